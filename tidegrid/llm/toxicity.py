"""Toxicity by a lexicon trie met with Levenshtein automata, and windows around each find.

The lexicon is learned: words far more frequent in toxic than in clean training documents. A word of a text is run through the product of the
trie and a Levenshtein automaton, made deterministic state by state, so a term is also found misspelled by one letter, or
masked by one digit or sign.
Each find has a window of words around it: an opening mark of quotation before it and a closing one after it there make it
quoted speech, further finds make it abuse. Sums over quoted and plain finds are the features of a logistic regression.

Training uses labelled rows whose crc32(id) modulo 5 is not 0, at most ``SAMPLE`` of them (in order of a hash of the id); labels
serve only there, and language, source and id never reach a score. Everything else covers all rows and whole texts.

Defined results: null or empty text has no finds and the score of such texts; without both kinds of training labels every
score is 0; a doc_id with several labels counts as toxic if one of them is; a null id is held out; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import common

#: Bounds of the classifier's fit: labelled rows in the sample (8 bytes each when sent to tasks) and terms in the lexicon.
SAMPLE, TERMS = 40_000, 4_000
#: A term's log odds, and the log-likelihood ratio (G squared) of its split between toxic and clean documents, reach these.
LEAST_ODDS, LEAST_G = 3.0, 24.0
FOLDS = 5
WINDOW = 8
#: Terms from this length on are also found with one edit.
EDIT_FROM = 5
#: Marks of quotation, double and single ones. Apostrophes count only at a chunk's outer edge, beside a word.
QUOTES = (frozenset("\"«»“”„"), frozenset("'‘’‹›"))
APOSTROPHES = frozenset("'’")
#: What a mark does where its place does not tell.
OPENING, CLOSING = frozenset("\"«“„‘‹"), frozenset("\"»”›")
LETTERS = re.compile(r"[^\W\d_]+")
#: Parts of a chunk between marks that stand between words; digits and other signs stay inside.
PARTS = re.compile(r"[^\s\-‐–—/\\,;:.…\"«»“”„‹›'‘’()\[\]{}<>]+")


def candidates(chunk: str) -> dict[str, None]:
    """Words of a chunk: its runs of letters, and what has a digit or sign inside (``id1ot``, ``st*pid``), without outer punctuation."""
    out = dict.fromkeys(LETTERS.findall(chunk))
    for part in (chunk, *PARTS.findall(chunk)):
        lo, hi = 0, len(part)
        while lo < hi and not part[lo].isalnum():
            lo += 1
        while lo < hi and not part[hi - 1].isalnum():
            hi -= 1
        if lo < hi:
            out[part[lo:hi]] = None
    return out


def marks(chunk: str, kind: frozenset[str]) -> list[str]:
    """For each mark of a kind: ``(`` if it opens (before a word), ``)`` if it closes (after one), ``|`` if it may do either."""
    if kind.isdisjoint(chunk):
        return []
    word = [p for p, c in enumerate(chunk) if c.isalnum()] or [len(chunk), -1]
    out = []
    for p, m in enumerate(chunk):
        if m not in kind:
            continue
        before, after = word[0] < p, word[-1] > p
        if before and after and m not in APOSTROPHES:  # inside: the side that touches a word
            before, after = chunk[p - 1].isalnum(), chunk[p + 1].isalnum()
        if before != after:
            out.append("(" if after else ")")
        elif m not in APOSTROPHES:
            out.append("|" if m in OPENING and m in CLOSING else "(" if m in OPENING else ")")
    return out


class LexiconAutomaton:
    """Finds words within one edit of a term: the subset construction of trie x Levenshtein automaton, grown as needed."""

    def __init__(self, terms: dict[str, float], most_states: int = 200_000):
        self.most_states = most_states
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, float] | None] = [None]
        for t, weight in sorted(terms.items()):
            at = 0
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                at = self.children[at][c]
            self.term[at] = (t, weight)
        self._reset()

    def _reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.known: dict[tuple, int] = {}
        self.next: list[dict[str, int]] = []
        self.start = self._state(self._closed({0: 0}))

    def _state(self, s: dict[int, int]) -> int:
        key = tuple(sorted(s.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(s)
            self.next.append({})
        return self.known[key]

    def _closed(self, s: dict[int, int]) -> dict[int, int]:
        """With the term's letters that the word may lack."""
        out = dict(s)
        for node, edits in s.items():
            if edits == 0:
                for child in self.children[node].values():
                    out.setdefault(child, 1)
        return out

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, edits in self.states[state].items():
            child = self.children[node].get(c)
            if child is not None:
                out[child] = min(edits, out.get(child, 9))
            if edits == 0:
                for other in self.children[node].values():
                    out.setdefault(other, 1)
                out.setdefault(node, 1)
        return self._state(self._closed(out))

    def find(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the nearest term (of equal ones the heaviest), or nothing."""
        if len(self.states) > self.most_states:
            self._reset()
        state = self.start
        for c in word:
            following = self.next[state].get(c)
            if following is None:
                following = self.next[state][c] = self._step(state, c)
            state = following
            if not self.states[state]:
                return None
        best = None
        for node, edits in self.states[state].items():
            if (t := self.term[node]) and (edits == 0 or len(t[0]) >= EDIT_FROM):
                if best is None or (edits, -t[1]) < (best[1], -best[0]):
                    best = (t[1], edits)
        return best


class Finder:
    """Features of a text. Chunks between white space are looked up once; ``capacity`` bounds the cache."""

    NAMES = ("plain", "misspelled", "quoted", "heaviest", "dense")

    def __init__(self, terms: dict[str, float], capacity: int = 400_000):
        self.automaton, self.capacity = LexiconAutomaton(terms), capacity
        self.known: dict[str, tuple[float, int] | None] = {}

    def _look(self, chunk: str) -> tuple[float, int] | None:
        found = [f for w in candidates(chunk.lower()) if (f := self.automaton.find(w))]
        if len(self.known) >= self.capacity:
            self.known.clear()
        self.known[chunk] = best = min(found, key=lambda f: (f[1], -f[0]), default=None)
        return best

    def quoted(self, chunks: list[str], i: int) -> bool:
        """Within a quotation: of one kind of marks, the nearest on the left opens it and the nearest on the right closes it.

        The chunk's own marks come first, then those of the window on either side.
        """
        for kind in QUOTES:
            own = marks(chunks[i], kind)
            left = next((m[-1] for c in reversed(chunks[max(0, i - WINDOW) : i]) if (m := marks(c, kind))), ")")
            right = next((m[0] for c in chunks[i + 1 : i + 1 + WINDOW] if (m := marks(c, kind))), "(")
            if ("(" in own or left != ")") and (")" in own or right != "("):
                return True
        return False

    def __call__(self, text: str) -> list[float]:
        chunks, known = text.split(), self.known
        finds = []
        for i, c in enumerate(chunks):
            f = known[c] if c in known else self._look(c)
            if f is not None:
                finds.append((i, f))
        plain = misspelled = quoted = heaviest = dense = 0.0
        for n, (i, (weight, edits)) in enumerate(finds):
            near = sum(1 for j in (n - 1, n + 1) if 0 <= j < len(finds) and abs(finds[j][0] - i) <= WINDOW)
            if self.quoted(chunks, i):
                quoted += 1
                continue
            plain += edits == 0
            misspelled += edits
            dense += near / 2
            heaviest = max(heaviest, weight / (1 + 2 * edits))
        return [float(np.log1p(plain)), float(np.log1p(misspelled)), float(np.log1p(quoted)), heaviest, float(np.log1p(dense))]


def _train_rows(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Texts of the labelled sample. Only the sample of labels, of bounded size, is sent to every task."""
    given = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("toxic")).where(
        F.col("l_id").isNotNull() & F.col("toxic").isNotNull() & (common.id_remainder(F.col("l_id"), FOLDS) != 0)
    )
    sample = given.groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE)
    return rows.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("text", "toxic")


def learn_terms(train: DataFrame) -> dict[str, float]:
    """Terms and their log odds."""
    schema = pa.schema([("word", pa.string()), ("bad", pa.int64()), ("good", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        sizes = [0, 0]
        for texts, toxic in common.records(batches, "text", "toxic"):
            for text, t in zip(texts, toxic):
                (bad if t else good).update({w for w in LETTERS.findall(text.lower()) if len(w) < 60})
                sizes[bool(t)] += 1
        words = list({**bad, **good})
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            yield common.batch(schema, part, [bad[w] for w in part], [good[w] for w in part], [0] * len(part))
        yield common.batch(schema, ["", ""], [sizes[1], 0], [0, sizes[0]], [1, 1])

    counts = train.mapInArrow(count, "word string, bad long, good long, docs long")
    # the empty word holds the numbers of documents
    sums = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("docs").alias("docs"))
    totals = sums.where("docs = 1")
    bad, good = F.col("bad"), F.col("good")
    one = totals.select(bad.alias("nb"), good.alias("ng"))
    odds = F.log((bad + 0.5) / (F.col("nb") + 1)) - F.log((good + 0.5) / (F.col("ng") + 1))
    share, df = F.col("nb") / (F.col("nb") + F.col("ng")), bad + good
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    g = 2 * (part(bad, df * share) + part(good, df * (1 - share)))
    found = (
        sums.where((F.col("docs") == 0) & (bad > 1)).join(F.broadcast(one))  # one row
        .where("nb > 0 AND ng > 0").select("word", odds.alias("odds"), g.alias("g"))
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
        .orderBy(F.desc("g"), "word").limit(TERMS)
    )
    return {r.word: float(r.odds) for r in found.collect()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, float], weights: np.ndarray | None):
        self.terms, self.weights = terms, weights

    def finder(self) -> Finder:
        return Finder(self.terms)

    def score(self, features: list[list[float]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        x = np.array(features, float).reshape(len(features), len(Finder.NAMES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Lexicon and weights; what reaches the driver is bounded by ``TERMS`` and ``SAMPLE`` rows of features."""
    train = _train_rows(common.texts(docs), labels, id_col, label_col)
    terms = learn_terms(train)
    schema = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(terms)
        for texts, toxic in common.records(batches, "text", "toxic"):
            yield common.batch(schema, [find(t) for t in texts], toxic)

    rows = train.mapInArrow(features, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    y = np.array([float(r.toxic > 0) for r in rows for _ in range(r["count"])])
    if len(set(y)) < 2:
        return Model(terms, None)
    return Model(terms, fit(np.array([r.x for r in rows for _ in range(r["count"])]), y))


def held_out(id_col: Column) -> Column:
    return common.id_remainder(id_col, FOLDS) == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model.finder()
        for ids, texts in common.records(batches, "doc_id", "text"):
            yield common.batch(schema, ids, model.score([find(t) for t in texts]))

    return common.texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all their columns, that are not predicted toxic."""

    @F.pandas_udf("boolean")
    def clean(texts):
        find = finders.get("f") or finders.setdefault("f", model.finder())
        return texts.map(lambda t: bool(model.score([find(t or "")])[0] < 0.5)).astype(bool)

    finders: dict[str, Finder] = {}
    return docs.where(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
