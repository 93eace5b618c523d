"""Language-model scores by context-tree weighting over bytes.

A text is a sequence of tokens: words (lower-cased A-Z, between white space) and one end. A word is coded by its bytes and a space, the
end by a space alone, so the code is free of prefixes and every text has a probability. A byte is eight binary decisions. A decision at
depth d has the last d bytes of its token as context (spaces before the token's start) and a Krichevsky-Trofimov estimate
from the training counts of that context; all depths from 0 to ``DEPTH`` are mixed by context-tree weighting: with
Pe a node's estimate and Pw the product of its children's weighted probabilities, Pw(node) = Pe / 2 + prod Pw(children) / 2, and a
node's share in a prediction is Pe / 2 / Pw.

Spark job. Words are counted per task, then summed; everything after works on distinct words. Blocks of words emit their
distinct (context, byte) grams, so a gram is summed once for each block. Grams are dealt by the last three bytes of their context, their
group: the tree below such a node is complete there. The three top levels are grouped sums. The way back is the same: grams return to
the blocks of words, words to the blocks of documents, each block with each distinct one once. The grams that a block has of a group
travel as one row. A task holds the distinct grams of the groups at hand, not the rows that ask for them. No model is collected or
broadcast, so it may grow with the corpus.

Across words. ``score`` cuts contexts at the start of each word. ``score_texts`` codes the same bytes with contexts from the
whole text: the last d bytes, across spaces and words (spaces before the text's start), so the order of words counts. Then
grams come from the texts: blocks of documents emit their distinct grams with the training counts, and get them back
scored; a gram goes there and back once for each block.

Training documents are those whose crc32(id) modulo 7 is not 2.

Defined results: null or blank text has the end only; without training documents every count is 0 and each bit costs one bit;
rows that repeat an id are texts of their own; a null id counts as the empty text in the fold. Words are told apart by 64-bit hashes
when they return to documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import common
from tidegrid.llm.staging import staged

DEPTH = 6
FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block of documents, and words in a block of words: what a task holds at once.
DOC_BLOCK, WORD_BLOCK = 32 << 20, 300_000
#: Bytes of text whose grams a task makes at a time, and grams that it holds before equal ones are summed.
GRAM_BYTES, GRAMS_HELD = 1 << 20, 4_000_000
#: Texts that a task compresses at once.
TEXTS = 256
#: Bytes of packed grams that a task works on at a time, at least, and rows that it adds to them at once.
TABLE_BYTES, PART_ROWS = 4 << 20, 2_000
LN2, LN10 = math.log(2), math.log(10)


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: both know ASCII only


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


# estimates


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, brought back by the recursion."""
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_gamma_column(x: Column) -> Column:
    """As ``log_gamma``, as an expression."""
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - F.log(low)


def log_kt(n0, n1, lg) -> np.ndarray | Column:
    """Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lg(n0 + 0.5) + lg(n1 + 0.5) - lg(n0 + n1 + 1.0) - math.log(math.pi)


#: Counts whose logarithms of the gamma function are looked up.
SMALL = 1 << 12
_HALVES, _WHOLES = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def _looked_up(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """``log_gamma(n + more)`` for whole numbers."""
    out = table[np.minimum(n, SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= SMALL)
    out[large] = log_gamma(n[large] + more)
    return out


def log_kt_counts(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """``log_kt`` with ``log_gamma`` for whole numbers."""
    return _looked_up(n0, _HALVES, 0.5) + _looked_up(n1, _HALVES, 0.5) - _looked_up(n0 + n1, _WHOLES, 1.0) - math.log(math.pi)


# grams


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every coded byte, and the index of its word.

    A gram is one number: the last three bytes of the context, the third last first (the group), then the fourth last to the sixth last,
    then the byte. In the order of these numbers the grams of a context of three bytes or more stand together.
    """
    pad = b" " * DEPTH
    data = np.frombuffer(b"".join([pad + w + b" " for w in words]), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(owner)) + DEPTH * (owner + 1)
    key = np.zeros(len(owner), np.int64)
    for back in (3, 2, 1, *range(4, DEPTH + 1), 0):
        key = key << 8 | data[at - back]
    return key, owner


def pack(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The groups of sorted grams, and for each the rest of its grams and its values as bytes."""
    group = key >> 32
    first = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(first, len(key))

    def joined(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    return group[first], [joined((key & 0xFFFFFFFF).astype(np.uint32)), *map(joined, values)]


def unpack(group: np.ndarray, lows: list[bytes], values: list[bytes] | None = None, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray | None]:
    """Grams, and their values, of packed rows."""
    rest = np.frombuffer(b"".join(lows), np.uint32).astype(np.int64)
    key = np.repeat(group, np.fromiter(map(len, lows), np.int64, len(lows)) // 4) << 32 | rest
    return key, None if values is None else np.frombuffer(b"".join(values), kind)


def _levels(key: np.ndarray, cnt: np.ndarray, down: bool):
    """For each of the 8 decisions of sorted distinct grams: what depth 3 passes up, and the probability of a one from depth 3 down.

    Yields each gram's bit and its place among the deepest nodes, keys of (context, node) at depth 3, n0, n1, log Pw, and for the deepest
    nodes the mixed probability of a one and the index into the keys (both only if ``down``).
    """
    ctx, sym = key >> 8, key & 255
    for k in range(8):
        node, bit = (1 << k) | (sym >> (8 - k)), (sym >> (7 - k)) & 1
        path = ctx << 8 | node  # sorted as the grams are
        new = np.diff(path, prepend=-1) != 0
        first, place = np.flatnonzero(new), np.cumsum(new) - 1
        u, n1 = path[first], np.add.reduceat(cnt * bit, first)
        n0 = np.add.reduceat(cnt, first) - n1
        pw = log_kt_counts(n0, n1)
        one, above = (n1 + 0.5) / (n0 + n1 + 1), []
        for _ in range(DEPTH - 3):
            u, inv = np.unique(u >> 16 << 8 | u & 255, return_inverse=True)  # without the oldest byte
            n0, n1, children = (np.bincount(inv, x, len(u)) for x in (n0, n1, pw))
            pe = log_kt_counts(n0, n1)
            pw = np.logaddexp(pe, children) - LN2
            if down:
                above.append((inv, np.exp(pe - LN2 - pw), (n1 + 0.5) / (n0 + n1 + 1)))
        at = np.arange(len(one))
        for inv, share, kt in above:
            at = inv[at]
            one = share[at] * kt[at] + (1 - share[at]) * one
        yield bit, place, u, n0, n1, pw, one, at


def _sorted_rows(
    batches: Iterator[pa.RecordBatch], whole: Callable[[pa.RecordBatch], np.ndarray], table_bytes: int, part_rows: int
) -> Iterator[pa.Table]:
    """Rows in tables of ``table_bytes`` or more; a table ends before a new group or where ``whole`` lets a row begin another."""
    held, size = [], 0
    for b in batches:
        for part in (b.slice(at, part_rows) for at in range(0, b.num_rows, part_rows)):
            if size >= table_bytes:
                last = held[-1].column("group")[-1].as_py()
                free = np.flatnonzero((part.column("group").to_numpy() != last) | whole(part))
                if len(free):
                    cut = int(free[0])
                    yield pa.Table.from_batches([*held, part.slice(0, cut)])
                    held, size, part = [], 0, part.slice(cut)
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def _chunks(schema: pa.Schema, columns: list, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), size):
        yield common.batch(schema, *(c[at : at + size] for c in columns))


def top_levels(u3: DataFrame) -> DataFrame:
    """(ctx2, node) with ``a``, ``b``: the prediction from the root down is a + b * (that from depth 3 down)."""
    level, parts = u3.select(F.expr("group & 65535").alias("ctx"), "node", "n0", "n1", "pw"), []
    for d in (2, 1, 0):
        sums = level.groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("children"))
        pe = log_kt(F.col("n0"), F.col("n1"), log_gamma_column)
        high = F.greatest("pe", "children")
        pw = high + F.log(F.exp(F.col("pe") - high) + F.exp(F.col("children") - high)) - LN2
        own = sums.withColumn("pe", pe).withColumn("pw", pw)
        parts.append(own.select(
            F.col("ctx").alias(f"ctx{d}"), F.col("node").alias(f"node{d}"),
            F.exp(F.col("pe") - LN2 - F.col("pw")).alias(f"share{d}"), ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias(f"kt{d}"),
        ))
        level = own.select((F.col("ctx").bitwiseAND(255) if d == 2 else F.lit(0).cast("long")).alias("ctx"), "node", "n0", "n1", "pw")
    two, one, root = parts
    joined = two.join(one, (F.col("ctx2").bitwiseAND(255) == F.col("ctx1")) & (F.col("node2") == F.col("node1"))).join(root, F.col("node2") == F.col("node0"))
    s0, s1, s2 = (F.col(f"share{d}") for d in range(3))
    k0, k1, k2 = (F.col(f"kt{d}") for d in range(3))
    return joined.select(
        "ctx2", F.col("node2").alias("node"), (s0 * k0 + (1 - s0) * (s1 * k1 + (1 - s1) * s2 * k2)).alias("a"), ((1 - s0) * (1 - s1) * (1 - s2)).alias("b")
    )


def gram_answers(asked: DataFrame) -> DataFrame:
    """(block, group, lows, logps): natural log probability of the byte of each gram in its context, for the packed (block, group, lows, ns)."""
    up = pa.schema([
        ("group", pa.int64()), ("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("pw", pa.float64()), ("lows", pa.binary()), ("ns", pa.binary())
    ])

    def pass_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            group, (lows, ns) = pack(key, n)
            none = [pa.nulls(len(group), f.type) for f in list(up)[1:5]]
            yield pa.RecordBatch.from_arrays([pa.array(group), *none, lows, ns], schema=up)
            for _, _, u, n0, n1, pw, _, _ in _levels(key, n.astype(float), down=False):
                for at in range(0, len(u), 50_000):
                    some = [x[at : at + 50_000] for x in (u >> 8, u & 255, n0, n1, pw)]
                    none = [pa.nulls(len(some[0]), pa.binary())] * 2
                    yield pa.RecordBatch.from_arrays([*map(pa.array, some), *none], schema=up)

        # blocks repeat a group's grams: what is held of an open group is summed
        open_key, open_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in _sorted_rows(batches, lambda part: np.ones(part.num_rows, bool), TABLE_BYTES, PART_ROWS):
            key, n = unpack(t.column("group").to_numpy(), *(t.column(c).to_pylist() for c in ("lows", "ns")))
            key, n = _summed([open_key, key], [open_n, n])
            cut = int(np.searchsorted(key, key[-1] >> 32 << 32))
            yield from told(key[:cut], n[:cut])
            open_key, open_n = key[cut:], n[cut:]
        yield from told(open_key, open_n)

    ordered = asked.select("group", "lows", "ns").repartition("group").sortWithinPartitions("group")
    seen = staged(ordered.mapInArrow(pass_up, "group long, node long, n0 double, n1 double, pw double, lows binary, ns binary"), "contexts")
    u3 = seen.where("node IS NOT NULL").drop("lows", "ns")
    tops = top_levels(u3).withColumnRenamed("node", "top")
    back = u3.select("group", "node").join(tops, (F.col("node") == F.col("top")) & (F.col("ctx2") == F.expr("group & 65535")))
    # of a group, a task first sees what comes from above, then the counts, then the blocks that ask
    none = {"block": "long", "node": "long", "a": "double", "b": "double", "lows": "binary", "ns": "binary"}

    def row(df: DataFrame, kind: int) -> DataFrame:
        return df.select("group", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    counts = seen.where("node IS NULL").select("group", "lows", "ns")
    every = row(back.select("group", "node", "a", "b"), 0).unionByName(row(counts, 1)).unionByName(row(asked.select("block", "group", "lows"), 2))
    out = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("lows", pa.binary()), ("logps", pa.binary())])

    def pass_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logps = np.zeros(0, np.int64), np.zeros(0)  # of the last group, which blocks may go on to ask for
        for t in _sorted_rows(batches, lambda part: part.column("kind").to_numpy() == 2, TABLE_BYTES, PART_ROWS):
            kind = t.column("kind").to_numpy()
            above, counted, asks = (t.filter(pa.array(kind == k)) for k in range(3))
            if counted.num_rows:
                group, node = _columns(above, "group", "node")
                top = group << 8 | node.astype(np.int64)
                order = np.argsort(top)
                top, a, b = top[order], *(x[order] for x in _columns(above, "a", "b"))
                key, n = unpack(counted.column("group").to_numpy(), *(counted.column(c).to_pylist() for c in ("lows", "ns")))
                logp = np.zeros(len(key))
                for bit, place, u, _, _, _, one, at in _levels(key, n.astype(float), down=True):
                    at = np.searchsorted(top, u)[at]
                    p = (a[at] + b[at] * one)[place]
                    logp += np.log(np.where(bit == 1, p, 1 - p))
                known, logps = np.concatenate([known, key]), np.concatenate([logps, logp])
            if asks.num_rows:
                group, lows = asks.column("group").to_numpy(), asks.column("lows").to_pylist()
                key, _ = unpack(group, lows)
                found = logps[np.searchsorted(known, key)].tobytes()
                ends = np.cumsum([0, *map(len, lows)]) * 2  # eight bytes for four
                parts = [found[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield common.batch(out, asks.column("block").to_pylist(), group, lows, parts)
            last = int(np.searchsorted(known, t.column("group")[-1].as_py() << 32))
            known, logps = known[last:], logps[last:]

    ddl = "block long, group long, lows binary, logps binary"
    return every.repartition("group").sortWithinPartitions("group", "kind").mapInArrow(pass_down, ddl)


# words and documents


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n): training count of every word of all texts; the empty word stands for the end."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for texts, train in common.records(batches, "text", "train"):
            get = counts.get
            for text, t in zip(texts, train):
                words = tokens(text)
                words.append(b"")
                if t:
                    for w in words:
                        counts[w] = get(w, 0) + 1
                else:
                    for w in words:
                        if w not in counts:
                            counts[w] = 0
            if len(counts) > 1_000_000:
                yield from _chunks(schema, [list(counts), list(counts.values())])
                counts = {}
        if counts:
            yield from _chunks(schema, [list(counts), list(counts.values())])

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_scores(words: DataFrame, n_words: int) -> DataFrame:
    """(wh, n, logp) of every word of (word, n)."""
    blocks = max(1, -(-n_words // WORD_BLOCK))
    words = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)))
    schema = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("lows", pa.binary()), ("ns", pa.binary())])

    def emit(t: pa.Table) -> pa.Table:
        key, owner = grams(t.column("word").to_pylist())
        n = t.column("n").to_numpy()
        group, packed = pack(*_summed([key], [n[owner]]))
        return pa.table([np.full(len(group), t.column("block")[0].as_py()), group, *packed], schema=schema)

    asked = staged(words.groupBy("block").applyInArrow(emit, "block long, group long, lows binary, ns binary"), "grams")
    answers = gram_answers(asked)
    out = pa.schema([("wh", pa.int64()), ("n", pa.int64()), ("logp", pa.float64())])

    def add(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        found = t.column("word").to_pylist()
        key, owner = grams(found)
        gram, logp = unpack(known.column("group").to_numpy(), *(known.column(c).to_pylist() for c in ("lows", "logps")), np.float64)
        order = np.argsort(gram)
        each = logp[order][np.searchsorted(gram[order], key)]
        return pa.table([[word_hash(w) for w in found], t.column("n"), np.bincount(owner, each, len(found))], schema=out)

    return words.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, "wh long, n long, logp double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text."""
    rows = common.texts(docs).withColumn("held_out", common.id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT)
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    words = staged(count_words(rows.select("text", (~F.col("held_out")).alias("train"))), "words")
    total = words.agg(F.count("*").alias("w"), F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    all_n, distinct = total.n or 0, total.v
    known = staged(word_scores(words, total.w), "scores")

    blocks = max(1, -(-size // DOC_BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", common.text_key(F.col("text"))), F.lit(blocks)))
    ask_schema = pa.schema([("block", pa.int64()), ("wh", pa.int64())])

    def ask(t: pa.Table) -> pa.Table:
        distinct_words: set[bytes] = {b""}
        for text in t.column("text"):
            distinct_words.update(tokens(text.as_py()))
        return pa.table([[t.column("block")[0].as_py()] * len(distinct_words), [word_hash(w) for w in distinct_words]], schema=ask_schema)

    answers = dealt.groupBy("block").applyInArrow(ask, "block long, wh long").join(known, "wh")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    out = pa.schema(list(zip(names, kinds)))

    def add(t: pa.Table, answer: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        wh, n, logp = _columns(answer, "wh", "n", "logp")
        order = np.argsort(wh)
        wh, n = wh[order], n[order]
        model, base, seen = logp[order] / LN10, np.log10((n + 1) / (all_n + distinct + 1)), n > 0
        index: dict[bytes, int] = {}
        result = []
        for doc_id, held, text in zip(*(t.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            found = tokens(text)
            found.append(b"")
            new = [w for w in found if w not in index]
            if new:
                index.update(zip(new, np.searchsorted(wh, [word_hash(w) for w in new]).tolist()))
            at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
            log10 = float(model[at].sum())
            coded = sum(map(len, found)) + len(found)
            result.append((doc_id, held, len(found), int(seen[at].sum()), all_n, float(base[at].sum()), log10, -log10 * LN10 / LN2 / coded))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*result), out)], schema=out)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, ddl)


def coded(words: list[bytes]) -> bytes:
    """A text's code without the space of its end."""
    return b"".join(w + b" " for w in words)


def _some(sizes: list[int], n_bytes: int) -> Iterator[slice]:
    """Slices of texts of about ``n_bytes`` together."""
    at = size = 0
    for i, n in enumerate(sizes):
        size += n + DEPTH + 1
        if size >= n_bytes:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts; both lists are emptied. Sorted parts are only merged."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    keys.clear()
    counts.clear()
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.int64)
    del order
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(n) else n


def _counted(key: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and how many of each have ``yes``."""
    both = np.sort(key << 1 | yes)  # a gram has 56 bits
    key = both >> 1
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(both & 1, first)


def _squeezed(rows: DataFrame) -> DataFrame:
    """``rows`` with texts as compressed bytes, and their sizes: they move twice."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("size", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                texts = part.column("text").to_pylist()
                some = [codec.compress(x, asbytes=True) if x else b"" for x in texts]
                yield common.batch(schema, *(part.column(c).to_pylist() for c in ("block", "doc_id", "held_out")), list(map(len, texts)), some)

    return rows.mapInArrow(run, "block long, doc_id long, held_out boolean, size long, text binary")


def _told(t: pa.Table, part: slice) -> list[list[bytes]]:
    """The words of some squeezed texts."""
    codec = pa.Codec("zstd")
    pairs = zip(*(t.column(c)[part].to_pylist() for c in ("text", "size")))
    return [codec.decompress(x, n, asbytes=True).lower().split() if n else [] for x, n in pairs]


def score_texts(docs: DataFrame) -> DataFrame:
    """The columns of ``score``, with contexts across words."""
    rows = common.texts(docs).withColumn("held_out", common.id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT)
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, -(-size // DOC_BLOCK))
    block = F.pmod(F.xxhash64("doc_id", common.text_key(F.col("text"))), F.lit(blocks)).alias("block")
    dealt = _squeezed(rows.select(block, "doc_id", "held_out", F.col("text").cast("binary").alias("text")))
    schema = pa.schema([("block", pa.int64()), ("wh", pa.int64()), ("n", pa.int64()), ("group", pa.int64()), ("lows", pa.binary()), ("ns", pa.binary())])

    def emit(t: pa.Table) -> pa.Table:
        train, sizes = ~t.column("held_out").to_numpy(), t.column("size").to_pylist()
        counts: dict[bytes, int] = {}
        keys, sums, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for part in _some(sizes, GRAM_BYTES):
            found = _told(t, part)
            for words, yes in zip(found, train[part].tolist()):
                for w in (*words, b""):
                    counts[w] = counts.get(w, 0) + yes
            key, owner = grams(list(map(coded, found)))
            u, n = _counted(key, train[part][owner])
            keys.append(u)
            sums.append(n)
            held += len(u)
            if held > GRAMS_HELD:
                u, n = _summed(keys, sums)
                keys, sums, held = [u], [n], 0
                del u, n
        u, n = _summed(keys, sums)
        group, packed = pack(u, n)
        hashes = np.fromiter(map(word_hash, counts), np.int64, len(counts))
        n_words = np.fromiter(counts.values(), np.int64, len(counts))
        block = np.full(len(counts) + len(group), t.column("block")[0].as_py())
        few, many = (lambda kind: pa.nulls(len(counts), kind)), (lambda: pa.nulls(len(group), pa.int64()))
        columns = [(pa.array(hashes), many()), (pa.array(n_words), many()), (few(pa.int64()), pa.array(group)), *((few(pa.binary()), x) for x in packed)]
        return pa.table([block, *map(pa.chunked_array, columns)], schema=schema)

    asked = staged(dealt.groupBy("block").applyInArrow(emit, "block long, wh long, n long, group long, lows binary, ns binary"), "grams", "zstd")
    of_words = asked.where("wh IS NOT NULL")
    words = staged(of_words.groupBy("wh").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    all_n, distinct = total.n or 0, total.v
    no_gram = (F.lit(None).cast(t).alias(c) for c, t in (("group", "long"), ("lows", "binary"), ("logps", "binary")))
    no_word = (F.lit(None).cast("long").alias(c) for c in ("wh", "n"))
    answers = of_words.select("block", "wh").join(words, "wh").select("block", "wh", "n", *no_gram).unionByName(
        gram_answers(asked.where("wh IS NULL").select("block", "group", "lows", "ns")).select("*", *no_word)
    )
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    out = pa.schema(list(zip(names, kinds)))

    def add(t: pa.Table, answer: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        kind = answer.column("wh").is_valid()
        count = dict(zip(*(answer.column(c).filter(kind).to_pylist() for c in ("wh", "n"))))
        told = answer.filter(pc.invert(kind))
        gram, logp = unpack(told.column("group").to_numpy(), *(told.column(c).to_pylist() for c in ("lows", "logps")), np.float64)
        order = np.argsort(gram)
        gram, logp = gram[order], logp[order]
        result, sizes = [], t.column("size").to_pylist()
        for part in _some(sizes, GRAM_BYTES):
            found = _told(t, part)
            asked_key, owner = grams(list(map(coded, found)))
            u, inv = np.unique(asked_key, return_inverse=True)
            each = np.bincount(owner, logp[np.searchsorted(gram, u)][inv], len(found))
            ids, held = (t.column(c)[part].to_pylist() for c in ("doc_id", "held_out"))
            for i, h, words, ln in zip(ids, held, found, each.tolist()):
                n = np.array([count[word_hash(w)] for w in (*words, b"")])
                base = float(np.log10((n + 1) / (all_n + distinct + 1)).sum())
                n_coded = sum(map(len, words)) + len(words) + 1
                result.append((i, h, len(n), int((n > 0).sum()), all_n, base, ln / LN10, -ln / LN2 / n_coded))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*result), out)], schema=out)

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, ddl)
