"""Removal of long repeated byte strings by prefix-free parsing.

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere else in the corpus.

Parse. A rolling hash of ``GRAM`` bytes is computed at every position. The trigger of a start is the position of the smallest hash in the
``window`` after it, so equal strings have equal triggers wherever they stand; starts in a row that share a trigger form a phrase. A
phrase's word is the text from its first start to ``length`` bytes after its last: it holds every string that starts in the phrase.

Dictionary. Equal words are one entry, whatever their number. All strings of a word that occurs twice are repeated: the parse
alone decides them. Suffix order is needed only to ``length`` bytes, so it comes down to classes of equal prefixes. They are looked for
only among different words with the same bytes after the trigger (``key``): cells of starts are compared by what all their
strings share (no equal cell: no repeat) and by all they span (equal cell: all repeated), and only cells between the two are halved
further, down to single strings.

Scale. A task emits a word at most twice, so copies and frequent passages are summed before the shuffle. Words meet in a stream
sorted by key that holds one row. Entries with the same key are held together up to ``GROUP``; larger groups send a
hash for each string instead, which is exact too and spreads over all tasks. Texts move once.

Defined results: null text counts as empty; texts shorter than ``length`` keep all; rows that repeat an id and text repeat
each other; a null id is an id like others. Keys and words together are 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import common
from tidegrid.llm.staging import staged

GRAM = 16
#: Most dictionary entries of one key that a task compares by itself.
GROUP = 4096
#: Starts in a cell, from the widest to single ones.
CELLS = (32, 8, 2, 1)
#: Words that a task remembers at most.
REMEMBERED = 2_000_000

_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each position, by doubling."""
    h, width, factor = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    return h ^ (h >> np.uint64(31))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v) - w + 1
    pad = np.pad(v, (0, -len(v) % w), constant_values=np.iinfo(np.uint64).max).reshape(-1, w)
    head = np.minimum.accumulate(pad, axis=1).reshape(-1)
    tail = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def phrases(data: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first start and last start of each phrase."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    h = rolling(data[: n + window + GRAM - 2])
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(v, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first, np.append(first[1:], n) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


PARSED = pa.schema([(c, pa.int64()) for c in ("key", "word", "doc_id", "tk")] + [(c, pa.int32()) for c in ("start", "n", "off")] + [("done", pa.bool_())])


def parse(rows: DataFrame, length: int, window: int) -> DataFrame:
    """Phrases of all texts. ``done``: this task has seen the word before, so it is repeated."""
    key_bytes = length - window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], bool] = {}
        for ids, tks, texts in common.records(batches, "doc_id", "tk", "text"):
            out = []
            for doc_id, tk, text in zip(ids, tks, texts):
                b = text.encode()
                for t, lo, hi in zip(*(x.tolist() for x in phrases(np.frombuffer(b, np.uint8), length, window))):
                    key = _signed(xxhash.xxh3_64_intdigest(b[t : t + key_bytes]))
                    word = _signed(xxhash.xxh3_64_intdigest(b[lo : hi + length], seed=1 + t - lo))
                    pair = (key, word)
                    if pair not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[pair] = False
                        out.append((key, word, doc_id, tk, lo, hi - lo + 1, t - lo, False))
                    elif not seen[pair]:
                        seen[pair] = True  # the second one tells the others that the word is repeated
                        out.append((key, word, doc_id, tk, lo, hi - lo + 1, t - lo, False))
                    else:
                        out.append((_signed(xxhash.xxh3_64_intdigest(b"%d" % lo, seed=tk % 2**64)), 0, doc_id, tk, lo, hi - lo + 1, 0, True))
                if len(out) > 20_000:
                    yield common.batch(PARSED, *zip(*out))
                    out = []
            if out:
                yield common.batch(PARSED, *zip(*out))

    return rows.mapInArrow(run, "key long, word long, doc_id long, tk long, start int, n int, off int, done boolean")


FOUND = pa.schema([(c, pa.int64()) for c in ("key", "doc_id", "tk")] + [(c, pa.int32()) for c in ("start", "n", "off")] + [("kind", pa.int32())])
SPAN, SINGLE, OTHER = 0, 1, 2


def dictionary(parsed: DataFrame) -> DataFrame:
    """Per row: a repeated phrase (``SPAN``), or an entry that shares its key with others: a word that occurs once (``SINGLE``) or
    one occurrence of a repeated word (``OTHER``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, shared, out = None, 0, False, []
        names = ("key", "word", "doc_id", "tk", "start", "n", "off", "done")

        def entry(row, times):
            return (row[0], row[2], row[3], row[4], row[5], row[6], SINGLE if times == 1 else OTHER)

        def span(row):
            return (row[0], row[2], row[3], row[4], row[5], row[6], SPAN)

        for columns in common.records(batches, *names):
            for row in zip(*columns):
                if row[7]:
                    out.append(span(row))
                elif first is not None and row[0] == first[0] and row[1] == first[1]:
                    count += 1
                    if count == 2:
                        out.append(span(first))
                    out.append(span(row))
                else:
                    if first is not None:
                        same = row[0] == first[0]
                        if shared or same:
                            out.append(entry(first, count))
                        shared = same
                    first, count = row, 1
            if len(out) > 20_000:
                yield common.batch(FOUND, *zip(*out))
                out = []
        if first is not None and shared:
            out.append(entry(first, count))
        if out:
            yield common.batch(FOUND, *zip(*out))

    # resolved rows come first in the order, so that no key is interrupted
    ordered = parsed.repartition(F.col("key")).sortWithinPartitions(F.desc("done"), "key", "word")
    return ordered.mapInArrow(run, "key long, doc_id long, tk long, start int, n int, off int, kind int")


BODY = pa.schema([("big", pa.bool_())] + [(c, pa.int64()) for c in ("key", "key2", "doc_id", "tk")] + [(c, pa.int32()) for c in ("start", "n", "off", "kind")] + [("body", pa.binary())])


def _bodies(rows: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """Entries with their word's bytes; entries of large groups as one row for each string, under the string's hash."""
    per_text = entries.groupBy("doc_id", "tk").agg(
        # bounded by the text's length
        F.collect_list(F.struct("big", "key", "start", "n", "off", "kind")).alias("entries")
    )
    e = per_text.select(F.col("doc_id").alias("e_id"), F.col("tk").alias("e_tk"), "entries")
    joined = rows.join(e, rows["doc_id"].eqNullSafe(e["e_id"]) & (rows["tk"] == e["e_tk"])).select(*rows.columns, "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in common.records(batches, "doc_id", "tk", "text", "entries"):
            out = []
            for doc_id, tk, text, found in zip(*columns):
                b = text.encode()
                for x in found:
                    lo, n = x["start"], x["n"]
                    if not x["big"]:
                        out.append((False, x["key"], 0, doc_id, tk, lo, n, x["off"], x["kind"], b[lo : lo + n - 1 + length]))
                        continue
                    for i in range(lo, lo + n):
                        h = xxhash.xxh3_128_intdigest(b[i : i + length])
                        out.append((True, _signed(h >> 64), _signed(h & (2**64 - 1)), doc_id, tk, i, 1, 0, x["kind"], None))
                    if len(out) > 5_000:
                        yield common.batch(BODY, *zip(*out))
                        out = []
                if len(out) > 5_000:
                    yield common.batch(BODY, *zip(*out))
                    out = []
            if out:
                yield common.batch(BODY, *zip(*out))

    return joined.mapInArrow(run, "big boolean, key long, key2 long, doc_id long, tk long, start int, n int, off int, kind int, body binary")


def compare(entries: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(entry, first, last) starts of repeated strings, relative to the word, of entries that occur once.

    An entry is (n, off, single, body): ``off`` is the trigger's distance from the first start. Distances from the trigger put
    the starts of different words side by side.
    """
    out = []
    widest = CELLS[0]
    todo = [(e, c) for e, (n, off, _, _) in enumerate(entries) for c in range((off - n + 1) // widest, off // widest + 1)]
    for level, size in enumerate(CELLS):
        by_core: dict[tuple, dict[bytes | tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for e, c in todo:
            n, off, _, body = entries[e]
            # the cell holds distances [c * size, c * size + size) from the trigger; its starts run the other way
            last, first = off - c * size, off - c * size - size + 1
            core = body[last : first + length]
            whole = body[first : last + length] if first >= 0 and last < n else (e,)
            by_core[c, core][whole].append(e)
        halved = []
        for (c, _), wholes in by_core.items():
            for whole, members in wholes.items():
                if len(members) > 1:
                    for e in members:
                        n, off, single, _ = entries[e]
                        if single:
                            out.append((e, off - c * size - size + 1, off - c * size))
            if len(wholes) > 1 and size > 1:
                step = size // CELLS[level + 1]
                for members in wholes.values():
                    e = members[0]  # one stands for all equal ones
                    n, off = entries[e][:2]
                    for part in range(c * step, (c + 1) * step):
                        if part * CELLS[level + 1] <= off and (part + 1) * CELLS[level + 1] > off - n + 1:
                            halved.append((e, part))
        todo = halved
    return out


def _edges(bodies: DataFrame, length: int) -> DataFrame:
    """Repeated strings (doc_id, tk, start, n) of words that occur once."""
    schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
    names = [f.name for f in BODY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, key = [], [], None
        first, count = None, 0

        def settle():
            for e, lo, hi in compare([(r[6], r[7], r[8] == SINGLE, r[9]) for r in group], length):
                out.append((group[e][3], group[e][4], group[e][5] + lo, hi - lo + 1))
            group.clear()

        for columns in common.records(batches, *names):
            for row in zip(*columns):
                if row[0]:  # a string's hash: repeated if the next row has it too
                    if first is not None and (row[1], row[2]) == (first[1], first[2]):
                        count += 1
                        if count == 2 and first[8] == SINGLE:
                            out.append((first[3], first[4], first[5], 1))
                        if row[8] == SINGLE:
                            out.append((row[3], row[4], row[5], 1))
                    else:
                        first, count = row, 1
                    continue
                if row[1] != key:
                    settle()
                    key = row[1]
                group.append(row)
            if len(out) > 20_000:
                yield common.batch(schema, *zip(*out))
                out = []
        settle()
        if out:
            yield common.batch(schema, *zip(*out))

    ordered = bodies.repartition(F.col("key")).sortWithinPartitions("big", "key", "key2")
    return ordered.mapInArrow(run, "doc_id long, tk long, start int, n int")


def repeated_spans(rows: DataFrame, length: int, window: int) -> DataFrame:
    """doc_id, tk and ``spans`` (start and number of repeated strings) of texts (doc_id, tk, text, ...) that have any.

    Other columns are carried to where the texts are, so that a caller who joins ``rows`` on the same keys needs no second shuffle.
    """
    found = staged(dictionary(parse(rows.select("doc_id", "tk", "text"), length, window)), "repeats")
    entries = found.where(F.col("kind") != SPAN)
    large = entries.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select("key", F.lit(True).alias("big"))
    entries = entries.join(large, "key", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    edges = _edges(_bodies(rows, entries, length), length)
    spans = found.where(F.col("kind") == SPAN).select("doc_id", "tk", "start", "n").unionByName(edges)
    return spans.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # bounded by the text's length


def removed(n_bytes: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Edges (start, end) of the maximal removed runs."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    begin = np.array([s["start"] for s in spans], np.int64)
    end = begin + np.array([s["n"] for s in spans], np.int64) - 1 + length
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return np.column_stack([begin[new], end[np.append(new[1:], len(end)) - 1]])


def kept(b: bytes, runs: np.ndarray) -> bytes:
    at, out = 0, []
    for lo, hi in runs.tolist():
        out.append(b[at:lo])
        at = hi
    return b"".join([*out, b[at:]])


def _with_spans(rows: DataFrame, length: int, window: int) -> DataFrame:
    """All rows (doc_id, tk, text, ...) with their ``spans``."""
    s = repeated_spans(rows, length, window)
    s = s.select(F.col("doc_id").alias("s_id"), F.col("tk").alias("s_tk"), "spans")
    return rows.join(s, rows["doc_id"].eqNullSafe(s["s_id"]) & (rows["tk"] == s["s_tk"]), "left").drop("s_id", "s_tk")


def report(docs: DataFrame, length: int = 400, window: int = 240) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    # the same columns in the same order as the parse reads them: both then share one shuffle of the texts
    rows = common.texts(docs).withColumn("tk", common.text_key(F.col("text"))).select("doc_id", "tk", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in common.records(batches, "doc_id", "text", "spans"):
            out = []
            for doc_id, text, s in zip(ids, texts, spans):
                b = text.encode()
                runs = removed(len(b), s, length)
                rest = kept(b, runs)
                out.append((doc_id, len(b), len(b) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            yield common.batch(schema, *zip(*out))

    return _with_spans(rows, length, window).select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def of_words(b: bytes, runs: np.ndarray, least: int, always: int) -> np.ndarray:
    """Runs that hold at least ``least`` words (cut ones at the ends counted) or ``always`` bytes."""
    wide = [hi - lo >= always or len(b[lo:hi].decode("utf-8", "ignore").split()) >= least for lo, hi in runs.tolist()]
    return runs[np.array(wide, bool)]


def cut(docs: DataFrame, length: int = 400, window: int = 240, least_words: int = 0, always: int = 400) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the repeated bytes cut out of ``text``.

    Characters of which a byte was removed go as a whole. With ``least_words``, runs of fewer words stay unless they have ``always``
    bytes; a repeated passage lies in one run, so none of that many words (and ``length`` bytes) is left.
    """
    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, s) -> str:
            b = t.encode()
            runs = removed(len(b), list(s) if s is not None else None, length)
            return kept(b, of_words(b, runs, least_words, always)).decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    # a text moves once: its other columns go beside it, and the rows that the phrases are taken from share the shuffle of those that are cut
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("_null")).alias("row")
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), others
    ).withColumn("tk", common.text_key(F.col("text"))).select("doc_id", "tk", "text", "row")
    # untouched texts stay as they are, null included
    own = F.when(~F.col("row._null"), F.col("text"))
    full = _with_spans(packed, length, window).withColumn("_new", F.when(F.col("spans").isNull(), own).otherwise(rest("text", "spans")))
    return full.select(*[F.col("_new").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
