"""Exact n-gram Jaccard join with components, by set-relation skipping.

A document is the set of 64-bit hashes of its word shingles; equal sets are one class.

Index lists by position. A sorted set is cut into blocks by position in the hash space, so many that two sets at
the threshold must agree in at least one whole block: with at most D differing elements, D + 1 blocks leave one untouched.
The number of blocks goes with the set's size class; a set near the lower end of its class also enters the class below, where
its smaller partners are. Lists are keyed by class, position and content of the block, so a set skips every other position and all sets
whose block differs. Empty blocks enter the index only for sets with more of them than ``SPARE``; this keeps the
guarantee without a list of unrelated short sets.

Bounds inside a list. Only lists with two sets or more go on. A set there carries its size and a bitmap of its hashes: every bit in
which two bitmaps differ needs an element that only one of the sets has, so pairs with too many such bits, or too different sizes, are
no links. Sets of a list are compared with all of it one after the other, until all others are in the list's largest tied group; a pair left
out is thus tied already. One list in ``FIRST_LISTS`` is compared first; of the others only those with sets not yet tied together. Lists beyond ``LIST`` sets are spread over tasks by pairs of parts. Bitmaps stop at ``MOST_BITS``, so that for very long sets they
exclude less.

Answers from a similar set. Sets tied in this way form families; every link lies inside one. Inside a block of a family one set is the pivot, the others are
held as differences from it; the overlap of two sets is the pivot's answer corrected by the elements in both differences, so only
those are counted. Families beyond ``BLOCK`` sets are spread over tasks: every block meets the first; a set that has then joined the
family's largest component needs no more comparisons, since links inside a component change nothing; the others meet all blocks.

Defined results: null or blank text: an empty set, linked with nothing, its component is its own id; fewer words than a shingle: the
whole sequence is one shingle; rows that repeat an id are documents of their own with that id; a null id is left out of the
smallest ids, and a component of null ids alone is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm import common
from tidegrid.llm.components import components
from tidegrid.llm.staging import staged
from tidegrid.session import cut_lineage

BLOCK = 512
SPARE = 2
CLASS_RATIO = 1.5
#: Sets of a list that a task compares, bits of a set's bitmap, sets whose keys a task remembers as sent, rows of lists held at once.
LIST = 2048
LEAST_BITS, MOST_BITS = 64, 1 << 15
REMEMBERED = 1_000_000
LIST_ROWS, LIST_BYTES = 50_000, 8 << 20
#: Texts held as Python strings at once, words whose hashes a task remembers.
TEXTS, WORDS = 256, 100_000
#: One list in so many is compared first.
FIRST_LISTS = 8

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text; word hashes are cached up to ``capacity`` words."""

    def __init__(self, n: int = 3, capacity: int = WORDS):
        self.n, self.capacity, self.known = n, capacity, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.capacity:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not words:
            return h
        k = min(self.n, len(words))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def digest(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()) & 0xFFFFFFFFFFFFFFFF).astype(np.int64)))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each value of the low bits of the hashes; half as many bits are the OR of both halves."""
    bits = min(max(LEAST_BITS, 1 << max(2 * len(s) - 1, 0).bit_length()), MOST_BITS)
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


class Scheme:
    """Size classes and numbers of blocks for ``num``/``den`` as the least similarity."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]  # smallest size of each class

    def _class(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * CLASS_RATIO)))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def blocks(self, c: int) -> int:
        most = self.low[c + 1] - 1
        together = most + most * self.den // self.num
        return together * (self.den - self.num) // (self.den + self.num) + 1 + SPARE

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of the index lists that a set enters."""
        c = self._class(len(s))
        classes = [c]
        # a partner may be as small as num/den of the set
        if c and -(-len(s) * self.num // self.den) < self.low[c]:
            classes.append(c - 1)
        out = []
        for c in classes:
            k = self.blocks(c)
            place = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            first = np.flatnonzero(np.diff(place, prepend=place[0] + np.uint64(1)))
            sums = np.add.reduceat(mix(s), first)
            seed = np.uint64((c << 32) + k)
            out.append(mix(mix(sums) + mix(place[first] + (seed << np.uint64(1)))))
            if k - len(first) > SPARE:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), place[first])
                out.append(mix(mix(empty + (seed << np.uint64(1)))))
        return np.concatenate(out)


def linked(sets: list[np.ndarray], others: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(i, j) of a spanning forest of the links between ``sets[i]`` and the joint list ``sets + others``."""
    every = sets + others
    sizes = np.array([len(s) for s in every], np.int64)
    pivot = every[int(np.argsort(sizes, kind="stable")[len(sizes) // 2])]
    # differences from the pivot: what a set has more, and what it lacks
    more = [np.setdiff1d(s, pivot, assume_unique=True) for s in every]
    less = [np.setdiff1d(pivot, s, assume_unique=True) for s in every]
    parent = np.arange(len(every))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def lists(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of all differences, sorted, and for each element the sets that hold it."""
        flat = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(flat, kind="stable")
        values, start = np.unique(flat[order], return_index=True)
        return values, np.append(start, len(flat)), owner[order]

    out = []
    index = [lists(more), lists(less)]
    for i in range(len(sets)):
        both = np.zeros(len(every), np.int64)  # elements in both differences
        for (values, start, owner), own in zip(index, (more[i], less[i])):
            at = np.searchsorted(values, own)
            spans = [owner[start[a] : start[a + 1]] for a in at]
            if spans:
                both += np.bincount(np.concatenate(spans), minlength=len(every))
        shared = len(pivot) - len(less[i]) - np.array([len(x) for x in less]) + both
        union = sizes[i] + sizes - shared
        for j in np.flatnonzero(den * shared >= num * union):
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _classes(rows: DataFrame, n: int, scheme: Scheme) -> DataFrame:
    """Each document with its set's size and name; the keys and the bitmap of every set."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(n), set()
        # texts become Python strings a part of a batch at a time
        parts = (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS))
        for ids, tks, texts in common.records(parts, "doc_id", "tk", "text"):
            out = []
            for i, tk, text in zip(ids, tks, texts):
                s = shingles(text)
                cls = digest(s)
                # a set's keys leave a task once: its copies add nothing
                new = len(s) and cls not in seen
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(cls)
                out.append((i, tk, len(s), cls, *((scheme.keys(s).view(np.int64), bitmap(s)) if new else (None, None))))
            yield common.batch(schema, *zip(*out))

    return rows.mapInArrow(run, "doc_id long, tk long, n long, cls long, keys array<long>, bits binary")


def _possible(sizes: tuple[np.ndarray, np.ndarray], bits: tuple[np.ndarray, np.ndarray], num: int, den: int) -> np.ndarray:
    """Pairs that sizes and bitmaps do not exclude: the elements of one set alone are at least the bits that differ."""
    a, b = sizes
    apart = np.maximum(np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64), np.abs(a - b))
    # shared = (a + b - apart) / 2 and union = (a + b + apart) / 2
    return den * (a + b - apart) >= num * (a + b + apart)


def ties(lists: np.ndarray, names: np.ndarray, sizes: np.ndarray, bits: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of names that tie together all possible links of each list; rows are sorted by list.

    One row of each list after the other is compared with the whole list, until all others are in the list's largest tied group. Only
    pairs that join two groups are returned: fewer than a list has rows.
    """
    total = len(lists)
    start = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    length = np.diff(np.r_[start, total])
    of = np.repeat(np.arange(len(start)), length)
    group, done, rows = np.arange(total), np.zeros(total, bool), np.arange(total)
    out_a, out_b = [], []
    while len(rows):
        members = np.bincount(group[rows], minlength=total)
        rank = np.full(len(start), -1)
        np.maximum.at(rank, of[rows], members[group[rows]] * total + total - 1 - group[rows])
        largest = total - 1 - rank % total
        todo = rows[~done[rows] & (group[rows] != largest[of[rows]])]
        own, at = np.unique(of[todo], return_index=True)
        pivots, reach = todo[at], length[own]
        other = np.repeat(start[own] - np.r_[0, np.cumsum(reach)[:-1]], reach) + np.arange(reach.sum())
        pivot = np.repeat(pivots, reach)
        good = _possible((sizes[pivot], sizes[other]), (bits[pivot], bits[other]), num, den)
        pivot, other = pivot[good], other[good]
        joins = group[pivot] != group[other]
        joined, one = np.unique(group[other[joins]], return_index=True)
        out_a.append(names[pivot[joins][one]])
        out_b.append(names[other[joins][one]])
        done[pivots] = True
        new, gone = np.zeros(len(start), np.int64), np.zeros(total, bool)
        new[own] = group[pivots]
        gone[joined] = True
        rows = rows[np.isin(of[rows], own)]
        moved = rows[gone[group[rows]]]
        group[moved] = new[of[moved]]
    return np.concatenate([names[:0], *out_a]), np.concatenate([names[:0], *out_b])


def _ties(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of all lists; entries (key, left, right, cls, n, bits) are sorted by list and ``cls`` in each task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def tie(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, left, right, names, sizes = (t.column(c).to_numpy() for c in ("key", "left", "right", "cls", "n"))
        lists = np.cumsum(np.r_[True, (np.diff(key) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0)])
        maps = t.column("bits").to_pylist()
        width = np.fromiter(map(len, maps), np.int64, len(maps))
        start = np.flatnonzero(np.r_[True, np.diff(lists) != 0])
        narrow = np.repeat(np.minimum.reduceat(width, start), np.diff(np.r_[start, len(lists)]))
        found = []
        for w in np.unique(narrow):
            rows = np.flatnonzero(narrow == w)
            bits = np.zeros((len(rows), w), np.uint8)
            for own in np.unique(width[rows]):
                at = np.flatnonzero(width[rows] == own)
                wide = np.frombuffer(b"".join([maps[r] for r in rows[at]]), np.uint8).reshape(len(at), own // w, w)
                bits[at] = np.bitwise_or.reduce(wide, axis=1)
            found.append(ties(lists[rows], names[rows], sizes[rows], bits.view(np.uint64), num, den))
        return tuple(map(np.concatenate, zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}  # sets tied by this task: most lists of a family say the same

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def new(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(parent) > REMEMBERED:
                parent.clear()
            pairs = []
            for a, b in zip(*(x.tolist() for x in tie(t))):
                x, y = find(a), find(b)
                if x != y:
                    parent[x] = y
                    pairs.append((a, b))
            if pairs:
                yield common.batch(schema, *zip(*pairs))

        held, rows, size = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, LIST):
                part = b.slice(at, LIST)
                if rows >= LIST_ROWS or size >= LIST_BYTES:
                    last = [held[-1].column(c)[-1].as_py() for c in ("key", "left", "right")]
                    same = np.logical_and.reduce([part.column(c).to_numpy() == v for c, v in zip(("key", "left", "right"), last)])
                    cut = int(same.sum())  # sorted: the open list's rows come first
                    if cut < part.num_rows:
                        yield from new(pa.Table.from_batches([*held, part.slice(0, cut)]))
                        held, rows, size = [], 0, 0
                        part = part.slice(cut)
                held.append(part)
                rows += part.num_rows
                size += part.nbytes
        if rows:
            yield from new(pa.Table.from_batches(held))

    order = ("key", "left", "right")
    return entries.repartition(*order).sortWithinPartitions(*order, "cls").mapInArrow(run, "a long, b long")


def _families(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of sets that lists and bounds tie together; every link lies inside one family."""
    held = docs.where("keys IS NOT NULL")
    # dealt by list once: the counts and the entries that they let through read the same shuffle
    entries = held.select("cls", F.explode("keys").alias("key")).repartition("key")
    counts = entries.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("members"))
    lists = counts.where("low <> high").select("key", F.ceil(F.col("members") / LIST).cast("long").alias("parts"))
    met = staged(entries.join(lists, "key").distinct(), "lists")
    marks = staged(held.groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "bitmaps")

    def tied(some: DataFrame) -> DataFrame:
        rows = some.join(marks, "cls").withColumn("part", F.pmod(F.xxhash64(F.lit(13), "cls"), F.col("parts")))
        # a part of a long list meets itself and every other part
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
        rows = rows.select("key", "cls", "n", "bits", "part", other).select(
            "key", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "cls", "n", "bits"
        )
        return staged(_ties(rows, num, den).distinct(), "ties")

    # near copies meet in most of their lists: a share of the lists ties them, and lists inside one family need no look
    early = tied(met.where(F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(FIRST_LISTS)) == 0))
    known = components(early)
    state = met.join(known, met["cls"] == known["node"], "left").select("key", "cls", "parts", F.coalesce("root", "cls").alias("root"))
    mixed = state.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return components(early.unionByName(tied(met.join(mixed, "key", "left_semi"))))


def _sets(rows: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """Members (doc_id, tk, cls, ...) with their sets, from the text of one document each."""
    extra = [c for c in members.columns if c not in ("doc_id", "tk")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(c, kinds[dict(members.dtypes)[c]]) for c in extra] + [("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                found = pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), found], schema=schema)

    m = members.select(F.col("doc_id").alias("m_id"), F.col("tk").alias("m_tk"), *extra)
    joined = rows.join(m, rows["doc_id"].eqNullSafe(m["m_id"]) & (rows["tk"] == m["m_tk"]))
    ddl = ", ".join(f"{c} {dict(members.dtypes)[c]}" for c in extra) + ", hashes binary"
    return joined.select(*extra, "text").mapInArrow(run, ddl)


def _compare(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the sets of one task: those with ``side`` 0 among each other and with ``side`` 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["side", "cls"]).sort_values(["side", "cls"], kind="stable")
        own, other = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        other = other[~other["cls"].isin(own["cls"])]
        if not len(own) or len(own) + len(other) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        names = [*own["cls"], *other["cls"]]
        hashes = lambda x: [np.frombuffer(h, np.uint64) for h in x["hashes"]]
        found = linked(hashes(own), hashes(other), num, den)
        return pd.DataFrame([(names[i], names[j]) for i, j in found], columns=["a", "b"]).astype("int64")

    return blocks.groupBy("family", "left", "right").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, tk, n_shingles and ``class`` (of linked documents; null for an empty set) of every document."""
    rows = common.texts(docs).withColumn("tk", common.text_key(F.col("text")))
    scheme = Scheme(num, den)
    named = staged(_classes(rows, n, scheme), "sets")
    families = _families(named, num, den)
    one = named.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "tk")).alias("one"))
    placed = families.join(one, families["node"] == one["cls"]).select(
        F.col("one.doc_id").alias("doc_id"), F.col("one.tk").alias("tk"), "cls", F.col("root").alias("family")
    )
    sizes = placed.groupBy("family").agg(F.count("*").alias("members"))
    # blocks by hash: about half of BLOCK each, so that few exceed it
    placed = placed.join(sizes, "family").withColumns(
        {"blocks": F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("long")}
    ).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "cls"), F.col("blocks")))
    sets = staged(_sets(rows, placed.select("doc_id", "tk", "cls", "family", "blocks", "block"), n), "members")
    first = sets.where("block = 0")
    own = sets.select("family", F.col("block").alias("left"), F.lit(0).cast("long").alias("right"), F.lit(0).alias("side"), "cls", "hashes")
    pivots = first.where("blocks > 1").select(
        "family", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).alias("left"),
        F.lit(0).cast("long").alias("right"), F.lit(1).alias("side"), "cls", "hashes",
    )
    links = cut_lineage(_compare(own.unionByName(pivots), num, den))
    found = components(links)
    large = sets.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_rest(large, found, num, den))
        found = components(links)
    return named.join(found, named["cls"] == found["node"], "left").select(
        "doc_id", "tk", F.col("n").alias("n_shingles"), F.coalesce("root", F.when(F.col("n") > 0, F.col("cls"))).alias("class")
    )


def join_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links at ``den`` * shared >= ``num`` * union."""
    found = classes(docs, n, num, den)
    least = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    return found.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest doc_id (null last).

    Empty sets stay. Rows equal in id and text are one document.
    """
    found = classes(docs, n, num, den)
    rows = found.groupBy("doc_id", "tk", "n_shingles", "class").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tk", "times")).alias("f")
    chosen = rows.where("class IS NOT NULL").groupBy("class").agg(first).select("f.doc_id", "f.tk", "f.times")
    chosen = chosen.unionByName(rows.where("class IS NULL").select("doc_id", "tk", F.lit(1).cast("long").alias("times")))
    chosen = chosen.select(F.col("doc_id").alias("_c_id"), F.col("tk").alias("_c_tk"), F.col("times").alias("_times"))
    names = docs.columns
    keyed = docs.withColumn("_tk", common.text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = keyed.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_c_id")) & (F.col("_tk") == F.col("_c_tk")))
    once = kept.where("_times = 1").select(*names)
    return once.unionByName(kept.where("_times > 1").dropDuplicates(["_c_id", "_c_tk"]).select(*names))


def _rest(large: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Links of sets outside their family's largest component with all blocks of the family."""
    state = large.join(found, large["cls"] == found["node"], "left").select(
        "family", "blocks", "block", "cls", "hashes", F.coalesce("root", "cls").alias("root")
    )
    sizes = state.groupBy("family", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("family").agg(F.max(F.struct("c", "root")).alias("m")).select("family", F.col("m.root").alias("main"))
    left = state.join(largest, "family").where("root <> main")
    counts = left.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("left_blocks"))
    left = left.join(counts, "family").withColumn("left", F.pmod(F.xxhash64(F.lit(11), "cls"), F.col("left_blocks")))
    right = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    lefts = left.select("family", "left", F.explode(right).alias("right"), F.lit(0).alias("side"), "cls", "hashes")
    rights = state.join(counts, "family").select(
        "family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left_blocks") - 1)).alias("left"),
        F.col("block").alias("right"), F.lit(1).alias("side"), "cls", "hashes",
    )
    return _compare(lefts.unionByName(rights), num, den)
