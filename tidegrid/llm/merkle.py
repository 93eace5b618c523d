"""Merkle manifest of a table by time-forward processing.

Rows become leaf digests. Leaves stand in one tree for each group (here: lang) in the order of their ids, the roots of these trees in one
tree on top. A node's label is (level, position), so children always come before their parents. Inside a block of neighbouring
nodes a priority queue ordered by label delivers every digest to its parent, and a reversed sweep over the labels delivers the proof
suffix of every parent to its children. Between blocks the queue is external: block tops are the nodes of the next round, moved by a shuffle
to the block that their parents' labels belong to. A block spans four levels, so a round leaves one node of 4,096;
proof suffixes come back the same way, one for each block.

A task holds one block: its digests going up, its proofs (siblings of all levels above a node) coming down. Leaf order comes from
ranges of (group, id, digest) and one count for each range and group, so that a group of any size is spread over many tasks.

Defined results: a null column counts as ``-`` in its leaf; null groups have a tree of their own, before all others; rows of a null id come
first; rows that repeat an id stand in order of their digests, equal rows have equal leaves and each its own place and proof; an
empty table gives no rows; columns beyond those named stay behind. A lone leaf is its own root and has no sibling.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.staging import staged

FANOUT = 8
#: Levels of one round, and the nodes of a block: ``FANOUT ** LEVELS``.
LEVELS = 4

STEP = "struct<left: string, right: string>"
UP = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("digest", pa.string())])
PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
DOWN = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("proof", PROOF), ("root", pa.string())])


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of values: ``-`` if null, else byte count, ``:``, value."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return digest(F.concat(*map(field, columns)))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Sweep:
    """Both sweeps over one block of neighbouring nodes of a tree.

    ``last`` says that the block is the whole tree: it ends at its single top node. Other blocks always rise ``levels`` levels.
    Positions are counted from the block's first node.
    """

    def __init__(self, digests: list[str], last: bool, levels: int):
        self.runs: list[tuple[int, int, list[str]]] = []  # (level, position) of a parent and its children's digests
        # the queue is filled in order of position, which is a heap already
        queue = [(0, at, d) for at, d in enumerate(digests)]
        width = len(digests)
        level = 0
        while width > 1 if last else level < levels:
            width, level = -(-width // FANOUT), level + 1
        self.height = level
        while queue[0][0] < self.height:
            level, at, d = heapq.heappop(queue)
            parent, children = at // FANOUT, [d]
            while queue and queue[0][0] == level and queue[0][1] // FANOUT == parent:
                children.append(heapq.heappop(queue)[2])
            self.runs.append((level + 1, parent, children))
            heapq.heappush(queue, (level + 1, parent, _hash(children)))
        self.top = queue[0][2]

    def proofs(self, suffix: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
        """Proof of every node of the block, given that of its top; a step holds the siblings left and right of the node."""
        waiting = {(self.height, 0): suffix}
        for level, at, children in reversed(self.runs):
            above = waiting.pop((level, at))
            for i in range(len(children)):
                step = ("".join(children[:i]), "".join(children[i + 1 :]))
                waiting[level - 1, FANOUT * at + i] = [step, *above]
        return [waiting[0, at] for at in range(len(waiting))]


def positions(rows: DataFrame, group: str, order: list[str], tree: str = "tree", idx: str = "idx", size: str = "n") -> DataFrame:
    """Numbers the rows of each group from 0 in ``order`` and adds the group's number (null first) and size.

    Ranges are written once, so their numbers stay when an executor is lost; only a row for each range and group meets in a window.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    marked = staged(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "order")
    counts = marked.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # the ranges of a group follow each other: one row for each range and group, hence as many as ranges plus groups
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(group).agg(F.sum("_n").alias(size))
    # a row for each group
    numbers = sizes.withColumn(tree, F.row_number().over(Window.orderBy(F.col(group).asc_nulls_first())).cast("long") - 1)
    bases = counts.select(
        F.col("_part"), F.col(group).alias("_group"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")
    )
    numbers = numbers.withColumnRenamed(group, "_group_of")
    bases = bases.join(numbers, F.col("_group").eqNullSafe(F.col("_group_of"))).drop("_group_of").withColumnRenamed("_part", "_part_of")
    on = (F.col("_part") == F.col("_part_of")) & F.col(group).eqNullSafe(F.col("_group"))
    return marked.join(bases, on).withColumn(idx, F.col("_at") + F.col("_base")).drop("_part", "_part_of", "_group", "_at", "_base")


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("idx")


def _rise(nodes: DataFrame, levels: int) -> DataFrame:
    """Tops of all blocks: the nodes of the next round."""
    size = FANOUT**levels

    def run(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        first = group["idx"][0].as_py()
        sweep = Sweep(group["digest"].to_pylist(), group["n"][0].as_py() <= size, levels)
        return pa.table({"tree": group["tree"][:1], "idx": pa.array([first // size], pa.int64()), "n": group["n"][:1], "digest": [sweep.top]})

    blocks = nodes.select("tree", "idx", "n", "digest", F.floor(F.col("idx") / size).alias("block"))
    tops = blocks.groupBy("tree", "block").applyInArrow(run, "tree long, idx long, n long, digest string")
    return tops.withColumn("n", F.ceil(F.col("n") / size))


def _sink(nodes: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """Proof of every node, given the proofs and the root of the block tops."""
    size = FANOUT**levels

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group = _sorted(group)
        suffix = [(s["left"], s["right"]) for s in above["proof"][0].as_py()]
        sweep = Sweep(group["digest"].to_pylist(), group["n"][0].as_py() <= size, levels)
        proofs = [[{"left": a, "right": b} for a, b in p] for p in sweep.proofs(suffix)]
        root = [above["root"][0].as_py()] * len(proofs)
        return pa.table({"tree": group["tree"], "idx": group["idx"], "proof": pa.array(proofs, PROOF), "root": root}).cast(DOWN)

    blocks = nodes.select("tree", "idx", "n", "digest", F.floor(F.col("idx") / size).alias("block")).groupBy("tree", "block")
    above = tops.select("tree", F.col("idx").alias("block"), "proof", "root").groupBy("tree", "block")
    return blocks.cogroup(above).applyInArrow(run, f"tree long, idx long, proof array<{STEP}>, root string")


def _rounds(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """Nodes of every round, the trees' roots last. Each round is written, as the way back reads it again."""
    rounds = [nodes]
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        rounds.append(staged(_rise(rounds[-1], levels), name))
        widest = -(-widest // FANOUT**levels)
    return rounds


def prove(leaves: DataFrame, group: str, order: list[str], levels: int = LEVELS) -> DataFrame:
    """Adds subroot, root and proof (siblings of every level, from the leaf up to the root) to rows with a ``digest``."""
    placed = positions(leaves, group, order)
    rounds = _rounds(placed, "nodes", levels)
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    top = _rounds(subroots.withColumn("n", F.lit(subroots.count()).cast("long")), "roots", levels)
    proofs = top[-1].select("tree", "idx", F.array().cast(f"array<{STEP}>").alias("proof"), F.col("digest").alias("root"))
    for nodes in reversed(top[:-1]):
        proofs = _sink(nodes, proofs, levels)
    # a subroot is the only node of its group's tree
    proofs = proofs.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "proof", "root")
    for nodes in reversed(rounds[:-1]):
        proofs = _sink(nodes, proofs, levels)
    named = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    return placed.join(proofs, ["tree", "idx"]).join(named, "tree")


def fold(own: Column, proof: Column) -> Column:
    """Root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, own, lambda d, step: digest(F.concat(step["left"], d, step["right"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof of every row of ``docs``, and ``changed``: the leaf of its text in lower case (A-Z)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    columns = [F.col(c) for c in FIELDS]
    changed = leaf([*columns[:-1], F.translate(F.col("text").cast("string"), upper, upper.lower())])
    leaves = docs.select("doc_id", "lang", leaf(columns).alias("digest"), changed.alias("changed"))
    return prove(leaves, "lang", ["doc_id", "digest"], levels).withColumnRenamed("digest", "leaf")


def tamper_report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs checked against leaves of which every third is tampered with; a row with a null id is not."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return (
        manifest(docs, levels)
        .withColumn("proof_sha256", digest(siblings(F.col("proof"))))
        .withColumn("folded_root", fold(F.when(hit, F.col("changed")).otherwise(F.col("leaf")), F.col("proof")))
        .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    )
