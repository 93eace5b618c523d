"""Connected components of a table of links, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.staging import staged


#: Rows that a partition of the shrinking tables holds at most, on average.
ROWS = 500_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of all nodes in ``a``, ``b``.

    Each round every node goes to its neighbour of the smallest hash if that is below its own, links are renamed and those
    inside a node vanish. Hashes are new in each round and have no order along a chain, so a round takes a constant share of
    the nodes away. Rounds end in written tables (a checkpoint would hand the constraints of all earlier rounds to the
    optimizer); the driver only sees whether links are left.
    """
    links = links.select("a", "b").where("a <> b")
    links = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found, turn, nodes = None, 0, 0
    while (size := links.count()) or found is None:
        turn += 1
        # tables shrink with the links, and so do their partitions
        few = -(-2 * size // ROWS) or 1
        ends = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"))
        goes = links.select(F.inline(ends))
        goes = staged(goes.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "b"), "b")).getField("b").alias("to")).coalesce(few), "hooks")
        if found is None:
            found = goes.select(F.col("a").alias("node"), F.col("to").alias("root"))
            nodes = few
        else:
            step = goes.select(F.col("a").alias("root"), "to")
            found = staged(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")).coalesce(nodes), "roots")
        left = links.join(goes, "a").select(F.col("to").alias("x"), "b")
        both = left.join(goes.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        links = staged(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(few), "links")
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
