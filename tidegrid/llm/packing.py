"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many of ``longest`` as fit, then one for each
binary digit of the rest, longest first. A piece is a sequence of its own, so no sequence crosses documents and none is
padded; sequences of equal length form the buckets that batches are drawn from. Numbers run through the buckets from the shortest
to the longest, in order of document and start.

Texts are dealt into ranges of ascending doc_id once and encoded there; ids never move. A task numbers the pieces of each length that it
cuts, the result is written, and a table with one row for each length and range says where a range's numbers begin. That table is
broadcast: the number of shuffle partitions times the number of lengths.

Defined results: null text counts as empty and gives one piece with the end id; rows that repeat an id are cut each and
numbered in order of a hash of the text, then of the text; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm import common, words
from tidegrid.llm.staging import staged


def cuts(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids. ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, end_id: int, longest: int = 2048, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and (``with_ids``) the ids of every piece; ``part`` and ``nth`` among the part's pieces of its length."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("part", pa.int32()), ("nth", pa.int64())]
    ids_field = [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(fields + ids_field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = words.encoder(path).encode
        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), Counter()
        for doc_ids, texts in common.records(batches, "doc_id", "text"):
            for lo in range(0, len(doc_ids), 1024):
                out, ids = [], []
                for i, coded in zip(doc_ids[lo : lo + 1024], encode(texts[lo : lo + 1024])):
                    coded += end
                    n, at = len(coded) // 4, 0
                    for size in cuts(n, longest):
                        piece = coded[4 * at : 4 * (at + size)]
                        row = (i, at, size, zlib.crc32(piece), n, part, seen[size])
                        seen[size] += 1
                        out.append(row)
                        at += size
                    ids.append(coded)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                if with_ids:
                    # pieces follow each other as they do in the documents
                    ends = np.cumsum([0, *columns[2].to_pylist()], dtype="i4")
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * with_ids
    order = ["doc_id", common.text_key(F.col("text")), "text"]
    return common.texts(docs).repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, ddl)


def number(found: DataFrame) -> DataFrame:
    """Adds sequence_id (gapless, by length, part and place in it) and offset (0: a piece fills its sequence). ``found`` is a written table."""
    counts = found.groupBy("length", "part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # one row for each length
    buckets = counts.groupBy("length").agg(F.sum("_n").alias("_n"))
    buckets = buckets.select("length", F.coalesce(F.sum("_n").over(shorter), F.lit(0)).alias("_bucket"))
    inside = counts.select("length", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_inside"))
    bases = inside.join(buckets, "length").select("length", "part", (F.col("_bucket") + F.col("_inside")).alias("_base"))
    columns = [c for c in found.columns if c not in ("part", "nth")]
    return found.join(F.broadcast(bases), ["length", "part"]).select(
        *columns, (F.col("nth") + F.col("_base")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )


def pack(docs: DataFrame, path: str, end_id: int, longest: int = 2048, with_ids: bool = True) -> DataFrame:
    """All pieces with their sequences. Lineage is cut after encoding, so that parts and places stay."""
    return number(staged(pieces(docs, path, end_id, longest, with_ids), "pieces"))


def digests(packed: DataFrame) -> DataFrame:
    """Packed pieces with their ids' checksum, taken from the ids, in place of the ids."""
    columns = [c for c in packed.columns if c != "ids"]
    at = columns.index("ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[lo:hi].tobytes()) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
            out = [b.column(c) for c in columns]
            out[at] = pa.array(sums, pa.int64())
            yield pa.RecordBatch.from_arrays(out, columns)

    return packed.mapInArrow(run, packed.drop("ids").schema)
