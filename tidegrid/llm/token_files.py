"""Token ids in Arrow files of equal-length sequences with masks.

Documents are dealt into ranges of ascending doc_id. Each range becomes a shard: one Arrow file whose record batches hold
``sequence`` as fixed-size lists of ids and ``mask`` as fixed-size lists of flags (true: an id, false: padding in the
shard's last sequence), and one Arrow file with ``doc_id``, ``start`` (in the shard) and ``n_tokens``. A memory map of
a shard gives every sequence without a copy. Ids need 16 bits while the vocabulary allows it.

A task writes under a name of its own and returns it; only names in the manifest, a table that Spark commits, count. So a repeated
or lost task leaves stray files, never wrong ones.

Defined results: null text counts as empty and has the end id alone; rows that repeat an id are neighbours in order of a hash of the text, then of the text; an empty table
gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm import common, words

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard string, first_id long, n_docs long, n_tokens long"


class ShardWriter:
    """Cuts a stream of ids into sequences and writes them in batches of ``per_batch``."""

    def __init__(self, sink, length: int, dtype: str, per_batch: int = 64):
        self.length, self.dtype, self.room = length, np.dtype(dtype), length * per_batch
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("sequence", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} doesn't fit {self.dtype}")
        self.waiting.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= self.room:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(flat[at : at + self.room], self.room)
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, n: int) -> None:
        mask = np.arange(len(flat)) < n
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.waiting, np.zeros(0, self.dtype)])
        if len(flat):
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int, length: int = 2048, dtype: str = "<u2") -> DataFrame:
    """Writes all shards below ``folder``, a URI that every executor reaches; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        if (head := next(batches, None)) is None:
            return
        encode = words.encoder(path).encode
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        end, at, n_docs, first = np.array([end_id], "<u4").tobytes(), 0, 0, None
        with fs.open_output_stream(f"{root}/{name}.arrow") as out, fs.open_output_stream(f"{root}/{name}.docs.arrow") as index:
            shard, docs_out = ShardWriter(out, length, dtype), pa.ipc.new_file(index, INDEX)
            for b in (x for part in ([head], batches) for x in part):
                ids = b.column("doc_id").to_pylist()
                coded = [np.frombuffer(c + end, "<u4") for c in encode(b.column("text").to_pylist())]
                sizes = np.array([len(c) for c in coded])
                for c in coded:
                    shard.add(c)
                docs_out.write_batch(common.batch(INDEX, ids, at + np.cumsum(sizes) - sizes, sizes))
                if n_docs == 0:
                    first = ids[0]
                at, n_docs = at + int(sizes.sum()), n_docs + len(ids)
            shard.close()
            docs_out.close()
        yield pa.RecordBatch.from_pydict({"shard": [name], "first_id": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_tokens": [at]})

    rows = common.texts(docs)
    order = ["doc_id", common.text_key(F.col("text")), "text"]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, MANIFEST)


class Shard:
    """Random access to one shard: sequences, masks and the ids of a document."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(opened(f"{root}/{name}.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{root}/{name}.docs.arrow"))
        self.length = self.file.schema.field("sequence").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def batch(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of one record batch as a matrix that shares the file's memory, and its mask."""
        b = self.file.get_batch(i)
        ids = b.column("sequence")
        return ids.values.to_numpy(zero_copy_only=True)[ids.offset * self.length :].reshape(-1, self.length), b.column("mask")

    def sequence(self, i: int) -> np.ndarray:
        return self.batch(i // self.per_batch)[0][i % self.per_batch]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``; a view where they lie in one record batch."""
        room = self.length * self.per_batch
        parts = []
        while n:
            flat = self.batch(start // room)[0].reshape(-1)
            part = flat[start % room : start % room + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, "<u2")])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    before = Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard: few, as a shard is a whole partition of documents
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = pa.schema([*INDEX, ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, bases in common.records(batches, "shard", "base"):
            for name, base in zip(names, bases):
                shard = Shard(folder, name)
                for i in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(i)
                    starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    crcs = [zlib.crc32(shard.tokens(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                    yield common.batch(schema, docs.column("doc_id"), starts + base, sizes, crcs)

    # a given number of partitions is not merged: every shard can have a task of its own
    spread = shards.select("shard", "base").repartition(max(manifest.count(), 1), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
