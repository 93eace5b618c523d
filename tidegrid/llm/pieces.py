"""SentencePiece encoding through a table of distinct chunks.

The library turns each space into a marker and puts one before the text. Where no piece of the vocabulary holds a marker
behind another letter, a text falls apart into chunks (a run of markers with the letters after it) that no piece crosses, so a
text's ids are those of its chunks in order. Each distinct chunk is segmented once and its ids are joined back by position:

1. Blocks of documents (``BLOCK`` bytes of text) number their distinct chunks; a document becomes the list of its chunks' numbers.
   The result is written as a table, so the numbers stay when an executor is lost.
2. Every block asks each part of the chunk table (a part holds the chunks of one hash remainder) once for all its chunks of
   that part. A part's task keeps its table of segmented chunks and answers in the order asked.
3. Answers meet the block's documents, and numbers are replaced by ids. Answers sort before documents, so that a task streams.

A chunk moves once a block, however often it occurs, so a very common word weighs no more than a rare one. A task holds one block's chunks
(at most those of ``BLOCK`` bytes and of one text) or one part's table (at most ``TABLE`` chunks; a full table is emptied and filled anew).

Defined results: null text counts as empty and has no ids; a literal marker letter counts as a space, as in the library; repeated rows
and repeated or null ids are encoded each; an empty table gives no rows; other columns stay behind. A vocabulary with pieces that cross markers makes the whole text one chunk.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import common
from tidegrid.llm.staging import staged

BLOCK = 32 << 20
TABLE = 1_000_000
#: Chunk numbers in one row of documents.
ROW = 1 << 20
MARKER = "▁"
#: ``part`` of the row that says which part answers which chunk; documents follow behind all parts.
ORDER, DOCS = -1, 1 << 30

MESSAGE = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("load", pa.binary())]
)
MESSAGE_DDL = "block long, part int, ids array<long>, sizes array<int>, load binary"


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Segmenter:
    """Chunks of a text, and the ids of a chunk."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        self.crossing = any(MARKER in n.lstrip(MARKER) for n in names)
        self.runs = re.compile(" +[^ ]*")
        # a marker without letters: the library puts none before an empty text
        self.lone = self.library.encode("x ")[len(self.library.encode("x")) :]

    def chunks(self, text: str) -> list[str]:
        """Every chunk without its first marker."""
        if not text:
            return []
        text = text.replace(MARKER, " ")
        if self.crossing:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [run[1:] for run in self.runs.findall(" " + text)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [ids if c else self.lone for c, ids in zip(chunks, self.library.encode(chunks, num_threads=1))] if chunks else []


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """One segmenter per worker process and vocabulary."""
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


class Numbers(dict):
    """Numbers chunks in order of first sight."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """Packed numbers, byte by byte of equal rank: the upper ones are nearly constant."""
    return _pack(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def _numbers(load: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(load, "u1").reshape(4, -1).T).view("<u4").reshape(-1)


def _short(numbers: np.ndarray) -> bytes:
    """Packed numbers of one to four bytes, seven bits each, the lowest first."""
    groups = numbers[:, None] >> np.arange(0, 28, 7, dtype="u4") & 127
    more = numbers[:, None] >> np.arange(7, 35, 7, dtype="u8") > 0
    used = np.concatenate([np.ones((len(numbers), 1), bool), more[:, :-1]], axis=1)
    return _pack((groups | more.astype("u4") << 7).astype("u1")[used].tobytes())


def _long(load: bytes) -> np.ndarray:
    """What ``_short`` packed."""
    raw = np.frombuffer(load, "u1")
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = np.zeros(len(last), "<u4")
    for k in range(4):
        has = first + k <= last
        out[has] |= (raw[first[has] + k] & 127).astype("u4") << 7 * k
    return out


class Block:
    """Documents of one block as chunk numbers, and the block's questions."""

    def __init__(self, number: int, parts: int):
        self.number, self.parts = number, parts
        self.seen, self.size = Numbers(), 0
        self.ids: list[int | None] = []
        self.coded: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str, chunks: list[str]) -> None:
        self.size += len(text)
        self.ids.append(doc_id)
        self.coded.append(np.fromiter(map(self.seen.__getitem__, chunks), "<u4", len(chunks)))

    def messages(self, row: int) -> Iterator[tuple]:
        """The block's questions, then its documents in rows of about ``row`` chunks.

        Chunks are numbered anew by falling count, equal counts by name: frequent numbers are short, and names beside each other alike.
        """
        if self.seen:
            by_name = sorted(self.seen)
            at = np.fromiter(map(self.seen.__getitem__, by_name), "i8", len(by_name))
            counts = np.zeros(len(at), "i8")
            for c in self.coded:
                np.add.at(counts, c, 1)
            ranked = np.argsort(-counts[at], kind="stable")
            rank = np.empty(len(at), "<u4")
            rank[at[ranked]] = np.arange(len(at))
            yield from self._questions([by_name[i].encode() for i in ranked.tolist()])
            self.coded = [rank[c] for c in self.coded]
        lo = held = 0
        for hi, c in enumerate(self.coded, 1):
            held += len(c) + 1
            if held >= row or hi == len(self.coded):
                some = self.coded[lo:hi]
                yield self.number, DOCS, self.ids[lo:hi], [len(x) for x in some], _short(np.concatenate(some))
                lo, held = hi, 0

    def _questions(self, names: list[bytes]) -> Iterator[tuple]:
        part = np.fromiter((zlib.crc32(n) % self.parts for n in names), "<u2", len(names))
        yield self.number, ORDER, None, None, _pack(part.tobytes())
        by_part = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[by_part], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            # no byte of a text is 0xFF
            load = b"\xff".join(names[i] for i in by_part[ends[p] : ends[p + 1]].tolist())
            yield self.number, p, None, None, _pack(load)


def number_chunks(docs: DataFrame, path: str, parts: int, size: int = BLOCK, row: int = ROW) -> DataFrame:
    """Messages of all blocks: numbered documents, the order of parts, and questions to each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = segmenter(path).chunks
        first, n = TaskContext.get().partitionId() << 32, 0
        block = Block(first, parts)
        for ids, texts in common.records(batches, "doc_id", "text"):
            for i, text in zip(ids, texts):
                block.add(i, text, cut(text))
                if block.size >= size:
                    yield from finish(block)
                    n += 1
                    block = Block(first + n, parts)
        yield from finish(block)

    def finish(block: Block) -> Iterator[pa.RecordBatch]:
        for message in block.messages(row):
            yield common.batch(MESSAGE, *zip(message))

    return common.texts(docs).mapInArrow(run, MESSAGE_DDL)


def answer(questions: DataFrame, path: str, room: int = TABLE) -> DataFrame:
    """Ids of the chunks asked for: each distinct chunk of a part is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(path).segment
        table: dict[bytes, np.ndarray] = {}
        current = None
        for blocks, part_of, loads in common.records(batches, "block", "part", "load"):
            for block, part, load in zip(blocks, part_of, loads):
                if part != current or len(table) > room:
                    table, current = {}, part
                asked = _unpack(load).split(b"\xff")
                new = [c for c in asked if c not in table]
                table.update(zip(new, (np.array(ids, "<u4") for ids in segment([c.decode() for c in new]))))
                found = [table[c] for c in asked]
                sizes = np.fromiter(map(len, found), "<u4", len(found))
                reply = _planes(np.concatenate([[len(found)], sizes, *found]))
                yield common.batch(MESSAGE, [block], [part], [None], [None], [reply])

    asked = questions.repartition("part").sortWithinPartitions("part", "block")
    return asked.mapInArrow(run, MESSAGE_DDL)


class Answers:
    """Ids of one block's chunks by number: ``flat[ends[i] - sizes[i] : ends[i]]``."""

    def __init__(self, order: bytes, replies: list[bytes]):
        part = np.frombuffer(order, "<u2")
        all_sizes, all_ids = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for reply in replies:
            words = _numbers(reply)
            n = int(words[0])
            all_sizes.append(words[1 : 1 + n])
            all_ids.append(words[1 + n :])
        sizes = np.concatenate(all_sizes).astype("i8")
        asked_as = np.argsort(part, kind="stable")
        if len(asked_as) != len(sizes):
            raise RuntimeError(f"{len(sizes)} answers to {len(asked_as)} questions")
        self.flat = np.concatenate(all_ids)
        ends = np.cumsum(sizes)
        self.sizes, self.ends = np.empty_like(sizes), np.empty_like(sizes)
        self.sizes[asked_as], self.ends[asked_as] = sizes, ends

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a sequence of chunks."""
        sizes = self.sizes[numbers]
        total = np.cumsum(sizes)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.ends[numbers] - total, sizes)
        return self.flat[at]

    def each(self, function: Callable[[list[int]], bytes]) -> list[bytes]:
        """``function`` of the ids of every chunk."""
        flat = self.flat.tolist()
        return [function(flat[e - n : e]) for e, n in zip(self.ends.tolist(), self.sizes.tolist())]


def _parts(docs: DataFrame) -> int:
    """Parts of the chunk table: one for 64 MB of text, so that questions stay few; at most 4,096."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(max(total >> 26, 8), 4096)


def _by_block(docs: DataFrame, path: str, **sizes: int) -> DataFrame:
    """Messages of each block together: order, answers, documents."""
    texts = common.texts(docs)
    room = sizes.pop("room", TABLE)
    sizes.setdefault("parts", _parts(texts))
    messages = staged(number_chunks(texts, path, **sizes), "chunks")
    asked = F.col("part").between(0, DOCS - 1)
    answers = answer(messages.where(asked), path, room)
    return messages.where(~asked).unionByName(answers).repartition("block").sortWithinPartitions("block", "part")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Answers, list, list[np.ndarray]]]:
    """Answers, document ids and chunk numbers for each message of documents."""
    order, replies, answers = b"", [], None
    for b in batches:
        for row in range(b.num_rows):
            part, load = b.column("part")[row].as_py(), _unpack(b.column("load")[row].as_py())
            if part == ORDER:
                order, replies, answers = load, [], None
            elif part < DOCS:
                replies.append(load)
            else:
                sizes = b.column("sizes")[row].as_py()
                flat = _long(load)
                if answers is None:
                    # a block without any chunk asks nothing
                    answers = Answers(order, replies)
                    order, replies = b"", []
                ends = np.cumsum(sizes)
                yield answers, b.column("ids")[row].as_py(), [flat[e - n : e] for e, n in zip(ends.tolist(), sizes)]


def encode(docs: DataFrame, path: str, **sizes: int) -> DataFrame:
    """doc_id and ids of every text. ``sizes`` may set ``parts``, block ``size``, chunk numbers in a ``row``, ``room`` of a table."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for answers, doc_ids, coded in _blocks(batches):
            for at in range(0, len(doc_ids), 512):
                yield common.batch(schema, doc_ids[at : at + 512], [answers.ids(c).astype("i4") for c in coded[at : at + 512]])

    return _by_block(docs, path, **sizes).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = segmenter(path).library
        for doc_ids, ids in common.records(batches, "doc_id", "ids"):
            yield common.batch(schema, doc_ids, [library.decode(row or []) for row in ids])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; chunks are decoded from their ids, once a block each."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = segmenter(path).library
        decimal = [str(i) for i in range(library.get_piece_size())]
        known, digits, words = None, [], []
        for answers, doc_ids, coded in _blocks(batches):
            if answers is not known:
                known = answers
                digits = answers.each(lambda ids: ",".join(map(decimal.__getitem__, ids)).encode())
                # decoding drops the chunk's first marker, a space unless it opens the text
                words = answers.each(lambda ids: library.decode(ids).encode())
            rows = []
            for i, numbers in zip(doc_ids, coded):
                order = numbers.tolist()
                ids, text = b",".join(map(digits.__getitem__, order)), b" ".join(map(words.__getitem__, order))
                rows.append((i, int(answers.sizes[numbers].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield common.batch(schema, *zip(*rows))

    return _by_block(docs, path, **sizes).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
