"""Byte-level BPE by a contiguous array of adjacent ranks.

A short word is held as its list of part ids and, beside it, the ranks of adjacent pairs. The smallest rank is found by a scan,
its boundary is deleted and the two neighbouring ranks are refreshed, until no pair has a rank. Words beyond ``SHORT``
parts use a heap of pairs over linked parts, so that a long run without a boundary stays quasi-linear.

Defined results: null text counts as empty and has no ids; special strings of the vocabulary are one id each, as in the library;
repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegrid.llm import common

#: The split pattern that byte-level vocabularies of this kind are defined with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 200
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable Latin-1, else from 256 on."""
    plain = [b for r in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(r[0], r[1] + 1)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Codec:
    """``encode`` and ``decode`` of one vocabulary file; ``capacity`` bounds the cached pieces."""

    def __init__(self, path: str, capacity: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.rank: dict[int, tuple[int, int]] = {}  # (left << 32 | right): rank, merged id
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], (r, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.split = regex.compile(SPLIT)
        # white space next to a space: pieces may then span the space
        self.uneven = regex.compile(r"\s \s|  ")
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.capacity = capacity
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Part ids after all merges."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get, none = self.rank.get, (NONE, 0)
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NONE:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(parts[x] << 32 | parts[y])):
                    heapq.heappush(heap, (r[0], x, parts[x], parts[y], r[1]))
        return [p for p in parts if p >= 0]

    def _piece(self, piece: str) -> bytes:
        if (known := self.pieces.get(piece)) is None:
            first = self.first
            known = np.array(self.merge([first[b] for b in piece.encode()]), "<u4").tobytes()
            if len(self.pieces) >= self.capacity:
                self.pieces.clear()
            if len(piece) <= SHORT:
                self.pieces[piece] = known
        return known

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.split.findall(text)))

    def _even(self, text: str) -> bytes:
        """A text in which no white space touches a space: each space belongs to what follows it."""
        if self.uneven.search(text) or text[:1] == " " or text[-1:] == " ":
            return self._plain(text)
        first, *rest = text.split(" ")
        chunks = self.chunks
        out = [self._plain(first)]
        for c in rest:
            if (known := chunks.get(c)) is None:
                known = self._plain(" " + c)
                if len(chunks) >= self.capacity:
                    chunks.clear()
                if len(c) <= SHORT:
                    chunks[c] = known
            out.append(known)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.marks is None or not self.marks.search(text):
            return np.frombuffer(self._even(text), "<u4")
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._even(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._even(text[at:])]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for ids, texts in common.records(batches, "doc_id", "text"):
            for at in range(0, len(ids), 512):
                yield common.batch(schema, ids[at : at + 512], [c.encode(t).astype("i4") for t in texts[at : at + 512]])

    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(row.values.to_numpy()) for row in b.column("ids")]
            yield common.batch(schema, b.column("doc_id"), texts)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; the text is decoded from its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for doc_ids, texts in common.records(batches, "doc_id", "text"):
            rows = []
            for i, t in zip(doc_ids, texts):
                ids = c.encode(t)
                rows.append((i, len(ids), sha(",".join(map(c.decimal.__getitem__, ids.tolist()))), sha(c.decode(ids))))
            yield common.batch(schema, *zip(*rows))

    return common.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
