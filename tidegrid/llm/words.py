"""Token ids of whole texts by a public tokenizer that drops white space, through a bounded cache of chunks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Marks that the tokenizer keeps apart from the letters before them. Not all: an apostrophe may open an ending of its own.
MARKS = "!\"#$%&()*+,-./:;=?@[]^_{}~"

#: Characters of texts that are cut into chunks at once, at least.
HELD = 4 << 20


class ChunkEncoder:
    """Encodes text between spaces once per distinct chunk.

    The tokenizer never joins what white space separates, so a text's ids are those of its chunks in order. ``capacity``
    bounds the cached words, marks and other chunks; a full cache is emptied.
    """

    def __init__(self, path: str, capacity: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.is_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.is_end[list(ends)] = True
        self.capacity = capacity
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only, many in one call: each ends with an id that closes a word."""
        out = []
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(some):  # a letter that becomes several marks in lower case
                out += self._encode(some)
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, new: list[str]) -> None:
        words = [c for c in new if c.isalpha()]
        others = [c for c in new if not c.isalpha()]
        self.known.update(zip(words, self._encode_letters(words)))
        self.known.update(zip(others, self._encode(others)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and held < HELD:
                held += len(texts[to])
                to += 1
            out += self._encode_some(texts[at:to])
            at = to
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        """Texts that are held at once: each distinct chunk is put together once, its ids are copied to all its places."""
        rows = pc.split_pattern(pc.replace_substring(self._plain(texts), "\n", " "), " ")
        coded = pc.dictionary_encode(rows.values)
        word, marks = (self._ids(part) for part in self._parts(coded.dictionary))
        placed = pc.binary_join_element_wise(word, marks, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        _, ends, data = placed.buffers()
        ids = memoryview(data or b"")
        bounds = np.frombuffer(ends, np.int64)[rows.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    @staticmethod
    def _parts(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Letters and the marks after them, the whole and nothing for other chunks."""
        word = pc.utf8_rtrim(chunks, MARKS)
        word = pc.if_else(pc.utf8_is_alpha(word), word, chunks)
        _, ends, data = chunks.buffers()
        if data is None:
            return word, chunks
        ends = np.frombuffer(ends, np.int64)[: len(chunks) + 1]
        sizes = np.diff(ends) - pc.binary_length(word).to_numpy()
        after = np.append(0, np.cumsum(sizes))
        marks = np.frombuffer(data, np.uint8)[np.repeat(ends[1:] - after[1:], sizes) + np.arange(after[-1])]
        return word, pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(after), pa.py_buffer(marks))

    def _ids(self, parts: pa.Array) -> pa.Array:
        """Ids of words, marks or chunks, each distinct one looked up once."""
        coded = pc.dictionary_encode(parts)
        some = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        new = [c for c in some if c not in known]
        if len(known) + len(new) > self.capacity:
            known, new = {"": b""}, some
            self.known = known
        if new:
            self._learn(new)
        return pa.array([known[c] for c in some], pa.large_binary()).take(coded.indices)

    @staticmethod
    def _plain(texts: list[str]) -> pa.Array:
        """A-Z in lower case, as the tokenizer puts them, so that chunks repeat; special tokens keep their case."""
        raw = pa.array(texts, pa.large_string())
        return pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
