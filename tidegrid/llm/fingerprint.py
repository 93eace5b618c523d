"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (what lies between line feeds) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, component by component, modulo a power of two. The sum doesn't depend on the order of paragraphs, and a
paragraph is inserted or deleted by adding or subtracting its vector. The vector has two parts:

* ``LANES`` components modulo 2**32 from an extendable hash of the paragraph. They decide equality.
* ``SKETCH`` components modulo 2**16: every sentence of the paragraph adds +1 or -1 to one of them. Sums of squares of these
  components estimate how many sentences two documents share, from the fingerprints alone.

``likeness`` is 1 for equal fingerprints, else 1 - |a - b|^2 / (|a|^2 + |b|^2) of the sketches, cut to [0, 1).

Defined results: null text counts as empty; the empty text is one empty paragraph without a sentence; two sketches without a
sentence are like (0) unless the fingerprints are equal (1); of rows that repeat an id the order is that of a hash of the text,
then of the text; the next document of the last is the first, and of a single one itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import common

LANES, SKETCH = 32, 256
SENTENCE = re.compile(rb"[.!?] ")


class Fingerprint:
    """A sum of paragraph vectors."""

    __slots__ = ("lanes", "sketch")

    def __init__(self, lanes: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, "<u4") if lanes is None else lanes
        self.sketch = np.zeros(SKETCH, "<u2") if sketch is None else sketch

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        paragraphs = text.encode().split(b"\n")
        wide = b"".join([hashlib.shake_128(p).digest(4 * LANES) for p in paragraphs])
        lanes = np.frombuffer(wide, "<u4").reshape(-1, LANES).sum(axis=0, dtype="<u4")
        hashes = np.array([xxhash.xxh3_64_intdigest(s) for p in paragraphs for s in SENTENCE.split(p) if s], np.uint64)
        place, minus = (hashes % np.uint64(SKETCH)).astype(np.intp), (hashes >> np.uint64(63)).astype(bool)
        added = np.bincount(place[~minus], minlength=SKETCH) - np.bincount(place[minus], minlength=SKETCH)
        return cls(lanes, added.astype("<u2"))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.sketch - other.sketch)

    def hex(self) -> str:
        return self.lanes.tobytes().hex() + self.sketch.tobytes().hex()

    @classmethod
    def from_hex(cls, s: str) -> Fingerprint:
        raw = bytes.fromhex(s)
        return cls(np.frombuffer(raw[: 4 * LANES], "<u4"), np.frombuffer(raw[4 * LANES :], "<u2"))

    def likeness(self, other: Fingerprint) -> float:
        if (self.lanes == other.lanes).all() and (self.sketch == other.sketch).all():
            return 1.0
        signed = lambda x: x.astype("<u2").view("<i2").astype(np.float64)
        a, b, d = signed(self.sketch), signed(other.sketch), signed(self.sketch - other.sketch)
        total = float(a @ a + b @ b)
        return min(max(1.0 - float(d @ d) / total, 0.0), 0.999999) if total else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.records(batches, "doc_id", "text"):
            yield common.batch(schema, ids, [Fingerprint.of(t).hex() for t in texts])

    return common.texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: At most so many ranges, so at most so many bounds and heads are sent to every task: 16 bytes each, 1 MB in all.
MAX_RANGES = 65_536


def in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds ``part`` (ranges of ascending doc_id) and ``halo``: rows of a range's first id come once more, as halo of the range before.

    The bounds come from the doc_id column alone. A null id comes before all others.
    """
    ranges = max(1, min(ranges, MAX_RANGES))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    steps = [i / ranges for i in range(1, ranges)]
    found = rows.select(F.percentile_approx(key, steps, 10 * ranges).alias("b")).first().b if steps else None
    bounds = np.array(sorted({*(found or [])}), dtype=np.int64)

    @F.pandas_udf("long")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"))

    heads = sorted((r.part, r.first) for r in rows.groupBy(part_of(key).alias("part")).agg(F.min(key).alias("first")).collect())
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    firsts, parts = np.array(sorted(before), np.int64), np.array([before[f] for f in sorted(before)], np.int64)

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        own, at = np.searchsorted(bounds, ids.to_numpy(), side="right"), np.searchsorted(firsts, ids.to_numpy())
        head = at < len(firsts)
        head[head] = firsts[at[head]] == ids.to_numpy()[head]
        return pd.Series([[o, parts[a]] if h else [o] for o, a, h in zip(own, at, head)])

    return rows.select("*", F.posexplode(places(key)).alias("halo", "part"))


def edit_report(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every document beside its edited text and the next document by doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Texts move once, by range.
    """
    rows = common.texts(docs)
    if ranges is None:
        ranges = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "halo", "doc_id", common.text_key(F.col("text")), "text"]
    dealt = in_ranges(rows, ranges).repartition(F.col("part")).sortWithinPartitions(*order)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))

    def report(doc_id, text: str, own: Fingerprint, following: str, other: Fingerprint) -> tuple:
        new = edited(text, following)
        new_print = Fingerprint.of(new)
        sha = hashlib.sha256(new.encode()).hexdigest()
        return doc_id, len(text), sha, own.hex(), new_print.hex(), own.likeness(new_print), own.likeness(other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, doc_id, text, fingerprint of the row that waits for its next
        for parts, halos, ids, texts in common.records(batches, "part", "halo", "doc_id", "text"):
            out = []
            for part, halo, doc_id, text in zip(parts, halos, ids, texts):
                if halo and (last is None or last[0] != part):
                    continue  # the halo's first row was enough
                own = Fingerprint.of(text)
                if last is not None and last[0] == part:
                    out.append(report(*last[1:], text, own))
                last = None if halo else (part, doc_id, text, own)
                if len(out) >= 512:
                    yield common.batch(schema, *zip(*out))
                    out = []
            if out:
                yield common.batch(schema, *zip(*out))

    return dealt.select("part", "halo", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
