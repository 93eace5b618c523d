"""Repair of conversations: the cheapest edits that bring their turns into order.

Turns of a conversation must read ``(s?(ua)+)?`` by the first letters of their roles: an optional system turn, then user and assistant
in turn. A turn is kept (cost 0), gets role user or assistant (1) or is deleted (2); an empty user or assistant turn is inserted
anywhere (5). Blank turns and repeats of an earlier turn must go; a truncated turn that stays costs 5 more.

Rows are dealt by conversation and sorted by turn, and a task streams them. The dynamic programme has four states (what may come next), and each holds
its cost and its rank among the states by the edits' letters; a conversation's state is carried from one Arrow batch to the next. Edits that end in
a turn's letter are never a prefix of one another, so ranks decide every tie. A turn leaves four bytes behind: each state's
way back. Rows wait with these bytes until their conversation ends; when they outgrow ``HOLD`` bytes they go into an Arrow file in the shared
folder, which is read backwards along the ways back and forwards once more to write the repaired turns. So a task holds ``HOLD`` bytes and one
batch, whatever the length of a conversation. Repeats are found by a window over (conversation, role, text) in the same shuffle.

Defined results: a null role or text is one space; a role's first letter decides, and a role without one fits nowhere; null turns come first, rows of one turn stand in order of
role and text; a null id is a conversation of its own; a conversation of which nothing stays has deleted rows only; an empty table gives no rows; other columns stay behind.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm import common
from tidegrid.llm.staging import shared_uri

HOLD = 32 << 20
SPACE = " \t\n\x0b\x0c\r"

#: State: what has been read. The first letters that lead on, and the states in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 40


def _insertions(state: int) -> list[tuple[int, int]]:
    """States reached by 0, 1, ... inserted turns, each with their number."""
    out = [(state, 0)]
    while (following := next(NEXT[out[-1][0], c] for c in "ua" if (out[-1][0], c) in NEXT)) not in [s for s, _ in out]:
        out.append((following, len(out)))
    return out


INSERTIONS = [_insertions(s) for s in range(4)]

#: What a turn may become, by its kind: (first letter, or x for others, or - for turns that must go; truncated).
Kind = tuple[str, bool]


def _moves(state: int, kind: Kind) -> list[tuple[int, int, str]]:
    """(next state, cost, edit) of one turn."""
    letter, truncated = kind
    out = [(state, 2, "D")]
    if letter != "-":
        stay = 5 if truncated else 0
        out += [(NEXT[state, letter], stay, "K")] if (state, letter) in NEXT else []
        out += [(NEXT[state, c], 1 + stay, "R") for c in "ua" if (state, c) in NEXT]
    return out


#: Costs (relative to the least) and ranks of the states.
Front = tuple[tuple[int, ...], tuple[int, ...]]
FIRST: Front = ((0, NEVER, NEVER, NEVER), (0, 1, 2, 3))
EDITS = "DKR"


class Programme:
    """Steps of the dynamic programme, each worked out once: few fronts exist, as states differ by a few insertions at most."""

    def __init__(self):
        self.known: dict[tuple[Front, Kind], tuple[Front, int, bytes]] = {}

    def step(self, front: Front, kind: Kind) -> tuple[Front, int, bytes]:
        """The next front, the cost that all states share, and one byte a state: the state before, insertions, edit."""
        if (found := self.known.get((front, kind))) is None:
            found = self.known[front, kind] = self._step(front, kind)
        return found

    @staticmethod
    def _step(front: Front, kind: Kind) -> tuple[Front, int, bytes]:
        costs, ranks = front
        best: dict[int, tuple] = {}
        for before in range(4):
            if costs[before] >= NEVER:
                continue
            for at, inserted in INSERTIONS[before]:
                for after, cost, edit in _moves(at, kind):
                    letters = "I" * inserted + edit
                    way = (costs[before] + 5 * inserted + cost, ranks[before], letters, before)
                    best[after] = min(best.get(after, (NEVER,)), way)
        least = min(way[0] for way in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        new_costs = tuple(best[s][0] - least if s in best else NEVER for s in range(4))
        new_ranks = tuple(order.index(s) if s in best else 3 for s in range(4))
        back = bytes(
            best[s][3] | (len(best[s][2]) - 1) << 2 | EDITS.index(best[s][2][-1]) << 4 if s in best else 0 for s in range(4)
        )
        return (new_costs, new_ranks), least, back

    @staticmethod
    def finish(front: Front) -> tuple[int, int, int]:
        """Remaining cost, state after the last turn, and turns to insert there."""
        costs, ranks = front
        ways = [
            (costs[s] + 5 * inserted, ranks[s], s, inserted)
            for s in range(4)
            if costs[s] < NEVER
            for at, inserted in INSERTIONS[s]
            if at in ENDS
        ]
        cost, _, state, inserted = min(ways)
        return cost, state, inserted


def walk(back: bytes, state: int) -> tuple[int, list[tuple[int, int]]]:
    """State before the first of some turns and (insertions before it, edit) of each, given the state after the last."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        way = back[at + state]
        out.append((way >> 2 & 3, way >> 4))
        state = way & 3
    return state, out[::-1]


REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
     ("text", pa.string()), ("old_role", pa.string()), ("fault", pa.string())]
)
REPAIRED_DDL = "conv_id long, position long, edit string, turn long, role string, text string, old_role string, fault string"


class Waiting:
    """Rows of a conversation that has not ended, each segment with its ways back; beyond ``hold`` bytes in a file."""

    def __init__(self, folder: str, hold: int):
        self.folder, self.hold = folder, hold
        self.rows: list[tuple[pa.RecordBatch, bytes]] = []
        self.size, self.file = 0, None

    def add(self, rows: pa.RecordBatch, back: bytes) -> None:
        if not rows.num_rows:
            return
        self.rows.append((rows, back))
        self.size += rows.nbytes + len(back)
        if self.size > self.hold:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.fs, root = pafs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(root, recursive=True)
            self.path = f"{root}/{uuid.uuid4().hex}.arrow"
            self.out = self.fs.open_output_stream(self.path)
            self.file = pa.ipc.new_file(self.out, self.rows[0][0].schema.append(pa.field("back", pa.binary(4))))
        for rows, back in self.rows:
            self.file.write_batch(rows.append_column("back", pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), rows.num_rows, [None, pa.py_buffer(back)])))
        self.rows, self.size = [], 0

    def segments(self, state: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
        """All rows in order with their edits, given the state after the last; ends the wait."""
        if self.file is None:
            read, n = (lambda i: self.rows[i]), len(self.rows)
        else:
            self._spill()
            self.file.close()
            self.out.close()
            stored = pa.ipc.open_file(self.fs.open_input_file(self.path))

            def read(i: int) -> tuple[pa.RecordBatch, bytes]:
                b = stored.get_batch(i)
                at = b.column("back").offset * 4
                return b.drop_columns("back"), bytes(b.column("back").buffers()[1])[at : at + 4 * b.num_rows]

            n = stored.num_record_batches
        after = [state] * n
        for i in range(n - 1, 0, -1):
            after[i - 1] = walk(read(i)[1], after[i])[0]
        for i in range(n):
            rows, back = read(i)
            yield rows, walk(back, after[i])[1]
        if self.file is not None:
            self.fs.delete_file(self.path)
        self.rows, self.size, self.file = [], 0, None


class Writer:
    """Repaired turns as record batches of ``size`` rows or more."""

    def __init__(self, size: int = 4096):
        self.size, self.columns = size, [[] for _ in REPAIRED]
        self.position, self.state = 0, START

    def begin(self) -> None:
        self.position, self.state = 0, START

    def _put(self, *row) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)

    def insert(self, conv, times: int) -> None:
        for _ in range(times):
            letter = "u" if (self.state, "u") in NEXT else "a"
            self.state = NEXT[self.state, letter]
            self._put(conv, self.position, "I", None, ROLE[letter], "", None, None)
            self.position += 1

    def turn(self, conv, turn, role: str, text: str, fault: str | None, edit: str) -> None:
        new = role
        if edit == "R":
            letter = "u" if (self.state, "u") in NEXT else "a"
            new = ROLE[letter]
        if edit != "D":
            self.state = NEXT[self.state, new[0]]
        self._put(conv, self.position, edit, turn, new, text, role, fault)
        self.position += 1

    def take(self, all_rows: bool = False) -> Iterator[pa.RecordBatch]:
        if self.columns[0] and (all_rows or len(self.columns[0]) >= self.size):
            yield common.batch(REPAIRED, *self.columns)
            self.columns = [[] for _ in REPAIRED]


FAULTS = (None, "blank", "duplicate", "truncated")


def _kind(letter: str, fault: int) -> Kind:
    return ("-" if fault in (1, 2) else letter if letter in ("s", "u", "a") else "x", fault == 3)


def _prepared(turns: DataFrame) -> DataFrame:
    """Rows with their fault, dealt by conversation and sorted by turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    # one shuffle: the window's keys hold the conversation, so it sorts within the same partitions and spills like any sort
    dealt = rows.repartition("conv_id")
    before = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    open_end = ~F.substring(shown, -1, 1).isin(".", "!", "?")
    fault = F.when(shown == "", 1).when(F.row_number().over(before) > 1, 2).when(open_end, 3).otherwise(0)
    return dealt.withColumn("fault", fault.cast("byte")).sortWithinPartitions(*order)


def repair(turns: DataFrame, hold: int = HOLD) -> DataFrame:
    """The edits of every conversation in order: K and R rows are its repaired turns, I rows are inserted, D rows are deleted.

    ``old_role`` and ``fault`` (blank, duplicate, truncated) belong to the turn as it was. Rows stay dealt by conversation and in order.
    """
    folder = shared_uri(turns.sparkSession, "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme, waiting, writer = Programme(), Waiting(folder, hold), Writer()
        current, front, open_ = None, FIRST, False

        def close() -> Iterator[pa.RecordBatch]:
            _, state, inserted = programme.finish(front)
            writer.begin()
            for rows, edits in waiting.segments(state):
                columns = [rows.column(c).to_pylist() for c in ("turn", "role", "text", "fault")]
                for turn, role, text, fault, (before, edit) in zip(*columns, edits):
                    writer.insert(current, before)
                    writer.turn(current, turn, role, text, FAULTS[fault], EDITS[edit])
                yield from writer.take()
            writer.insert(current, inserted)

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id").to_pylist()
            letters = [r[:1] for r in b.column("role").to_pylist()]
            faults = b.column("fault").to_pylist()
            at = 0
            for conv, same in groupby(ids):
                n = sum(1 for _ in same)
                if not open_ or conv != current:
                    if open_:
                        yield from close()
                    current, front, open_ = conv, FIRST, True
                back = bytearray()
                for letter, fault in zip(letters[at : at + n], faults[at : at + n]):
                    front, _, ways = programme.step(front, _kind(letter, fault))
                    back += ways
                waiting.add(b.slice(at, n), bytes(back))
                at += n
        if open_:
            yield from close()
        yield from writer.take(all_rows=True)

    return _prepared(turns).mapInArrow(run, REPAIRED_DDL)


REPORT = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
     ("audit", pa.string()), ("repaired_sha256", pa.string())]
)
REPORT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
LEGAL = {"su", "ua", "au"}


class Tally:
    """Figures of one conversation from its edits in order."""

    def __init__(self):
        self.first = self.last = self.letter = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = dict.fromkeys(FAULTS[1:], 0)
        self.audit: list[str] = []
        self.sha, self.any = hashlib.sha256(), False

    def add(self, edit: str, turn: int | None, role: str, text: str, old_role: str | None, fault: str | None) -> None:
        self.audit.append(edit)
        self.cost += COST[edit] + 5 * (fault == "truncated" and edit != "D")
        if edit != "I":
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.distinct = turn, self.distinct + 1
            if fault:
                self.faults[fault] += 1
            letter = old_role[:1]
            if self.letter is not None and self.letter + letter not in LEGAL:
                self.illegal += 1
            self.letter = letter
        if edit != "D":
            self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True

    def row(self, conv: int | None) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def summary(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s result, read in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tally, done = None, None, []
        for convs, *columns in common.records(batches, "conv_id", "edit", "turn", "role", "text", "old_role", "fault"):
            for conv, *row in zip(convs, *columns):
                if tally is None or conv != current:
                    if tally is not None:
                        done.append(tally.row(current))
                    current, tally = conv, Tally()
                tally.add(*row)
            if done:
                yield common.batch(REPORT, *zip(*done))
                done = []
        if tally is not None:
            yield common.batch(REPORT, *zip(tally.row(current)))

    return repaired.mapInArrow(run, REPORT_DDL)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the row's key decides: dropped, emptied, unmarked, repeated or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    hit = (F.crc32(key.cast("binary")) % 20).cast("int")
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    )
    return rows.drop("_copy")


def report(turns: DataFrame, hold: int = HOLD) -> DataFrame:
    """Figures of every conversation of ``turns`` after damage and repair; one that lost all rows has zeros."""
    found = summary(repair(damage(turns), hold)).withColumnRenamed("conv_id", "_found")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in REPORT.names[1:7]}
    nothing = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left").drop("_found").withColumns(zeros | nothing)
