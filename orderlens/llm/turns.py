"""Repair of damaged conversations by the cheapest edits, as a stream over sorted turns.

A repaired conversation has the role initials `(s?(ua)+)?`: perhaps a system row, then pairs
of user and assistant. Edits, one letter each: K keeps a row (0), R gives it the role user or
assistant (3), D deletes it (4; blank and duplicate rows have to go), I inserts an empty row of
user or assistant (3). A truncated row that stays costs 3 more.

Rows are partitioned by conversation and sorted inside, the latest turn first. One pass over
the Arrow batches carries, per conversation, the least cost from here to the end for each of
the four places a repaired conversation can be in (nothing yet, after system, after user,
after assistant). Only differences between these costs matter and they take few values, so a
row is one lookup in a small table. Every row leaves one byte: which edit to take in each
place. When the first row of the conversation is reached, the bytes are walked back to the
last row, which gives the edits and, with the rows, the repaired text. Bytes and rows of a
conversation that grows large are moved to a file of the task. Walking from the front and
taking the smallest letter that still costs least gives the ASCII-least of the cheapest.

Defined cases:
- null texts and roles count as one space, null ids and turns as one space where they name a
  row for damage; null turns come first, and a null conversation id is one conversation;
- rows of equal turn follow their role and text; repeated rows stand next to each other, all
  but the first are duplicates;
- a conversation without rows gives zeros, no edits and the hash of the empty text; an empty
  table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import prepare

# --- Fixed values -------------------------------------------------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAULTS = ("none", "blank", "duplicate", "truncated")
LEGAL_PAIRS = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
# ------------------------------------------------------------------------------
# Bytes of rows and choices that a conversation keeps in memory.
HELD_BYTES = 8 << 20

# Places: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
GIVEN = (2, 2, 3, 2)  # the place after a row whose role is free to choose
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
LETTERS = "DIKR"
RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: one fault planted by the checksum of `conv_id:turn`.

    A dropped row stays as a marker that is not alive, so that its conversation is not lost.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", kind.alias("kind"), spaced("role").alias("role"), spaced("text").alias("text")
    )
    text = F.col("text")
    return rows.select(
        "conv_id",
        F.when(F.col("kind") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", ""))
        .when(F.col("kind") != 0, text).alias("text"),
        (F.col("kind") != 0).alias("alive"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault, the place in FAULTS of each row's first fault; one shuffle by conversation.

    The window over equal rows needs no shuffle of its own: its keys begin with conv_id.
    """
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    same = F.when(F.col("alive"), F.md5(F.concat_ws("\x00", "role", "text")))
    at = [F.asc_nulls_first("turn")]
    earlier = Window.partitionBy("conv_id", "same").orderBy(*at)
    return (
        rows.repartition("conv_id")
        .withColumns({"end": end, "same": same})
        .withColumn("nth", F.row_number().over(earlier))
        .withColumn(
            "fault",
            F.when(F.col("end") == "", 1).when(F.col("nth") > 1, 2)
            .when(~F.col("end").isin(".", "!", "?"), 3).otherwise(0),
        )
        .drop("end", "same")
    )


class Costs:
    """The table of steps: from the costs behind a row to the costs before it."""

    END = (0, 2 * INSERT, INSERT, 0)

    def __init__(self):
        self.steps: dict[tuple, tuple[tuple, int, int]] = {}

    def step(self, costs: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
        """(costs before the row less their least, that least, choices: two bits a place)."""
        key = costs, initial, fault
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self._step(*key)
        return found

    @staticmethod
    def _step(costs: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
        stays = fault in (0, 3)
        extra = TRUNCATED if fault == 3 else 0
        options: list[dict[str, int]] = []
        for place in range(4):
            ways = {"D": DELETE + costs[place]}
            if stays:
                ways["R"] = REROLE + extra + costs[GIVEN[place]]
                if initial in KEPT[place]:
                    ways["K"] = KEEP + extra + costs[KEPT[place][initial]]
            options.append(ways)
        least = [min(ways.values()) for ways in options]
        for _ in range(3):  # from any place, two inserts reach all that inserts can reach
            least = [min(least[p], INSERT + least[GIVEN[p]]) for p in range(4)]
        choices = 0
        for place, ways in enumerate(options):
            ways["I"] = INSERT + least[GIVEN[place]]
            letter = min(c for c in LETTERS if ways.get(c) == least[place])
            choices |= LETTERS.index(letter) << (2 * place)
        low = min(least)
        return tuple(c - low for c in least), low, choices


class Conversation:
    """The rows of one conversation, the latest first, until its first row is met."""

    def __init__(self, table: Costs, held_bytes: int):
        self.table, self.held_bytes = table, held_bytes
        self.costs, self.base = Costs.END, 0
        self.counts = [0, 0, 0, 0]
        self.turns, self.high, self.low, self.illegal = 0, None, None, 0
        self.follower: str | None = None
        self.choices, self.rows, self.bytes = bytearray(), [], 0
        self.file, self.places = None, []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if turn is not None and turn != self.low:
            self.turns += 1
            self.high = turn if self.high is None else self.high
            self.low = turn
        if self.follower is not None and role[:1] + self.follower not in LEGAL_PAIRS:
            self.illegal += 1
        self.follower = role[:1]
        self.costs, more, choice = self.table.step(self.costs, role[:1], fault)
        self.base += more
        self.choices.append(choice)
        stays = fault in (0, 3)
        self.rows.append((role, text) if stays else None)
        self.bytes += 100 + (len(role) + len(text) if stays else 0)
        if self.bytes > self.held_bytes:
            self._move()

    def _move(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.places.append(self.file.tell())
        pickle.dump((bytes(self.choices), self.rows), self.file)
        self.choices, self.rows, self.bytes = bytearray(), [], 0

    def _forward(self) -> Iterator[tuple[int, tuple[str, str] | None]]:
        """Choices and rows from the first turn to the last."""
        yield from zip(reversed(self.choices), reversed(self.rows), strict=True)
        for place in reversed(self.places):
            self.file.seek(place)
            choices, rows = pickle.load(self.file)
            yield from zip(reversed(choices), reversed(rows), strict=True)

    def result(self) -> tuple:
        letters, digest, first = bytearray(), hashlib.sha256(), True
        place = 0

        def put(role: str, text: str) -> None:
            nonlocal first
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False

        def insert() -> None:
            nonlocal place
            place = GIVEN[place]
            letters.extend(b"I")
            put(ROLE[place], "")

        for choice, row in self._forward():
            while (letter := LETTERS[choice >> 2 * place & 3]) == "I":
                insert()
            letters.extend(letter.encode())
            if letter == "R":
                place = GIVEN[place]
                put(ROLE[place], row[1])
            elif letter == "K":
                place = KEPT[place][row[0][0]]
                put(*row)
        while place in (1, 2):
            insert()
        if self.file:
            self.file.close()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        cost = self.base + self.costs[0]
        _, blank, duplicate, truncated = self.counts
        return gaps, blank, duplicate, truncated, self.illegal, cost, letters.decode(), digest.hexdigest()


def repair(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """conv_id and RESULT per conversation of `with_faults`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    latest_first = [F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")]
    narrow = rows.sortWithinPartitions("conv_id", *latest_first).select(
        "conv_id", "turn", "role", "text", F.when(F.col("alive"), F.col("fault")).alias("fault")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, present, now = Costs(), None, None
        results: list[tuple] = []
        schema = None

        def batch_of(results: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(zip(*results, strict=True), schema, strict=True)], schema=schema
            )

        for batch in batches:
            if schema is None:
                fields = [(n.split()[0], pa.string() if n.endswith("string") else pa.int64()) for n in RESULT.split(", ")]
                schema = pa.schema([batch.schema.field("conv_id"), *[pa.field(n, t) for n, t in fields]])
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != present:
                    if now is not None:
                        results.append((present, *now.result()))
                    present, now = conv, Conversation(table, held_bytes)
                if fault is not None:
                    now.add(turn, role, text, fault)
            if len(results) > 1000:
                yield batch_of(results)
                results = []
        if now is not None:
            results.append((present, *now.result()))
            yield batch_of(results)

    return narrow.mapInArrow(walk, f"conv_id {kind}, {RESULT}")


def repair_conversations(conversations: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Damages the conversations, finds the faults and repairs them: one row each."""
    prepare(conversations.sparkSession)
    return repair(with_faults(damaged(conversations)), held_bytes)
