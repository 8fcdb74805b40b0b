"""Repair of damaged conversations: cheapest edits by Dial's bucket-queue shortest paths, told as one audit string each.

A conversation is a graph of nodes (rows passed, role last given); edits are arcs of small whole costs. Distances to the
end come from a circular queue of one bucket for each cost; the audit then walks tight arcs from the start, least letter
first. Rows are sorted over the cluster by conversation and turn first, so a large conversation is ordered by many tasks.
Its search needs one byte and four distances a row, and its texts are hashed as they stream by in order.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, bounded_batches, hot_keys, join_hot, materialize, release

#: What is blank, what ends a sentence, and what edits cost. An undeleted truncated row costs CUT more.
BLANK, ENDS = " \t\n\x0b\f\r", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Roles last given: none, system, user, assistant. A repaired conversation is empty or ends with the assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NONE, ASSISTANT)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or changed row must be
BEFORE = {NONE: (), SYSTEM: (), USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}  # where such a row may stand
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BUCKETS = max(DELETE, INSERT, REROLE + CUT) + 1
#: The code of a row: the role of its initial (0 for any other), with these bits for faults.
FORCED, TRUNCATED = 4, 8
LIMIT = (1 << 63) - 1


def damaged(table: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """What is left after damage by the crc32 of the row's name: conv_id, turn, role, text and copies (1 or 2). Null roles and texts are a space."""
    blank = F.lit(" ")
    known = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    fault = F.crc32(F.concat(known(conv_id), F.lit(":"), known(turn)).cast("binary")) % 20
    rows = table.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), known(role).alias("role"), known(text).alias("text"), fault.alias(P + "fault"))
    what = F.col(P + "fault")
    return rows.where(what != 0).select(
        "conv_id",
        "turn",
        F.when(what == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(what == 1, F.lit("")).when(what == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(what == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def distances(codes: bytes | bytearray) -> array:
    """Cost from every node (rows passed * 4 + role) to the goal, by Dial's algorithm on the reversed graph."""
    n = len(codes)
    far = array("q", [-1]) * (4 * (n + 1))
    queue: list[list[int]] = [[] for _ in range(BUCKETS)]
    queue[0] = [4 * n + goal for goal in GOALS]
    waiting, cost = len(queue[0]), 0
    while waiting:
        bucket = queue[cost % BUCKETS]
        while bucket:  # arcs without cost come back to the same bucket
            node = bucket.pop()
            waiting -= 1
            if far[node] >= 0:
                continue
            far[node] = cost
            passed, last = divmod(node, 4)
            arcs = [(4 * passed + before, INSERT) for before in BEFORE[last]]
            if passed:
                code = codes[passed - 1]
                arcs.append((node - 4, DELETE))
                if not code & FORCED:
                    extra, initial = CUT if code & TRUNCATED else 0, code & 3
                    arcs += [(4 * (passed - 1) + before, REROLE + extra) for before in BEFORE[last]]
                    if initial and initial == last:
                        arcs += [(4 * (passed - 1) + before, KEEP + extra) for before in (BEFORE[last] or (NONE,))]
            for at, more in arcs:
                if far[at] < 0:
                    queue[(cost + more) % BUCKETS].append(at)
                    waiting += 1
        cost += 1
    return far


def audit(codes: bytes | bytearray) -> tuple[int, str]:
    """The least cost, and the ASCII-least of the cheapest edits as initials: D, I, K and R."""
    far, n = distances(codes), len(codes)
    at, last, letters = 0, NONE, bytearray()
    while at < n or far[4 * at + last]:
        left = far[4 * at + last]
        if at < n and far[4 * (at + 1) + last] == left - DELETE:
            at, letter = at + 1, b"D"
        elif far[4 * at + NEXT[last]] == left - INSERT:
            last, letter = NEXT[last], b"I"
        else:
            extra, initial = CUT if codes[at] & TRUNCATED else 0, codes[at] & 3
            fits = last in BEFORE[initial] or (initial == SYSTEM and last == NONE)
            if initial and fits and far[4 * (at + 1) + initial] == left - KEEP - extra:
                last, letter = initial, b"K"
            else:
                last, letter = NEXT[last], b"R"
            at += 1
        letters += letter
    return far[NONE], letters.decode()


class Repair:
    """One conversation: first every row's facts in order, then its texts in the same order."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.codes, self.rows = conv_id, bytearray(), array("q")
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None
        self.sha, self.letters, self.cost, self.at, self.passed, self.last, self.lines = hashlib.sha256(), None, 0, 0, 0, NONE, 0

    def fact(self, row: int, turn: int | None, initial: str, copies: int, first: bool, blank: bool, cut: bool) -> None:
        """``copies`` equal rows; ``first`` if no equal role and text came before."""
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.turns = turn if self.first_turn is None else self.first_turn, self.turns + 1
            self.last_turn = turn
        good = not blank and first
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - first
        self.truncated += good and cut
        self.illegal += (self.initial is not None and (self.initial, initial) not in LEGAL) + copies - 1
        self.initial = initial
        self.codes.append(INITIALS.get(initial, 0) | (0 if good else FORCED) | (TRUNCATED if cut else 0))
        self.codes += bytes([FORCED]) * (copies - 1)
        self.rows.extend([row] + [-1] * (copies - 1))

    def _line(self, line: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + line.encode())
        self.lines += 1

    def _until(self, row: int | None) -> str | None:
        """Carry edits out up to that row, or all; the letter that the row itself gets."""
        if self.letters is None:
            self.cost, self.letters = audit(self.codes)
        while self.at < len(self.letters):
            letter = self.letters[self.at]
            if letter == "I":
                self.last = NEXT[self.last]
                self._line(f"{NAMES[self.last]}:")
            elif self.rows[self.passed] == row:
                return letter
            elif letter != "D":
                raise ValueError(f"row {self.rows[self.passed]} of conversation {self.conv_id} has no text")
            else:
                self.passed += 1
            self.at += 1
        return None

    def text(self, row: int, role: str, text: str) -> None:
        letter = self._until(row)
        if letter == "D":
            return
        self.last = NEXT[self.last] if letter == "R" else self.codes[self.passed] & 3
        self._line(f"{NAMES[self.last] if letter == 'R' else role}:{text}")
        self.at, self.passed = self.at + 1, self.passed + 1

    def result(self) -> dict:
        self._until(None)
        gaps = 0 if self.first_turn is None else min(LIMIT, self.last_turn - self.first_turn + 1 - self.turns)
        counts = {c: int(getattr(self, c)) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return {"conv_id": self.conv_id, "gaps": gaps, **counts, "audit": self.letters, "repaired_sha256": self.sha.hexdigest()}


def repair_conversations(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage every conversation by rule, then find the cheapest edits that give it roles ``(s?(ua)+)?``.

    Rows of one conversation are taken by turn, nulls first; rows that share a turn by role, then text. Equal rows stand
    beside each other. Null roles and texts count as one space, null conversation ids are one conversation, and an empty role
    has no initial. Returns for each conversation of the table: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256; one whose rows are all dropped has zeros, an empty audit and the hash of the empty string. An
    empty table gives an empty result, gaps saturate at 63 bits, and other columns are not read. A row of the result holds a
    conversation's whole audit, a letter a row; its hash runs over its texts in one order, so one task reads these, in a stream.
    The result reads a scratch table.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    same = damaged(table, conv_id, turn, role, text).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    seen = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.when(F.col("conv_id").isNull(), "n").otherwise(":"), F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    shown = F.rtrim("text", F.lit(BLANK))
    rows = materialize(
        same.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "conv_id", "turn", "role", "text", "copies", F.monotonically_increasing_id().alias("row"), F.unhex(seen).alias("seen"),
            (shown == "").alias("blank"), ((shown != "") & ~F.right(shown, F.lit(1)).isin(*ENDS)).alias("cut"),
        )
    )
    firsts = materialize(rows.groupBy("seen").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(firsts.select("seen", "n"), "n", rows.count())
    facts = join_hot(rows.select("conv_id", "row", "turn", "copies", "seen", "blank", "cut", F.left("role", F.lit(1)).alias("initial")), firsts.select("seen", "first"), ["seen"], hot)
    kind = lambda k: F.lit(k).alias("kind")
    every = table.select(F.col(conv_id).alias("conv_id")).distinct().select("conv_id", kind(0))
    told = facts.select("conv_id", kind(1), "row", "turn", "initial", "copies", (F.col("row") == F.col("first")).alias("first"), "blank", "cut")
    texts = rows.where("not blank").select("conv_id", kind(2), "row", "role", "text")
    stream = every.unionByName(told, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "row")
    columns = stream.columns

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now = None, None
        for batch in batches:
            done = []
            if schema is None:
                id_type = batch.schema.field("conv_id").type
                schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True):
                x = dict(zip(columns, row, strict=True))
                if x["kind"] == 0:
                    if now is not None:
                        done.append(now.result())
                    now = Repair(x["conv_id"])
                elif x["kind"] == 1:
                    now.fact(x["row"], x["turn"], x["initial"], x["copies"], x["first"], x["blank"], x["cut"])
                else:
                    now.text(x["row"], x["role"], x["text"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], schema=schema)

    id_kind = rows.schema["conv_id"].dataType.simpleString()
    out = materialize(stream.mapInArrow(repair, f"conv_id {id_kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"))
    release(rows, firsts)
    return out
