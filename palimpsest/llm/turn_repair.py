"""Operator 13, conversation repair by aligning turns to the alternating grammar.

A conversation's role initials should read ``(s?(ua)+)?``.  Every feasible length of that grammar string is a
target of a Wagner-Fischer alignment of the turns: keep (0), rerole (3), delete (4, required for blank and
duplicate turns), insert an empty user or assistant turn (3); a truncated turn that stays costs 3 more.
Lengths are tried from the number of turns outwards.  The cheapest cost so far bounds, after Ukkonen, the
diagonals that a table needs and the lengths worth trying; ties stay inside the band.  The cheapest table of each
length is backtraced to its ASCII-least audit (D, I, K, R), and the audits of equal cost are compared.

A conversation may hold a large part of all turns, so turns stream through sorted, in blocks of ``BLOCK``, and
conversations of at most a block are aligned whole.  A longer one keeps, at every block's end, the best cost and
audit for each grammar state (nothing yet, after the system turn, after a user turn, after an assistant turn), and a
block is aligned to every feasible length of the grammar string from each of them on.  Inserts belong to the block of
the next turn, so that no audit is the beginning of another one and their order is that of the first difference:
the result is that of one whole table.  A task holds one block of turns, the audits and four hash states.

Turns are taken by turn, nulls first, then by role and text (ties do not depend on partitions).  Duplicates are found
by a window in the same partitioning, so rows are shuffled once; a conversation is one task's stream because its
repaired text has one SHA-256, which can only be taken in order.

Defined cases: null roles and texts are one space, null conversation ids one conversation; a role of another initial
can only be reroled or deleted; repeated rows are duplicates; a conversation without turns has zeros, an empty audit
and the hash of nothing; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 16
REMEMBERED = 1 << 16  # alignments of blocks that a worker keeps

NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # grammar states, by what stands last
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 40


def _targets(entry: int, length: int) -> list[str]:
    """Grammar pieces of a length that may follow a state."""
    turns = "aua" if entry == USER else "uau"
    out = [(turns[:2] * (length // 2 + 1))[:length]]
    if entry == NOTHING and length:
        out.append("s" + out[0][:-1])
    return out


def _align(codes: str, target: str, most: int, last: bool) -> tuple[int, str] | None:
    """Cheapest cost, if at most ``most``, and its ASCII-least audit of turning ``codes`` into ``target``."""
    n, m = len(codes), len(target)
    low = max(-n, -(most // DELETE))  # diagonals (column less row) that cost at most ``most`` to reach and to leave
    while low < min(0, m - n) and DELETE * -low + INSERT * (m - n - low) > most:
        low += 1
    high = min(m, most // INSERT)
    while high > max(0, m - n) and INSERT * high + DELETE * (high - (m - n)) > most:
        high -= 1
    if low > min(0, m - n) or high < max(0, m - n):
        return None
    togo = [[_FAR] * (m + 2) for _ in range(n + 2)]
    togo[n][m] = 0
    for i in range(n, -1, -1):
        row, below = togo[i], togo[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = row[j]
            if j < m and target[j] != "s" and (i < n or last):
                best = min(best, INSERT + row[j + 1])
            if i < n:
                best = min(best, DELETE + below[j])
                if j < m:
                    best = min(best, _stay(codes[i], target[j]) + below[j + 1])
            row[j] = best
    if togo[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        here = togo[i][j]
        if i < n and here == DELETE + togo[i + 1][j]:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or last) and here == INSERT + togo[i][j + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return togo[0][0], "".join(audit)


def _stay(code: str, wanted: str) -> int:
    """Cost of a turn that stays in a place of the grammar string (far for one that must go)."""
    if code == "x" or wanted == "s" != code.lower():
        return _FAR
    return (KEEP if code.lower() == wanted else REROLE) + (TRUNCATED if code.isupper() else 0)


@lru_cache(REMEMBERED)
def align_block(codes: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """Cheapest ``(cost, audit)`` from a grammar state to every state that a block's turns can end in.

    ``codes`` has a letter a turn: its initial (``o`` for others), in upper case if truncated, or ``x`` if it must go.
    """
    n, best = len(codes), {}
    # the lengths nearest to the turns first: they give the incumbents that bound the rest
    for length in sorted(range(2 * n + 3), key=lambda x: (abs(x - n), x)):
        away = INSERT * (length - n) if length > n else DELETE * (n - length)
        for target in _targets(entry, length):
            state = _STATE[target[-1]] if target else entry
            if last and state not in (NOTHING, ASSISTANT):
                continue
            most = best[state][0] if state in best else DELETE * n + INSERT * (length + 2) + TRUNCATED * n
            if away <= most and (found := _align(codes, target, most, last)):
                best[state] = min(best.get(state, found), found)
    return best


class Repair:
    """The turns of one conversation, in order; ``close`` gives its row."""

    def __init__(self):
        self.turns, self.codes = [], []
        # by grammar state: cost, place among the audits, audit (a chain of pieces), hash of the repaired text
        self.best = {NOTHING: (0, 0, None, hashlib.sha256())}
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.numbers = self.low = self.high = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if len(self.turns) == BLOCK:
            self._block(False)
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            if self.numbers is None:
                self.numbers, self.low, self.high = 1, turn, turn
            elif turn != self.high:
                self.numbers, self.high = self.numbers + 1, turn
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        code = initial if initial in _STATE else "o"
        self.turns.append((role, text))
        self.codes.append("x" if fault in (1, 2) else code.upper() if fault == 3 else code)

    def _block(self, last: bool) -> None:
        codes, ways = "".join(self.codes), {}
        for entry, (cost, place, _, _) in self.best.items():
            for state, (more, piece) in align_block(codes, entry, last).items():
                way = (cost + more, place, piece, entry)
                ways[state] = min(ways.get(state, way), way)
        order = sorted(ways.values(), key=lambda w: w[1:3])
        best = {}
        for state, way in ways.items():
            cost, _, piece, entry = way
            _, _, chain, digest = self.best[entry]
            digest, state_now = digest.copy(), entry
            for _, role, text in edited(piece, self.turns, entry):
                digest.update(f"{'' if state_now == NOTHING else chr(10)}{role}:{text}".encode())
                state_now = None
            best[state] = (cost, order.index(way), (chain, piece), digest)
        self.best, self.turns, self.codes = best, [], []

    def close(self) -> tuple:
        if self.turns:
            self._block(True)
        cost, _, chain, digest = min(self.best.values(), key=lambda b: b[:2])
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        gaps = 0 if self.numbers is None else self.high - self.low + 1 - self.numbers
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(pieces)),
                digest.hexdigest())


def edited(audit: str, turns, state: int = NOTHING) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of the repaired turns that an audit makes of ``(role, text)`` turns."""
    turns = iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K":
            state = _STATE[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role = "user" if state == USER else "assistant"
        yield edit, role, text


# ------------------------------------------------------------------------------------------- on Spark

_WORD = r"[^\x20\x09-\x0D]"
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def faulty(turns: DataFrame, present: Column | None = None, conv_id: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, fault)`` in order; fault is 0 none, 1 blank, 2 duplicate, 3 truncated and 4 for
    rows that are not ``present``, which stand for their conversation only."""
    here = F.lit(True) if present is None else present
    rows = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
                        F.when(here, F.col(f"`{turn}`")).cast("long").alias("turn"),
                        F.when(here, F.coalesce(F.col(f"`{role}`"), F.lit(" "))).alias("role"),
                        F.when(here, F.coalesce(F.col(f"`{text}`"), F.lit(" "))).alias("text"), here.alias("here"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = (F.when(~F.col("here"), 4).when(~F.col("text").rlike(_WORD), 1).when(F.col("seen") > 1, 2)
             .when(~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0))
    return (rows.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault.cast("int"))
            .select("conv_id", "turn", "role", "text", "fault"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", *first, "turn", "role", "text")])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])


def audits(faults: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for every conversation of ``faulty``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def table(done):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        repair, now = None, None
        for batch in batches:
            done = []
            for conv, turn, role, text, fault in _rows(batch):
                if repair is None or conv != now:
                    if repair:
                        done.append((now, *repair.close()))
                    repair, now = Repair(), conv
                if fault < 4:
                    repair.add(turn, role, text, fault)
            if done:
                yield table(done)
        if repair:
            yield table([(now, *repair.close())])

    return _ordered(faults).mapInArrow(run, SCHEMA)


def repaired(faults: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, position, edit, role, text)``: the repaired turns, from the turns and their audits.

    A conversation's audit goes before its turns in the same partition, so turns stream through once more.
    """
    marked = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"),
                          F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = marked.union(faults.where("fault < 4").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        conv, audit, at, tail, state, position = None, "", 0, 0, NOTHING, 0
        for batch in batches:
            out = []
            for now, part, _, role, text in _rows(batch):
                if part == 0:
                    conv, audit, at, tail, state, position = now, text, 0, len(text.rstrip("I")), NOTHING, 0
                    continue
                stop = at
                while audit[stop] == "I":
                    stop += 1
                stop = stop + 1 if stop + 1 < tail else len(audit)  # behind this turn's edit, or all if it is the last
                for edit, made, words in edited(audit[at:stop], [(role, text)], state):
                    out.append((conv, position, edit, made, words))
                    state, position = _STATE[made[0]], position + 1
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                                             names=["conv_id", "position", "edit", "role", "text"])

    return _ordered(rows.repartition("conv_id"), "part").mapInArrow(
        run, "conv_id long, position long, edit string, role string, text string")


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
            ) -> tuple[DataFrame, Column]:
    """Turns with planted faults, by h = crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    takes ``.!?`` out, 3 repeats it, 4 makes it the user's; and the column that tells which rows are there."""
    space = F.lit(" ")
    label = F.concat(F.coalesce(F.col(f"`{conv_id}`").cast("string"), space), F.lit(":"),
                     F.coalesce(F.col(f"`{turn}`").cast("string"), space))
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.coalesce(F.col(f"`{role}`"), space).alias("role"),
                        F.coalesce(F.col(f"`{text}`"), space).alias("text"),
                        (F.crc32(label.cast("binary")) % 20).alias("h"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", ""))
                       .otherwise(F.col("text")).alias("text"), "h",
                       F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows, F.col("h") != 0
