"""Repair of conversation structure: the cheapest edits that make the roles alternate.

A repaired conversation has role initials ``(s?(ua)+)?``. Its rows may be kept, given
another role, or deleted, and empty turns may be inserted; ``COSTS`` says at what price.

Rows are dealt by conversation and sorted by turn, and one task streams them: a
conversation is read once, in order, whatever its length. What the task carries from
one Arrow batch to the next is the state of a dynamic programme over the four places
of the pattern, the backpointers (one number a row) and the texts seen so far; both
of the latter are spilled to an unnamed file of the task in blocks of ``BLOCK`` bytes,
so memory is bounded for a conversation of any size. Copies are found before, by a
window within the same partitioning. A conversation's edits hang on its last turn and
its digest runs over its texts in order, so one conversation is one task's work.

Costs of the four places differ by at most ``SPREAD`` (what is dearer cannot win), so
the programme has finitely many states; each step is one dictionary look-up.

Null roles and texts become one space, which is blank. A null ``turn`` comes before all
others and makes no gap; equal turns stand in the order of role and text. A null
``conv_id`` is a conversation of its own. A role whose first letter is none of s, u, a
can be re-roled or deleted only. Empty tables give empty results. Only the four named
columns are read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: The price of each edit, and what an undeleted truncated row adds.
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
SOUND, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
INITIALS = "sua"
#: Places in the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a. A text may end at 0 and 3.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
WANTED = ("user", "user", "assistant", "user")
#: From any place all that another allows is reached by at most two insertions and one deletion.
SPREAD = 2 * COSTS[INSERT] + COSTS[DELETE]
BLOCK = 8 << 20
WHITE = " \t\n\u000b\f\r"

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string"


class Steps:
    """The dynamic programme as an automaton, filled in as its states turn up.

    A state holds for each place (cost above the least, order of its edits among the
    places' edits); edits of two places are never prefixes of each other, as both end
    with the edit of the last row.
    """

    def __init__(self):
        self.states = [((0, 0), None, None, None)]
        self.numbers = {self.states[0]: 0}
        self.known: dict[int, tuple[int, int, int]] = {}
        self.back: list[tuple] = []

    def step(self, state: int, symbol: int) -> tuple[int, int, int]:
        """The next state, the number of its backpointers, and the least cost added."""
        found = self.known.get(state << 5 | symbol)
        return found if found is not None else self._make(state, symbol)

    def _make(self, state: int, symbol: int) -> tuple[int, int, int]:
        best: list[tuple | None] = [None] * 4
        for place, held in enumerate(self.states[state]):
            if held is None:
                continue
            cost, order = held
            for letters, extra, to in self._edits(place, symbol):
                offer = (cost + extra, order, letters, place)
                if best[to] is None or offer < best[to]:
                    best[to] = offer
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] - least <= SPREAD else None for b in best]
        ranks = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        order = {to: i for i, (_, _, to) in enumerate(ranks)}
        after = tuple((b[0] - least, order[to]) if b else None for to, b in enumerate(best))
        number = self.numbers.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self.back.append(tuple((b[3], b[2]) if b else None for b in best))
        found = self.known[state << 5 | symbol] = (number, len(self.back) - 1, least)
        return found

    @staticmethod
    def _edits(place: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """``(edits, cost, place reached)``: insertions before the row, then the row's own edit."""
        fault, initial = symbol & 7, (*INITIALS, None)[symbol >> 3]
        for count in range(3):
            lead, paid = INSERT * count, COSTS[INSERT] * count
            yield lead + DELETE, paid + COSTS[DELETE], place
            if fault not in (BLANK, DUPLICATE):
                more = paid + (TRUNCATED_COST if fault == TRUNCATED else 0)
                if initial in NEXT[place]:
                    yield lead + KEEP, more + COSTS[KEEP], NEXT[place][initial]
                yield lead + REROLE, more + COSTS[REROLE], NEXT[place][WANTED[place][0]]
            place = NEXT[place][WANTED[place][0]]

    def end(self, state: int) -> tuple[int, str, int]:
        """Cost above the least, the last insertions and the place that the cheapest edits leave."""
        offers = []
        for place, held in enumerate(self.states[state]):
            if held is not None:
                lead, at = "", place
                while at not in ENDS:
                    lead, at = lead + INSERT, NEXT[at][WANTED[at][0]]
                offers.append((held[0] + COSTS[INSERT] * len(lead), held[1], lead, place))
        cost, _, lead, place = min(offers)
        return cost, lead, place


class Blocks:
    """A list that keeps its last block in memory and the others in an unnamed file."""

    def __init__(self):
        self.here: list = []
        self.size, self.file, self.starts = 0, None, []

    def extend(self, items: list, size: int) -> None:
        self.here += items
        self.size += size
        if self.size > BLOCK:
            self.file = self.file or tempfile.TemporaryFile()
            self.starts.append(self.file.tell())
            pickle.dump(self.here, self.file, pickle.HIGHEST_PROTOCOL)
            self.here, self.size = [], 0

    def forward(self) -> Iterator[list]:
        for start in self.starts:
            self.file.seek(start)
            yield pickle.load(self.file)
        yield self.here

    def backward(self) -> Iterator[list]:
        yield self.here
        for start in reversed(self.starts):
            self.file.seek(start)
            yield pickle.load(self.file)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """All that is carried for the conversation being read."""

    def __init__(self, steps: Steps, key: tuple[bool, int]):
        self.steps, self.key = steps, key
        self.faults = np.zeros(5, np.int64)
        self.illegal = self.state = self.cost = 0
        self.last = None
        self.low = self.high = None
        self.turns = 0
        self.back, self.rows = Blocks(), Blocks()

    def read(self, symbols: np.ndarray, turns: np.ndarray, has_turn: np.ndarray, roles: np.ndarray, texts: np.ndarray) -> None:
        """The next rows of the conversation, in order."""
        live = (symbols & 7) != GONE
        if not live.all():
            symbols, turns, has_turn, roles, texts = symbols[live], turns[live], has_turn[live], roles[live], texts[live]
        if not len(symbols):
            return
        self.faults += np.bincount(symbols & 7, minlength=5)
        placed = turns[has_turn]
        if len(placed):
            self.turns += int((np.diff(placed) != 0).sum()) + (self.high is None or self.high != placed[0])
            self.low, self.high = int(placed[0]) if self.low is None else self.low, int(placed[-1])
        back, state, cost, step = [], self.state, self.cost, self.steps.step
        for symbol in symbols.tolist():
            state, number, more = step(state, symbol)
            back.append(number)
            cost += more
        self.state, self.cost = state, cost
        initials = symbols >> 3
        before = np.concatenate([[] if self.last is None else [self.last], initials]).astype(np.int64)
        pairs = before[:-1] * 4 + before[1:]
        self.illegal += int((~np.isin(pairs, LEGAL)).sum())
        self.last = int(initials[-1])
        self.back.extend(back, 4 * len(back))
        rows = list(zip(roles.tolist(), texts.tolist()))
        self.rows.extend(rows, sum(len(t) for _, t in rows) + 100 * len(rows))

    def audit(self) -> tuple[int, str]:
        """The least cost and the edits' initials, by the backpointers from the end."""
        cost, last, place = self.steps.end(self.state)
        parts, back = [last], self.steps.back
        for block in self.back.backward():
            letters = []
            for number in reversed(block):
                place, edits = back[number][place]
                letters.append(edits)
            parts.append("".join(reversed(letters)))
        return self.cost + cost, "".join(reversed(parts))

    def repaired(self, audit: str) -> Iterator[tuple[str, str]]:
        """Roles and texts after the edits."""
        rows = (row for block in self.rows.forward() for row in block)
        place = 0
        for edit in audit:
            role, text = ("", "") if edit == INSERT else next(rows)
            if edit == DELETE:
                continue
            role = role if edit == KEEP else WANTED[place]
            place = NEXT[place][role[0]]
            yield role, text

    def report(self) -> tuple:
        cost, audit = self.audit()
        digest = hashlib.sha256()
        for i, (role, text) in enumerate(self.repaired(audit)):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *map(int, self.faults[[BLANK, DUPLICATE, TRUNCATED]]), self.illegal, cost, audit, digest.hexdigest())


#: Pairs of initials that may be neighbours, as ``first * 4 + second``.
LEGAL = np.array([INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")])


def _code(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    code = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        code = F.when(first == letter, i).otherwise(code)
    return code


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows with the number of their fault and initial, a conversation in one partition and in order."""
    dealt = rows.repartition("conv_id")
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = (
        F.when(F.col("gone"), GONE).when(F.length(trimmed) == 0, BLANK).when(F.col("_copy") > 1, DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    named = dealt.withColumn("_copy", copy).select(
        "_copy",
        F.col("conv_id").isNotNull().alias("has_id"), F.coalesce("conv_id", F.lit(0)).alias("id"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        (F.shiftleft(_code(F.col("role")), 3) + fault).cast("int").alias("symbol"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return named.sortWithinPartitions("has_id", "id", "has_turn", "turn", "role", "text", "_copy").drop("_copy")


def _streamed(rows: DataFrame, schema: str, results) -> DataFrame:
    """``results(conversation)`` gives the result rows, without the id, of each conversation."""
    names = [c.split()[0] for c in schema.split(", ")]

    def frame(done: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([r[1:] for r in done], columns=names)
        out["conv_id"] = pd.array([r[1] if r[0] else None for r in done], dtype="Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, talk, done = Steps(), None, []
        for batch in batches:
            has, ids = batch["has_id"].to_numpy(bool), batch["id"].to_numpy(np.int64)
            columns = [batch[c].to_numpy() for c in ("symbol", "turn", "has_turn", "role", "text")]
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(has.view(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)] if len(ids) else []):
                key = (bool(has[a]), int(ids[a]))
                if talk is None or talk.key != key:
                    if talk is not None:
                        yield from finish(talk, done)
                    talk = Conversation(steps, key)
                talk.read(*[c[a:b] for c in columns])
        if talk is not None:
            yield from finish(talk, done)
        if done:
            yield frame(done)

    def finish(talk: Conversation, done: list[tuple]) -> Iterator[pd.DataFrame]:
        for row in results(talk):
            done.append((*talk.key, *row))
            if len(done) >= 2000:
                yield frame(done)
                done.clear()
        talk.back.close()
        talk.rows.close()

    return _sorted(rows).mapInPandas(run, schema)


def ready(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` of plain rows: nulls become one space, no row is gone."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("gone"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``ready`` rows with repeatable faults, by the CRC of ``conv_id:turn``.

    Of twenty remainders 0 marks the row as gone, 1 empties its text, 2 takes ``.!?``
    out of it, 3 repeats the row, 4 makes it the user's.
    """
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.col("_fault")
    marked = ready(rows).withColumn("_fault", F.crc32(place) % 20)
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = marked.select(
        "conv_id", "turn", F.when(fault != 0, F.when(fault == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(fault != 0, text).alias("text"),
        (fault == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_copy"),
    )
    return hurt.drop("_copy")


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``ready`` or ``damaged`` rows: gaps, faults, cost, edits and digest of the repaired turns."""
    return _streamed(rows, REPORT, lambda talk: [talk.report()])


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns of the repaired conversations."""
    return _streamed(rows, TURNS, lambda talk: ((i, *turn) for i, turn in enumerate(talk.repaired(talk.audit()[1]))))
