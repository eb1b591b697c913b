"""Repaired conversations against a plain search over all edits."""

import functools
import hashlib
import re
import zlib

import pytest

from agropanel.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, extra int, gone boolean, symbol string"
PATTERN = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def brute_repair(rows):
    """From ``(turn, role, text)``: the report, by cost to go from the end and the least letter at every step."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def options(i, last):
        for r in ("user", "assistant"):
            if r[0] in follows[last]:
                yield 3, "I", i, r[0], (r, "")
        if i < len(rows):
            more = 3 if faults[i] == "truncated" else 0
            yield 4, "D", i + 1, last, None
            if faults[i] in ("", "truncated"):
                if rows[i][1][:1] and rows[i][1][0] in follows[last]:
                    yield more, "K", i + 1, rows[i][1][0], rows[i][1:]
                for r in ("user", "assistant"):
                    if r[0] in follows[last]:
                        yield 3 + more, "R", i + 1, r[0], (r, rows[i][2])

    @functools.lru_cache(None)
    def least(i, last, inserts):
        if i == len(rows) and last in ("", "a"):
            return 0
        return min((c + least(j, to, inserts - (e == "I") if j == i else 3) for c, e, j, to, _ in options(i, last) if e != "I" or inserts), default=10**9)

    for at in range(len(rows), 0, -100):  # from the end, so that no call nests deeply
        for place in follows:
            least(at, place, 3)

    audit, turns, i, last, cost = "", [], 0, "", least(0, "", 3)
    left, inserts = cost, 3
    while not (i == len(rows) and last in ("", "a") and left == 0):
        c, e, j, to, turn = min((o for o in options(i, last) if (o[1] != "I" or inserts) and o[0] + least(o[2], o[3], inserts - 1 if o[2] == i else 3) == left), key=lambda o: o[1])
        inserts = inserts - 1 if j == i else 3
        audit, left, i, last = audit + e, left - c, j, to
        turns += [tuple(turn)] if turn else []
    assert PATTERN.fullmatch("".join(r[0] for r, _ in turns))
    placed = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(placed) - min(placed) + 1 - len(set(placed)) if placed else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    ), turns


def brute(rows, damage=True):
    talks = {r[0]: [] for r in rows}
    for conv, *row in brute_damage(rows) if damage else rows:
        talks[conv].append(row)
    return {c: brute_repair(t) for c, t in talks.items()}


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def made(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(1, longest))):
            role = str(rng.choice(["user", "assistant", "system", "tool", "", "u"], p=[0.35, 0.35, 0.15, 0.05, 0.05, 0.05]))
            rows.append((c, t if rng.random() > 0.1 else int(rng.integers(0, 5)), role, str(rng.choice(["One.", "Two!", "three", " ", "", "Four? \n", "é.", ". x"]))))
    return rows


@pytest.mark.parametrize("block", [conversations.BLOCK, 300])  # with 300 bytes every conversation spills
def test_repairs_are_the_cheapest_and_least(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = made(np.random.default_rng(11), 400, 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    want = brute(rows)
    got = conversations.report(conversations.damaged(df))
    assert got.columns[0] == "conv_id" and found(got) == {c: r for c, (r, _) in want.items()}
    want = brute([tuple(" " if v is None else v for v in r) for r in rows], damage=False)
    assert found(conversations.report(conversations.ready(df))) == {c: r for c, (r, _) in want.items()}
    turns = {}
    for r in sorted(conversations.repaired(conversations.ready(df)).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: t for c, (_, t) in want.items() if t}


def test_one_conversation_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 2000)
    rows = [(1, t, ("user", "assistant", "user", "tool")[t % 4 if t % 9 else 2], f"text {t % 700}{'.' if t % 5 else ''}") for t in range(3000)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "170")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
        got = found(conversations.report(conversations.ready(df)))[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_repair([r[1:] for r in rows])[0]


def test_odd_conversations(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hi."), (5, None, "user", "A."), (5, None, "user", "A."), (5, 2, None, "x."), (6, 1, "user", None),
        (7, 1, "assistant", "Long " * 200_000 + "."), (7, 1, "assistant", "Long " * 200_000 + "."), (2**60 + 1, 2**55, "system", "S."), (2**60, 9, "user", "Q?"),
    ]
    rows += [(8, t, "user", "gone.") for t in range(400) if zlib.crc32(f"8:{t}".encode()) % 20 == 0][:2]  # nothing of it is left
    df = spark.createDataFrame([(*r, 1, True, "z") for r in rows], SCHEMA)
    got = found(conversations.report(conversations.damaged(df)))
    assert got == {c: r for c, (r, _) in brute(rows).items()}
    assert got[8] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = df.where("false")
    assert conversations.report(conversations.damaged(empty)).count() == 0 and conversations.repaired(conversations.ready(empty)).count() == 0


def test_the_automaton_is_finite():
    steps = conversations.Steps()
    at = 0
    while at < len(steps.states):
        for initial in range(4):
            for fault in (conversations.SOUND, conversations.BLANK, conversations.DUPLICATE, conversations.TRUNCATED):
                steps.step(at, initial << 3 | fault)
        at += 1
        assert at < 5000
