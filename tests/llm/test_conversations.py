"""Conversation repair against a brute-force search over all edits."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wordloom.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out, ids = [], set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return ids, out


def plain_edits(signs, roles):
    """(cost, audit, lines): least over all ways, turn by turn, two insertions at most between turns."""
    def inserted(ways):
        for state, (cost, audit, lines) in list(ways.items()):
            for _ in range(2):
                name, state = ("assistant", 3) if state == 2 else ("user", 2)
                cost, audit, lines = cost + 3, audit + "I", (*lines, name + ":")
                if state not in ways or (cost, audit) < ways[state][:2]:
                    ways[state] = cost, audit, lines
        return ways

    ways = {0: (0, "", ())}
    for sign, (role, text) in zip(signs, roles, strict=True):
        following = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            extra = 3 if sign == "truncated" else 0
            name, after = ("assistant", 3) if state == 2 else ("user", 2)
            options = [(state, cost + 4, audit + "D", lines)]
            if sign not in ("blank", "duplicate"):
                options.append((after, cost + 3 + extra, audit + "R", (*lines, f"{name}:{text}")))
                if role[:1] == name[0] or role[:1] == "s" and state == 0:
                    now = 1 if role[:1] == "s" else after
                    options.append((now, cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for now, *way in options:
                if now not in following or tuple(way[:2]) < following[now][:2]:
                    following[now] = tuple(way)
        ways = following
    return min(way for state, way in inserted(ways).items() if state in (0, 3))


def plain_report(ids, rows):
    out = set()
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, signs = set(), []
        for _, role, text in own:
            body = text.rstrip(SPACE)
            signs.append(
                "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            )
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = plain_edits(signs, [r[1:] for r in own])
        faults = [signs.count(f) for f in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def some_turns(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        role = "user"
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.1:
                continue
            role = rng.choice([role, "user", "assistant", "assistant", "system", "tool", "Sys", "ux", None])
            text = rng.choice(["Hello.", "Hello", "so?", "a!", None, "", " \t\n", "é.", " ", ".", f"text {turn}."])
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
            role = "assistant" if role == "user" else "user"
    return rows


@pytest.mark.parametrize("segment", [1, 3, 16])
def test_aligned_in_segments(segment, monkeypatch):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    for seed in range(3):
        ids, rows = plain_damage(some_turns(seed, 60, 9))
        got = set()
        for conv in ids:
            state, seen = cv._Conversation(conv), set()
            own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
            for turn, role, text in own:
                state.add(turn, role, text, (role, text) in seen)
                seen.add((role, text))
            got.add(state.report())
        assert got == plain_report(ids, rows)


def test_whole_query(spark):
    rows = some_turns(9, 120, 12)
    rows += [(None, t, r, x) for _, t, r, x in some_turns(4, 3, 8)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("kind", "digest", "later", "of_conv", "first")})
    ids, kept = plain_damage(rows)
    damaged = cv.damaged(df)
    report = cv.audit_conversations(damaged).cache()
    assert {tuple(r) for r in report.collect()} == plain_report(ids, kept)

    lines = {}
    for r in sorted(cv.repaired_turns(damaged, report).collect(), key=lambda r: r["place"]):
        assert (r["edit"] == "I") <= (r["turn"] is None and r["text"] == "")
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in report.collect():
        assert hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_nothing_left(spark):
    """A conversation all of whose turns are dropped is still reported."""
    gone = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    conv, turn = gone[0]
    df = spark.createDataFrame([(conv, turn, "user", "Hi.")], SCHEMA)
    got = [tuple(r) for r in cv.audit_conversations(cv.damaged(df)).collect()]
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation(spark):
    """Thousands of turns, a text that most of them repeat, and a very long text."""
    rng = random.Random(2)
    rows = []
    for turn in range(3000):
        text = rng.choice(["Same again.", f"Turn {turn}.", f"Turn {turn}", ""])
        rows.append((7, turn * 2, rng.choice(["user", "assistant", "assistant", "system"]), text))
    rows.append((8, 0, "user", "x" * 3_000_000 + "."))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in cv.audit_conversations(df).collect()}
    assert got == plain_report({7, 8}, rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    report = cv.audit_conversations(cv.damaged(df))
    assert report.collect() == []
    assert cv.repaired_turns(df, report).collect() == []


@pytest.mark.parametrize(
    "turns, expected",
    [
        ("", (0, "")),
        ("u", (3, "KI")),
        ("a", (3, "IK")),
        ("s", (4, "D")),
        ("ua-", (4, "KKD")),
        ("uua", (3, "KIKK")),
        ("sua", (0, "KKK")),
        ("usa", (4, "KDK")),
        ("Ua", (3, "KK")),
        ("x", (4, "D")),
    ],
)
def test_cheapest(turns, expected):
    found = [f for f in (cv.cheapest(turns, 0, 0), cv.cheapest(turns, 0, 3)) if f]
    assert min(found) == expected
