"""Repair of conversations: the cheapest edits that give roles in turn, with an audit of them.

A repaired conversation is empty or an optional system turn and then user and assistant turns in pairs. Turns
are aligned to each feasible length of that alternating string by Wagner and Fischer's table, limited to
Ukkonen's band that the cheapest alignment so far leaves; of equally cheap alignments the least audit
string wins. Conversations are dealt by id and sorted by turn; a task reads them as a stream. A long
conversation is aligned SEGMENT turns at a time, from each state of the grammar to each other, and only the
best way to each state is kept, so memory holds a segment and the audits, never the texts. (Of two ways to one
state with the same cost neither audit starts with the other, as each letter has its own cost, so the least
audit of the whole consists of least audits.) The digest of a repaired conversation and its audit are one
row by nature, so one conversation is not split over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
UNFINISHED = 3  # an undeleted truncated turn

SEGMENT = 16
DAMAGE_KINDS = 20

_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_ROLES = {"u": "user", "a": "assistant"}

# What has been put out so far: nothing, a system turn only, last a user turn, last an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}

REPORT = (
    "conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _offset_cost(d: int) -> int:
    return INSERT * d if d > 0 else -DELETE * d


def _aligned(turns: str, target: str, limit: int) -> tuple[int, str] | None:
    """Cost and least audit of turning ``turns`` into ``target`` for at most ``limit``.

    ``turns``: one letter a turn, its role's initial or x, a capital for a truncated one, - for one that
    has to go.
    """
    n, m = len(turns), len(target)
    band = [d for d in range(-n, m + 1) if _offset_cost(d) + _offset_cost(m - n - d) <= limit]
    if not band:
        return None
    low, high = band[0], band[-1]
    never = limit + 1
    # rest[i][j - i - low]: cost from turn i and target j to the end; outside of the band it is too much.
    rest = [[never] * (high - low + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        here, below = rest[i], rest[i + 1]
        turn = turns[i] if i < n else "-"
        initial, extra = turn.lower(), UNFINISHED if turn.isupper() else 0
        for k in range(min(high, m - i) - low, max(low, -i) - low - 1, -1):
            j = i + k + low
            best = 0 if i == n and j == m else never
            if i < n and k:
                best = min(best, below[k - 1] + DELETE)
            if j < m and target[j] != "s":
                best = min(best, here[k + 1] + INSERT)
            if i < n and j < m and turn != "-":
                if initial == target[j]:
                    best = min(best, below[k] + KEEP + extra)
                elif target[j] != "s":
                    best = min(best, below[k] + REROLE + extra)
            here[k] = best
    if not low <= 0 <= high or rest[0][-low] > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:  # the least letter that stays on a cheapest way
        k = j - i - low
        now, turn = rest[i][k], turns[i] if i < n else "-"
        if i < n and k and rest[i + 1][k - 1] + DELETE == now:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and rest[i][k + 1] + INSERT == now:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turn.lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return rest[0][-low], "".join(audit)


def _targets(start: int, end: int, length: int, system: bool) -> Iterator[str]:
    """The grammar's strings of a length that lead from one state to another."""
    for head in ("", "s") if start == _START and system else ("",):
        size = length - len(head)
        if size < 0:
            continue
        body = "".join("au"[(k + (start != _USER)) % 2] for k in range(size))
        state = _AFTER[(head + body)[-1]] if head + body else start
        if state == end:
            yield head + body


def _at_most(turns: str, start: int, end: int) -> int:
    """The cost of keeping or rerolling every turn that may stay, then one insertion if the end needs it."""
    cost, state = 0, start
    for turn in turns:
        if turn == "-":
            cost += DELETE
            continue
        want = "a" if state == _USER else "u"
        if not (state == _START and turn in "sS"):
            cost += 0 if turn.lower() == want else REROLE
            state = _AFTER[want]
        else:
            state = _SYSTEM
        cost += UNFINISHED if turn.isupper() else 0
    if state != end:
        steps = (2, 1)[state == _USER] if end == _ASSISTANT else (1, 2)[state == _USER]
        cost += INSERT * steps
    return cost


@lru_cache(1 << 15)
def cheapest(turns: str, start: int, end: int) -> tuple[int, str] | None:
    """The cheapest edits, ties by the audit, that lead from one state to another; None if there are none."""
    if end in (_START, _SYSTEM) and start != end and (start, end) != (_START, _SYSTEM):
        return None
    stay = len(turns) - turns.count("-")
    must, system = DELETE * turns.count("-"), "s" in turns.lower()
    best = None
    limit = DELETE * len(turns) if start == end else _at_most(turns, start, end)
    if end == _SYSTEM and start == _START:
        limit = DELETE * len(turns)
    lengths = sorted(range(len(turns) + limit // INSERT + 1), key=lambda m: _offset_cost(m - stay))
    for length in lengths:
        if must + _offset_cost(length - stay) > limit:
            break
        for target in _targets(start, end, length, system):
            found = _aligned(turns, target, limit)
            if found and (best is None or found < best):
                best, limit = found, found[0]
    return best


class _Way:
    """The best way to a state: its cost, its audit in pieces, the digest of what it puts out."""

    __slots__ = ("cost", "piece", "before", "digest", "lines")

    def __init__(self, cost, piece, before, digest, lines):
        self.cost, self.piece, self.before, self.digest, self.lines = cost, piece, before, digest, lines

    def audit(self) -> str:
        pieces, at = [], self
        while at is not None:
            pieces.append(at.piece)
            at = at.before
        return "".join(reversed(pieces))


def _first(a: tuple, b: tuple) -> bool:
    """Whether candidate a (cost, piece, way before) goes before b: cheaper, or the lesser audit."""
    if a[0] != b[0]:
        return a[0] < b[0]
    mine, others, x, y = [a[1]], [b[1]], a[2], b[2]
    while x is not y:  # all ways have as many pieces; they part at the last one they share
        mine.append(x.piece)
        others.append(y.piece)
        x, y = x.before, y.before
    return "".join(reversed(mine)) < "".join(reversed(others))


def edited(turns: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, edit, number of the turn or -1) of what an audit leaves of (role, text) turns."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text, source = "", "", -1
        if edit != "I":
            (role, text), source = turns[at], at
            at += 1
        if edit == "K":
            state = _AFTER[role[0]]
        else:
            want = "a" if state == _USER else "u"
            role, state = _ROLES[want], _AFTER[want]
        yield role, text, edit, source


class _Conversation:
    """Counts and ways of one conversation, fed turn by turn."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.distinct = 0
        self.initial = None
        self.signs: list[str] = []
        self.turns: list[tuple[str, str]] = []
        self.ways = {_START: _Way(0, "", None, hashlib.sha256(), 0)}

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if len(self.turns) == SEGMENT:
            self._close(range(4))
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        body = text.rstrip(_SPACE)
        sign = initial if initial in ("s", "u", "a") else "x"
        if not body:
            self.blank, sign = self.blank + 1, "-"
        elif repeated:
            self.duplicate, sign = self.duplicate + 1, "-"
        elif body[-1] not in ".!?":
            self.truncated, sign = self.truncated + 1, sign.upper()
        self.signs.append(sign)
        self.turns.append((role, text))

    def _close(self, ends) -> None:
        signs, best = "".join(self.signs), {}
        for start, way in self.ways.items():
            for end in ends:
                found = cheapest(signs, start, end)
                if found:
                    candidate = (way.cost + found[0], found[1], way, start)
                    if end not in best or _first(candidate, best[end]):
                        best[end] = candidate
        done, self.ways = self.ways, {end: self._extended(*found) for end, found in best.items()}
        for way in done.values():
            way.digest = None
        self.signs, self.turns = [], []

    def _extended(self, cost: int, piece: str, before: _Way, start: int) -> _Way:
        digest, lines = before.digest.copy(), before.lines
        for role, text, _, _ in edited(self.turns, piece, start):
            digest.update(("\n" * (lines > 0) + role + ":" + text).encode())
            lines += 1
        return _Way(cost, piece, before, digest, lines)

    def report(self) -> tuple:
        self._close((_START, _ASSISTANT))
        way = None
        for other in self.ways.values():
            candidate = (other.cost, other.piece, other.before)
            if way is None or _first(candidate, (way.cost, way.piece, way.before)):
                way = other
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv_id, gaps, *counts, way.cost, way.audit(), way.digest.hexdigest())


_MARK, _TURN = 0, 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _audit(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, marks, at, out = None, {}, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role", "text", "digest", "later"))
            for conv_id, turn, kind, role, text, digest, later in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.report())
                    now, marks, at = _Conversation(conv_id), {}, None
                if turn != at:
                    marks, at = {}, turn
                if kind == _MARK:
                    if digest is not None:
                        marks[role, digest] = later
                    continue
                repeated = False
                if marks:
                    key = role, hashlib.sha256(text.encode()).digest()
                    repeated = marks.get(key, False)
                    if key in marks:
                        marks[key] = True
                now.add(turn, role, text, repeated)
            if out:
                yield _batch(out, schema)
                out = []
        if now is not None:
            yield _batch([now.report()], schema)

    return rows


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: conversations with faults put in, by a hash of id and turn.

    Of DAMAGE_KINDS hash values 0 drops a turn (``present`` is false then), 1 empties its text, 2 removes its full
    stops, exclamation and question marks, 3 repeats it and 4 makes it a user's. NULL counts as one space,
    also in the hash; the id and the turn themselves stay NULL.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(DAMAGE_KINDS))
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))).alias("present"),
    )


def _filled(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        F.coalesce(present, F.lit(True)).alias("present"),
    )


def _repeats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, later: turns whose role and text come more than once in a conversation.

    ``later``: whether an earlier turn has them. Digests are counted before they meet, so a text that
    fills a conversation is one row per turn; the texts are not shuffled for this.
    """
    digest = F.unhex(F.sha2("text", 256))
    alike = turns.select("conv_id", "turn", "role", digest.alias("digest")).groupBy(
        "conv_id", "turn", "role", "digest"
    ).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # NULL first
    keys = alike.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.sum("n").alias("total"))
    keys = keys.where("total > 1").select(
        F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"),
        F.col("first.turn").alias("first_turn"),
    )
    met = alike.join(
        keys,
        F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest")),
    )
    later = ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return met.select("conv_id", "turn", "role", "digest", later.alias("later"))


def audit_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): faults, cheapest edits and their result.

    ``gaps``: turn numbers that lack between the first and the last. Each turn's first fault counts: ``blank``
    (nothing but white space), ``duplicate`` (role and text of an earlier turn), ``truncated`` (no full stop,
    exclamation or question mark at the end). ``illegal``: neighbours whose roles do not follow each
    other. ``audit``: K (keep), R (rerole), D (delete), I (insert) in order, for ``cost`` together; blank and
    duplicate turns have to go. ``repaired_sha256``: of ``role:text`` lines (see ``repaired_turns``).

    Turns go by number, NULL first, ties by role and text; a NULL role or text is one space, a NULL id a
    conversation of its own, repeated rows are duplicates. Rows whose column ``present``, if there is one, is
    false only name their conversation; without other rows it has zeros, an empty audit and the digest of
    nothing. Other columns are ignored; an empty table gives an empty one.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    rows = _filled(turns)
    there = rows.where("present")
    nothing = F.lit(None).cast("string")
    no_digest, no_mark = F.lit(None).cast("binary"), F.lit(None).cast("boolean")
    stream = there.select("conv_id", "turn", F.lit(_TURN).alias("kind"), "role", "text", no_digest.alias("digest"), no_mark.alias("later"))
    stream = stream.unionByName(
        _repeats(there).select("conv_id", "turn", F.lit(_MARK).alias("kind"), "role", nothing.alias("text"), "digest", "later")
    ).unionByName(
        rows.where("not present").select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(_MARK).alias("kind"), nothing.alias("role"),
            nothing.alias("text"), no_digest.alias("digest"), no_mark.alias("later"),
        )
    )
    report = REPORT.format(id_type=id_type)
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "kind", "role", "text")
    return dealt.mapInArrow(_audit(to_arrow_schema(StructType.fromDDL(report))), report)


def _edit(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, conv, audit, at, state, place, out = False, None, "", 0, _START, 0, []

        def put(edits: str, turn, role: str, text: str) -> None:
            nonlocal state, place
            for role_now, text_now, edit, source in edited([(role, text)], edits, state):
                out.append((conv, place, None if source < 0 else turn, role_now, text_now, edit))
                place, state = place + 1, _AFTER[role_now[0]]

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text"))
            for conv_id, kind, turn, role, text in zip(*columns, strict=True):
                if kind == _MARK:
                    if known:
                        put(audit[at:], None, "", "")
                    known, conv, audit, at, state, place = True, conv_id, text, 0, _START, 0
                    continue
                start = at
                while audit[at] == "I":
                    at += 1
                at += 1
                put(audit[start:at], turn, role, text)
            if out:
                yield _batch(out, schema)
                out.clear()
        if known:
            put(audit[at:], None, "", "")
        if out:
            yield _batch(out, schema)

    return rows


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, place, turn, role, text, edit: the turns that the audits of ``report`` leave of ``turns``.

    ``report`` is what ``audit_conversations`` gave for the same turns; inserted ones have no turn and an empty
    text. Read as a stream; a task holds one audit at a time.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {id_type}, place long, turn long, role string, text string, edit string"
    stream = _filled(turns).where("present").select("conv_id", F.lit(_TURN).alias("kind"), "turn", "role", "text")
    stream = stream.unionByName(
        report.select(
            "conv_id", F.lit(_MARK).alias("kind"), F.lit(None).cast("long").alias("turn"),
            F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"),
        )
    )
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return dealt.mapInArrow(_edit(to_arrow_schema(StructType.fromDDL(ddl))), ddl)
