"""Patterns written in Python's dialect, run by Spark's Java regex engine.

The two engines agree on most syntax. They differ in that Java's ``\\w \\d \\s \\b`` are
ASCII-only, its ``.``, ``^`` and ``$`` honour more line terminators than ``\\n``, a bracket inside a
character class nests, named groups are spelt differently, and replacements use ``$1``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# The reader of patterns that the standard library itself uses.
_parser = re._parser

SYNTAX = r"[\\^$.|?*+()\[\]{}]"

_UNICODE_CLASS = re.compile(r"\\[wWdDsSbB]")
_LINE_END = re.compile(r"[.^$]")

# Group references, named groups and inline flags mean something else inside a joined pattern.
_REFERS_OR_FLAGS = re.compile(r"\\[1-9]|\(\?P|\(\?[aiLmsux]")

_NAMED_GROUP = re.compile(r"\(\?P<(\w+)>")
_NAMED_BACKREF = re.compile(r"\(\?P=(\w+)\)")
_CLASS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL)
_REPL_TOKEN = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|(\$)", re.DOTALL)
_REPL_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}


def _fix_class(match: re.Match) -> str:
    """Escape what Java would read as nesting or intersection inside a character class."""
    body = match.group(0)
    if not body.startswith("["):
        return r"\z" if body == r"\Z" else body
    head = 2 if body.startswith("[^") else 1
    inner = re.sub(r"(?<!\\)\[", r"\\[", body[head:-1]).replace("&&", r"&\&")
    return body[:head] + re.sub(r"^\]", r"\\]", inner) + "]"


def _translated(pattern: str) -> tuple[str, str]:
    """Flags and Java form. U: Unicode character classes. d: only \\n ends a line."""
    flags = "U" * bool(_UNICODE_CLASS.search(pattern)) + "d" * bool(_LINE_END.search(pattern))
    out = _NAMED_GROUP.sub(r"(?<\1>", pattern)
    out = _NAMED_BACKREF.sub(r"\\k<\1>", out)
    return flags, _CLASS.sub(_fix_class, out)


def java_pattern(pattern: str) -> str:
    """Translate a Python pattern."""
    flags, body = _translated(pattern)
    return f"(?{flags}){body}" if flags else body


def java_replacement(replacement: str) -> str:
    """Translate a Python replacement template (``\\1`` and ``\\g<name>``)."""

    def swap(m: re.Match) -> str:
        group, number, escaped, dollar = m.groups()
        if dollar:
            return r"\$"
        if number:
            return f"${int(number)}"
        if group:
            return f"${group}" if group.isdigit() else f"${{{group}}}"
        return _REPL_ESCAPES.get(escaped, escaped)

    return _REPL_TOKEN.sub(swap, replacement)


def contains(col: Column, pattern: str) -> Column:
    """True where the pattern matches anywhere."""
    return col.rlike(java_pattern(pattern))


def contains_any(col: Column, patterns: Sequence[str]) -> Column:
    """True where any pattern matches anywhere, in one pass where the patterns can be joined."""
    if not patterns:
        return F.lit(False)
    if any(_REFERS_OR_FLAGS.search(p) for p in patterns):
        return reduce(or_, [contains(col, p) for p in patterns])
    joined = ("(?{}:{})".format(*_translated(p)) for p in patterns)
    return col.rlike("|".join(joined))


def matches_start(col: Column, pattern: str) -> Column:
    """True where the pattern matches at the first character."""
    return col.rlike(java_pattern(f"^(?:{pattern})"))


def replace_all(col: Column, pattern: str, replacement: str) -> Column:
    """Replace every match."""
    return F.regexp_replace(col, F.lit(java_pattern(pattern)), F.lit(java_replacement(replacement)))


def replace_each(col: Column, replacements: dict[str, str]) -> Column:
    """Apply an ordered mapping pattern -> replacement."""
    for pattern, replacement in replacements.items():
        col = replace_all(col, pattern, replacement)
    return col


def is_literal(pattern: str) -> bool:
    """True when a pattern holds no regex syntax, so a plain string comparison does."""
    return re.search(SYNTAX, pattern) is None


def required_literals(pattern: str) -> list[str]:
    """Strings that everything the pattern matches holds; none where nothing is certain.

    Runs of plain characters, also inside groups and repeats that occur at least once. A pattern that
    ignores case, or cannot be read, has none.
    """
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return []
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    found: list[str] = []
    return [f for f in dict.fromkeys(found) if f] if _collect(parsed, found) else []


def anchors(pattern: str, at_start: bool = False) -> tuple[str, str]:
    """The plain characters that everything the pattern matches starts with and ends with, where it is bound to the
    start (``^``, or ``at_start``) or the end (``$``) of the word; empty where it is not."""
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return "", ""
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE | re.MULTILINE):
        return "", ""
    parts, start, end = list(parsed), "", ""
    if parts and parts[0] in [(_parser.AT, _parser.AT_BEGINNING), (_parser.AT, _parser.AT_BEGINNING_STRING)]:
        at_start, parts = True, parts[1:]
    if at_start:
        for kind, value in parts:
            if kind is not _parser.LITERAL:
                break
            start += chr(value)
    if parts and parts[-1] in [(_parser.AT, _parser.AT_END), (_parser.AT, _parser.AT_END_STRING)]:
        for kind, value in reversed(parts[:-1]):
            if kind is not _parser.LITERAL:
                break
            end = chr(value) + end
    return start, end


def _collect(parts, found: list[str]) -> bool:
    """Gather the literals of a sequence; False when a part ignores case."""
    run = ""
    for kind, value in parts:
        if kind is _parser.LITERAL:
            run += chr(value)
            continue
        if kind is _parser.AT:  # takes no characters
            continue
        found.append(run)
        run = ""
        inner = None
        if kind is _parser.SUBPATTERN:
            if value[1] & re.IGNORECASE:
                return False
            inner = value[3]
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = value[2]
        elif kind is _parser.ATOMIC_GROUP:
            inner = value
        if inner is not None and not _collect(inner, found):
            return False
    found.append(run)
    return True
