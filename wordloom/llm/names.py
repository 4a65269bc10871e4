"""Names for helper columns that a caller's table does not use."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """One name per stem that no column has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
