"""Column names that don't get into each other's way."""

from __future__ import annotations

from collections.abc import Sequence


def others(columns: Sequence[str], *names: str) -> list[str]:
    """The columns that keep their place beside new ones: a column that bears a new one's name is replaced."""
    new = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in new]


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, made longer until no column bears it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
