"""Column names that a table doesn't use yet."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to be none of the taken ones, in any case."""
    known, found = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        found.append(name)
    return found
