"""Column names that are told apart."""

from __future__ import annotations

from collections.abc import Sequence


def distinct_names(names: Sequence[str]) -> list[str]:
    """The names in their order; one that is taken, in any case of its letters, gets _2, _3, ... past all that are taken."""
    found: list[str] = []
    taken: set[str] = set()
    for name in names:
        free, n = name, 1
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        found.append(free)
    return found
