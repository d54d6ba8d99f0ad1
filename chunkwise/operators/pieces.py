"""Results cut into pieces, so that a task's Python holds little besides the batch it was sent.

Spark sends up to 10,000 rows or 64 MB at a time. What they become may be many times as
large, so it is handed on piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

V = TypeVar("V")

#: Bytes of results after which a task hands them on.
PIECE = 4 << 20


def cut(values: Iterable[V], size: Callable[[V], int]) -> Iterator[list[V]]:
    """Consecutive values in lists of some ``PIECE`` bytes each."""
    held, total = [], 0
    for v in values:
        held.append(v)
        total += size(v)
        if total >= PIECE:
            yield held
            held, total = [], 0
    if held:
        yield held
