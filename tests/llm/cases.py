"""Small tables with everything that may trip an operator."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, keep_id string, _key long, `group_size` double"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioustrnlmd") for _ in range(rng.randint(2, 9))) for _ in range(n))


def nasty_rows(seed: int = 0) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, near and case copies."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    near = [t + " tail" for t in texts[:8]]
    case = [t.upper() for t in texts[8:16]]
    every = [*texts, *near, *case, texts[0], texts[0], None, None, "", "", "  \n\t", "a", "a b", "É é ß", prose(rng, 30000), "x" * 50000]
    rows = [(i, t, None, None, None) for i, t in enumerate(every)]
    rows += [(None, texts[0], "k", 1, 2.0), (None, None, None, None, None), (3, texts[3], None, None, None), (3, texts[3], None, None, None), (3, "other text of the same id", None, None, None)]
    rows += [(1000 + i, "Hot  text of many rows", None, None, None) for i in range(300)]
    return rows
