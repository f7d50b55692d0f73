"""Small document tables with everything odd that they may have."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = ["the", "of", "and", "river", "stone", "light", "over", "under", "winter", "garden", "letter", "market", "silver", "window", "bridge", "morning"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows(texts: list, start: int = 0) -> list[tuple]:
    return [(start + i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]


def table(spark, texts: list, partitions: int = 3):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(partitions)


ODD = [None, "", " ", "\n\n", "a", "A b", "é ñ 日本 😀", "x" * 30_000, "tab\tand\x0bfeed", "  lead and trail  ", "\x00nul", "'s 't 're", " nbsp　wide"]
