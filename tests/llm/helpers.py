"""Small tables with everything that is awkward in them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names could clash with ones that operators make.
CLASHING = "th string, key string, cid long, row string, level string, hits string, n long, __id long, __row string, id string, _id long, g1 string, __g1 string, __words long, __size long, __taken long, __th long, words string, size string"


def documents(spark: SparkSession, rows: list[tuple], clashing: bool = False) -> DataFrame:
    """rows of doc_id, text and maybe source; with clashing, columns of awkward names and nulls."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    if not clashing:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, "x", None, 1, None, "y", "z", 7, None, "w", "v", 3, None, "u", 5, None, 2, 9, "t", "s") for r in full], f"{SCHEMA}, {CLASHING}")


def awkward() -> list[tuple]:
    """Nulls, blanks, ties, repeated rows, control characters, a very long text, one without blanks."""
    long = " ".join(f"w{k % 977}" for k in range(20_000))
    return [
        (1, "one two three four five six", "a"),
        (1, "one two three four five six", "a"),
        (2, None, "b"),
        (3, "", "b"),
        (None, "nobody owns this text at all", None),
        (None, None, None),
        (4, " \t\n\x0b\f\r ", "c"),
        (5, "x" * 30_000, "c"),
        (6, long, "a"),
        (7, "ÄÖÜ straße É 日本語 \U0001f600 ½", "b"),
        (8, "line\r\nline\n\nline", "b"),
        (9, "one two three four five six", None),
    ]


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def edited(r: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        k = r.randrange(len(w))
        match r.randrange(3):
            case 0:
                w[k] = f"new{r.randrange(10**6)}"
            case 1 if len(w) > 1:
                del w[k]
            case _:
                w.insert(k, r.choice(WORDS))
    return " ".join(w)
