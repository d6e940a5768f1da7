"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(words: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 8))) for _ in range(words))


LONG = prose(30_000, 1)
ROWS = [
    (1, prose(120, 2), "en", "s0", 5),
    (2, prose(120, 2), "en", "s0", 5),
    (2, prose(120, 2), "en", "s0", 5),
    (3, None, "de", "s1", None),
    (4, "", None, "s1", 0),
    (5, " \n\t ", "de", None, 4),
    (None, prose(120, 2), "fr", "s2", 7),
    (None, "no id here, call +1 (555) 010-9999", None, None, None),
    (6, LONG, "fr", "s2", len(LONG)),
    (7, LONG, "fr", "s2", len(LONG)),
    (8, "ÀÉÎ ẞß Œuvre 你好 🙂 <|endoftext|> I'll", "fr", "s2", 9),
    (9, "one", "en", "s0", 3),
    (10, "1234 5678 !!", "en", "s0", 12),
]


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = "kept sha copy_no label region u s n size place bits rank part piece length weight probability lang_pred score held_out words lines directory page_id".split()


def clashing(spark):
    """The documents with columns named as the operators' own."""
    return documents(spark).select("*", *[F.lit("x").alias(c) for c in CLASHING])
