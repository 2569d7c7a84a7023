"""Small inputs shared by the tests, and plain versions of the text rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Further columns whose names the operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("first", T.LongType()), T.StructField("w", T.StringType()),
    T.StructField("rank", T.LongType()), T.StructField("n", T.LongType()),
])


def documents(spark, rows):
    """Rows (doc_id, text, lang) as documents with further columns."""
    full = [(i, t, lang, "s", len(t) if t is not None else None, "x", "y", 1, "z", 2, 3) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows and ties."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    long = "\n".join(sentence(rng, 40) for _ in range(1500))
    return [
        (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, base, "en"), (5, base, "de"), (5, base, "de"), (None, base, "en"),
        (None, base + " tail", "en"), (6, long, "en"), (7, "one", None), (8, "one two", "en"), (9, "a\n\nb\na\n", "en"),
        (10, sentence(rng, 30) + "\n" + sentence(rng, 9), "fr"), (11, "*** ### $$$", "en"), (12, "Ünï cödé ßtraße 日本語 \U0001F600", "de"),
    ]
