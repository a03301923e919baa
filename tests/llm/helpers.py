"""Documents with everything that may go wrong."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, KEY string, `_keys` int, n_lines string, probability string"


def words(seed, n, size=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


def table(spark, texts, source="s", lang="en", start=0):
    """Documents numbered from `start`, with further columns whose names clash with those the operators use."""
    rows = [(start + i, text, lang, source, None if text is None else len(text), f"k{i}", i, "x", "y") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ids that repeat with other texts."""
    long_text = words(1, 60_000)
    rows = [(1, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "", 0, "", ""), (3, " \t\x0b\n\n ", None, "s", None, None, None, None, None),
            (4, long_text, "en", "s", len(long_text), "k", 1, "1", "1"), (4, long_text, "en", "s", len(long_text), "k", 1, "1", "1"),
            (5, "one two", "de", None, 7, "k", 1, "1", "1"), (5, "three four", "de", "t", 10, "k", 1, "1", "1"),
            (None, "no id at all", "en", "s", 12, "k", 1, "1", "1"), (None, None, None, None, None, None, None, None, None),
            (6, "Ünïcode \U0001f600 text  with\x85 odd marks \x01\x02", "fr", "s", 1, "k", 1, "1", "1")]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
