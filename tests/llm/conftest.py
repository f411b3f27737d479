import random

import pytest

#: Columns of documents, and extra ones whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, size string, lang_pred string, row_id string, bench_words string, part string"


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source); the extra columns hold other things."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 99, False, "big", "zz", "r", "b", "p") for i, t, la, s in rows], SCHEMA)


def sentence(rng, n, words="the of and to in house river stone green walks under seven bright again".split()):
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base + " tail", None, None),
        (4, None, "en", "b"),
        (5, "", "fr", None),
        (6, " \n\t\x0b ", "fr", "b"),
        (7, long, "en", "b"),
        (8, "solo", "de", "c"),
        (9, "solo", "de", "c"),
        (10, "first " + passage + " middle " + passage + " last", "en", "c"),
        (11, sentence(rng, 50) + " " + passage, "en", "a"),
        (12, "x" * 200_000, "en", "a"),
        (13, "é ß 中文 \U0001f600 " + sentence(rng, 20), None, "a"),
        (14, "12345 !!! ---", "en", "d"),
        (None, sentence(rng, 40), "en", "d"),
        (None, sentence(rng, 40), None, None),
        (15, "!! A !! B\n" * 50, "en", "d"),
        (-3, sentence(rng, 80), "en", "é"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
