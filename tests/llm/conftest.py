import pytest

WORDS = "the of and lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(rng, n):
    """n invented words in sentences."""
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in rng.choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, repeated and very long texts, and columns whose names clash with the operators' own."""
    text = "Some words of a text.\nAll rights reserved. token = 0123456789abcdef0123456789abcdef\n"
    rows = [
        (1, None, "en", "s", 0, 1),
        (2, "", None, None, None, 2),
        (3, text, "en", "s", len(text), 3),
        (3, text, "en", "s", len(text), 3),
        (4, text, "en", "s", len(text), 4),
        (5, "word " * 60_000, "en", "s", 300_000, 5),
        (6, "x" * 200_000, "en", "s", 200_000, 5),
        (7, "é漢字🙂 \x00\t tail", "fr", "s", 10, 6),
        (None, "a row without an id", "en", "s", 19, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length long").withColumn("shard", spark_lit(9)).withColumn("score", spark_lit(9)).withColumn("bucket", spark_lit(9))


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
