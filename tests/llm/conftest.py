import numpy as np
import pytest
from pyspark.sql import Row

WORDS = "river stone walks under bright morning while seven ancient horses carry quiet letters across distant valley green harbour lamps never answer summer bread found near broken tower gates open slowly".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[r.integers(len(WORDS))] + str(r.integers(40)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, repeated and very long texts, and ties."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "s0", None),
        (2, "", "en", "s0", 0),
        (3, "   \n\t ", None, None, 6),
        (4, prose(2, 80), "en", "s0", None),
        (4, prose(2, 80), "en", "s0", None),
        (None, prose(3, 80), "de", "s1", None),
        (None, None, None, None, None),
        (5, long, "en", "s0", len(long)),
        (6, long, "en", None, len(long)),
        (7, "one", "fr", "s0", 3),
        (8, prose(2, 80), "en", "s1", None),
        (9, "Ünïcödé wörds — “quoted” 東京 🙂 don't", "xx", "s1", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").cache() for t in ("documents", "labels", "pages", "benchmark")}


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["Row"]
