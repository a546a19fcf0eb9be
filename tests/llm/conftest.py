import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n, size=900):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        rows.append((i, "\n".join(" ".join(_words(rng, rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))), "en", f"s{i % 5}", 1))
    base = " ".join(_words(rng, 600))
    for i in range(120, 150):
        words = base.split(" ")
        words[rng.randrange(600)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "hot", 1))
    rows += [(i, "the same text here", "de", "hot", 1) for i in range(150, 160)]
    rows += [(160, "the  same\ttext\nhere", "de", "hot", 1), (161, "", "de", "hot", 1), (162, None, "de", "hot", 1), (163, "   \n\t ", None, None, None)]
    rows += [(164, " ".join(_words(rng, 9000)), None, None, None), (None, "a row without an id", "fr", "s1", 2), (None, None, None, None, None)]
    rows += [(5, rows[5][1], "en", "s0", 1), (7, "the id of another row", "en", "s0", 1), (165, "Été ça ½ 日本語 \U0001f600 ﬁ don't  we'll", "fr", "é", 1), (-3, "two words", "en", "", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Columns named as those that operators make inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in ("id", "row", "size", "number", "norm", "fp", "node", "root", "count", "start", "key", "path", "line", "score", "kept", "a", "b", "_id", "_salt")})


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
