import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size long, shard long, slot long, row long, point long, n long, score double, target double, draws long, "
         "segment long, shingles string, content string, token string, held_out string, component_id string, law string")


def _words(rng, n, stem="w"):
    return " ".join(f"{stem}{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(7)
    long_text = _words(rng, 30_000)
    base, other = _words(rng, 200), _words(rng, 200, "v")
    near = base.split()
    near[50] = "changed"
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "b", 3), (4, base, "en", "a", 1),
            (5, base, "en", None, 1), (6, " ".join(near), "fr", "b", 1), (7, other, "fr", "a", 1),
            (7, other, "fr", "a", 1), (None, base, "en", "b", 1), (None, None, None, None, None),
            (8, long_text, "en", "a", 1), (9, "Only three words", "en", "", 1), (10, "only THREE words", "en", "c", 1),
            (11, "x" * 5000, "en", "c", 1), (12, "a\u0000b É é 12 日本語 _-_", "fr", "c", 1),
            (13, long_text[:9000] + other, None, "b", 1), (14, "same same same " * 300, "en", "b", 1)]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """Nulls, empty and long texts, copies, repeated rows and clashing extra columns."""
    df = spark.createDataFrame(edge_rows, SCHEMA)
    for c in CLASH.split(", "):
        name, kind = c.split(" ")
        df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [tuple(r) for r in small.select("doc_id", "text", "lang", "source", "n_chars").collect()]
