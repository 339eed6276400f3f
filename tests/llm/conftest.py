import pytest


LONG = "ab " * 60000
BASE = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, "Plain words of a short text.\nSecond line here.", "en", "a", 46),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", None, "b", 6),
    (5, BASE, "en", "a", 1),
    (6, BASE, "en", "a", 1),
    (6, BASE, "en", "a", 1),
    (7, BASE.replace("w3 ", "zz "), "en", None, 1),
    (None, BASE + " tail", "de", "c", 1),
    (9, LONG, "de", "a", len(LONG)),
    (10, "one two three", "es", "a", 13),
    (11, "One TWO three", "es", "", 13),
    (12, "Ünïcödé wörds größer ñandú\u00a0glued \u2028 end", "de", "c", 1),
    (13, "x", "fr", "d", 1),
    (14, "line one is here\nline one is here\nline one is here\n" + " ".join("a b c d e f g h".split() * 5), "fr", "d", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
