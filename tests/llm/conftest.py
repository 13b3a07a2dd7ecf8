import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return make


@pytest.fixture(scope="session")
def corpus(docs_of):
    """Null, empty, tied, repeated, very long and near-copied texts, with a column whose name clashes."""
    base = " ".join(f"word{k % 97} the{k % 13}" for k in range(120))
    other = " ".join(f"alpha{k} beta{k * 7 % 31}" for k in range(150))
    rows = [
        (1, base, "en", "a", 1, 9),
        (2, base, "en", "a", 1, 9),
        (3, base + " tail", "en", None, 1, 9),
        (4, other, "fr", "b", 1, 9),
        (5, None, "fr", "b", 1, 9),
        (6, "", None, "c", 1, 9),
        (7, "short éü text", "de", "c", 1, 9),
        (8, other[:700] + " " + base[300:900], "de", "a", 1, 9),
        (8, other[:700] + " " + base[300:900], "de", "a", 1, 9),
        (9, "x " * 30000, "de", "a", 1, 9),
        (10, "é" * 200 + other[:80], "de", "b", 1, 9),
    ]
    return docs_of(rows, ", size long")
