import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang) as a documents table."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Null ids and texts, empty and very long texts, repeated rows."""
    long = "alpha beta gamma delta epsilon zeta " * 30_000
    return documents((1, None), (None, "a text without an id"), (2, ""), (3, " \n\t "), (4, long), (5, "same words here"), (5, "same words here"), (6, "same words here"), (None, None, None), (7, "é" * 10, None))


@pytest.fixture(scope="session")
def empty(documents, spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def crowded_names(odd):
    """Extra columns whose names the operators use for their results."""
    from pyspark.sql import functions as F

    names = ("score", "kept", "piece", "fp", "key", "rule", "bytes", "component_id", "predicted", "n_words", "root", "least", "address", "bucket", "cell", "page", "value", "sequence_id", "offset", "length", "hash", "n", "block", "toxic", "units", "shard", "held_out", "__q_n_words", "__row", "__h", "__fp", "__l_pred", "__t_score", "__d_words", "__c0", "__one", "a.b", "x y")
    wide = odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)], F.create_map(F.lit("k"), F.col("n_chars")).alias("map"))
    return wide.toDF(*wide.columns[:-1], "TEXT")  # differs from a needed name in case alone


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)
