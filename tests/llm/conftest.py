import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node long, text_ string, bucket int, component_id string, tokens string, rank int"


def documents(spark, texts, langs=None):
    """Rows with ids from 0, and columns whose names clash with those the operators use."""
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "src0", None, "s", 1, "x", 2, "c", "t", 3) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], DOCS)


ODD = [None, "", "   \n\t ", "a", "The same text twice, word for word, in two rows.", "The same text twice, word for word, in two rows.", "ünïcödé 漢字 🙂 <|endoftext|>", "word " * 30_000, "x" * 50_000]


@pytest.fixture
def docs(spark):
    return lambda texts, langs=None: documents(spark, texts, langs)


@pytest.fixture
def odd(spark):
    """Odd documents: nulls in every column, empty and very long texts, repeated rows and a null id."""
    df = documents(spark, ODD, ["en", None, "de", None, "en", "en", None, "de", "en"])
    return df.unionByName(df.where("doc_id = 4")).unionByName(spark.createDataFrame([tuple([None] * 12)], DOCS))
