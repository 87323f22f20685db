import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).parent)]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long = " ".join(f"w{i % 700}x" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [
        None, "", " \t\n", "one", "two words", "One two three four five six.", passage, f"{passage} end", f"Start {passage}",
        long, long, f"{long} tail", "é ñ 中文 😀\n\n中文", "same same same same", "same same same same", "a\na\na\n",
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, passage, None, None, None), (None, None, None, None, None), rows[6], rows[6], (3, passage, "en", "s", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    for name in ("id", "label", "score", "predicted", "kept", "n_words", "_row", "_doc_key", "_text_key", "_repeats", "pos"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
