import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes the given rows as a folder of tables; documents come with clashing extra columns."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def run(spark):
    return lambda name, sf_dir: __spark_entry__.queries()[name](spark, sf_dir).collect()


@pytest.fixture
def edge_docs(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows, and extra columns with names that operators use."""
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (0, "", "en", "a"), (1, None, None, None), (2, " \n\t ", "en", "b"), (3, long_text, "de", "a"), (4, long_text, "de", "b"),
        (5, "one two", None, "a"), (6, "One TWO", "en", None), (7, f"head x y {passage} tail", "en", "a"), (8, f"other {passage} end.", "en", "a"),
        (8, f"other {passage} end.", "en", "a"), (None, "no id here", "en", "b"), (9, "a\u00a0b \u2581 \u00e9\U0001d11e <|x|> \\ end", "fr", "c"),
        (10, "line one\nline one\nline two!!", "en", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    names = ("size", "taken", "rank", "node", "fp", "words", "gone", "spans", "n_words", "score", "shard", "copies", "_part")
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "cast(char_length(text) as long) AS n_chars", *[f"'x' AS {n}" for n in names])
    return frame


@pytest.fixture
def sf_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("benchmark tables are not here")
    return SMALL
