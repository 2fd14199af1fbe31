import pytest
from pyspark.sql import types as T


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in (
        "shard", "fingerprint", "score", "ids", "pos", "n", "fp", "key", "part", "dh", "gid", "h")]])


def _row(doc_id, text, lang, source):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * 12)


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
AWKWARD = [
    _row(1, None, "en", "a"), _row(2, "", None, None), _row(3, "   \n\t ", "en", "a"), _row(4, "!!! 123 ...", "en", "b"),
    _row(5, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    _row(5, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    _row(6, "the quick brown fox jumps over the lazy dog again", "en", "b"),
    _row(None, "the quick brown fox jumps over the lazy dog again", None, "c"),
    _row(8, LONG, "en", "c"), _row(9, "ein kleiner Fuchs läuft über die Straße", "de", "c"),
    _row(10, "Wort", None, "d"), _row(11, "▁ a  b ▁▁\r\n   🎉 日本語 <|im_end|> \\<\\|", "en", "d"),
    _row(12, "one two", "en", "d"), _row(13, "ONE two", "en", "e")]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
