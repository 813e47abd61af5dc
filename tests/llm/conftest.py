import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, and extra columns with likely names."""
    long_text = " ".join(f"word{i % 97} und{i % 31}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (4, " \n\t ", "de", None), (5, long_text, "en", "s"),
        (6, "the quick brown fox jumps over the lazy dog", "en", "s"), (7, "same row", "fr", "s"), (7, "same row", "fr", "s"), (None, "no id here", "en", "s"), (None, None, None, None),
        (8, "123 456 !!", "en", "s"), (9, "日本語のテキスト 🙂🙂", "ja", "s"), (10, "x", "en", "s"), (11, "same id, other text", "en", "s"), (11, "other", "en", "s"), (12, long_text + " end", "en", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for c in ("row", "score", "lang_pred", "tox_score", "fp", "component", "n", "shard", "slot", "piece", "copies", "rate", "size", "text_key", "keep_id"):
        df = df.withColumn(c, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (6, 1, 0), (7, 1, 1), (None, 1, 1), (9, None, None), (11, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory, odd_docs, odd_labels):
    d = str(tmp_path_factory.mktemp("odd"))
    odd_docs.write.parquet(f"{d}/documents.parquet")
    odd_labels.write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, spark, odd_docs, odd_labels):
    d = str(tmp_path_factory.mktemp("empty"))
    odd_docs.limit(0).write.parquet(f"{d}/documents.parquet")
    odd_labels.limit(0).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
