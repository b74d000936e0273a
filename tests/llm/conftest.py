import pytest

SENTENCE = "The quick brown foxes jumped over seventeen lazy dogs beside a quiet river. "
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, and extra columns with clashing names."""
    long_text = "".join(f"Sentence number {k} speaks about subject {k * 7919 % 1000} plainly.\n" for k in range(4000))
    rows = [
        (1, SENTENCE * 3, "en", "a", 10),
        (1, SENTENCE * 3, "en", "a", 10),
        (2, SENTENCE * 3, "en", "b", 10),
        (None, SENTENCE * 3, None, None, None),
        (3, None, "en", "a", None),
        (None, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, "  \n\t ", "en", None, 5),
        (6, long_text, "en", "a", len(long_text)),
        (7, "a" * 200_000, "en", "c", 200_000),
        (8, "!!! ???", "de", "a", 7),
        (9, "été déjà vu — naïve façade", "fr", "a", 26),
        (9, "another text under the same number", "en", "a", 34),
        (10, "\x1f\x00 odd bytes \x0b here. And here. Too.", "en", "a", 30),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    clash = {name: 0 for name in ("fp", "shard", "score", "id", "tk", "sid", "bytes", "length", "toxic", "removed_lines", "item_id", "key", "rank")}
    from pyspark.sql import functions as F

    out = df.select("*", *[F.lit(v).alias(k) for k, v in clash.items()])
    # names that differ by case only, and one that is there twice
    return out.select("*", F.lit("x").alias("TEXT"), F.lit("y").alias("Doc_Id"), F.lit(1).alias("__c0"), F.lit(2).alias("shard"))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
