import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, **extra):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df

    return make


LONG = "Many words make one very long text and this one goes on. " * 12_000


@pytest.fixture(scope="session")
def small_tables(spark, tmp_path_factory):
    """Tables with nulls in any column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    folder = str(tmp_path_factory.mktemp("small"))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n\t ", "en", "s", 4), (9004, LONG, "en", "s", len(LONG)), (9005, "tie tie tie tie", "en", "s", 15), (9006, "tie tie tie tie", "en", "s", 15), (9007, "x" * 30_000, "en", "s", 30_000)], SCHEMA)
    docs = real.unionByName(odd)
    extra = {"score": "x", "id": 1, "fp": "y", "rid": 2, "kept": "z", "n_words": "w", "_key": 3, "samples": 4, "h1": 5, "pos": 6, "component": 7, "window": 8, "term": 9}
    from pyspark.sql import functions as F

    docs.withColumns({k: F.lit(v) for k, v in extra.items()}).repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.unionByName(spark.createDataFrame([(None, None, None), (9001, 1, 0), (9005, 0, 1), (9005, 0, 1)], labels.schema)).withColumn("score", F.lit("x")).write.parquet(f"{folder}/labels.parquet")
    for name in ("pages", "benchmark"):
        t = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(150)
        key, *rest = t.columns
        blank = [None] * len(rest)
        odd = [(None, *blank), (9001, *blank), (9002, *[""] * len(rest)), (9003, *[LONG[:60_000]] * len(rest)), (9004, *["tie tie tie"] * len(rest)), (9005, *["tie tie tie"] * len(rest))]
        t = t.unionByName(spark.createDataFrame(odd, t.schema)).unionByName(t.limit(2))
        t.withColumns({k: F.lit(v) for k, v in extra.items() if k not in t.columns}).write.parquet(f"{folder}/{name}.parquet")
    return folder
