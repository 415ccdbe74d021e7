"""Awkward rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def rows():
    prose = "The quick brown fox jumps over the lazy dog near the old river bank while seven grey geese fly south. "
    texts = [None, "", " \n\t ", "one", "word " * 30000, prose, prose, prose * 4, "line\n" * 300, "été ñandú ßü " * 40, " x　y", "a\x00b c", "🙂 " * 70, "!!! " * 60]
    out = [(i, t, ("en", "de", None)[i % 3], ("s0", "s1", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, prose, "en", "s0", 1), (None, None, None, None, None)]


def frame(spark, extra=()):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
