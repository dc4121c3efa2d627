"""Repeated rows of equal vectors count once."""

from pyspark.sql import functions as F

from glyphmill.llm import neighbours


def test_repeated_rows_push_no_id_out(spark):
    near, far = [1.0] * 4, [5.0, 1.0, 1.0, 1.0]
    rows = [(1, near)] * 30 + [(i, near) for i in (2, 3, 4)] + [(0, far)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.rank, r.vec_id) for r in neighbours.nearest(docs, F.col("vec_id") == 0, k=3).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]
