"""Ranks and joins along an order, against plain Python, on data larger than one sampled range."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.operators import ordering


@pytest.mark.parametrize("settings", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "23"}])
def test_ranks_over_many_ranges(spark, tmp_path, settings):
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 400_000
        rows = spark.range(n).select(F.xxhash64("id").alias("id"), F.expr("CASE WHEN id % 3 = 0 THEN 'malicious' WHEN id % 1000 <> 1 THEN 'clean' END").alias("truth"), F.concat(F.lit("file"), F.col("id") % 5000).alias("file_name"))
        rows.repartition(8).write.parquet(str(tmp_path / "rows"))
        rows = spark.read.parquet(str(tmp_path / "rows"))
        got = ordering.ranked(rows, "truth", "file_name", "id")
        want = rows.withColumn("want", F.row_number().over(Window.partitionBy("truth").orderBy("file_name", "id")))
        both = got.join(want.select("id", "want"), "id")
        assert got.count() == n and both.where("place = want").count() == n
        assert ordering.ranked(rows.limit(0), "truth", "id").count() == 0
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("bin_size", [7, 1 << 16])
def test_points_within_spans(spark, monkeypatch, bin_size):
    monkeypatch.setattr(ordering, "BIN", bin_size)
    rng = np.random.default_rng(3)
    spans, points = [], []
    for key in range(12):
        at = int(rng.integers(0, 5))
        for number in range(int(rng.integers(0, 30))):
            size = int(rng.choice([0, 1, 3, 40]))
            spans.append((key, at, size, number))
            at += size + int(rng.choice([0, 1, 9]))
        points += [(key, p, f"p{p}") for p in [*range(at + 4), 0, 10**9]]
    got = ordering.within_spans(spark.createDataFrame(points, "key int, at long, name string"), spark.createDataFrame(spans, "key int, start long, len long, stream long"), "key", "at", "start", "len", "stream")
    want = [(k, p, n, next((s for q, a, m, s in spans if q == k and a <= p < a + m), None)) for k, p, n in points]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
