"""Draws formed in place against the draw table; components without broadcasts."""

import pytest
from pyspark.sql import functions as F

from signalharm.operators import infer as I
from signalharm.operators import splits


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_sums_without_table(spark, keys):
    v = spark.range(0, 700).select(F.col("id").alias("c"), (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.sqrt("id")).alias("v"))
    table = I.bootstrap_sums(v, "c", keys, ["v"], I.draw_table(v, "c", "t", 40))
    direct = I.bootstrap_sums(v, "c", keys, ["v"], I.Draws(v, "c", "t", 40))
    cols = [*keys, "resample", "v", "_w"]
    a, b = (sorted(tuple(r) for r in d.select(*cols).collect()) for d in (table, direct))
    assert len(a) == 40 * (3 if keys else 1)
    assert [r[:-2] + r[-1:] for r in a] == [r[:-2] + r[-1:] for r in b]
    assert all(abs(x[-2] - y[-2]) < 1e-6 for x, y in zip(a, b))


def test_components_broadcast_nothing(spark):
    edges = spark.range(0, 300).select("id", F.explode(F.array(F.col("id") % 50, F.lit(1000) + F.floor(F.col("id") / 60))).alias("hub"))
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1b")  # any broadcast of a table fails
    try:
        got = splits.leakage_components(edges, "id", "hub").collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == 300 and {r.component_id for r in got} == {0}
