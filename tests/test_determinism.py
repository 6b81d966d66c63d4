"""Same results with 1 and 16 shuffle partitions (the numbering, blocking and top-k all depend on
the partition layout internally, never in their output); top-k ranks are 1..min(10, n)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

NAMES = ["top10_wide", "mrr_matched", "target_rank", "user_features", "loss_softmax", "shuffled_batches",
         "group_review_ids", "sample_groups_replace"]


def _with_partitions(spark, n, fn):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        return fn()
    finally:
        spark.conf.set(key, old)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_16_partitions(spark, sf_small, name):
    q = E.queries()[name]
    one = _with_partitions(spark, 1, lambda: q(spark, sf_small).toPandas())
    many = _with_partitions(spark, 16, lambda: q(spark, sf_small).toPandas())
    cols = sorted(one.columns)
    assert len(one) == len(many) > 0
    a = one[cols].sort_values(cols).reset_index(drop=True)
    b = many[cols].sort_values(cols).reset_index(drop=True)
    assert a.equals(b)


def test_topk_ranks_are_consecutive_from_one(spark, sf_small):
    t = E.queries()["topk10"](spark, sf_small)
    per_user = t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"),
                                        F.max("rank").alias("hi"), F.countDistinct("rank").alias("d"))
    bad = per_user.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))
                         | (F.col("n") > 10))
    assert per_user.count() > 0 and bad.count() == 0
