"""Ranking semantics: ties, padding, short lists, users without candidates, blocked == brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomrank.operators.ranking import mean_reciprocal_rank, target_ranks, topk_per_user, wide_top10
from roomrank.functions.vectors import reciprocal_rank


def _items(spark, rows):
    return spark.createDataFrame(rows, "review_id long, accommodation_id long, vec array<double>")


def _users(spark, rows):
    return spark.createDataFrame(rows, "user_id long, accommodation_id long, vec array<double>")


def test_short_list_padded_with_first_candidate(spark):
    items = _items(spark, [(10, 1, [0.5, 0.0]), (20, 1, [1.0, 0.0]), (30, 1, [0.1, 0.0])])  # a<b<c
    users = _users(spark, [(1, 1, [1.0, 0.0])])
    t = topk_per_user(users, items)
    w = wide_top10(t, users, items).first()
    assert [w[f"review_{i}"] for i in range(1, 11)] == [20, 10, 30] + [10] * 7
    assert w["ID"] == 1


def test_score_tie_smaller_id_first(spark):
    items = _items(spark, [(9, 1, [1.0]), (5, 1, [1.0])])
    users = _users(spark, [(1, 1, [1.0])])
    t = topk_per_user(users, items).orderBy("rank").collect()
    assert [r["review_id"] for r in t] == [5, 9]


def test_user_without_candidates_dropped(spark):
    items = _items(spark, [(1, 1, [1.0])])
    q = spark.createDataFrame([(1, 1, [1.0], 1, [1.0]), (2, 99, [1.0], 1, [1.0])],
                              "user_id long, accommodation_id long, vec array<double>, review_id long, tvec array<double>")
    r = target_ranks(q, items).collect()
    assert [x["user_id"] for x in r] == [1]


def test_reciprocal_rank_cutoff(spark):
    df = spark.createDataFrame([(10,), (11,), (1,)], "rank long")
    assert [r[0] for r in df.select(reciprocal_rank(F.col("rank"))).collect()] == [0.1, 0.0, 1.0]


def test_two_users_one_review_ranks_one_and_two(spark):
    # both users matched review 7; candidates are the matched rows, tie broken by row user id
    q = spark.createDataFrame([(1, 1, [1.0], 7, [1.0], 1), (2, 1, [1.0], 7, [1.0], 2)],
                              "user_id long, accommodation_id long, vec array<double>, review_id long, "
                              "tvec array<double>, ttie long")
    items = spark.createDataFrame([(1, 7, [1.0], 1), (1, 7, [1.0], 2)],
                                  "accommodation_id long, review_id long, vec array<double>, itie long")
    r = {x["user_id"]: x["rank"] for x in target_ranks(q, items, target_tie="ttie", item_tie="itie").collect()}
    assert r == {1: 1, 2: 2}


def test_blocked_scoring_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n_items, n_users, d = 300, 200, 8
    acc_i = np.where(rng.random(n_items) < 0.5, 0, rng.integers(1, 5, n_items))
    acc_u = np.where(rng.random(n_users) < 0.5, 0, rng.integers(1, 5, n_users))
    iv = np.round(rng.normal(size=(n_items, d)), 2)
    uv = np.round(rng.normal(size=(n_users, d)), 2)
    items = spark.createDataFrame([(i, int(acc_i[i]), iv[i].tolist()) for i in range(n_items)],
                                  "review_id long, accommodation_id long, vec array<double>")
    # target: a random item of the same accommodation
    tgt = [int(rng.choice(np.flatnonzero(acc_i == a))) for a in acc_u]
    q = spark.createDataFrame([(u, int(acc_u[u]), uv[u].tolist(), tgt[u], iv[tgt[u]].tolist()) for u in range(n_users)],
                              "user_id long, accommodation_id long, vec array<double>, review_id long, "
                              "tvec array<double>")
    got = {r["user_id"]: r["rank"] for r in target_ranks(q, items, block=16).collect()}
    got_top = topk_per_user(q.select("user_id", "accommodation_id", "vec"), items, block=16).toPandas()
    # block sizes from a wrong size source change only the work
    bad = spark.createDataFrame([(a,) for a in [0, 1, 2, 3, 4] * 200], "accommodation_id long")
    assert {r["user_id"]: r["rank"] for r in
            target_ranks(q, items, block=16, query_sizes=bad, item_sizes=bad).collect()} == got
    bad_top = topk_per_user(q.select("user_id", "accommodation_id", "vec"), items, block=16,
                            query_sizes=bad, item_sizes=bad).toPandas()
    key = ["user_id", "rank"]
    assert bad_top.sort_values(key).reset_index(drop=True).equals(got_top.sort_values(key).reset_index(drop=True))
    for u in range(n_users):
        cand = np.flatnonzero(acc_i == acc_u[u])
        s = np.round(iv[cand] @ uv[u], 6)
        order = sorted(range(len(cand)), key=lambda j: (-s[j], cand[j]))
        ranked = [int(cand[j]) for j in order]
        assert got[u] == ranked.index(tgt[u]) + 1
        mine = got_top[got_top.user_id == u].sort_values("rank")["review_id"].tolist()
        assert mine == ranked[:10]


def test_mrr_in_unit_interval_and_matches_anchor(spark):
    from roomrank.plans.queries import mrr_all
    r = mrr_all(spark, "/root/testdata/sf0.01").first()
    assert r["n_users"] == 1500 and abs(r["mrr"] - 0.344385) < 1e-6


def test_topk_no_duplicates_before_padding(spark, sf_small):
    from roomrank.plans.queries import topk10
    t = topk10(spark, sf_small)
    assert t.groupBy("user_id", "review_id").count().where("count > 1").count() == 0
    assert t.groupBy("user_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m != n").count() == 0


def test_mean_reciprocal_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 0.0)], "user_id long, rr double")
    r = mean_reciprocal_rank(df).first()
    assert r["n_users"] == 3 and abs(r["mrr"] - 0.5) < 1e-12


def test_hot_group_blocks_are_built_by_many_tasks(spark):
    # one group holds almost every row; its blocks must not all be built in one task
    from roomrank.operators.scoring import _blocks
    hot = spark.range(0, 2000).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("iid"),
                                      F.array(F.col("id").cast("double")).alias("vec"))
    cold = spark.range(2000, 2010).select((F.col("id") % 3 + 2).alias("g"), F.col("id").alias("iid"),
                                          F.array(F.col("id").cast("double")).alias("vec"))
    b = _blocks(hot.unionByName(cold), "g", ["iid"], ["iid", "vec"], 50, "rows")
    hot_blocks = b.where(F.col("g") == 1).withColumn("pid", F.spark_partition_id())
    sizes = [r["n"] for r in hot_blocks.select(F.size("rows").alias("n")).collect()]
    assert sum(sizes) == 2000 and len(sizes) == 40 and max(sizes) <= 100  # ~50 rows per block
    # AQE merges this tiny input into one partition; at scale partitions are not merged, so
    # look at the partitioning itself
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert hot_blocks.select("pid").distinct().count() > 4
    finally:
        spark.conf.set(key, old)


def _queries(spark, rows):
    return spark.createDataFrame(rows, "user_id long, accommodation_id long, vec array<double>, review_id long, tvec array<double>")


def test_target_that_is_no_candidate_has_no_rank(spark):
    items = _items(spark, [(1, 1, [1.0]), (2, 1, [0.5])])
    r = target_ranks(_queries(spark, [(1, 1, [1.0], 99, [0.7]), (2, 1, [1.0], 2, [0.5])]), items).orderBy("user_id").collect()
    assert (r[0]["rank"], r[0]["rr"]) == (None, 0.0) and (r[1]["rank"], r[1]["rr"]) == (2, 0.5)


def test_nan_scores_rank_last_and_stop_the_mean(spark):
    nan = float("nan")
    items = _items(spark, [(i, 1, [nan if i == 3 else float(i)]) for i in range(1, 6)])
    ranks = target_ranks(_queries(spark, [(1, 1, [1.0], 3, [nan]), (2, 1, [1.0], 5, [5.0])]), items, block=2)
    assert {r["user_id"]: r["rank"] for r in ranks.collect()} == {1: 5, 2: 1}
    with pytest.raises(Exception, match="non-finite"):
        mean_reciprocal_rank(ranks).collect()
    top = topk_per_user(_users(spark, [(1, 1, [1.0])]), items, block=2).orderBy("rank").collect()
    assert [r["review_id"] for r in top] == [5, 4, 2, 1, 3]


def test_group_without_a_size_stops(spark):
    items = _items(spark, [(1, 1, [1.0]), (2, 2, [0.5])])
    sizes = spark.createDataFrame([(1,)], "accommodation_id long")
    with pytest.raises(Exception, match="no size"):
        topk_per_user(_users(spark, [(1, 2, [1.0])]), items, item_sizes=sizes).collect()


def test_hot_group_block_pairs_are_spread_without_aqe(spark):
    from roomrank.operators.scoring import SALT_BLOCKS, _blocks, _salted

    rows = spark.range(0, 1600).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("iid"), F.lit(0.5).alias("vec"))
    few = spark.range(1600, 1610).select((F.col("id") % 5 + 2).alias("g"), F.col("id").alias("iid"), F.lit(0.5).alias("vec"))
    both = rows.unionByName(few)
    qb, ib = (_blocks(both, "g", ["iid"], ["iid", "vec"], 16, n) for n in ("qrows", "irows"))
    qb, ib = _salted(qb, ib)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        keys = qb.join(ib, ["g", "_salt"]).groupBy("g", "_salt").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    total = sum(r["count"] for r in keys)
    hot = [r["count"] for r in keys if r["g"] == 1]
    assert len(hot) == -(-100 // SALT_BLOCKS) and sum(hot) == 100 * 100 and max(hot) <= 0.1 * total


def test_hot_keys_are_few_and_their_rows_spread(spark):
    """A key with a third of the rows: joined in parts, the result as a plain join gives it, nulls and missing keys too."""
    from pyspark.sql import functions as F

    from roomrank.operators.scoring import hot_key_join, hot_keys
    rows = spark.createDataFrame([(i, 1 if i % 3 == 0 else (None if i % 50 == 1 else i % 97)) for i in range(3000)], "id long, grp long")
    lookup = spark.createDataFrame([(g, g * 10) for g in range(80)], "grp long, v long")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(sizes, "grp", parts=8)
    found = {r["grp"]: r["_salts"] for r in hot.collect()}
    assert list(found) == [1] and found[1] >= 3
    for how in ("inner", "left"):
        got = hot_key_join(rows, lookup, "grp", hot, ["id"], how)
        want = rows.join(lookup, "grp", how).select("grp", "id", "v")
        assert got.columns == ["grp", "id", "v"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # neither AQE nor a broadcast of the lookup: no task has more than a part of the hot key
        spread = hot_key_join(rows, lookup, "grp", hot, ["id"]).where("grp = 1").groupBy(F.spark_partition_id()).count()
        assert spread.agg(F.max("count")).first()[0] <= 2 * 1000 / 3 and spread.count() >= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
