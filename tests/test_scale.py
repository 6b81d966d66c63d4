"""What travels in the joins of vectors, features and texts, and the compact forms against plain ones."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from roomrank.operators import candidates as C
from roomrank.operators import losses as L
from roomrank.operators import training as TR
from roomrank.plans import jobs as J
from roomrank.plans.fixture import fixture
from roomrank.sources.tables import reviews_view
from tests.test_plans import _plan


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanged(df) -> list[set[str]]:
    """The columns of every exchange of the plan."""
    blocks = [b for b in _plan(df).split("\n\n") if "Exchange" in b.split("\n")[0] and "Reused" not in b.split("\n")[0]]
    return [set(re.findall(r"([A-Za-z_]\w*)#", b.split("Input")[1].split("\n")[0])) for b in blocks if "Input" in b]


@pytest.mark.parametrize("name", ["dot_scores", "cosine_scores", "euclid_scores", "pair_vector", "loss_cosine"])
def test_a_match_is_shuffled_with_one_vector_once(spark, sf_small, no_broadcast, name):
    wide = [c for c in exchanged(E.queries()[name](spark, sf_small)) if c & {"uvec", "rvec", "vec"} and c & {"user_id", "review_id", "split"}]
    assert len(wide) == 1, wide


def test_only_the_split_s_matches_meet_vectors(spark, sf_small, no_broadcast):
    plan = _plan(E.queries()["mrr_matched"](spark, sf_small))
    assert not [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0] and "user_id" in b and re.search(r"\bvec#", b) and "review_id" not in b]


def test_a_user_s_vector_is_shuffled_once_for_all_epochs(spark, sf_small, no_broadcast):
    wide = [c for c in exchanged(E.queries()["loss_epoch_mean"](spark, sf_small)) if c & {"uvec", "buf"} and "vec_id" not in c]
    assert len(wide) == 2, wide  # the collected users and the collected reviews, nothing per epoch


@pytest.mark.parametrize("whole", [2048, 20])
def test_epoch_losses_equal_those_of_single_epochs(spark, whole):
    rng = np.random.default_rng(3)
    rows = [(a, u, int(rng.integers(0, 4)) + 10 * a) for a, n in ((1, 45), (2, 12), (3, 1)) for u in range(100 * a, 100 * a + n)]
    rows += rows[-2:]  # rows that come twice
    keys = spark.createDataFrame(rows, "accommodation_id long, user_id long, review_id long")
    uv = spark.createDataFrame([(u, rng.normal(size=3).tolist()) for u in sorted({r[1] for r in rows})], "user_id long, uvec array<double>")
    held = sorted({r[2] for r in rows}) + [10, 21]  # reviews that come twice
    rv = spark.createDataFrame([(r, rng.normal(size=3).tolist()) for r in held], "review_id long, rvec array<double>")
    of, seeds = C.epoch_batches(keys, 8, [None, 0, 5], whole=whole), [None, 0, 5]
    found = L.epoch_losses(of.join(uv, "user_id"), of.select("accommodation_id", "epoch", "part", "review_id").distinct().join(rv, "review_id"), "softmax")
    got = {(r["accommodation_id"], r["epoch"], r["batch_id"]): (r["n"], r["loss"]) for r in found.collect()}
    plain = {}
    for e, seed in enumerate(seeds):
        b = C.assign_batches(keys, 8, shuffle_seed=seed).join(uv, "user_id").join(rv, "review_id")
        plain |= {(r["accommodation_id"], e, r["batch_id"]): (r["n"], r["loss"]) for r in L.batch_losses(b, "softmax").collect()}
    assert got.keys() == plain.keys() and all(got[k][0] == plain[k][0] and abs(got[k][1] - plain[k][1]) < 1e-9 for k in got)


def test_compact_mini_batches_hold_each_review_once(spark, sf_small):
    p = J.prepared(spark, sf_small)
    users, reviews = p.user_features.select("user_id", F.col("features").alias("xu")), p.review_features.select("review_id", F.col("vec").alias("xr"))
    rows = p.compact_batches(8, users, reviews).collect()
    assert all(list(r["rids"]) == sorted(set(r["rid"])) and len(r["xr"]) == len(r["rids"]) * p.dims[1] for r in rows)
    assert any(len(r["rids"]) < len(r["rid"]) for r in rows)
    xu, xr = ({r[0]: r[1] for r in df.collect()} for df in (users, reviews))
    keys = p.train_batches(8).collect()
    want = {}
    for k in sorted(keys, key=lambda k: k["pos"]):
        want.setdefault((k["accommodation_id"], k["batch_id"]), []).append((xu[k["user_id"]], xr[k["review_id"]]))
    got = {(r["accommodation_id"], r["batch_id"]): r for r in p.mini_batches(8, users, reviews).collect()}
    assert got.keys() == want.keys()
    for k, pairs in want.items():
        assert got[k]["xu"] == [x for u, _ in pairs for x in u] and got[k]["xr"] == [x for _, r in pairs for x in r]


def test_pair_batches_are_cut_out_of_the_encoders_batches(spark, sf_small):
    from roomrank.operators import models as M

    p = J.prepared(spark, sf_small)
    encoders = {"user": M.init_mlp([p.dims[0], 8, 4], 0), "review": M.init_mlp([p.dims[1], 8, 4], 1)}
    users, reviews = p.user_features.select("user_id", F.col("features").alias("xu")), p.review_features.select("review_id", F.col("vec").alias("xr"))
    cut = TR.plain_batches(TR.encoded_batches(p.compact_batches(8, users, reviews), encoders, 8, 4, 3))
    a = M.encode(users, "user_id", "xu", encoders["user"], "a").withColumnRenamed("a", "xu")
    b = M.encode(reviews, "review_id", "xr", encoders["review"], "b").withColumnRenamed("b", "xr")
    plain = p.mini_batches(4, a, b)
    one, two = ({(r["accommodation_id"], r["batch_id"]): r for r in df.collect()} for df in (cut, plain))
    assert one.keys() == two.keys()
    assert all(np.allclose(one[k]["xu"], two[k]["xu"]) and np.allclose(one[k]["xr"], two[k]["xr"]) for k in one)


def test_batch_losses_keep_no_gradients(spark):
    class Gradient:
        alive = 0

        def __init__(self):
            Gradient.alive += 1

        def __del__(self):
            Gradient.alive -= 1

    def objective(models, xu, xr):
        held = Gradient()
        return float(Gradient.alive), 1.0, {"g": held}

    rows = spark.createDataFrame([(1, b, [1.0, 2.0], [3.0, 4.0]) for b in range(50)], TR_SCHEMA).coalesce(1)
    assert max(r["loss"] for r in TR.batch_losses(rows, {}, objective, (1, 1)).collect()) <= 2


TR_SCHEMA = "accommodation_id long, batch_id long, xu array<double>, xr array<double>"


def test_texts_are_cut_once(spark, sf_small):
    plan = reviews_view(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"substring_index\(|split\(|split_part\(", plan)) == 1


@pytest.mark.parametrize("name", ["top10_text", "mrr_text", "mrr_text_fitted", "csv_splits"])
def test_texts_stay_where_they_are_read(spark, sf_small, no_broadcast, name):
    p = J.prepared(spark, sf_small)
    users = fixture(spark, sf_small).users.where(F.col("split") == "val")
    df = p.fx.of_accommodations(p.fx.reviews, users) if name == "csv_splits" else J.text_review_features(p, "val")
    assert not [c for c in exchanged(df) if c & {"text", "title", "rest", "review_title", "review_positive"}]


def test_only_the_split_s_users_are_encoded(spark, sf_small):
    p = J.prepared(spark, sf_small)
    users, _ = J._text_sides(p, "val")
    scans = [b for b in _plan(users).split("\n\n") if "Scan parquet" in b and "user_features" in b]
    assert scans and all("EqualTo(split,val)" in b for b in scans)
