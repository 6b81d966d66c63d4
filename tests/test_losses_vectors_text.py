"""Losses, vector functions and text functions against numpy / Python references."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomrank.functions import text as TX
from roomrank.functions import vectors as V
from roomrank.operators import candidates as C
from roomrank.operators import clean as K
from roomrank.operators.losses import batch_losses, bce_loss, contrastive_loss, running_means, softmax_loss


def test_batch_edge_65_rows(spark):
    rows = [(1, i, [float(i % 3), 1.0], [1.0, float(i % 5)]) for i in range(65)]
    df = spark.createDataFrame(rows, "accommodation_id long, user_id long, uvec array<double>, rvec array<double>")
    b = C.assign_batches(df, 64)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [1, 64]
    losses = {r["n"]: r for r in batch_losses(b, "softmax").collect()}
    assert losses[1]["loss"] == 0.0


def test_losses_match_bruteforce():
    rng = np.random.default_rng(0)
    u, r = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    sm, bce, con = softmax_loss(u, r), bce_loss(u, r), contrastive_loss(u, r, 2.0)
    s = u @ r.T
    ce = [np.log(np.exp(s[i]).sum()) - s[i, i] for i in range(5)]
    assert abs(sm - np.mean(ce)) < 1e-12
    y = np.eye(5)
    b = [np.mean([-(y[i, j] * np.log(1 / (1 + np.exp(-s[i, j]))) + (1 - y[i, j]) * np.log(1 - 1 / (1 + np.exp(-s[i, j]))))
                  for j in range(5)]) for i in range(5)]
    assert abs(bce - np.mean(b)) < 1e-10
    d = np.array([[np.linalg.norm(u[i] - r[j] + 1e-6) for j in range(5)] for i in range(5)])
    c = np.mean(y * d ** 2 + (1 - y) * np.maximum(2.0 - d, 0) ** 2)
    assert abs(con - c) < 1e-12


def test_running_means(spark):
    df = spark.createDataFrame([(1, 0, 4.0), (1, 1, 2.0), (1, 2, 0.0), (2, 0, 5.0)], "accommodation_id long, batch_id long, loss double")
    got = {(r["accommodation_id"], r["batch_id"]): r["running"] for r in running_means(df, "accommodation_id", "batch_id").collect()}
    assert got == {(1, 0): 4.0, (1, 1): 3.0, (1, 2): 2.0, (2, 0): 5.0}


def test_nan_guard_raises(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(FloatingPointError):
        K.assert_finite(df, ["x"])
    assert df.agg(K.nonfinite_count(df, "x")).first()[0] == 1


def test_vector_functions_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=8), rng.normal(size=8)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), [0.0] * 4)], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.dot("a", "b").alias("dot"), V.cosine("a", "b").alias("cos"), V.euclidean("a", "b").alias("eu"),
                  V.layer_norm("a").alias("ln"), V.l2_normalize("a").alias("l2"), V.l2_normalize("z").alias("z2"),
                  V.truncate("a", 3).alias("tr"), V.append("a", F.lit(1)).alias("ap")).first()
    assert abs(r["dot"] - a @ b) < 1e-12
    assert abs(r["cos"] - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12
    assert abs(r["eu"] - np.linalg.norm(a - b + 1e-6)) < 1e-12
    ln = (a - a.mean()) / np.sqrt(a.var() + 1e-5)
    assert np.allclose(r["ln"], ln)
    assert np.allclose(r["l2"], a / np.linalg.norm(a))
    assert r["z2"] == [0.0] * 4           # zero vector: no error, stays zero
    assert np.allclose(r["tr"], a[:3]) and len(r["ap"]) == 9


def test_vectors_have_unit_norm(spark, sf_small):
    from roomrank.plans.queries import layernorm_truncate_l2
    n = layernorm_truncate_l2(spark, sf_small).groupBy("vec_id").agg(F.sum(F.col("value") * F.col("value")).alias("s"))
    assert n.where(F.abs(F.col("s") - 1.0) > 1e-4).count() == 0


def test_prompt_rendering_exact(spark):
    df = spark.createDataFrame([("T", None, "neg", 7.0, 3)],
                               "review_title string, review_positive string, review_negative string, "
                               "review_score double, review_helpful_votes int")
    df = TX.fill_text(df)
    r = df.select(TX.review_prompt().alias("p"), TX.review_prompt_full().alias("f")).first()
    assert r["p"] == TX.PROMPT_SHORT.format(title="T", positive="None Given", negative="neg")
    assert r["f"] == TX.PROMPT_FULL.format(title="T", positive="None Given", negative="neg", score=7.0, review=3)


def test_hashed_encoder_matches_python(spark):
    text = "Hello hello  World of the  world"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = {r["position"]: r["value"] for r in TX.hashed_token_counts(df, "id", F.col("t"), 16).collect()}
    counts = {}
    for tok in text.lower().split(" "):
        if tok:
            b = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % 16
            counts[b + 1] = counts.get(b + 1, 0) + 1
    nn = np.sqrt(sum(c * c for c in counts.values()))
    assert got.keys() == counts.keys()
    assert all(abs(got[k] - counts[k] / nn) < 1e-12 for k in counts)


def test_hash_sample_reproducible_and_overflow_safe(spark):
    df = spark.createDataFrame([(k,) for k in [0, 1, 2**40, 2**62]], "k long")
    h = [r[0] for r in df.select(K.mult_hash32("k")).collect()]
    assert h == [(k * 2654435761) % 2**32 for k in [0, 1, 2**40, 2**62]]


def test_running_means_of_a_hot_group_spread_over_tasks(spark):
    rows = [(a, b, float((7 * (a or 0) + 3 * b) % 11)) for a, n in ((1, 4000), (2, 3), (3, 1), (None, 5)) for b in range(n)]
    df = spark.createDataFrame(rows, "accommodation_id long, batch_id long, loss double").repartition(6)
    out = running_means(df, "accommodation_id", "batch_id")
    got = {(r["accommodation_id"], r["batch_id"]): r["running"] for r in out.collect()}
    assert len(got) == len(rows)
    for a in (1, 2, 3, None):
        total = 0.0
        for n, (_, b, loss) in enumerate(sorted((r for r in rows if r[0] == a), key=lambda r: r[1]), 1):
            total += loss
            assert abs(got[a, b] - total / n) < 1e-9
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join such small partitions
    try:
        spread = running_means(df, "accommodation_id", "batch_id")
        assert spread.where("accommodation_id = 1").withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 2
        assert {(r["accommodation_id"], r["batch_id"]): r["running"] for r in spread.collect()} == pytest.approx(got)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fitted_projection_equals_the_eigenvectors_of_all_texts(spark):
    from roomrank.functions.text import encode_with, fit_projection, hashed_counts, projected_encoder

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, rng.integers(1, 60))) for _ in range(300)] + ["", None, "W1 w1  w2"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, text string").repartition(5)
    p = fit_projection(df, F.col("text"), 6, buckets=32)
    x = hashed_counts([t or "" for t in texts], 32)
    values, vectors = np.linalg.eigh(x.T @ x)
    assert np.allclose(p @ (x.T @ x), values[::-1][:6, None] * p) and np.allclose(p @ p.T, np.eye(6))
    out = {r["review_id"]: r["vec"] for r in encode_with(df, "review_id", "text", projected_encoder(p, 32), 6).collect()}
    assert np.allclose(np.stack([out[i] for i in range(len(texts))]), x @ p.T)
