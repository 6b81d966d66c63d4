"""Model jobs, weights table, caches, CSV sources and sinks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from roomrank.operators import models as M
from roomrank.sources.cache import read_through
from roomrank.sources.tables import USER_SCHEMA, load_split


def test_distributed_forward_equals_numpy(spark):
    layers = M.init_mlp([4, 8, 3], seed=1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "id long, v array<double>")
    got = M.encode(df, "id", "v", layers).toPandas().sort_values("id")
    assert np.allclose(np.stack(got["emb"].to_numpy()), M.forward(x, layers))


def test_weights_roundtrip(spark, tmp_path):
    models = {"user": M.init_mlp([3, 5, 2], seed=0)}
    M.save_weights(spark, models, str(tmp_path / "w"))
    back = M.load_weights(spark, str(tmp_path / "w"))
    for a, b in zip(models["user"], back["user"]):
        assert np.array_equal(a.w, b.w) and np.array_equal(a.b, b.b) and a.activation == b.activation


def test_bridge_block_equals_pairwise():
    bridge = M.init_mlp([6, 6, 4, 1], seed=3)
    sc = M.BridgeScorer(bridge, 3)
    rng = np.random.default_rng(4)
    q, it = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
    mat = sc.matrix(q, it)
    for i in range(4):
        for j in range(5):
            assert abs(mat[i, j] - M.forward(np.concatenate([q[i], it[j]])[None, :], bridge)[0, 0]) < 1e-12
    assert np.allclose(sc.paired(q[:3], it[:3]), np.diag(mat[:3, :3]))


def test_mllib_weight_layout_matches_model(spark):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    model = MultilayerPerceptronClassifier(layers=[4, 5, 2], maxIter=30, seed=1).fit(df)
    layers = M.mllib_layers(model.weights.toArray(), [4, 5, 2])
    raw = np.stack([r["rawPrediction"].toArray() for r in model.transform(df).collect()])
    assert np.allclose(M.forward(x, layers), raw, atol=1e-8)


def test_dual_fit_loss_falls(spark):
    from roomrank.plans.jobs import dual_fit
    rows = {r["step"]: r["value"] for r in dual_fit(spark, "/root/testdata/sf0.001").collect()}
    assert rows["epoch_4_loss"] < rows["epoch_0_loss"]
    assert 0.0 <= rows["val_mrr_matched"] <= 1.0


def test_csv_split_loader(spark, tmp_path):
    d = tmp_path / "Data"
    d.mkdir()
    (d / "test_users.csv").write_text(",".join(f.name for f in USER_SCHEMA.fields) + "\n"
                                      "1,DE,couple,5,FR,hotel,,7.5,2,6\n")
    (d / "test_reviews.csv").write_text("review_id,accommodation_id,review_title,review_positive,review_negative,"
                                        "review_score,review_helpful_votes\n9,5,t,,n,8.0,1\n")
    users, reviews, matches = load_split(spark, str(d), "test")
    assert matches is None
    u = users.first()
    assert u["accommodation_star_rating"] is None and u["room_nights"] == 2
    assert reviews.first()["review_positive"] is None


def test_read_through_builds_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    key = {"test": np.random.default_rng().integers(1 << 30)}
    a = read_through(spark, "t", key, build).count()
    b = read_through(spark, "t", key, build).count()
    assert a == b == 5 and len(calls) == 1


def test_csv_roundtrip_equal(spark, sf_small):
    from roomrank.plans.jobs import csv_roundtrip
    from roomrank.plans.queries import top10_wide
    a = csv_roundtrip(spark, sf_small)
    b = top10_wide(spark, sf_small)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_split_csv_layout_keeps_texts_exactly(spark, tmp_path):
    from roomrank.sources.tables import MATCH_SCHEMA, REVIEW_SCHEMA, write_split
    texts = ["ends with a space ", "  leading", 'a "quoted" word', "two\nlines\n", None]
    reviews = spark.createDataFrame([(i, 5, t, t, "n", 8.0, 1) for i, t in enumerate(texts)], REVIEW_SCHEMA)
    users = spark.createDataFrame([(1, "DE", "couple", 5, "FR", "hotel", None, 7.5, 2, 6)], USER_SCHEMA)
    matches = spark.createDataFrame([(1, 0, 5)], MATCH_SCHEMA)
    write_split(users, reviews, matches, str(tmp_path), "train")
    u, r, m = load_split(spark, str(tmp_path), "train")
    got = {row["review_id"]: row["review_positive"] for row in r.collect()}
    assert [got[i] for i in range(len(texts))] == texts
    assert u.count() == 1 and m.first()["review_id"] == 0


def test_escaped_csv_is_read_line_by_line_and_keeps_texts(spark, tmp_path):
    from roomrank.sources.tables import MATCH_SCHEMA, REVIEW_SCHEMA, write_split

    texts = ["a\nb", "a\r\nb", "%0A", "50%", "", None, ' "q", ', "%00", "\n"]
    reviews = spark.createDataFrame([(i, 1, t, t, "x", 1.0, 0) for i, t in enumerate(texts)], REVIEW_SCHEMA)
    users = spark.createDataFrame([], USER_SCHEMA)
    write_split(users, reviews, spark.createDataFrame([], MATCH_SCHEMA), str(tmp_path), "val", escaped=True)
    _, back, _ = load_split(spark, str(tmp_path), "val", escaped=True)
    assert [r["review_title"] for r in back.orderBy("review_id").collect()] == texts


def test_cache_misses_new_input_files_and_has_one_place_in_every_session(spark, tmp_path):
    from roomrank.sources.cache import cache_path, input_digest
    from roomrank.session import shared_root

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    one = input_digest(spark, str(tmp_path))
    assert one == input_digest(spark, str(tmp_path))
    spark.range(4).write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert one != input_digest(spark, str(tmp_path))
    own = spark.sparkContext.getCheckpointDir().rstrip("/").rsplit("/", 1)[1]
    assert own not in cache_path(spark, "x", {}) and cache_path(spark, "x", {}).startswith(shared_root(spark))


def test_csv_roundtrip_on_two_inputs(spark):
    from roomrank.plans.jobs import csv_roundtrip

    a, b = csv_roundtrip(spark, "/root/testdata/sf0.001"), csv_roundtrip(spark, "/root/testdata/sf0.01")
    assert (a.count(), b.count()) == (150, 1500)


def test_training_stops_on_a_loss_that_is_not_finite(spark):
    import pytest

    nan = float("nan")
    rows = spark.createDataFrame([(1, 0, [1, 2], [nan, 1.0], [1.0, 2.0])], "accommodation_id long, batch_id long, uids array<long>, xu array<double>, xr array<double>")
    with pytest.raises(FloatingPointError):
        M.fit_dual_encoders(rows, 1, 1, k=2, epochs=2, seed=0)


def test_runs_outside_the_repository(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "print('ROWS', E.entry(s).count())\n") % str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]


def test_scorer_of_other_encoders_is_refused(spark, tmp_path):
    import pytest

    a = {"user": M.init_mlp([3, 2], seed=0), "review": M.init_mlp([3, 2], seed=1)}
    b = {"user": M.init_mlp([3, 2], seed=2), "review": M.init_mlp([3, 2], seed=1)}
    M.save_scorer(spark, M.init_mlp([4, 1], seed=3), a, str(tmp_path / "s"))
    assert len(M.load_scorer(spark, str(tmp_path / "s"), a)) == 1
    with pytest.raises(ValueError, match="not fitted"):
        M.load_scorer(spark, str(tmp_path / "s"), b)


def test_half_written_cache_entry_is_never_read(spark):
    """A build that died leaves its folder; readers build anew, and the first published table stays."""
    import uuid

    from roomrank.sources.cache import _publish, cache_path, entry_path
    key = {"test": uuid.uuid4().hex}
    entry = cache_path(spark, "half", key)
    spark.range(2).write.parquet(f"{entry}/attempt-died")
    assert entry_path(spark, "half", key) is None
    assert read_through(spark, "half", key, lambda: spark.range(5)).count() == 5
    first = entry_path(spark, "half", key)
    spark.range(9).write.parquet(f"{entry}/attempt-second")  # another application that began before the first one published
    _publish(spark, entry, "attempt-second")
    assert entry_path(spark, "half", key) == first
    other = spark.newSession()
    assert read_through(other, "half", key, lambda: other.range(7)).count() == 5


def test_a_reader_during_a_rebuild_sees_a_whole_table(spark):
    import uuid

    from roomrank.sources.cache import entry_path
    key = {"test": uuid.uuid4().hex}
    seen = []

    def build():
        seen.append(entry_path(spark, "whole", key))  # what a reader finds while the table is being built
        inner = read_through(spark, "whole", key, lambda: spark.range(4)).count() if len(seen) == 1 else 0
        seen.append(inner)
        return spark.range(6)

    assert read_through(spark, "whole", key, build).count() == 4  # the one published first
    assert seen == [None, 4]


def test_new_input_files_are_seen_in_the_same_session(spark, tmp_path):
    from roomrank.plans.fixture import Fixture, fixture
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    one = fixture(spark, str(tmp_path))
    assert fixture(spark, str(tmp_path) + "/") is one and isinstance(one, Fixture)
    spark.range(4).write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert fixture(spark, str(tmp_path)) is not one


def test_deep_encoders_fit_better_than_linear_ones(spark):
    from roomrank.operators import training as TR
    from roomrank.plans.jobs import DUAL_BATCH, DUAL_LR, EMB_DIM, prepared
    p = prepared(spark, "/root/testdata/sf0.001")
    rows = p.mini_batches(DUAL_BATCH, p.user_features.select("user_id", F.col("features").alias("xu")),
                          p.review_features.select("review_id", F.col("vec").alias("xr"))).withColumn("uids", F.expr("sequence(1, size(xr) div %d)" % p.dims[1]))
    linear = M.fit_dual_encoders(rows, *p.dims, k=EMB_DIM, epochs=6)[2]
    models = {"user": M.init_mlp([p.dims[0], 64, 32, EMB_DIM], 0), "review": M.init_mlp([p.dims[1], 64, 32, EMB_DIM], 1)}
    deep = TR.fit(rows, models, TR.dual_objective, p.dims, epochs=6, lr=DUAL_LR).losses
    assert deep[-1] < deep[0] and deep[-1] < linear[-1]
