"""Pluggable encoder, dense hashed vectors, evaluation cap, anti-join and seeded sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomrank.functions import text as TX
from roomrank.operators import candidates as C
from roomrank.operators import clean as K


def _make_factory():
    # built inside the test so cloudpickle ships it by value (workers cannot import tests/)
    def factory():
        import numpy as np

        def encode(texts):
            return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float64)
        return encode
    return factory


def test_encode_with_runs_in_batches_and_keeps_ids(spark):
    texts = [(i, "a b " * i) for i in range(300)]  # more rows than one encoder batch
    df = spark.createDataFrame(texts, "rid long, t string").repartition(3)
    got = {r["rid"]: r["vec"] for r in TX.encode_with(df, "rid", "t", _make_factory(), dim=2, batch_size=7).collect()}
    assert len(got) == 300
    assert all(got[i] == [float(len("a b " * i)), float(("a b " * i).count(" "))] for i in range(300))


def test_encode_with_checks_the_dimension(spark):
    df = spark.createDataFrame([(1, "x")], "rid long, t string")
    with pytest.raises(Exception, match="expected"):
        TX.encode_with(df, "rid", "t", _make_factory(), dim=3).collect()


def test_hashed_dense_vector_equals_long_form(spark):
    df = spark.createDataFrame([(1, "the cat saw the other cat"), (2, "one"), (3, "")], "id long, t string")
    long = {(r["id"], r["position"]): r["value"] for r in TX.hashed_token_counts(df, "id", F.col("t"), 8).collect()}
    dense = {r["id"]: r["vec"] for r in TX.hashed_vectors(df, "id", F.col("t"), 8).collect()}
    assert set(dense) == {1, 2}  # a text without tokens has no vector
    for i, vec in dense.items():
        assert len(vec) == 8
        assert vec == [long.get((i, p), 0.0) for p in range(1, 9)]
        assert abs(sum(v * v for v in vec) - 1.0) < 1e-12


def test_cap_examples(spark):
    df = spark.createDataFrame([(k,) for k in [5, 3, 9, 1, 7]], "k long")
    assert K.cap_examples(df, "k", -1).count() == 5
    assert [r["k"] for r in K.cap_examples(df, "k", 3).collect()] == [1, 3, 5]


def test_missing_from_keeps_duplicates_and_is_null_safe(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,)], "k long")
    other = spark.createDataFrame([(2,), (None,)], "k long")
    assert sorted(r["k"] for r in C.missing_from(df, other, "k").collect()) == [1, 1, 3]
    assert sorted(r["k"] for r in C.restrict_to(df, other, "k").collect()) == [2]  # semi join: null never matches


def test_sample_fraction_is_seeded(spark):
    df = spark.range(0, 2000)
    a = sorted(r["id"] for r in K.sample_fraction(df, 0.1, seed=3).collect())
    b = sorted(r["id"] for r in K.sample_fraction(df, 0.1, seed=3).collect())
    assert a == b and 100 < len(a) < 300
