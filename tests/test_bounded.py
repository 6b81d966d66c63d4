"""Bounded top-k gives what the full scan gives, and leaves blocks unopened where vectors are clustered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomrank.operators.bounded import bounded_top_k
from roomrank.operators.scoring import top_k

NAMES = dict(grp="g", qid="u", qvec="vec", iid="i", ivec="vec")


def _tables(spark, rng, n_items=6000, n_users=2400, dim=8, spread=0.1):
    """Clustered vectors of several lengths; group 0 holds about half of all rows."""
    centres = rng.normal(size=(24, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def side(n):
        g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
        v = centres[rng.integers(0, 24, n)] + spread * rng.normal(size=(n, dim)) / np.sqrt(dim)
        return g, np.round(v * 2.0 ** rng.integers(-2, 2, n)[:, None], 3)

    gi, iv = side(n_items)
    gu, uv = side(n_users)
    items = spark.createDataFrame([(int(g), i, v.tolist()) for i, (g, v) in enumerate(zip(gi, iv, strict=True))], "g long, i long, vec array<double>")
    users = spark.createDataFrame([(int(g), u, v.tolist()) for u, (g, v) in enumerate(zip(gu, uv, strict=True))], "g long, u long, vec array<double>")
    return users, items


def _list(df):
    return sorted(tuple(r) for r in df.select("u", "rank", "i", "score", "itie").collect())


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_equals_the_full_scan_and_opens_fewer_blocks(spark, metric):
    users, items = _tables(spark, np.random.default_rng(5))
    plan = bounded_top_k(users, items, k=10, metric=metric, block=32, **NAMES)
    assert _list(plan.top("u", "i")) == _list(top_k(users, items, k=10, metric=metric, block=32, **NAMES))
    share = plan.opened().first()
    assert share.pairs_opened < 0.6 * share.pairs_all
    hot = plan.query_blocks.where("grp = 0").select("qb")
    opened = plan.rest.join(hot, "qb").count() + hot.count()
    assert opened < 0.6 * hot.count() * plan.item_blocks.where("grp = 0").count()
    assert plan.rest.groupBy("qb", "ib").count().where("count > 1").count() == 0


def test_vectors_without_structure_ties_and_odd_values(spark):
    rng = np.random.default_rng(6)
    nan = float("nan")
    users = [(1, u, [float(x) for x in rng.integers(-2, 3, 3)]) for u in range(80)] + [(2, 200, [1.0, 0.0, 0.0]), (3, 201, [1.0, 1.0, 1.0]), (None, 202, [1.0] * 3),
             (1, 203, [0.0, 0.0, 0.0]), (1, 204, [nan, 1.0, 0.0])]
    items = [(1, i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(150)] + [(1, 300, [nan, 0.0, 1.0]), (1, 301, [1e-7, 0.0, 0.0]), (1, 302, [0.0] * 3),
             (2, 303, [0.5, 0.5, 0.0]), (2, 304, [0.5, 0.5, 0.0]), (None, 305, [1.0] * 3)]
    users = spark.createDataFrame(users, "g long, u long, vec array<double>").withColumn("s", F.lit("x"))
    items = spark.createDataFrame(items, "g long, i long, vec array<double>").withColumn("grp", F.lit(1))
    for metric in ("dot", "cosine"):
        for k in (3, 200):
            plan = bounded_top_k(users, items, k=k, metric=metric, block=8, **NAMES)
            assert _list(plan.top("u", "i")) == _list(top_k(users, items, k=k, metric=metric, block=8, **NAMES))


def test_empty_tables_and_other_metrics(spark):
    users, items = _tables(spark, np.random.default_rng(7), 20, 10)
    for u, i in ((users.where("false"), items), (users, items.where("false"))):
        plan = bounded_top_k(u, i, **NAMES)
        assert plan.top("u", "i").count() == 0 and tuple(plan.opened().first()) == (0, 0)
    with pytest.raises(ValueError):
        bounded_top_k(users, items, metric="euclid", **NAMES)
