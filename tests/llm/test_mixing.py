import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomrank.llm import mixing
from roomrank.llm.queries import op1_mixing
from roomrank.llm.shared import table


def deviations(got: list, w: dict) -> float:
    """The largest difference of a source's blocks from its exact share of the slots, at any slot."""
    names = list(w)
    at = {s: i for i, s in enumerate(names)}
    share = np.array([w[s] for s in names]) / sum(w.values())
    had, worst = np.zeros(len(names)), 0.0
    for t, s in enumerate(got, 1):
        had[at[s]] += 1
        worst = max(worst, np.abs(had - share * t).max())
    return worst


def planned(spark, w: dict, blocks: int, period: int = mixing.PERIOD) -> list:
    shares = mixing.shares_of(spark.createDataFrame(list(w.items()), "source string, weight double"))
    n = spark.createDataFrame([(s, blocks) for s in w], "source string, blocks long")
    return mixing.schedule(shares, n, period).orderBy("slot").collect()


@pytest.mark.parametrize("m,period", [(1, 10), (2, 7), (5, 64), (20, 300), (20, 50)])
def test_schedule_deviates_by_less_than_a_block_from_the_exact_weights(spark, m, period):
    rng = random.Random(m * period)
    w = {f"s{i}": rng.random() ** 2 + 0.01 for i in range(m)}
    w["s0"] += m / 10
    plan = planned(spark, w, 30, period)
    assert [r.slot for r in plan] == list(range(len(plan)))
    mine = defaultdict(list)
    for r in plan:
        mine[r.source].append(r.block)
    assert all(b == list(range(len(b))) and len(b) >= 30 for b in mine.values())
    assert deviations([r.source for r in plan], w) < 1 + 1e-9


@pytest.mark.parametrize("m", [20, 500, 2000])
def test_a_heavy_source_keeps_its_weight_among_many(spark, m):
    w = {f"s{i}": 0.7 / (m - 1) for i in range(1, m)} | {"hot": 0.3}
    plan = planned(spark, w, 1)
    assert deviations([r.source for r in plan], w) < 1 + 1e-9
    assert abs(sum(r.source == "hot" for r in plan) - 0.3 * len(plan)) < 1


def test_places_do_not_depend_on_the_columns_names(spark):
    rows = [(i, f"s{i % 3}", f"t{i}", i * 10, "x", i, "y") for i in range(200)]
    names = "doc_id long, source string, text string, _row long, _at string, key long, slot string"
    docs = spark.createDataFrame(rows, names)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)


def test_query_holds_the_weights_and_keeps_all_rows(spark, sf_small):
    rows = op1_mixing(spark, sf_small).collect()
    docs = table(spark, sf_small, "documents").select("doc_id", "source").collect()
    assert sorted((r.doc_id, r.source) for r in rows) == sorted((r.doc_id, r.source) for r in docs)
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    sizes = Counter(r.source for r in docs)
    of_source = defaultdict(list)
    for r in rows:
        of_source[r.source].append(r)
    for s, mine in of_source.items():
        blocks = defaultdict(list)
        for r in mine:
            blocks[r.block].append(r)
        assert sorted(blocks) == list(range(math.ceil(sizes[s] / mixing.BLOCK_ROWS)))
        assert all(len({r.slot for r in b}) == 1 for b in blocks.values())
        order = [blocks[b][0].slot for b in sorted(blocks)]
        assert order == sorted(order)


def test_given_weights_and_hot_source(spark):
    rows = [(i, "hot" if i % 3 == 0 or i % 10 else f"s{i % 4}") for i in range(3000)]
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 3.0)], "source string, weight double")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, period=100).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    by = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(7), weights, period=100).collect()
    assert {(r.doc_id, r.slot, r.place) for r in out} == {(r.doc_id, r.slot, r.place) for r in by}


def test_odd_rows(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and len({(r.slot, r.place) for r in out}) == len(out)
    assert mixing.mix(no_docs).count() == 0
    ordered = mixing.mixed(odd)
    assert ordered.columns == odd.columns and sorted(map(str, ordered.collect())) == sorted(map(str, odd.collect()))
    assert mixing.mixed(no_docs).count() == 0


def test_no_python_in_the_plan(spark, sf_small):
    plan = mixing.mixed(table(spark, sf_small, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
