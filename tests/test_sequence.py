"""Skew-safe numbering equals a plain row_number, also when groups span partitions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from roomrank.operators.sequence import number_within_group, sequential_id


def _expected(pdf, group, order):
    s = pdf.sort_values(group + order)
    s["exp"] = s.groupby(group).cumcount() if group else np.arange(len(s))
    return s


def test_hot_group_spans_partitions(spark):
    rng = np.random.default_rng(1)
    n = 3000
    grp = np.where(rng.random(n) < 0.34, 7, rng.integers(0, 50, n))  # one key holds a third of the rows
    pdf = pd.DataFrame({"g": grp.astype("int64"), "k": rng.permutation(n).astype("int64")})
    df = spark.createDataFrame(pdf)
    out = number_within_group(df, ["g"], ["k"], name="rn", num_partitions=16).toPandas()
    exp = _expected(pdf, ["g"], ["k"])
    m = out.merge(exp, on=["g", "k"])
    assert len(m) == n and (m["rn"] == m["exp"]).all()


def test_string_and_null_keys(spark):
    pdf = pd.DataFrame({"g": ["a", None, "b", "a", None, "b", "a"], "k": [5, 1, 2, 3, 4, 1, 0]})
    df = spark.createDataFrame(pdf, "g string, k long")
    out = number_within_group(df, ["g"], ["k"], name="rn", start=1, num_partitions=3).toPandas()
    got = {(r.g, r.k): r.rn for r in out.itertuples()}
    assert got[("a", 0)] == 1 and got[("a", 3)] == 2 and got[("a", 5)] == 3
    assert got[(None, 1)] == 1 and got[(None, 4)] == 2
    assert got[("b", 1)] == 1 and got[("b", 2)] == 2


def test_global_sequence_gap_free(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = sequential_id(df, ["k"], name="ID", start=1, num_partitions=9).toPandas().sort_values("k")
    assert list(out["ID"]) == list(range(1, 1001))


def test_same_result_for_any_partition_count(spark):
    df = spark.range(0, 500).select((F.col("id") % 13).alias("g"), F.col("id").alias("k"))
    a = number_within_group(df, ["g"], ["k"], num_partitions=1).toPandas().sort_values("k")["rn"].tolist()
    b = number_within_group(df, ["g"], ["k"], num_partitions=16).toPandas().sort_values("k")["rn"].tolist()
    assert a == b


def test_numbering_under_union_and_coalesce(spark):
    # the job may run with other partition ids (union) or merged partitions (coalesce)
    df = spark.range(0, 400).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    n = number_within_group(df, ["g"], ["k"], num_partitions=8)
    expected = sorted((r["g"], r["k"], r["k"] // 3) for r in df.collect())
    both = n.unionByName(n).toPandas()
    assert sorted(map(tuple, both[["g", "k", "rn"]].drop_duplicates().values.tolist())) == expected
    assert len(both) == 800
    merged = n.coalesce(1).toPandas()
    assert sorted(map(tuple, merged[["g", "k", "rn"]].values.tolist())) == expected


def test_numbering_stays_in_the_jvm(spark):
    df = spark.range(0, 300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    for group in (["g"], []):
        n = number_within_group(df, group, ["k"], num_partitions=6)
        plan = n._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan and "Python" not in plan
        assert "BroadcastHashJoin" in plan


def test_keys_of_all_types(spark):
    df = spark.sql("""SELECT g, k FROM VALUES (named_struct('a', 1.5BD, 'b', date'2020-01-01')), (named_struct('a', NULL, 'b', date'2020-01-02')) AS t(g),
                      (SELECT explode(array(double('nan'), -3.5D, NULL, 1e300D, 7.5D)) AS k)""")
    for p in (1, 4):
        out = number_within_group(df, ["g"], ["k"], num_partitions=p).collect()
        by_group = {}
        for r in out:
            by_group.setdefault(str(r.g), {})[r.rn] = str(r.k)
        assert len(by_group) == 2
        assert all([v[i] for i in range(5)] == ["None", "-3.5", "7.5", "1e+300", "nan"] for v in by_group.values())


def test_empty_table(spark):
    assert number_within_group(spark.createDataFrame([], "g string, k long"), ["g"], ["k"]).count() == 0
    assert sequential_id(spark.createDataFrame([], "k long"), ["k"]).count() == 0
