"""Encoder semantics: FIXTURES.md section C cases and properties."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roomrank.operators import features as FE


def _users(spark, rows):
    # tuples, not a pandas frame: pandas would turn None into NaN instead of SQL null
    cols = ["user_id", "split", "room_nights", "accommodation_star_rating", "guest_country"]
    data = list(zip(*[rows[c] for c in cols]))
    return spark.createDataFrame(data, "user_id long, split string, room_nights int, "
                                       "accommodation_star_rating double, guest_country string")


def test_constant_column_scales_to_zero_and_null_stays(spark):
    df = _users(spark, {"user_id": [1, 2, 3], "split": ["train"] * 3, "room_nights": [3, 3, 3],
                        "accommodation_star_rating": [1.0, None, 5.0], "guest_country": ["A", "B", None]})
    out = FE.apply_minmax(df, ["room_nights", "accommodation_star_rating"]).orderBy("user_id").toPandas()
    assert list(out["room_nights"]) == [0.0, 0.0, 0.0]
    assert out["accommodation_star_rating"][0] == 0.0 and out["accommodation_star_rating"][2] == 1.0
    assert pd.isna(out["accommodation_star_rating"][1])


def test_frequency_null_category_filled_with_mode_smallest_on_tie(spark):
    # frequencies 0.2, 0.2, 0.4, 0.4 over rows -> mode tie -> 0.2
    rows = {"user_id": list(range(1, 7)), "split": ["train"] * 6, "room_nights": [1] * 6,
            "accommodation_star_rating": [1.0] * 6,
            "guest_country": ["A", "B", "C", "C", None, None]}
    df = _users(spark, rows)
    out = FE.apply_frequencies(df, cols=["guest_country"], fill_mode=("guest_country",)).orderBy("user_id").toPandas()
    assert out["count_guest_country"].tolist()[:4] == [0.25, 0.25, 0.5, 0.5]
    # frequency column values: 0.25 x2, 0.5 x2 -> tie -> smallest = 0.25
    assert out["count_guest_country"].tolist()[4:] == [0.25, 0.25]


@pytest.mark.parametrize("n,bits", [(3, 2), (4, 3), (1, 1), (7, 3), (8, 4)])
def test_bit_width(spark, n, bits):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "user_id long, c string")
    _, b = FE.fit_binary_domain(df, "c")
    assert b == bits == max(1, math.ceil(math.log2(n + 1)))


def test_binary_null_and_unseen_are_zero_and_bits_decode(spark):
    fit = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id long, c string")
    dom, bits = FE.fit_binary_domain(fit, "c")
    data = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "zzz")], "user_id long, c string")
    out = FE.apply_binary(data, "c", dom, bits).orderBy("user_id").toPandas()
    codes = [sum(int(r[f"c_{i}"]) << (bits - 1 - i) for i in range(bits)) for _, r in out.iterrows()]
    assert codes == [1, 2, 3, 0, 0]


def test_onehot_sums_to_one(spark, sf_small):
    from roomrank.plans.fixture import fixture
    users = fixture(spark, sf_small).users
    codes, sizes = FE.fit_codes(users.select(F.lit("guest_type").alias("col"), F.col("guest_type").alias("value")))
    n = sizes["guest_type"]
    enc = FE.apply_onehot(users, "guest_type", codes, n)
    s = enc.select(F.aggregate(FE.onehot_array(F.col("guest_type_index"), n), F.lit(0.0), lambda a, x: a + x).alias("s")).distinct().collect()
    assert [r["s"] for r in s] == [1]


def test_codes_are_the_same_for_every_size(spark):
    """Small, large and numeric domains take one way: ordinals in the byte order of the value's text."""
    for values in (["b", "a", "c"], [f"v{i}" for i in range(3000)], list(range(1, 13))):
        rows = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], f"c {'string' if isinstance(values[0], str) else 'int'}")
        dom, bits = FE.fit_binary_domain(rows, "c")
        want = {str(v): i + 1 for i, v in enumerate(sorted(map(str, values)))}
        assert {r["value"]: r["code"] for r in dom.collect()} == want
        out = FE.apply_binary(rows.distinct(), "c", dom, bits).collect()
        got = {r["c"]: sum(r[f"c_{i}"] << (bits - 1 - i) for i in range(bits)) for r in out}
        assert got.pop(None) == 0 and {str(k): v for k, v in got.items()} == want
    one = FE.apply_onehot(spark.createDataFrame([(f"v{i}",) for i in range(3000)], "c string"), "c", *_codes_of(spark, 3000))
    assert one.agg(F.countDistinct("c_index")).first()[0] == 3000


def _codes_of(spark, n):
    codes, sizes = FE.fit_codes(spark.createDataFrame([("c", f"v{i}") for i in range(n)], "col string, value string"))
    return codes, sizes["c"]


def test_user_features_properties(spark, sf_small):
    from roomrank.plans.fixture import fixture
    u, widths = FE.build_user_features(fixture(spark, sf_small).users)
    scaled = [c for c in FE.SCALE_COLS]
    row = u.agg(*[F.min(c).alias(f"lo_{c}") for c in scaled], *[F.max(c).alias(f"hi_{c}") for c in scaled],
                F.countDistinct(F.size("features")).alias("widths"), F.max(F.size("features")).alias("w")).first()
    for c in scaled:
        assert 0.0 <= row[f"lo_{c}"] and row[f"hi_{c}"] <= 1.0
    assert row["widths"] == 1 and row["w"] == sum(widths.values())


def test_drift_anchor(spark):
    from roomrank.plans.queries import drift_summary
    rows = {r["feature"]: r for r in drift_summary(spark, "/root/testdata/sf0.01").collect()}
    assert rows["guest_id"]["unseen_rows"] == 4361


def test_rows_of_a_hot_accommodation_spread_without_aqe(spark):
    """One accommodation holds a third of the users: no task has over twice the mean rows, the means are the plain ones."""
    from pyspark.sql import functions as F

    from roomrank.operators.features import apply_group_means

    users = spark.range(0, 12_000).select(
        F.col("id").alias("user_id"), F.lit("train").alias("split"), F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 1999).cast("long").alias("accommodation_id"), (F.col("id") % 7).cast("double").alias("x"))
    plain = users.groupBy("split", "accommodation_id").agg(F.avg("x").alias("average_x"))
    want = {r.user_id: r.average_x for r in users.join(plain, ["split", "accommodation_id"], "left").collect()}
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = apply_group_means(users, cols=["x"])
        assert {r.user_id: r.average_x for r in out.collect()} == want
        tasks = [r["count"] for r in out.where("accommodation_id is not null").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(tasks) <= 2 * sum(tasks) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
