"""User and review feature encoders.

Fit / transform are separate: every ``fit_*`` returns a small DataFrame, every ``apply_*`` joins it back. Statistics are grouped aggregates
(partial aggregation before the shuffle), never windows over a whole key, so a hot
accommodation or category is summed map-side instead of landing in one task.

Fitting is per split by default (``by=("split",)``), as the reference fits its encoders on
each split separately; pass ``by=()`` to fit on whatever frame is given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrank.operators.scoring import hot_key_join, hot_keys
from roomrank.operators.sequence import number_within_group
from roomrank.session import materialize

# Column groups of the user feature build (fixed by the reference's feature set).
TARGET_COLS = ["guest_country", "accommodation_country", "accommodation_type"]
AVG_COLS = ["accommodation_star_rating", "accommodation_score", "room_nights"]
COUNT_COLS = ["guest_country", "guest_type", "accommodation_country"]
ONEHOT_COL = "guest_type"
SCALE_COLS = ["accommodation_score", "month", "room_nights", "accommodation_star_rating",
              "average_accommodation_star_rating", "average_accommodation_score", "average_room_nights"]
REVIEW_SCALE_COLS = ["review_score", "review_helpful_votes"]
FILL_MODE_COLS = ("guest_country",)


# --------------------------------------------------------------------- D1, C9
def fit_group_means(users: DataFrame, key: str = "accommodation_id", cols=AVG_COLS, by=("split",)) -> DataFrame:
    """One row per (fit key, ``key``): ``average_<c>`` = mean of ``c`` (nulls ignored)."""
    return users.groupBy(*by, key).agg(*[F.avg(c).alias(f"average_{c}") for c in cols])


def apply_group_means(users: DataFrame, key: str = "accommodation_id", cols=AVG_COLS, by=("split",), spread=("user_id",)) -> DataFrame:
    """``average_<c>`` = mean of ``c`` over the rows sharing ``key`` (nulls ignored).

    A grouped aggregate joined back, not a window: a window over an unbounded frame buffers a whole accommodation in one
    task. The rows of a key that holds more than 1 / 512 of them are dealt to salts by a hash of the ``spread`` columns.
    """
    keys = [*by, key]
    fitted = materialize(users.groupBy(*keys).agg(*[F.avg(c).alias(f"average_{c}") for c in cols], F.count(F.lit(1)).alias("_n")))
    return hot_key_join(users, fitted.drop("_n"), keys, hot_keys(fitted, keys), list(spread), "left")


# --------------------------------------------------------------------- D2, D3, B6, D6
BROADCAST_ROWS = 100_000  # a fit table is broadcast only when it was counted and has at most this many rows


def _joined(df: DataFrame, small: DataFrame, on, rows: int) -> DataFrame:
    """Left join with a fit table of ``rows`` (counted) rows: broadcast up to ``BROADCAST_ROWS``, else a shuffle join."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, "left")


def _per_split(by) -> bool:
    """One row per split (or one at all): the only fit keys whose tables are known to be tiny."""
    return set(by) <= {"split", "_fit"}


def _tiny(df: DataFrame, by) -> DataFrame:
    return F.broadcast(df) if _per_split(by) else df


def fit_value_counts(rows: DataFrame, cols, by=("split",)) -> DataFrame:
    """``(by, col, value, k)``: rows per non-null value of several columns, from ONE scan (values as text).

    Frequencies, modes, domains and codes all follow from this table.
    """
    stacked = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                                                   for c in cols])).alias("x"))
    return (stacked.where(F.col("x.value").isNotNull()).groupBy(*by, F.col("x.col").alias("col"), F.col("x.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("k")))


def value_shares(counts: DataFrame, by) -> DataFrame:
    """``(by, col, value, k, share)``: each value's share of its column's non-null rows."""
    totals = counts.groupBy(*by, "col").agg(F.sum("k").alias("_t"))
    return counts.join(_tiny(totals, by), [*by, "col"]).select(*by, "col", "value", "k", (F.col("k") / F.col("_t")).alias("share"))


def share_modes(shares: DataFrame, by) -> DataFrame:
    """``(by, col, mode)``: the share carried by the most rows (a value of ``k`` rows puts its share on
    ``k`` rows), the smallest on ties."""
    carried = shares.groupBy(*by, "col", "share").agg(F.sum("k").alias("_rows"))
    return carried.groupBy(*by, "col").agg(F.min_by(F.col("share"), F.struct((-F.col("_rows")).alias("r"), F.col("share"))).alias("mode"))


def _fit_key(df: DataFrame, by):
    """A global fit uses a constant key, so every fit is an equi-join to a tiny table."""
    if by:
        return df, tuple(by), []
    return df.withColumn("_fit", F.lit(0)), ("_fit",), ["_fit"]


def fit_frequencies(users: DataFrame, col: str, by=("split",)) -> DataFrame:
    """Normalised value counts of ``col``; nulls are left out of numerator and denominator."""
    shares = value_shares(fit_value_counts(users, [col], by), by)
    return shares.select(*by, F.col("value").cast(users.schema[col].dataType).alias(col), F.col("share").alias(f"count_{col}"))


def _join_frequencies(users: DataFrame, shares: DataFrame, cols, by, fill_mode, rows: int) -> DataFrame:
    modes = share_modes(shares, by)
    for c in cols:
        name = f"count_{c}"
        mine = shares.where(F.col("col") == c).select(*by, F.col("value").alias("_v"), F.col("share").alias(name))
        users = _joined(users.withColumn("_v", F.col(c).cast("string")), mine, [*by, "_v"], rows).drop("_v")
        if c in fill_mode:
            mode = modes.where(F.col("col") == c).select(*by, F.col("mode").alias("_mode"))
            users = (users.join(_tiny(mode, by), list(by), "left")
                     .withColumn(name, F.coalesce(F.col(name), F.col("_mode"))).drop("_mode"))
    return users


def apply_frequencies(users: DataFrame, cols=COUNT_COLS, by=("split",), fill_mode=("guest_country",)) -> DataFrame:
    """``count_<c>`` per row; null shares of the ``fill_mode`` columns take the column's mode."""
    users, by, extra = _fit_key(users, by)
    counts = materialize(fit_value_counts(users, cols, by))
    return _join_frequencies(users, value_shares(counts, by), cols, by, fill_mode, counts.count()).drop(*extra)


# --------------------------------------------------------------------- D4, G4, G5, D5
def fit_minmax(df: DataFrame, cols, by=("split",)) -> DataFrame:
    """One row per fit key: ``min_<c>``, ``max_<c>`` (nulls ignored)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}")]
    return df.groupBy(*by).agg(*aggs)


def minmax_expr(c: str) -> Column:
    lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
    x = F.col(c).cast("double")
    # constant column -> 0 (range treated as 1); null stays null
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(x - lo)


def apply_minmax(df: DataFrame, cols, by=("split",), suffix: str = "") -> DataFrame:
    df, by, extra = _fit_key(df, by)
    stats = fit_minmax(df, cols, by)
    j = df.join(_tiny(stats, by), list(by), "left")
    out = j.withColumns({f"{c}{suffix}": minmax_expr(c) for c in cols})
    return out.drop(*[f"{p}_{c}" for c in cols for p in ("min", "max")], *extra)


# --------------------------------------------------------------------- D6, G1, G2, G3
def fit_codes(values: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``(col, value)`` rows, repeats allowed -> ``(col, value, code)`` and the number of values per column.

    One way for every size: the distinct values of each column are numbered from 1 in the byte order
    of their text by the distributed numbering; only the highest code per column is read back.
    """
    codes = number_within_group(values.select("col", "value").distinct(), ["col"], ["value"], name="code", start=1)
    sizes = {r["col"]: r["n"] for r in codes.groupBy("col").agg(F.max("code").alias("n")).collect()}
    return codes, sizes


def _values(users: DataFrame, cols) -> DataFrame:
    return fit_value_counts(users, cols, ()).select("col", "value")


def bit_width(n: int) -> int:
    return max(1, math.ceil(math.log2(n + 1)))


def join_code(df: DataFrame, col: str, codes: DataFrame, n: int) -> DataFrame:
    """``_code_<col>``: the value's code; 0 for null and for values unseen at fit time."""
    mine = codes.where(F.col("col") == col).select(F.col("value").alias("_v"), F.col("code").alias(f"_code_{col}"))
    j = _joined(df.withColumn("_v", F.col(col).cast("string")), mine, "_v", n).drop("_v")
    return j.withColumn(f"_code_{col}", F.coalesce(F.col(f"_code_{col}"), F.lit(0)))


def bits_of(code: Column, bits: int) -> list[Column]:
    """The bits of a code, most significant first."""
    return [F.shiftright(code, bits - 1 - i).bitwiseAND(1).cast("int") for i in range(bits)]


def fit_binary_domain(users: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Codes of ``col`` over all splits and the bit width ``ceil(log2(n + 1))``.

    Our stated rules (the reference's ordinal follows file order): null -> code 0, values unseen at
    fit time -> code 0, ordinals from 1 in value order, most significant bit first.
    """
    codes, sizes = fit_codes(_values(users, [col]))
    return codes, bit_width(sizes.get(col, 0))


def apply_binary(users: DataFrame, col: str, codes: DataFrame, bits: int) -> DataFrame:
    j = join_code(users, col, codes, 2 ** bits)
    return j.withColumns({f"{col}_{i}": b for i, b in enumerate(bits_of(F.col(f"_code_{col}"), bits))}).drop(f"_code_{col}")


def apply_onehot(users: DataFrame, col: str, codes: DataFrame, n: int) -> DataFrame:
    """``<col>_index``: the place of the one in the row's one-hot vector of ``n``, 0 if it has none (the sparse form, any domain)."""
    return join_code(users, col, codes, n).withColumnRenamed(f"_code_{col}", f"{col}_index")


def onehot_array(index: Column, n: int) -> Column:
    """The dense vector of a one-hot index, as doubles."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i == index).cast("double")) if n else F.array().cast("array<double>")


# --------------------------------------------------------------------- G7
def build_user_features(users: DataFrame, by=("split",), domain_users: DataFrame | None = None):
    """Whole user feature build; returns ``(frame, widths)``.

    ``frame`` keeps ``user_id``, ``accommodation_id``, ``split``, the scaled columns and a ``features``
    array: frequencies, the bits of each coded column, the one-hot vector, the scaled columns and the
    month mean; ``widths`` gives the length of each part in that order. Codes come from
    ``domain_users`` (default: the given users, i.e. the union of the splits present).

    The users are scanned once for the value counts (frequencies, modes, domains and codes follow from
    them), once for means and extremes per accommodation (per split from those), and once for the rows.
    """
    base, by, extra = _fit_key(users, by)
    coded = [*TARGET_COLS, ONEHOT_COL]
    counts = materialize(fit_value_counts(base, dict.fromkeys([*COUNT_COLS, *coded]), by))
    n_counts = counts.count()
    domain = counts if domain_users is None else fit_value_counts(domain_users, coded, ())
    codes, sizes = fit_codes(domain.where(F.col("col").isin(coded)).select("col", "value"))

    raw = [c for c in SCALE_COLS if not c.startswith("average_")]
    avg = [c for c in SCALE_COLS if c.startswith("average_")]
    per_group = base.groupBy(*by, "accommodation_id").agg(
        *[F.avg(c).alias(f"average_{c}") for c in AVG_COLS],
        *[f(c).cast("double").alias(f"{n}_{c}") for c in raw for n, f in (("min", F.min), ("max", F.max))],
        F.sum("month").alias("_month"), F.count("month").alias("_months"), F.count(F.lit(1)).alias("_n"))
    per_group = materialize(per_group)
    stats = per_group.groupBy(*by).agg(
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in raw for n, f in (("min", F.min), ("max", F.max))],
        *[f(c).alias(f"{n}_{c}") for c in avg for n, f in (("min", F.min), ("max", F.max))],
        (F.sum("_month") / F.sum("_months")).alias("_month"))
    lo, hi = F.col("min_month"), F.col("max_month")  # the mean of the scaled month is the scaled mean
    stats = stats.withColumn("average_month", F.when(hi > lo, (F.col("_month") - lo) / (hi - lo)).otherwise(F.col("_month") - lo)).drop("_month")

    keys = [*by, "accommodation_id"]
    u = hot_key_join(base, per_group.select(*keys, *avg), keys, hot_keys(per_group, keys), ["user_id"], "left")
    u = _join_frequencies(u, value_shares(counts, by), COUNT_COLS, by, FILL_MODE_COLS, n_counts)
    for c in coded:
        u = join_code(u, c, codes, sizes.get(c, 0))
    u = u.join(_tiny(stats, by), list(by), "left").withColumns({c: minmax_expr(c) for c in SCALE_COLS})
    bits = {c: bit_width(sizes.get(c, 0)) for c in TARGET_COLS}
    n_one = sizes.get(ONEHOT_COL, 0)
    features = F.concat(
        F.array(*[F.col(f"count_{c}").cast("double") for c in COUNT_COLS]),
        F.array(*[b.cast("double") for c in TARGET_COLS for b in bits_of(F.col(f"_code_{c}"), bits[c])]),
        onehot_array(F.col(f"_code_{ONEHOT_COL}"), n_one),
        F.array(*[F.col(c).cast("double") for c in [*SCALE_COLS, "average_month"]]))
    widths = {**{f"count_{c}": 1 for c in COUNT_COLS}, **bits, ONEHOT_COL: n_one, **{c: 1 for c in [*SCALE_COLS, "average_month"]}}
    return u.select("user_id", "accommodation_id", *([c for c in ("split",) if c in users.columns]),
                    *SCALE_COLS, features.alias("features")), widths


# --------------------------------------------------------------------- G9, C7, D9, D10, D12, S1-S4
def drift_counts(rows: DataFrame, features, seen: Column) -> DataFrame:
    """``(feature, value, n_new, n_seen)``: rows per value where ``seen`` is false and true, all features in one
    scan and one aggregation; null is a value."""
    long = rows.select(seen.alias("_seen"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"))
                                                                for f in features])).alias("x"))
    return long.groupBy("x.feature", "x.value").agg(F.count_if(~F.col("_seen")).alias("n_new"), F.count_if(F.col("_seen")).alias("n_seen"))


def drift_summary(rows: DataFrame, features, seen: Column) -> DataFrame:
    """Per feature: size of the union of both domains, and the rows on one side whose value the other side lacks."""
    return drift_counts(rows, features, seen).groupBy("feature").agg(
        F.count(F.lit(1)).alias("union_size"), F.sum(F.when(F.col("n_seen") == 0, F.col("n_new")).otherwise(0)).alias("unseen_rows"))


def drift_unseen_counts(rows: DataFrame, features, seen: Column) -> DataFrame:
    """Rows per non-null value that the other side lacks."""
    return (drift_counts(rows, features, seen).where((F.col("n_seen") == 0) & F.col("value").isNotNull())
            .select("feature", "value", F.col("n_new").alias("n")))
