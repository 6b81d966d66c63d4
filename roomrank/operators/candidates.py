"""Joins, candidate sets and mini-batches.

Pair volume is the scaling hazard of this workload: a group of n users and m reviews has
n * m candidate pairs. Counting queries therefore multiply group sizes instead of emitting
pairs, and scoring goes through the blocked operator in ``scoring``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomrank.operators.clean import mult_hash32
from roomrank.operators.sequence import number_within_group
from roomrank.session import materialize


def merge_single_key(users: DataFrame, reviews: DataFrame, matches: DataFrame) -> DataFrame:
    """matches JOIN reviews ON review_id JOIN users ON user_id.

    The accommodation is kept once: the matches' column (the reference keeps three copies).
    """
    m = matches.join(reviews.drop("accommodation_id"), "review_id")
    return m.join(users.drop("accommodation_id"), "user_id")


def merge_composite_key(users: DataFrame, reviews: DataFrame, matches: DataFrame) -> DataFrame:
    """Same join on both keys (C2): (review_id, accommodation_id), then (user_id, accommodation_id)."""
    m = matches.join(reviews, ["review_id", "accommodation_id"])
    return m.join(users, ["user_id", "accommodation_id"])


def restrict_to(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (C4, S4): a left-semi join."""
    return df.join(other.select(key), key, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other`` (C7, S3), duplicates kept, null-safe."""
    o = other.select(F.col(key).alias("_k")).distinct()
    return df.join(o, df[key].eqNullSafe(o["_k"]), "left_anti")


def first_match(users: DataFrame, matches: DataFrame) -> DataFrame:
    """Two-step lookup (C8, B8): each user's first match (smallest review_id) on both keys."""
    j = users.select("user_id", "accommodation_id").join(matches.select("user_id", "accommodation_id", "review_id"),
                                                         ["user_id", "accommodation_id"])
    return j.groupBy("user_id").agg(F.min("review_id").alias("review_id"))


def candidate_counts(users: DataFrame, reviews: DataFrame, key: str = "accommodation_id") -> DataFrame:
    """Per group: users, and user x review candidate pairs, from the two group sizes."""
    nu = users.groupBy(key).agg(F.count(F.lit(1)).alias("n_users"))
    nr = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"))
    return nu.join(nr, key).select(key, "n_users", (F.col("n_users") * F.col("n_reviews")).alias("n_pairs"))


def pairs_in_group(merged: DataFrame, key: str = "accommodation_id") -> DataFrame:
    """In-group user x matched-review pairs (C6): n*n pairs, n positives - counted, not emitted."""
    n = merged.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, (F.col("n") * F.col("n")).alias("pairs"), F.col("n").alias("positives"))


WHOLE = 2048  # a group of at most so many rows is kept together for all epochs


def epoch_batches(rows: DataFrame, batch_size: int, seeds, key: str = "accommodation_id", order: str = "user_id", whole: int = WHOLE) -> DataFrame:
    """``assign_batches`` for several epochs, one per seed (None: not shuffled), so that wide columns join and travel once.

    Adds ``batches``, the row's batch in each epoch, and ``epoch, part``: rows that agree in them and in the group are
    to be collected together. A group of at most ``whole`` rows is collected as one, for all epochs (epoch and part are -1); a larger
    group's rows are listed per epoch, collected per batch, with -1 in the other epochs' places. Of larger groups there
    is at most one per ``whole`` rows; their keys are broadcast.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.where(F.col("_n") > whole).select(key, F.lit(0).cast("long").alias("_large")))

    def batch(seed):
        shuffled = [] if seed is None else [mult_hash32(F.col(order) + F.lit(seed))]
        place = F.row_number().over(Window.partitionBy(key).orderBy(*shuffled, order)) - 1
        return F.floor(place / F.lit(batch_size)).cast("long")

    none = F.lit(-1).cast("long")
    few = rows.join(F.broadcast(large), key, "left").where(F.col("_large").isNull())
    of = F.coalesce(F.col("_large"), none)  # not a literal: those are dropped from grouping keys, and collecting and joining would shuffle apart
    out = few.select(*rows.columns, of.alias("epoch"), of.alias("part"), F.array(*[batch(s) for s in seeds]).alias("batches"))
    if large.isEmpty():
        return out
    many = rows.join(F.broadcast(large), key, "left_semi").select(*rows.columns)
    for e, seed in enumerate(seeds):
        listed = F.array(*[F.col("batch_id") if i == e else none for i in range(len(seeds))])
        out = out.unionByName(assign_batches(many, batch_size, key, order, seed).select(
            *rows.columns, F.lit(e).cast("long").alias("epoch"), F.col("batch_id").alias("part"), listed.alias("batches")))
    return out


def assign_batches(rows: DataFrame, batch_size: int, key: str = "accommodation_id", order: str = "user_id",
                   shuffle_seed: int | None = None) -> DataFrame:
    """``batch_id = floor(position / batch_size)`` inside each group (E8), shuffled by a seeded hash.

    Positions come from the skew-safe numbering operator, so a hot group is numbered by many
    tasks. Pass a narrow frame (ids and vectors).
    """
    r = rows
    order_cols = [order]
    if shuffle_seed is not None:
        r = r.withColumn("_shuffle", mult_hash32(F.col(order) + F.lit(shuffle_seed)))
        order_cols = ["_shuffle", order]
    n = number_within_group(r, [key], order_cols, name="_pos")
    out = n.withColumn("batch_id", F.floor(F.col("_pos") / F.lit(batch_size)).cast("long"))
    return out.drop("_pos", *(["_shuffle"] if shuffle_seed is not None else []))
