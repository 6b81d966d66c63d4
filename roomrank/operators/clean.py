"""Projection, cleaning and sampling.

Samples are reproducible: a multiplicative hash of the key decides membership, so the same
rows are drawn on every run and in any engine (the reference's samples are unseeded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sample hash (Knuth's multiplicative constant, 32-bit range).
HASH_MULT = 2654435761
HASH_RANGE = 4294967296


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mult_hash32(key) -> Column:
    """``(key * 2654435761) mod 2**32`` without 64-bit overflow (key split in 16-bit halves)."""
    k = F.pmod(_c(key).cast("long"), F.lit(HASH_RANGE))
    hi = F.floor(k / F.lit(65536)).cast("long")
    lo = F.pmod(k, F.lit(65536))
    return F.pmod(F.pmod(hi * F.lit(HASH_MULT), F.lit(65536)) * F.lit(65536) + lo * F.lit(HASH_MULT),
                  F.lit(HASH_RANGE))


def hash_sample(df: DataFrame, key: str, frac: float) -> DataFrame:
    """Keep rows whose key hash falls below ``frac`` of the range (B9, reproducible)."""
    return df.where(mult_hash32(key) < F.lit(int(frac * HASH_RANGE)))


def sample_fraction(df: DataFrame, frac: float, seed: int = 0) -> DataFrame:
    """Bernoulli sample, seeded (B9, statistical form)."""
    return df.sample(withReplacement=False, fraction=frac, seed=seed)


def sample_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in hash order (B10); planned as a per-partition top-n, never a full sort."""
    return df.orderBy(mult_hash32(key), F.col(key)).limit(n)


def cap_examples(df: DataFrame, key: str, reps: int) -> DataFrame:
    """First ``reps`` examples by key (B12); ``-1`` keeps all."""
    return df if reps == -1 else df.orderBy(key).limit(reps)


def nonfinite_count(df: DataFrame, col: str) -> Column:
    """Aggregate: rows where ``col`` is NaN or infinite."""
    x = F.col(col).cast("double")
    return F.sum((F.isnan(x) | (F.abs(x) == F.lit(float("inf")))).cast("long"))


def assert_finite(df: DataFrame, cols) -> None:
    """Raise when any value is NaN/inf - the reference aborts on a NaN loss."""
    row = df.agg(*[nonfinite_count(df, c).alias(c) for c in cols]).first()
    bad = {c: row[c] for c in cols if row[c]}
    if bad:
        raise FloatingPointError(f"non-finite values: {bad}")
