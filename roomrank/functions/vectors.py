"""Dense-vector expressions over ``array<double>`` columns.

Everything here is a Catalyst expression (higher-order array functions), evaluated in the
JVM. Statistics that a per-element lambda needs (norm, mean) are computed once per row and
broadcast along the array with ``array_repeat`` + ``zip_with``, so each helper is O(d).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the library functions being matched (layer norm / normalise / cosine /
# pairwise distance epsilons).
LAYER_NORM_EPS = 1e-5
L2_EPS = 1e-12
COSINE_EPS = 1e-8
PAIRWISE_EPS = 1e-6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vsum(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def scale_by(a, s) -> Column:
    """Element-wise ``a * s`` with ``s`` a per-row scalar evaluated once."""
    a = _col(a)
    return F.zip_with(a, F.array_repeat(_col(s), F.size(a)), lambda x, y: x * y)


def shift_scale(a, shift, s) -> Column:
    """Element-wise ``(a - shift) * s`` with per-row scalars evaluated once."""
    a = _col(a)
    n = F.size(a)
    st = F.zip_with(F.array_repeat(_col(shift), n), F.array_repeat(_col(s), n),
                    lambda x, y: F.struct(x.alias("m"), y.alias("s")))
    return F.zip_with(a, st, lambda x, p: (x - p["m"]) * p["s"])


def l2_normalize(a, eps: float = L2_EPS) -> Column:
    """``a / max(||a||, eps)``; the zero vector stays zero."""
    return scale_by(a, F.lit(1.0) / F.greatest(norm(a), F.lit(eps)))


def layer_norm(a, eps: float = LAYER_NORM_EPS) -> Column:
    """Normalise over the whole vector, population variance, no affine part."""
    a = _col(a)
    n = F.size(a).cast("double")
    mean = vsum(a) / n
    # E[x^2] - mean^2 loses precision; compute the centred sum instead.
    centred_sq = F.aggregate(F.zip_with(a, F.array_repeat(mean, F.size(a)), lambda x, m: (x - m) * (x - m)),
                             F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    inv_std = F.lit(1.0) / F.sqrt(centred_sq / n + F.lit(eps))
    return shift_scale(a, mean, inv_std)


def truncate(a, k: int) -> Column:
    return F.slice(_col(a), 1, k)


def append(a, *scalars) -> Column:
    return F.concat(_col(a), F.array(*[_col(s).cast("double") for s in scalars]))


def concat_vectors(a, b) -> Column:
    return F.concat(_col(a), _col(b))


def cosine(a, b, eps: float = COSINE_EPS) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def euclidean(a, b, eps: float = PAIRWISE_EPS) -> Column:
    """``|| a - b + eps ||_2`` as the pairwise-distance function defines it."""
    d = F.zip_with(_col(a), _col(b), lambda x, y: (x - y + F.lit(eps)) * (x - y + F.lit(eps)))
    return F.sqrt(F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def reciprocal_rank(rank, cutoff: int = 10) -> Column:
    r = _col(rank)
    return F.when(r <= cutoff, F.lit(1.0).cast("double") / r.cast("double")).otherwise(F.lit(0.0))


def round6(c) -> Column:
    return F.round(_col(c), 6)
