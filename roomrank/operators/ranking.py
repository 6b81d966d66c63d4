"""Ranking and evaluation.

* target rank: counting form (``1 + #candidates ranked before the target``) from the blocked
  scorer - E1's sort and E2's count give the same number; counting needs no sort at all;
* MRR@10 is an average of a native expression;
* top-k per user: blocked scorer + ``row_number() <= k`` (``WindowGroupLimit`` keeps k per
  user before the shuffle); pad with the group's first candidate; one grouped pivot; a
  gap-free ``ID`` from the distributed numbering operator (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrank.functions.vectors import reciprocal_rank
from roomrank.operators.scoring import DEFAULT_BLOCK, rank_of_target, top_k
from roomrank.operators.sequence import sequential_id

CUTOFF = 10  # MRR@10 and top-10 output, as in the reference


def target_ranks(queries: DataFrame, items: DataFrame, *, metric: str = "dot", block: int = DEFAULT_BLOCK,
                 target_tie: str | None = None, item_tie: str | None = None,
                 query_sizes: DataFrame | None = None, item_sizes: DataFrame | None = None) -> DataFrame:
    """``queries(user_id, accommodation_id, vec, review_id, tvec)``, ``items(review_id, accommodation_id, vec)``
    -> ``(user_id, rank, rr, n_candidates)``. ``*_sizes``: optional cheap frames to size the blocks from."""
    r = rank_of_target(queries, items, grp="accommodation_id", qid="user_id", qvec="vec",
                       target_id="review_id", target_vec="tvec", iid="review_id", ivec="vec",
                       target_tie=target_tie, itie=item_tie, metric=metric, block=block,
                       query_sizes=query_sizes, item_sizes=item_sizes)
    rr = F.coalesce(reciprocal_rank(F.col("rank"), CUTOFF), F.lit(0.0))  # 0 for a target that is no candidate
    return r.select("user_id", "rank", rr.alias("rr"), "n_candidates", "n_nonfinite")


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """One row: ``n_users``, ``mrr`` (mean of 1/rank when rank <= 10, else 0).

    Stops on a score that is not finite (B14): a diverged model has no MRR.
    """
    bad = F.sum("n_nonfinite") if "n_nonfinite" in ranks.columns else F.lit(0)
    mrr = F.when(bad > 0, F.raise_error(F.concat(F.lit("non-finite scores: "), bad)).cast("double")).otherwise(F.avg("rr"))
    return ranks.agg(F.count(F.lit(1)).alias("n_users"), mrr.alias("mrr"))


def topk_per_user(users: DataFrame, items: DataFrame, *, k: int = CUTOFF, metric: str = "dot",
                  block: int = DEFAULT_BLOCK, query_sizes: DataFrame | None = None,
                  item_sizes: DataFrame | None = None) -> DataFrame:
    """``users(user_id, accommodation_id, vec)`` -> ``(user_id, rank, review_id, score)``, rank 1..min(k, n)."""
    t = top_k(users, items, grp="accommodation_id", qid="user_id", qvec="vec", iid="review_id", ivec="vec",
              k=k, metric=metric, block=block, query_sizes=query_sizes, item_sizes=item_sizes)
    return t.select("user_id", "rank", "review_id", "score")


def wide_lists(topk: DataFrame, users: DataFrame, items: DataFrame, pad: str = "first") -> DataFrame:
    """``accommodation_id, user_id, review_1 .. review_10`` (no ``ID`` yet).

    Short lists are padded with the group's first candidate (smallest review_id), as the
    reference pads with candidate index 0; ``pad='null'`` leaves the gaps empty.
    """
    wide = topk.groupBy("user_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("review_id"))).alias(f"review_{i}")
                                         for i in range(1, CUTOFF + 1)])
    first = items.groupBy("accommodation_id").agg(F.min("review_id").alias("_first"))
    j = wide.join(users.select("user_id", "accommodation_id"), "user_id").join(first, "accommodation_id")
    if pad == "first":
        j = j.withColumns({f"review_{i}": F.coalesce(F.col(f"review_{i}"), F.col("_first"))
                           for i in range(1, CUTOFF + 1)})
    return j.select("accommodation_id", "user_id", *[f"review_{i}" for i in range(1, CUTOFF + 1)])


def number_lists(wide: DataFrame) -> DataFrame:
    """Prepend the gap-free ``ID`` (from 1, by accommodation_id then user_id)."""
    numbered = sequential_id(wide, ["accommodation_id", "user_id"], name="ID", start=1)
    return numbered.select("ID", "accommodation_id", "user_id", *[f"review_{i}" for i in range(1, CUTOFF + 1)])


def wide_top10(topk: DataFrame, users: DataFrame, items: DataFrame, pad: str = "first") -> DataFrame:
    """``ID, accommodation_id, user_id, review_1 .. review_10``."""
    return number_lists(wide_lists(topk, users, items, pad))
