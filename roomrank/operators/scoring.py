"""Blocked candidate scoring.

Every query row (a user) is scored against every item row (a review) of the same group
(an accommodation). Materialising one row per (user, review) pair grows with the square of a
group, and a group may hold a third of all rows. Instead:

1. each side is cut into blocks of at most ~``block`` rows per group
   (``pmod(xxhash64(id), ceil(n/block))``), and each block is collected into one row
   (a bounded list, never a whole group);
2. query blocks are joined with the item blocks of their group: one row per *block pair*,
   i.e. ``block**2`` fewer rows than pairs; a hot group's query blocks are dealt to salts, so its
   block pairs spread over many tasks without AQE;
3. a vectorised Python job multiplies the two blocks (numpy matmul on Arrow batches) and emits
   only what ranking needs: per query, the number of items that rank before its target, and /
   or its top-k of that block;
4. Spark sums the counts per query (partial aggregation) or keeps the k best per query with a
   window limit (``WindowGroupLimit``, partial before the shuffle).

Ranking order everywhere: score rounded to 6 decimals descending, then item id, then the
item's tie key ascending.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BLOCK = 256
SALT_BLOCKS = 8  # query blocks of a group that share a join key
HOT_PARTS = 512  # a key with more than 1 / HOT_PARTS of the rows is hot: its rows are salted in joins on it
SCORE_DECIMALS = 6
COSINE_EPS = 1e-8


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def hot_keys(sizes: DataFrame, key: str | list[str], n: str = "_n", parts: int = HOT_PARTS) -> DataFrame:
    """``(key, _salts)`` of the keys that hold more than 1 / parts of all rows: fewer than ``parts`` keys, whatever the data."""
    total = sizes.agg(F.sum(n).alias("_all"))
    share = F.col(n) * F.lit(parts) / F.col("_all")
    return sizes.crossJoin(F.broadcast(total)).where(share > 1).select(*_names(key), F.ceil(share).cast("long").alias("_salts"))


def hot_key_join(rows: DataFrame, lookup: DataFrame, key: str | list[str], hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with one ``lookup`` row per key, without meeting a hot key's rows in one task.

    A hot key's rows are dealt to salts by a hash of the ``spread`` columns, and its one lookup row is repeated per salt;
    all other keys have salt 0. What is broadcast is ``hot``, whose size ``hot_keys`` bounds.
    """
    hot, key = F.broadcast(hot), _names(key)
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0).cast("long")).otherwise(
        F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.col("_salts")))).drop("_salts")
    each = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1))).drop("_salts")
    return dealt.join(each, [*key, "_salt"], how).drop("_salt")


def _blocks(df: DataFrame, grp: str, id_cols: list[str], fields: list, block: int, name: str, sizes: DataFrame | None = None,
            how: str = "inner") -> DataFrame:
    """Cut each group of ``df`` into blocks of about ``block`` rows, one row per block, with the group's ``_s``.

    ``sizes(grp, _n, _s)`` holds the rows of each group (counted on ``df`` if not given). The block count only sets the work per task, never the result
    (every item still meets every query of its group), so sizes may be counted on a cheaper frame with the same groups.
    A row whose group has no size stops the job, since its group would become one block without bound.
    """
    sizes = _sizes(df, df, grp, block)[0] if sizes is None else sizes
    nb = F.greatest(F.ceil(F.col("_n") / F.lit(float(block))), F.lit(1)).cast("long")
    nb = F.when(F.col("_n").isNull(), F.raise_error(F.lit("a group has no size: sizes_from lacks it")).cast("long")).otherwise(nb)
    b = (hot_key_join(df, sizes, grp, hot_keys(sizes.where("_n is not null"), grp), id_cols, how)
         .withColumn("_blk", F.pmod(F.xxhash64(*[F.col(c) for c in id_cols]), nb)))
    # Shuffle on (group, block), not on the group alone: otherwise the aggregate reuses the
    # join's partitioning by group and a hot group's blocks are all built by one task.
    b = b.repartition(grp, "_blk")
    return b.groupBy(grp, "_blk").agg(F.collect_list(F.struct(*fields)).alias(name), F.max("_s").alias("_s"))


def _sizes(queries: DataFrame, items: DataFrame, grp: str, block: int) -> tuple[DataFrame, DataFrame]:
    """``(grp, _n, _s)`` for the query side and for the item side (only of groups that have queries).

    ``_s`` is the number of salts of a group's block pairs: about SALT_BLOCKS query blocks share a join key.
    """
    s = F.greatest(F.ceil(F.ceil(F.col("_n") / F.lit(float(block))) / F.lit(float(SALT_BLOCKS))), F.lit(1)).cast("long")
    of_queries = queries.groupBy(grp).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", s)
    of_items = items.groupBy(grp).agg(F.count(F.lit(1)).alias("_n"))
    return of_queries, of_queries.select(grp, "_s").join(of_items, grp, "left").select(grp, "_n", "_s")


def _salted(qb: DataFrame, ib: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread a hot group's block pairs: its query blocks are dealt to ``_salt`` 0 .. s - 1, its item blocks go to every salt."""
    qb = qb.withColumn("_salt", F.pmod(F.col("_blk"), F.col("_s"))).drop("_blk", "_s")
    ib = ib.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1))).drop("_blk", "_s")
    return qb, ib


def _flatten_side(rows_col: str, prefix: str, scalar_fields: list[str], vec_fields: list[str]):
    def field(name):
        return lambda x: x[name]

    out = []
    for f in scalar_fields:
        out.append(F.transform(F.col(rows_col), field(f)).alias(f"{prefix}{f}"))
    for f in vec_fields:
        out.append(F.flatten(F.transform(F.col(rows_col), field(f))).alias(f"{prefix}{f}"))
    return out


class PairScorer:
    """A learned pair function for the blocked scorer: ``matrix(Q, I)`` -> (nq, ni) scores and
    ``paired(Q, T)`` -> (n,) scores of row-aligned pairs. Must be picklable (it ships with the job)."""

    def matrix(self, q: np.ndarray, it: np.ndarray) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError

    def paired(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError


def _scores(q: np.ndarray, it: np.ndarray, metric) -> np.ndarray:
    if isinstance(metric, PairScorer):
        return _lowest_if_nan(np.round(metric.matrix(q, it), SCORE_DECIMALS))
    s = q @ it.T
    if metric == "cosine":
        qn = np.sqrt((q * q).sum(axis=1))
        inn = np.sqrt((it * it).sum(axis=1))
        s = s / np.maximum(np.outer(qn, inn), COSINE_EPS)
    return _lowest_if_nan(np.round(s, SCORE_DECIMALS))


def _lowest_if_nan(s: np.ndarray) -> np.ndarray:
    """NaN ranks below every score, in numpy and in Spark."""
    return np.where(np.isnan(s), -np.inf, s)


def _pair_scores(q: np.ndarray, t: np.ndarray, metric) -> np.ndarray:
    if isinstance(metric, PairScorer):
        return _lowest_if_nan(np.round(metric.paired(q, t), SCORE_DECIMALS))
    s = np.einsum("ij,ij->i", q, t)
    if metric == "cosine":
        s = s / np.maximum(np.sqrt((q * q).sum(axis=1)) * np.sqrt((t * t).sum(axis=1)), COSINE_EPS)
    return _lowest_if_nan(np.round(s, SCORE_DECIMALS))


def _rank_job(metric):
    def fn(batches):
        for pdf in batches:
            out_q, out_b, out_n, out_t, out_x = [], [], [], [], []
            for row in pdf.itertuples(index=False):
                qid = np.asarray(row.q_qid, dtype=np.int64)
                nq = len(qid)
                ni = len(row.i_iid)
                if nq == 0 or ni == 0:
                    continue
                q = np.asarray(row.q_vec, dtype=np.float64).reshape(nq, -1)
                tv = np.asarray(row.q_tvec, dtype=np.float64).reshape(nq, -1)
                it = np.asarray(row.i_vec, dtype=np.float64).reshape(ni, -1)
                iid = np.asarray(row.i_iid, dtype=np.int64)
                itie = np.asarray(row.i_tie, dtype=np.int64)
                tid = np.asarray(row.q_tid, dtype=np.int64)[:, None]
                ttie = np.asarray(row.q_ttie, dtype=np.int64)[:, None]
                s = _scores(q, it, metric)
                t = _pair_scores(q, tv, metric)[:, None]
                is_target = (iid[None, :] == tid) & (itie[None, :] == ttie)
                earlier = (iid[None, :] < tid) | ((iid[None, :] == tid) & (itie[None, :] < ttie))
                before = ((s > t) | ((s == t) & earlier)) & ~is_target
                out_q.append(qid)
                out_b.append(before.sum(axis=1).astype(np.int64))
                out_n.append(np.full(nq, ni, dtype=np.int64))
                out_t.append(is_target.sum(axis=1).astype(np.int64))
                out_x.append(np.isinf(s).sum(axis=1).astype(np.int64) + np.isinf(t[:, 0]))
            if out_q:
                yield pd.DataFrame({"qid": np.concatenate(out_q), "n_before": np.concatenate(out_b),
                                    "n_items": np.concatenate(out_n), "n_target": np.concatenate(out_t),
                                    "n_nonfinite": np.concatenate(out_x)})
    return fn


def _topk_job(metric, k: int):
    def fn(batches):
        for pdf in batches:
            cols = {"qid": [], "iid": [], "itie": [], "score": []}
            for row in pdf.itertuples(index=False):
                qid = np.asarray(row.q_qid, dtype=np.int64)
                nq, ni = len(qid), len(row.i_iid)
                if nq == 0 or ni == 0:
                    continue
                q = np.asarray(row.q_vec, dtype=np.float64).reshape(nq, -1)
                it = np.asarray(row.i_vec, dtype=np.float64).reshape(ni, -1)
                iid = np.asarray(row.i_iid, dtype=np.int64)
                itie = np.asarray(row.i_tie, dtype=np.int64)
                order = np.lexsort((itie, iid))  # items by tie order; stable sort keeps it
                iid, itie, it = iid[order], itie[order], it[order]
                s = _scores(q, it, metric)
                kk = min(k, ni)
                top = np.argsort(-s, axis=1, kind="stable")[:, :kk]
                cols["qid"].append(np.repeat(qid, kk))
                cols["iid"].append(iid[top].ravel())
                cols["itie"].append(itie[top].ravel())
                cols["score"].append(np.take_along_axis(s, top, axis=1).ravel())
            if cols["qid"]:
                yield pd.DataFrame({c: np.concatenate(v) for c, v in cols.items()})
    return fn


_RANK_SCHEMA = T.StructType([T.StructField("qid", T.LongType()), T.StructField("n_before", T.LongType()),
                             T.StructField("n_items", T.LongType()), T.StructField("n_target", T.LongType()),
                             T.StructField("n_nonfinite", T.LongType())])
_TOPK_SCHEMA = T.StructType([T.StructField("qid", T.LongType()), T.StructField("iid", T.LongType()),
                             T.StructField("itie", T.LongType()), T.StructField("score", T.DoubleType())])


def _prepare_items(items: DataFrame, grp: str, iid: str, ivec: str, itie: str | None, block: int, sizes: DataFrame) -> DataFrame:
    it = items.select(F.col(grp), F.col(iid).cast("long").alias("iid"),
                      (F.col(itie).cast("long") if itie else F.lit(0).cast("long")).alias("tie"),
                      F.col(ivec).alias("vec"))
    ib = _blocks(it, grp, ["iid", "tie"], ["iid", "tie", "vec"], block, "irows", sizes, "inner")
    return ib.select(grp, "_blk", "_s", *_flatten_side("irows", "i_", ["iid", "tie"], ["vec"]))


def rank_of_target(queries: DataFrame, items: DataFrame, *, grp: str, qid: str, qvec: str,
                   target_id: str, target_vec: str, iid: str, ivec: str,
                   target_tie: str | None = None, itie: str | None = None,
                   metric="dot", block: int = DEFAULT_BLOCK, query_sizes: DataFrame | None = None,
                   item_sizes: DataFrame | None = None) -> DataFrame:
    """Rank (1-based) of each query's target item among all items of its group.

    ``rank = 1 + #items ranked before the target`` - the counting form, which needs no sort of
    the candidates. Returns ``(qid, rank, n_candidates, n_nonfinite)``; the rank is null if the target
    is no candidate, NaN scores rank last and are counted, and queries whose group has no items
    produce no row (the query ``dropped_users`` counts them). ``query_sizes`` / ``item_sizes``: optional cheap frames
    with the group column to size the blocks from (see ``_blocks``).
    """
    q = queries.select(F.col(grp), F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("vec"),
                       F.col(target_id).cast("long").alias("tid"),
                       (F.col(target_tie).cast("long") if target_tie else F.lit(0).cast("long")).alias("ttie"),
                       F.col(target_vec).alias("tvec"))
    q_sizes, i_sizes = _sizes(q if query_sizes is None else query_sizes, items if item_sizes is None else item_sizes, grp, block)
    qb = _blocks(q, grp, ["qid"], ["qid", "vec", "tid", "ttie", "tvec"], block, "qrows", q_sizes, "left")
    qb = qb.select(grp, "_blk", "_s", *_flatten_side("qrows", "q_", ["qid", "tid", "ttie"], ["vec", "tvec"]))
    ib = _prepare_items(items, grp, iid, ivec, itie, block, i_sizes)
    qb, ib = _salted(qb, ib)
    pairs = qb.join(ib, [grp, "_salt"]).select("q_qid", "q_tid", "q_ttie", "q_vec", "q_tvec", "i_iid", "i_tie", "i_vec")
    partial = pairs.mapInPandas(_rank_job(metric), _RANK_SCHEMA)
    return (partial.groupBy("qid")
            .agg(F.when(F.sum("n_target") > 0, F.sum("n_before") + 1).alias("rank"), F.sum("n_items").alias("n_candidates"),
                 F.sum("n_nonfinite").alias("n_nonfinite"))
            .withColumnRenamed("qid", qid))


def top_k(queries: DataFrame, items: DataFrame, *, grp: str, qid: str, qvec: str, iid: str, ivec: str,
          k: int = 10, itie: str | None = None, metric="dot", block: int = DEFAULT_BLOCK,
          query_sizes: DataFrame | None = None, item_sizes: DataFrame | None = None) -> DataFrame:
    """The ``k`` best items of each query's group: ``(qid, rank, iid, score)`` with rank 1..min(k, n)."""
    q = queries.select(F.col(grp), F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("vec"))
    q_sizes, i_sizes = _sizes(q if query_sizes is None else query_sizes, items if item_sizes is None else item_sizes, grp, block)
    qb = _blocks(q, grp, ["qid"], ["qid", "vec"], block, "qrows", q_sizes, "left")
    qb = qb.select(grp, "_blk", "_s", *_flatten_side("qrows", "q_", ["qid"], ["vec"]))
    ib = _prepare_items(items, grp, iid, ivec, itie, block, i_sizes)
    qb, ib = _salted(qb, ib)
    pairs = qb.join(ib, [grp, "_salt"]).select("q_qid", "q_vec", "i_iid", "i_tie", "i_vec")
    partial = pairs.mapInPandas(_topk_job(metric, k), _TOPK_SCHEMA)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("iid"), F.col("itie"))
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(qid), "rank", F.col("iid").alias(iid), "score", "itie")
