"""Losses as table metrics over in-batch pairs.

A batch holds at most ``batch_size`` rows of one accommodation; it is collected into one row
(bounded list) and a vectorised job computes the batch's score matrix with numpy, emitting
one row per batch. No (user, review) pair becomes a Spark row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrank.functions.vectors import cosine
from roomrank.session import materialize

CONTRASTIVE_MARGIN = 2.0  # fixed value of the reference's contrastive loss
PAIRWISE_EPS = 1e-6

_BATCH_SCHEMA = T.StructType([
    T.StructField("accommodation_id", T.LongType()), T.StructField("batch_id", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("pairs", T.LongType()), T.StructField("loss", T.DoubleType())])


def softmax_loss(u: np.ndarray, r: np.ndarray) -> float:
    """L1: in-batch softmax cross-entropy, target = own review."""
    s = u @ r.T
    mx = s.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(s - mx).sum(axis=1)) + mx[:, 0] - np.diag(s)))


def bce_loss(u: np.ndarray, r: np.ndarray) -> float:
    """L2: binary cross-entropy with logits over the batch, one positive per user."""
    s = u @ r.T
    return float(np.mean(np.maximum(s, 0) - s * np.eye(len(s)) + np.log1p(np.exp(-np.abs(s)))))


def contrastive_loss(u: np.ndarray, r: np.ndarray, margin: float = CONTRASTIVE_MARGIN) -> float:
    """L3: contrastive margin loss over all in-batch pairs; |u - r + eps|^2 from norms and products."""
    e, y = PAIRWISE_EPS, np.eye(len(u))
    d2 = ((u * u).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :] - 2 * u @ r.T
          + 2 * e * (u.sum(axis=1)[:, None] - r.sum(axis=1)[None, :]) + u.shape[1] * e * e)
    d = np.sqrt(np.maximum(d2, 0.0))
    return float((y * d ** 2 + (1 - y) * np.maximum(margin - d, 0.0) ** 2).mean())


LOSSES = {"softmax": softmax_loss, "bce": bce_loss, "contrastive": contrastive_loss}


def _loss_job(fn):
    def work(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                n = len(row.uids)
                u = np.asarray(row.u_flat, dtype=np.float64).reshape(n, -1)
                r = np.asarray(row.r_flat, dtype=np.float64).reshape(n, -1)
                rows.append((row.accommodation_id, row.batch_id, n, n * n, fn(u, r)))
            if rows:
                yield pd.DataFrame(rows, columns=[f.name for f in _BATCH_SCHEMA.fields])
    return work


def batch_losses(batched: DataFrame, loss: str) -> DataFrame:
    """``batched(accommodation_id, batch_id, user_id, uvec, rvec)`` -> one row per batch with the asked loss of ``LOSSES``."""
    g = batched.groupBy("accommodation_id", "batch_id").agg(
        F.collect_list(F.struct("user_id", "uvec", "rvec")).alias("rows"))
    g = g.select("accommodation_id", "batch_id",
                 F.transform("rows", lambda x: x["user_id"]).alias("uids"),
                 F.flatten(F.transform("rows", lambda x: x["uvec"])).alias("u_flat"),
                 F.flatten(F.transform("rows", lambda x: x["rvec"])).alias("r_flat"))
    return g.mapInPandas(_loss_job(LOSSES[loss]), _BATCH_SCHEMA)


_EPOCH_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("accommodation_id", "epoch", "batch_id", "n", "pairs")]
                             + [T.StructField("loss", T.DoubleType())])


def _epoch_job(fn):
    def work(frames):
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                rid, rids = np.asarray(row.u_rid, dtype=np.int64), np.asarray(row.r_rid, dtype=np.int64)
                u = np.asarray(row.u_flat, dtype=np.float64).reshape(len(rid), -1)
                r = np.asarray(row.r_flat, dtype=np.float64).reshape(len(rids), -1)
                order = np.argsort(rids, kind="stable")
                first, end = np.searchsorted(rids[order], rid), np.searchsorted(rids[order], rid, "right")
                ids = np.asarray(row.b_flat, dtype=np.int64).reshape(len(rid), -1)
                for e in range(ids.shape[1]):
                    for b in np.unique(ids[ids[:, e] >= 0, e]):
                        mine = np.flatnonzero(ids[:, e] == b)
                        size = (end - first)[mine]  # 1, unless review rows repeat an id
                        n = int(size.sum())
                        if not n:
                            continue
                        at = order[np.repeat(first[mine] - np.cumsum(size) + size, size) + np.arange(n)]
                        rows.append((row.accommodation_id, e, b, n, n * n, fn(u[np.repeat(mine, size)], r[at])))
            if rows:
                yield pd.DataFrame(rows, columns=[f.name for f in _EPOCH_SCHEMA.fields])
    return work


def epoch_losses(users: DataFrame, reviews: DataFrame, loss: str) -> DataFrame:
    """The asked loss of every batch of every epoch: ``(accommodation_id, epoch, batch_id, n, pairs, loss)``.

    ``users(accommodation_id, epoch, part, batches, review_id, uvec)`` has the rows of ``epoch_batches``, each with its user's vector;
    ``reviews(accommodation_id, epoch, part, review_id, rvec)`` each collected group's reviews, once. A row is joined with
    its review inside the group, so a review's vector travels once per group, and a user's once for all epochs.
    """
    of = ["accommodation_id", "epoch", "part"]
    u = users.groupBy(*of).agg(F.collect_list(F.struct("review_id", "batches", "uvec")).alias("rows"))
    u = u.select(*of, F.transform("rows", lambda x: x["review_id"]).alias("u_rid"), F.flatten(F.transform("rows", lambda x: x["batches"])).alias("b_flat"),
                 F.flatten(F.transform("rows", lambda x: x["uvec"])).alias("u_flat"))
    r = reviews.groupBy(*of).agg(F.collect_list(F.struct("review_id", "rvec")).alias("rows"))
    r = r.select(*of, F.transform("rows", lambda x: x["review_id"]).alias("r_rid"), F.flatten(F.transform("rows", lambda x: x["rvec"])).alias("r_flat"))
    return u.join(r, of).mapInPandas(_epoch_job(LOSSES[loss]), _EPOCH_SCHEMA)


def cosine_loss(rows: DataFrame, by: str = "split") -> DataFrame:
    """L4 with all-positive targets: mean of ``1 - cos(u, r)`` per ``by``."""
    return rows.groupBy(by).agg(F.avg(F.lit(1.0) - cosine("uvec", "rvec")).alias("loss"))


def running_means(batch_table: DataFrame, group: str, order: str, loss: str = "loss") -> DataFrame:
    """``running`` = mean of the group's losses up to each batch (one row per batch, not per match).

    A segmented prefix sum: rows are range-partitioned by (group, order), so a group of any size spans many partitions;
    sums run within a partition's part of the group, and each part adds what the group's earlier parts hold (one small row
    per partition and group).
    """
    placed = materialize(batch_table.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "_part").agg(F.sum(loss).alias("_sum"), F.count(loss).alias("_rows"))
    carried = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"),
                           F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"),
                           F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"))
    summed = placed.withColumns({"_in": F.coalesce(F.sum(loss).over(within), F.lit(0.0)), "_rows_in": F.count(loss).over(within)})
    joined = summed.join(carried, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    n = F.col("_rows_before") + F.col("_rows_in")
    return joined.select(*batch_table.columns, F.when(n > 0, (F.col("_before") + F.col("_in")) / n).alias("running"))


def epoch_means(batch_table: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean of the batch losses per epoch (mean over batches)."""
    return batch_table.groupBy("epoch").agg(F.avg(loss).alias("loss"))
