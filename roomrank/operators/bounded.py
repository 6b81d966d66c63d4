"""Top-k of a group without opening item blocks that cannot reach it.

``scoring.top_k`` opens every (query block, item block) of a group, which is the square of a hot group in blocks. Here
blocks hold vectors of similar direction (and, for dot products, of similar length), and each item block is known by its
centre ``c`` and radius ``r``: no item of it scores above ``q.c + |q| r`` for a query ``q``.

1. ``_side``: rows of a group larger than a block are dealt to cells by the signs of a few fixed projections (items by the
   octave of their length too, for dot products), and cells to blocks of about ``block`` rows by a hash; one row per block.
2. ``_pages``: centre and radius of every item block, 256 blocks of a group to a row. Query blocks meet pages, not items.
3. Every query block opens the item block with the best mean bound (one with k items or more, if there is any) first. That
   gives each query a k-th best score, which its final one can't be below.
4. ``rest``: of all other item blocks only those whose bound reaches that score for some query of the block are opened.

The result is that of ``scoring.top_k``, ties included: a block is left out only if its bound is lower by more than the
rounding of scores. Blocks with lengths near 0 under the cosine, and with values that are not finite, are always opened.
A hot group's blocks and pages are dealt to salts, blocks that many others open are repeated for theirs (``hot_key_join``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrank.operators.scoring import DEFAULT_BLOCK, _blocks, _flatten_side, _scores, _sizes, _topk_job, hot_key_join, hot_keys
from roomrank.session import materialize, ship_package

BITS = 12  # projections at most
FINER = 2  # a group has up to 2**FINER times as many cells as full blocks, so that a cell holds near vectors only
PAGE_BITS = 8  # 256 blocks to a page
ANGLE = 2.399963  # projection b weighs value j with sin(ANGLE * (b + 1) * (j + 1))
SLACK = 1e-5  # above the rounding of scores and of the bound
SHORT = 1e-4  # vectors shorter than this have no bound under the cosine


class BoundedTopK(NamedTuple):
    first: DataFrame  # a row per query block: the block opened first, the k-th best scores, the best of it
    rest: DataFrame  # (qb, ib) of the other block pairs that are opened
    query_blocks: DataFrame
    item_blocks: DataFrame
    k: int
    metric: str

    def top(self, qid: str, iid: str) -> DataFrame:
        """``(qid, rank, iid, score, itie)`` as ``scoring.top_k`` returns it."""
        more = _met(self.rest, self.query_blocks, self.item_blocks).mapInPandas(_topk_job(self.metric, self.k), _FOUND)
        best = self.first.select(F.explode(F.arrays_zip("r_qid", "r_iid", "r_itie", "r_score")).alias("x")).select(
            *[F.col(f"x.r_{c}").alias(c) for c in ("qid", "iid", "itie", "score")])
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("iid"), F.col("itie"))
        ranked = best.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)
        return ranked.select(F.col("qid").alias(qid), "rank", F.col("iid").alias(iid), "score", "itie")

    def opened(self) -> DataFrame:
        """One row: ``pairs_opened`` of the ``pairs_all`` block pairs that the full scan opens."""
        mine, theirs = (b.groupBy("grp").agg(F.count(F.lit(1)).alias(n)) for b, n in ((self.query_blocks, "q"), (self.item_blocks, "i")))
        every = mine.join(theirs, "grp").agg(F.coalesce(F.sum(F.col("q") * F.col("i")), F.lit(0)).alias("pairs_all"))
        opened = self.first.select("qb").unionByName(self.rest.select("qb")).agg(F.count(F.lit(1)).alias("pairs_opened"))
        return opened.crossJoin(F.broadcast(every))  # one row each


_FOUND = "qid long, iid long, itie long, score double"


def _direction(vec: Column) -> Column:
    """The signs of BITS projections of a vector as the bits of a number."""
    def sign(b: int) -> Column:
        along = F.transform(vec, lambda x, j: x.cast("double") * F.sin((j + 1) * F.lit(ANGLE * (b + 1))))
        return F.when(F.aggregate(along, F.lit(0.0), lambda a, x: a + x) > 0, F.lit(1 << b)).otherwise(F.lit(0))

    out = sign(0)
    for b in range(1, BITS):
        out = out + sign(b)
    return out


def _octave(vec: Column) -> Column:
    return F.floor(F.log2(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) / 2)


def _side(rows: DataFrame, ids: list[str], block: int, name: str, prefix: str, sizes: DataFrame, by_length: bool) -> DataFrame:
    """One row per block: its id ``name``, ``grp``, the group's salts ``s`` and the rows' fields as flat arrays."""
    dealt = hot_key_join(rows, sizes, "grp", hot_keys(sizes.where("_n is not null"), "grp"), ids)
    large = F.col("_n") > F.lit(block)
    bits = F.least(F.ceil(F.log2(F.col("_n") / F.lit(float(block)))) + FINER, F.lit(BITS)).cast("int")
    code = F.when(large, _direction(F.col("vec")).bitwiseAND(F.pow(F.lit(2), bits).cast("int") - 1)).otherwise(0)
    octave = F.when(large, F.coalesce(_octave(F.col("vec")), F.lit(-9999))).otherwise(0) if by_length else F.lit(0)
    cell = F.struct(F.col("grp"), F.col("_s").alias("s"), code.alias("code"), octave.cast("int").alias("octave"))
    rows_of = _blocks(dealt.select(cell.alias("_cell"), *ids, "vec"), "_cell", ids, [*ids, "vec"], block, "_rows")
    return materialize(rows_of.select(F.monotonically_increasing_id().alias(name), "_cell.grp", "_cell.s",
                                      *_flatten_side("_rows", prefix, ids, ["vec"])))


def _rows(values, n: int) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(n, -1)


def _bodies(metric: str):
    """Centre, radius and size of each item block."""
    def fn(batches):
        for pdf in batches:
            centres, radii = [], []
            for values, ids in zip(pdf["i_vec"], pdf["i_iid"], strict=True):
                v = _rows(values, len(ids))
                length = np.sqrt((v * v).sum(axis=1))
                fine = np.isfinite(length).all()
                if metric == "cosine":
                    fine = fine and (length >= SHORT).all()
                    v = v / np.maximum(length, SHORT)[:, None]
                centre = v.mean(axis=0) if fine else np.zeros(v.shape[1])
                centres.append(centre)
                radii.append(float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max()) if fine else np.inf)
            yield pd.DataFrame({"ib": pdf["ib"], "grp": pdf["grp"], "s": pdf["s"], "n": pdf["i_iid"].map(len).astype("int64"),
                                "centre": centres, "radius": radii})
    return fn


def _bounds(row, metric: str) -> np.ndarray:
    """(queries, blocks of the page): what no item of the block scores above."""
    q = _rows(row.q_vec, len(row.q_qid))
    radius = np.asarray(row.p_radius, dtype=np.float64)
    centre = _rows(row.p_centre, len(radius))
    length = np.sqrt((q * q).sum(axis=1))
    with np.errstate(invalid="ignore"):
        if metric == "cosine":
            known = length >= SHORT
            q = q / np.maximum(length, SHORT)[:, None]
            out = q @ centre.T + radius[None, :]
            out[~known] = np.inf
        else:
            out = q @ centre.T + length[:, None] * radius[None, :]
    out[:, np.isinf(radius)] = np.inf
    return np.where(np.isfinite(out), out, np.inf)


def _nearest(metric: str, k: int):
    """The best item block of a page to open first."""
    def fn(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                full, mean, ib = np.asarray(row.p_n) >= k, _bounds(row, metric).mean(axis=0), np.asarray(row.p_ib)
                best = np.lexsort((-ib, mean, full))[-1]
                out.append((row.qb, bool(full[best]), float(mean[best]), int(ib[best])))
            yield pd.DataFrame(out, columns=["qb", "full", "bound", "ib"])
    return fn


def _first(metric: str, k: int):
    """The best k of the block opened first, and each query's k-th best score (-inf with fewer items)."""
    def fn(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                iid, tie = np.asarray(row.i_iid, dtype=np.int64), np.asarray(row.i_tie, dtype=np.int64)
                order = np.lexsort((tie, iid))
                s = _scores(_rows(row.q_vec, len(row.q_qid)), _rows(row.i_vec, len(iid))[order], metric)
                kk = min(k, len(iid))
                top = np.argsort(-s, axis=1, kind="stable")[:, :kk]
                scores = np.take_along_axis(s, top, axis=1)
                least = scores[:, -1] if kk == k else np.full(len(s), -np.inf)
                out.append((row.qb, row.ib, least, np.repeat(np.asarray(row.q_qid, dtype=np.int64), kk), iid[order][top].ravel(),
                            tie[order][top].ravel(), scores.ravel()))
            yield pd.DataFrame(out, columns=["qb", "ib", "least", "r_qid", "r_iid", "r_itie", "r_score"])
    return fn


def _reaching(metric: str):
    """(qb, ib) of the blocks of a page that some query's bound reaches, but for the one opened first."""
    def fn(batches):
        for pdf in batches:
            qb, ib = [], []
            for row in pdf.itertuples(index=False):
                least = np.asarray(row.least, dtype=np.float64)[:, None]
                slack = SLACK * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
                ids = np.asarray(row.p_ib, dtype=np.int64)
                found = ids[(_bounds(row, metric) >= least - slack).any(axis=0) & (ids != row.first)]
                qb.append(np.full(len(found), row.qb, dtype=np.int64))
                ib.append(found)
            if qb:
                yield pd.DataFrame({"qb": np.concatenate(qb), "ib": np.concatenate(ib)})
    return fn


def _met(pairs: DataFrame, query_blocks: DataFrame, item_blocks: DataFrame) -> DataFrame:
    """The blocks of (qb, ib) pairs side by side; a block in many pairs doesn't meet them all in one task."""
    for key, other, blocks in (("qb", "ib", query_blocks.drop("grp", "s")), ("ib", "qb", item_blocks.drop("grp", "s"))):
        often = hot_keys(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
        met = hot_key_join(pairs if key == "qb" else met, blocks, key, often, [other])
    return met


def bounded_top_k(queries: DataFrame, items: DataFrame, *, grp: str, qid: str, qvec: str, iid: str, ivec: str, k: int = 10,
                  itie: str | None = None, metric: str = "dot", block: int = DEFAULT_BLOCK, query_sizes: DataFrame | None = None,
                  item_sizes: DataFrame | None = None) -> BoundedTopK:
    """The block pairs to open for the ``k`` best items of each query's group, under ``dot`` or ``cosine``.

    Queries without items, rows with a null group and empty tables give no rows; NaN scores rank last; repeated rows are
    items (or queries) of their own; extra columns are ignored. ``query_sizes`` / ``item_sizes``: optional cheap frames with
    the group column ``grp`` to count the groups on.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError("only dot products and cosines have a bound")
    ship_package(queries.sparkSession)
    q = queries.select(F.col(grp).alias("grp"), F.col(qid).cast("long").alias("qid"), F.col(qvec).alias("vec"))
    it = items.select(F.col(grp).alias("grp"), F.col(iid).cast("long").alias("iid"),
                      (F.col(itie).cast("long") if itie else F.lit(0).cast("long")).alias("tie"), F.col(ivec).alias("vec"))
    of_q, of_it = (d if z is None else z.select(F.col(grp).alias("grp")) for d, z in ((q, query_sizes), (it, item_sizes)))
    q_sizes, i_sizes = _sizes(of_q, of_it, "grp", block)
    query_blocks = _side(q, ["qid"], block, "qb", "q_", q_sizes, False)
    item_blocks = _side(it, ["iid", "tie"], block, "ib", "i_", i_sizes, metric == "dot")

    bodies = item_blocks.mapInPandas(_bodies(metric), T.StructType([
        T.StructField("ib", T.LongType()), item_blocks.schema["grp"], T.StructField("s", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())]))
    pages = (bodies.groupBy("grp", "s", F.shiftright("ib", PAGE_BITS).alias("_page"))
             .agg(F.collect_list(F.struct("ib", "n", "radius", "centre")).alias("_bodies"))
             .select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("_salt"),
                     *_flatten_side("_bodies", "p_", ["ib", "n", "radius"], ["centre"])))
    pages = materialize(pages)
    asking = query_blocks.withColumn("_salt", F.pmod(F.col("qb"), F.col("s"))).drop("s")

    near = asking.join(pages, ["grp", "_salt"]).mapInPandas(_nearest(metric, k), "qb long, full boolean, bound double, ib long")
    near = materialize(near.groupBy("qb").agg(F.max(F.struct("full", "bound", "ib")).alias("x")).select("qb", F.col("x.ib").alias("ib")))
    first = materialize(_met(near, query_blocks, item_blocks).mapInPandas(
        _first(metric, k), "qb long, ib long, least array<double>, r_qid array<long>, r_iid array<long>, r_itie array<long>, r_score array<double>"))
    known = asking.join(first.select("qb", F.col("ib").alias("first"), "least"), "qb")
    rest = materialize(known.join(pages, ["grp", "_salt"]).mapInPandas(_reaching(metric), "qb long, ib long"))
    return BoundedTopK(first, rest, query_blocks, item_blocks, k, metric)
