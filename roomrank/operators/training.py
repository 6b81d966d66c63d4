"""Distributed training of the encoders and the pair scorer.

A model is a dict of named dense stacks (LeakyReLU between the layers). A training set is a table of mini-batches,
one row each: ``(accommodation_id, batch_id, xu, xr)`` with the flattened user and review rows of the batch, so a
batch's all-against-all comparison happens inside one row's matrices and no pair row is ever made. A compact table
(``batch_table``) holds each review once per batch: ``rid`` names every row's review, ``rids`` the reviews in ``xr``.

Objectives return a batch's loss, weight and exact gradient (back-propagation written out in numpy):
* ``dual_objective``: in-batch softmax over the scores of two encoders (each batch weighs 1);
* ``pair_objective``: binary cross-entropy of every user against every review of the batch, through two towers and
  a bridge (each user weighs 1). The bridge's first layer is split, so towers run once per row, not per pair.

Two ways to run an epoch, both one pass of Spark tasks over the batch table:
* ``summed``: tasks add up gradients, Spark adds the tasks', the driver takes one Adam step (``rounds`` steps an epoch
  on hash parts of the batches). The result does not depend on the partitioning beyond floating-point order.
* ``local``: every task takes one Adam step per batch from the epoch's common weights; weights and moments are then
  averaged, weighted by the tasks' batches. Many steps an epoch for one exchange of model size; the batch table's
  partitions are the workers, so write it with the number and order wanted.

Model-sized vectors travel in chunks and are added per chunk; the driver holds the model only. After each epoch the
weights, both Adam moments, epoch, step and losses are one table under ``state_dir``; a fit that finds such tables goes
on after the last complete one and ends as an unbroken fit does. A loss that is not finite stops the fit (B14).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrank.operators.models import LEAKY_SLOPE, Dense, _act, forward, init_mlp
from roomrank.session import ship_package

CHUNK = 8192
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8

Models = dict[str, list[Dense]]
Objective = Callable[[Models, np.ndarray, np.ndarray], tuple[float, float, Models]]


# ------------------------------------------------------------------ back-propagation
def tower(sizes: list[int], seed: int) -> list[Dense]:
    """Dense layers with LeakyReLU after every one, the last included."""
    layers = init_mlp(sizes, seed)
    layers[-1].activation = "leaky_relu"
    return layers


def _through(d: np.ndarray, pre: np.ndarray, kind: str) -> np.ndarray:
    """The gradient ``d`` of an activation's output, taken through the activation."""
    if kind == "leaky_relu":
        return np.where(pre > 0, d, LEAKY_SLOPE * d)
    if kind == "none":
        return d
    raise ValueError(f"no derivative for {kind}")


def run(x: np.ndarray, layers: list[Dense]) -> tuple[np.ndarray, list]:
    """Forward pass, with each layer's input and pre-activation."""
    kept = []
    for layer in layers:
        pre = x @ layer.w.T + layer.b
        kept.append((x, pre))
        x = _act(pre, layer.activation)
    return x, kept


def back(d: np.ndarray, layers: list[Dense], kept: list) -> tuple[list[Dense], np.ndarray]:
    """(gradient per layer, gradient of the input) for the gradient ``d`` of the output of ``run``."""
    out = []
    for layer, (x, pre) in zip(reversed(layers), reversed(kept), strict=True):
        d = _through(d, pre, layer.activation)
        out.append(Dense(d.T @ x, d.sum(axis=0), layer.activation))
        d = d @ layer.w
    return out[::-1], d


# ------------------------------------------------------------------ objectives
def dual_objective(models: Models, xu: np.ndarray, xr: np.ndarray) -> tuple[float, float, Models]:
    """Mean cross-entropy of each user's own review among the batch's reviews."""
    n = len(xu)
    u, ku = run(xu, models["user"])
    r, kr = run(xr, models["review"])
    s = u @ r.T
    s = s - s.max(axis=1, keepdims=True)
    e = np.exp(s)
    z = e.sum(axis=1, keepdims=True)
    loss = float(np.mean(np.log(z[:, 0]) - np.diag(s)))
    ds = (e / z - np.eye(n)) / n
    return loss, 1.0, {"user": back(ds @ r, models["user"], ku)[0], "review": back(ds.T @ u, models["review"], kr)[0]}


def pair_logits(models: Models, xu: np.ndarray, xr: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(logits of all users x reviews as one column, what the gradient needs)."""
    tu, ku = run(xu, models["tower_user"])
    tr, kr = run(xr, models["tower_review"])
    first, d = models["bridge"][0], tu.shape[1]
    pre = (tu @ first.w[:, :d].T)[:, None, :] + (tr @ first.w[:, d:].T)[None, :, :] + first.b
    z, kz = run(_act(pre, first.activation).reshape(-1, pre.shape[2]), models["bridge"][1:])
    return z[:, 0], (tu, ku, tr, kr, pre, kz)


def pair_objective(models: Models, xu: np.ndarray, xr: np.ndarray) -> tuple[float, float, Models]:
    """Sum over users of the mean binary cross-entropy against all reviews of the batch, the own one positive."""
    n = len(xu)
    z, (tu, ku, tr, kr, pre, kz) = pair_logits(models, xu, xr)
    y = np.eye(n).ravel()
    loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum() / n)
    dz = (0.5 * (1 + np.tanh(z / 2)) - y) / n
    rest, dh = back(dz[:, None], models["bridge"][1:], kz)
    first, d = models["bridge"][0], tu.shape[1]
    dpre = _through(dh.reshape(pre.shape), pre, first.activation)
    da, db = dpre.sum(axis=1), dpre.sum(axis=0)
    top = Dense(np.concatenate([da.T @ tu, db.T @ tr], axis=1), dpre.sum(axis=(0, 1)), first.activation)
    return loss, float(n), {"bridge": [top, *rest], "tower_user": back(da @ first.w[:, :d], models["tower_user"], ku)[0],
                            "tower_review": back(db @ first.w[:, d:], models["tower_review"], kr)[0]}


# ------------------------------------------------------------------ models as vectors
def flatten(models: Models) -> np.ndarray:
    return np.concatenate([a for name in sorted(models) for layer in models[name] for a in (layer.w.ravel(), layer.b)])


def unflatten(vector: np.ndarray, like: Models) -> Models:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = []
        for layer in like[name]:
            w = vector[at:at + layer.w.size].reshape(layer.w.shape)
            at += layer.w.size
            out[name].append(Dense(w.copy(), vector[at:at + layer.b.size].copy(), layer.activation))
            at += layer.b.size
    return out


@dataclass
class Training:
    models: Models
    m: np.ndarray
    v: np.ndarray
    epoch: int = 0  # epochs done
    step: int = 0   # Adam steps done
    losses: list[float] = field(default_factory=list)

    @classmethod
    def fresh(cls, models: Models) -> Training:
        size = len(flatten(models))
        return cls(models, np.zeros(size), np.zeros(size))


def adam(w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int, lr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step, numbered from 1."""
    m = BETA1 * m + (1 - BETA1) * g
    v = BETA2 * v + (1 - BETA2) * g * g
    return w - lr * (m / (1 - BETA1 ** step)) / (np.sqrt(v / (1 - BETA2 ** step)) + EPS), m, v


# ------------------------------------------------------------------ tasks
def _aligned(rid: np.ndarray, rids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``rids``) of every row with each review that has its id; ``rids`` ascend."""
    first = np.searchsorted(rids, rid)
    size = np.searchsorted(rids, rid, "right") - first  # 1, unless review rows repeat an id
    return np.repeat(np.arange(len(rid)), size), np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _matrices(pdf: pd.DataFrame, du: int, dr: int):
    """(place in ``pdf``, user rows, review rows) of every mini-batch that has rows."""
    for i, (xu, xr) in enumerate(zip(pdf["xu"], pdf["xr"], strict=True)):
        xu, xr = np.asarray(xu, np.float64).reshape(-1, du), np.asarray(xr, np.float64).reshape(-1, dr)
        if "rid" in pdf:
            mine, theirs = _aligned(np.asarray(pdf["rid"].iat[i]), np.asarray(pdf["rids"].iat[i]))
            xu, xr = xu[mine], xr[theirs]
        if len(xu):
            yield i, xu, xr


def _columns(batches: DataFrame) -> DataFrame:
    return batches.select("accommodation_id", "batch_id", "xu", "xr", *[c for c in ("rid", "rids") if c in batches.columns])


def _chunks(vector: np.ndarray, part: int) -> pd.DataFrame:
    at = range(0, len(vector), CHUNK)
    return pd.DataFrame({"chunk": list(range(len(at))), "part": part, "g": [vector[i:i + CHUNK] for i in at]})


_CHUNKS = "chunk int, part int, g array<double>"


def _added(parts: DataFrame) -> np.ndarray | None:
    """The sum of the tasks' vectors: per chunk in task order, so it is the same whichever task ends first."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "g": [np.sum(np.stack(pdf.sort_values("part")["g"].to_list()), axis=0)]})

    rows = parts.groupBy("chunk").applyInPandas(add, "chunk int, g array<double>").collect()  # of the model's size
    return np.concatenate([np.asarray(r["g"]) for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else None


def _summed_job(told, objective: Objective, dims: tuple[int, int]):
    def job(frames):
        models = told.value
        total = np.zeros(len(flatten(models)) + 3)
        for pdf in frames:
            for _, xu, xr in _matrices(pdf, *dims):
                loss, weight, grads = objective(models, xu, xr)
                # the dual objective is a mean over its batch, the pair objective a sum over its users: both add up
                total[:-3] += flatten(grads)
                total[-3:] += loss, weight, not np.isfinite(loss)
        if total[-2]:
            yield _chunks(np.nan_to_num(total), TaskContext.get().partitionId())
    return job


def _local_job(told, objective: Objective, dims: tuple[int, int], lr: float):
    def job(frames):
        models, m, v, step = told.value
        w, done, loss_sum, weight_sum, bad = flatten(models), 0, 0.0, 0.0, 0
        for pdf in frames:
            for _, xu, xr in _matrices(pdf, *dims):
                loss, weight, grads = objective(unflatten(w, models), xu, xr)
                done += 1
                loss_sum, weight_sum, bad = loss_sum + loss, weight_sum + weight, bad + (not np.isfinite(loss))
                w, m, v = adam(w, m, v, flatten(grads) / weight, step + done, lr)
        if done:
            yield _chunks(np.nan_to_num(np.concatenate([w * done, m * done, v * done, [loss_sum, weight_sum, bad, done, 1]])),
                          TaskContext.get().partitionId())
    return job


# ------------------------------------------------------------------ A5 training state
STATE = ("model string, layer int, activation string, n_out int, n_in int, value array<double>, m array<double>, v array<double>, "
         "epoch int, step long, losses array<double>")


def save_state(spark: SparkSession, state: Training, state_dir: str) -> str:
    """One table of the whole training state under ``state_dir/epoch=N``."""
    rows, at = [], 0
    for name in sorted(state.models):
        for i, layer in enumerate(state.models[name]):
            size = layer.w.size + layer.b.size
            rows.append((name, i, layer.activation, *map(int, layer.w.shape), np.concatenate([layer.w.ravel(), layer.b]).tolist(),
                         state.m[at:at + size].tolist(), state.v[at:at + size].tolist(), state.epoch, state.step, list(map(float, state.losses))))
            at += size
    path = f"{state_dir}/epoch={state.epoch}"
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, state_dir: str) -> Training | None:
    """The state of the last epoch that was written completely; None if there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    epochs = [int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(root) if fs.exists(root) else [])
              if s.getPath().getName().startswith("epoch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not epochs:
        return None
    models, m, v = {}, [], []
    rows = spark.read.schema(STATE).parquet(f"{state_dir}/epoch={max(epochs)}").orderBy("model", "layer").collect()
    for r in rows:
        value, size = np.asarray(r["value"]), r["n_out"] * r["n_in"]
        models.setdefault(r["model"], []).append(Dense(value[:size].reshape(r["n_out"], r["n_in"]), value[size:], r["activation"]))
        m.append(np.asarray(r["m"]))
        v.append(np.asarray(r["v"]))
    return Training(models, np.concatenate(m), np.concatenate(v), rows[0]["epoch"], rows[0]["step"], list(rows[0]["losses"]))


# ------------------------------------------------------------------ the fit
def fit(batches: DataFrame, models: Models, objective: Objective, dims: tuple[int, int], *, epochs: int, lr: float, mode: str = "local",
        rounds: int = 1, state_dir: str | None = None, on_epoch: Callable[[Training], None] | None = None) -> Training:
    """Train ``models`` on the table of mini-batches; ``dims`` are the widths of a user and a review row.

    The loss of an epoch is the mean over its weights, each batch's measured before the step it leads to. An empty
    table leaves the models as they are, with NaN losses. ``on_epoch`` is called after each epoch (evaluation).
    """
    spark = batches.sparkSession
    ship_package(spark)
    if mode not in ("local", "summed"):
        raise ValueError(f"mode {mode} is not local or summed")
    state = (load_state(spark, state_dir) if state_dir else None) or Training.fresh(models)
    if [(k, [x.w.shape for x in state.models[k]]) for k in sorted(state.models)] != [(k, [x.w.shape for x in models[k]]) for k in sorted(models)]:
        raise ValueError("the saved training is of other models")
    rows = _columns(batches)
    while state.epoch < epochs:
        loss = weight = 0.0
        for r in range(rounds if mode == "summed" else 1):
            part = rows.where(F.pmod(F.xxhash64("accommodation_id", "batch_id"), F.lit(rounds)) == r) if mode == "summed" and rounds > 1 else rows
            if mode == "summed":
                told = spark.sparkContext.broadcast(state.models)
                total = _added(part.mapInPandas(_summed_job(told, objective, dims), _CHUNKS))
            else:
                told = spark.sparkContext.broadcast((state.models, state.m, state.v, state.step))
                total = _added(part.mapInPandas(_local_job(told, objective, dims, lr), _CHUNKS))
            told.unpersist()
            if total is None:
                continue
            if mode == "summed":
                *_, loss_r, weight_r, bad = total
                state.step += 1
                w, state.m, state.v = adam(flatten(state.models), state.m, state.v, total[:-3] / weight_r, state.step, lr)
            else:
                loss_r, weight_r, bad, done, workers = total[-5:]
                w, state.m, state.v = np.split(total[:-5] / done, 3)
                state.step += round(done / workers)
            if bad:
                raise FloatingPointError(f"epoch {state.epoch}: {bad:.0f} batches have a loss that is not finite")
            state.models = unflatten(w, state.models)
            loss, weight = loss + loss_r, weight + weight_r
        state.losses.append(loss / weight if weight else float("nan"))
        state.epoch += 1
        if state_dir:
            save_state(spark, state, state_dir)
        if on_epoch:
            on_epoch(state)
    return state


BATCH = ("accommodation_id long, batch_id long, pos array<long>, rid array<long>, xu array<double>, rids array<long>, xr array<double>")


def _dealt(one: DataFrame, workers: int) -> DataFrame:
    return one.repartition(workers, "accommodation_id", "batch_id").sortWithinPartitions("batch_id", "accommodation_id")


def batch_table(users: DataFrame, reviews: DataFrame, workers: int) -> DataFrame:
    """``users(accommodation_id, batch_id, pos, review_id, xu)`` and each batch's ``reviews(accommodation_id, batch_id, review_id, xr)``
    -> one compact row per mini-batch, dealt to ``workers`` partitions in a fixed order."""
    of = ["accommodation_id", "batch_id"]
    u = users.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("pos", "review_id", "xu"))).alias("rows"))
    u = u.select(*of, F.transform("rows", lambda x: x["pos"].cast("long")).alias("pos"), F.transform("rows", lambda x: x["review_id"]).alias("rid"),
                 F.flatten(F.transform("rows", lambda x: x["xu"])).alias("xu"))
    r = reviews.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("review_id", "xr"))).alias("rows"))
    r = r.select(*of, F.transform("rows", lambda x: x["review_id"]).alias("rids"), F.flatten(F.transform("rows", lambda x: x["xr"])).alias("xr"))
    return _dealt(u.join(r, of), workers)


def plain_batches(batches: DataFrame) -> DataFrame:
    """A compact table as ``(accommodation_id, batch_id, xu, xr)``, where row i of ``xr`` is the review of row i of ``xu``."""
    ship_package(batches.sparkSession)

    def job(frames):
        for pdf in frames:
            rows = []
            for a, b, rid, xu, rids, xr in zip(*[pdf[c] for c in ("accommodation_id", "batch_id", "rid", "xu", "rids", "xr")], strict=True):
                mine, theirs = _aligned(np.asarray(rid), np.asarray(rids))
                if len(mine):
                    rows.append((a, b, xu.reshape(len(rid), -1)[mine].ravel(), xr.reshape(len(rids), -1)[theirs].ravel()))
            if rows:
                yield pd.DataFrame(rows, columns=["accommodation_id", "batch_id", "xu", "xr"])

    return batches.select("accommodation_id", "batch_id", "rid", "xu", "rids", "xr").mapInPandas(
        job, "accommodation_id long, batch_id long, xu array<double>, xr array<double>")


def encoded_batches(batches: DataFrame, encoders: Models, of: int, size: int, workers: int) -> DataFrame:
    """The mini-batches of ``size`` rows, both sides encoded, cut out of a compact table of ``of`` rows each (a multiple of ``size``).

    Rows are numbered alike for both sizes, so the small batches are pieces of the large ones, and the features needn't be
    joined and collected again."""
    ship_package(batches.sparkSession)
    told = batches.sparkSession.sparkContext.broadcast(encoders)
    names = [f.split()[0] for f in BATCH.split(", ")]

    def job(frames):
        for pdf in frames:
            rows = []
            for a, b, pos, rid, xu, rids, xr in zip(*[pdf[c] for c in names], strict=True):
                pos, rid, rids = np.asarray(pos), np.asarray(rid), np.asarray(rids)
                u = forward(np.asarray(xu, np.float64).reshape(len(rid), -1), told.value["user"])
                r = forward(np.asarray(xr, np.float64).reshape(len(rids), -1), told.value["review"])
                for p in np.unique(pos // size).tolist():
                    m = pos // size == p
                    held = np.isin(rids, rid[m])
                    rows.append((a, b * (of // size) + p, pos[m] % size, rid[m], u[m].ravel(), rids[held], r[held].ravel()))
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return _dealt(batches.select(*names).mapInPandas(job, BATCH), workers)


def batch_losses(batches: DataFrame, models: Models, objective: Objective, dims: tuple[int, int]) -> DataFrame:
    """(accommodation_id, batch_id, loss): each mini-batch's mean loss under the given models."""
    ship_package(batches.sparkSession)
    told = batches.sparkSession.sparkContext.broadcast(models)

    def job(frames):
        for pdf in frames:
            at, losses = [], []
            for i, xu, xr in _matrices(pdf, *dims):
                loss, weight = objective(told.value, xu, xr)[:2]  # no gradient is kept
                at.append(i)
                losses.append(loss / weight)
            if at:
                yield pdf[["accommodation_id", "batch_id"]].iloc[at].assign(loss=losses)

    return _columns(batches).mapInPandas(job, "accommodation_id long, batch_id long, loss double")
