"""Model jobs (A5, I2-I6, I8, I10) re-aimed as Spark jobs.

* Weights live in a table ``(model, layer, n_in, n_out, weight, bias)`` saved as parquet (A5);
  a model is a short list of dense layers, small enough to broadcast.
* Encoding (I2, I3) is an Arrow-batched ``mapInPandas``: numpy matmuls with the broadcast
  weights, each entity encoded once.
* Pair scoring (I4) splits the bridge's first layer into a user part and a review part, so the
  per-entity parts are computed once and only the remaining layers run per pair, inside the
  blocked scorer (no pair rows).
* Pair-scorer fitting (I5) trains ``pyspark.ml``'s multilayer perceptron on positives plus
  in-batch negatives taken by a fixed shift (linear in the data); its weights are then read
  back into the same numpy form for blocked scoring.
* Dual-encoder fitting (I6) is data-parallel gradient descent: each task computes gradient
  sums of the in-batch softmax loss for its batches, Spark sums them per parameter, the driver
  applies the Adam step to the (model-sized) weights and broadcasts them again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrank.operators.scoring import PairScorer

LEAKY_SLOPE = 0.01  # default negative slope of the LeakyReLU activation

WEIGHTS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("layer", T.IntegerType()),
    T.StructField("n_in", T.IntegerType()), T.StructField("n_out", T.IntegerType()),
    T.StructField("activation", T.StringType()),
    T.StructField("weight", T.ArrayType(T.DoubleType())), T.StructField("bias", T.ArrayType(T.DoubleType())),
])


@dataclass
class Dense:
    w: np.ndarray          # (n_out, n_in)
    b: np.ndarray          # (n_out,)
    activation: str        # "leaky_relu" | "sigmoid" | "none"


def _act(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "leaky_relu":
        return np.maximum(x, LEAKY_SLOPE * x)
    if kind == "sigmoid":
        return 1.0 / (1.0 + np.exp(-x))
    return x


def init_mlp(sizes: list[int], seed: int = 0, hidden: str = "leaky_relu") -> list[Dense]:
    """Xavier-uniform weights, zero biases; activation after every layer but the last."""
    rng = np.random.default_rng(seed)
    layers = []
    for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        bound = np.sqrt(6.0 / (a + b))
        layers.append(Dense(rng.uniform(-bound, bound, size=(b, a)), np.zeros(b),
                            hidden if i < len(sizes) - 2 else "none"))
    return layers


def formula_mlp(sizes: list[int], model: int, hidden: str = "leaky_relu") -> list[Dense]:
    """Weights from an integer formula that any engine can evaluate: (((7 i + 13 j + 5 layer + 3 model) mod 17) - 8) / 32."""
    layers = []
    for n, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        i, j = np.arange(b)[:, None], np.arange(a)[None, :]
        layers.append(Dense(((7 * i + 13 * j + 5 * n + 3 * model) % 17 - 8) / 32.0, np.zeros(b), hidden if n < len(sizes) - 2 else "none"))
    return layers


def forward(x: np.ndarray, layers: list[Dense]) -> np.ndarray:
    """Inference forward pass (dropout is off at inference)."""
    for l in layers:
        x = _act(x @ l.w.T + l.b, l.activation)
    return x


# ------------------------------------------------------------------ A5 weights table
def weights_frame(spark: SparkSession, models: dict[str, list[Dense]]) -> DataFrame:
    rows = [(name, i, int(l.w.shape[1]), int(l.w.shape[0]), l.activation, l.w.ravel().tolist(), l.b.tolist())
            for name, layers in models.items() for i, l in enumerate(layers)]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def save_weights(spark: SparkSession, models: dict[str, list[Dense]], path: str) -> None:
    weights_frame(spark, models).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, list[Dense]]:
    """Read a weights table; the rows are model parameters (bounded by model size), not data."""
    out: dict[str, list[Dense]] = {}
    for r in spark.read.parquet(path).orderBy("model", "layer").collect():
        out.setdefault(r["model"], []).append(
            Dense(np.asarray(r["weight"], dtype=np.float64).reshape(r["n_out"], r["n_in"]),
                  np.asarray(r["bias"], dtype=np.float64), r["activation"]))
    return out


def encoder_id(models: dict[str, list[Dense]]) -> str:
    """Digest of the encoders' weights."""
    h = hashlib.sha1()
    for name in ("user", "review"):
        for l in models[name]:
            h.update(np.ascontiguousarray(l.w).tobytes() + np.ascontiguousarray(l.b).tobytes() + l.activation.encode())
    return h.hexdigest()[:16]


def save_scorer(spark: SparkSession, scorer: list[Dense], encoders: dict[str, list[Dense]], path: str) -> None:
    """The pair scorer with the id of the encoders it was fitted on."""
    weights_frame(spark, {f"pair_scorer-{encoder_id(encoders)}": scorer}).write.mode("overwrite").parquet(path)


def load_scorer(spark: SparkSession, path: str, encoders: dict[str, list[Dense]]) -> list[Dense]:
    """The pair scorer; refuses one that was fitted on other encoders."""
    (name, layers), = load_weights(spark, path).items()
    if name != f"pair_scorer-{encoder_id(encoders)}":
        raise ValueError(f"{name} was not fitted on encoders {encoder_id(encoders)}")
    return layers


def save_pair_models(spark: SparkSession, models: dict[str, list[Dense]], encoders: dict[str, list[Dense]], path: str) -> None:
    """Towers and bridge, each under a name with the id of the encoders they were fitted on."""
    weights_frame(spark, {f"{name}-{encoder_id(encoders)}": layers for name, layers in models.items()}).write.mode("overwrite").parquet(path)


def load_pair_models(spark: SparkSession, path: str, encoders: dict[str, list[Dense]]) -> dict[str, list[Dense]]:
    """Towers and bridge; refuses those that were fitted on other encoders."""
    out = {}
    for name, layers in load_weights(spark, path).items():
        model, _, of = name.rpartition("-")
        if of != encoder_id(encoders):
            raise ValueError(f"{name} was not fitted on encoders {encoder_id(encoders)}")
        out[model] = layers
    return out


# ------------------------------------------------------------------ I2 I3 encoders
def encode(df: DataFrame, id_col: str, vec_col: str, layers: list[Dense], out_col: str = "emb", keys: tuple = ()) -> DataFrame:
    """Apply an MLP to every row's vector, Arrow batch at a time, weights broadcast once; ``keys`` pass through."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(layers)
    carried = [id_col, *keys]
    schema = T.StructType([*df.select(*carried).schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def job(batches):
        ls = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            y = forward(x, ls)
            yield pdf[carried].assign(**{out_col: list(y)})

    return df.select(*carried, vec_col).mapInPandas(job, schema)


# ------------------------------------------------------------------ I4 pair scorer
class BridgeScorer(PairScorer):
    """Score = bridge(concat(a, b)) for encoded user ``a`` and encoded review ``b``.

    The first bridge layer acts on ``[a; b]`` as ``W_a a + W_b b + bias``: both parts are
    computed per entity of the block, and only the remaining layers run per pair.
    """

    def __init__(self, bridge: list[Dense], dim_user: int, out: str = "logit"):
        self.bridge, self.du, self.out = bridge, dim_user, out

    def _from_parts(self, pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
        first = self.bridge[0]
        h = _act(pa + pb + first.b, first.activation)
        h = forward(h, self.bridge[1:])
        if self.out == "logit":
            return h[..., 0]
        # two-class softmax output: log-odds of class 1
        return h[..., 1] - h[..., 0]

    def matrix(self, q, it):
        w = self.bridge[0].w
        pa = q @ w[:, :self.du].T                    # (nq, h)
        pb = it @ w[:, self.du:].T                   # (ni, h)
        return self._from_parts(pa[:, None, :], pb[None, :, :])

    def paired(self, q, t):
        w = self.bridge[0].w
        return self._from_parts(q @ w[:, :self.du].T, t @ w[:, self.du:].T)


def pair_score_rows(pairs: DataFrame, scorer: BridgeScorer, a: str = "a", b: str = "b") -> DataFrame:
    """Score row-aligned pairs ``(user_id, review_id, a, b)`` with the bridge (I4)."""
    bc = pairs.sparkSession.sparkContext.broadcast(scorer)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("review_id", T.LongType()),
                           T.StructField("score", T.DoubleType())])

    def job(batches):
        sc = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            s = sc.paired(np.stack(pdf[a].to_numpy()), np.stack(pdf[b].to_numpy()))
            yield pd.DataFrame({"user_id": pdf["user_id"].to_numpy(), "review_id": pdf["review_id"].to_numpy(),
                                "score": s})

    return pairs.select("user_id", "review_id", a, b).mapInPandas(job, schema)


# ------------------------------------------------------------------ I5 pair-scorer fit (MLlib)
def negative_pairs(batched: DataFrame, k: int = 3) -> DataFrame:
    """Positives plus ``k`` in-batch negatives per user, taken by position shift (no all-pairs).

    ``batched(accommodation_id, batch_id, pos, n_in_batch, user_id, review_id, a, b)``; the
    negative ``j`` of a user is the review of the user ``j`` places further in the batch.
    """
    base = batched.select("accommodation_id", "batch_id", "pos", "n_in_batch", "user_id", "a")
    rev = batched.select("accommodation_id", "batch_id", F.col("pos").alias("rpos"), "review_id", "b")
    pos = batched.select("user_id", "review_id", "a", "b", F.lit(1.0).alias("label"))
    shifts = [base.withColumn("rpos", F.pmod(F.col("pos") + F.lit(j), F.col("n_in_batch")))
              .where(F.col("n_in_batch") > j) for j in range(1, k + 1)]
    neg = None
    for s in shifts:
        part = (s.join(rev, ["accommodation_id", "batch_id", "rpos"])
                .select("user_id", "review_id", "a", "b", F.lit(0.0).alias("label")))
        neg = part if neg is None else neg.unionByName(part)
    return pos.unionByName(neg) if neg is not None else pos


def fit_pair_mlp(train_pairs: DataFrame, hidden: int = 16, max_iter: int = 60, seed: int = 0):
    """Fit MLlib's perceptron on ``concat(a, b)``; returns (model, BridgeScorer over its weights).

    MLlib's perceptron has sigmoid hidden layers and a softmax output: the same purpose as the
    reference's LeakyReLU bridge with one logit, not the same function.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = train_pairs.select(array_to_vector(F.concat("a", "b")).alias("features"), "label")
    first = train_pairs.select(F.size("a").alias("da"), F.size("b").alias("db")).first()
    da, db = int(first["da"]), int(first["db"])
    mlp = MultilayerPerceptronClassifier(layers=[da + db, hidden, 2], maxIter=max_iter, seed=seed,
                                         blockSize=128)
    model = mlp.fit(data)
    return model, BridgeScorer(mllib_layers(model.weights.toArray(), [da + db, hidden, 2]), da, out="log_odds")


def mllib_layers(weights: np.ndarray, sizes: list[int]) -> list[Dense]:
    """MLlib's flat weight vector -> dense layers (column-major n_out x n_in matrix, then bias)."""
    layers, off = [], 0
    for i, (n_in, n_out) in enumerate(zip(sizes[:-1], sizes[1:])):
        w = weights[off:off + n_in * n_out].reshape(n_in, n_out).T
        off += n_in * n_out
        b = weights[off:off + n_out]
        off += n_out
        layers.append(Dense(w, b, "sigmoid" if i < len(sizes) - 2 else "none"))
    return layers


# ------------------------------------------------------------------ I6 dual-encoder fit
_GRAD_SCHEMA = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("g", T.DoubleType())])


def _grad_job(bc, du: int, dr: int, k: int):
    n_wu, n_wr = k * du, k * dr

    def fn(batches):
        wu, wr = bc.value
        gu, gr = np.zeros_like(wu), np.zeros_like(wr)
        loss_sum, nb, bad = 0.0, 0, 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = len(row.uids)
                xu = np.asarray(row.xu, dtype=np.float64).reshape(n, du)
                xr = np.asarray(row.xr, dtype=np.float64).reshape(n, dr)
                u, r = xu @ wu.T, xr @ wr.T                    # (n, k)
                s = u @ r.T
                mx = s.max(axis=1, keepdims=True)
                e = np.exp(s - mx)
                p = e / e.sum(axis=1, keepdims=True)
                loss = float(np.mean(np.log(e.sum(axis=1)) + mx[:, 0] - np.diag(s)))
                bad += not np.isfinite(loss)
                loss_sum += loss
                ds = (p - np.eye(n)) / n                        # d(batch mean loss)/dS
                du_, dr_ = ds @ r, ds.T @ u
                gu += du_.T @ xu
                gr += dr_.T @ xr
                nb += 1
        idx = np.arange(n_wu + n_wr + 3, dtype=np.int32)
        vals = np.concatenate([gu.ravel(), gr.ravel(), [loss_sum, float(nb), float(bad)]])
        vals = np.nan_to_num(vals)  # pandas hands NaN on as null, which a sum skips; `bad` tells
        yield pd.DataFrame({"idx": idx, "g": vals})

    return fn


def fit_dual_encoders(batches: DataFrame, du: int, dr: int, k: int = 16, epochs: int = 5, lr: float = 0.05,
                      seed: int = 0):
    """Train linear user / review encoders with the in-batch softmax loss.

    ``batches(accommodation_id, batch_id, uids, xu, xr)``: one row per mini-batch, flattened
    feature blocks. Returns ``(wu, wr, losses)`` with the mean batch loss of every epoch,
    measured before that epoch's step. The batch table should be materialised by the caller.
    """
    spark = batches.sparkSession
    rng = np.random.default_rng(seed)
    wu = rng.normal(0, 1 / np.sqrt(du), size=(k, du))
    wr = rng.normal(0, 1 / np.sqrt(dr), size=(k, dr))
    m = [np.zeros_like(wu), np.zeros_like(wr)]
    v = [np.zeros_like(wu), np.zeros_like(wr)]
    b1, b2, eps = 0.9, 0.999, 1e-8
    losses = []
    for epoch in range(epochs):
        bc = spark.sparkContext.broadcast((wu, wr))
        g = (batches.mapInPandas(_grad_job(bc, du, dr, k), _GRAD_SCHEMA)
             .groupBy("idx").agg(F.sum("g").alias("g")).orderBy("idx").collect())
        vals = np.array([r["g"] for r in g])
        n_b = max(vals[-2], 1.0)
        losses.append(vals[-3] / n_b)
        if vals[-1]:
            raise FloatingPointError(f"epoch {epoch}: {vals[-1]:.0f} batches have a loss that is not finite")  # B14
        grads = [vals[:k * du].reshape(k, du) / n_b, vals[k * du:k * du + k * dr].reshape(k, dr) / n_b]
        params = [wu, wr]
        for i in range(2):  # Adam step on the driver (model-sized arrays)
            m[i] = b1 * m[i] + (1 - b1) * grads[i]
            v[i] = b2 * v[i] + (1 - b2) * grads[i] ** 2
            mh, vh = m[i] / (1 - b1 ** (epoch + 1)), v[i] / (1 - b2 ** (epoch + 1))
            params[i] = params[i] - lr * mh / (np.sqrt(vh) + eps)
        wu, wr = params
        bc.unpersist()
    return wu, wr, losses
