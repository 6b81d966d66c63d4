"""5. Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing: a word (as written, by fingerprint in one of `BUCKETS` buckets) has a fixed sparse
ternary index vector; its word vector is the sum of the index vectors of the words up to two places
away, over every occurrence in all documents. The sums are integers, added per task and then over
tasks, so they don't depend on the partitions; the table has a fixed size. A document's features pool
its word vectors: their mean, the least and the greatest mean of its 32-word windows, how alike
neighbouring words are (mean and greatest window), and its length. A network with one hidden layer,
written in numpy, is fitted to the labels, and its outputs are divided by a temperature fitted on
training rows kept aside, so scores are calibrated probabilities of label 1.

Labels are learned only from rows whose crc32(doc_id as text) modulo 5 is not 0, at most `sample` of
them (those of least hash; remainder 1 sets the temperature). Words are the only inputs of a score.

Null and empty texts have zero features and a score like any other. Without labels of both kinds
every score is the base rate (0.5 without any). Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomrank.llm.bytes_text import slices, word_hashes, words
from roomrank.llm.shared import written

BUCKETS = 1 << 14
DIM = 32
WINDOW = 32
SAMPLE = 20_000
HIDDEN = 32
CUT = 0.3
N_FEATURES = 3 * DIM + 3


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary vectors: two entries of 1 and two of -1 in each."""
    rng = np.random.default_rng(5)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :4]
    out = np.zeros((BUCKETS, DIM), np.int32)
    out[np.arange(BUCKETS)[:, None], at] = [1, 1, -1, -1]
    return out


def _word_ids(data, starts):
    ws, we, bounds = words(data, starts)
    return (word_hashes(data, ws, we, lower=False) % np.uint64(BUCKETS)).astype(np.int64), bounds


def _sum_contexts(batches):
    index = index_vectors()
    sums = np.zeros((BUCKETS, DIM), np.int64)
    for batch in batches:
        for _, data, starts in slices(batch.column(0)):
            ids, bounds = _word_ids(data, starts)
            if len(ids) < 2:
                continue
            row = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
            ctx = np.zeros((len(ids), DIM), np.int32)
            for d in (1, 2):
                same = row[d:] == row[:-d]
                a = np.flatnonzero(same)
                ctx[a] += index[ids[a + d]]
                ctx[a + d] += index[ids[a]]
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            sums[ids[order][first]] += np.add.reduceat(ctx[order], first, axis=0)
    used = np.flatnonzero(np.abs(sums).sum(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))] + [pa.array(sums[used, j]) for j in range(DIM)],
                                         names=["bucket"] + [f"c{j}" for j in range(DIM)])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) unit word vectors over all documents; the table of a fixed size comes to the driver."""
    names = [f"c{j}" for j in range(DIM)]
    sums = (docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_sum_contexts, "bucket int, " + ", ".join(f"{n} long" for n in names))
            .groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])).toArrow()
    table = np.zeros((BUCKETS, DIM))
    if sums.num_rows:
        table[sums.column("bucket").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    return unit(table).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def pooled(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES) float32."""
    n = len(starts) - 1
    out = np.zeros((n, N_FEATURES), np.float32)
    ids, bounds = _word_ids(data, starts)
    count = np.diff(bounds)
    out[:, -1] = np.log1p(count)
    if not len(ids):
        return out
    row = np.repeat(np.arange(n), count)
    place = np.arange(len(ids)) - bounds[row]
    # windows of WINDOW words; a shorter rest belongs to the window before
    n_win = np.maximum(count // WINDOW, 1)
    win = np.minimum(place // WINDOW, n_win[row] - 1)
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(win, prepend=-1) != 0))
    size = np.diff(np.append(first, len(ids)))
    v = table[ids]
    means = np.add.reduceat(v, first, axis=0) / size[:, None]
    alike = np.zeros(len(ids), np.float32)
    alike[1:] = (v[1:] * v[:-1]).sum(axis=1) * (row[1:] == row[:-1]) + (ids[1:] == ids[:-1]) * (row[1:] == row[:-1])
    alike_means = np.add.reduceat(alike, first) / size
    of = row[first]
    texts = np.flatnonzero(np.diff(of, prepend=-1))
    at = of[texts]
    out[at, :DIM] = np.add.reduceat(means * size[:, None], texts, axis=0) / count[at][:, None]
    out[at, DIM:2 * DIM] = np.minimum.reduceat(means, texts, axis=0)
    out[at, 2 * DIM:3 * DIM] = np.maximum.reduceat(means, texts, axis=0)
    out[at, 3 * DIM] = np.add.reduceat(alike_means * size, texts) / count[at]
    out[at, 3 * DIM + 1] = np.maximum.reduceat(alike_means, texts)
    return out


def _features(table):
    def work(batches):
        t = table.value
        for batch in batches:
            for lo, data, starts in slices(batch.column(1)):
                f = pooled(data, starts, t)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * N_FEATURES, pa.int32()), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(f)), lists], names=["doc_id", "features"])
    return work


class Network:
    """Standardised inputs, tanh hidden layer, one logit divided by a temperature."""

    def __init__(self, base: float = 0.5) -> None:
        self.base = base
        self.w1 = None
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.sd).clip(-8, 8) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, x_aside: np.ndarray, y_aside: np.ndarray, hidden: int = HIDDEN, epochs: int = 40,
            batch: int = 256, rate: float = 3e-3, l2: float = 1e-4) -> None:
        rng = np.random.default_rng(7)
        x = x.astype(np.float64)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        xs = ((x - self.mean) / self.sd).clip(-8, 8)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden),
             np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                i = order[lo:lo + batch]
                h = np.tanh(xs[i] @ w[0] + w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -50, 50))) - y[i]) / len(i)
                dh = np.outer(d, w[2]) * (1 - h * h)
                grads = [xs[i].T @ dh + l2 * w[0], dh.sum(axis=0), h.T @ d + l2 * w[2], d.sum()]
                step += 1
                r = rate * (1 - epoch / epochs)
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - r * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = w
        if len(y_aside):
            z = self.logits(x_aside.astype(np.float64))
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
            loss = [np.mean(np.logaddexp(0, z / t) - y_aside * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features) of every row, written: two passes over the texts, none of them shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text))  # BUCKETS x DIM floats
    return written(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
                   .mapInArrow(_features(table), "doc_id long, features array<float>"), "quality-features")


def training_rows(labels: DataFrame, sample: int) -> DataFrame:
    return (labels.where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id")) != 0)
            .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))


def fit(made: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on at most `sample` labelled rows outside the held-out fold (label columns doc_id, quality)."""
    chosen = training_rows(labels, sample)
    got = (made.join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "quality", (remainder(F.col("doc_id")) == 1).alias("aside"))
           .toArrow())
    y = got.column("quality").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 0.5)
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), N_FEATURES)
    order = np.lexsort((*x[:, :2].T, got.column("doc_id").to_numpy()))  # the same order whatever the partitions were
    x, y, aside = x[order], y[order], got.column("aside").to_numpy(zero_copy_only=False)[order]
    net = Network()
    if (~aside).sum() == 0 or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    net.fit(x[~aside], y[~aside], x[aside], y[aside])
    return net


def _score(net):
    def work(batches):
        m = net.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(x))], names=["doc_id", "score"])
    return work


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= cut)."""
    made = features(docs, doc_id, text)
    net = docs.sparkSession.sparkContext.broadcast(fit(made, labels, sample))
    return (made.mapInArrow(_score(net), "doc_id long, score double")
            .select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= cut).cast("int").alias("predicted")))


def _keep(table, net, text_at, cut):
    def work(batches):
        t, m = table.value, net.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, data, starts in slices(batch.column(text_at)):
                x = pooled(data, starts, t)
                keep[lo:lo + len(x)] = m.scores(x) >= cut
            yield batch.filter(pa.array(keep))
    return work


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, that score `cut` or more. No text is shuffled."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(word_vectors(docs, text))
    chosen = training_rows(labels, sample).select("doc_id").distinct()
    made = (docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .join(F.broadcast(chosen), "doc_id").mapInArrow(_features(table), "doc_id long, features array<float>"))
    net = sc.broadcast(fit(made, labels, sample))
    return docs.mapInArrow(_keep(table, net, docs.columns.index(text), cut), docs.schema)
