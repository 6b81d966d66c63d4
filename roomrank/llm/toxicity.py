"""4. Toxicity: cumulative-link ordinal regression on sparse word features.

The labels say toxic or not; severity grades 0 to 3 are made from them. Words (runs of letters,
A-Z lower-cased) are counted by document in both classes of the training rows; a word's evidence is
its smoothed log odds. Toxic training documents are graded 1, 2 or 3 by thirds of their summed
positive evidence, the others are grade 0. The model is P(grade > k) = sigmoid(w x - t_k) with one
weight vector shared by the ordered thresholds t_0 < t_1 < t_2; x marks which of the `vocabulary`
words of most significant evidence a document has. Expected severity is the sum of the three
probabilities.

Training rows are a bounded sample: the `sample` labelled rows of least hash. Every document is
scored in whole by one pass; no text is shuffled (the sample's ids are broadcast, `sample` of them at most).

Null and empty texts score as a document without any known word. Unlabelled rows and null labels
don't train; without both classes every severity is that of the base rate. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrank.llm.bytes_text import NO_LETTER, slices, word_hashes, words

SAMPLE = 20_000
VOCABULARY = 4096
LEAST_DOCS = 5
LEAST_Z = 3.0
GRADES = 3
TOXIC_FROM = 0.22


def _distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word fingerprint), each once."""
    ws, we, bounds = words(data, starts, NO_LETTER)
    h = word_hashes(data, ws, we)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(bounds))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _word_rows(batches):
    for batch in batches:
        for lo, data, starts in slices(batch.column(2)):
            row, h = _distinct_words(data, starts)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h.view(np.int64))],
                                             names=["row", "toxic", "word"])


class OrdinalModel:
    """Words (sorted fingerprints), shared weights, ordered thresholds."""

    def __init__(self, vocab: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.vocab, self.weights, self.thresholds = vocab, weights, thresholds

    def severity(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity, and P(grade > 0), of each text."""
        z = np.zeros(len(starts) - 1)
        if len(self.vocab) and len(data):
            ws, we, bounds = words(data, starts, NO_LETTER)
            h = word_hashes(data, ws, we)
            place = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
            hit = np.flatnonzero(self.vocab[place] == h)
            row = np.searchsorted(bounds, hit, "right") - 1
            code = np.unique(row * len(self.vocab) + place[hit])
            z = np.bincount(code // len(self.vocab), weights=self.weights[code % len(self.vocab)], minlength=len(z))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -50, 50)))
        return p.sum(axis=1), p[:, 0]


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_words: int, steps: int = 300, rate: float = 0.1,
                l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log likelihood; (row, col) are the set entries of x."""
    n = len(grade)
    share = np.array([(grade > k).mean() for k in range(GRADES)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(GRADES) * 1e-3)
    theta = np.concatenate([np.zeros(n_words), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for step in range(1, steps + 1):
        w = theta[:n_words]
        gaps = np.exp(theta[n_words + 1:])
        t = theta[n_words] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, weights=w[col], minlength=n)
        q = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -50, 50)))  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), q, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
        slope = q * (1 - q)
        slope = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], axis=1)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p
        dz = -(up - down) / n
        dt = np.zeros(GRADES)
        for k in range(GRADES):
            dt[k] = (up[grade == k + 1].sum() - down[grade == k].sum()) / n
        g = np.concatenate([np.bincount(col, weights=dz[row], minlength=n_words) + l2 * w, [dt.sum()],
                            [dt[k + 1:].sum() * gaps[k] for k in range(GRADES - 1)]])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    t = theta[n_words] + np.concatenate([[0], np.cumsum(np.exp(theta[n_words + 1:]))])
    return theta[:n_words], t


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> OrdinalModel:
    """Fit on the `sample` labelled documents (label columns doc_id, toxic) of least hash."""
    chosen = (labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample))
    rows = (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text")
            .mapInArrow(_word_rows, "row long, toxic long, word long").distinct())
    counted = rows.groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= LEAST_DOCS)
    totals = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).join(F.broadcast(chosen), "doc_id").distinct().groupBy("toxic").count().collect()
    n = {int(r["toxic"]): r["count"] for r in totals}
    pos, neg = n.get(1, 0), n.get(0, 0)
    base = np.log((neg + 1) / (pos + 1)) + np.arange(GRADES) * 1.0
    if not pos or not neg:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), base)
    if not counted.limit(1).count():
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), base)
    a, b = F.col("a") + 0.5 * pos / (pos + neg), F.col("c") - F.col("a") + 0.5 * neg / (pos + neg)
    evidence = F.log(a / (pos + 0.5 - F.col("a") + 0.5)) - F.log(b / (neg + 0.5 - F.col("c") + F.col("a") + 0.5))
    top = (counted.withColumn("e", evidence).withColumn("z", F.col("e") / F.sqrt(1 / a + 1 / b))
           .where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "word").limit(vocabulary))
    top_rows = top.select("word", "e", "z").collect()
    if not top_rows:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), base)
    vocab = np.array([r["word"] for r in top_rows], np.int64).view(np.uint64)
    order = np.argsort(vocab)
    vocab, e = vocab[order], np.array([r["e"] for r in top_rows], float)[order]
    # every training document, those without any of the words too
    entries = (rows.join(F.broadcast(top.select("word").withColumn("known", F.lit(True))), "word", "left").groupBy("row", "toxic")
               .agg(F.collect_list(F.when(F.col("known"), F.col("word"))).alias("w")).toArrow())
    lists = entries.column("w").combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    col = np.searchsorted(vocab, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    toxic = entries.column("toxic").to_numpy()
    ids = entries.column("row").to_numpy()
    by_id = np.argsort(ids, kind="stable")  # the same order whatever the partitions were
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    row, toxic = rank[row], toxic[by_id]
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    strength = np.bincount(row, weights=np.maximum(e[col], 0), minlength=len(toxic))
    cuts = np.quantile(strength[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else [0, 0]
    grade = np.where(toxic == 1, 1 + (strength > cuts[0]) + (strength > cuts[1]), 0)
    weights, thresholds = fit_ordinal(row, col, grade, len(vocab))
    return OrdinalModel(vocab, weights, thresholds)


def _score(model):
    def work(batches):
        m = model.value
        for batch in batches:
            for lo, data, starts in slices(batch.column(1)):
                severity, p = m.severity(data, starts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(p)), pa.array(severity), pa.array(p)], names=["doc_id", "severity", "p_toxic"])
    return work


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """One row per row of docs: doc_id, severity (expected, 0 to 3), p_toxic, grade (rounded severity), toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # `vocabulary` weights
    out = (docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
           .mapInArrow(_score(sent), "doc_id long, severity double, p_toxic double"))
    return out.withColumn("grade", F.round("severity").cast("int")).withColumn("toxic", F.col("severity") >= toxic_from)
