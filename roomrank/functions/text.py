"""Review text: null fill, prompt rendering, and text encoders.

Rendering is one native ``concat`` per row. The default encoder is a hashed bag of tokens
built from native expressions (split, md5, conv), so it runs distributed over whole texts
with no model download; any other encoder plugs in through ``encode_with``, an Arrow-batched
``mapInPandas`` job that builds its model once per task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These strings must equal the reference's so rendered prompts agree.
# ---------------------------------------------------------------------------
FILL_VALUE = "None Given"
TEXT_COLS = ["review_title", "review_positive", "review_negative"]
# prompt without score and votes (used for the review vector):
PROMPT_SHORT = ("clustering: The following is a review on a website for some accommodation.\n"
                "    The review title is: {title}.\n"
                "    The positive review portion: {positive}.\n"
                "    The negative review portion: {negative}.\n")
# prompt with all five fields:
PROMPT_FULL = ("\n"
               "    The following data is a review by a user of an anonymous hotel/accomodation.\n"
               "    The review title is: {title}.\n"
               "    The user wrote this positive review portion: {positive}.\n"
               "    The user wrote this negative review portion: {negative}.\n"
               "    The overall Score the user gave is: {score}.\n"
               "    When published, this review garnered {review} 'helpful' notes.\n"
               "    \n"
               "    ")
HASH_DIM = 64


def fill_text(df: DataFrame, cols=TEXT_COLS, value: str = FILL_VALUE) -> DataFrame:
    """Fill nulls of the text columns only (numeric columns keep their nulls)."""
    return df.fillna(value, subset=[c for c in cols if c in df.columns])


def render(template: str, values: dict[str, Column]) -> Column:
    """Substitute ``{name}`` placeholders with columns: one native ``concat``."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(values[rest[i + 1:j]].cast("string"))
        rest = rest[j + 1:]
    return F.concat(*parts)


def review_prompt(title="review_title", positive="review_positive", negative="review_negative") -> Column:
    return render(PROMPT_SHORT, {"title": F.col(title), "positive": F.col(positive), "negative": F.col(negative)})


def review_prompt_full(title="review_title", positive="review_positive", negative="review_negative",
                       score="review_score", votes="review_helpful_votes") -> Column:
    return render(PROMPT_FULL, {"title": F.col(title), "positive": F.col(positive), "negative": F.col(negative),
                                "score": F.col(score), "review": F.col(votes)})


# ---------------------------------------------------------------------------
# hashed-token encoder (default, native)
# ---------------------------------------------------------------------------

def tokens(text: Column) -> Column:
    """Lower-cased tokens split on single spaces, empty tokens removed (whole text)."""
    return F.filter(F.split(F.lower(text), " "), lambda t: t != F.lit(""))


def token_bucket(token: Column, dim: int = HASH_DIM) -> Column:
    """First 8 hex digits of md5(token) as an integer, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hashed_token_counts(df: DataFrame, id_col: str, text: Column, dim: int = HASH_DIM) -> DataFrame:
    """Long form ``(id, position, value)``: L2-normalised token counts per hash bucket.

    Tokens are exploded and counted with a grouped aggregate, so the work is spread over
    the cluster by (id, bucket) and no text is ever cut short. The partial aggregate runs in
    the task that read the text, so at most ``dim`` rows per text are shuffled. The norm is a
    window over one text's buckets (at most ``dim`` rows, whatever the text length), which
    needs no second aggregate and no join back.
    """
    t = df.select(F.col(id_col), F.explode(tokens(text)).alias("tok"))
    counts = t.groupBy(id_col, token_bucket(F.col("tok"), dim).alias("bucket")).agg(
        F.count(F.lit(1)).cast("double").alias("cnt"))
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(id_col)))
    return counts.select(F.col(id_col), (F.col("bucket") + 1).cast("int").alias("position"),
                         (F.col("cnt") / norm).alias("value"))


def hashed_vectors(df: DataFrame, id_col: str, text: Column, dim: int = HASH_DIM) -> DataFrame:
    """Dense ``array<double>`` of length ``dim`` per id from the long form (bounded by dim per id)."""
    long = hashed_token_counts(df, id_col, text, dim)
    dense = long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("position", "value"))).alias("_m"))
    return dense.select(id_col, F.transform(F.sequence(F.lit(1), F.lit(dim)),
                                            lambda p: F.coalesce(F.element_at(F.col("_m"), p), F.lit(0.0))).alias("vec"))


# ---------------------------------------------------------------------------
# pluggable encoder (Arrow batches, model built once per task)
# ---------------------------------------------------------------------------

def encode_with(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Callable[[list[str]], np.ndarray]],
                dim: int, batch_size: int = 128) -> DataFrame:
    """Run a Python text encoder over Arrow batches: ``factory()`` returns ``encode(texts) -> (n, dim)``.

    The model is created once per task (not per row), texts are encoded ``batch_size`` at a
    time, and the result returns to the JVM as ``array<double>``.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def job(batches):
        encode = factory()
        for pdf in batches:
            ids, texts = pdf[id_col].to_numpy(), pdf[text_col].fillna("").tolist()
            out = []
            for i in range(0, len(texts), batch_size):
                v = np.asarray(encode(texts[i:i + batch_size]), dtype=np.float64)
                if v.shape != (len(texts[i:i + batch_size]), dim):
                    raise ValueError(f"encoder returned shape {v.shape}, expected (*, {dim})")
                out.extend(list(v))
            yield pd.DataFrame({id_col: ids, "vec": out})

    return df.select(id_col, text_col).mapInPandas(job, schema)


# ---------------------------------------------------------------------------
# an encoder fitted on the corpus: hashed tokens, projected on the leading directions of their Gram matrix
# ---------------------------------------------------------------------------
FIT_BUCKETS = 512


def hashed_counts(texts: list[str], buckets: int) -> np.ndarray:
    """(n, buckets): L2-normalised counts of the tokens' hash buckets; a text without tokens is a zero row."""
    out = np.zeros((len(texts), buckets))
    for i, text in enumerate(texts):
        for token, n in Counter(t for t in text.lower().split(" ") if t).items():
            out[i, zlib.crc32(token.encode()) % buckets] += n
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


def fit_projection(df: DataFrame, text: Column, dim: int, buckets: int = FIT_BUCKETS, batch_size: int = 128) -> np.ndarray:
    """(dim, buckets): the leading eigenvectors of the corpus' Gram matrix of hashed tokens.

    Every text counts. Tasks add up X'X batch by batch, Spark adds the tasks' rows, and the driver decomposes one matrix of
    ``buckets`` squared, whatever the corpus. Each vector's largest entry is positive, so signs don't depend on the solver.
    """
    def gram(frames):
        total = np.zeros((buckets, buckets))
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            for i in range(0, len(texts), batch_size):
                x = hashed_counts(texts[i:i + batch_size], buckets)
                total += x.T @ x
        yield pd.DataFrame({"row": range(buckets), "part": TaskContext.get().partitionId(), "g": list(total)})

    def add(pdf):
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "g": [np.sum(np.stack(pdf.sort_values("part")["g"].to_list()), axis=0)]})

    rows = (df.select(text.alias("text")).mapInPandas(gram, "row int, part int, g array<double>")
            .groupBy("row").applyInPandas(add, "row int, g array<double>").collect())
    total = np.zeros((buckets, buckets))
    for r in rows:
        total[r["row"]] = r["g"]
    _, vectors = np.linalg.eigh(total)
    top = vectors[:, ::-1][:, :dim].T
    return top * np.sign(top[np.arange(dim), np.abs(top).argmax(axis=1)])[:, None]


def projected_encoder(projection: np.ndarray, buckets: int = FIT_BUCKETS):
    """A factory for ``encode_with``."""
    return lambda: lambda texts: hashed_counts(texts, buckets) @ projection.T
