"""7. Quality rules with adaptive thresholds from mergeable quantile sketches.

A first pass over the texts counts the base quantities of each document. Quantile sketches of four
ratios are kept per (lang, source): a sketch is a table of logarithmic buckets with counts (relative
error below 2.5 %), merged by adding counts, so partial sketches combine before the shuffle and any
coarser group is the sum of finer ones. A group's upper fence for a ratio is
    q90 + 3 * (q90 - q50) + slack
but not above MULTIPLE times the median of that fence over the groups of `least` documents or more (each counts
once, whatever its size), so a source that is mostly junk does not set its own limit.
A group with fewer than `least` documents uses the merged sketch of its language, and a language with
fewer that of everything. The fences (one row per group) are joined back and a document is kept if it
passes the base rules and no ratio is above its fence.

Null and empty texts have zero counts and fail the base rule on n_words. Null lang or source is a
group of its own. An empty table gives an empty result; repeated rows are judged each by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrank.llm.bytes_text import BASE_B, BYTE_B, prefix_sums, runs_of, slices, spans, word_hashes, words

GAMMA = 1.05
FLOOR = 1e-4
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LEAST = 200
MULTIPLE = 1.5
SLACK = {"symbol_ratio": 0.02, "dup_line_ratio": 0.30, "repeat_ratio": 0.10, "word_length": 2.0}
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _earlier(group: np.ndarray, key: np.ndarray, key2: np.ndarray) -> np.ndarray:
    """True where the same (group, key, key2) stands before."""
    order = np.lexsort((np.arange(len(key)), key2, key, group))
    same = np.zeros(len(key), bool)
    g, k, k2 = group[order], key[order], key2[order]
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1]) & (k2[1:] == k2[:-1])
    out = np.zeros(len(key), bool)
    out[order] = same
    return out


def counts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The COUNTS of each text."""
    n = len(starts) - 1
    ws, we, bounds = words(data, starts)
    n_words = np.diff(bounds)
    of_word = np.repeat(np.arange(n), n_words)

    def total(where: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(where, starts))

    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_chars = np.bincount(of_word, weights=chars[we] - chars[ws], minlength=n).astype(np.int64) if len(ws) else np.zeros(n, np.int64)
    n_symbols = total(np.flatnonzero(SYMBOL[data]))

    # lines: between line feeds and text borders; those with a word that equal an earlier one
    feeds = np.flatnonzero(data == 10)
    of_line = np.concatenate([np.arange(n), np.searchsorted(starts, feeds, "right") - 1])
    ls = np.concatenate([starts[:-1], feeds + 1])
    order = np.lexsort((ls, of_line))
    of_line, ls = of_line[order], ls[order]
    le = np.empty_like(ls)
    le[:-1] = ls[1:] - 1
    border = np.flatnonzero(np.diff(of_line, append=n))
    le[border] = starts[of_line[border] + 1]
    has_word = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
    of_line, ls, le = of_line[has_word], ls[has_word], le[has_word]
    sums = prefix_sums(data)
    sums2 = prefix_sums(data, BYTE_B, BASE_B)
    dup = _earlier(of_line, spans(sums, ls, le), spans(sums2, ls, le, BASE_B) + (le - ls).astype(np.uint64))
    n_dup = np.bincount(of_line[dup], minlength=n)
    n_lines = np.bincount(of_line, minlength=n)

    # words inside 8-word windows found twice or more in the same text
    n_repeat = np.zeros(n, np.int64)
    if len(ws) >= 8:
        w8 = runs_of(word_hashes(data, ws, we, lower=False), 8)
        at = np.flatnonzero(of_word[:len(w8)] == of_word[7:])
        key, group = w8[at], of_word[at]
        order = np.lexsort((key, group))
        k, g = key[order], group[order]
        same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(len(ws) + 1, np.int64)
        np.add.at(cover, at[order[twice]], 1)
        np.add.at(cover, at[order[twice]] + 8, -1)
        n_repeat = np.bincount(of_word[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines]


def _count_batches(batches):
    for batch in batches:
        for lo, data, starts in slices(batch.column(3)):
            n = len(starts) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(lo, n) for i in range(3)] + [pa.array(c.astype(np.int64)) for c in counts(data, starts)],
                names=["doc_id", "lang", "source"] + [c.split()[0] for c in COUNTS.split(", ")])


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    return (docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"),
                        F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
            .mapInArrow(_count_batches, "doc_id long, lang string, source string, " + COUNTS))


def ratios(counted: DataFrame) -> DataFrame:
    words_, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return (counted.withColumn("symbol_ratio", F.col("n_symbols") / chars)
            .withColumn("dup_line_ratio", F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))
            .withColumn("repeat_ratio", F.col("n_repeat_words") / words_)
            .withColumn("word_length", F.col("word_chars") / words_))


def sketch(measured: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by..., name, bucket, c): the merged quantile sketches; bucket -1 holds what is below FLOOR."""
    long = measured.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("x"))
    bucket = F.when(F.col("x.v") < FLOOR, -1).otherwise(F.ceil(F.log(F.col("x.v") / FLOOR) / math.log(GAMMA)))
    return long.groupBy(*by, F.col("x.name").alias("name"), bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "name", "bucket").agg(F.sum("c").alias("c"))


def quantiles(parts: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """(by..., name, n, q): the quantiles of each sketch; a sketch is a few hundred buckets, so it fits one row."""
    folded = parts.groupBy(*by, "name").agg(F.array_sort(F.collect_list(F.struct("bucket", "c"))).alias("b"), F.sum("c").alias("n"))
    run = F.aggregate("b", F.expr("cast(array() as array<struct<bucket:int,upto:bigint>>)"),
                      lambda acc, x: F.concat(acc, F.array(F.struct(
                          x["bucket"].alias("bucket"),
                          (F.coalesce(F.try_element_at(acc, F.lit(-1))["upto"], F.lit(0)) + x["c"]).alias("upto")))))
    out = folded.withColumn("r", run)

    def value(q: float):
        b = F.filter("r", lambda x: x["upto"] >= F.ceil(F.col("n") * q))[0]["bucket"]
        return F.when(b < 0, F.lit(0.0)).otherwise(FLOOR * F.pow(F.lit(GAMMA), b))

    return out.select(*by, "name", "n", F.array(*[value(q) for q in at]).alias("q"))


def fences(measured: DataFrame, slack: dict[str, float] = SLACK, least: int = LEAST) -> DataFrame:
    """(lang, source, one column per ratio): the upper fence of each group."""
    names = list(slack)
    fine = sketch(measured, ["lang", "source"], names)
    levels = []
    for by in (["lang", "source"], ["lang"], []):
        q = quantiles(merged(fine, by) if len(by) < 2 else fine, by, [0.5, 0.9])
        fence = F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])
        levels.append(q.groupBy(*by).agg(F.max("n").alias("n"), *[
            F.max(F.when(F.col("name") == n, fence + slack[n])).alias(n) for n in names]))
    a, b, c = levels
    usual = a.where(F.col("n") >= least).groupBy().agg(*[(MULTIPLE * F.percentile(F.col(n), 0.5)).alias(n + "4") for n in names])
    b = b.select(F.col("lang").alias("lang2"), F.col("n").alias("n2"), *[F.col(n).alias(n + "2") for n in names])
    c = c.select(F.lit(1).alias("one"), *[F.col(n).alias(n + "3") for n in names])
    return (a.withColumn("one", F.lit(1)).join(b, F.col("lang").eqNullSafe(F.col("lang2"))).join(c, "one")
            .crossJoin(F.broadcast(usual))
            .select("lang", "source", *[F.least(F.when(F.col("n") >= least, F.col(n)).when(F.col("n2") >= least, F.col(n + "2"))
                                                .otherwise(F.col(n + "3")), F.col(n + "4")).alias(n) for n in names]))


def judge(docs: DataFrame, slack: dict[str, float] = SLACK, least: int = LEAST, counted: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and failed (names of the ratios above their fence)."""
    measured = ratios(base_counts(docs) if counted is None else counted)
    limits = fences(measured, slack, least)
    limits = limits.select(F.col("lang").alias("lang2"), F.col("source").alias("source2"), *[F.col(n).alias(n + "_max") for n in slack])
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    above = F.filter(F.array(*[F.when(F.col(n) > F.col(n + "_max"), F.lit(n)) for n in slack]), lambda x: x.isNotNull())
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2")), "left")
    return (joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          base_failed.alias("base_failed"), above.alias("failed"))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))
