"""1. Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of `block_rows` rows (in md5 order of the id, so a block is a fair draw of its source).
With w the source's exact share of the weights, its block i (from 1) may run from slot floor((i - 1) / w) on and must
end by slot ceil(i / w); each slot goes to the released block with the earliest deadline, so after any number of slots
a source has had less than one block more or less than w times as many, for as long as every source has blocks left.

The schedule is computed in stretches of `period` slots (or of 1 / least share, if that is more), each by itself: at a
stretch's ends every source has had floor(w t) blocks, or one more for the largest remainders, so that the blocks add
up to the slots; within it the earliest deadline decides, by the exact releases and deadlines. So no weight is ever
rounded to a period, a stretch's work is slots x sources whatever the rows, and stretches are dealt to tasks.

When a source runs out, its later slots stay empty and the others go on in their own proportions: no row is dropped or
repeated.

Rows without a source form a source of their own (null). Empty and very long texts don't matter (texts are only carried
by `mixed`). Repeated ids keep all their rows: ties are ordered arbitrarily but numbered apart. An empty table gives an
empty result. Columns of any names come along in `mixed`; `mix` reads the id and the source only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from roomrank.llm.shared import only

BLOCK_ROWS = 16
PERIOD = 1000
BUCKET_ROWS = 4096
RUN = 250


def shares_of(weights: DataFrame) -> DataFrame:
    """(source, weight) -> (source, w): positive weights divided by their sum."""
    w = weights.groupBy("source").agg(F.max("weight").cast("double").alias("weight")).where("weight > 0")
    return w.select("source", (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("w"))


def bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it (also within its own lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_by(s: Column, t: Column) -> Column:
    """How many blocks each of the sources `s` (array of named, source, w) has had after t slots: floor(w t), and one more
    for the largest remainders until they add up to t."""
    def rest(x: Column, i: Column) -> Column:
        return F.struct((F.floor(x["w"] * t) - x["w"] * t).alias("rest"), i.alias("i"))

    left = (t - F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.floor(x["w"] * t))).cast("int")
    # the smallest remainder that still gets one
    last = bound(left, lambda n: F.when(n > 0, F.get(F.array_sort(F.transform(s, rest)), n - 1)))
    return bound(last, lambda z: F.transform(s, lambda x, i: (F.floor(x["w"] * t) + F.when(rest(x, i) <= z, 1).otherwise(0)).cast("long")))


def schedule(shares: DataFrame, blocks: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, w) and (source, blocks) -> (source, block, slot), from 0: at least as many blocks of each source as it has."""
    both = shares.join(blocks.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    one = both.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "w"))).alias("s"),
        F.greatest(F.lit(period), F.ceil(1 / F.min("w"))).cast("long").alias("q"), F.max(F.ceil(F.col("blocks") / F.col("w"))).alias("slots"))
    stretches = (one.where(F.size("s") > 0)
                 .select("s", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("slots") / F.col("q"))  + 1)).alias("k"))
                 .repartition("k")
                 # inline keeps the two as values: as expressions they would be evaluated anew in every step of the fold
                 .select("s", "q", "k", F.inline(F.array(F.struct(blocks_by(F.col("s"), F.col("k") * F.col("q")).alias("begin"),
                                                                  blocks_by(F.col("s"), (F.col("k") + 1) * F.col("q")).alias("end"))))))

    def step(acc: Column, t: Column) -> Column:
        # a source that has had its blocks of the stretch waits; not yet released ones only fill what would be idle
        ready = F.transform(acc["had"], lambda n, i: F.when(n < F.get("end", i), F.struct(
            (F.floor(n / F.get("s", i)["w"]) > t).alias("early"), F.ceil((n + 1) / F.get("s", i)["w"]).alias("deadline"), i.alias("i"))))
        return bound(F.array_min(ready)["i"], lambda pick: F.struct(
            F.transform(acc["had"], lambda n, i: F.when(i == pick, n + 1).otherwise(n)).alias("had"),
            F.concat(acc["out"], F.array(F.struct(t.alias("slot"), pick.alias("i"), F.get(acc["had"], pick).alias("block")))).alias("out")))

    none = "cast(array() as array<{}struct<slot:bigint,i:int,block:bigint>{}>)"

    def run(acc: Column, first: Column) -> Column:
        # RUN slots at a time, so that what is copied with each step stays short
        last = F.least(first + RUN, (F.col("k") + 1) * F.col("q")) - 1
        part = F.aggregate(F.sequence(first, last), F.struct(acc["had"].alias("had"), F.expr(none.format("", "")).alias("out")), step)
        return bound(part, lambda p: F.struct(p["had"].alias("had"), F.concat(acc["runs"], F.array(p["out"])).alias("runs")))

    zero = F.struct(F.col("begin").alias("had"), F.expr(none.format("array<", ">")).alias("runs"))
    firsts = F.sequence(F.col("k") * F.col("q"), (F.col("k") + 1) * F.col("q") - 1, F.lit(RUN).cast("long"))
    return (stretches.select("s", F.explode(F.aggregate(firsts, zero, run)["runs"]).alias("out")).select("s", F.inline("out"))
            .select(F.get("s", F.col("i"))["source"].alias("source"), "block", "slot"))


def square_root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """Target weights proportional to the square root of each source's number of rows."""
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sqrt(F.count(F.lit(1))).alias("weight"))


def number_in_source(ids: DataFrame) -> DataFrame:
    """(doc_id, source) -> plus n (from 0), the row's place in its source by md5 of the id.

    Rows are counted by (source, leading md5 digits); a row's number is its place in that small
    bucket plus the rows of earlier buckets, so a hot source is numbered by many tasks.
    """
    total = ids.count()
    digits = 1
    while 16 ** digits * BUCKET_ROWS < 16 * total:
        digits += 1
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = ids.select("doc_id", "source", key.alias("key")).withColumn("bucket", F.substring("key", 1, digits))
    counts = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = (F.sum("c").over(Window.partitionBy("source").orderBy("bucket")
                              .rowsBetween(Window.unboundedPreceding, -1)))
    bases = counts.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"),
                          F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id")) - 1
    placed = keyed.withColumn("place", place)
    return (placed.join(bases, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
            .select("doc_id", "source", (F.col("base") + F.col("place")).alias("n")))


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source",
        block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """One row per row of docs: the id, source, block, slot, place (in its block).

    Reading in order of (slot, place) gives the mixed stream; two rows never share both. Sources that
    the weights leave out get the least weight given.
    """
    ids = only(docs, doc_id=doc_id, source=source)
    shares = square_root_weights(ids) if weights is None else weights
    if weights is not None:
        least = F.min("weight").over(Window.partitionBy(F.lit(0)))
        there = ids.select("source").distinct().withColumnRenamed("source", "s2")
        shares = (there.join(weights.where("weight > 0"), F.col("s2").eqNullSafe(F.col("source")), "left")
                  .select(F.col("s2").alias("source"), F.coalesce("weight", least, F.lit(1.0)).alias("weight")))
    blocks = ids.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
    plan = schedule(shares_of(shares), blocks, period).select(F.col("source").alias("s2"), F.col("block").alias("b2"), "slot")
    numbered = (number_in_source(ids)
                .withColumn("block", F.floor(F.col("n") / block_rows))
                .withColumn("place", (F.col("n") % block_rows).cast("int")))
    # a row per slot meets the block_rows rows of its block
    return (numbered.join(plan, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
            .select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "block", "slot", "place"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text",
          block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """The rows of docs, all columns as they are, in mixed order: range-partitioned and sorted by (slot, place).

    Rows that repeat id and text share a place and stand next to each other.
    """
    key = F.concat_ws("-", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("string"))
    keyed = docs.select(key.alias("key"), F.col(f"`{source}`").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    places = (mix(keyed, weights, "key", "source", block_rows, period).groupBy(F.col("key"))
              .agg(F.min(F.struct("slot", "place")).alias("at")))
    out = keyed.join(places, "key").repartitionByRange(F.col("at.slot"), F.col("at.place")).sortWithinPartitions("at.slot", "at.place", "key")
    return out.select("row.*")
