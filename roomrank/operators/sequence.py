"""Skew-safe row numbering within groups (E6, E7, E8 and the matches fixture).

``row_number() over (partition by g order by o)`` sends every row of a group to one task;
a group holding a third of all rows then sorts in a single task. Here the rows are
range-partitioned on ``(g, o)`` instead, so a hot group is spread over many tasks, and the
row number is taken within (range partition, group). A group that crosses a partition edge
adds the rows that it has in earlier partitions: at most one group of each partition goes on
from the one before, so these offsets have fewer rows than there are partitions and are broadcast.

Everything is a native expression, so keys may have any type that Spark can order. Nulls and NaN
are values like others (nulls first, NaN last).

The numbered frame is checkpointed into the shared checkpoint folder before the offsets are
counted, so both see identical partitions, also after an executor loss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomrank.session import default_parallelism, materialize

_PLACE_BITS = (1 << 33) - 1  # monotonically_increasing_id holds the row's place in its partition in the lower 33 bits


def number_within_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                        name: str = "rn", start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = position of the row inside its group by ``order_cols`` (from ``start``).

    ``group_cols=[]`` numbers the whole table (a distributed, gap-free sequence).
    ``order_cols`` must make the order total (include a key), as a row number requires.
    Pass a narrow frame: every column is checkpointed once.
    """
    keys = [*group_cols, *order_cols]
    if not keys:
        raise ValueError("need at least one grouping or ordering column")
    p = num_partitions or default_parallelism(df.sparkSession)
    ranged = df.repartitionByRange(p, *keys)
    if group_cols:
        within = Window.partitionBy("_pid", *group_cols).orderBy(*(order_cols or group_cols))
        dealt = ranged.withColumn("_pid", F.spark_partition_id()).repartition(p, "_pid", *group_cols)  # as the window needs them, p tasks as asked for
        placed = dealt.withColumn("_place", F.row_number().over(within) - 1)
    else:
        placed = (ranged.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())
                  .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS))))
    placed = materialize(placed)
    groups = [F.col(g).alias(f"_group{i}") for i, g in enumerate(group_cols)]
    names = [f"_group{i}" for i in range(len(group_cols))]
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = (placed.groupBy(F.col("_pid").alias("_part"), *groups).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.sum("_n").over(earlier)).where("_offset > 0").drop("_n"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group_cols, names, strict=True)],
                  F.col("_pid") == F.col("_part"))
    number = F.col("_place") + F.coalesce(F.col("_offset"), F.lit(0)) + F.lit(start)
    return placed.join(F.broadcast(offsets), same, "left").select(*df.columns, number.cast("long").alias(name))


def sequential_id(df: DataFrame, order_cols: list[str], name: str = "ID", start: int = 1,
                  num_partitions: int | None = None) -> DataFrame:
    """Gap-free id over the whole table in ``order_cols`` order (E6), without a single-task window."""
    return number_within_group(df, [], order_cols, name=name, start=start, num_partitions=num_partitions)
