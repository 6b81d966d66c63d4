"""Incremental prediction: the top-10 job (I9) over arriving user files, with Structured Streaming.

The reference predicts once, for a finished test file, and keeps no state between inputs; so
does this job. New user files land in a folder; every micro-batch is an independent batch job
(``foreachBatch``) that scores the batch's users against the review vectors of their
accommodations with the blocked scorer and writes the padded top-10 lists.

* Exactly-once output: micro-batch ``N`` writes the folder ``batch_id=N`` in overwrite mode, so
  a batch replayed after a failure replaces its own output instead of adding to it. The stream's
  checkpoint (offsets, commits) lives in the shared checkpoint folder, never on one machine.
* The gap-free ``ID`` depends on all users, so it is assigned when the output is read
  (``read_top10``), by the distributed numbering operator; the result then equals the batch job.
* Per micro-batch only the reviews of the batch's accommodations are read (left-semi join on
  the distinct accommodation ids; AQE broadcasts that side only when its measured size is small).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from roomrank.operators.ranking import number_lists, topk_per_user, wide_lists


def top10_batch(users: DataFrame, items: DataFrame, pad: str = "first") -> DataFrame:
    """Padded top-10 lists of one batch of ``users(user_id, accommodation_id, vec)``, without ``ID``."""
    cand = items.join(users.select("accommodation_id").distinct(), "accommodation_id", "left_semi")
    return wide_lists(topk_per_user(users, cand), users, cand, pad)


def write_batch(batch: DataFrame, batch_id: int, items: DataFrame,
                attach_vectors: Callable[[DataFrame], DataFrame], sink: str, pad: str = "first") -> None:
    """One micro-batch: score, then overwrite ``batch_id=N`` (a replay replaces its own output)."""
    u = attach_vectors(batch).select("user_id", "accommodation_id", "vec").persist()
    try:
        top10_batch(u, items, pad).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
    finally:
        u.unpersist()


def start_top10_stream(users: DataFrame, items: DataFrame, attach_vectors: Callable[[DataFrame], DataFrame],
                       sink: str, checkpoint: str, *, available_now: bool = True,
                       processing_time: str | None = None, pad: str = "first") -> StreamingQuery:
    """Start the stream.

    ``users`` is a streaming frame with ``user_id, accommodation_id``; ``attach_vectors`` maps a
    static batch of it to ``(user_id, accommodation_id, vec)``; ``items`` is the static
    ``(review_id, accommodation_id, vec)`` table. ``available_now`` processes what is there and
    stops (a scheduled run); otherwise the stream runs on ``processing_time``.
    """
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, items, attach_vectors, sink, pad)

    w = users.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def read_top10(spark: SparkSession, sink: str) -> DataFrame:
    """All micro-batch outputs with the gap-free ``ID`` (from 1, by accommodation_id, user_id)."""
    return number_lists(spark.read.parquet(sink.rstrip("/")).drop("batch_id"))


def run_top10_stream(spark: SparkSession, users: DataFrame, items: DataFrame,
                     attach_vectors: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """Process every file present now (``availableNow``), then return the numbered result."""
    q = start_top10_stream(users, items, attach_vectors, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced by awaitTermination as well
        raise RuntimeError(str(q.exception()))
    try:
        return read_top10(spark, f"{base}/out")
    except Exception as exc:  # no batch ran: no file in the source
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return spark.createDataFrame([], read_schema())
        raise


def read_schema() -> str:
    cols = ", ".join(f"review_{i} long" for i in range(1, 11))
    return f"ID long, accommodation_id long, user_id long, {cols}"

