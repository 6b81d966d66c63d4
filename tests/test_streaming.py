"""The streamed top-10 job equals the batch job, across micro-batches and restarts."""

import os
import tempfile

from pyspark.sql import functions as F

from roomrank.operators.ranking import topk_per_user, wide_top10
from roomrank.plans.fixture import fixture
from roomrank.sources.tables import user_vectors
from roomrank.streaming.predict import read_top10, run_top10_stream


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_equals_batch_and_restarts_incrementally(spark, sf_small):
    fx = fixture(spark, sf_small)
    test_users = fx.users.where(F.col("split") == "test").select("user_id", "accommodation_id")
    base = tempfile.mkdtemp(prefix="stream-test-")
    src = os.path.join(base, "src")
    # two arrivals (test users all end in 9): even tens first, the rest later
    early = (F.floor(F.col("user_id") / 10) % 2) == 0
    assert test_users.where(early).count() > 3
    test_users.where(early).repartition(3).write.parquet(src + "/a")
    schema = test_users.schema

    def stream():
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                .option("recursiveFileLookup", "true").parquet(src))

    def attach(b):
        return user_vectors(spark, sf_small, b)

    first = run_top10_stream(spark, stream(), fx.review_vecs, attach, os.path.join(base, "job"))
    n_first = first.count()
    assert n_first == test_users.where(early).count()
    batches_first = len([d for d in os.listdir(os.path.join(base, "job", "out")) if d.startswith("batch_id=")])
    assert batches_first >= 2  # one file per trigger

    test_users.where(~early).repartition(2).write.parquet(src + "/b")
    both = run_top10_stream(spark, stream(), fx.review_vecs, attach, os.path.join(base, "job"))
    batches_both = len([d for d in os.listdir(os.path.join(base, "job", "out")) if d.startswith("batch_id=")])
    assert batches_both > batches_first  # the restart processed only the new files

    users = attach(test_users).select("user_id", "accommodation_id", "vec")
    expected = wide_top10(topk_per_user(users, fx.review_vecs), users, fx.review_vecs)
    assert both.count() == test_users.count()
    assert _same(both, expected)
    assert _same(read_top10(spark, os.path.join(base, "job", "out")), expected)


def test_replayed_micro_batch_replaces_its_output(spark, sf_small):
    from roomrank.streaming.predict import write_batch
    fx = fixture(spark, sf_small)
    batch = fx.users.where(F.col("split") == "test").select("user_id", "accommodation_id")
    sink = os.path.join(tempfile.mkdtemp(prefix="stream-replay-"), "out")

    def attach(b):
        return user_vectors(spark, sf_small, b)

    write_batch(batch, 0, fx.review_vecs, attach, sink)
    first = read_top10(spark, sink).count()
    write_batch(batch, 0, fx.review_vecs, attach, sink)  # the same batch again, as after a failure
    again = read_top10(spark, sink)
    assert again.count() == first == batch.count()
    assert again.select("user_id").distinct().count() == first
