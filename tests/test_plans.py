"""Physical-plan properties: pushdown and pruning reach the scans, top-k keeps k per user before the
shuffle, and no registered query runs a row-at-a-time Python UDF."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from roomrank.plans.jobs import job_registry


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _scan_blocks(plan: str, table: str) -> list[str]:
    """The 'Scan parquet' detail blocks whose location names ``table``."""
    blocks = plan.split("\n\n")
    return [b for b in blocks if "Scan parquet" in b and f"/{table}" in b]


def test_split_filter_and_columns_reach_the_users_scan(spark, sf_small):
    plan = _plan(E.queries()["target_rank"](spark, sf_small))
    scans = _scan_blocks(plan, "cache/users-")
    assert scans, plan
    for s in scans:
        assert "EqualTo(split,val)" in s
        schema = s.split("ReadSchema:")[1].splitlines()[0]
        assert "guest_country" not in schema and "month" not in schema  # pruned


def test_topk_keeps_k_per_user_before_the_shuffle(spark, sf_small):
    plan = _plan(E.queries()["topk10"](spark, sf_small))
    assert plan.count("WindowGroupLimit") >= 2  # partial (before the exchange) and final


# every registered query built from DataFrame operators; the stream runs a query when called
_PLANNED = sorted(n for n in set(E.queries()) - set(job_registry()) - {"top10_stream", "pipeline"} if not n.startswith("op"))


@pytest.mark.parametrize("name", _PLANNED)
def test_no_row_at_a_time_python(spark, sf_small, name):
    plan = _plan(E.queries()[name](spark, sf_small))
    assert "BatchEvalPython" not in plan


@pytest.fixture
def no_static_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _nodes(df, name: str) -> int:
    """Nodes of a kind in the initial physical plan (explain's tree)."""
    return sum(name in line.split("(")[0] for line in _plan(df).split("\n\n")[0].splitlines())


@pytest.mark.parametrize("name", ["drift_summary", "drift_unseen_counts"])
def test_drift_is_one_scan_without_joins(spark, sf_small, no_static_broadcast, name):
    df = E.queries()[name](spark, sf_small)
    assert _nodes(df, "Scan parquet") == 1 and _nodes(df, "Join") == 0


def test_user_features_scans_and_shuffles(spark, sf_small, no_static_broadcast):
    df = E.queries()["user_features"](spark, sf_small)
    plan = _plan(df)
    assert _nodes(df, "Scan parquet") <= 3  # the rows, the means, their extremes (the value counts come from their checkpoint)
    # joins on low-cardinality keys are broadcasts of counted tables; the only shuffle join is on the accommodation
    joins = [b for b in plan.split("\n\n") if "SortMergeJoin" in b.split("\n")[0] and "Left keys" in b]
    assert all("accommodation_id" in b for b in joins)


@pytest.mark.parametrize("name", ["review_prompt", "review_prompt_full", "hashed_text_vector", "text_filled"])
def test_texts_are_not_shuffled(spark, sf_small, name):
    for block in _plan(E.queries()[name](spark, sf_small)).split("\n\n"):
        if "Exchange" in block.split("\n")[0]:
            assert "review_title" not in block and "review_positive" not in block and "text" not in block


def test_reviews_hold_every_character_of_the_documents(spark, sf_small):
    from pyspark.sql import functions as F

    from roomrank.sources.tables import read_table, reviews_view

    docs = read_table(spark, sf_small, "documents").select(F.col("doc_id").alias("review_id"), "text")
    rest = F.concat(F.coalesce("review_positive", F.lit("")), F.coalesce("review_negative", F.lit("")))
    whole = F.when(rest == "", F.col("review_title")).otherwise(F.concat("review_title", F.lit("\n"), rest))
    bad = reviews_view(spark, sf_small).join(docs, "review_id").where(F.rtrim(whole, F.lit("\n")) != F.rtrim("text", F.lit("\n")))
    assert bad.count() == 0
    assert reviews_view(spark, sf_small).where("review_positive is null and review_negative is null").count() == 0
