"""Registry of named queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the fixture views, so its work grows with them.
Floating outputs are rounded to 6 decimals and every computed column is aliased, so the
results compare column-for-column with the oracle SQL in ``oracle``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrank.functions import vectors as V
from roomrank.functions import text as _text
from roomrank.functions.text import hashed_token_counts
from roomrank.operators import candidates as C
from roomrank.operators import clean as K
from roomrank.operators import features as FE
from roomrank.operators.losses import cosine_loss, epoch_losses, epoch_means, running_means
from roomrank.operators.ranking import mean_reciprocal_rank, target_ranks, topk_per_user, wide_top10
from roomrank.operators.bounded import bounded_top_k
from roomrank.operators.sequence import number_within_group
from roomrank.plans.fixture import fixture

R6 = V.round6
BATCH = 64          # encoder training batch of the reference
TRUNCATE_DIM = 32   # truncation length used on the 64-dim fixture vectors
SAMPLE_FRAC = 0.2
SAMPLE_N = 100
DRAWS = 20
DRAW_SEED = 11
SHUFFLE_SEED = 7
EPOCHS = 3
GROUP_BLOCK = 64
STREAM_FILES_PER_BATCH = 2
DRIFT_FEATURES = ["guest_id", "guest_country", "guest_type", "accommodation_country", "accommodation_type",
                  "accommodation_id"]

_REGISTRY: dict = {}


def query(fn):
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict:
    return dict(_REGISTRY)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _long(df: DataFrame, key: str, vec: str, *extra: str) -> DataFrame:
    return df.select(key, *extra, F.posexplode(vec).alias("_p", "_v")).select(
        key, *extra, (F.col("_p") + 1).cast("long").alias("position"), R6("_v").alias("value"))


# ------------------------------------------------------------------ A1 A2
@query
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf).users.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A1 A2 (CSV layout)
@query
def csv_splits(spark, sf):
    """Each split written in the reference's CSV layout (users, the reviews of the split's
    accommodations, matches except for test), then scanned back with explicit schemas:
    rows, id sum, text length and the sum of the rows' digests per split and table."""
    from roomrank.sources.cache import run_dir
    from roomrank.sources.tables import SPLITS, load_split, write_split

    fx = fixture(spark, sf)
    base = run_dir(spark, "csv_layout")
    for split in SPLITS:
        users = fx.split_users(split)
        reviews = fx.of_accommodations(fx.reviews, users)
        matches = fx.matches.where(F.col("split") == split) if split != "test" else None
        write_split(users, reviews, matches, base, split, escaped=True)
    out = []
    for split in SPLITS:
        users, reviews, matches = load_split(spark, base, split, escaped=True)
        parts = [("users", users, "user_id", ["guest_country", "guest_type"]),
                 ("reviews", reviews, "review_id", _text.TEXT_COLS),
                 ("matches", matches, "user_id", [])]
        for name, df, key, texts in parts:
            if df is None:
                continue
            chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0))
            row = F.concat_ws("|", F.col(key).cast("string"), *[F.coalesce(F.col(c), F.lit("~")) for c in texts])
            digest = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
            out.append(df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).cast("long").alias("id_sum"),
                              F.sum(chars).cast("long").alias("text_chars"), F.sum(digest).alias("digest_sum"))
                       .select(F.lit(split).alias("split"), F.lit(name).alias("table_name"), "n", "id_sum",
                               "text_chars", "digest_sum"))
    return _union(out)


# ------------------------------------------------------------------ B5
@query
def text_filled(spark, sf):
    return fixture(spark, sf).reviews_filled.select("review_id", "review_title", "review_positive", "review_negative")


# ------------------------------------------------------------------ B3 B4 H12
@query
def review_prompt(spark, sf):
    p = review_prompt_fn()
    r = fixture(spark, sf).reviews_filled
    return r.select("review_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("prompt_len"))


def review_prompt_fn():
    return _text.review_prompt()


@query
def review_prompt_full(spark, sf):
    p = review_prompt_full_fn()
    r = fixture(spark, sf).reviews_filled
    return r.select("review_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("prompt_len"))


def review_prompt_full_fn():
    return _text.review_prompt_full()


# ------------------------------------------------------------------ B9 C4
@query
def hash_sample_cascade(spark, sf):
    fx = fixture(spark, sf)
    reviews = K.hash_sample(fx.review_keys.select("review_id"), "review_id", SAMPLE_FRAC)
    out = []
    for split in ("train", "val", "test"):
        users = fx.split_users(split).select("user_id")
        out.append(reviews.agg(F.count(F.lit(1)).alias("n")).select(F.lit(split).alias("split"),
                                                                     F.lit("reviews").alias("table_name"), "n"))
        if split != "test":
            m = C.restrict_to(fx.matches.where(F.col("split") == split).select("user_id", "review_id"),
                              reviews, "review_id")
            users = C.restrict_to(users, m, "user_id")
            out.append(m.agg(F.count(F.lit(1)).alias("n")).select(F.lit(split).alias("split"),
                                                                   F.lit("matches").alias("table_name"), "n"))
        # test split: no matches, so users are not restricted (the reference fails here)
        out.append(users.agg(F.count(F.lit(1)).alias("n")).select(F.lit(split).alias("split"),
                                                                  F.lit("users").alias("table_name"), "n"))
    return _union(out)


# ------------------------------------------------------------------ B10
@query
def sample_n_users(spark, sf):
    return K.sample_n(fixture(spark, sf).users.select("user_id"), "user_id", SAMPLE_N)


# ------------------------------------------------------------------ B11
@query
def sample_groups_replace(spark, sf):
    fx = fixture(spark, sf)
    train = fx.matches.where(F.col("split") == "train")
    groups = train.groupBy("accommodation_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = number_within_group(groups, [], ["accommodation_id"], name="ordinal", start=1)
    n_groups = groups.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(DRAWS).select(
        F.col("id").alias("draw"),
        (F.pmod(K.mult_hash32(F.col("id") + F.lit(DRAW_SEED)), n_groups) + 1).alias("ordinal"))
    return draws.join(numbered, "ordinal").select("draw", "accommodation_id", "n")


# ------------------------------------------------------------------ C1 C2 C3
@query
def merge_single_key(spark, sf):
    fx = fixture(spark, sf)
    m = fx.matches.where(F.col("split") != "test").drop("split")
    j = C.merge_single_key(fx.users, fx.reviews_filled, m)
    return j.select("user_id", "review_id", "accommodation_id", "split")


@query
def merge_composite_key(spark, sf):
    fx = fixture(spark, sf)
    m = fx.matches.where(F.col("split") != "test").drop("split")
    j = C.merge_composite_key(fx.users, fx.reviews_filled, m)
    return j.select("user_id", "review_id", "accommodation_id", "split")


# ------------------------------------------------------------------ C8 B8
@query
def user_match_lookup(spark, sf):
    fx = fixture(spark, sf)
    return C.first_match(_train_and_val(fx), fx.matches.where(F.col("split") != "test"))


# ------------------------------------------------------------------ G9 C7 D9 D10 D12 S1-S4
def _train_and_val(fx):
    return fx.users.where(F.col("split") != "test")


@query
def drift_summary(spark, sf):
    return FE.drift_summary(_train_and_val(fixture(spark, sf)), DRIFT_FEATURES, F.col("split") == "val")


@query
def drift_unseen_counts(spark, sf):
    return FE.drift_unseen_counts(_train_and_val(fixture(spark, sf)), DRIFT_FEATURES, F.col("split") == "val")


# ------------------------------------------------------------------ D1 C9
@query
def accommodation_means(spark, sf):
    u = FE.apply_group_means(fixture(spark, sf).users)
    return u.select("user_id", *[R6(f"average_{c}").alias(f"average_{c}") for c in FE.AVG_COLS])


# ------------------------------------------------------------------ D2 D3 B6
@query
def value_frequencies(spark, sf):
    u = FE.apply_frequencies(fixture(spark, sf).users)
    return u.select("user_id", *[R6(f"count_{c}").alias(f"count_{c}") for c in FE.COUNT_COLS])


# ------------------------------------------------------------------ D4 G4 G5 D5
@query
def minmax_users(spark, sf):
    u = FE.apply_minmax(FE.apply_group_means(fixture(spark, sf).users), FE.SCALE_COLS)
    return u.select("user_id", *[R6(c).alias(c) for c in FE.SCALE_COLS])


@query
def minmax_reviews(spark, sf):
    """Fitted per split, over the reviews of the split's accommodations (its review table)."""
    fx = fixture(spark, sf)
    held = fx.users.select("split", "accommodation_id").distinct()
    rows = fx.review_keys.join(held, "accommodation_id").select("split", "review_id", *FE.REVIEW_SCALE_COLS)
    r = FE.apply_minmax(rows, FE.REVIEW_SCALE_COLS)
    return r.select("split", "review_id", *[R6(c).alias(c) for c in FE.REVIEW_SCALE_COLS])


@query
def month_mean(spark, sf):
    u = FE.apply_minmax(fixture(spark, sf).users, ["month"])
    return u.groupBy("split").agg(R6(F.avg("month")).alias("average_month"))


# ------------------------------------------------------------------ D6 G1 G2
@query
def binary_codes(spark, sf):
    users = fixture(spark, sf).users
    codes, sizes = FE.fit_codes(FE._values(users, FE.TARGET_COLS))
    cells = []
    for c in FE.TARGET_COLS:
        users = FE.join_code(users, c, codes, sizes[c])
        cells += [F.struct(F.lit(f"{c}_{i}").alias("column"), b.cast("long").alias("value"))
                  for i, b in enumerate(FE.bits_of(F.col(f"_code_{c}"), FE.bit_width(sizes[c])))]
    return users.select("user_id", F.explode(F.array(*cells)).alias("e")).select("user_id", "e.column", "e.value")


# ------------------------------------------------------------------ G3
@query
def onehot_guest_type(spark, sf):
    """The sparse form: each row's one, with the column's place and name."""
    users = fixture(spark, sf).users
    codes, sizes = FE.fit_codes(FE._values(users, [FE.ONEHOT_COL]))
    enc = FE.apply_onehot(users.select("user_id", FE.ONEHOT_COL), FE.ONEHOT_COL, codes, sizes[FE.ONEHOT_COL])
    return enc.where(F.col(f"{FE.ONEHOT_COL}_index") > 0).select(
        "user_id", F.concat(F.lit(f"{FE.ONEHOT_COL}_"), F.col(FE.ONEHOT_COL)).alias("column"),
        F.col(f"{FE.ONEHOT_COL}_index").cast("long").alias("position"), F.lit(1).cast("long").alias("value"))


# ------------------------------------------------------------------ G7 G6 B1 B2 B13 B15
@query
def user_features(spark, sf):
    u, _ = FE.build_user_features(fixture(spark, sf).users)
    return _long(u, "user_id", "features")


# ------------------------------------------------------------------ C5 B7
@query
def candidates(spark, sf):
    fx = fixture(spark, sf)
    return C.candidate_counts(fx.users, fx.review_keys)


# ------------------------------------------------------------------ D13
@query
def group_review_ids(spark, sf):
    r = fixture(spark, sf).review_keys.select("accommodation_id", "review_id")
    n = number_within_group(r, ["accommodation_id"], ["review_id"], name="_rn")
    b = n.withColumn("block_id", F.floor(F.col("_rn") / F.lit(GROUP_BLOCK)).cast("long"))
    return b.groupBy("accommodation_id", "block_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list("review_id")).cast("array<string>"), ",").alias("review_ids"))


# ------------------------------------------------------------------ C6 D11 H9
@query
def pairs_in_group(spark, sf):
    fx = fixture(spark, sf)
    return C.pairs_in_group(fx.matches.where(F.col("split") == "train"))


# ------------------------------------------------------------------ H5 H6 H8
def _pair_score(spark, sf, expr):
    p = fixture(spark, sf).matched_pairs()
    return p.select("user_id", "review_id", R6(expr).alias("score"))


@query
def dot_scores(spark, sf):
    return _pair_score(spark, sf, V.dot("uvec", "rvec"))


@query
def cosine_scores(spark, sf):
    return _pair_score(spark, sf, V.cosine("uvec", "rvec"))


@query
def euclid_scores(spark, sf):
    return _pair_score(spark, sf, V.euclidean("uvec", "rvec"))


# ------------------------------------------------------------------ E1 E2 E7 H11 D7 I7
def _val_queries(fx):
    m = fx.matches.where(F.col("split") == "val").select("user_id", "review_id")
    q = fx.user_vecs.where(F.col("split") == "val").select("user_id", "accommodation_id", "vec")
    t = fx.review_vecs.select("review_id", F.col("vec").alias("tvec"))
    return q.join(m, "user_id").join(t, "review_id")


def _sizes(fx):
    """Cheap frames to size the scoring blocks from (prepared key tables, no vector joins)."""
    return {"val_matches": fx.matches.where(F.col("split") == "val").select("accommodation_id"),
            "test_users": fx.users.where(F.col("split") == "test").select("accommodation_id"),
            "reviews": fx.review_keys.select("accommodation_id")}


def _ranks(spark, sf, metric="dot"):
    fx = fixture(spark, sf)
    z = _sizes(fx)
    return target_ranks(_val_queries(fx), fx.review_vecs, metric=metric,
                        query_sizes=z["val_matches"], item_sizes=z["reviews"])


@query
def target_rank(spark, sf):
    return _ranks(spark, sf).select("user_id", "rank", R6("rr").alias("rr"))


@query
def mrr_all(spark, sf):
    m = mean_reciprocal_rank(_ranks(spark, sf))
    return m.select("n_users", R6("mrr").alias("mrr"))


@query
def mrr_cosine(spark, sf):
    m = mean_reciprocal_rank(_ranks(spark, sf, "cosine"))
    return m.select("n_users", R6("mrr").alias("mrr"))


@query
def mrr_matched(spark, sf):
    """Candidates = the matched rows of the user's group (evaluation form, T9/T10)."""
    fx = fixture(spark, sf)
    p = fx.stored_pairs(("val",))
    queries = p.select("user_id", "accommodation_id", F.col("uvec").alias("vec"), "review_id",
                       F.col("rvec").alias("tvec"), F.col("user_id").alias("ttie"))
    items = p.select("accommodation_id", "review_id", F.col("rvec").alias("vec"), F.col("user_id").alias("itie"))
    z = _sizes(fx)["val_matches"]
    r = target_ranks(queries, items, target_tie="ttie", item_tie="itie", query_sizes=z, item_sizes=z)
    m = mean_reciprocal_rank(r)
    return m.select("n_users", R6("mrr").alias("mrr"))


# ------------------------------------------------------------------ E3-E6 I9
def _test_topk(fx):
    users = fx.user_vecs.where(F.col("split") == "test").select("user_id", "accommodation_id", "vec")
    z = _sizes(fx)
    return users, topk_per_user(users, fx.review_vecs, query_sizes=z["test_users"], item_sizes=z["reviews"])


@query
def topk10(spark, sf):
    _, t = _test_topk(fixture(spark, sf))
    return t.select("user_id", F.col("rank").cast("long").alias("rank"), "review_id")


@query
def top10_wide(spark, sf):
    fx = fixture(spark, sf)
    users, t = _test_topk(fx)
    return wide_top10(t, users, fx.review_vecs)


@query
def top10_stream(spark, sf):
    """``top10_wide`` computed by a stream over the prepared users' files (I9 incrementally)."""
    from roomrank.sources.cache import digest, read_through
    from roomrank.sources.tables import user_vectors
    from roomrank.session import shared_dir
    from roomrank.streaming.predict import run_top10_stream

    fx = fixture(spark, sf)
    src = fx.prepared_path("users")
    items = read_through(spark, "review_vecs", fx.params("review_vecs"), lambda: fx.review_vecs)
    users = (spark.readStream.schema(fx.users.schema).option("maxFilesPerTrigger", STREAM_FILES_PER_BATCH)
             .parquet(src).where(F.col("split") == "test").select("user_id", "accommodation_id"))
    base = shared_dir(spark, f"stream/top10-{digest({'src': src})}")
    return run_top10_stream(spark, users, items, lambda b: user_vectors(spark, fx.sf_dir, b), base)


# ------------------------------------------------------------------ H1 H2 H3 H10
@query
def layernorm_truncate_l2(spark, sf):
    from roomrank.sources.tables import vector_table
    v = vector_table(spark, sf)
    out = v.select("vec_id", V.l2_normalize(V.truncate(V.layer_norm("vec"), TRUNCATE_DIM)).alias("v"))
    return _long(out, "vec_id", "v")


# ------------------------------------------------------------------ G8 H4
@query
def review_vector(spark, sf):
    fx = fixture(spark, sf)
    scaled = FE.apply_minmax(fx.review_keys.select("review_id", *FE.REVIEW_SCALE_COLS), FE.REVIEW_SCALE_COLS, by=())
    v = fx.review_vecs.select("review_id", "vec").join(scaled, "review_id")
    emb = V.l2_normalize(V.truncate(V.layer_norm("vec"), TRUNCATE_DIM))
    out = v.select("review_id", V.append(emb, "review_score", "review_helpful_votes").alias("v"))
    return _long(out, "review_id", "v")


# ------------------------------------------------------------------ I1
@query
def hashed_text_vector(spark, sf):
    r = fixture(spark, sf).reviews_filled
    long = hashed_token_counts(r, "review_id", review_prompt_fn())
    return long.select("review_id", F.col("position").cast("long").alias("position"), R6("value").alias("value"))


# ------------------------------------------------------------------ E8 E9
def _train_rows(fx):
    return fx.matches.where(F.col("split") == "train").select("accommodation_id", "user_id", "review_id")


def _batch_members(b):
    """Rows, id sum, least id and a digest of the sorted ids of each batch (a batch is bounded)."""
    ids = F.array_join(F.array_sort(F.collect_list("user_id")).cast("array<string>"), ",")
    return b.groupBy("accommodation_id", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").cast("long").alias("id_sum"), F.min("user_id").alias("id_min"), F.md5(ids).alias("ids_md5"))


@query
def batches(spark, sf):
    return _batch_members(C.assign_batches(_train_rows(fixture(spark, sf)), BATCH))


@query
def shuffled_batches(spark, sf):
    return _batch_members(C.assign_batches(_train_rows(fixture(spark, sf)), BATCH, shuffle_seed=SHUFFLE_SEED))


# ------------------------------------------------------------------ L1-L4 D8 B14
def _batch_table(fx, loss, seeds=(None,)):
    # number the prepared match keys only, for all epochs, then attach the vectors: the numbering carries ids, each user's
    # vector travels once for all epochs, and a review's once per group
    keys = C.epoch_batches(_train_rows(fx), BATCH, seeds)
    users = fx.with_user_vector(keys.join(fx.users.select("user_id"), "user_id"))
    held = keys.select("accommodation_id", "epoch", "part", "review_id").distinct()
    reviews = fx.with_review_vector(held.join(fx.review_keys.select("review_id"), "review_id"))
    return epoch_losses(users, reviews, loss)


def _loss(spark, sf, loss):
    t = _batch_table(fixture(spark, sf), loss)
    return t.select("accommodation_id", "batch_id", R6("loss").alias("loss"))


@query
def loss_softmax(spark, sf):
    return _loss(spark, sf, "softmax")


@query
def loss_bce(spark, sf):
    return _loss(spark, sf, "bce")


@query
def loss_contrastive(spark, sf):
    return _loss(spark, sf, "contrastive")


@query
def loss_cosine(spark, sf):
    l = cosine_loss(fixture(spark, sf).matched_pairs())
    return l.select("split", R6("loss").alias("loss"))


@query
def loss_epoch_mean(spark, sf):
    fx = fixture(spark, sf)
    return epoch_means(_batch_table(fx, "softmax", range(EPOCHS))).select("epoch", R6("loss").alias("loss"))


@query
def loss_running_mean(spark, sf):
    """D8, second half: mean of the losses so far, batch by batch, in each accommodation."""
    t = _batch_table(fixture(spark, sf), "softmax")
    return running_means(t, "accommodation_id", "batch_id").select("accommodation_id", "batch_id", R6("running").alias("running"))


@query
def nonfinite_counts(spark, sf):
    from roomrank.sources.tables import vector_table
    fx = fixture(spark, sf)
    v = vector_table(spark, sf).select(F.explode("vec").alias("x"))
    a = v.agg(K.nonfinite_count(v, "x").alias("value")).select(F.lit("embedding_values").alias("key"), "value")
    t = _batch_table(fx, "softmax")
    b = t.agg(K.nonfinite_count(t, "loss").alias("value")).select(F.lit("loss_softmax").alias("key"), "value")
    return a.unionByName(b)


# ------------------------------------------------------------------ I11
def feature_sums(col: str):
    """Sum and position-weighted sum of a feature array (nulls left out), rounded."""
    add = lambda a, x: a + F.coalesce(x, F.lit(0.0))
    return (R6(F.aggregate(col, F.lit(0.0), add)), R6(F.aggregate(F.transform(col, lambda x, i: x * (i + 1)), F.lit(0.0), add)))


@query
def training_examples(spark, sf):
    fx = fixture(spark, sf)
    feats, cols = FE.build_user_features(fx.users.where(F.col("split") != "test"))
    m = fx.matches.where(F.col("split") == "train").select("user_id", "review_id")
    text = fx.reviews_filled.select("review_id", F.md5(review_prompt_full_fn()).alias("text_md5"))
    j = m.join(feats.where(F.col("split") == "train").select("user_id", "features"), "user_id").join(text, "review_id")
    return j.select("user_id", "review_id", "text_md5", F.size("features").cast("long").alias("n_features"),
                    feature_sums("features")[0].alias("total"), feature_sums("features")[1].alias("weighted"))


# ------------------------------------------------------------------ H7
@query
def pair_vector(spark, sf):
    """The concatenated vector of every match: its length, sum and position-weighted sum."""
    p = fixture(spark, sf).matched_pairs()
    v = V.concat_vectors("uvec", "rvec")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("user_id", "review_id", F.size(v).cast("long").alias("n"), R6(total).alias("total"), R6(weighted).alias("weighted"))


# ------------------------------------------------------------------ C5
@query
def dropped_users(spark, sf):
    """Users without any candidate, who get no ranking, per split."""
    fx = fixture(spark, sf)
    groups = fx.review_keys.select("accommodation_id").distinct().withColumn("_has", F.lit(1))
    return (fx.users.select("split", "accommodation_id").join(groups, "accommodation_id", "left")
            .groupBy("split").agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("_has").isNull()).alias("n_dropped")))


# ------------------------------------------------------------------ E3 bounded
@query
def topk10_bounded(spark, sf):
    """``topk10`` by the bounded search: item blocks whose bound misses the 10th best score so far stay unopened."""
    fx = fixture(spark, sf)
    users = fx.user_vecs.where(F.col("split") == "test").select("user_id", "accommodation_id", "vec")
    z = _sizes(fx)
    plan = bounded_top_k(users, fx.review_vecs, grp="accommodation_id", qid="user_id", qvec="vec", iid="review_id", ivec="vec", k=10,
                         query_sizes=z["test_users"], item_sizes=z["reviews"])
    return plan.top("user_id", "review_id").select("user_id", F.col("rank").cast("long").alias("rank"), "review_id")
