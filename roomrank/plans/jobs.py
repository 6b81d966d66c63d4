"""Registered jobs: sinks, caches and model jobs.

The sink, cache and preparation jobs read back what a query stored, so the oracle SQL of that
query checks them; the model jobs are checked by value and property in ``tests/``.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomrank.functions import vectors as V
from roomrank.operators import clean as K
from roomrank.operators import features as FE
from roomrank.functions.text import encode_with, fit_projection, hashed_vectors, projected_encoder, review_prompt
from roomrank.operators import models as M
from roomrank.operators import training as TR
from roomrank.operators.ranking import mean_reciprocal_rank, target_ranks, topk_per_user, wide_top10
from roomrank.operators.sequence import number_within_group
from roomrank.plans.fixture import fixture
from roomrank.plans.queries import DRAW_SEED, DRAWS, feature_sums, top10_wide
from roomrank.sources.cache import read_csv, read_through, run_dir, write_csv
from roomrank.session import materialize

TRUNCATE_DIM = 32
EMB_DIM = 16
PAIR_BATCH = 32      # pair-scorer batch of the reference
DUAL_BATCH = 64      # encoder batch of the reference
DUAL_EPOCHS = 6
DUAL_LR = 0.01
EVAL_EVERY = 2       # the reference evaluates the encoders every second epoch
PAIR_EPOCHS = 5
PAIR_LR = 0.003
WORKERS = 8          # tasks that take local steps; a setting of the training, not of the cluster
HIDDEN = [64, 32]
TOWER = [EMB_DIM, 2 * EMB_DIM, EMB_DIM]
BRIDGE = [2 * EMB_DIM, 2 * EMB_DIM, 16, 1]            # of the formula scorer
FITTED_BRIDGE = [2 * EMB_DIM, 2 * EMB_DIM, 32, 16, 8, 1]
TEXT_DIM = 64
SEED = 0

_MODELS: dict = {}
R6 = V.round6


class Prepared:
    """Feature tables and models of one data directory, built once per session."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.fx = spark, sf, fixture(spark, sf)
        self._encoded, self._towers = {}, {}

    @cached_property
    def user_features(self) -> DataFrame:
        """G7 over all splits (fit per split, code domains from all splits), cached."""
        def build():
            u, _ = FE.build_user_features(self.fx.users)
            # model input: a null feature (e.g. no star rating) becomes 0; the feature
            # queries themselves keep the null
            return u.select("user_id", "accommodation_id", "split",
                            F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))).alias("features"))
        return read_through(self.spark, "user_features", self.fx.params("user_features"), build)

    @cached_property
    def review_features(self) -> DataFrame:
        """Layer norm -> truncate -> L2 -> append the two scaled numbers, cached."""
        def build():
            scaled = FE.apply_minmax(self.fx.review_keys.select("review_id", *FE.REVIEW_SCALE_COLS),
                                     FE.REVIEW_SCALE_COLS, by=())
            v = self.fx.review_vecs.join(scaled, "review_id")
            emb = V.l2_normalize(V.truncate(V.layer_norm("vec"), TRUNCATE_DIM))
            return v.select("review_id", "accommodation_id", V.append(emb, *FE.REVIEW_SCALE_COLS).alias("vec"))
        return read_through(self.spark, "review_features", self.fx.params("review_features", dim=TRUNCATE_DIM), build)

    @cached_property
    def dims(self) -> tuple[int, int]:
        du = self.user_features.select(F.size("features")).first()[0]
        dr = self.review_features.select(F.size("vec")).first()[0]
        return int(du), int(dr)

    def train_batches(self, size: int) -> DataFrame:
        """``(user_id, review_id, accommodation_id, batch_id, pos)`` of the train matches; keys only are numbered."""
        keys = self.fx.matches.where(F.col("split") == "train").select("accommodation_id", "user_id", "review_id")
        n = number_within_group(keys, ["accommodation_id"], ["user_id"], name="_rn")
        return n.withColumns({"batch_id": F.floor(F.col("_rn") / size).cast("long"), "pos": F.pmod(F.col("_rn"), F.lit(size))})

    def mini_batches(self, size: int, users: DataFrame, reviews: DataFrame) -> DataFrame:
        """The train matches as one row per mini-batch; ``users(user_id, xu)``, ``reviews(review_id, xr)``. Written."""
        return TR.plain_batches(self.compact_batches(size, users, reviews))

    def compact_batches(self, size: int, users: DataFrame, reviews: DataFrame) -> DataFrame:
        """`mini_batches` with each review once per batch: reviews join the batches' distinct ids, not every match, so what is
        shuffled and written per match is the user's features."""
        keys = self.train_batches(size)
        held = keys.select("accommodation_id", "batch_id", "review_id").distinct()
        return materialize(TR.batch_table(keys.join(users, "user_id"), held.join(reviews, "review_id"), WORKERS))

    def split_features(self, split: str) -> DataFrame:
        return self.user_features.where(F.col("split") == split)

    @cached_property
    def dual_batches(self) -> DataFrame:
        return self.compact_batches(DUAL_BATCH, self.split_features("train").select("user_id", F.col("features").alias("xu")),
                                    self.review_features.select("review_id", F.col("vec").alias("xr")))

    @cached_property
    def trained(self) -> tuple[dict, list[float], list[tuple[int, float]]]:
        """The dual encoders fitted on the train matches, their epoch losses, and (epoch, MRR on drawn groups);
        the encoders are read back from the saved training state."""
        du, dr = self.dims
        models = {"user": M.init_mlp([du, *HIDDEN, EMB_DIM], SEED), "review": M.init_mlp([dr, *HIDDEN, EMB_DIM], SEED + 1)}
        path, seen = run_dir(self.spark, "encoders"), []
        drawn = self.drawn_validation

        def evaluate(state):
            if state.epoch % EVAL_EVERY == 0:
                seen.append((state.epoch, drawn_mrr(encoded_pairs(drawn, state.models), drawn).first()["mrr"]))

        state = TR.fit(self.dual_batches, models, TR.dual_objective, (du, dr), epochs=DUAL_EPOCHS, lr=DUAL_LR, state_dir=path, on_epoch=evaluate)
        return TR.load_state(self.spark, path).models, state.losses, seen

    @cached_property
    def drawn_validation(self) -> DataFrame:
        """The validation matches of the drawn groups with both feature vectors and ``times``, how often their group was drawn;
        derived once, so an evaluation during training only encodes and ranks."""
        m = drawn_matches(self.fx)
        return self._written(m.join(self.user_features.select("user_id", "features"), "user_id")
                             .join(self.review_features.select("review_id", "vec"), "review_id"), "drawn-validation")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = run_dir(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def encoded_users(self, split: str) -> DataFrame:
        """Every user of a split encoded once by the trained encoder, written; the fit encodes the train split's where its batches are."""
        if split not in self._encoded:
            self._encoded[split] = self._written(M.encode(self.split_features(split), "user_id", "features", self.trained[0]["user"], "a", ("accommodation_id",)),
                                                 f"encoded-users-{split}")
        return self._encoded[split]

    @cached_property
    def encoded_reviews(self) -> DataFrame:
        return self._written(M.encode(self.review_features, "review_id", "vec", self.trained[0]["review"], "b", ("accommodation_id",)),
                             "encoded-reviews")

    def matched(self, split: str) -> DataFrame:
        m = self.fx.matches.where(F.col("split") == split).select("user_id", "review_id", "accommodation_id")
        return (m.join(self.encoded_users(split).select("user_id", "a"), "user_id")
                .join(self.encoded_reviews.select("review_id", "b"), "review_id"))

    @cached_property
    def pair_model(self) -> tuple[dict, list[float]]:
        """Towers and bridge fitted on all in-batch pairs of the train split, on the trained encoders' output; read back
        from an artefact that names the encoders."""
        batches = materialize(TR.encoded_batches(self.dual_batches, self.trained[0], DUAL_BATCH, PAIR_BATCH, WORKERS))
        models = {"tower_user": TR.tower(TOWER, SEED), "tower_review": TR.tower(TOWER, SEED + 1), "bridge": M.init_mlp(FITTED_BRIDGE, SEED + 2)}
        state = TR.fit(batches, models, TR.pair_objective, (EMB_DIM, EMB_DIM), epochs=PAIR_EPOCHS, lr=PAIR_LR)
        path = run_dir(self.spark, "pair-scorer")
        M.save_pair_models(self.spark, state.models, self.trained[0], path)
        return M.load_pair_models(self.spark, path, self.trained[0]), state.losses

    @cached_property
    def text_projection(self) -> np.ndarray:
        """The text encoder fitted on all review texts, read back from its artefact."""
        found = fit_projection(self.fx.reviews_filled, review_prompt(), TEXT_DIM)
        path = run_dir(self.spark, "text-encoder")
        M.save_weights(self.spark, {"text": [M.Dense(found, np.zeros(TEXT_DIM), "none")]}, path)
        return M.load_weights(self.spark, path)["text"][0].w

    @cached_property
    def tower_reviews(self) -> DataFrame:
        return self._written(M.encode(self.encoded_reviews, "review_id", "b", self.pair_model[0]["tower_review"], "t", ("accommodation_id",)), "tower-reviews")

    def towered(self, split: str) -> tuple[DataFrame, DataFrame]:
        """Every user of a split and every review taken through its tower once, written; the bridge then works on those."""
        if split not in self._towers:
            self._towers[split] = self._written(M.encode(self.encoded_users(split), "user_id", "a", self.pair_model[0]["tower_user"], "t", ("accommodation_id",)),
                                                f"tower-users-{split}")
        return self._towers[split], self.tower_reviews

    def bridge_scorer(self) -> M.BridgeScorer:
        return M.BridgeScorer(self.pair_model[0]["bridge"], TOWER[-1])


def drawn_matches(fx) -> DataFrame:
    """The validation matches of DRAWS groups drawn with replacement, and ``times`` each was drawn.

    A group counts as often as it was drawn, without repeating its rows.
    """
    val = fx.matches.where(F.col("split") == "val").select("user_id", "review_id", "accommodation_id")
    groups = number_within_group(val.select("accommodation_id").distinct(), [], ["accommodation_id"], name="ordinal", start=1)
    n_groups = groups.agg(F.count(F.lit(1))).scalar()
    draws = fx.spark.range(DRAWS).select((F.pmod(K.mult_hash32(F.col("id") + F.lit(DRAW_SEED)), n_groups) + 1).alias("ordinal"))
    drawn = draws.join(groups, "ordinal").groupBy("accommodation_id").agg(F.count(F.lit(1)).alias("times"))
    return val.join(F.broadcast(drawn), "accommodation_id")  # DRAWS rows at most


def matched_ranks(rows: DataFrame, sizes: DataFrame, metric="dot") -> DataFrame:
    """Ranks of each user's review among the matched reviews of the group; ``rows(user_id, review_id, accommodation_id, a, b)``."""
    queries = rows.select("user_id", "accommodation_id", F.col("a").alias("vec"), "review_id", F.col("b").alias("tvec"), F.col("user_id").alias("ttie"))
    items = rows.select("accommodation_id", "review_id", F.col("b").alias("vec"), F.col("user_id").alias("itie"))
    return target_ranks(queries, items, metric=metric, target_tie="ttie", item_tie="itie", query_sizes=sizes, item_sizes=sizes)


def encoded_pairs(rows: DataFrame, models: dict) -> DataFrame:
    """``rows(user_id, review_id, accommodation_id, features, vec)`` with both sides encoded as ``a`` and ``b``."""
    keys = ("review_id", "accommodation_id", "vec")
    a = M.encode(rows, "user_id", "features", models["user"], "a", keys)
    return M.encode(a, "user_id", "vec", models["review"], "b", ("review_id", "accommodation_id", "a"))


def drawn_mrr(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """MRR over drawn groups, each as often as it was drawn: ``n_users``, ``mrr``."""
    r = matched_ranks(pairs, drawn.select("accommodation_id")).join(drawn.select("user_id", "times"), "user_id")
    bad = F.sum("n_nonfinite")
    mrr = F.when(bad > 0, F.raise_error(F.concat(F.lit("non-finite scores: "), bad)).cast("double")).otherwise(
        F.sum(F.col("rr") * F.col("times")) / F.sum("times"))
    return r.agg(F.sum("times").alias("n_users"), mrr.alias("mrr"))


def prepared(spark: SparkSession, sf: str) -> Prepared:
    fx = fixture(spark, sf)
    key = (spark.sparkContext.applicationId, fx.sf_dir, fx.inputs)
    if key not in _MODELS:
        _MODELS[key] = Prepared(spark, fx.sf_dir)
    return _MODELS[key]


def _long(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(key, F.posexplode(vec).alias("_p", "_v")).select(
        key, (F.col("_p") + 1).cast("long").alias("position"), R6("_v").alias("value"))


# ------------------------------------------------------------------ A4
WIDE_SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("accommodation_id", T.LongType()),
                            T.StructField("user_id", T.LongType())] +
                           [T.StructField(f"review_{i}", T.LongType()) for i in range(1, 11)])


def csv_roundtrip(spark, sf):
    path = run_dir(spark, "out/top10_wide")
    write_csv(top10_wide(spark, sf), path)
    return read_csv(spark, path, WIDE_SCHEMA)


# ------------------------------------------------------------------ A3
def cache_roundtrip(spark, sf):
    p = prepared(spark, sf)
    return _long(p.review_features, "review_id", "vec")


# ------------------------------------------------------------------ I12
def prepare_all(spark, sf):
    p = prepared(spark, sf)
    m = p.fx.matches.where(F.col("split") != "test")
    j = (m.join(p.user_features.select("user_id", "features"), "user_id")
         .join(p.review_features.select("review_id", "vec"), "review_id"))
    (ut, uw), (rt, _) = feature_sums("features"), feature_sums("vec")
    return j.select("user_id", "review_id", "accommodation_id", "split",
                    F.size("features").cast("long").alias("n_user_features"), ut.alias("user_total"), uw.alias("user_weighted"),
                    F.size("vec").cast("long").alias("n_review_features"), rt.alias("review_total"))


# ------------------------------------------------------------------ A5
def weights_roundtrip(spark, sf):
    """The model artefact read back: both trained encoders, and the towers and bridge fitted on their output."""
    p = prepared(spark, sf)
    path = run_dir(spark, "weights")
    M.save_weights(spark, {**p.trained[0], **p.pair_model[0]}, path)
    return M.weights_frame(spark, M.load_weights(spark, path)).select(
        "model", "layer", "n_in", "n_out", "activation", F.size("weight").alias("n_weights"),
        F.round(F.aggregate("weight", F.lit(0.0), lambda a, x: a + x * x), 6).alias("sum_sq"))


# ------------------------------------------------------------------ I2 I3 I4 (weights from a formula)
def formula_pair_models() -> dict:
    """Towers and bridge with formula weights."""
    towers = {"tower_user": M.formula_mlp(TOWER, 3), "tower_review": M.formula_mlp(TOWER, 4)}
    for layers in towers.values():
        layers[-1].activation = "leaky_relu"
    return {**towers, "bridge": M.formula_mlp(BRIDGE, 2)}


def _formula_users(p, split: str | None = None) -> DataFrame:
    """All users, or those of a split, encoded with formula weights."""
    users = p.split_features(split) if split else p.user_features
    return M.encode(users, "user_id", "features", M.formula_mlp([p.dims[0], *HIDDEN, EMB_DIM], 0), "a")


def _formula_reviews(p) -> DataFrame:
    return M.encode(p.review_features, "review_id", "vec", M.formula_mlp([p.dims[1], *HIDDEN, EMB_DIM], 1), "b")


def encode_users(spark, sf):
    return _long(_formula_users(prepared(spark, sf)), "user_id", "a")


def encode_reviews(spark, sf):
    return _long(_formula_reviews(prepared(spark, sf)), "review_id", "b")


def pair_score(spark, sf):
    """The towers and the bridge on every match (the test split's stay hidden)."""
    p = prepared(spark, sf)
    rows = (p.fx.matches.where(F.col("split") != "test").select("user_id", "review_id")
            .join(_formula_users(p), "user_id").join(_formula_reviews(p), "review_id"))
    scorer = M.BridgeScorer(M.formula_mlp(BRIDGE, 2), EMB_DIM)
    return M.pair_score_rows(rows, scorer).select("user_id", "review_id", R6("score").alias("score"))


# ------------------------------------------------------------------ I5
def pair_fit(spark, sf):
    """The epoch losses of the pair scorer's fit: every user against every review of its mini-batch, in all batches."""
    losses = prepared(spark, sf).pair_model[1]
    return spark.createDataFrame([(f"epoch_{i}_loss", float(x)) for i, x in enumerate(losses)], "step string, value double")


def pair_batch_loss(spark, sf):
    """The pair objective of every train mini-batch under formula weights: what the fit's first epoch adds up."""
    p = prepared(spark, sf)
    batches = p.compact_batches(PAIR_BATCH, _formula_users(p, "train").select("user_id", F.col("a").alias("xu")), _formula_reviews(p).select("review_id", F.col("b").alias("xr")))
    losses = TR.batch_losses(batches, formula_pair_models(), TR.pair_objective, (EMB_DIM, EMB_DIM))
    return losses.select("accommodation_id", "batch_id", R6("loss").alias("loss"))


# ------------------------------------------------------------------ I8
def _val_match_groups(fx) -> DataFrame:
    """Group column of the validation matches: a cheap frame to size the scoring blocks from."""
    return fx.matches.where(F.col("split") == "val").select("accommodation_id")


def pair_eval(spark, sf):
    p = prepared(spark, sf)
    users, reviews = p.towered("val")
    m = p.fx.matches.where(F.col("split") == "val").select("user_id", "review_id", "accommodation_id")
    rows = m.join(users.select("user_id", F.col("t").alias("a")), "user_id").join(reviews.select("review_id", F.col("t").alias("b")), "review_id")
    return mean_reciprocal_rank(matched_ranks(rows, _val_match_groups(p.fx), p.bridge_scorer())).select("n_users", R6("mrr").alias("mrr"))


def _formula_towers(p, split: str) -> tuple[DataFrame, DataFrame]:
    models = formula_pair_models()
    return (M.encode(_formula_users(p, split), "user_id", "a", models["tower_user"], "t"),
            M.encode(_formula_reviews(p), "review_id", "b", models["tower_review"], "t"))


def pair_mrr(spark, sf):
    """`pair_eval` with towers and bridge of formula weights."""
    p = prepared(spark, sf)
    users, reviews = _formula_towers(p, "val")
    m = p.fx.matches.where(F.col("split") == "val").select("user_id", "review_id", "accommodation_id")
    rows = m.join(users.withColumnRenamed("t", "a"), "user_id").join(reviews.withColumnRenamed("t", "b"), "review_id")
    scorer = M.BridgeScorer(formula_pair_models()["bridge"], TOWER[-1])
    return mean_reciprocal_rank(matched_ranks(rows, _val_match_groups(p.fx), scorer)).select("n_users", R6("mrr").alias("mrr"))


# ------------------------------------------------------------------ I10
def _pair_lists(p, users: DataFrame, reviews: DataFrame, scorer) -> DataFrame:
    """The ten best reviews of each test user; ``users(user_id, accommodation_id, vec)``, ``reviews(review_id, accommodation_id, vec)``."""
    t = topk_per_user(users, reviews, metric=scorer, query_sizes=p.fx.users.where(F.col("split") == "test").select("accommodation_id"),
                      item_sizes=p.fx.review_keys.select("accommodation_id"))
    return wide_top10(t, users, reviews)


def pair_top10(spark, sf):
    p = prepared(spark, sf)
    users, reviews = p.towered("test")
    return _pair_lists(p, users.select("user_id", "accommodation_id", F.col("t").alias("vec")),
                       reviews.select("review_id", "accommodation_id", F.col("t").alias("vec")), p.bridge_scorer())


def pair_top10_formula(spark, sf):
    """`pair_top10` with towers and bridge of formula weights."""
    p = prepared(spark, sf)
    users, reviews = _formula_towers(p, "test")
    test = p.fx.users.where(F.col("split") == "test").select("user_id", "accommodation_id")
    return _pair_lists(p, test.join(users, "user_id").select("user_id", "accommodation_id", F.col("t").alias("vec")),
                       p.fx.review_keys.select("review_id", "accommodation_id").join(reviews, "review_id")
                       .select("review_id", "accommodation_id", F.col("t").alias("vec")),
                       M.BridgeScorer(formula_pair_models()["bridge"], TOWER[-1]))


# ------------------------------------------------------------------ I6 I7
def dual_fit(spark, sf):
    """Losses of the dual-encoder fit, the MRR on drawn groups during it, and the trained encoders evaluated on all validation matches."""
    p = prepared(spark, sf)
    _, losses, seen = p.trained
    mrr = mean_reciprocal_rank(matched_ranks(p.matched("val"), _val_match_groups(p.fx)))
    rows = [(f"epoch_{i}_loss", float(x)) for i, x in enumerate(losses)] + [(f"after_{e}_mrr_drawn", float(x)) for e, x in seen]
    return spark.createDataFrame(rows, "step string, value double").unionByName(
        mrr.select(F.lit("val_mrr_matched").alias("step"), F.col("mrr").alias("value")))


def mrr_drawn(spark, sf):
    """MRR of the given vectors on groups drawn with replacement: a group enters the mean as often as it was drawn."""
    fx = fixture(spark, sf)
    drawn = drawn_matches(fx)
    pairs = (drawn.join(fx.user_vecs.select("user_id", F.col("vec").alias("a")), "user_id")
             .join(fx.review_vecs.select("review_id", F.col("vec").alias("b")), "review_id"))
    return drawn_mrr(pairs.select("user_id", "review_id", "accommodation_id", "a", "b"), drawn).select("n_users", R6("mrr").alias("mrr"))


# ------------------------------------------------------------------ I1 G8: from the texts to the ranking
def text_review_features(p, split: str, encode=lambda texts: hashed_vectors(texts, "review_id", review_prompt())) -> DataFrame:
    """G8 of a split's reviews from their texts: prompt -> encoder (hashed tokens) -> layer norm -> truncate -> L2, then the two
    numbers, scaled within the split's review table."""
    fx = p.fx
    users = fx.users.where(F.col("split") == split)
    keys = fx.of_accommodations(fx.review_keys, users)
    scaled = FE.apply_minmax(keys.select("review_id", "accommodation_id", *FE.REVIEW_SCALE_COLS), FE.REVIEW_SCALE_COLS, by=())
    texts = fx.of_accommodations(fx.reviews_filled, users)
    v = encode(texts).join(scaled, "review_id")
    emb = V.l2_normalize(V.truncate(V.layer_norm("vec"), TRUNCATE_DIM))
    return v.select("review_id", "accommodation_id", V.append(emb, *FE.REVIEW_SCALE_COLS).alias("vec"))


def _text_sides(p, split: str, **encoder) -> tuple[DataFrame, DataFrame]:
    """(users, reviews) of a split, encoded with formula weights: what is ranked comes from the texts and the bookings."""
    layers = M.formula_mlp([TRUNCATE_DIM + len(FE.REVIEW_SCALE_COLS), *HIDDEN, EMB_DIM], 1)
    reviews = M.encode(text_review_features(p, split, **encoder), "review_id", "vec", layers, "b", ("accommodation_id",))
    users = p.fx.users.where(F.col("split") == split).select("user_id", "accommodation_id").join(_formula_users(p, split), "user_id")
    return (users.select("user_id", "accommodation_id", F.col("a").alias("vec")),
            p._written(reviews.select("review_id", "accommodation_id", F.col("b").alias("vec")), f"text-reviews-{split}"))


def _text_mrr(p, users: DataFrame, reviews: DataFrame) -> DataFrame:
    queries = (p.fx.matches.where(F.col("split") == "val").select("user_id", "review_id").join(users, "user_id")
               .join(reviews.select("review_id", F.col("vec").alias("tvec")), "review_id"))
    r = target_ranks(queries, reviews, query_sizes=p.fx.users.select("accommodation_id"), item_sizes=p.fx.review_keys.select("accommodation_id"))
    return mean_reciprocal_rank(r).select("n_users", R6("mrr").alias("mrr"))


def mrr_text(spark, sf):
    """Validation MRR@10 with review vectors made of the texts, every review of the accommodation a candidate."""
    p = prepared(spark, sf)
    return _text_mrr(p, *_text_sides(p, "val"))


def mrr_text_fitted(spark, sf):
    """`mrr_text` with the text encoder that was fitted on the corpus, run in Arrow batches."""
    p = prepared(spark, sf)
    projection = p.text_projection

    def encode(texts):
        return encode_with(texts.select("review_id", review_prompt().alias("text")), "review_id", "text", projected_encoder(projection), TEXT_DIM)

    return _text_mrr(p, *_text_sides(p, "val", encode=encode))


def top10_text(spark, sf):
    """The ten best reviews of each test user by review vectors made of the texts."""
    p = prepared(spark, sf)
    return _pair_lists(p, *_text_sides(p, "test"), "dot")


def job_registry() -> dict:
    return {f.__name__: f for f in (csv_roundtrip, cache_roundtrip, prepare_all, weights_roundtrip, encode_users,
                                    encode_reviews, pair_score, pair_fit, pair_batch_loss, pair_eval, pair_mrr, pair_top10,
                                    pair_top10_formula, dual_fit, mrr_drawn, mrr_text, mrr_text_fitted, top10_text)}
