"""Distributed training: gradients against finite differences, losses against plain loops, resume after a killed driver."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from roomrank.operators import models as M
from roomrank.operators import training as TR

DU, DR = 3, 4
SCHEMA = "accommodation_id long, batch_id long, xu array<double>, xr array<double>"


def dual(seed=0):
    return {"user": M.init_mlp([DU, 5, 4, 2], seed), "review": M.init_mlp([DR, 5, 2], seed + 1)}


def pair(seed=0):
    return {"tower_user": TR.tower([DU, 6, 3], seed), "tower_review": TR.tower([DR, 6, 3], seed + 1), "bridge": M.init_mlp([6, 5, 4, 1], seed + 2)}


def draw(n_batches=7, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(a), b, rng.normal(size=(n, DU)), rng.normal(size=(n, DR))) for b, (a, n) in enumerate(zip(rng.integers(0, 3, n_batches), [4, 1, 5, 3, 2, 6, 4]))]


def frame(spark, batches, parts=3):
    rows = [(a, b, xu.ravel().tolist(), xr.ravel().tolist()) for a, b, xu, xr in batches]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts, "batch_id").sortWithinPartitions("batch_id")


def plain_pair_loss(models, xu, xr):
    """Sum over users of the mean loss over the batch's reviews, pair by pair on the concatenated towers."""
    total = 0.0
    for i in range(len(xu)):
        losses = []
        for j in range(len(xr)):
            both = np.concatenate([M.forward(xu[i:i + 1], models["tower_user"])[0], M.forward(xr[j:j + 1], models["tower_review"])[0]])
            p = 1 / (1 + np.exp(-M.forward(both[None, :], models["bridge"])[0, 0]))
            losses.append(-np.log(p if i == j else 1 - p))
        total += np.mean(losses)
    return total


def plain_dual_loss(models, xu, xr):
    s = M.forward(xu, models["user"]) @ M.forward(xr, models["review"]).T
    return np.mean([np.log(np.exp(s[i]).sum()) - s[i, i] for i in range(len(s))])


@pytest.mark.parametrize("objective,models,plain", [(TR.dual_objective, dual(), plain_dual_loss), (TR.pair_objective, pair(), plain_pair_loss)])
def test_loss_and_gradient(objective, models, plain):
    _, _, xu, xr = draw()[2]
    loss, weight, grads = objective(models, xu, xr)
    assert abs(loss - plain(models, xu, xr)) < 1e-10
    assert weight == (len(xu) if objective is TR.pair_objective else 1)
    w, g, h = TR.flatten(models), TR.flatten(grads), 1e-6
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += h
        down[i] -= h
        slope = (plain(TR.unflatten(up, models), xu, xr) - plain(TR.unflatten(down, models), xu, xr)) / (2 * h)
        assert abs(slope - g[i]) < 1e-5, i


@pytest.mark.parametrize("objective,models,plain", [(TR.dual_objective, dual(), plain_dual_loss), (TR.pair_objective, pair(), plain_pair_loss)])
def test_first_epoch_equals_one_step_of_plain_descent_for_any_partitions(spark, objective, models, plain):
    data = draw()
    weight = sum(len(x[2]) if objective is TR.pair_objective else 1 for x in data)
    loss = sum(plain(models, xu, xr) for _, _, xu, xr in data) / weight
    g = sum(TR.flatten(objective(models, xu, xr)[2]) for _, _, xu, xr in data) / weight
    want, _, _ = TR.adam(TR.flatten(models), np.zeros(len(g)), np.zeros(len(g)), g, 1, 0.1)
    for parts in (1, 4, 9):
        state = TR.fit(frame(spark, data, parts), models, objective, (DU, DR), epochs=1, lr=0.1, mode="summed")
        assert abs(state.losses[0] - loss) < 1e-10 and np.allclose(TR.flatten(state.models), want, atol=1e-9)


def test_local_steps_are_averaged_by_batches(spark):
    data, models = draw(), dual()
    df = frame(spark, data, 2)
    of = {b: p for p, rows in enumerate(df.rdd.glom().collect()) for b in [r.batch_id for r in rows]}
    ends, counts = [], []
    for p in set(of.values()):
        w, m, v, n = TR.flatten(models), 0.0, 0.0, 0
        for _, b, xu, xr in sorted(data, key=lambda x: x[1]):
            if of[b] == p:
                n += 1
                w, m, v = TR.adam(w, m, v, TR.flatten(TR.dual_objective(TR.unflatten(w, models), xu, xr)[2]), n, 0.05)
        ends.append(w * n)
        counts.append(n)
    state = TR.fit(df, models, TR.dual_objective, (DU, DR), epochs=1, lr=0.05)
    assert np.allclose(TR.flatten(state.models), sum(ends) / sum(counts), atol=1e-9)


def test_losses_fall_and_rounds_take_several_steps(spark):
    data = draw()
    for objective, models in ((TR.dual_objective, dual()), (TR.pair_objective, pair())):
        local = TR.fit(frame(spark, data), models, objective, (DU, DR), epochs=4, lr=0.03)
        rounds = TR.fit(frame(spark, data), models, objective, (DU, DR), epochs=4, lr=0.03, mode="summed", rounds=3)
        assert local.losses[-1] < local.losses[0] and rounds.losses[-1] < rounds.losses[0]
        assert rounds.step > 4


def test_empty_table_and_not_finite_loss(spark):
    state = TR.fit(frame(spark, [], 1), dual(), TR.dual_objective, (DU, DR), epochs=1, lr=0.1)
    assert np.array_equal(TR.flatten(state.models), TR.flatten(dual())) and np.isnan(state.losses[0])
    bad = [(1, 0, np.full((2, DU), np.nan), np.ones((2, DR)))]
    for mode in ("summed", "local"):
        with pytest.raises(FloatingPointError):
            TR.fit(frame(spark, bad, 1), dual(), TR.dual_objective, (DU, DR), epochs=1, lr=0.1, mode=mode)


def test_state_roundtrip_and_other_models_are_refused(spark, tmp_path):
    state = TR.fit(frame(spark, draw()), pair(), TR.pair_objective, (DU, DR), epochs=2, lr=0.05, state_dir=str(tmp_path / "s"))
    back = TR.load_state(spark, str(tmp_path / "s"))
    assert (back.epoch, back.step, back.losses) == (2, state.step, state.losses)
    assert all(np.array_equal(a, b) for a, b in ((TR.flatten(back.models), TR.flatten(state.models)), (back.m, state.m), (back.v, state.v)))
    assert [layer.activation for layer in back.models["tower_user"]] == ["leaky_relu"] * 2
    (tmp_path / "s" / "epoch=3").mkdir()  # a state that was not written completely
    assert TR.load_state(spark, str(tmp_path / "s")).epoch == 2
    with pytest.raises(ValueError, match="other models"):
        TR.fit(frame(spark, draw()), dual(), TR.dual_objective, (DU, DR), epochs=3, lr=0.05, state_dir=str(tmp_path / "s"))


def test_fit_resumed_after_a_killed_driver_equals_an_unbroken_one(spark, tmp_path):
    code = """
import os, sys
sys.path[:0] = [%r, %r]
from roomrank.session import get_spark
from tests.test_training import DR, DU, draw, dual, frame
from roomrank.operators import training as TR
s = get_spark("local[2]", 2)
TR.fit(frame(s, draw()), dual(), TR.dual_objective, (DU, DR), epochs=4, lr=0.05, state_dir=%r, on_epoch=lambda t: os._exit(9) if t.epoch == 2 else None)
""" % (str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent), str(tmp_path / "s"))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 9, out.stderr[-2000:]
    resumed = TR.fit(frame(spark, draw()), dual(), TR.dual_objective, (DU, DR), epochs=4, lr=0.05, state_dir=str(tmp_path / "s"))
    unbroken = TR.fit(frame(spark, draw()), dual(), TR.dual_objective, (DU, DR), epochs=4, lr=0.05)
    assert np.array_equal(TR.flatten(resumed.models), TR.flatten(unbroken.models)) and resumed.losses == unbroken.losses
