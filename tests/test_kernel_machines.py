"""Kernel machines that learn in shared passes, against plain losses and slopes."""

import numpy as np
import pandas as pd
import pytest

from gaugeframe.operators import kernel_machines as km
from gaugeframe.staging import stage

TRIALS = [km.KernelTrial(0.5, 0.1), km.KernelTrial(5.0, 1.0), km.KernelTrial(0.01, 0.3)]


def data(n=180, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(n, 3)) + 1.5 * y[:, None], y, np.arange(n) % 3


def frame(spark, x, y, fold):
    rows = [([float(v) for v in r], float(c), int(f)) for r, c, f in zip(x, y, fold)]
    return stage(spark.createDataFrame(rows, "x array<double>, y double, fold int").repartition(5), "machines")


def plain_loss(machines, trial, fold_at, column, x, y, fold, coef):
    own = fold != machines.folds[fold_at]
    z = machines.features(x[own] @ machines.base, trial)
    sign = np.where(y[own] == (column if machines.classes > 2 else 1), 1.0, -1.0)
    short = np.maximum(0, 1 - sign * (z @ coef))
    return (short ** 2).mean() + 0.5 / (machines.trials[trial].c * own.sum()) * (coef[:-1] ** 2).sum()


@pytest.mark.parametrize("classes", [2, 3])
def test_machines_stand_at_the_least_loss(spark, classes):
    x, y, fold = data(classes=classes)
    rows = frame(spark, x, y, fold)
    machines = km.fit_machines(rows, TRIALS, [0, 1, 2, -1], 3, classes, features=16, max_iter=400, vec="x")
    assert machines.coef.shape == (3, 4, 1 if classes == 2 else 3, 17)
    for t, f, c in [(0, 0, 0), (1, 2, 0), (2, 3, machines.coef.shape[2] - 1)]:
        coef = machines.coef[t, f, c]
        here = plain_loss(machines, t, f, c, x, y, fold, coef)
        for k in range(17):
            for step in (1e-2, -1e-2):
                moved = coef.copy()
                moved[k] += step
                assert plain_loss(machines, t, f, c, x, y, fold, moved) >= here - 1e-5 * max(1, here)
    counts = km.held_out_counts(rows, machines, "x")
    assert counts.shape == (3, 4, classes, classes) and (counts.sum((2, 3)) == [60, 60, 60, 0]).all()
    for t in range(3):
        want = np.zeros((classes, classes))
        for a, b in zip(y[fold == 1], machines.margins(x[fold == 1], t, 1).argmax(1)):
            want[a, b] += 1
        assert (counts[t, 1] == want).all()
    margins = km.held_out_margins(rows, machines, "x")
    got = sorted((r.label, round(r.margins[-1], 9)) for r in margins.collect())
    assert got == sorted((int(c), round(float(machines.margins(v[None], 0, f)[0, -1]), 9)) for v, c, f in zip(x, y, fold))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    base, phase = rng.normal(size=(3, 20_000)), rng.uniform(0, 2 * np.pi, 20_000)
    machines = km.Machines((km.KernelTrial(1, 0.4),), (-1,), 2, base, phase, np.zeros((1, 1, 1, 20_001)))
    x = rng.normal(size=(6, 3))
    z = machines.features(x @ base, 0)[:, :-1]
    want = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(z @ z.T, want, atol=0.03)


def test_sigmoids_stand_at_the_least_log_loss(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 400)
    m = np.column_stack([rng.normal(size=400) + 2 * (y == c) for c in range(3)])
    m[:, 2] = np.where(y == 2, 5.0, -5.0)  # separable
    df = stage(spark.createDataFrame([(int(c), [float(v) for v in r]) for c, r in zip(y, m)], "label long, margins array<double>"), "margins")
    coef = km.fit_sigmoids(df, 3)
    for c in range(3):
        n = (y == c).sum()
        target = np.where(y == c, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
        z = m[:, c] * coef[c, 0] + coef[c, 1]
        r = 1 / (1 + np.exp(-z)) - target
        assert abs(r.mean()) < 1e-4 and abs((r * m[:, c]).mean()) < 1e-4 and coef[c, 0] > 0


def test_cosines_of_turns():
    turns = np.random.default_rng(6).uniform(-40, 40, (50, 30))
    assert np.abs(km.turned(turns.copy()) - np.cos(2 * np.pi * (turns - np.rint(turns)))).max() < 5e-15


def test_ended_machines_are_not_evaluated_again(spark, monkeypatch):
    """A trial whose machines have all ended costs no features in later passes."""
    x, y, fold = data()
    pdf, features = pd.DataFrame({"x": list(x), "y": y, "fold": fold}), km.Machines.features
    asked = []
    monkeypatch.setattr(km, "_summed", lambda rows, read: read(pdf))
    monkeypatch.setattr(km.Machines, "features", lambda self, projected, trial: asked.append(trial) or features(self, projected, trial))
    trials = [km.KernelTrial(1e-6, 0.1), km.KernelTrial(10.0, 1.0)]
    both = km.fit_machines(None, trials, [0, 1, 2], 3, 3, features=16, max_iter=200, vec="x")
    assert asked.count(0) != asked.count(1)
    for t, trial in enumerate(trials):
        alone = km.fit_machines(None, [trial], [0, 1, 2], 3, 3, features=16, max_iter=200, vec="x")
        assert np.allclose(alone.coef[0], both.coef[t], atol=1e-3)
