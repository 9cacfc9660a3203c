"""Many kernel machines at once: classes x trials x folds of a search learn in the same passes over the rows.

The RBF kernel of a width is approximated by random Fourier features. All widths share one draw of frequencies, which a trial
scales by its own width, so a pass projects a row once and then takes the cosines per trial. Machines minimise the
squared hinge loss, one class against the rest; those of a trial are the columns of one matrix product, whatever their fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashing import gauss_matrix
from ..functions.vectors import stack_vectors
from .many_models import _summed, minimise

_BATCH = 2_000_000  # margins held at once
_ROWS = 256  # rows whose features stay in a core's cache
_COSINE = [(-1) ** n * (math.pi / 2) ** (2 * n) / math.factorial(2 * n) for n in range(9)]  # fixed values: series of a quarter of a turn's angle


def turned(z: np.ndarray) -> np.ndarray:
    """Cosines of angles in turns, in place, to within a few units of the last digit; numpy's own take several times as long."""
    z -= np.rint(z)
    z *= z
    out = z * _COSINE[-1]
    for c in _COSINE[-2:0:-1]:
        out += c
        out *= z
    out += 1.0
    for _ in range(2):  # the double angle
        out *= out
        out *= 2.0
        out -= 1.0
    z[:] = out
    return z


@dataclass(frozen=True)
class KernelTrial:
    """Inverse weight of the squared coefficients and the kernel's ``gamma``."""

    c: float
    gamma: float


@dataclass(frozen=True)
class Machines:
    """Coefficients (trial, fold, class, feature and offset); two classes share one machine, of the second class."""

    trials: tuple[KernelTrial, ...]
    folds: tuple[int, ...]
    classes: int
    base: np.ndarray
    phase: np.ndarray
    coef: np.ndarray

    def features(self, projected: np.ndarray, trial: int) -> np.ndarray:
        out = np.empty((len(projected), projected.shape[1] + 1))
        turns, phase = math.sqrt(2.0 * self.trials[trial].gamma) / (2.0 * math.pi), self.phase / (2.0 * math.pi)
        for a in range(0, len(out), _ROWS):
            z = projected[a:a + _ROWS] * turns
            z += phase
            np.multiply(turned(z), math.sqrt(2.0 / projected.shape[1]), out=out[a:a + _ROWS, :-1])
        out[:, -1] = 1.0
        return out

    def margins(self, x: np.ndarray, trial: int, fold: int) -> np.ndarray:
        """Rows x classes; with two classes the first has the second's margin with the other sign."""
        m = self.features(x @ self.base, trial) @ self.coef[trial, fold].T
        return np.hstack([-m, m]) if self.classes <= 2 else m


def _signs(y: np.ndarray, classes: int) -> np.ndarray:
    """1 for a row's own class and -1 for others, a column a machine."""
    return np.where(y[:, None] == (np.arange(classes) if classes > 2 else np.array([1])), 1.0, -1.0)


def _parts(rows: int, columns: int):
    step = max(1, min(_ROWS, _BATCH // max(1, columns)))
    return [slice(a, a + step) for a in range(0, rows, step)]


def fit_machines(rows: DataFrame, trials: list[KernelTrial], folds: list[int], width: int, classes: int, features: int = 128, seed: int = 42,
                 max_iter: int = 100, vec: str = "embedding", label: str = "y") -> Machines:
    """Machines of every trial and fold for staged ``rows(vec, label, fold)``; fold -1 learns from all rows."""
    base = gauss_matrix(width, features, "fourier", seed)
    phase = np.random.Generator(np.random.PCG64(seed + 1)).uniform(0.0, 2.0 * math.pi, features)
    columns = 1 if classes <= 2 else classes
    shape = (len(trials), len(folds), columns, features + 1)
    held = np.array(folds)
    machines = Machines(tuple(trials), tuple(folds), classes, base, phase, np.zeros(shape))
    inside = _summed(rows, lambda pdf: (pdf["fold"].to_numpy()[:, None] != held).sum(0).astype(float))
    penalty = 1.0 / (np.array([t.c for t in trials])[:, None] * np.maximum(inside, 1))

    def evaluate(coef: np.ndarray, live: np.ndarray):
        coef, learns = coef.reshape(shape), [np.flatnonzero(own) for own in live.reshape(len(trials), -1)]

        def read(pdf):
            x, y, fold = stack_vectors(pdf[vec]), pdf[label].to_numpy(np.int64), pdf["fold"].to_numpy()
            loss, slope = np.zeros(shape[:3]), np.zeros(shape)
            flat_loss, flat_slope = loss.reshape(len(trials), -1), slope.reshape(len(trials), -1, features + 1)
            own = [coef[t].reshape(-1, features + 1)[some].T for t, some in enumerate(learns)]
            for part in _parts(len(x), len(held) * columns):
                projected = x[part] @ base
                sign = np.tile(_signs(y[part], classes), len(held))
                teaches = np.repeat(fold[part][:, None] != held, columns, axis=1)
                for t, some in enumerate(learns):
                    if not len(some):  # all machines of the trial have ended
                        continue
                    z, side, counts = machines.features(projected, t), sign, teaches
                    if len(some) < sign.shape[1]:
                        side, counts = sign[:, some], teaches[:, some]
                    short = z @ own[t]
                    short *= side
                    np.subtract(1.0, short, out=short)
                    np.maximum(short, 0.0, out=short)
                    short *= counts
                    flat_loss[t, some] += (short * short).sum(0)
                    short *= side
                    flat_slope[t, some] -= 2.0 * (short.T @ z)
            return np.concatenate([loss.ravel(), slope.ravel()])

        got, size = _summed(rows, read), coef[..., 0].size
        n = np.maximum(inside, 1)[:, None]
        free = coef.copy()
        free[..., -1] = 0.0  # the offset is not penalised
        value = got[:size].reshape(shape[:3]) / n + 0.5 * penalty[:, :, None] * (free * free).sum(-1)
        slope = got[size:].reshape(shape) / n[..., None] + penalty[:, :, None, None] * free
        return value.ravel(), slope.reshape(size, -1)

    many = len(trials) * len(folds) * columns
    coef = minimise(evaluate, (many, features + 1), np.full(many, max_iter)).reshape(shape)
    return Machines(tuple(trials), tuple(folds), classes, base, phase, coef)


def held_out_counts(rows: DataFrame, machines: Machines, vec: str = "embedding", label: str = "y") -> np.ndarray:
    """(trial, fold, class, told class) counts over the rows of each fold."""
    k, many = max(2, machines.classes), (len(machines.trials), len(machines.folds))

    def read(pdf):
        x, y, fold = stack_vectors(pdf[vec]), pdf[label].to_numpy(np.int64), pdf["fold"].to_numpy()
        out = np.zeros((*many, k * k))
        for f, number in enumerate(machines.folds):
            own = fold == number
            for t in range(many[0]) if own.any() else []:
                out[t, f] += np.bincount(y[own] * k + machines.margins(x[own], t, f).argmax(1), minlength=k * k)
        return out.ravel()

    return _summed(rows, read).reshape(*many, k, k)


def held_out_margins(rows: DataFrame, machines: Machines, vec: str = "embedding", label: str = "y") -> DataFrame:
    """``(label, margins)`` of every row by the first trial's machines that did not learn from it."""
    folds = {number: f for f, number in enumerate(machines.folds)}

    def work(batches):
        for pdf in batches:
            x, fold = stack_vectors(pdf[vec]), pdf["fold"].to_numpy()
            out = np.zeros((len(x), max(2, machines.classes)))
            for number in np.unique(fold):
                out[fold == number] = machines.margins(x[fold == number], 0, folds[int(number)])
            yield pd.DataFrame({"label": pdf[label].to_numpy(np.int64), "margins": list(out)})

    return rows.mapInPandas(work, "label long, margins array<double>")


def fit_sigmoids(margins: DataFrame, classes: int, rounds: int = 100) -> np.ndarray:
    """Per class the slope and offset that turn staged ``(label, margins)`` into probabilities, all classes in the same passes.

    Targets are drawn in by a pseudo-count on each side, so separable margins keep finite slopes. Newton steps, halved while a step
    does not lessen the loss.
    """
    sides = _summed(margins, lambda pdf: np.bincount(pdf["label"], minlength=classes).astype(float))
    yes, no = (sides + 1) / (sides + 2), 1 / (sides.sum() - sides + 2)

    def evaluate(coef):
        def read(pdf):
            m, y = stack_vectors(pdf["margins"]), pdf["label"].to_numpy()
            target = np.where(y[:, None] == np.arange(classes), yes, no)
            z = m * coef[:, 0] + coef[:, 1]
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            loss = np.logaddexp(0, z) - target * z
            r, w = p - target, p * (1 - p)
            return np.concatenate([v.sum(0) for v in (loss, r * m, r, w * m * m, w * m, w)])

        return _summed(margins, read).reshape(6, classes)

    coef = np.column_stack([np.ones(classes), np.zeros(classes)])
    now, step = evaluate(coef), np.ones(classes)
    for _ in range(rounds):
        a, b, c = now[3] + 1e-9, now[4], now[5] + 1e-9
        move = np.column_stack([c * now[1] - b * now[2], a * now[2] - b * now[1]]) / np.maximum(a * c - b * b, 1e-18)[:, None]
        new = evaluate(coef - step[:, None] * move)
        better = new[0] <= now[0]
        if (better & (now[0] - new[0] <= 1e-9 * np.maximum(1, now[0])) | (step < 1e-6)).all():
            break
        coef[better] -= (step[:, None] * move)[better]
        now, step = np.where(better, new, now), np.where(better, 1.0, step / 2)
    return coef
