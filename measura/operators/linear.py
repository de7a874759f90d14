"""Linear models from sums.

One aggregate gives the sums of products of all columns for each group of rows (folds, inner folds). Ridges are solved from sums, lasso and
elastic net by coordinate descent on them; sums of groups add up, so all training sets of a validation, all penalties and all scores come
from one scan. Tasks and driver hold columns squared numbers for each group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a task may multiply, and groups of one aggregate.
MOST_COLUMNS, MOST_GROUPS = 2_000, 10_000


@dataclass
class Sums:
    """Weight, sums and sums of products of (features, label), all less one common ``shift``; and the number of rows."""

    n: float
    first: np.ndarray
    second: np.ndarray
    shift: np.ndarray
    rows: float = 0.0

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.first + other.first, self.second + other.second, self.shift, self.rows + other.rows)

    def times(self, weight: float) -> Sums:
        """The sums with each row's weight times ``weight``."""
        return Sums(self.n * weight, self.first * weight, self.second * weight, self.shift, self.rows)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Means, and centred sums of products."""
        mean = self.first / self.n if self.n else self.first
        return mean + self.shift, self.second - np.outer(mean, self.first)

    def of(self, columns: list[int]) -> Sums:
        """The sums of some features and the label."""
        at = [*columns, len(self.first) - 1]
        return Sums(self.n, self.first[at], self.second[np.ix_(at, at)], self.shift[at], self.rows)

    def squared_error(self, coefficients: np.ndarray, intercept: float) -> float:
        """The sum of squared errors that a model makes on these rows."""
        mean, second = self.centred()
        v = np.append(-coefficients, 1.0)
        off = mean @ v - intercept
        return float(max(v @ second @ v, 0.0) + self.n * off * off)

    def label_variation(self) -> tuple[float, float]:
        mean, second = self.centred()
        return mean[-1], second[-1, -1]


def total(parts: list[Sums]) -> Sums | None:
    out = None
    for p in parts:
        out = p if out is None else out + p
    return out


#: Columns up to which the sums are an aggregate of column expressions; more of them are multiplied as matrices.
FEW_COLUMNS = 6


def sums(df: DataFrame, features: list[str], label: str, by: list[str] | None = None, weight: str | None = None) -> dict[tuple, Sums]:
    """Sums by group, a tuple of the integers in ``by``. Rows with a missing feature, label, weight or group are left out."""
    by, m = by or [], len(features) + 1
    if m > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS - 1} features")
    columns = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*features, label])]
    w = (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")
    rows = df.select(*(F.col(c).cast("long").alias(f"g{k}") for k, c in enumerate(by)), *columns, w).na.drop()
    some = rows.select(*(f"c{k}" for k in range(m))).limit(64).toArrow()  # any value near the data will do
    shift = np.array([np.mean(np.asarray(some[k], float)) if len(some) else 0.0 for k in range(m)])
    upper, n_by = np.triu_indices(m), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            z = np.stack([np.asarray(b.column(n_by + k), float) for k in range(m)], axis=1) - shift
            w = np.asarray(b.column(n_by + m), float)
            keys = np.stack([np.asarray(b.column(k)) for k in range(n_by)], axis=1) if n_by else np.zeros((len(b), 0), int)
            groups, at = np.unique(keys, axis=0, return_inverse=True)
            for k, g in enumerate(groups):
                mine = at.reshape(-1) == k
                own, ww = z[mine], w[mine]
                part = np.concatenate([[ww.sum(), len(ww)], ww @ own, ((own.T * ww) @ own)[upper]])
                found[tuple(g.tolist())] = found.get(tuple(g.tolist()), 0) + part
        for g, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x)) for x in g] + [pa.array(np.arange(len(part))), pa.array(part)], [*(f"g{k}" for k in range(n_by)), "i", "v"])

    schema = ", ".join([*(f"g{k} long" for k in range(n_by)), "i long", "v double"])
    keys = [f"g{k}" for k in range(n_by)]
    if m <= FEW_COLUMNS:
        z, own = [f"z{k}" for k in range(m)], F.col("w")
        near = rows.withColumns({f"z{k}": F.col(f"c{k}") - float(shift[k]) for k in range(m)})
        parts = [F.sum(own), F.count(F.lit(1)).cast("double"), *(F.sum(own * F.col(c)) for c in z), *(F.sum(own * F.col(z[i]) * F.col(z[j])) for i, j in zip(*upper))]
        long = near.groupBy(*keys).agg(*(p.alias(f"s{i}") for i, p in enumerate(parts))).select(*keys, F.posexplode(F.array(*(f"s{i}" for i in range(len(parts))))).alias("i", "v"))
        got = long.where("v is not null").select(*keys, F.col("i").cast("long").alias("i"), "v").toArrow()
    else:
        got = rows.mapInArrow(run, schema).groupBy(*keys, "i").agg(F.sum("v").alias("v")).toArrow()
    out: dict[tuple, np.ndarray] = {}
    width = 2 + m + len(upper[0])
    names = np.stack([np.asarray(got[k]) for k in keys], axis=1) if keys and len(got) else np.zeros((len(got), 0), int)
    for g, i, v in zip(map(tuple, names.tolist()), np.asarray(got["i"]), np.asarray(got["v"])):
        if g not in out and len(out) >= MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups")
        out.setdefault(g, np.zeros(width))[i] = v
    found = {}
    for g, v in sorted(out.items()):
        if not v[1]:
            continue
        second = np.zeros((m, m))
        second[upper] = v[2 + m:]
        found[g] = Sums(v[0], v[2:2 + m], second + np.triu(second, 1).T, shift, v[1])
    return found


@dataclass
class Linear:
    """A fitted linear model; predicts by a column expression."""

    weights: np.ndarray
    intercept: float

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.weights)

    def column(self, features: list[str]) -> Column:
        return added([F.lit(float(w)) * F.col(c) for w, c in zip(self.weights, features)] + [F.lit(float(self.intercept))])


def added(parts: list[Column]) -> Column:
    """A balanced sum: its expression stays shallow."""
    while len(parts) > 1:
        parts = [parts[k] + parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def solve(s: Sums | None, kind: str, alpha: float, mix: float = 0.5, per_row: bool = False, start: np.ndarray | None = None, tolerance: float = 1e-10, most: int = 100_000) -> Linear:
    """``ridge``: least |err|^2 / 2n + alpha |w|^2 / 2n. ``lasso``, ``elastic``: least |err|^2 / 2n + alpha (mix |w|_1 + (1 - mix) |w|^2 / 2),
    with mix 1 for lasso; ``per_row`` divides this penalty by n as well. The intercept is not penalised."""
    if s is None or not s.n:
        return Linear(np.zeros(0 if s is None else len(s.first) - 1), 0.0)
    mean, second = s.centred()
    c, d = second[:-1, :-1], second[:-1, -1]
    if kind == "ridge":
        w = np.linalg.lstsq(c + alpha * np.eye(len(d)), d, rcond=None)[0] if len(d) else np.zeros(0)
    else:
        w = descend(c / s.n, d / s.n, alpha / s.n if per_row else alpha, 1.0 if kind == "lasso" else mix, start, tolerance, most)
    return Linear(w, float(mean[-1] - mean[:-1] @ w))


def descend(c: np.ndarray, d: np.ndarray, alpha: float, mix: float, start: np.ndarray | None, tolerance: float, most: int) -> np.ndarray:
    """Coordinate descent for w'cw / 2 - d'w + alpha (mix |w|_1 + (1 - mix) |w|^2 / 2), until no coordinate's optimality condition is off
    by more than ``tolerance`` of the largest |d|."""
    w = np.zeros(len(d)) if start is None else start.astype(float).copy()
    rest, l1, l2 = d - c @ w, alpha * mix, alpha * (1 - mix)
    scale = max(np.abs(d).max(initial=0.0), 1e-300)
    for _ in range(most):
        for j in range(len(d)):
            if (bottom := c[j, j] + l2) <= 1e-300:
                continue
            g = rest[j] + c[j, j] * w[j]
            new = np.sign(g) * max(abs(g) - l1, 0.0) / bottom
            if new != w[j]:
                rest -= c[:, j] * (new - w[j])
                w[j] = new
        slope = rest - l2 * w
        off = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0.0))
        if off.max(initial=0.0) <= tolerance * scale:
            break
    return w


def path(s: Sums, alphas: list[float], mix: float = 1.0, per_row: bool = False) -> list[Linear]:
    """Models for falling penalties, each started from the one before; in the order of ``alphas``."""
    found, start = {}, None
    for a in sorted(alphas, reverse=True):
        found[a] = solve(s, "elastic", a, mix, per_row, start)
        start = found[a].weights
    return [found[a] for a in alphas]


def fold_column(models: list[Linear], features: list[str], fold: str) -> Column:
    """The prediction of each row by the model of its fold; NULL for other folds."""
    at = F.col(fold) + 1

    def of(values: list[float]) -> Column:
        return F.element_at(F.lit([float(v) for v in values]), at)

    got = added([of([m.weights[j] for m in models]) * F.col(c) for j, c in enumerate(features)] + [of([m.intercept for m in models])])
    return F.when(F.col(fold).between(0, len(models) - 1), got)
