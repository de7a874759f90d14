"""Distances to the k-th neighbour in a plane."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Points of a tile, sampled points of a tile, and tiles. Beyond that many tiles, tiles grow.
OF_TILE, SAMPLED, MOST_TILES = 512, 32, 16_384


@dataclass
class Tiles:
    """Boxes that fill the plane, from halving a sample of its points along the wider side."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray) -> Tiles:
        nodes, boxes = [], []

        def build(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            at = len(nodes)
            nodes.append([0, 0.0, at, at, -1])
            spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(2)
            d = int(spread.argmax())
            if len(own) < 2 * SAMPLED or not spread[d] > 0:
                nodes[at][4] = len(boxes)
                boxes.append((low, high))
                return at
            v = own[:, d]
            cut = float(np.partition(v, len(v) // 2)[len(v) // 2])
            if not (v < cut).any():
                cut = float(v[v > cut].min())
            right_low, left_high = low.copy(), high.copy()
            right_low[d] = left_high[d] = cut
            nodes[at][:4] = [d, cut, build(own[v < cut], low, left_high), build(own[v >= cut], right_low, high)]
            return at

        build(sample, np.full(2, -np.inf), np.full(2, np.inf))
        return cls(np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2:4] for n in nodes]), np.array([n[4] for n in nodes]),
                   np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))

    def of(self, v: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(v), int), np.arange(len(v))
        while (self.leaf[at] < 0).any():
            at = self.child[at, (v[rows, self.dim[at]] >= self.cut[at]).astype(int)]  # a leaf is its own child
        return self.leaf[at]

    def met(self, v: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which tiles the squares around points touch."""
        reach = (reach * (1 + 1e-9) + 1e-12)[:, None]
        return ((v[:, :1] - reach <= self.high[:, 0]) & (v[:, :1] + reach >= self.low[:, 0]) & (v[:, 1:] - reach <= self.high[:, 1]) & (v[:, 1:] + reach >= self.low[:, 1]))


def _nearest(asked: np.ndarray, have: np.ndarray, count: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and counts of the ``want`` nearest points, from the nearest on."""
    n, ds, cs = min(want, len(have)), [], []
    for a in range(0, len(asked), 256):
        q = asked[a:a + 256]
        d = np.maximum(np.abs(q[:, :1] - have[:, 0]), np.abs(q[:, 1:] - have[:, 1]))
        at = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(have) else np.tile(np.arange(n), (len(q), 1))
        near = np.take_along_axis(d, at, axis=1)
        order = np.argsort(near, axis=1)
        ds.append(np.take_along_axis(near, order, axis=1))
        cs.append(count[np.take_along_axis(at, order, axis=1)])
    return np.concatenate(ds), np.concatenate(cs)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def reaches(plane: DataFrame, k: int) -> DataFrame:
    """(id, x, y, c, reach) for the distinct points of ``plane`` (x, y) that come ``c`` times: the distance to the k-th other row, the
    larger of both differences; to the farthest where there are fewer.

    Points are dealt into tiles of about ``OF_TILE``; a tile's own rows bound each distance, and only points whose square leaves the tile
    visit the tiles that it touches. Rows that are equal are one point, so tiles can always be halved and work grows with the points."""
    want = k + 1  # a row is its own neighbour
    points = written(plane.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")).select(F.monotonically_increasing_id().alias("id"), "x", "y", "c"), "points")
    n = points.count()
    tiles = max(1, min(MOST_TILES, n // OF_TILE))
    share = int(min(1.0, tiles * SAMPLED / max(n, 1)) * (1 << 30)) if tiles > 1 else 0
    some = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("x", "y").toArrow()
    known = Tiles.fit(np.stack([np.asarray(some["x"], float), np.asarray(some["y"], float)], axis=1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = known.of(np.stack([np.asarray(b.column(1)), np.asarray(b.column(2))], axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], ["id", "x", "y", "c", "tile"])

    def inside(rows: pa.Table) -> pa.Table:
        v, c, own = np.stack([np.asarray(rows["x"]), np.asarray(rows["y"])], axis=1), np.asarray(rows["c"]), rows["tile"][0].as_py()
        d, near = _nearest(v, v, c, want)
        enough = np.cumsum(near, axis=1) >= want
        far = np.where(enough.any(axis=1), d[np.arange(len(v)), enough.argmax(axis=1)], np.inf)
        at, sizes = [], []
        for a in range(0, len(v), 256):
            met = known.met(v[a:a + 256], far[a:a + 256])
            met[:, own] = False
            at.append(np.nonzero(met)[1])
            sizes.append(met.sum(axis=1))
        far = np.where(np.isinf(far), d[:, -1], far)
        width = np.full(len(v), d.shape[1])
        return pa.table([rows["id"], rows["x"], rows["y"], rows["c"], pa.array(far), _lists(d.ravel(), width), _lists(near.ravel(), width), _lists(np.concatenate(at).astype(np.int32), np.concatenate(sizes))],
                        ["id", "x", "y", "c", "far", "d", "n", "tiles"])

    def beyond(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(asked) or not len(rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], ["id", "d", "n"])
        d, near = _nearest(np.stack([np.asarray(asked["x"]), np.asarray(asked["y"])], axis=1), np.stack([np.asarray(rows["x"]), np.asarray(rows["y"])], axis=1), np.asarray(rows["c"]), want)
        return pa.table([pa.array(np.repeat(np.asarray(asked["id"]), d.shape[1])), pa.array(d.ravel()), pa.array(near.ravel())], ["id", "d", "n"])

    dealt = written(points.mapInArrow(deal, "id long, x double, y double, c long, tile int"), "tiles")
    own = written(dealt.groupBy("tile").applyInArrow(inside, "id long, x double, y double, c long, far double, d array<double>, n array<long>, tiles array<int>"), "inside")
    leaving = own.where(F.size("tiles") > 0)
    asked = leaving.select("id", "x", "y", F.explode("tiles").alias("tile"))
    there = asked.groupBy("tile").cogroup(dealt.groupBy("tile")).applyInArrow(beyond, "id long, d double, n long")
    here = leaving.select("id", F.explode(F.arrays_zip("d", "n")).alias("z")).select("id", "z.d", "z.n")
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    merged = here.unionByName(there).withColumn("s", upto).groupBy("id").agg(F.coalesce(F.min(F.when(F.col("s") >= want, F.col("d"))), F.max("d")).alias("merged"))
    return own.join(merged, "id", "left").select("id", "x", "y", "c", F.coalesce("merged", "far").alias("reach"))
