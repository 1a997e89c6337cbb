"""Nearest point by branch and bound: boxes of binned points decide which points a place has to meet, a tree within each bin
finds the nearest of them. Exact; no place meets all points.

1. One aggregation bins the points over the unit cube and gives each bin's count and tight bounding box. There are BINS bins
   at most, whatever the number of points.
2. A place needs a bin only if its box is nearer than the best upper bound over all boxes. A tight box has a point on each of
   its faces, which bounds the nearest point from above (Roussopoulos, Kelley and Vincent, 1995).
3. Places and points meet by bin. Bins that no place needs are dropped before the shuffle; bins of more than PART points are
   dealt to parts by hash, each of which every such place asks, so that a hot bin is many tasks.
4. In each part a k-d tree is searched by all its places together, a branch being left when its box is no nearer than a
   place's best so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship

#: Bins over all layers, at most (beyond it each layer is one bin), and points in a part of a bin, about.
BINS, PART = 1 << 16, 200_000
_LEAF, _GROUP, _SLAB = 32, 256, 1 << 18
#: Bounds and distances are rounded differently; nothing is left out for that.
_ROUNDING = 1 + 1e-9


class Tree:
    """A k-d tree over points (rows of a matrix), searched for many places at once."""

    def __init__(self, points: np.ndarray):
        self.points = points.copy()
        self.nodes: list[tuple[int, int, int, int]] = []  # first and last point, and the two nodes below (-1: a leaf)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        if len(points):
            self._split(0, len(points))

    def _split(self, a: int, z: int) -> int:
        own = self.points[a:z]
        low, high = own.min(0), own.max(0)
        at = len(self.nodes)
        self.nodes.append((a, z, -1, -1))
        self.low.append(low)
        self.high.append(high)
        widest = int(np.argmax(high - low))
        if z - a > _LEAF and high[widest] > low[widest]:
            half = (z - a) // 2
            self.points[a:z] = own[np.argpartition(own[:, widest], half)]
            left = self._split(a, a + half)
            self.nodes[at] = (a, z, left, self._split(a + half, z))
        return at

    def nearest(self, places: np.ndarray) -> np.ndarray:
        """Squared distances of the places' nearest points; infinity without points."""
        best = np.full(len(places), np.inf)
        if self.nodes and len(places):
            self._visit(0, np.arange(len(places)), places, best)
        return best

    def _visit(self, node: int, asked: np.ndarray, places: np.ndarray, best: np.ndarray) -> None:
        asked = asked[outside(places[asked], self.low[node], self.high[node]) <= best[asked] * _ROUNDING]
        if not len(asked):
            return
        a, z, left, right = self.nodes[node]
        if left < 0:
            own = self.points[a:z]
            if z - a > _LEAF:  # points that are all alike
                own = own[:1]
            for s in range(0, len(asked), _SLAB // _LEAF):
                some = asked[s : s + _SLAB // _LEAF]
                best[some] = np.minimum(best[some], squared(own[None], places[some][:, None]).min(1))
            return
        near_left = outside(places[asked], self.low[left], self.high[left]) <= outside(places[asked], self.low[right], self.high[right])
        self._visit(left, asked[near_left], places, best)
        self._visit(right, asked[~near_left], places, best)
        self._visit(right, asked[near_left], places, best)
        self._visit(left, asked[~near_left], places, best)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the dimensions."""
    total = 0.0
    for i in range(a.shape[-1]):
        d = a[..., i] - b[..., i]
        total = total + d * d
    return total


def outside(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of places from boxes (0 within): no point of a box is nearer."""
    d = np.maximum(np.maximum(low - places, places - high), 0.0)
    return (d * d).sum(-1)


def reached(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances within which tight boxes must have a point."""
    near = np.abs(places - np.where(places <= (low + high) / 2, low, high))
    far = np.maximum(np.abs(places - low), np.abs(places - high))
    whole = (far * far).sum(-1)
    return (whole[..., None] - far * far + near * near).min(-1)


def _bits(dimensions: int, layers: int) -> int:
    return max(0, int(math.log2(max(1, BINS // max(1, layers)))) // dimensions)


def _bin(prefix: str, dimensions: int, bits: int) -> Column:
    """Number of the bin of coordinates in [0, 1]; those outside are at the rim."""
    out = F.lit(0).cast("long")
    for i in range(dimensions):
        at = F.floor(F.greatest(F.least(F.col(f"{prefix}{i}"), F.lit(1.0)), F.lit(0.0)) * F.lit(float(1 << bits)))
        out = out * F.lit(1 << bits) + F.least(at, F.lit((1 << bits) - 1).cast("long"))
    return out


class _Boxes:
    """The bins of all layers: numbers, boxes, and parts."""

    def __init__(self, rows: list, dimensions: int, part: int):
        rows = sorted(rows, key=lambda r: (r["layer"], r["bin"]))
        self.bins = np.array([r["bin"] for r in rows], np.int64)
        self.parts = np.array([-(-r["n"] // part) for r in rows], np.int64)
        self.low, self.high = (np.array([[r[f"{k}{i}"] for i in range(dimensions)] for r in rows], float).reshape(-1, dimensions) for k in ("low", "high"))
        layers = np.array([r["layer"] for r in rows], np.int64)
        self.of = {int(k): slice(*np.searchsorted(layers, [k, k + 1]).tolist()) for k in np.unique(layers)}

    def needed(self, layer: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, box) pairs in which the box may hold the place's nearest point."""
        own = self.of.get(layer)
        if own is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.low[own], self.high[own]
        step = max(1, min(_GROUP, _SLAB // len(low)))
        found = []
        for s in range(0, len(places), step):  # neighbours in the grid's order leave most boxes out together
            some = places[s : s + step]
            a, z = some.min(0), some.max(0)
            farthest = np.maximum(np.abs(high - a), np.abs(z - low))
            apart = np.maximum(np.maximum(low - z, a - high), 0.0)
            left = np.flatnonzero((apart * apart).sum(1) <= (farthest * farthest).sum(1).min() * _ROUNDING)
            most = reached(some[:, None], low[left], high[left]).min(1)
            p, b = np.nonzero(outside(some[:, None], low[left], high[left]) <= most[:, None] * _ROUNDING)
            found.append((p + s, left[b] + own.start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(places: DataFrame, points: DataFrame, dimensions: int, layers: int, part: int = PART) -> DataFrame:
    """layer, place and d2 (squared distance to the nearest point of its layer; infinity without any) per place.

    ``places``: layer, place, g0..; ``points``: layer, n0.., scaled so that most lie in [0, 1]. Points without all
    coordinates are no points.
    """
    spark = places.sparkSession
    ship(spark)
    axes, held = range(dimensions), [f"n{i}" for i in range(dimensions)]
    bits = _bits(dimensions, layers)
    known = points.select("layer", *held).where(" AND ".join(f"{c} IS NOT NULL" for c in ["layer", *held])).withColumn("bin", _bin("n", dimensions, bits))
    ends = [f(f"n{i}").alias(f"{k}{i}") for i in axes for k, f in (("low", F.min), ("high", F.max))]
    boxes = _Boxes(known.groupBy("layer", "bin").agg(F.count("*").alias("n"), *ends).collect(), dimensions, part)  # BINS rows, or one a layer
    box = spark.sparkContext.broadcast(boxes)
    asked = "layer long, bin long, part long, place long, " + ", ".join(f"g{i} double" for i in axes)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = box.value
        for b in batches:
            layer, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.column_stack([b.column(2 + i).to_numpy() for i in axes])
            for k in np.unique(layer).tolist():
                own = np.flatnonzero(layer == k)
                p, c = boxes.needed(k, at[own])
                many = boxes.parts[c]
                p, c = np.repeat(own[p], many), np.repeat(c, many)
                part = np.arange(len(c)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(p), k), boxes.bins[c], part, place[p], *at[p].T)], names=["layer", "bin", "part", "place", *[f"g{i}" for i in axes]])

    slim = places.select("layer", "place", *[f"g{i}" for i in axes])
    pairs = slim.mapInArrow(needed, asked)
    wanted = pairs.groupBy("layer", "bin").agg((F.max("part") + 1).alias("parts"))  # as many rows as boxes, at most
    dealt = known.join(F.broadcast(wanted), ["layer", "bin"]).select("layer", "bin", F.pmod(F.xxhash64(*held), F.col("parts")).alias("part"), *held).distinct()
    keys = ["layer", "bin", "part"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        at = a[[f"g{i}" for i in axes]].to_numpy()
        return pd.DataFrame({"layer": a["layer"], "place": a["place"], "d2": Tree(b[held].to_numpy()).nearest(at)})

    met = pairs.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(meet, "layer long, place long, d2 double")
    least = slim.select("layer", "place", F.lit(float("inf")).alias("d2")).union(met).groupBy("layer", "place").agg(F.min("d2").alias("d2"))
    return least
