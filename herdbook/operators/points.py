"""Points near other points, and the regions that contain them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdbook.runtime import cut, hot_keys, salt_all, salt_one

EARTH_M = 6_371_000.0


def usable_point(lat: Column, lon: Column) -> Column:
    """True for a pair of finite coordinates other than latitude 0 and longitude 0; never null."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < 1e6) & (F.abs(lon) < 1e6)
    return F.coalesce(ok & ~((lat == 0) & (lon == 0)), F.lit(False))


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres by the haversine formula."""
    s = F.pow(F.sin((F.radians(lat_b) - F.radians(lat_a)) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin((F.radians(lon_b) - F.radians(lon_a)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))))


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_m: float, apart: str | None = None, cell_radii: int = 8) -> DataFrame:
    """All pairs of points at most radius_m apart, as (key_a, key_b, distance_m), the smaller key first.

    Points become cells of a grid over the sphere in three dimensions, so poles and the date line need no special case.
    One side stands in its own cell, the other in each cell that its ball touches: every pair meets in exactly one cell.
    Cells with many rows are salted. `key` must be unique; with `apart` given, both rows must have different values in it
    (a null takes no part). Rows without usable coordinates take no part. An empty table gives an empty result.
    """
    side = radius_m * cell_radii
    reach = radius_m * 1.000001 + 1e-3
    own = F.col(apart) if apart else F.col(key)
    p = points.where(usable_point(F.col(lat), F.col(lon)) & own.isNotNull()).select(
        F.col(key).alias("_k"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), F.xxhash64(own).alias("_g"))
    la, lo = F.radians("_lat"), F.radians("_lon")
    axes = {"_x": F.cos(la) * F.cos(lo) * EARTH_M, "_y": F.cos(la) * F.sin(lo) * EARTH_M, "_z": F.sin(la) * EARTH_M}
    p = p.withColumns(axes)
    cells = ["_cx", "_cy", "_cz"]
    a = p.select("_k", "_lat", "_lon", "_g", *(F.floor(F.col(v) / side).cast("int").alias(c) for v, c in zip(axes, cells)))
    b = p.select("_k", "_lat", "_lon", "_g", *(F.sequence(F.floor((F.col(v) - reach) / side).cast("int"), F.floor((F.col(v) + reach) / side).cast("int")).alias(f"{v}s") for v in axes))
    for v, c in zip(axes, cells):
        b = b.withColumn(c, F.explode(f"{v}s")).drop(f"{v}s")
    hot = hot_keys(a, cells, rows=2_000)
    a = salt_one(a, hot, cells, F.col("_k"))
    b = salt_all(b, hot, cells)
    b = b.select(*cells, "_salt", *(F.col(c).alias(f"{c}2") for c in ("_k", "_lat", "_lon", "_g")))
    pairs = a.join(b, [*cells, "_salt"]).where((F.col("_k") < F.col("_k2")) & (F.col("_g") != F.col("_g2")))
    pairs = pairs.withColumn("distance_m", great_circle_m(F.col("_lat"), F.col("_lon"), F.col("_lat2"), F.col("_lon2")))
    return pairs.where(F.col("distance_m") <= radius_m).select(F.col("_k").alias("key_a"), F.col("_k2").alias("key_b"), "distance_m")


def ring_edges(regions: DataFrame, region: str, rings: str) -> DataFrame:
    """One row (region, x1, y1, x2, y2) for each edge of each ring that isn't level, y1 < y2.

    A ring may or may not repeat its first point. Null rings and points with null coordinates are left out.
    """
    ring = regions.select(F.col(region).alias("region"), F.explode(rings).alias("ring")).select("region", F.filter("ring", lambda q: q.isNotNull() & q.x.isNotNull() & q.y.isNotNull()).alias("ring"))
    n = F.size("ring")
    edge = ring.where(n >= 3).select("region", F.explode(F.transform("ring", lambda q, i: F.struct(q.alias("p"), F.get("ring", F.pmod(i + 1, n)).alias("q")))).alias("e"))
    p, q, up = F.col("e.p"), F.col("e.q"), F.col("e.p.y") < F.col("e.q.y")
    pick = lambda f: [F.when(up, p[f]).otherwise(q[f]).alias(f"{f}1"), F.when(up, q[f]).otherwise(p[f]).alias(f"{f}2")]
    return edge.where(F.col("e.p.y") != F.col("e.q.y")).select("region", *pick("x"), *pick("y"))


class Slabs:
    """The trapezoidal decomposition of the edges in one strip: slabs between the heights of all vertices, edges in order.

    In a slab no vertex lies, so the edges of a region are ordered from left to right as long as none cross; a run of
    edges that do cross is marked and counted edge by edge. Slabs end at the strip's own heights `low` and `high`: an edge
    that runs far beyond the strip makes no slab there (its own coordinates stay whole, so crossings are exact).
    """

    def __init__(self, region: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, low: float = -np.inf, high: float = np.inf) -> None:
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2
        bottom, top = np.maximum(y1, low), np.minimum(y2, high)
        self.heights = np.unique(np.concatenate([bottom, top]))
        first, last = np.searchsorted(self.heights, bottom), np.searchsorted(self.heights, top)
        spans = last - first
        edge = np.repeat(np.arange(len(x1)), spans)
        slab = np.repeat(first, spans) + np.arange(len(edge)) - np.repeat(np.cumsum(spans) - spans, spans)
        low, high = self.heights[slab], self.heights[slab + 1]
        middle = self.at(edge, (low + high) / 2)
        order = np.lexsort((middle, region[edge], slab))
        self.edge, slab = edge[order], slab[order]
        reg = region[self.edge]
        new = np.ones(len(order), bool)
        new[1:] = (slab[1:] != slab[:-1]) | (reg[1:] != reg[:-1])
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(order))
        self.run_region, run_slab = reg[self.start], slab[self.start]
        self.slab_runs = np.searchsorted(run_slab, np.arange(len(self.heights)))  # the runs of slab k: slab_runs[k] .. slab_runs[k + 1]
        left, right = self.at(self.edge, low[order]), self.at(self.edge, high[order])
        run = np.cumsum(new) - 1
        wrong = np.zeros(len(order), bool)
        wrong[1:] = ~new[1:] & ((left[1:] < left[:-1]) | (right[1:] < right[:-1]))
        self.crossed = np.bincount(run, wrong, len(self.start)) > 0
        self.run_min = np.minimum.reduceat(np.minimum(left, right), self.start) if len(order) else left
        self.run_max = np.maximum.reduceat(np.maximum(left, right), self.start) if len(order) else left

    def at(self, edge: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Where the edge is at height y."""
        return self.x1[edge] + (self.x2[edge] - self.x1[edge]) * (y - self.y1[edge]) / (self.y2[edge] - self.y1[edge])

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, region) for each region that contains the point.

        Points are taken by so many that the lists of candidate regions, and of crossed edges, stay below MOST_CELLS.
        """
        slab = np.searchsorted(self.heights, y, "right") - 1
        inside = np.flatnonzero((slab >= 0) & (slab < len(self.heights) - 1))
        load = np.cumsum(self.slab_runs[slab[inside] + 1] - self.slab_runs[slab[inside]]) // MOST_CELLS
        found = [self._locate_some(part, slab[part], x, y) for part in np.split(inside, np.flatnonzero(np.diff(load)) + 1)] if len(inside) else []
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _locate_some(self, inside: np.ndarray, slab: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, stop = self.slab_runs[slab], self.slab_runs[slab + 1]
        point, run = _ranges(inside, begin, stop - begin)
        keep = (self.run_min[run] - 1e-9 <= x[point]) & (x[point] <= self.run_max[run] + 1e-9)
        point, run = point[keep], run[keep]
        lo, hi = self.start[run].copy(), self.end[run].copy()
        px, py = x[point], y[point]
        while (open_ := lo < hi).any():  # the first edge to the right of the point
            mid = (lo + hi) // 2
            right = np.zeros(len(lo), bool)
            right[open_] = px[open_] < self.at(self.edge[mid[open_]], py[open_])
            hi = np.where(open_ & right, mid, hi)
            lo = np.where(open_ & ~right, mid + 1, lo)
        crossings = self.end[run] - lo
        crossed = np.flatnonzero(self.crossed[run])
        load = np.cumsum(self.end[run[crossed]] - self.start[run[crossed]]) // MOST_CELLS
        for part in np.split(crossed, np.flatnonzero(np.diff(load)) + 1) if len(crossed) else []:
            which, at = _ranges(part, self.start[run[part]], self.end[run[part]] - self.start[run[part]])
            crossings[part] = 0
            np.add.at(crossings, which, (px[which] < self.at(self.edge[at], py[which])).astype(int))
        odd = crossings % 2 == 1
        return point[odd], self.run_region[run[odd]]


#: How many (point, region) or (point, edge) candidates are held at a time.
MOST_CELLS = 2_000_000


def _ranges(owner: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index) for each index from begin to begin + n of each owner."""
    return np.repeat(owner, n), np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _locate_in(strip: float):
    """For a tile: its points in the regions whose edges came along."""

    def run(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(edges):
            return pd.DataFrame({"key_a": pd.Series(dtype="int64"), "key_b": pd.Series(dtype="int64")})
        low = float(edges["strip"].iloc[0]) * strip
        slabs = Slabs(*(edges[c].to_numpy() for c in ("region", "x1", "y1", "x2", "y2")), low=low - 1e-9, high=low + strip + 1e-9)
        at, region = slabs.locate(points["x"].to_numpy(), points["y"].to_numpy())
        return pd.DataFrame({"key_a": points["key"].to_numpy()[at], "key_b": region})

    return run


def containing_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, rings: str, strip: float = 0.25, tile: float = 2.0) -> DataFrame:
    """(key_a, key_b): each point with each region that it lies in (inside an odd number of the region's rings).

    Edges are straight in longitude and latitude. Both sides are dealt to strips of `strip` degrees of latitude and tiles of
    `tile` degrees of longitude; in a strip a region's edges go to those tiles only that the region touches there, so edges
    round the globe don't meet. Tiles with many points are salted. In a task, the edges become a trapezoidal decomposition of
    the strip (Slabs) and each point is located by binary search among the edges of its slab. Rows without usable
    coordinates take no part; a region without rings contains nothing. Keys must be integers.
    """
    p = points.where(usable_point(F.col(lat), F.col(lon))).select(
        F.col(key).cast("bigint").alias("key"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"),
        F.floor(F.col(lat) / strip).cast("int").alias("strip"), F.floor(F.col(lon) / tile).cast("int").alias("tile"))
    e = ring_edges(regions, region, rings).withColumn("region", F.col("region").cast("bigint"))
    e = e.withColumn("strip", F.explode(F.sequence(F.floor((F.col("y1") - 1e-9) / strip).cast("int"), F.floor((F.col("y2") + 1e-9) / strip).cast("int"))))
    at = lambda x: F.floor(x / tile).cast("int")
    spans = e.groupBy("region", "strip").agg(at(F.min(F.least("x1", "x2")) - 1e-9).alias("west"), at(F.max(F.greatest("x1", "x2")) + 1e-9).alias("east"))
    e = e.join(spans, ["region", "strip"]).withColumn("tile", F.explode(F.sequence("west", "east"))).drop("west", "east")
    by = ["strip", "tile"]
    # only tiles that hold points and edges become groups, those with many points several
    both = cut(p.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(e.select(*by).distinct(), by, "left_semi").select(*by, F.ceil(F.col("_n") / 50_000).cast("int").alias("_salts")))
    p = p.join(both, by).withColumn("_salt", F.pmod(F.xxhash64("key"), F.col("_salts")).cast("int")).drop("_salts")
    e = e.join(both, by).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    by = [*by, "_salt"]
    return p.groupBy(*by).cogroup(e.groupBy(*by)).applyInPandas(_locate_in(strip), "key_a bigint, key_b bigint")


__all__ = ["EARTH_M", "Slabs", "containing_regions", "great_circle_m", "near_pairs", "ring_edges", "usable_point"]
