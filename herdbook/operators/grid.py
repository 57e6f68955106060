"""Regular grids: tiling, assignment, sampling, neighbourhood weights, local autocorrelation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdbook.operators.points import EARTH_M, containing_regions, great_circle_m
from herdbook.runtime import cut

#: The ellipsoid GRS80 and the European equal-area projection (EPSG:3035).
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
LAEA_LAT, LAEA_LON, LAEA_X, LAEA_Y = 52.0, 10.0, 4_321_000.0, 3_210_000.0


#: Distinct values up to which a permutation test draws from all of them.
FEW_VALUES = 10_000


def _q(sin: Column | float, e: float):
    log, one = (F.log, F.lit(1.0)) if isinstance(sin, Column) else (math.log, 1.0)
    return (1 - e * e) * (sin / (1 - (sin * e) * (sin * e)) - log((one - sin * e) / (one + sin * e)) / (2 * e))


def to_laea(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of EPSG:3035 for degrees, in closed form."""
    e = math.sqrt(2 * GRS80_F - GRS80_F**2)
    qp, s0 = _q(1.0, e), math.sin(math.radians(LAEA_LAT))
    b0 = math.asin(_q(s0, e) / qp)
    rq = GRS80_A * math.sqrt(qp / 2)
    d = GRS80_A * (math.cos(math.radians(LAEA_LAT)) / math.sqrt(1 - e * e * s0 * s0)) / (rq * math.cos(b0))
    b = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _q(F.sin(F.radians(lat)), e) / qp)))
    dl = F.radians(lon - LAEA_LON)
    k = F.lit(rq) * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dl)))
    return k * d * F.cos(b) * F.sin(dl) + LAEA_X, k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dl)) + LAEA_Y


def from_laea(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees for metres of EPSG:3035."""
    e = math.sqrt(2 * GRS80_F - GRS80_F**2)
    qp, s0 = _q(1.0, e), math.sin(math.radians(LAEA_LAT))
    b0 = math.asin(_q(s0, e) / qp)
    rq = GRS80_A * math.sqrt(qp / 2)
    d = GRS80_A * (math.cos(math.radians(LAEA_LAT)) / math.sqrt(1 - e * e * s0 * s0)) / (rq * math.cos(b0))
    px, py = (x - LAEA_X) / d, (y - LAEA_Y) * d
    rho = F.greatest(F.sqrt(px * px + py * py), F.lit(1e-12))
    c = 2 * F.asin(rho / (2 * rq))
    b = F.asin(F.cos(c) * math.sin(b0) + py * F.sin(c) * math.cos(b0) / rho)
    e2 = e * e
    lat = b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * b) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * b) + 761 * e2**3 / 45360 * F.sin(6 * b)
    lon = F.atan2(px * F.sin(c), rho * math.cos(b0) * F.cos(c) - py * math.sin(b0) * F.sin(c))
    return F.degrees(lat), F.degrees(lon) + LAEA_LON


def bounds(regions: DataFrame, rings: str, by: list[str]) -> DataFrame:
    """The bounding box (x0, y0, x1, y1) of each group of regions."""
    p = regions.select(*by, F.explode(F.flatten(rings)).alias("q"))
    return p.groupBy(*by).agg(F.min("q.x").alias("x0"), F.min("q.y").alias("y0"), F.max("q.x").alias("x1"), F.max("q.y").alias("y1"))


def dissolved(regions: DataFrame, by: str, rings: str) -> DataFrame:
    """One row for each value of `by` with the rings of all its regions; a region's rings are few, a group's regions too."""
    return regions.groupBy(by).agg(F.flatten(F.collect_list(rings)).alias(rings))


def degree_tiles(boxes: DataFrame, step: float) -> DataFrame:
    """boxes exploded to tiles of `step` degrees: (i, j, south, west, north, east), the last ones cut at the box."""
    n = lambda a, b: F.greatest(F.lit(0), F.ceil((F.col(b) - F.col(a)) / step - 1e-9).cast("int") - 1)
    t = boxes.withColumn("i", F.explode(F.sequence(F.lit(0), n("x0", "x1")))).withColumn("j", F.explode(F.sequence(F.lit(0), n("y0", "y1"))))
    west, south = F.col("x0") + F.col("i") * step, F.col("y0") + F.col("j") * step
    return t.withColumns({"south": south, "west": west, "north": F.least(south + step, F.col("y1")), "east": F.least(west + step, F.col("x1"))})


def box_tiles(boxes: DataFrame, tile_km: float = 50, most: int = 5, small_km: float = 15) -> DataFrame:
    """boxes cut evenly: one tile if both sides are at most small_km, else 1 to `most` rows and columns of about tile_km.

    Width is taken at the middle latitude, height along the western edge.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    w = great_circle_m(mid, F.col("x0"), mid, F.col("x1")) / 1000
    h = great_circle_m(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x0")) / 1000
    count = lambda km: F.when((w <= small_km) & (h <= small_km), 1).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(km / tile_km)))).cast("int")
    t = boxes.withColumns({"n_rows": count(h), "n_cols": count(w)})
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    dx, dy = (F.col("x1") - F.col("x0")) / F.col("n_cols"), (F.col("y1") - F.col("y0")) / F.col("n_rows")
    return t.withColumns({"south": F.col("y0") + F.col("j") * dy, "west": F.col("x0") + F.col("i") * dx, "north": F.col("y0") + (F.col("j") + 1) * dy, "east": F.col("x0") + (F.col("i") + 1) * dx})


def covered_tiles(tiles: DataFrame, keys: list[str], regions: DataFrame, region: str, rings: str, least: float = 0.1, probes: int = 8) -> DataFrame:
    """The tiles of which at least a share lies in a region, by a lattice of probes x probes points, with that share."""
    ids = tiles.withColumn("_t", F.xxhash64(*keys))
    at = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * (F.col(k) + 0.5) / probes
    p = ids.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(probes - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))))
    p = p.select("_t", (F.col("a") * probes + F.col("b")).alias("k"), at("south", "north", "a").alias("lat"), at("west", "east", "b").alias("lon")).withColumn("_p", F.xxhash64("_t", "k"))
    hit = containing_regions(p, "_p", "lat", "lon", regions, region, rings).select(F.col("key_a").alias("_p")).distinct()
    share = p.join(hit, "_p", "left_semi").groupBy("_t").agg((F.count(F.lit(1)) / float(probes * probes)).alias("share"))
    return ids.join(share.where(F.col("share") >= least), "_t").drop("_t")


def points_in_region(regions: DataFrame, region: str, rings: str, spacing_km: float = 10) -> DataFrame:
    """(region, lat, lon): a lattice of points spacing_km apart inside each region, rounded to five digits.

    Rows are spacing_km apart along the meridian; in each row, points are spacing_km apart at the row's latitude.
    """
    step = math.degrees(spacing_km * 1000 / EARTH_M)
    box = bounds(regions, rings, [region])
    rows = box.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0")) / step).cast("int")))).withColumn("lat", F.col("y0") + F.col("j") * step)
    dx = F.lit(step) / F.greatest(F.lit(1e-6), F.cos(F.radians("lat")))
    p = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0")) / dx).cast("int")))).withColumn("lon", F.col("x0") + F.col("i") * dx)
    p = p.select(F.col(region).alias("_r"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")).withColumn("_p", F.xxhash64("_r", "lat", "lon"))
    hit = containing_regions(p, "_p", "lat", "lon", regions, region, rings)
    return p.join(hit.withColumnsRenamed({"key_a": "_p", "key_b": "_r"}), ["_p", "_r"]).select(F.col("_r").alias(region), "lat", "lon")


def assign_cells(points: DataFrame, x: Column, y: Column, x0: float, y0: float, size: float) -> DataFrame:
    """points with the cell (i, j) of a square grid in which they lie."""
    return points.withColumns({"i": F.floor((x - x0) / size).cast("int"), "j": F.floor((y - y0) / size).cast("int")})


def nearest_cells(points: DataFrame, key: str, cells: DataFrame) -> DataFrame:
    """(key, i, j): for points with their own (i, j), the existing cell nearest by index, however far; ties go to the smaller (i, j)."""
    return nearest_occupied(points, key, "i", "j", cells, 0.0)


def nearest_occupied(points: DataFrame, key: str, x: str, y: str, cells: DataFrame, width: float = 1.0) -> DataFrame:
    """(key, i, j): the nearest cell of each point, however far; distance 0 inside it, ties go to the smaller (i, j).

    x, y count in cells; cell (i, j) is the square from there of that width. Points in a cell get it by an equi-join. The
    others look at the nine blocks around them, blocks doubling in side from round to round, until the nearest cell found is
    nearer than what the blocks don't cover: so every answer is exact, and the rounds are the logarithm of the farthest
    distance. Points without coordinates, and all points if there are no cells, have null.
    """
    have = cells.select("i", "j").distinct()
    p = points.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    at = p.withColumns({"i": F.floor("_x").cast("int"), "j": F.floor("_y").cast("int")})
    out = cut(at.join(have, ["i", "j"], "left_semi").select("_k", "i", "j"))
    rest = cut(at.where("_x IS NOT NULL AND _y IS NOT NULL").join(have, ["i", "j"], "left_anti").select("_k", "_x", "_y"))
    side, any_ = 1, bool(have.limit(1).count())
    while any_ and rest.limit(1).count():
        block = lambda c: F.floor(F.col(c) / side)
        blocks = have.withColumns({"_bi": block("i"), "_bj": block("j")})
        look = rest.withColumn("_bi", F.explode(F.sequence(block("_x") - 1, block("_x") + 1))).withColumn("_bj", F.explode(F.sequence(block("_y") - 1, block("_y") + 1)))
        off = lambda c, v: F.greatest(F.col(c) - F.col(v), F.col(v) - F.col(c) - width, F.lit(0.0))
        best = look.join(blocks, ["_bi", "_bj"]).groupBy("_k").agg(F.min(F.struct((F.pow(off("i", "_x"), 2) + F.pow(off("j", "_y"), 2)).alias("d"), "i", "j")).alias("b"))
        found = cut(best.where(F.col("b.d") < float(max(0.0, side - width)) ** 2).select("_k", "b.i", "b.j"))
        out = out.unionByName(found)
        rest = cut(rest.join(found.select("_k"), "_k", "left_anti"))
        side *= 2
    return p.select("_k").join(out, "_k", "left").withColumnRenamed("_k", key)


def cell_counts(cells: DataFrame, assigned: DataFrame, keys: list[str], name: str = "clinic_count") -> DataFrame:
    """cells with the number of rows assigned to each, 0 where there are none."""
    return cells.join(assigned.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def sample_raster(cells: DataFrame, x: Column, y: Column, pixels: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """cells with the value of each raster at (x, y), 0 where there is no pixel. pixels: (raster, row, col, value), row 0 at the top."""
    names = sorted(r["raster"] for r in pixels.select("raster").distinct().collect())
    wide = pixels.groupBy("row", "col").pivot("raster", names).agg(F.first("value"))
    at = cells.withColumns({"col": F.floor((x - x0) / size).cast("int"), "row": F.floor((F.lit(y0) - y) / size).cast("int")})
    return at.join(wide, ["row", "col"], "left").drop("row", "col").fillna(0, names)


def rasterize(cells: DataFrame, value: str, spark: SparkSession, width: int, height: int, empty: float) -> DataFrame:
    """(row, col, value) of the whole grid, row 0 at the top; `empty` where no cell (i, j) is."""
    full = spark.range(width * height).select((F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    burnt = cells.select((F.lit(height - 1) - F.col("j")).alias("row"), F.col("i").alias("col"), F.col(value).cast("double").alias("value"))
    return full.join(burnt, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(empty)))


def queen_weights(cells: DataFrame) -> DataFrame:
    """(i, j, ni, nj, w): each cell with its up to eight neighbours, weights of a cell summing to 1."""
    steps = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    e = cells.select("i", "j", F.explode(steps).alias("s")).select("i", "j", (F.col("i") + F.col("s.di")).alias("ni"), (F.col("j") + F.col("s.dj")).alias("nj"))
    e = e.join(cells.select(F.col("i").alias("ni"), F.col("j").alias("nj")), ["ni", "nj"])
    n = e.groupBy("i", "j").agg((1.0 / F.count(F.lit(1))).alias("w"))
    return e.join(n, ["i", "j"]).select("i", "j", "ni", "nj", "w")


def local_moran(cells: DataFrame, value: str) -> DataFrame:
    """cells with z (deviation from the mean), lag (the neighbours' mean deviation, 0 for islands), local_i = z lag / m2, and quadrant.

    Quadrants are by sign: High-High, Low-Low, High-Low, Low-High; None where either is 0.
    """
    stat = cells.agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    z = cells.crossJoin(F.broadcast(stat)).withColumn("z", F.col(value) - F.col("_m"))
    lag = queen_weights(cells).join(z.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("z").alias("nz")), ["ni", "nj"]).groupBy("i", "j").agg(F.sum(F.col("w") * F.col("nz")).alias("lag"))
    out = z.join(lag, ["i", "j"], "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))
    out = out.withColumn("local_i", F.when(F.col("_v") > 0, F.col("z") * F.col("lag") / F.col("_v")).otherwise(0.0)).drop("_m", "_v")
    up, lup = F.col("z") > 0, F.col("lag") > 0
    dn, ldn = F.col("z") < 0, F.col("lag") < 0
    return out.withColumn("quadrant", F.when(up & lup, "High-High").when(dn & ldn, "Low-Low").when(up & ldn, "High-Low").when(dn & lup, "Low-High").otherwise("None"))


def moran_significance(cells: DataFrame, value: str, permutations: int = 999, seed: int = 1, level: float = 0.05) -> DataFrame:
    """local_moran() with p_value and label: a conditional permutation test per cell, seeded by the cell.

    A cell's neighbours are replaced by draws from the values of all other cells: from their histogram, which counts have
    few values for, so no task sees more than its cells. Beyond FEW_VALUES distinct values, their FEW_VALUES quantiles stand
    for them, as many cells each. Labels are quadrants, 'Not significant' above `level`.
    """
    counts = cut(cells.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    if counts.count() <= FEW_VALUES:
        hist = sorted((float(r[0]), int(r[1])) for r in counts.collect())
    else:
        qs, all_ = cells.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit((i + 0.5) / FEW_VALUES) for i in range(FEW_VALUES))), 100 * FEW_VALUES), F.count(value)).first()
        hist = [(float(q), -(-all_ // FEW_VALUES)) for q in qs]
    v, n = np.array([h[0] for h in hist]), np.array([h[1] for h in hist])
    total = n.sum()
    mean = float((v * n).sum() / total) if total else 0.0
    ends = n.cumsum()  # the cells stand in order of their values: a value's end here
    lm = local_moran(cells, value)
    degree = queen_weights(cells).groupBy("i", "j").agg(F.count(F.lit(1)).alias("_k"))
    rows = lm.join(degree, ["i", "j"], "left").withColumn("_k", F.coalesce("_k", F.lit(0)))

    @F.pandas_udf("double")
    def p(i: pd.Series, j: pd.Series, z: pd.Series, lag: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for a, b, zz, l, kk in zip(i, j, z, lag, k):
            if not kk:
                out.append(1.0)
                continue
            rng = np.random.default_rng([seed, a & 0xFFFFFFFF, b & 0xFFFFFFFF])
            own = ends[min(len(v) - 1, int(np.searchsorted(v, zz + mean - 1e-9)))] - 1  # a place of the cell's own value
            drawn = rng.integers(0, max(1, total - 1), (permutations, int(kk)))
            draws = v[np.minimum(np.searchsorted(ends, drawn + (drawn >= own), "right"), len(v) - 1)].mean(1) - mean
            larger = int((draws * zz >= l * zz).sum())
            out.append((min(larger, permutations - larger) + 1.0) / (permutations + 1))
        return pd.Series(out, dtype=float)

    rows = rows.withColumn("p_value", p("i", "j", "z", "lag", "_k")).drop("_k")
    return rows.withColumn("label", F.when(F.col("p_value") > level, "Not significant").otherwise(F.col("quadrant")))


def _crossed(edges: DataFrame) -> DataFrame:
    """(code, i, j): the unit squares through whose inside an edge (u0, v0)-(u1, v1) runs; an edge along a border runs through none."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b)).cast("int"), F.floor(F.greatest(a, b)).cast("int"))
    e = edges.withColumn("i", F.explode(span("u0", "u1"))).withColumn("j", F.explode(span("v0", "v1")))

    def within(k: str, p: str, q: str) -> tuple[Column, Column]:  # the part of the edge, from 0 to 1, between k and k + 1; empty is (1, 0)
        d, lo, hi = F.col(q) - F.col(p), F.col(k) - F.col(p), F.col(k) + 1 - F.col(p)
        level, runs = (lo < 0) & (hi > 0), F.nullif(d, F.lit(0.0))
        return F.when(d != 0, F.least(lo / runs, hi / runs)).when(level, 0.0).otherwise(1.0), F.when(d != 0, F.greatest(lo / runs, hi / runs)).when(level, 1.0).otherwise(0.0)

    (a, b), (c, d) = within("i", "u0", "u1"), within("j", "v0", "v1")
    return e.where(F.greatest(F.lit(0.0), a, c) < F.least(F.lit(1.0), b, d)).select("code", "i", "j").distinct()


def touched_tiles(regions: DataFrame, code: str, region: str, rings: str, step: float) -> DataFrame:
    """degree_tiles of each code's bounding box that share some area with its regions, exactly: through those an edge runs, or,
    where none does, the tile's middle lies in a region."""
    tiles = degree_tiles(bounds(regions, rings, [code]), step)
    ring = regions.select(F.col(code).alias("code"), F.explode(rings).alias("q"))
    edge = ring.select("code", F.explode(F.transform("q", lambda p, i: F.struct(p.alias("p"), F.get("q", F.pmod(i + 1, F.size("q"))).alias("n")))).alias("e"))
    box = bounds(regions, rings, [code]).select(F.col(code).alias("code"), "x0", "y0")
    unit = lambda c, at: (F.col(c) - F.col(at)) / step
    crossed = _crossed(edge.join(box, "code").select("code", unit("e.p.x", "x0").alias("u0"), unit("e.p.y", "y0").alias("v0"), unit("e.n.x", "x0").alias("u1"), unit("e.n.y", "y0").alias("v1")))
    middle = tiles.select(F.col(code).alias("code"), "i", "j", F.xxhash64(code, "i", "j").alias("_p"), ((F.col("south") + F.col("north")) / 2).alias("lat"), ((F.col("west") + F.col("east")) / 2).alias("lon"))
    owners = regions.select(F.col(region).cast("bigint").alias("key_b"), F.col(code).alias("code"))
    inside = middle.join(containing_regions(middle, "_p", "lat", "lon", regions, region, rings).join(owners, "key_b").select(F.col("key_a").alias("_p"), "code"), ["_p", "code"], "left_semi").select("code", "i", "j")
    return tiles.join(crossed.unionByName(inside).distinct().withColumnRenamed("code", code), [code, "i", "j"], "left_semi")


def square_cells(regions: DataFrame, code: str, region: str, rings: str, size_m: float = 10_000, probes: int = 6) -> DataFrame:
    """(code, cell_id, i, j, x0, y0, share): the squares of a grid in EPSG:3035 that share some area with a country.

    Corners of regions are projected and edges are straight in the projection. A square is kept if an edge runs through its
    inside, or a probe lies inside a region; where no edge runs through, one probe decides for all. `share` is the share of
    probes x probes points that lie inside, 0 for a square met between the probes only.
    A country's grid starts at its own bounding box. Cells are numbered from 1 after clipping, by x and then y: 'CHE_1', ...
    """
    unit = 2e5  # metres to numbers in the range of degrees, as containing_regions wants them
    corners = regions.select(F.col(code).alias("code"), F.col(region).alias("_r"), F.posexplode(rings).alias("ring", "_q"))
    corners = corners.select("code", "_r", "ring", F.posexplode("_q").alias("at", "q"))
    px, py = to_laea(F.col("q.y"), F.col("q.x"))
    corners = cut(corners.select("code", "_r", "ring", "at", px.alias("px"), py.alias("py")))
    box = corners.groupBy("code").agg(F.min("px").alias("gx"), F.min("py").alias("gy"), F.max("px").alias("hx"), F.max("py").alias("hy"))
    n = lambda a, b: F.greatest(F.lit(0), F.ceil((F.col(b) - F.col(a)) / size_m).cast("int") - 1)
    c = box.withColumn("i", F.explode(F.sequence(F.lit(0), n("gx", "hx")))).withColumn("j", F.explode(F.sequence(F.lit(0), n("gy", "hy"))))
    c = c.select("code", "i", "j", (F.col("gx") + F.col("i") * size_m).alias("x0"), (F.col("gy") + F.col("j") * size_m).alias("y0"))
    own = W.partitionBy("_r", "ring")
    nxt = lambda x: F.coalesce(F.lead(x).over(own.orderBy("at")), F.first(x).over(own.orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    edges = corners.withColumns({"qx": nxt("px"), "qy": nxt("py")}).join(box, "code")
    edges = edges.select("code", *(((F.col(x) - F.col(g)) / size_m).alias(k) for k, x, g in (("u0", "px", "gx"), ("v0", "py", "gy"), ("u1", "qx", "gx"), ("v1", "qy", "gy"))))
    span = F.sequence(F.lit(0), F.lit(probes - 1))
    at = c.withColumn("a", F.explode(span)).withColumn("b", F.explode(span))
    at = at.select("code", "i", "j", ((F.col("y0") + (F.col("b") + 0.5) / probes * size_m) / unit).alias("lat"), ((F.col("x0") + (F.col("a") + 0.5) / probes * size_m) / unit).alias("lon"), F.xxhash64("code", "i", "j", "a", "b").alias("_p"))
    flat = corners.groupBy("code", "_r", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "px", "py"))), lambda q: F.struct((q.px / unit).alias("x"), (q.py / unit).alias("y"))).alias("one"))
    flat = cut(flat.groupBy("code", "_r").agg(F.collect_list("one").alias("rings")))
    hit = containing_regions(at, "_p", "lat", "lon", flat, "_r", "rings").join(flat.select(F.col("_r").alias("key_b"), "code"), "key_b").select(F.col("key_a").alias("_p"), "code").distinct()
    share = at.join(hit, ["_p", "code"], "left_semi").groupBy("code", "i", "j").agg((F.count(F.lit(1)) / float(probes * probes)).alias("share"))
    met = share.unionByName(_crossed(edges).withColumn("share", F.lit(0.0))).groupBy("code", "i", "j").agg(F.max("share").alias("share"))
    kept = c.join(met, ["code", "i", "j"])
    number = F.row_number().over(W.partitionBy("code").orderBy("i", "j"))
    return kept.withColumn("cell_id", F.concat_ws("_", "code", number)).select("code", "cell_id", "i", "j", "x0", "y0", "share")


def clip_raster(pixels: DataFrame, x: Column, y: Column, regions: DataFrame, region: str, rings: str) -> DataFrame:
    """The pixels other than 0 whose centre (x, y) lies in a region."""
    p = pixels.where(F.col("value") != 0).withColumn("_p", F.xxhash64("raster", "row", "col")).withColumns({"_lon": x, "_lat": y})
    inside = containing_regions(p, "_p", "_lat", "_lon", regions, region, rings).select(F.col("key_a").alias("_p")).distinct()
    return p.join(inside, "_p", "left_semi").drop("_p", "_lon", "_lat")


def raster_hints(pixels: DataFrame, pixel_size: float) -> DataFrame:
    """(raster, least, most, mean, about_5_arc_minutes, looks_log10) of each raster."""
    r = pixels.groupBy("raster").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))
    return r.withColumns({"about_5_arc_minutes": F.lit(abs(pixel_size - 0.08333) <= 0.001), "looks_log10": F.col("most") < 10})


def ring_area(ring: Column) -> Column:
    """The area of a ring in the square of its unit, by the shoelace formula; it may or may not repeat its first point."""
    nxt = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    return F.abs(F.aggregate(F.transform(ring, lambda q, i: q.x * nxt(i).y - nxt(i).x * q.y), F.lit(0.0), lambda a, v: a + v)) / 2
