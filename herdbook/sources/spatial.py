"""Spatial files: shapefiles, GeoPackages and ASCII grids as tables; cells and rasters stored as Parquet."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdbook.operators.grid import from_laea

RINGS = "array<array<struct<x:double,y:double>>>"
_FEATURES = f"path string, feature_no bigint, attributes map<string,string>, rings {RINGS}"


def shp_rings(data: bytes) -> Iterator[list[list[dict[str, float]]]]:
    """The rings of each record of a .shp file of polygons (plain, Z or M); a null shape has none."""
    at = 100
    while at + 12 <= len(data):
        length = struct.unpack_from(">i", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0]
        rings: list[list[dict[str, float]]] = []
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            rings = [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        elif kind != 0:
            raise ValueError(f"not a file of polygons: shape type {kind}")
        yield rings
        at += 8 + length


def dbf_rows(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """The rows of a .dbf file, values as text; '' becomes null by being left out."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= head and data[at] != 0x0D:
        fields.append((data[at:at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        at, row = head + i * width + 1, {}
        for name, size in fields:
            value = data[at:at + size].decode(encoding, "replace").strip(" \0")
            if value:
                row[name] = value
            at += size
        rows.append(row)
    return rows


def wkb_rings(data: bytes) -> list[list[dict[str, float]]]:
    """The rings of a polygon or multipolygon in well-known binary; a GeoPackage's header may stand before it."""
    if data[:2] == b"GP":
        data = data[8 + (0, 32, 48, 48, 64)[data[3] >> 1 & 7]:]

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] == 1 else ">"
        kind, n = struct.unpack_from(order + "2I", data, at + 1)
        dims, base, at = 2 + (kind % 10000 >= 1000) + (kind % 10000 >= 3000), kind % 1000, at + 9
        rings = []
        for _ in range(n):
            if base == 6:
                some, at = read(at)
                rings += some
            elif base == 3:
                m = struct.unpack_from(order + "I", data, at)[0]
                v = struct.unpack_from(f"{order}{m * dims}d", data, at + 4)
                rings.append([{"x": v[i], "y": v[i + 1]} for i in range(0, m * dims, dims)])
                at += 4 + 8 * m * dims
            else:
                raise ValueError(f"not a polygon: geometry type {kind}")
        return rings, at

    return read(0)[0]


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(path, feature_no, attributes, rings) of the polygons of shapefiles; .dbf files beside them give the attributes.

    A task reads a file whole (the format ends at 2 GB); any file system that Spark reads will do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{shp,dbf,SHP,DBF}").load(path)
    files = files.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("base"), F.lower(F.right("path", F.lit(3))).alias("kind"), "content")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(part["kind"], part["content"]))
        shapes = list(shp_rings(by["shp"])) if "shp" in by else []
        rows = dbf_rows(by["dbf"]) if "dbf" in by else []
        rows += [{}] * (len(shapes) - len(rows))
        return pd.DataFrame({"path": part["base"].iloc[0], "feature_no": range(len(shapes)), "attributes": rows[:len(shapes)], "rings": shapes})

    return files.groupBy("base").applyInPandas(run, _FEATURES)


def geopackage(spark: SparkSession, path: str, layer: str, geometry: str = "geom") -> DataFrame:
    """(path, feature_no, attributes, rings) of a polygon layer of GeoPackage files, each read whole by one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
                quote = lambda name: '"' + name.replace('"', '""') + '"'
                rows = con.execute(f"SELECT * FROM {quote(layer)}")
                names = [c[0] for c in rows.description]
                found = [dict(zip(names, r)) for r in rows]
                con.close()
                yield pd.DataFrame({"path": p, "feature_no": range(len(found)), "attributes": [{k: str(v) for k, v in r.items() if k != geometry and v is not None} for r in found],
                                    "rings": [wkb_rings(r[geometry]) if r[geometry] else [] for r in found]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gpkg").load(path).select("path", "content")
    return files.mapInPandas(run, _FEATURES)


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(raster, row, col, x, y, value) of ASCII grids (.asc): the pixels' centres and values, those without a value left out.

    Lines are split and numbered in the JVM, a file a task; a pixel is a row of the long table.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1).alias("raster"), "value")
    head = lambda k: F.regexp_extract("value", rf"(?im)^\s*{k}\s+(\S+)", 1)
    number = lambda k: head(k).try_cast("double")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^\s*[-+.\d]"))
    g = whole.select("raster", number("nrows").alias("n"), number("cellsize").alias("size"), F.coalesce(number("xllcorner"), number("xllcenter") - number("cellsize") / 2).alias("x0"),
                     F.coalesce(number("yllcorner"), number("yllcenter") - number("cellsize") / 2).alias("y0"), F.coalesce(number("nodata_value"), F.lit(-9999.0)).alias("none"), F.posexplode(lines).alias("row", "line"))
    p = g.select("raster", "n", "size", "x0", "y0", "none", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    value = F.col("v").try_cast("double")
    return p.select("raster", "row", "col", (F.col("x0") + (F.col("col") + 0.5) * F.col("size")).alias("x"), (F.col("y0") + (F.col("n") - F.col("row") - 0.5) * F.col("size")).alias("y"), value.alias("value"), "none").where("value <> none AND NOT isnan(value)").drop("none")


def raster(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """A long raster table stored as Parquet (raster, row, col, x, y, value), masked: without nulls, NaN and `nodata`."""
    keep = F.col("value").isNotNull() & ~F.isnan("value")
    return spark.read.parquet(path).where(keep if nodata is None else keep & (F.col("value") != nodata))


def write_cells(cells: DataFrame, path: str, x: str = "x0", y: str = "y0", size_m: float = 10_000) -> None:
    """Square cells in EPSG:3035 as Parquet in two reference systems: `<path>/laea` as they are, `<path>/degrees` with `rings` of
    their corners in longitude and latitude."""
    cells.write.mode("overwrite").parquet(f"{path}/laea")
    corner = lambda a, b: (lambda p: F.struct(p[1].alias("x"), p[0].alias("y")))(from_laea(F.col(x) + a * size_m, F.col(y) + b * size_m))
    cells.withColumn("rings", F.array(F.array(*(corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))))).drop(x, y).write.mode("overwrite").parquet(f"{path}/degrees")


def cells(spark: SparkSession, path: str, system: str = "laea") -> DataFrame:
    """Cells that write_cells stored, in one of its reference systems."""
    return spark.read.parquet(f"{path}/{system}")
