"""Reading tables, directories of tables, map elements and stored search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, nodes array<struct<lat:double,lon:double>>"


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line feeds unless `multi_line` is off, which lets one file be split."""
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV file's header."""
    return spark.read.option("header", True).csv(path).columns


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def csv_files(spark: SparkSession, paths: list[str], target: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """(the files' rows aligned to `target`, in one table; path -> what was wrong with those left out)."""
    from herdbook.operators.relational import align

    out, failed = None, {}
    for i, p in enumerate(paths):
        try:
            one = align(csv(spark, p), target).select(*(F.nullif(F.col(t).cast("string"), F.lit("")).alias(t) for t in target), F.lit(i).alias("file_no"))
        except Exception as e:  # one bad file doesn't stop the rest
            failed[p] = str(e)[:200]
            continue
        out = one if out is None else out.unionByName(one)
    return out, failed


def discover(spark: SparkSession, root: str, pattern: str = "???_VP_OSM.csv") -> DataFrame:
    """All CSV rows below root in files of that name, with `path` and `iso` (the name's first three letters)."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    return df.withColumn("path", F.input_file_name()).withColumn("iso", F.regexp_extract("path", r"([^/]{3})[^/]*$", 1))


def places_of(elements: DataFrame, amenity: str = "veterinary") -> DataFrame:
    """(osm_id, name, address, latitude, longitude, website) of the map elements of an amenity.

    Nodes have their own coordinates, elements with a centre that; a way otherwise has the sum of its located nodes over the
    number of all its nodes; a relation without a centre has none.
    """
    tag = lambda k: F.col("tags")[k]
    total = lambda f: F.aggregate(F.coalesce("nodes", F.array().cast("array<struct<lat:double,lon:double>>")), F.lit(0.0), lambda a, n: a + F.coalesce(n[f], F.lit(0.0)))
    way = lambda f: F.when((F.col("type") == "way") & (F.size("nodes") > 0), total(f) / F.size("nodes"))
    address = F.nullif(F.concat_ws(", ", F.nullif(F.concat_ws(" ", tag("addr:street"), tag("addr:housenumber")), F.lit("")), F.nullif(F.concat_ws(" ", tag("addr:postcode"), tag("addr:city")), F.lit(""))), F.lit(""))
    return elements.where(tag("amenity") == amenity).select(
        F.concat_ws("/", "type", "id").alias("osm_id"), tag("name").alias("name"), address.alias("address"),
        F.coalesce("center.lat", "lat", way("lat")).alias("latitude"), F.coalesce("center.lon", "lon", way("lon")).alias("longitude"),
        F.coalesce(F.nullif(tag("website"), F.lit("")), tag("contact:website")).alias("website"))


def geocoded(df: DataFrame, query: str, tables: list[DataFrame]) -> DataFrame:
    """df with latitude and longitude filled from lookup tables (query, lat, lon), the first that knows the query first."""
    out = df
    for i, t in enumerate(tables):
        out = out.join(t.groupBy(F.col("query").alias(f"_q{i}")).agg(F.min(F.struct("lat", "lon")).alias(f"_g{i}")), F.col(query) == F.col(f"_q{i}"), "left")
    pick = lambda f: F.coalesce(*(F.col(f"_g{i}.{f}") for i in range(len(tables))))
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return out.withColumns({"latitude": F.when(both, F.col("latitude")).otherwise(pick("lat")), "longitude": F.when(both, F.col("longitude")).otherwise(pick("lon"))}).select(*df.columns)


def reverse_geocoded(df: DataFrame, places: DataFrame, digits: int = 4) -> DataFrame:
    """df with missing or blank addresses composed from places (lat, lon, road, house_number, postcode, city, town, village, country)."""
    parts = F.concat_ws(", ", *(F.nullif(F.col(c), F.lit("")) for c in ("road", "house_number", "postcode")), F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("city", "town", "village"))), F.nullif(F.col("country"), F.lit("")))
    key = lambda lat, lon: [F.round(lat, digits), F.round(lon, digits)]
    found = places.select(*(c.alias(n) for c, n in zip(key("lat", "lon"), ("_a", "_b"))), parts.alias("_new")).groupBy("_a", "_b").agg(F.min("_new").alias("_new"))
    a, b = key("latitude", "longitude")
    out = df.join(found, (a == F.col("_a")) & (b == F.col("_b")), "left")
    missing = F.coalesce(F.trim("address"), F.lit("")) == ""
    return out.withColumn("address", F.when(missing, F.col("_new")).otherwise(F.col("address"))).select(*df.columns)


def first_result(df: DataFrame, results: DataFrame, query: str, keep) -> DataFrame:
    """df with `found`: the URL of the best-ranked stored search result (query, rank, url) that passes `keep`."""
    best = results.where(keep(F.col("url"))).groupBy(F.col("query").alias("_q")).agg(F.min_by("url", "rank").alias("found"))
    return df.join(best, F.col(query) == F.col("_q"), "left").drop("_q")


def texts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, text) of the texts that sinks.write_texts stored, each whole."""
    return spark.read.text(path, wholetext=True).select(name, F.regexp_replace("value", "\\n$", "").alias("text"))


class PagedSearch(DataSource):
    """Stored result pages of a place search as a stream of rows: files of JSON lines (tile, page, places), one partition a file.

    Options: path (a folder). An adapter for a live search would only replace read().
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "tile string, page int, place_id string, name string, latitude double, longitude double, status string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options.get("path", ""))


class _PagedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".jsonl")]

    def read(self, partition: InputPartition):
        import json

        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                page = json.loads(line)
                for p in page.get("places") or []:
                    at = p.get("location") or {}
                    yield page.get("tile"), page.get("page"), p.get("placeId"), (p.get("displayName") or {}).get("text"), at.get("latitude"), at.get("longitude"), p.get("businessStatus")
