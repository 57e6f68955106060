"""Clusters of points or records: connected components, and merging the rows of a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdbook.operators.points import near_pairs
from herdbook.runtime import cut, forget


def components(nodes: DataFrame, edges: DataFrame, key: str, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(key, cluster): each node with the smallest key of its connected component; nodes without edges are their own.

    Large-star and small-star steps by turns: the number of rounds grows with the logarithm of a chain's length. Each round
    is checkpointed and the one before removed; only a count comes to the driver. Stars are aggregated by minimum, never collected.
    """
    e = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v")
        down = large.where("u <> v").distinct()
        # small star: each node's smaller neighbours and itself point to the smallest of them
        low = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(low, "v")
        new = cut(small.select(F.col("m").alias("x"), F.col("u").alias("y")).where("x <> y").unionByName(low.select(F.col("m").alias("x"), F.col("v").alias("y"))).distinct().select(F.col("x").alias("u"), F.col("y").alias("v")))
        # done once every node has one edge, to a root that hangs from no other
        roots = new.select(F.col("u").alias("v")).distinct()
        open_ = new.join(roots, "v", "left_semi").limit(1).count() or new.groupBy("v").count().where("count > 1").limit(1).count()
        forget(e)
        e = new
        if not open_:
            return nodes.select(key).join(e.groupBy(F.col("v").alias(key)).agg(F.min("u").alias("cluster")), key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def near_clusters(points: DataFrame, key: str, lat: str, lon: str, radius_m: float = 50.0) -> DataFrame:
    """(key, cluster): points chained by steps of at most radius_m; rows without coordinates are their own cluster."""
    return components(points, near_pairs(points, key, lat, lon, radius_m), key, "key_a", "key_b")


def merge_clusters(df: DataFrame, cluster: str, order: str, preferred, columns: list[str], joined: str) -> DataFrame:
    """One row for each cluster: of each column the first value that isn't null by `order`, preferred rows (a condition) first;
    `joined` holds the distinct values in order, n the number of rows. Minima and sets only, combined before the shuffle."""
    rank = lambda c: F.struct((~F.coalesce(preferred, F.lit(False))).alias("a"), F.col(order).alias("b"))
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), rank(c))).alias(c) for c in columns]
    return df.groupBy(cluster).agg(*aggs, F.nullif(F.array_join(F.array_sort(F.collect_set(joined)), ", "), F.lit("")).alias(joined), F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """The rows in clusters of more than one, with their cluster."""
    many = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    return df.join(clusters.join(many, "cluster", "left_semi"), key)
