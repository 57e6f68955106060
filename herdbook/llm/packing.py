"""Filling fixed-capacity containers: best fit over several permitted capacities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdbook.runtime import cut, parts

#: Items that one task packs at a time; with thousands of items a part's last, half-full container doesn't count.
PART_ROWS = 8_192


def best_fit(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int]]:
    """(container of each item, capacity of each container) for sizes of 1 to the largest capacity.

    The largest item left opens a container. Of all permitted capacities the one at least cost is opened: the cost is the
    space that is left for certain, after the best-fitting set of the items still to come and after downsizing, by the
    container's content. That set is found exactly, by the sums that the histogram of remaining sizes can reach (one bit
    each), large sizes first, so small ones stay for later containers. Equal costs go to the larger capacity.
    """
    items: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        items.setdefault(sizes[i], []).append(i)
    order, top = sorted(items, reverse=True), capacities[-1]
    where, final = [-1] * len(sizes), []
    for at, size in enumerate(order):
        while items[size]:
            inside = [items[size].pop()]
            room = top - size
            full, sums, steps = (1 << room + 1) - 1, 1, []
            for x in order[at:]:
                n = min(len(items[x]), room // x)
                if not n:
                    continue
                steps.append((x, sums))
                copies = 1
                while n > 0:
                    sums |= (sums << x * min(copies, n)) & full
                    n, copies = n - copies, copies * 2
                if sums >> room & 1:
                    break  # the largest capacity can be filled to the brim: nothing costs less
            choices = []
            for cap in capacities:
                if cap >= size:
                    fill = (sums & (1 << cap - size + 1) - 1).bit_length() - 1
                    small = next(c for c in capacities if c >= size + fill)
                    choices.append(((small - size - fill) / (size + fill), -cap, small, fill))
            _, _, cap, fill = min(choices)
            for x, before in reversed(steps):
                while not before >> fill & 1:
                    inside.append(items[x].pop())
                    fill -= x
            for i in inside:
                where[i] = len(final)
            final.append(cap)
    return where, final


def pack(sized: DataFrame, key: str, size: str, capacities: tuple[int, ...] = (256, 512, 1024, 2048), part_rows: int = PART_ROWS) -> DataFrame:
    """(key, piece_no, start, size, container, capacity, place): where each item, or piece of one, lies.

    An item larger than the largest capacity is split into pieces of that capacity and a rest; no other is. Items go to
    parts of about part_rows by a hash of their key, so equal sizes, hot sources and copies spread; each part is packed by
    best_fit: all capacities are weighed jointly, the least-cost one is opened and downsized to its contents.
    Items of size 0 or null have one row with a null container. `container` is unique over all parts. An empty table gives
    none. Ties in size are packed in the order of keys, so that the result is the same on every run.
    """
    caps = sorted(capacities)
    top = caps[-1]
    items = cut(sized.select(F.col(key).cast("bigint").alias("_k"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_n")))
    n = parts(items.count(), part_rows)
    nothing = items.where("_n <= 0").select(F.col("_k").alias(key), F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias(size), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("place"))
    pieces = items.where("_n > 0").select("_k", "_n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / top).cast("int") - 1)).alias("piece_no"))
    pieces = pieces.select("_k", "piece_no", (F.col("piece_no").cast("bigint") * top).alias("start"), F.least(F.lit(top), F.col("_n") - F.col("piece_no") * F.lit(top)).cast("bigint").alias("_n"), F.pmod(F.xxhash64("_k", "piece_no"), F.lit(n)).cast("int").alias("_part"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_n", "_k", "piece_no"], ascending=[False, True, True])
        where, final = best_fit(part["_n"].tolist(), caps)
        placed = part.assign(container=[int(part["_part"].iloc[0]) * 2**40 + w for w in where], capacity=[final[w] for w in where])
        placed["place"] = placed.groupby("container")["_n"].cumsum() - placed["_n"]
        return placed[["_k", "piece_no", "start", "_n", "container", "capacity", "place"]]

    packed = pieces.groupBy("_part").applyInPandas(run, "_k bigint, piece_no int, start bigint, _n bigint, container bigint, capacity int, place int")
    return packed.withColumnsRenamed({"_k": key, "_n": size}).unionByName(nothing)


def space_left(packed: DataFrame, size: str) -> DataFrame:
    """(capacity, containers, tokens, space, share_left) for each capacity: what the packing leaves unused."""
    each = packed.where("container IS NOT NULL").groupBy("container").agg(F.max("capacity").alias("capacity"), F.sum(size).alias("tokens"))
    out = each.groupBy("capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("space", F.col("containers") * F.col("capacity") - F.col("tokens")).withColumn("share_left", F.col("space") / (F.col("containers") * F.col("capacity")))
