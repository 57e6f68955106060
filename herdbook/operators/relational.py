"""Relational operators: alignment, keep-first, null-safe splits, lookups, page stop rules, running caps, checks."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdbook.functions.text import safe_name
from herdbook.runtime import cut, hot_keys, salt_all, salt_one


def align(df: DataFrame, target: list[str], cutoff: float = 0.85) -> DataFrame:
    """df with the target's columns: each source column goes to the closest target name; the last of several wins, missing ones are ''.

    Only names are compared, on the driver: lower case, letters and digits only, difflib's closeness of at least `cutoff`.
    """
    plain = lambda c: re.sub("[^a-z0-9]", "", c.lower())
    by = {plain(t): t for t in target}
    to: dict[str, str] = {}
    for c in df.columns:
        close = difflib.get_close_matches(plain(c), list(by), n=1, cutoff=cutoff)
        if close:
            to[by[close[0]]] = c
    return df.select(*(F.col(f"`{to[t]}`").alias(t) if t in to else F.lit("").alias(t) for t in target))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; null keys count as equal. One aggregate, combined before the shuffle."""
    cols = df.columns
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(first).select(*(F.col("_r")[c].alias(c) for c in cols))


def is_not(x: Column, value: object) -> Column:
    """True unless x is the value; true for null."""
    return ~x.eqNullSafe(F.lit(value))


def split_by(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which the test is true, all others, those of unknown outcome included)."""
    t = F.coalesce(test, F.lit(False))
    return df.where(t), df.where(~t)


def fill_from(df: DataFrame, lookup: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """df with missing fields taken from the lookup. fields: name -> 'null' (only where null), 'empty' (also where empty) or 'always'."""
    found = lookup.select(F.col(key), *(F.col(f).alias(f"_l_{f}") for f in fields))
    out = df.join(found, key, "left")
    for f, mode in fields.items():
        old, new = F.col(f), F.col(f"_l_{f}")
        if mode == "always":
            out = out.withColumn(f, new)
        elif mode == "empty":
            empty = F.size(old) <= 0 if dict(df.dtypes)[f].startswith("array") else F.coalesce(old, F.lit("")) == ""
            out = out.withColumn(f, F.when(F.coalesce(empty, F.lit(True)), new).otherwise(old))
        else:
            out = out.withColumn(f, F.coalesce(old, new))
    return out.drop(*(f"_l_{f}" for f in fields))


def update_first(df: DataFrame, updates: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """df with `fields` replaced from `updates` in the first row of each key by `order`; later rows of a key stay as they are."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    new = first.join(updates.select(key, *(F.col(f).alias(f"_u_{f}") for f in fields)), key).drop(key)
    out = df.join(new, order, "left")
    return out.select(*(F.coalesce(f"_u_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among those done: what a resumed run still has to do."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """An inner join whose hot keys, by the left side's counts, are spread over several tasks by a hash of `spread`."""
    hot = hot_keys(left, keys)
    return salt_one(left, hot, keys, F.col(spread)).join(salt_all(right, hot, keys), [*keys, "_salt"]).drop("_salt")


def population_radius(population: Column) -> Column:
    """The search radius in metres for a place of some population, 10,000 to 80,000."""
    steps = [(20_000, 15_000), (100_000, 25_000), (300_000, 35_000), (1_000_000, 50_000)]
    r = F.when(population.isNull() | (population <= 0), 20_000)
    for below, metres in steps:
        r = r.when(population < below, metres)
    return F.least(F.lit(80_000), F.greatest(F.lit(10_000), r.otherwise(65_000)))


def pages_to_fetch(items: DataFrame, tile: str, page: str, item: str, full: int = 20, same: float = 0.8) -> DataFrame:
    """(tile, n1, n2, repeated, pages): how many result pages of a tile a search would fetch, 1 to 3.

    One if the first page isn't full or is the last; two if the second isn't full or is the last, or more than `same` of its
    items (repeats counted each) are on the first page too; else three. Items of the first page are joined, not collected.
    """
    n = lambda p: F.count(F.when(F.col(page) == p, 1)).alias(f"n{p}")
    counts = items.groupBy(tile).agg(n(1), n(2), n(3))
    one = items.where(F.col(page) == 1).select(tile, item).distinct()
    rep = items.where(F.col(page) == 2).join(one, [tile, item], "left_semi").groupBy(tile).agg(F.count(F.lit(1)).alias("repeated"))
    out = counts.join(rep, tile, "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    stop2 = (F.col("n2") < full) | (F.col("n3") == 0) | (F.col("repeated") > same * F.col("n2"))
    return out.withColumn("pages", F.when((F.col("n1") < full) | (F.col("n2") == 0), 1).when(stop2, 2).otherwise(3)).select(tile, "n1", "n2", "repeated", "pages")


def _in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df, written once, with `_b`, the number of its range of the order, and rows of a range in one partition."""
    return cut(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))


def within_cap(df: DataFrame, order: str, amount: Column, cap: float) -> DataFrame:
    """The rows up to which the running sum of `amount` by `order` stays within the cap, with that sum as `running`.

    The sum isn't taken in one task: rows are dealt to ranges of the order, ranges are summed, and only their sums, one row a
    partition, are accumulated in one place. `order` must be unique.
    """
    rows = _in_ranges(df.withColumn("_a", amount), [order])
    sums = rows.groupBy("_b").agg(F.sum("_a").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    run = rows.join(F.broadcast(sums), "_b").withColumn("running", F.col("_before") + F.sum("_a").over(W.partitionBy("_b").orderBy(order)))
    return run.where(F.col("running") <= cap).drop("_b", "_a", "_before")


def row_numbers(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """df with each row's place in the whole order, from 0; counted by ranges, so that no task orders all rows."""
    rows = _in_ranges(df, order)
    before = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1).drop("_b", "_before")


def value_counts(df: DataFrame, column: str, domain: list[str] | None = None) -> DataFrame:
    """(value, n, percent): counts with nulls; with a domain exactly its values, 0 where there are none."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if domain is not None:
        counts = df.sparkSession.createDataFrame([(d,) for d in domain], "value string").join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.floor(F.col("n") * 100.0 / F.col("_t") * 100 + 0.5) / 100).alias("percent"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, least, most, mean, filled) of each column, in one pass."""
    aggs = [f(c).alias(f"{c}|{n}") for c in columns for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg), ("filled", F.count))]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("name"), *(F.col(f"`{c}|{n}`").cast("double").alias(n) for n in ("least", "most", "mean")), F.col(f"`{c}|filled`").alias("filled")) for c in columns]
    return one.select(F.inline(F.array(*parts)))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with nulls of the columns replaced by the column's mean."""
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(means))
    return out.select(*(F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def check_total(parts: DataFrame, amount: str, whole: DataFrame) -> DataFrame:
    """parts, with an error at run time if the sum of `amount` isn't the number of rows of `whole`."""
    both = parts.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_a")).crossJoin(whole.agg(F.count(F.lit(1)).alias("_n")))
    good = both.select(F.when(F.col("_a") == F.col("_n"), True).otherwise(F.raise_error(F.lit("rows were lost or doubled")).cast("boolean")).alias("_ok"))
    return parts.crossJoin(F.broadcast(good)).where("_ok").drop("_ok")


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with `batch`, the number of its batch of `size` rows in the order."""
    return row_numbers(df, order, "_no").withColumn("batch", F.floor(F.col("_no") / size)).drop("_no")


def all_null(*names: str) -> Column:
    """True if all of the columns are null."""
    return F.coalesce(*(F.col(n).cast("string") for n in names)).isNull()


def inner_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of both sides with one key; of columns that both have, the left one's stay."""
    return left.join(right.select(key, *(c for c in right.columns if c not in left.columns)), key)


def text_of(df: DataFrame, name: Column, stored: DataFrame, stored_name: Column, text: str) -> DataFrame:
    """df with `text` of the stored text whose sanitised name is the row's; null where there is none, the least of several."""
    found = stored.groupBy(safe_name(stored_name).alias("_f")).agg(F.min(text).alias(text))
    return df.withColumn("_f", safe_name(name)).join(found, "_f", "left").drop("_f")


def rounded(x: Column, digits: int = 2) -> Column:
    """x rounded half up, the same in any engine: floor(x 10^d + 0.5) / 10^d."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def to_number(x: Column, kind: str = "double") -> Column:
    """x as a number, null where it is none."""
    return x.try_cast(kind)
