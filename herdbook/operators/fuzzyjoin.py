"""Joins on similar text: best match, exclusion, exact with a fuzzy rest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdbook.functions.fuzzy import similar
from herdbook.runtime import cut, parts

#: Texts, and their letters, that one task gets of each side at once.
TILE_TEXTS = 40_000
TILE_LETTERS = 3_000_000
#: What parts words: the same characters as in Python's str.split().
BLANKS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _sorted(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, BLANKS), lambda w: w != "")), " ")


def similar_texts(lt: DataFrame, rt: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """(_lt, _rt, score): all pairs of distinct texts (words sorted) with a ratio of at least `percent`.

    With `best`, rt also has a key `_rk`, and only (_lt, _rk, score) of each left text's best right text come out, ties to
    the smaller key.

    Texts are dealt to classes of length, so wide that texts that reach the ratio are at most one class apart. A class is cut
    into tiles of bounded parts of either side, and a task compares the texts of a tile in memory (functions.fuzzy.similar).
    So every pair of a possible length is tested once, no pair is lost, and only texts are shuffled, never candidates: each
    goes to as many tiles as the other side has parts.
    """
    r = percent / 100
    step = math.log((2 - r) / r) + 1e-9
    kind = lambda c: F.floor(F.log(F.length(c).cast("double")) / step)
    lt, rt = cut(lt.select("_lt", kind("_lt").alias("_c"))), cut(rt.withColumn("_c", kind("_rt")))
    key = dict(rt.dtypes)["_rk"] if best else "int"
    of = lambda d, c: {x[0]: x[1:] for x in d.groupBy("_c").agg(F.count(F.lit(1)), F.sum(F.length(c))).collect()}
    n_l, n_r = of(lt, "_lt"), of(rt, "_rt")  # a row for each class: as many as the longest text's logarithm
    n_r = {c: [sum(x) for x in zip(*(n_r[k] for k in (c - 1, c, c + 1) if k in n_r))] for c in n_l if {c - 1, c, c + 1} & n_r.keys()}
    out = f"_lt string, _rk {key}, score double" if best else "_lt string, _rt string, score double"
    if not n_r:
        return lt.sparkSession.createDataFrame([], out)
    cuts = lambda n: max(parts(n[0], TILE_TEXTS), parts(n[1], TILE_LETTERS))
    rows, tiles = [], 0
    for c in sorted(n_r):
        rows.append((c, cuts(n_l[c]), cuts(n_r[c]), tiles))
        tiles += rows[-1][1] * rows[-1][2]
    plan = F.broadcast(lt.sparkSession.createDataFrame(rows, "_c bigint, _pl int, _pr int, _first bigint"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    l = lt.join(plan, "_c").withColumn("_o", every("_pr")).select((F.col("_first") + own("_lt", "_pl") * F.col("_pr") + F.col("_o")).alias("_tile"), F.lit(True).alias("_left"), F.col("_lt").alias("_t"), F.lit(0).cast(key).alias("_k"))
    near = rt.withColumn("_c", F.explode(F.array(*(F.col("_c") + d for d in (-1, 0, 1))))).join(plan, "_c").withColumn("_o", every("_pl"))
    near = near.select((F.col("_first") + F.col("_o") * F.col("_pr") + own("_rt", "_pr")).alias("_tile"), F.lit(False).alias("_left"), F.col("_rt").alias("_t"), (F.col("_rk") if best else F.lit(0).cast(key)).alias("_k"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        a, b = d[d["_left"]], d[~d["_left"]]
        x, y, k = a["_t"].to_numpy(object), b["_t"].to_numpy(object), b["_k"].to_numpy()
        got = [(i, j, s) for i, j, s in (pick(i, k[j], j, s) if best else (i, j, s) for i, j, s in similar(list(x), list(y), percent)) if len(i)]
        i, j, s = (np.concatenate(v) for v in zip(*got)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pd.DataFrame({"_lt": x[i], "_rk": k[j], "score": s} if best else {"_lt": x[i], "_rt": y[j], "score": s})

    def pick(i: np.ndarray, k: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((k, -s, i))
        first = by[np.append(True, np.diff(i[by]) != 0)] if len(by) else by
        return i[first], j[first], s[first]

    found = l.unionByName(near).repartition(min(3 * tiles, 10_000), "_tile").groupBy("_tile").applyInPandas(run, out)
    if not best:
        return found
    return found.groupBy("_lt").agg(F.max_by(F.struct("_rk", "score"), F.struct("score", -F.col("_rk"))).alias("w")).select("_lt", "w._rk", "w.score")


def _sides(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str) -> tuple[DataFrame, DataFrame]:
    l = left.select(F.col(left_key).alias("_lk"), _sorted(F.col(left_text)).alias("_lt")).where(F.col("_lt") != "")
    r = right.select(F.col(right_key).alias("_rk"), _sorted(F.col(right_text)).alias("_rt")).where(F.col("_rt") != "")
    return l, r


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, percent: int = 85) -> DataFrame:
    """(left_key, right_key, score): all pairs of rows whose texts have a token-sort ratio of at least `percent`; see similar_texts."""
    l, r = _sides(left, right, left_key, right_key, left_text, right_text)
    scored = similar_texts(l.select("_lt").distinct(), r.select("_rt").distinct(), percent)
    return scored.join(l, "_lt").join(r, "_rt").select(F.col("_lk").alias(left_key), F.col("_rk").alias(right_key), "score")


def best_of_each(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, percent: int) -> DataFrame:
    """(left_key, right_key, score): each left row's best right row, ties to the smaller key. Texts are compared once each, and
    of rows with one text only the first is a candidate, so frequent names don't multiply. Texts that both sides have need no search."""
    l, r = _sides(left, right, left_key, right_key, left_text, right_text)
    first = cut(r.groupBy("_rt").agg(F.min("_rk").alias("_rk")))
    texts = cut(l.select("_lt").distinct().join(first, F.col("_lt") == F.col("_rt"), "left"))
    same = texts.where("_rt IS NOT NULL").select("_lt", "_rk", F.lit(100.0).alias("score"))  # nothing is better
    best = same.unionByName(similar_texts(texts.where("_rt IS NULL").select("_lt"), first, percent, best=True))
    return l.join(best, "_lt").select(F.col("_lk").alias(left_key), F.col("_rk").alias(right_key), "score")


def best_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, percent: int = 85) -> DataFrame:
    """(left_key, right_key, score): what a greedy pass takes. Each left row, in order of its key, wants its best right row and
    gets it if it is free; there is no second choice."""
    want = best_of_each(left, right, left_key, right_key, left_text, right_text, percent)
    return want.groupBy(right_key).agg(F.min_by(F.struct(left_key, "score"), left_key).alias("w")).select(F.col(f"w.{left_key}").alias(left_key), right_key, F.col("w.score").alias("score"))


def union_of_match(left: DataFrame, right: DataFrame, pairs: DataFrame, left_key: str, right_key: str, fill: list[str]) -> DataFrame:
    """Matched right rows with nulls of `fill` taken from the left, then the unmatched rows of both sides."""
    got = pairs.select(left_key, right_key)
    l = left.select(left_key, *(F.col(f).alias(f"_l_{f}") for f in fill))
    matched = right.join(got, right_key).join(l, left_key).withColumns({f: F.coalesce(f, f"_l_{f}") for f in fill}).drop(left_key, *(f"_l_{f}" for f in fill))
    return matched.unionByName(left.join(got, left_key, "left_anti"), allowMissingColumns=True).unionByName(right.join(got, right_key, "left_anti"), allowMissingColumns=True)


def without_closed(df: DataFrame, closed: DataFrame, key: str, closed_key: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """df without rows that resemble a closed one by any rule (text column, closed text column, percent)."""
    for mine, theirs, percent in rules:
        hit = cut(best_of_each(df, closed, key, closed_key, mine, theirs, percent).select(key))
        df = df.join(hit, key, "left_anti")
    return df


def exact_else_fuzzy(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_text: str, right_text: str, percent: int = 90) -> DataFrame:
    """(left_key, right_key, score): the first right row with the same text, else the best of at least `percent`."""
    l = left.select(left_key, F.col(left_text).alias("_t"))
    exact = l.join(right.groupBy(F.col(right_text).alias("_t")).agg(F.min(right_key).alias(right_key)), "_t").select(left_key, right_key, F.lit(100.0).alias("score"))
    exact = cut(exact)
    rest = left.join(exact.select(left_key), left_key, "left_anti")
    return exact.unionByName(best_of_each(rest, right, left_key, right_key, left_text, right_text, percent))
