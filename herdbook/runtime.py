"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one join or group key that one task should get; keys with more are salted.
HOT_ROWS = 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder, with its lineage cut.

    The folder is the one named in spark.checkpoint.dir. Only in local mode (tests, a laptop) a temporary one is made where
    none is set; on a cluster that would lose data with its machine, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir isn't set: name a shared folder")
            named = tempfile.mkdtemp(prefix="herdbook-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Removes the files of a DataFrame that cut() gave; for loops, once nothing reads it any more."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD" or plan.rdd().getCheckpointFile().isEmpty():
        return
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than `rows` rows, and the number of salts (`salts`) each needs.

    At most count(df) / rows keys come out; the count is combined before the shuffle.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias("salts"))
    )


def salt_one(df: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """df with a column `_salt`: rows of hot keys are spread by a hash of `by`, others get 0."""
    spread = F.pmod(F.xxhash64(by), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    return df.join(hot, keys, "left").withColumn("_salt", spread).drop("salts")


def salt_all(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """df with each row of a hot key repeated for all its salts: the other side of salt_one."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    return df.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("salts")


def salt_both(a: DataFrame, b: DataFrame, keys: list[str], by_a: Column, by_b: Column, rows: int = HOT_ROWS, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a column `_salt`, so that no task gets more than about `rows` rows of a key from either side.

    A key with m parts on one side and n on the other has m x n salts: each row stands in one part of its own side, with
    every part of the other. With `few`, the table of hot keys, at most count / rows of either side, is made once and
    broadcast, so that the sides aren't shuffled for it.
    """
    hot = hot_keys(a, keys, rows).withColumnRenamed("salts", "_sa").join(hot_keys(b, keys, rows).withColumnRenamed("salts", "_sb"), keys, "full")
    hot = hot.select(*keys, F.coalesce("_sa", F.lit(1)).alias("_sa"), F.coalesce("_sb", F.lit(1)).alias("_sb"))
    hot = F.broadcast(cut(hot)) if few else hot
    one = F.lit(1)

    def side(df: DataFrame, by: Column, mine: str, other: str, salt) -> DataFrame:
        n, m = F.coalesce(F.col(mine), one), F.coalesce(F.col(other), one)
        own = F.pmod(F.xxhash64(by), n)
        return df.join(hot, keys, "left").withColumn("_salt", F.explode(F.transform(F.sequence(F.lit(0), m - 1), lambda o: salt(own, o, n, m).cast("int")))).drop("_sa", "_sb")

    return side(a, by_a, "_sa", "_sb", lambda own, o, n, m: own * m + o), side(b, by_b, "_sb", "_sa", lambda own, o, n, m: o * n + own)


def parts(rows: int, each: int) -> int:
    """The number of parts of about `each` rows."""
    return max(1, math.ceil(rows / each))
