"""Writing tables: fixed decimals, routed and quarantined rows, safe replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdbook.operators.relational import split_by


def write_csv(df: DataFrame, path: str, decimals: int | None = None, append: bool = False) -> None:
    """df as CSV with a header; with `decimals`, floats have exactly so many digits after the point."""
    if decimals is not None:
        df = df.select(*(F.format_string(f"%.{decimals}f", F.col(c).cast("double")).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes))
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_routed(df: DataFrame, test: Column, yes: str, no: str) -> None:
    """Rows for which the test is true to one place, all others (also where it is null) to another."""
    a, b = split_by(df, test)
    a.write.mode("overwrite").parquet(yes)
    b.write.mode("overwrite").parquet(no)


def long_texts(df: DataFrame, text: str, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is longer than `most` characters, the rest)."""
    return split_by(df, F.length(text) > most)


def replace_table(df: DataFrame, path: str) -> None:
    """df written over the Parquet table it was read from: to a new folder first, which then takes the old one's place."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(old), True)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    fs.delete(p(old), True)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One folder `<name>=<value>` of text files for each key: every text (or JSON, or reply) can be found by its name."""
    df.where(F.col(name).isNotNull()).select(name, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(name).text(path)
