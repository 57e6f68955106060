"""Queries on texts: main bodies (p2), languages (p3), packing (p8), mixing (p9), one form (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdbook.llm.language import languages
from herdbook.llm.lookalike import one_form, same_looking_pairs
from herdbook.llm.mainbody import main_lines
from herdbook.llm.mixing import mix, mix_report
from herdbook.llm.packing import pack, space_left
from herdbook.llm.tokens import n_tokens
from herdbook.runtime import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = same_looking_pairs(table(spark, folder, "documents"), "doc_id", "text")
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p10_form(spark: SparkSession, folder: str) -> DataFrame:
    return one_form(table(spark, folder, "documents"), "doc_id", "text")


def p2_main(spark: SparkSession, folder: str) -> DataFrame:
    return main_lines(table(spark, folder, "site_pages"), "page_id", "website", "html")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_main(spark, folder).select("page_id", "line_no")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = p3_languages(spark, folder)
    return found.where(~F.col("seg_lang").eqNullSafe(F.col("label_lang"))).select("doc_id", "seg_no", "seg_lang")


def p3_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"), "doc_id", "text", "lang")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder), "doc_id", "n_tokens")


def p8_space(spark: SparkSession, folder: str) -> DataFrame:
    return space_left(p8_pack(spark, folder), "n_tokens")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(_sized(spark, folder), "doc_id", "source", "n_tokens", table(spark, folder, "mix_targets"), "target_share", "max_repeats")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(p9_mix(spark, folder), "source", "n_tokens", table(spark, folder, "mix_targets"), "target_share", "max_repeats")


QUERIES = {"p2_found": p2_found, "p2_main": p2_main, "p3_found": p3_found, "p3_languages": p3_languages, "p8_pack": p8_pack, "p8_space": p8_space, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_form": p10_form}
SQL: dict[str, str] = {}
