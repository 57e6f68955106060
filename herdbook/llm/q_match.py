"""Queries on entities: matching across sources (p4), best representative (p6), same address (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdbook.llm.addresses import same_address
from herdbook.llm.entities import Source, match
from herdbook.llm.survivor import PLACEHOLDERS, Field, golden_records, n_categories, plain_field, survivors
from herdbook.runtime import table

CATEGORIES = ["small animals", "large animals", "horses"]
PLAIN = ["name", "address", "plz", "ort", "email", "category"]


def _web_fields(spark: SparkSession, folder: str) -> list[Field]:
    n = n_categories(F.col("specialization"), table(spark, folder, "animal_keywords"), "category", "keyword_text", CATEGORIES)
    site = F.regexp_replace("website", r"^[\s ]+|[\s ]+$", "")
    host = F.regexp_extract(site, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:\s]*)", 1)
    return [
        Field("specialization", F.col("specialization"), F.lower(F.trim("specialization")), F.coalesce(n > 0, F.lit(False)), rank=n),
        Field("website", site, F.lower(F.regexp_replace(site, "/+$", "")), F.coalesce(F.contains(host, F.lit(".")), F.lit(False)), rank=F.lit(0)),
    ]


def _survivors(spark: SparkSession, folder: str, fields: list[Field], least_rows: int) -> DataFrame:
    return survivors(table(spark, folder, "practices_web"), "cluster_id", "web_id", "origin", table(spark, folder, "source_trust"), "trust", "updated_at", fields, least_rows=least_rows)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _survivors(spark, folder, _web_fields(spark, folder), 2)
    return found.select("cluster_id", "field_name", "web_id")


def p6_golden(spark: SparkSession, folder: str) -> DataFrame:
    found = _survivors(spark, folder, [*_web_fields(spark, folder), *map(plain_field, PLAIN)], 1)
    return golden_records(table(spark, folder, "practices_web"), found, "cluster_id", ["specialization", "website", *PLAIN])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = same_address(table(spark, folder, "address_records"), "address_id", "address", "plz", "ort")
    return pairs.select(F.col("key_a").alias("address_id_a"), F.col("key_b").alias("address_id_b"))


def p4_matches(spark: SparkSession, folder: str) -> DataFrame:
    return match(Source(table(spark, folder, "practices_google"), "google_id"), Source(table(spark, folder, "osm_places").where("osm_id IS NOT NULL"), "osm_key"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_matches(spark, folder).where("match").select(F.col("key_a").alias("google_id"), F.col("key_b").alias("osm_key"))


QUERIES = {"p4_found": p4_found, "p4_matches": p4_matches, "p7_found": p7_found, "p6_found": p6_found, "p6_golden": p6_golden}
_CLAIMS = """
w AS (SELECT w.*, t.trust AS known, coalesce(t.trust, -1) AS trust, count(*) OVER (PARTITION BY cluster_id) AS n,
                  ' ' || trim(regexp_replace(lower(specialization), '[^\\p{L}\\p{N}'']+', ' ', 'g')) || ' ' AS said,
                  regexp_replace(website, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g') AS site,
                  regexp_extract(regexp_replace(website, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'), '^(?i)https?://([^/?#@]*@)?([^/?#:\\s]*)', 2) AS host
           FROM practices_web w LEFT JOIN source_trust t USING (origin) WHERE cluster_id IS NOT NULL),
k AS (SELECT category, keyword_text AS kw FROM animal_keywords UNION SELECT DISTINCT category, category FROM animal_keywords),
s AS (SELECT web_id, count(DISTINCT k.category) AS c FROM w JOIN k ON contains(said, ' ' || trim(regexp_replace(lower(kw), '[^\\p{L}\\p{N}'']+', ' ', 'g')) || ' ') GROUP BY web_id)"""


def _golden_sql(rounds: int = 8) -> str:
    """Truth discovery in SQL: one group of CTEs a round; once no reliability moves, the later ones keep it."""
    plain = " UNION ALL ".join(f"""SELECT cluster_id AS g, '{f}' AS field, web_id AS id, {f} AS value, lower(regexp_replace(trim({f}), '\\s+', ' ', 'g')) AS same, coalesce(origin, '') AS o, known, 0 AS rank, trust, updated_at AS ts FROM w
      WHERE lower(regexp_replace({f}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')) NOT IN ({", ".join(f"'{x}'" for x in PLACEHOLDERS)})""" for f in PLAIN)
    head = f"""
WITH {_CLAIMS},
f AS (SELECT cluster_id AS g, 'specialization' AS field, web_id AS id, specialization AS value, lower(trim(specialization)) AS same, coalesce(origin, '') AS o, known, c AS rank, trust, updated_at AS ts FROM w JOIN s USING (web_id)
      UNION ALL SELECT cluster_id, 'website', web_id, site, lower(regexp_replace(site, '/+$', '')), coalesce(origin, ''), known, 0, trust, updated_at FROM w WHERE contains(host, '.')
      UNION ALL {plain}),
cl AS MATERIALIZED (SELECT g, field, same, o, max(rank) AS rank, any_value(known) AS known, max((trust, coalesce(ts, TIMESTAMP '0001-01-01'), -id, value)) AS best FROM f GROUP BY ALL),
sp AS MATERIALIZED (SELECT * FROM cl QUALIFY min(same) OVER (PARTITION BY g, field) <> max(same) OVER (PARTITION BY g, field)),
ar AS (SELECT o, field, count(*) AS argued FROM sp GROUP BY ALL),
r0 AS MATERIALIZED (SELECT o, field, coalesce(argued, 0) AS argued, count(*) - coalesce(argued, 0) AS sure, least(0.95::DOUBLE, greatest(0.3::DOUBLE, 0.3::DOUBLE + 0.6::DOUBLE * coalesce(any_value(known), 0) / greatest((SELECT max(trust) FROM source_trust), 1))) AS start, false AS done
       FROM cl LEFT JOIN ar USING (o, field) GROUP BY o, field, argued)"""
    ruled = "field IN ('specialization', 'website')"
    votes = "SELECT g, field, same, sum(-ln(1 - {0}.r)) AS support, max(rank) AS rank, max(best) AS best FROM {1} JOIN {0} USING (o, field) GROUP BY ALL"
    order = f"(CASE WHEN {ruled} THEN rank::DOUBLE ELSE round(support, 6) END, best)"
    steps = ["q0 AS MATERIALIZED (SELECT *, start AS r FROM r0)"]
    for i in range(rounds):
        steps += [f"v{i} AS ({votes.format(f'q{i}', 'sp')})", f"t{i} AS MATERIALIZED (SELECT g, field, arg_max(same, {order}) AS truth FROM v{i} GROUP BY ALL)",
                  f"h{i} AS (SELECT o, field, count(*) AS hit FROM sp JOIN t{i} USING (g, field) WHERE same = truth GROUP BY ALL)",
                  f"n{i} AS MATERIALIZED (SELECT q.*, round(least(0.98::DOUBLE, greatest(0.05::DOUBLE, (coalesce(hit, 0) + 0.5::DOUBLE * sure + 10 * start) / (argued + 0.5::DOUBLE * sure + 10))), 9) AS nr FROM q{i} q LEFT JOIN h{i} USING (o, field))",
                  f"q{i + 1} AS MATERIALIZED (SELECT o, field, argued, sure, start, done OR (SELECT max(CASE WHEN {ruled} THEN 0 ELSE abs(nr - r) END) FROM n{i}) < 1e-3 AS done, CASE WHEN done THEN r ELSE nr END AS r FROM n{i})"]
    last = f"z AS ({votes.format(f'q{rounds}', 'cl')}), y AS (SELECT g, field, arg_max(best[4], {order}) AS value FROM z GROUP BY ALL)"
    names = ["specialization", "website", *PLAIN]
    return head + ",\n" + ",\n".join([*steps, last]) + "\nSELECT g AS cluster_id, " + ", ".join(f"max(value) FILTER (WHERE field = '{n}') AS {n}" for n in names) + " FROM y GROUP BY g"


SQL = {
    "p6_found": f"""
WITH {_CLAIMS},
f AS (SELECT cluster_id, 'specialization' AS field_name, web_id, c, trust, updated_at FROM w JOIN s USING (web_id) WHERE n > 1
      UNION ALL SELECT cluster_id, 'website', web_id, 0, trust, updated_at FROM w WHERE n > 1 AND contains(host, '.'))
SELECT cluster_id, field_name, web_id FROM f
QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY c DESC, trust DESC, updated_at DESC NULLS LAST, web_id) = 1""",
    "p6_golden": _golden_sql(),
}
