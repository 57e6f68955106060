"""Queries for the survey's plain filters, columns, lookups, links and batches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdbook.functions import html, text, url
from herdbook.operators import classify, fuzzyjoin, grid, relational
from herdbook.plans.survey import _HOST, _hits, _words
from herdbook.runtime import table

#: Frequent words of seven languages, for the vote of stop words; a parameter of the function.
STOP_WORDS = {
    "de": ["und", "der", "die", "das", "ist", "nicht", "mit", "für", "wir", "sie"], "fr": ["et", "les", "des", "est", "nous", "vous", "pour", "dans", "une", "avec"], "en": ["the", "and", "is", "of", "for", "with", "you", "are", "we", "this"],
    "it": ["il", "che", "di", "per", "con", "sono", "della", "gli", "una", "nostro"], "es": ["el", "los", "las", "para", "con", "una", "por", "del", "que", "su"], "nl": ["het", "een", "van", "voor", "met", "wij", "zijn", "uw", "niet", "op"], "uk": ["та", "для", "ми", "це", "на", "що", "ви", "не", "з", "до"],
}


def drop_any_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_google").dropna("any", subset=["name", "address", "latitude", "longitude"]).select("google_id")


def drop_all_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "osm_places").dropna("all", subset=["name", "address"]).select("osm_key")


def membership_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "osm_places").where(F.col("country_code").isin("CHE", "AUT") | (F.col("country_code") == "NLD")).select("osm_key", "country_code")


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "practices_google")
    return g.where((F.col("place_id") != "") & (F.col("name") != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("google_id", "place_id")


def _done(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def unprocessed_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_web").where(~_done(F.col("category")).isin("small animals", "horses") & F.col("website").isNotNull()).select("web_id")


def settlement_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "covariates").where(F.col("settlement") > 0).select("row_id", "settlement")


def not_rejected(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_google").where(_done(F.col("business_status")) != "closed_permanently").select("google_id", "business_status")


def all_fields_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_web").where(relational.all_null("email", "specialization", "latitude", "longitude")).select("web_id")


def missing_address(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "osm_places").where(text.null_if_blank(F.col("address")).isNull()).select("osm_key")


def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "practices_web")
    return w.select("web_id", F.lit("web").alias("source"), text.concat_key("name", "address").alias("combined"), F.concat_ws("/", "origin", "web_id").alias("full_id"),
                    text.falsy_coalesce(F.col("website"), F.col("email"), F.col("name")).alias("contact"), relational.to_number(F.col("plz")).alias("plz_number"))


def label_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_web").select("web_id", text.label_number(F.col("origin"), {"google": 1, "osm": 2, "register": 3}, 0).alias("origin_no"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("n_chars"), 2).alias("request"), text.image_tokens(F.col("n_chars") + 1000, F.lit(2000)).cast("bigint").alias("image"))


def grid_covariates_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "covariates")
    of = lambda year, *names: relational.keep_first(c.where(F.col("ref_year") == year).select("cell_id", "row_id", *names), ["cell_id"], ["row_id"])
    return relational.inner_merge(of(2020, "pop", "settlement").where("settlement > 0").drop("row_id"), of(2015, "pop", "ca").drop("row_id"), "cell_id")


def text_lookup(spark: SparkSession, d: str) -> DataFrame:
    w, pages = table(spark, d, "practices_web").select("web_id", "website"), table(spark, d, "site_pages").select("website", "url")
    return relational.text_of(w, url.host(F.col("website")), pages.select("website", F.col("url").alias("page")), F.lower("website"), "page").select("web_id", "page")


def keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "animal_keywords").groupBy("lang").agg(F.array_sort(F.collect_set("keyword_text")).alias("w"), F.count(F.lit(1)).alias("n"))
    return k.select("lang", F.array_join("w", "|").alias("words"), "n")


def sorted_values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "covariates").groupBy("cell_id").agg(F.array_sort(F.collect_set("ref_year")).alias("y"))  # a year is one of few
    return c.select("cell_id", F.array_join(F.transform("y", lambda y: y.cast("string")), ",").alias("years"))


def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "practices_google").select("google_id", "name")
    return relational.batches(g, [F.coalesce("name", F.lit("")), F.col("google_id")], 20).select("google_id", "batch")


def matched_union(spark: SparkSession, d: str) -> DataFrame:
    """Web and Google rows joined where name and address are equal, then all others, the first of each name and address."""
    key = lambda t, k: table(spark, d, t).where("name <> '' AND address <> ''").select(k, "name", "address", "website")
    web, google = key("practices_web", "web_id"), key("practices_google", "google_id")
    first = lambda df, k: df.groupBy("name", "address").agg(F.min(k).alias(k))
    pairs = first(web, "web_id").join(first(google, "google_id"), ["name", "address"])
    out = fuzzyjoin.union_of_match(web, google, pairs, "web_id", "google_id", ["website"])
    order = [F.coalesce("google_id", F.lit(1 << 60)), F.coalesce("web_id", F.lit(1 << 60))]
    out = out.withColumns({"_a": order[0], "_b": order[1]})
    return relational.keep_first(out, ["name", "address"], ["_a", "_b"]).select("name", "address", "website")


def first_or_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    key = lambda t, k: table(spark, d, t).select(k, text.safe_name(F.lower("name")).alias("name")).where("name <> ''")
    return fuzzyjoin.exact_else_fuzzy(key("practices_google", "google_id"), key("practices_web", "web_id"), "google_id", "web_id", "name", "name", 90)


def nonclinic_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    hits = classify.keyword_hits(docs, "doc_id", "text", "lang", _words(spark), "lang", "word", "kind")
    of = lambda kind: hits.where(F.col("kind") == kind).select("doc_id")
    return docs.select("doc_id").join(of("clinic"), "doc_id", "left_semi").join(of("other"), "doc_id", "left_anti")


def species_own_language(spark: SparkSession, d: str) -> DataFrame:
    docs, kw = table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "animal_keywords")
    return classify.keyword_hits(docs, "doc_id", "text", "lang", kw, "lang", "keyword_text", "category", also=None).select("doc_id", F.initcap("kind").alias("species"))


def _specialized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_web").select("web_id", F.concat_ws(" ", "name", "specialization").alias("text"), F.lit("de").alias("lang"))


def species_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Keywords in names and specializations by a partial ratio of 85 or more."""
    return classify.keyword_hits(_specialized(spark, d), "web_id", "text", "lang", table(spark, d, "animal_keywords"), "lang", "keyword_text", "category", fuzzy=85)


def clinic_classify_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    hits = classify.keyword_hits(docs, "doc_id", "text", "lang", _words(spark), "lang", "word", "kind", fuzzy=85).groupBy("doc_id").agg(F.bool_or(F.col("kind") == "clinic").alias("c"), F.bool_or(F.col("kind") == "other").alias("o"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", classify.clinic_status(F.coalesce("c", F.lit(False)), F.coalesce("o", F.lit(False))).alias("clinic"))


def keep_existing(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "practices_web")
    found = F.when(F.contains(F.lower("name"), F.lit("pferd")), "horses")
    return w.select("web_id", classify.keep_or(F.col("category"), found).alias("category"), classify.reason(F.col("category"), found).alias("reason"))


def loose_path_words(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "site_pages").select("page_id", text.contains_any(F.lower(url.path(u)), ["team", "equipe", "praxis"]).alias("in_path"), F.coalesce(url.last_part(u).rlike("^(?:team|equip|ueber)"), F.lit(False)).alias("starts"))


def service_link_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "site_pages").select("page_id", "url", html.links(F.col("html")).alias("l"))
    return classify.service_links(p, "page_id", "url", "l", ["team", "praxis", "service", "leistung"])


def url_clean_country(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("website")
    return table(spark, d, "practices_web").select("web_id", url.clean(F.regexp_replace(u, r"\.example", ".ch"), country="ch").alias("own"), url.clean(F.regexp_replace(u, r"\.example", ".fr"), country="ch").alias("other"),
                                                   url.clean(F.concat(u, F.lit("?file=A.PDF")), with_query=True).alias("file"))


def stop_word_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.stop_word_language(F.col("text"), STOP_WORDS).alias("lang"))


def nearest_cell_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each located place with the nearest of the cells that hold a site of the directory, however far."""
    w = table(spark, d, "practices_web").where("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)")
    size = 2.0
    cells = w.select(F.floor(F.col("longitude") / size).cast("int").alias("i"), F.floor(F.col("latitude") / size).cast("int").alias("j")).distinct()
    p = table(spark, d, "osm_places").where("latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)").select("osm_key", (F.col("longitude") / size).alias("x"), (F.col("latitude") / size).alias("y"))
    return grid.nearest_occupied(p, "osm_key", "x", "y", cells).select("osm_key", "i", "j")


def touched_tiles(spark: SparkSession, d: str) -> DataFrame:
    return grid.touched_tiles(table(spark, d, "boundaries"), "iso", "region_id", "rings", 0.25).select("iso", "i", "j")


QUERIES = {f.__name__: f for f in (
    drop_any_null, drop_all_null, membership_filter, required_fields, unprocessed_filter, settlement_mask, not_rejected, all_fields_null, missing_address, derived_columns, label_numbers, token_estimates, grid_covariates_merge,
    text_lookup, keyword_sets, sorted_values, batch_numbers, matched_union, first_or_fuzzy, nonclinic_semi_anti, species_own_language, species_fuzzy, clinic_classify_fuzzy, keep_existing, loose_path_words, service_link_table, url_clean_country,
    stop_word_languages, nearest_cell_assignment, touched_tiles)}

_PATH = "regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SAFE = "regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), '\\s+$', '')"
_WORD_ROWS = "(VALUES ('de', 'Praxis', 'clinic'), ('de', 'Impfung', 'clinic'), ('fr', 'cabinet', 'clinic'), ('fr', 'vaccination', 'clinic'), ('en', 'vet', 'clinic'), ('en', 'vaccination', 'clinic'), ('it', 'studio', 'clinic'), ('it', 'vaccinazione', 'clinic'), ('es', 'clínica', 'clinic'), ('es', 'vacunación', 'clinic'), ('nl', 'praktijk', 'clinic'), ('nl', 'vaccinatie', 'clinic'), ('de', 'Kurs', 'other'), ('fr', 'cours', 'other'), ('en', 'course', 'other'), ('it', 'corso', 'other'), ('es', 'curso', 'other'), ('nl', 'cursus', 'other')) k(lang, word, kind)"
_FIRST = "(SELECT {1} FROM covariates WHERE ref_year = {0} QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY row_id) = 1)"
_SOME = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)"

#: The European equal-area projection in SQL, from its definition (ellipsoid GRS80, origin 52 N 10 E).
_Q = "(0.00669438002290079::DOUBLE) AS e2, sqrt(0.00669438002290079::DOUBLE) AS e"
_QOF = "((1 - e2) * ({0} / (1 - e2 * {0} * {0}) - ln((1 - e * {0}) / (1 + e * {0})) / (2 * e)))"
_LAEA = f"""
WITH k AS (SELECT {_Q}), k2 AS (SELECT *, {_QOF.format("1.0::DOUBLE")} AS qp, {_QOF.format("sin(radians(52.0::DOUBLE))")} AS q0, 6378137.0::DOUBLE AS a FROM k),
k3 AS (SELECT *, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq, a * cos(radians(52.0::DOUBLE)) / sqrt(1 - e2 * pow(sin(radians(52.0::DOUBLE)), 2)) AS m FROM k2), k4 AS (SELECT *, m / (rq * cos(b0)) AS d FROM k3),
o AS (SELECT *, asin(least(1, greatest(-1, {_QOF.format("sin(radians(latitude))")} / qp))) AS b, radians(longitude - 10) AS dl FROM osm_places, k4 WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)),
r AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(dl))) AS s FROM o),
xy AS (SELECT s * d * cos(b) * sin(dl) + 4321000 AS x, s / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(dl)) + 3210000 AS y FROM r)"""

_BOX = "b AS (SELECT {0}, min(q.x) x0, min(q.y) y0, max(q.x) x1, max(q.y) y1 FROM (SELECT {0}, unnest(flatten(rings)) AS q FROM boundaries) GROUP BY {0})"
_EDGES = "g AS (SELECT region_id, iso, unnest(rings) AS ring FROM boundaries), e AS (SELECT region_id, iso, ring[k] AS p, ring[k % len(ring) + 1] AS q FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS k FROM g))"
_METRES = "2 * 6371000 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"

_FILES = "pdf|jpg|jpeg|png|gif|svg|webp|zip|rar|7z|doc|docx|xls|xlsx|ppt|pptx|mp3|mp4|avi|mov|exe"

SQL = {
    "site_link_table": f"""
WITH a AS (SELECT url, regexp_replace(url, '^([A-Za-z]+)://([^/?#]*).*$', '\\1://\\2') AS root, {_PATH} AS p, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>')) AS a FROM site_pages),
l AS (SELECT *, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS h, trim(regexp_replace(a, '<[^>]*>', '', 'g')) AS anchor FROM a),
f AS (SELECT url, anchor, regexp_replace(CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(root, '^[A-Za-z]+:') || h WHEN starts_with(h, '/') THEN root || h
  ELSE root || coalesce(nullif(regexp_replace(p, '[^/]*$', ''), ''), '/') || h END, '#.*$', '') AS href FROM l WHERE NOT starts_with(h, '#')),
k AS (SELECT url, href, anchor, {_PATH.replace("(url,", "(href,")} AS hp FROM f WHERE {_HOST.format(u="href")} = {_HOST.format(u="url")} AND NOT regexp_matches(lower(href), 'download|install|os='))
SELECT url, min(href) AS href, min(anchor) AS anchor FROM k WHERE NOT regexp_matches(lower(hp), '\\.({_FILES})$') GROUP BY url, hp""",
    "touched_tiles": f"""
WITH {_BOX.format("iso")}, {_EDGES},
t AS (SELECT *, unnest(range(0, greatest(1, ceil((y1 - y0) / 0.25::DOUBLE - 1e-9)::INT))) AS j FROM (SELECT *, unnest(range(0, greatest(1, ceil((x1 - x0) / 0.25::DOUBLE - 1e-9)::INT))) AS i FROM b)),
u AS (SELECT e.iso, (p.x - x0) / 0.25::DOUBLE AS u0, (p.y - y0) / 0.25::DOUBLE AS v0, (q.x - x0) / 0.25::DOUBLE AS u1, (q.y - y0) / 0.25::DOUBLE AS v1 FROM e JOIN b USING (iso)),
c AS (SELECT DISTINCT t.iso, i, j FROM t JOIN u ON t.iso = u.iso AND i <= greatest(u0, u1) AND i + 1 >= least(u0, u1) AND j <= greatest(v0, v1) AND j + 1 >= least(v0, v1)
      WHERE greatest(0, CASE WHEN u1 = u0 THEN (CASE WHEN i < u0 AND u0 < i + 1 THEN 0 ELSE 1 END) ELSE least((i - u0) / (u1 - u0), (i + 1 - u0) / (u1 - u0)) END, CASE WHEN v1 = v0 THEN (CASE WHEN j < v0 AND v0 < j + 1 THEN 0 ELSE 1 END) ELSE least((j - v0) / (v1 - v0), (j + 1 - v0) / (v1 - v0)) END)
          < least(1, CASE WHEN u1 = u0 THEN (CASE WHEN i < u0 AND u0 < i + 1 THEN 1 ELSE 0 END) ELSE greatest((i - u0) / (u1 - u0), (i + 1 - u0) / (u1 - u0)) END, CASE WHEN v1 = v0 THEN (CASE WHEN j < v0 AND v0 < j + 1 THEN 1 ELSE 0 END) ELSE greatest((j - v0) / (v1 - v0), (j + 1 - v0) / (v1 - v0)) END)),
m AS (SELECT iso, i, j, (x0 + i * 0.25::DOUBLE + least(x0 + i * 0.25::DOUBLE + 0.25::DOUBLE, x1)) / 2 AS x, (y0 + j * 0.25::DOUBLE + least(y0 + j * 0.25::DOUBLE + 0.25::DOUBLE, y1)) / 2 AS y FROM t),
h AS (SELECT m.iso, i, j, region_id FROM m JOIN e ON m.iso = e.iso AND (p.y <= y) <> (q.y <= y) AND x < p.x + (q.x - p.x) * (y - p.y) / (q.y - p.y) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT iso, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT iso, i, j FROM c UNION SELECT iso, i, j FROM h)""",
    "country_boxes": f"""
WITH {_BOX.format("region_id")}, k AS (SELECT *, {_METRES.format("((y0 + y1) / 2)", "x0", "((y0 + y1) / 2)", "x1")} / 1000 AS w, {_METRES.format("y0", "x0", "y1", "x0")} / 1000 AS h FROM b),
n AS (SELECT *, CASE WHEN w <= 15 AND h <= 15 THEN 1 ELSE least(5, greatest(1, ceil(h / 50)))::INT END AS nr, CASE WHEN w <= 15 AND h <= 15 THEN 1 ELSE least(5, greatest(1, ceil(w / 50)))::INT END AS nc FROM k),
t AS (SELECT *, unnest(range(0, nr)) AS j FROM (SELECT *, unnest(range(0, nc)) AS i FROM n))
SELECT region_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(y0 + j * ((y1 - y0) / nr), 6) AS south, round(x0 + i * ((x1 - x0) / nc), 6) AS west, round(y0 + (j + 1) * ((y1 - y0) / nr), 6) AS north, round(x0 + (i + 1) * ((x1 - x0) / nc), 6) AS east FROM t""",
    "region_lattice": f"""
WITH {_BOX.format("region_id")}, {_EDGES}, s AS (SELECT *, degrees(10000 / 6371000.0::DOUBLE) AS step FROM b),
j AS (SELECT *, y0 + j * step AS lat FROM (SELECT *, unnest(range(0, floor((y1 - y0) / step)::INT + 1)) AS j FROM s)), d AS (SELECT *, step / greatest(1e-6, cos(radians(lat))) AS dx FROM j),
i AS (SELECT region_id, round(lat, 5) AS lat, round(x0 + i * dx, 5) AS lon FROM (SELECT *, unnest(range(0, floor((x1 - x0) / dx)::INT + 1)) AS i FROM d))
SELECT region_id, lat, lon FROM i JOIN e USING (region_id) WHERE (p.y <= lat) <> (q.y <= lat) AND lon < p.x + (q.x - p.x) * (lat - p.y) / (q.y - p.y) GROUP BY region_id, lat, lon HAVING count(*) % 2 = 1""",
    "laea_cells": _LAEA + " SELECT CAST(floor(x / 10000) AS INT) AS i, CAST(floor(y / 10000) AS INT) AS j, count(*) AS n FROM xy GROUP BY ALL",
    "drop_any_null": "SELECT google_id FROM practices_google WHERE name IS NOT NULL AND address IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(latitude) AND longitude IS NOT NULL AND NOT isnan(longitude)",
    "drop_all_null": "SELECT osm_key FROM osm_places WHERE name IS NOT NULL OR address IS NOT NULL",
    "membership_filter": "SELECT osm_key, country_code FROM osm_places WHERE country_code IN ('CHE', 'AUT', 'NLD')",
    "required_fields": "SELECT google_id, place_id FROM practices_google WHERE place_id <> '' AND name <> '' AND latitude IS NOT NULL AND longitude IS NOT NULL",
    "unprocessed_filter": "SELECT web_id FROM practices_web WHERE coalesce(lower(trim(category)), '') NOT IN ('small animals', 'horses') AND website IS NOT NULL",
    "settlement_mask": "SELECT row_id, settlement FROM covariates WHERE settlement > 0",
    "not_rejected": "SELECT google_id, business_status FROM practices_google WHERE lower(trim(business_status)) IS DISTINCT FROM 'closed_permanently'",
    "all_fields_null": "SELECT web_id FROM practices_web WHERE email IS NULL AND specialization IS NULL AND latitude IS NULL AND longitude IS NULL",
    "missing_address": "SELECT osm_key FROM osm_places WHERE address IS NULL OR regexp_full_match(address, '\\s*')",
    "derived_columns": """
SELECT web_id, 'web' AS source, concat_ws(' ', name, address) AS combined, concat_ws('/', origin, CAST(web_id AS VARCHAR)) AS full_id, CASE WHEN website <> '' THEN website WHEN email <> '' THEN email WHEN name <> '' THEN name END AS contact,
  TRY_CAST(plz AS DOUBLE) AS plz_number FROM practices_web""",
    "label_numbers": "SELECT web_id, CAST(CASE origin WHEN 'google' THEN 1 WHEN 'osm' THEN 2 WHEN 'register' THEN 3 ELSE 0 END AS INT) AS origin_no FROM practices_web",
    "token_estimates": "SELECT doc_id, n_chars + 10 AS request, CAST(round((n_chars + 1000) * 2000 / 1e6 * 85) AS BIGINT) AS image FROM documents",
    "grid_covariates_merge": f"SELECT a.cell_id, a.pop, a.settlement, b.ca FROM {_FIRST.format(2020, 'cell_id, pop, settlement')} a JOIN {_FIRST.format(2015, 'cell_id, ca')} b USING (cell_id) WHERE settlement > 0",
    "text_lookup": f"""
WITH p AS (SELECT {_SAFE.format("lower(website)")} AS f, min(url) AS page FROM site_pages GROUP BY 1)
SELECT web_id, page FROM practices_web LEFT JOIN p ON f = {_SAFE.format(_HOST.format(u="practices_web.website"))}""",
    "keyword_sets": "SELECT lang, string_agg(DISTINCT keyword_text, '|' ORDER BY keyword_text) AS words, count(*) AS n FROM animal_keywords GROUP BY lang",
    "sorted_values": "SELECT cell_id, coalesce(string_agg(DISTINCT CAST(ref_year AS VARCHAR), ',' ORDER BY CAST(ref_year AS VARCHAR)), '') AS years FROM covariates GROUP BY cell_id",
    "batch_numbers": "SELECT google_id, (row_number() OVER (ORDER BY coalesce(name, ''), google_id) - 1) // 20 AS batch FROM practices_google",
    "matched_union": """
WITH w AS (SELECT web_id, name, address, website FROM practices_web WHERE name <> '' AND address <> ''), g AS (SELECT google_id, name, address, website FROM practices_google WHERE name <> '' AND address <> ''),
m AS (SELECT a.web_id, b.google_id FROM (SELECT name, address, min(web_id) AS web_id FROM w GROUP BY ALL) a JOIN (SELECT name, address, min(google_id) AS google_id FROM g GROUP BY ALL) b USING (name, address)),
u AS (SELECT g.name, g.address, coalesce(g.website, w.website) AS website, g.google_id, NULL::BIGINT AS web_id FROM g JOIN m USING (google_id) JOIN w USING (web_id)
      UNION ALL SELECT name, address, website, google_id, NULL FROM g WHERE google_id NOT IN (SELECT google_id FROM m) UNION ALL SELECT name, address, website, NULL, web_id FROM w WHERE web_id NOT IN (SELECT web_id FROM m))
SELECT name, address, website FROM u QUALIFY row_number() OVER (PARTITION BY name, address ORDER BY google_id NULLS LAST, web_id NULLS LAST) = 1""",
    "nonclinic_semi_anti": _hits(_WORD_ROWS, "lang", "word", "kind") + " SELECT doc_id FROM h GROUP BY doc_id HAVING bool_or(kind = 'clinic') AND NOT bool_or(kind = 'other')",
    "species_own_language": """
SELECT DISTINCT doc_id, CASE category WHEN 'small animals' THEN 'Small Animals' WHEN 'large animals' THEN 'Large Animals' ELSE 'Horses' END AS species FROM documents d JOIN animal_keywords k ON lower(d.lang) = lower(k.lang) AND contains(lower(text), lower(keyword_text))""",
    "keep_existing": """
SELECT web_id, CASE WHEN category IS NOT NULL AND NOT regexp_full_match(category, '\\s*') THEN category WHEN contains(lower(name), 'pferd') THEN 'horses' END AS category,
  CASE WHEN category IS NOT NULL AND NOT regexp_full_match(category, '\\s*') THEN 'skipped' WHEN contains(lower(name), 'pferd') THEN 'match' ELSE 'no_species_match' END AS reason FROM practices_web""",
    "loose_path_words": f"""
SELECT page_id, coalesce(contains(lower({_PATH}), 'team') OR contains(lower({_PATH}), 'equipe') OR contains(lower({_PATH}), 'praxis'), false) AS in_path,
  coalesce(regexp_matches(lower(regexp_extract({_PATH}, '([^/]*)/*$', 1)), '^(team|equip|ueber)'), false) AS starts FROM site_pages""",
    "service_link_table": """
WITH a AS (SELECT page_id, regexp_replace(url, '^([A-Za-z]+)://([^/?#]*).*$', '\\1://\\2') AS root, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a>')) AS a FROM site_pages),
l AS (SELECT *, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS h, lower(trim(regexp_replace(a, '<[^>]*>', '', 'g'))) AS t FROM a)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(root, '^[A-Za-z]+:') || h WHEN starts_with(h, '/') THEN root || h
  ELSE root || coalesce(nullif(regexp_replace(p, '[^/]*$', ''), ''), '/') || h END AS href FROM l WHERE contains(t, 'team') OR contains(t, 'praxis') OR contains(t, 'service') OR contains(t, 'leistung')""",
    "url_clean_country": """
WITH u AS (SELECT web_id, CASE WHEN lower(regexp_replace(website, '^\\s+|\\s+$', '', 'g')) IN ('', 'none', 'null', 'nan') THEN NULL ELSE regexp_replace(website, '^\\s+|\\s+$', '', 'g') END AS u FROM practices_web),
p AS (SELECT web_id, u, regexp_matches(u, '^(?i)https?://([^/?#@]*@)?[^/?#:\\s]*\\.[^/?#:\\s]*') AS ok, lower(regexp_extract(u, '^(?i)(https?)://', 1)) || '://' || lower(regexp_extract(u, '^(?i)https?://([^/?#@]*@)?([^/?#:\\s]*)', 2)) || '/' AS home,
  regexp_extract(lower(regexp_replace(u, '\\.example', '.ch', 'g')), '^https?://([^/?#@]*@)?([^/?#:\\s]*)', 2) AS h1, regexp_extract(lower(regexp_replace(u, '\\.example', '.fr', 'g')), '^https?://([^/?#@]*@)?([^/?#:\\s]*)', 2) AS h2 FROM u)
SELECT web_id, CASE WHEN ok AND (length(regexp_extract(h1, '[^.]*$')) <> 2 OR ends_with(h1, '.ch')) THEN lower(regexp_replace(u, '\\.example', '.ch', 'g')) END AS own,
  CASE WHEN ok AND (length(regexp_extract(h2, '[^.]*$')) <> 2 OR ends_with(h2, '.ch')) THEN lower(regexp_replace(u, '\\.example', '.fr', 'g')) END AS other,
  CASE WHEN ok THEN home END AS file FROM p""",
    "stop_word_languages": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}'']+')) AS w FROM documents), s(lang, w) AS (VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in STOP_WORDS.items() for w in ws) + """),
n AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN s USING (w) GROUP BY doc_id, lang), v AS (SELECT doc_id, lang FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1) SELECT d.doc_id, v.lang FROM documents d LEFT JOIN v USING (doc_id)""",
    "nearest_cell_assignment": f"""
WITH c AS (SELECT DISTINCT CAST(floor(longitude / 2.0::DOUBLE) AS INT) AS i, CAST(floor(latitude / 2.0::DOUBLE) AS INT) AS j FROM practices_web WHERE {_SOME}),
p AS (SELECT osm_key, longitude / 2.0::DOUBLE AS x, latitude / 2.0::DOUBLE AS y FROM osm_places WHERE {_SOME})
SELECT osm_key, i, j FROM p, c QUALIFY row_number() OVER (PARTITION BY osm_key ORDER BY pow(greatest(i - x, x - i - 1, 0), 2) + pow(greatest(j - y, y - j - 1, 0), 2), i, j) = 1""",
}
