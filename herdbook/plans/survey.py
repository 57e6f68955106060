"""Queries for the operators of the survey, over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from herdbook.functions import html, text, url
from herdbook.operators import classify, clusters, fuzzyjoin, grid, model, points, relational
from herdbook.plans.dealt import GAPS
from herdbook.runtime import table

#: Words in the names of practices that aren't small-animal ones, and of clinics in six languages.
SPECIAL = ["pferde", "équine", "equine", "paarden"]
CLINIC_WORDS = {"de": ["Praxis", "Impfung"], "fr": ["cabinet", "vaccination"], "en": ["vet", "vaccination"], "it": ["studio", "vaccinazione"], "es": ["clínica", "vacunación"], "nl": ["praktijk", "vaccinatie"]}
OTHER_WORDS = {"de": ["Kurs"], "fr": ["cours"], "en": ["course"], "it": ["corso"], "es": ["curso"], "nl": ["cursus"]}
CATEGORIES = ["small animals", "large animals", "horses"]

_HOST = "nullif(lower(regexp_extract({u}, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:\\s]*)', 2)), '')"
_POINT = "latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)"


def _located(df: DataFrame) -> DataFrame:
    return df.where(points.usable_point(F.col("latitude"), F.col("longitude")))


def dedup_spatial_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.near_clusters(_located(table(spark, d, "practices_google")), "google_id", "latitude", "longitude", 50.0)


def dedup_duplicates_export(spark: SparkSession, d: str) -> DataFrame:
    g = _located(table(spark, d, "practices_google"))
    return clusters.duplicates(g, clusters.near_clusters(g, "google_id", "latitude", "longitude", 50.0), "google_id").select("google_id", "cluster", "name")


def merge_cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    return clusters.merge_clusters(table(spark, d, "practices_web"), "cluster_id", "web_id", F.col("origin") == "google", ["name", "address", "website", "email"], "specialization")


def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_first(table(spark, d, "osm_places").select("osm_id", "osm_key", "name"), ["osm_id"], ["osm_key"])


def status_split_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    open_, other = relational.split_by(table(spark, d, "practices_google"), ~relational.is_not(F.col("business_status"), "OPERATIONAL"))
    return open_.select("google_id", F.lit("open").alias("part")).unionByName(other.select("google_id", F.lit("other").alias("part")))


def union_align_columns(spark: SparkSession, d: str) -> DataFrame:
    want = ["Name", "Address", "Web_Site", "Email"]
    a, b = relational.align(table(spark, d, "practices_google"), want), relational.align(table(spark, d, "practices_web"), want)
    return a.unionByName(b).select(F.col("Name").alias("name"), F.col("Address").alias("address"), F.col("Web_Site").alias("website"), F.col("Email").alias("email")).distinct()


def keyword_filter_names(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "practices_google").select("google_id", "name")
    return g.withColumn("special", text.contains_any(F.lower("name"), SPECIAL)).select("google_id", "special")


def null_conventions(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "practices_web")
    return w.select("web_id", text.null_if_sentinel(F.col("website")).alias("website"), text.null_if_blank(F.col("specialization")).alias("specialization"), text.geocode_query("address", "plz", "ort").alias("query"), text.compose_address("address", "plz", "ort").alias("full_address"))


def species_flags(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "practices_web")
    return w.select("web_id", *(text.species_flag(F.col("specialization"), c).alias(c.replace(" ", "_")) for c in CATEGORIES))


def _words(spark: SparkSession) -> DataFrame:
    rows = [(lang, w, kind) for kind, words in (("clinic", CLINIC_WORDS), ("other", OTHER_WORDS)) for lang, ws in words.items() for w in ws]
    return spark.createDataFrame(rows, "lang string, word string, kind string")


def clinic_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    hits = classify.keyword_hits(docs, "doc_id", "text", "lang", _words(spark), "lang", "word", "kind").groupBy("doc_id").agg(F.max((F.col("kind") == "clinic").cast("int")).alias("c"), F.max((F.col("kind") == "other").cast("int")).alias("o"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", classify.clinic_status(F.coalesce(F.col("c") == 1, F.lit(False)), F.coalesce(F.col("o") == 1, F.lit(False))).alias("clinic"))


def species_of_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, kw = table(spark, d, "documents").select("doc_id", "text", "lang"), table(spark, d, "animal_keywords")
    hits = classify.keyword_hits(docs, "doc_id", "text", "lang", kw, "lang", "keyword_text", "category")
    return classify.species(docs, hits, "doc_id", CATEGORIES).select("doc_id", "species")


def best_match_top1(spark: SparkSession, d: str) -> DataFrame:
    key = lambda t, k: table(spark, d, t).select(k, F.lower("name").alias("name")).where("name <> ''")
    return fuzzyjoin.best_match(key("practices_google", "google_id"), key("osm_places", "osm_key"), "google_id", "osm_key", "name", "name", 90)


def closed_anti_join(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "practices_google").select("google_id", "business_status", F.lower(text.concat_key("name", "address")).alias("both"), F.lower("address").alias("address"))
    open_, closed = relational.split_by(g, relational.is_not(F.col("business_status"), "CLOSED_PERMANENTLY"))
    closed = closed.select(F.col("google_id").alias("closed_id"), F.col("both").alias("c_both"), F.col("address").alias("c_address"))
    return fuzzyjoin.without_closed(open_, closed, "google_id", "closed_id", [("both", "c_both", 85), ("address", "c_address", 90)]).select("google_id")


def closed_anti_exact(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "practices_google")
    open_, closed = relational.split_by(g, relational.is_not(F.col("business_status"), "CLOSED_PERMANENTLY"))
    return open_.join(closed.select("address").where("address IS NOT NULL").distinct(), "address", "left_anti").select("google_id", "address")


def fill_missing_from_lookup(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "practices_web")
    lookup = w.groupBy("cluster_id").agg(F.min("email").alias("email"), F.min(F.when(F.col("category") != "", F.col("category"))).alias("category"))
    return relational.fill_from(w.select("web_id", "cluster_id", "email", "category"), lookup, "cluster_id", {"email": "null", "category": "empty"}).select("web_id", "email", "category")


def update_first_row(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "practices_web").select("web_id", "cluster_id", "name")
    new = w.groupBy("cluster_id").agg(F.max("name").alias("name"))
    return relational.update_first(w, new, "cluster_id", "web_id", ["name"])


def population_radius(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "covariates").select("row_id", relational.population_radius(F.col("pop") * 1000).cast("int").alias("radius_m"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kept = e.where("CASE user_id % 3 WHEN 0 THEN event_type = 'click' WHEN 1 THEN event_type IN ('click', 'view') ELSE true END")
    page = F.floor((F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 20) + 1
    item = F.when(F.col("user_id") % 2 == 0, F.col("event_id")).otherwise(F.floor(F.col("value") / 10).cast("bigint"))
    return kept.select("user_id", page.alias("page"), item.alias("item"))


def page_stop_rules(spark: SparkSession, d: str) -> DataFrame:
    return relational.pages_to_fetch(_pages(spark, d), "user_id", "page", "item")


def call_cap_running(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3 + 1).alias("calls"))
    return relational.within_cap(e, "event_id", F.col("calls"), 8000).select("event_id", "calls", "running")


def team_counts_json(spark: SparkSession, d: str) -> DataFrame:
    one = """concat('{"Name":"A","Gender":"', CASE google_id % 2 WHEN 0 THEN 'Female' ELSE ' male' END, '","Role":"', CASE google_id % 3 WHEN 0 THEN 'Doctor ' ELSE 'assistant' END, '","Uncertain":false}')"""
    reply = F.expr(f"CASE google_id % 5 WHEN 0 THEN 'no list' WHEN 1 THEN '[]' WHEN 2 THEN concat('Here: [', {one}, '] done') WHEN 3 THEN concat('[', {one}, ',', {one}, ']') ELSE concat('[', {one}) END")
    p = table(spark, d, "practices_google").select("google_id", classify.people(reply).alias("p"))
    return p.select("google_id", *(c.cast("int").alias(n) for n, c in classify.team_counts(F.col("p")).items()))


def url_clean(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("website")
    return table(spark, d, "practices_web").select("web_id", url.clean(u).alias("cleaned"), url.host(u).alias("host"), url.homepage(u).alias("home"), url.probably_page(u).alias("is_page"))


def url_blacklist(spark: SparkSession, d: str) -> DataFrame:
    u, words = F.col("website"), ("tierklinik", "petsolisgroup", "vet")
    return table(spark, d, "osm_places").where(url.host(u).isNotNull()).select("osm_key", url.blocked_exactly(u, words).alias("exact"), url.blocked_loosely(u, words).alias("loose"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_pages").select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href")).distinct()


def html_text_valid(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "site_pages").select("page_id", html.stripped(F.col("html")).alias("t"))
    return p.select("page_id", text.valid_content(F.col("t")).alias("valid"), text.visible(F.col("t")).alias("visible"), F.length("t").alias("n_chars"))


def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_pages").select("page_id", html.main_text(F.col("html")).alias("main"), html.readable_text(F.col("html")).alias("readable"), html.full_text(F.col("html")).alias("full"))


def team_page_score(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "site_pages").select("page_id", F.col("url").alias("u"), html.stripped(F.col("html")).alias("t"))
    return p.select("page_id", classify.page_score(F.col("t"), url.path(F.col("u")), {"Team": 20, "Praxis": 3, "Impfung": 5}, ("team", "equipe")).cast("bigint").alias("score"))


def best_team_page(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "site_pages").select("website", F.col("url").alias("u"), html.stripped(F.col("html")).alias("t"))
    p = p.withColumn("score", classify.page_score(F.col("t"), url.path(F.col("u")))).withColumn("pref", url.path(F.col("u")).rlike("(?i)team|equip"))
    return classify.best_page(p, "website", "u", "score", "pref", F.col("website"))


def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices_google").select("google_id", text.fold_words(F.col("name")).alias("folded"), text.safe_name(F.col("name")).alias("file_name"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundaries")
    inside = points.containing_regions(table(spark, d, "practices_google"), "google_id", "latitude", "longitude", b, "region_id", "rings")
    return inside.groupBy(F.col("key_b").alias("region_id")).agg(F.count(F.lit(1)).alias("n"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = grid.assign_cells(_located(table(spark, d, "osm_places")), F.col("longitude"), F.col("latitude"), -180.0, -90.0, 1.0)
    return p.select("i", "j").distinct(), p


def grid_assign_count(spark: SparkSession, d: str) -> DataFrame:
    cells, p = _cells(spark, d)
    return relational.check_total(grid.cell_counts(cells, p, ["i", "j"]), "clinic_count", p)


def _moran(spark: SparkSession, d: str) -> DataFrame:
    cells, p = _cells(spark, d)
    return grid.local_moran(grid.cell_counts(cells, p, ["i", "j"]), "clinic_count")


def grid_local_moran(spark: SparkSession, d: str) -> DataFrame:
    return _moran(spark, d).select("i", "j", F.round("lag", 6).alias("lag"), F.round("local_i", 6).alias("local_i"), "quadrant")


def lisa_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.value_counts(_moran(spark, d), "quadrant").select(F.col("value").alias("cluster"), "n", "percent")


def lisa_significance(spark: SparkSession, d: str) -> DataFrame:
    cells, p = _cells(spark, d)
    return grid.moran_significance(grid.cell_counts(cells, p, ["i", "j"]), "clinic_count").select("i", "j", "p_value", "label")


def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    o = _located(table(spark, d, "osm_places"))
    px = o.select(F.lit("places").alias("raster"), F.floor((F.lit(90.0) - F.col("latitude")) / 0.5).cast("int").alias("row"), F.floor((F.col("longitude") + 180.0) / 0.5).cast("int").alias("col")).groupBy("raster", "row", "col").agg(F.count(F.lit(1)).cast("double").alias("value"))
    g = _located(table(spark, d, "practices_google"))
    return grid.sample_raster(g, F.col("longitude"), F.col("latitude"), px, -180.0, 90.0, 0.5).select("google_id", "places")


def covariate_impute(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "covariates").select("row_id", F.when((F.col("settlement") % 7 == 0), None).otherwise(F.col("settlement").cast("double")).alias("settlement"))
    return relational.impute_mean(c, ["settlement"]).select("row_id", relational.rounded(F.col("settlement")).alias("settlement"))


def residuals(spark: SparkSession, d: str) -> DataFrame:
    cells, p = _cells(spark, d)
    c = grid.cell_counts(cells, p, ["i", "j"])
    c = c.crossJoin(F.broadcast(c.agg(F.avg("clinic_count").alias("expected"))))
    return model.residuals(c, "clinic_count", "expected").select("i", "j", F.round("resid_raw", 6).alias("resid_raw"), F.round("resid_pearson", 6).alias("resid_pearson"))


def poisson_fit(spark: SparkSession, d: str) -> DataFrame:
    measured = {g.name: g.measured() for g in GAPS}
    log = lambda c: F.when(measured.get(c, F.coalesce(~F.isnan(F.col(c)) & (F.col(c) >= 0) & (F.col(c) < 1e30), F.lit(False))), F.log(1 + F.col(c).cast("double"))).alias(f"l_{c}")
    nine = ["pop", "gdp", "acc", "ca", "ch", "pg", "sh"]
    c = table(spark, d, "covariates").where("settlement >= 0").select("row_id", "settlement", F.lit(100.0).alias("area"), *map(log, nine), F.when(measured["urban"], F.col("urban").cast("double") / 10).alias("urban"), ((F.col("ref_year") - 2015) / 10.0).alias("time"))
    return model.poisson_fit(c, "settlement", "area", [*(f"l_{n}" for n in nine), "urban", "time"])[1]


def profile_minmax(spark: SparkSession, d: str) -> DataFrame:
    return relational.profile(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("name", "least", "most", F.round("mean", 6).alias("mean"), "filled")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "osm_places")
    return relational.not_done(o.select("osm_key", "osm_id").where("osm_id IS NOT NULL"), o.where("country_code = 'CHE'"), "osm_id")


def country_tiles(spark: SparkSession, d: str) -> DataFrame:
    box = grid.bounds(table(spark, d, "boundaries"), "rings", ["iso"])
    return grid.degree_tiles(box, 0.25).select("iso", "i", "j", *(F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")))


def covered_tiles(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundaries")
    tiles = grid.degree_tiles(grid.bounds(b, "rings", ["iso"]), 1.0)
    return grid.covered_tiles(tiles, ["iso", "i", "j"], b, "region_id", "rings").select("iso", "i", "j", "share")


def region_lattice(spark: SparkSession, d: str) -> DataFrame:
    return grid.points_in_region(table(spark, d, "boundaries"), "region_id", "rings", 10.0)


def laea_cells(spark: SparkSession, d: str) -> DataFrame:
    o = _located(table(spark, d, "osm_places"))
    x, y = grid.to_laea(F.col("latitude"), F.col("longitude"))
    return grid.assign_cells(o, x, y, 0.0, 0.0, 10_000.0).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def country_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "osm_places").groupBy("country_code").agg(F.count(F.lit(1)).alias("n"), F.count("osm_id").alias("elements"), F.countDistinct("osm_id").alias("distinct_elements"))


def country_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = grid.bounds(table(spark, d, "boundaries"), "rings", ["region_id"])
    return grid.box_tiles(boxes, 50, 5, 15).select("region_id", "i", "j", *(F.round(c, 6).alias(c) for c in ("south", "west", "north", "east")))


def country_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.square_cells(table(spark, d, "boundaries"), "iso", "region_id", "rings")


def region_areas(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundaries")
    return b.select("region_id", F.round(F.aggregate(F.transform("rings", grid.ring_area), F.lit(0.0), lambda a, x: a + x), 6).alias("area"))


def cookie_buttons(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "site_pages").select(F.explode(F.regexp_extract_all("html", F.lit("(?i)<button>([^<]*)"), F.lit(1))).alias("label"))
    return b.groupBy(F.trim("label").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("accepts", classify.cookie_label(F.col("label")))


def site_link_table(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "site_pages").select("url", html.links(F.col("html")).alias("l"))
    return classify.site_links(pages, "url", "l")


def moran_of_residuals(spark: SparkSession, d: str) -> DataFrame:
    cells, p = _cells(spark, d)
    c = grid.cell_counts(cells, p, ["i", "j"])
    c = model.residuals(c.crossJoin(F.broadcast(c.agg(F.avg("clinic_count").alias("expected")))), "clinic_count", "expected")
    return model.global_moran(c, "resid_pearson").select("n", F.round("moran_i", 6).alias("moran_i"))


QUERIES = {f.__name__: f for f in (
    dedup_spatial_clusters, dedup_duplicates_export, merge_cluster_rows, keep_first_dedup, status_split_nullsafe, union_align_columns, keyword_filter_names, null_conventions, species_flags,
    clinic_classify, species_of_documents, best_match_top1, closed_anti_join, closed_anti_exact, fill_missing_from_lookup, update_first_row, population_radius, page_stop_rules, call_cap_running,
    team_counts_json, url_clean, url_blacklist, html_links, html_text_valid, html_main_text, team_page_score, best_team_page, text_normalise, point_in_polygon, grid_assign_count, grid_local_moran,
    lisa_summary, lisa_significance, raster_sample, covariate_impute, residuals, poisson_fit, profile_minmax, resume_anti, country_tiles, covered_tiles, region_lattice, laea_cells, country_summary, country_boxes, country_cells, region_areas, cookie_buttons, site_link_table, moran_of_residuals)}

_CLUSTERS = f"""
WITH RECURSIVE p AS (SELECT google_id, name, latitude y, longitude x FROM practices_google WHERE {_POINT}),
e AS (SELECT a.google_id a, b.google_id b FROM p a JOIN p b ON a.google_id <> b.google_id AND abs(a.y - b.y) < 0.0005
  AND 2 * 6371000 * asin(least(1, sqrt(pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2)))) <= 50),
r AS (SELECT google_id AS s, google_id AS t FROM p UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a),
c AS (SELECT s AS google_id, min(t) AS cluster FROM r GROUP BY s)"""
_CELLS = f"""
WITH p AS (SELECT CAST(floor((longitude + 180.0::DOUBLE) / 1.0::DOUBLE) AS INT) i, CAST(floor((latitude + 90.0::DOUBLE) / 1.0::DOUBLE) AS INT) j FROM osm_places WHERE {_POINT}),
c AS (SELECT i, j, count(*) AS clinic_count FROM p GROUP BY i, j)"""
_MORAN = _CELLS + """,
s AS (SELECT avg(clinic_count) m, var_pop(clinic_count) v FROM c), z AS (SELECT i, j, clinic_count - m AS z, v FROM c, s),
l AS (SELECT a.i, a.j, avg(b.z) AS lag FROM z a JOIN z b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j),
lm AS (SELECT z.i, z.j, z, v, coalesce(lag, 0.0) AS lag FROM z LEFT JOIN l USING (i, j)),
q AS (SELECT i, j, lag, CASE WHEN v > 0 THEN z * lag / v ELSE 0.0 END AS local_i,
  CASE WHEN z > 0 AND lag > 0 THEN 'High-High' WHEN z < 0 AND lag < 0 THEN 'Low-Low' WHEN z > 0 AND lag < 0 THEN 'High-Low' WHEN z < 0 AND lag > 0 THEN 'Low-High' ELSE 'None' END AS quadrant FROM lm)"""
_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = "(VALUES " + ", ".join(f"('{lang}', '{w}', '{kind}')" for kind, words in (("clinic", CLINIC_WORDS), ("other", OTHER_WORDS)) for lang, ws in words.items() for w in ws) + ") k(lang, word, kind)"


def _hits(keywords: str, lang: str, word: str, kind: str) -> str:
    return f"""
WITH k AS (SELECT lower({lang}) AS l, lower({word}) AS w, {kind} AS kind FROM {keywords}), langs AS (SELECT DISTINCT l FROM k),
d AS (SELECT doc_id, lower(text) AS t, CASE WHEN lower(lang) IN (SELECT l FROM langs) THEN lower(lang) ELSE 'en' END AS l FROM documents),
h AS (SELECT DISTINCT doc_id, kind FROM d JOIN k ON (k.l = d.l OR k.l = 'en') AND contains(t, w))"""


_U = "regexp_replace(website, '^\\s+|\\s+$', '', 'g')"
_ENDINGS = "|".join(url.BINARY_ENDINGS)

SQL = {
    "dedup_spatial_clusters": _CLUSTERS + " SELECT google_id, cluster FROM c",
    "dedup_duplicates_export": _CLUSTERS + " SELECT google_id, cluster, name FROM c JOIN p USING (google_id) QUALIFY count(*) OVER (PARTITION BY cluster) > 1",
    "merge_cluster_rows": """
WITH w AS (SELECT *, CASE WHEN origin = 'google' THEN 0 ELSE 1 END * 1000000000000 + web_id AS o FROM practices_web)
SELECT cluster_id, """ + ", ".join(f"arg_min({c}, o) FILTER ({c} IS NOT NULL) AS {c}" for c in ("name", "address", "website", "email")) + """,
  nullif(list_aggregate(list_sort(list(DISTINCT specialization) FILTER (specialization IS NOT NULL)), 'string_agg', ', '), '') AS specialization, count(*) AS n FROM w GROUP BY cluster_id""",
    "keep_first_dedup": "SELECT osm_id, osm_key, name FROM osm_places QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY osm_key) = 1",
    "status_split_nullsafe": "SELECT google_id, CASE WHEN business_status = 'OPERATIONAL' THEN 'open' ELSE 'other' END AS part FROM practices_google",
    "union_align_columns": "SELECT DISTINCT name, address, website, email FROM (SELECT name, address, website, '' AS email FROM practices_google UNION ALL SELECT name, address, website, email FROM practices_web)",
    "keyword_filter_names": "SELECT google_id, coalesce(" + " OR ".join(f"contains(lower(name), '{w}')" for w in SPECIAL) + ", false) AS special FROM practices_google",
    "null_conventions": """
SELECT web_id, CASE WHEN lower(regexp_replace(website, '^\\s+|\\s+$', '', 'g')) IN ('', 'none', 'null', 'nan') THEN NULL ELSE website END AS website,
  CASE WHEN regexp_full_match(specialization, '\\s*') THEN NULL ELSE specialization END AS specialization,
  CASE WHEN address IS NOT NULL THEN concat_ws(', ', address, CASE WHEN lower(trim(plz)) IN ('', 'none', 'null', 'nan') THEN NULL ELSE plz END, CASE WHEN lower(trim(ort)) IN ('', 'none', 'null', 'nan') THEN NULL ELSE ort END) END AS query,
  nullif(concat_ws(', ', nullif(address, ''), nullif(plz, ''), nullif(ort, '')), '') AS full_address FROM practices_web""",
    "species_flags": "SELECT web_id, " + ", ".join(f"CASE WHEN specialization IS NOT NULL AND NOT regexp_full_match(specialization, '\\s*') THEN contains(lower(specialization), '{c}') END AS {c.replace(' ', '_')}" for c in CATEGORIES) + " FROM practices_web",
    "clinic_classify": _hits(_WORDS, "lang", "word", "kind") + """,
s AS (SELECT doc_id, CASE WHEN bool_or(kind = 'clinic') THEN 'yes' WHEN bool_or(kind = 'other') THEN 'no' ELSE 'uncertain' END AS clinic FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, clinic FROM s""",
    "species_of_documents": _hits("animal_keywords", "lang", "keyword_text", "category") + """,
o AS (SELECT doc_id, string_agg(kind, ', ' ORDER BY CASE kind WHEN 'small animals' THEN 0 WHEN 'large animals' THEN 1 ELSE 2 END) AS species FROM h GROUP BY doc_id)
SELECT doc_id, species FROM documents LEFT JOIN o USING (doc_id)""",
    "closed_anti_exact": "SELECT google_id, address FROM practices_google WHERE business_status IS DISTINCT FROM 'CLOSED_PERMANENTLY' AND (address IS NULL OR address NOT IN (SELECT address FROM practices_google WHERE business_status = 'CLOSED_PERMANENTLY' AND address IS NOT NULL))",
    "fill_missing_from_lookup": """
WITH l AS (SELECT cluster_id, min(email) AS e, min(category) FILTER (category <> '') AS c FROM practices_web GROUP BY cluster_id)
SELECT web_id, coalesce(email, e) AS email, CASE WHEN coalesce(category, '') = '' THEN c ELSE category END AS category FROM practices_web LEFT JOIN l USING (cluster_id)""",
    "update_first_row": "SELECT web_id, cluster_id, CASE WHEN web_id = min(web_id) OVER (PARTITION BY cluster_id) THEN coalesce(max(name) OVER (PARTITION BY cluster_id), name) ELSE name END AS name FROM practices_web",
    "population_radius": "SELECT row_id, CASE WHEN p IS NULL OR p <= 0 THEN 20000 WHEN p < 20000 THEN 15000 WHEN p < 100000 THEN 25000 WHEN p < 300000 THEN 35000 WHEN p < 1000000 THEN 50000 ELSE 65000 END AS radius_m FROM (SELECT row_id, pop * 1000::FLOAT AS p FROM covariates)",
    "page_stop_rules": """
WITH k AS (SELECT * FROM events WHERE CASE user_id % 3 WHEN 0 THEN event_type = 'click' WHEN 1 THEN event_type IN ('click', 'view') ELSE true END),
p AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 + 1 AS page, CASE WHEN user_id % 2 = 0 THEN event_id ELSE CAST(floor(value / 10) AS BIGINT) END AS item FROM k),
c AS (SELECT user_id, count(*) FILTER (page = 1) AS n1, count(*) FILTER (page = 2) AS n2, count(*) FILTER (page = 3) AS n3,
  count(*) FILTER (page = 2 AND item IN (SELECT q.item FROM p q WHERE q.page = 1 AND q.user_id = p.user_id)) AS repeated FROM p GROUP BY user_id)
SELECT user_id, n1, n2, repeated, CASE WHEN n1 < 20 OR n2 = 0 THEN 1 WHEN n2 < 20 OR n3 = 0 OR repeated > 0.8 * n2 THEN 2 ELSE 3 END AS pages FROM c""",
    "call_cap_running": "SELECT * FROM (SELECT event_id, event_id % 3 + 1 AS calls, sum(event_id % 3 + 1) OVER (ORDER BY event_id) AS running FROM events) WHERE running <= 8000",
    "team_counts_json": """
WITH n AS (SELECT google_id, CASE google_id % 5 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS n, google_id % 2 = 0 AS f, google_id % 3 = 0 AS d FROM practices_google)
SELECT google_id, CASE WHEN n > 0 THEN CASE WHEN f AND d THEN n ELSE 0 END END AS FD, CASE WHEN n > 0 THEN CASE WHEN NOT f AND d THEN n ELSE 0 END END AS MD,
  CASE WHEN n > 0 THEN CASE WHEN f AND NOT d THEN n ELSE 0 END END AS FND, CASE WHEN n > 0 THEN CASE WHEN NOT f AND NOT d THEN n ELSE 0 END END AS MND FROM n""",
    "url_clean": f"""
WITH p AS (SELECT web_id, website, {_U} AS u, {_HOST.format(u='website')} AS host, nullif(lower(regexp_extract(website, '^\\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '') AS scheme,
  regexp_matches(lower(regexp_extract(website, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\\.({_ENDINGS})$') AS file FROM practices_web),
h AS (SELECT *, CASE WHEN host IS NOT NULL THEN scheme || '://' || host || '/' END AS home FROM p)
SELECT web_id, CASE WHEN scheme IN ('http', 'https') AND contains(host, '.') THEN CASE WHEN file THEN home ELSE lower(u) END END AS cleaned, host, home, coalesce(scheme IN ('http', 'https') AND NOT file, false) AS is_page FROM h""",
    "url_blacklist": f"""
WITH h AS (SELECT osm_key, {_HOST.format(u='website')} AS host FROM osm_places)
SELECT osm_key, list_has_any(string_split(host, '.')[:-2], ['tierklinik', 'petsolisgroup', 'vet']) AS exact,
  contains(regexp_replace(host, '^www\\.', ''), 'tierklinik') OR contains(regexp_replace(host, '^www\\.', ''), 'petsolisgroup') OR contains(regexp_replace(host, '^www\\.', ''), 'vet') AS loose FROM h WHERE host IS NOT NULL""",
    "html_links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM site_pages",
    "html_text_valid": f"""
WITH t AS (SELECT page_id, {_STRIPPED} AS t FROM site_pages)
SELECT page_id, coalesce(length(t) >= 200 AND NOT (contains(lower(t), 'error scraping content') OR contains(lower(t), 'no content') OR contains(lower(t), '<!doctype html>') OR contains(lower(t), '404 not found')
  OR contains(lower(t), 'page not found') OR contains(lower(t), 'document not found') OR contains(lower(t), 'the resource requested could not be found') OR contains(lower(t), 'diese seite wurde nicht gefunden')
  OR contains(lower(t), 'seite nicht gefunden') OR contains(lower(t), 'page introuvable') OR contains(lower(t), 'verifying you are human') OR contains(lower(t), 'enable javascript and cookies') OR contains(lower(t), 'cloudflare')
  OR regexp_matches(lower(t), 'waiting for .* to respond') OR contains(lower(t), 'ray id')), false) AS valid, coalesce(length(t) >= 300, false) AS visible, length(t) AS n_chars FROM t""",
    "team_page_score": f"""
WITH t AS (SELECT page_id, {_STRIPPED} AS t, regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM site_pages),
n AS (SELECT page_id, t, p, coalesce(len(regexp_extract_all(t, '(?i)\\bTeam\\b')), 0) AS a, coalesce(len(regexp_extract_all(t, '(?i)\\bPraxis\\b')), 0) AS b, coalesce(len(regexp_extract_all(t, '(?i)\\bImpfung\\b')), 0) AS c FROM t)
SELECT page_id, CASE WHEN coalesce(length(t), 0) <= 200 THEN 0 ELSE 20 * a + 3 * b + 5 * c + CASE WHEN contains(lower(p), 'team') THEN 25 ELSE 0 END + CASE WHEN contains(lower(p), 'equipe') THEN 25 ELSE 0 END
  - CASE WHEN coalesce(p, '') IN ('', '/') AND a = 0 THEN 15 ELSE 0 END END AS score FROM n""",
    "text_normalise": """
WITH f AS (SELECT google_id, name, regexp_replace(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '^\\s+|\\s+$', '', 'g') AS f FROM practices_google)
SELECT google_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '-', ' ', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS folded,
  regexp_replace(regexp_replace(name, '[^\\p{L}\\p{N} _-]', '', 'g'), '\\s+$', '') AS file_name FROM f""",
    "point_in_polygon": f"""
WITH pt AS (SELECT google_id, longitude x, latitude y FROM practices_google WHERE {_POINT}),
r AS (SELECT region_id, unnest(rings) AS ring FROM boundaries),
e AS (SELECT region_id, unnest(list_transform(range(1, len(ring) + 1), lambda i: {{'p': ring[i], 'q': ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END]}})) AS e FROM r),
f AS (SELECT region_id, CASE WHEN e.p.y < e.q.y THEN e.p.x ELSE e.q.x END x1, CASE WHEN e.p.y < e.q.y THEN e.q.x ELSE e.p.x END x2, least(e.p.y, e.q.y) y1, greatest(e.p.y, e.q.y) y2 FROM e WHERE e.p.y <> e.q.y),
w AS (SELECT google_id, region_id FROM pt JOIN f ON y1 <= y AND y < y2 AND x < x1 + (x2 - x1) * (y - y1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT region_id, count(*) AS n FROM w GROUP BY region_id""",
    "grid_assign_count": _CELLS + " SELECT i, j, clinic_count FROM c",
    "grid_local_moran": _MORAN + " SELECT i, j, round(lag, 6) AS lag, round(local_i, 6) AS local_i, quadrant FROM q",
    "lisa_summary": _MORAN + " SELECT quadrant AS cluster, count(*) AS n, floor(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () * 100 + 0.5) / 100 AS percent FROM q GROUP BY quadrant",
    "raster_sample": f"""
WITH px AS (SELECT floor((90.0::DOUBLE - latitude) / 0.5::DOUBLE) AS r, floor((longitude + 180.0::DOUBLE) / 0.5::DOUBLE) AS c, count(*)::DOUBLE AS v FROM osm_places WHERE {_POINT} GROUP BY r, c)
SELECT google_id, coalesce(v, 0.0::DOUBLE) AS places FROM practices_google LEFT JOIN px ON r = floor((90.0::DOUBLE - latitude) / 0.5::DOUBLE) AND c = floor((longitude + 180.0::DOUBLE) / 0.5::DOUBLE) WHERE {_POINT}""",
    "covariate_impute": """
WITH c AS (SELECT row_id, CASE WHEN settlement % 7 = 0 THEN NULL ELSE settlement::DOUBLE END AS s FROM covariates), m AS (SELECT avg(s) AS m FROM c)
SELECT row_id, floor(coalesce(s, m) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS settlement FROM c, m""",
    "residuals": _CELLS + ", m AS (SELECT avg(clinic_count) AS e FROM c) SELECT i, j, round(clinic_count - e, 6) AS resid_raw, round((clinic_count - e) / sqrt(e), 6) AS resid_pearson FROM c, m",
    "profile_minmax": " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS least, max({c}) AS most, round(avg({c}), 6) AS mean, count({c}) AS filled FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "resume_anti": "SELECT osm_key, osm_id FROM osm_places WHERE osm_id IS NOT NULL AND osm_id NOT IN (SELECT osm_id FROM osm_places WHERE country_code = 'CHE' AND osm_id IS NOT NULL)",
    "country_tiles": """
WITH q AS (SELECT iso, unnest(flatten(rings)) AS q FROM boundaries), b AS (SELECT iso, min(q.x) x0, min(q.y) y0, max(q.x) x1, max(q.y) y1 FROM q GROUP BY iso),
i AS (SELECT *, unnest(range(0, greatest(1, ceil((x1 - x0) / 0.25::DOUBLE - 1e-9)::INT))) AS i FROM b), t AS (SELECT *, unnest(range(0, greatest(1, ceil((y1 - y0) / 0.25::DOUBLE - 1e-9)::INT))) AS j FROM i)
SELECT iso, i::INT AS i, j::INT AS j, round(y0 + j * 0.25::DOUBLE, 6) AS south, round(x0 + i * 0.25::DOUBLE, 6) AS west, round(least(y0 + j * 0.25::DOUBLE + 0.25::DOUBLE, y1), 6) AS north, round(least(x0 + i * 0.25::DOUBLE + 0.25::DOUBLE, x1), 6) AS east FROM t""",
    "region_areas": """
WITH r AS (SELECT region_id, unnest(rings) AS ring FROM boundaries),
e AS (SELECT region_id, ring, unnest(list_transform(range(1, len(ring) + 1), lambda i: {'p': ring[i], 'q': ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END]})) AS e FROM r),
a AS (SELECT region_id, ring, abs(sum(e.p.x * e.q.y - e.q.x * e.p.y)) / 2 AS a FROM e GROUP BY region_id, ring)
SELECT region_id, round(sum(a), 6) AS area FROM a GROUP BY region_id""",
    "moran_of_residuals": _MORAN.replace("clinic_count - m AS z, v FROM c, s", "(clinic_count - m) / sqrt(m) AS z, v / m AS v FROM c, s") + " SELECT count(*) AS n, round(avg(local_i), 6) AS moran_i FROM q",
    "country_summary": "SELECT country_code, count(*) AS n, count(osm_id) AS elements, count(DISTINCT osm_id) AS distinct_elements FROM osm_places GROUP BY country_code",
}
