"""Queries of the general problems: points near points and regions (p1), filling missing values (p5)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdbook.operators.hotdeck import NO_VALUE_CODES, Deck, Gap, fill, hot_deck
from herdbook.operators.points import containing_regions, near_pairs
from herdbook.runtime import table

GAPS = [Gap("gdp", above=0, codes=NO_VALUE_CODES), Gap("acc", least=0, codes=NO_VALUE_CODES), Gap("urban", kind="class", above=0, below=100)]
DECK = Deck(key="row_id", cell="cell_id", area="admin_name", wide="iso", time="ref_year", features=("pop", "settlement", "ca", "ch", "pg", "sh"), classes=("urban",))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    places = table(spark, folder, "osm_places")
    near = near_pairs(places, "osm_key", "latitude", "longitude", 50.0, apart="osm_id")
    within = containing_regions(places, "osm_key", "latitude", "longitude", table(spark, folder, "boundaries"), "region_id", "rings")
    return near.select(F.lit("near").alias("relation_kind"), "key_a", "key_b").unionByName(within.select(F.lit("within").alias("relation_kind"), "key_a", "key_b"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hot_deck(table(spark, folder, "covariates"), GAPS, DECK).select("row_id", "field_name")


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    covariates = table(spark, folder, "covariates")
    return fill(covariates, hot_deck(covariates, GAPS, DECK), GAPS, "row_id").select("row_id", "cell_id", "ref_year", *(c for g in GAPS for c in (g.name, f"{g.name}_filled")))


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same gaps without their own cells: the blocks over area, time and features alone, as for a new cell."""
    return hot_deck(table(spark, folder, "covariates"), GAPS, replace(DECK, cell=None)).select("row_id", "field_name", "filled_value", "donor", "tier", "n_donors")


def _deck_sql(cells: bool) -> str:
    """The hot-deck by all pairs of a block, written on its own in SQL: CTEs up to `done` (k, field, tier, value, donor, n)."""
    feature = "CASE WHEN {0} IS NOT NULL AND NOT isnan({0}::DOUBLE) AND {0} >= 0 AND {0} < 1e30 THEN ln(1 + {0}::DOUBLE) END"
    feats = ["pop", "settlement", "ca", "ch", "pg", "sh"]
    fine = [f"CAST(floor(f{i} * 2) AS BIGINT)" for i in range(6)]
    blocks = [("area-time-mixed", ["a", "t", fine[0], fine[1], "c0"], 5), *((f"area-time-{n}", ["a", "t", f], 5) for n, f in zip(feats, fine)), ("area-time", ["a", "t"], 5), ("area-size", ["a", fine[0]], 5),
              ("wide-time-size", ["w", "t", fine[0]], 5), ("time-size", ["t", fine[0]], 5), ("size", ["CAST(floor(f0) AS BIGINT)"], 5), ("time", ["t"], 5), ("any", ["0"], 1)]
    blocks = [("cell", ["c"], 1), *blocks] if cells else blocks
    keyed = lambda source: " UNION ALL ".join(f"SELECT *, {i} AS level, {least} AS least, '{name}' AS tier, concat_ws('|', {', '.join(cols)}) AS block FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}" for i, (name, cols, least) in enumerate(blocks))
    off = [f"abs(g.f{i} - d.f{i})" for i in range(6)] + ["CASE WHEN g.c0 = d.c0 THEN 0 WHEN g.c0 <> d.c0 THEN 1 END"]
    return f"""
WITH base AS (SELECT row_id AS k, cell_id AS c, admin_name AS a, iso AS w, CAST(ref_year AS DOUBLE) AS t, {", ".join(feature.format(f) + f" AS f{i}" for i, f in enumerate(feats))},
                     CASE WHEN urban > 0 AND urban < 100 THEN urban END AS c0, gdp, acc, urban FROM covariates),
x AS (SELECT * EXCLUDE (gdp, acc, urban), 'gdp' AS field, gdp::DOUBLE AS v, coalesce(NOT isnan(gdp) AND gdp > 0 AND gdp < 1e30 AND gdp NOT IN (65535, 9999, 99999), false) AS ok FROM base
      UNION ALL SELECT * EXCLUDE (gdp, acc, urban), 'acc', acc::DOUBLE, coalesce(NOT isnan(acc) AND acc >= 0 AND acc < 1e30 AND acc NOT IN (65535, 9999, 99999), false) FROM base
      UNION ALL SELECT * EXCLUDE (gdp, acc, urban), 'urban', urban::DOUBLE, coalesce(urban > 0 AND urban < 100, false) FROM base),
gaps AS (SELECT * FROM x WHERE NOT ok), have AS (SELECT * FROM x WHERE ok),
gb AS ({keyed("gaps")}),
hb AS ({keyed("have")}),
sz AS (SELECT field, level, block, count(*) AS n FROM hb GROUP BY ALL),
ch AS (SELECT gb.* FROM gb JOIN sz USING (field, level, block) WHERE n >= least QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY level) = 1),
pairs AS (SELECT g.k, g.field, g.tier, d.k AS donor, d.v, floor((({" + ".join(f"coalesce({o}, 0)" for o in off)} + 0.5) / ({" + ".join(f"(CASE WHEN ({o}) IS NULL THEN 0 ELSE 1 END)" for o in off)} + 0.5) + 0.02 * abs(coalesce(g.t - d.t, 0))) * 1e6 + 0.5) / 1e6 AS dist
          FROM ch g JOIN hb d ON g.field = d.field AND g.level = d.level AND g.block = d.block),
near AS (SELECT *, 1 / (0.05 + dist) AS wt FROM pairs QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY dist, donor) <= 5),
mid AS (SELECT k, field, min(v) AS value FROM (SELECT k, field, v, sum(wt) OVER (PARTITION BY k, field ORDER BY v, wt, donor) AS run, sum(wt) OVER (PARTITION BY k, field) AS total FROM near) WHERE run >= total / 2 - 1e-9 GROUP BY ALL),
vote AS (SELECT k, field, v AS value FROM near GROUP BY k, field, v QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY round(sum(wt), 6) DESC, v) = 1),
pick AS (SELECT * FROM mid WHERE field <> 'urban' UNION ALL SELECT * FROM vote WHERE field = 'urban'),
done AS (SELECT n.k, n.field, min(n.tier) AS tier, min(p.value) AS value, arg_min(n.donor, (n.dist, n.donor)) FILTER (WHERE n.v = p.value) AS donor, count(*) AS n
         FROM near n JOIN pick p USING (k, field) GROUP BY ALL)"""


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_fill": p5_fill, "p5_blocks": p5_blocks}

SQL = {
    "p1_found": """
WITH pt AS (SELECT osm_key, osm_id, longitude x, latitude y FROM osm_places
            WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude) AND NOT (latitude = 0 AND longitude = 0)),
r AS (SELECT region_id, unnest(rings) AS ring FROM boundaries),
e AS (SELECT region_id, unnest(list_transform(range(1, len(ring) + 1), lambda i: {'p': ring[i], 'q': ring[CASE WHEN i = len(ring) THEN 1 ELSE i + 1 END]})) AS e FROM r),
f AS (SELECT region_id, CASE WHEN e.p.y < e.q.y THEN e.p.x ELSE e.q.x END x1, CASE WHEN e.p.y < e.q.y THEN e.q.x ELSE e.p.x END x2,
             least(e.p.y, e.q.y) y1, greatest(e.p.y, e.q.y) y2 FROM e WHERE e.p.y <> e.q.y),
w AS (SELECT osm_key, region_id FROM pt JOIN f ON y1 <= y AND y < y2 AND x < x1 + (x2 - x1) * (y - y1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT 'near' AS relation_kind, a.osm_key AS key_a, b.osm_key AS key_b
FROM pt a JOIN pt b ON a.osm_key < b.osm_key AND a.osm_id <> b.osm_id AND abs(a.y - b.y) < 0.0005
  AND 2 * 6371000 * asin(sqrt(pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2))) <= 50
UNION ALL SELECT 'within', osm_key, region_id FROM w""",
    "p5_found": """
SELECT row_id, 'gdp' AS field_name FROM covariates WHERE gdp IS NULL OR isnan(gdp) OR gdp <= 0 OR gdp > 1e30 OR gdp IN (65535, 9999, 99999)
UNION ALL SELECT row_id, 'acc' FROM covariates WHERE acc IS NULL OR isnan(acc) OR acc < 0 OR acc > 1e30 OR acc IN (65535, 9999, 99999)
UNION ALL SELECT row_id, 'urban' FROM covariates WHERE urban IS NULL OR urban <= 0 OR urban >= 100""",
    "p5_fill": _deck_sql(True) + """
SELECT row_id, cell_id, ref_year, CAST(CASE WHEN gg.k IS NULL THEN gdp ELSE gd.value END AS FLOAT) AS gdp, gd.value IS NOT NULL AS gdp_filled, CAST(CASE WHEN ga.k IS NULL THEN acc ELSE ad.value END AS FLOAT) AS acc,
       ad.value IS NOT NULL AS acc_filled, CAST(CASE WHEN gu.k IS NULL THEN urban ELSE ud.value END AS INT) AS urban, ud.value IS NOT NULL AS urban_filled
FROM covariates LEFT JOIN (SELECT k FROM gaps WHERE field = 'gdp') gg ON gg.k = row_id LEFT JOIN (SELECT k FROM gaps WHERE field = 'acc') ga ON ga.k = row_id LEFT JOIN (SELECT k FROM gaps WHERE field = 'urban') gu ON gu.k = row_id
LEFT JOIN done gd ON gd.k = row_id AND gd.field = 'gdp' LEFT JOIN done ad ON ad.k = row_id AND ad.field = 'acc' LEFT JOIN done ud ON ud.k = row_id AND ud.field = 'urban'""",
    "p5_blocks": _deck_sql(False) + """
SELECT g.k AS row_id, g.field AS field_name, value AS filled_value, donor, coalesce(tier, 'none') AS tier, CAST(coalesce(n, 0) AS INT) AS n_donors FROM gaps g LEFT JOIN done USING (k, field)""",
}
