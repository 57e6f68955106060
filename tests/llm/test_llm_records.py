import math
import os
import random

import pytest
from pyspark.sql import functions as F

from herdbook.llm import addresses, entities, queries, survivor
from oracle import DATA, same

have = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@have
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, queries.QUERIES[name], queries.SQL[name])


@have
@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p7_found", "p8_space", "p9_shares", "p3_found", "p10_found"])
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and (rows or name == "p10_found")


def test_truth_discovery_trusts_the_reliable(spark):
    rows = []
    for g in range(40):  # good and fair agree; bad is on its own though it has the highest stated trust
        rows += [(g * 3, g, "good", f"v{g}", None, 1), (g * 3 + 1, g, "fair", f"V{g} ", None, 1), (g * 3 + 2, g, "bad", f"wrong{g}", None, 1)]
    rows += [(900, 90, "good", "only", None, 1), (901, 91, "good", None, None, 1), (902, 91, "fair", "n/a", None, 1), (903, None, "good", "x", None, 1), (904, 92, "nobody", "z", None, 1), (905, 92, None, "z", None, 1)]
    df = spark.createDataFrame(rows, "id bigint, grp bigint, origin string, name string, at timestamp, support int")
    prior = spark.createDataFrame([("good", 3), ("fair", 3), ("bad", 4)], "origin string, trust int")
    run = lambda d: survivor.survivors(d, "grp", "id", "origin", prior, "trust", "at", [survivor.plain_field("name")])
    got = {r.grp: r for r in run(df).collect()}
    assert all(got[g].value.strip().lower() == f"v{g}" for g in range(40))
    assert set(got) == set(range(40)) | {92}
    assert run(df.where("false")).count() == 0


def test_survivor_rules_and_ties(spark):
    rows = [(1, 1, "a", "x, y", "2024-01-01"), (2, 1, "b", "x", "2024-02-01"), (3, 1, "b", "y, x", None), (4, 1, "a", "x,y", "2024-03-01"), (5, 1, "a", "y", None)]
    df = spark.createDataFrame(rows, "id bigint, grp bigint, origin string, spec string, at string").withColumn("at", F.to_timestamp("at"))
    prior = spark.createDataFrame([("a", 3), ("b", 1)], "origin string, trust int")
    n = F.size(F.split("spec", ","))
    out = survivor.survivors(df, "grp", "id", "origin", prior, "trust", "at", [survivor.Field("spec", F.col("spec"), F.col("spec"), F.col("spec").isNotNull(), rank=n)]).collect()
    assert [(r.id, r.value) for r in out] == [(4, "x,y")]


ADDRESSES = [
    (1, "Kirchfeldweg 12, 8001 Oberdorf", None, None, 0), (2, "12 Kirchfeld-Weg - 8001 Oberdorf", None, None, 0), (3, "Kirchfeldwg. Nr. 12", "8001", "Oberdorf", 0), (4, "Kirchfedlweg 12, 2. OG, CH-8001 Oberdorf, Schweiz", None, None, 0),
    (5, "Kirchfeldweg 12a, 8001 Oberdorf", None, None, 0), (6, "Kirchfeldgasse 12, 8001 Oberdorf", None, None, 0), (7, "Kirchfeldweg 12, 9000 Niederwil", None, None, 0), (8, "Kirchfeldweg 112, 8001 Oberdorf", None, None, 0),
    (9, None, None, None, 0), (10, "", "8001", "Oberdorf", 0), (11, "auf Anfrage", None, None, 0), (12, "Kirchfeldweg 12", None, "Oberdorf", 0), (13, "x" * 50_000, None, None, 0), (14, "Kirchfeldweg 12, 9000 Niederwil", None, None, 0)]
ADDRESS = "address_id bigint, address string, plz string, ort string, class int"


def test_addresses(spark):
    df = spark.createDataFrame(ADDRESSES, ADDRESS)
    got = {(r.key_a, r.key_b) for r in addresses.same_address(df, "address_id", "address", "plz", "ort").collect()}
    same_ = [1, 2, 3, 4, 12]
    assert got == {(a, b) for a in same_ for b in same_ if a < b} | {(7, 14)}
    assert addresses.same_address(df.where("false"), "address_id", "address", "plz", "ort").count() == 0


def test_address_parts():
    assert addresses.parse("c/ Puente Alta 21C, 1º piso, E-04490 Campo, España", None, None)[:3] == ("21c", "04490", "calle")
    assert addresses.parse("328 C/ Puente del Sauce", None, None)[0] == "328"
    assert addresses.parse("sur demande", None, None) is None


def test_entities(spark):
    cols = "google_id bigint, name string, address string, latitude double, longitude double, website string, score int"
    a = [(1, "Tierarztpraxis Rosenau", "Kirchweg 4, 8001 Oberdorf", 47.1, 8.1, "https://www.rosenau.example/", 0), (2, "Kleintierpraxis Belwyl", "Kirchweg 4, 8001 Oberdorf", 47.1, 8.1, None, 0),
         (3, "Petgroup", "Seestrasse 9, 9000 Niederwil", 47.4, 9.3, "https://petgroup.example/", 0), (4, "Ganz Neuer Name", "Hofweg 7, 8001 Oberdorf", 47.11, 8.11, "https://www.alt.example", 0), (5, None, None, None, None, None, 0), (6, "", " ", float("nan"), 0.0, "", 0)]
    b = [(10, "Rosenau Tierarztpraxis", "4, Kirchweg, Oberdorf 8001", 47.1001, 8.1001, None, 0), (11, "Kleintierpraxis Belwly", "Kirchweg 4, 8001 Oberdorf", 47.1, 8.1, None, 0), (12, "Petgroup", "Hauptstrasse 1, 7000 Chur", 46.8, 9.5, "http://petgroup.example", 0),
         (13, "Tierklinik Altdorf", "Hofweg 7, 8001 Oberdorf", 47.11, 8.11, "http://alt.example/index.html", 0), (14, "Rosenau Tierarztpraxis", "4, Kirchweg, Oberdorf 8001", 47.1001, 8.1001, None, 0), (15, None, None, None, None, None, 0)]
    left, right = spark.createDataFrame(a, cols), spark.createDataFrame([r for r in b], cols.replace("google_id", "osm_key"))
    out = entities.match(entities.Source(left, "google_id"), entities.Source(right, "osm_key")).collect()
    got = {(r.key_a, r.key_b) for r in out if r.match}
    assert got == {(1, 10), (1, 14), (2, 11), (4, 13)}
    assert all(0 <= r.confidence <= 1 and (r.confidence > 0.5) == r.match for r in out)
    assert entities.match(entities.Source(left.where("false"), "google_id"), entities.Source(right, "osm_key")).count() == 0


def test_hamming_buckets_are_exact():
    import random

    rng = random.Random(1)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), entities.BANDS - 1):
            y ^= 1 << bit
        assert any((x >> 8 * i) & 255 == (y >> 8 * i) & 255 for i in range(entities.BANDS))


def test_entities_without_a_common_place(spark):
    cols = "google_id bigint, name string, address string, latitude double, longitude double, website string"
    a = [(1, "Tierarztpraxis Rosenau", "Kirchfeldweg 4, 8001 Oberdorf", None, None, None), (2, "Kleintierpraxis Belwyl", "Lindenhofstrasse 9, 7000 Chur", 47.2, 8.2, None),
         (3, "Tierklinik Morgenthal", None, 46.0, 9.0, None), (4, "Praxis Zum Hirschen", "Seegasse 3, 6000 Altwil", None, None, "https://hirschen.example"), (5, "Pferdeklinik Sonnmatt", "Brunnenweg 12, 8010 Oberdorf", 47.0, 8.0, None)]
    b = [(10, "Tierarztpraxis Rosenau", "Kirchfeldweg 4", 47.1, 8.1, None), (11, "Kleintierpraxis Belwyl", "Lindenhofstrasse 9, Chur", 45.9, 9.9, None), (12, "Tierklinik Morgenthal", None, 46.013, 9.0, None),
         (13, "Praxis Hirschenn", None, 46.5, 8.8, "http://www.hirschen.example/"), (14, "Pferdeklinik Sonnmatt", "Brunnenweg 12, 8016 Oberdorf", 49.0, 8.0, None), (15, "Pferdeklinik Sonnmatt", "Brunnenweg 13", 49.0, 8.0, None)]
    out = entities.match(entities.Source(spark.createDataFrame(a, cols), "google_id"), entities.Source(spark.createDataFrame(b, cols.replace("google_id", "osm_key")), "osm_key")).collect()
    assert {(r.key_a, r.key_b) for r in out if r.match} == {(1, 10), (2, 11), (3, 12), (4, 13), (5, 14)}


@have
def test_entities_lose_no_pair_that_scores(spark):
    from herdbook.runtime import table

    a = entities.Source(table(spark, DATA, "practices_google"), "google_id")
    b = entities.Source(table(spark, DATA, "osm_places").where("osm_id IS NOT NULL"), "osm_key")
    generic = entities._generic([a, b])
    ra, rb = entities._records(a, generic), entities._records(b, generic)
    chains = ra.unionByName(rb).where("host <> ''").groupBy("host").agg(F.approx_count_distinct(F.when((F.col("code") != "") | (F.col("town") != ""), F.concat_ws("|", F.coalesce(F.nullif("code", F.lit("")), F.col("town")), "number")), 0.05).alias("n")).where("n >= 4").select("host", F.lit(True).alias("chain"))
    every = entities._side(ra.join(chains, "host", "left"), "a").crossJoin(entities._side(rb, "b"))
    true = {(r.key_a, r.key_b) for r in entities._scored(every, entities.Weights()).where("score > 0").collect()}
    assert true == {(r.key_a, r.key_b) for r in entities.match(a, b).where("match").collect()}


def test_truth_discovery_finds_planted_truths(spark):
    rng = random.Random(4)
    right = {"a": 0.92, "b": 0.88, "c": 0.35, "d": 0.35, "e": 0.35}
    rows, truth = [], {}
    for g in range(600):
        truth[g] = f"v{rng.randrange(1000)}"
        for s, p in right.items():
            rows.append((g * 10 + ord(s), g, s, truth[g] if rng.random() < p else f"x{g}.{rng.randrange(2)}", None))
    df = spark.createDataFrame(rows, "id bigint, grp bigint, origin string, name string, at timestamp")
    prior = spark.createDataFrame([(s, 1) for s in right], "origin string, trust int")
    run = lambda rounds: {r.grp: r.value for r in survivor.survivors(df, "grp", "id", "origin", prior, "trust", "at", [survivor.plain_field("name")], rounds=rounds).collect()}
    share = lambda got: sum(got[g] == v for g, v in truth.items()) / len(truth)
    known = {}  # the same vote with the true reliabilities
    for g in truth:
        w = {}
        for _, h, s, v, _ in rows[g * 5:g * 5 + 5]:
            w[v] = w.get(v, 0.0) - math.log(1 - right[s])
        known[g] = max(w, key=w.get)
    votes, found, best = share(run(0)), share(run(8)), share(known)
    assert found > votes + 0.05 and found > best - 0.01, (votes, found, best)


def test_hot_addresses_are_one_class(spark):
    n = 20_000  # a third and more of all rows say the same; classes and links don't grow with them
    rows = [(i, "Hauptstrasse 5, 8001 Zürich", None, None) for i in range(n)] + [(n, "Haupstr. 5", "8001", "Zürich"), (n + 1, "Hauptstrasse 5a, 8001 Zürich", None, None), (n + 2, None, None, None)]
    rows += [(n + 10 + i, f"Gartenweg {i % 400}, {8000 + i % 7} Ort{i % 7}", None, None) for i in range(2_000)]
    members, links = addresses.places(spark.createDataFrame(rows, "id bigint, address string, plz string, ort string"), "id", "address", "plz", "ort")
    by = {r.key: r["class"] for r in members.where(f"key IN (0, {n - 1}, {n}, {n + 1}, {n + 2})").collect()}
    assert by[0] == by[n - 1] and by[n] != by[0] != by[n + 1] and n + 2 not in by
    assert {frozenset((r.class_a, r.class_b)) for r in links.collect()} == {frozenset((by[0], by[n]))}


def test_stated_orders_need_no_rounds(spark, monkeypatch):
    calls, real = [], survivor.cut
    monkeypatch.setattr(survivor, "cut", lambda d: calls.append(1) or real(d))
    rows = [(1, 1, "a", "x, y", "u"), (2, 1, "b", "x", "v"), (3, 1, "c", "y, x", "v"), (4, 2, "a", None, "w"), (5, 2, "b", "z", None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "id bigint, grp bigint, origin string, spec string, name string, at timestamp")
    prior = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1)], "origin string, trust int")
    spec = survivor.Field("spec", F.col("spec"), F.col("spec"), F.col("spec").isNotNull(), rank=F.size(F.split("spec", ",")))
    run = lambda fields: {(r.grp, r.field_name): (r.id, r.value, r.support is None) for r in survivor.survivors(df, "grp", "id", "origin", prior, "trust", "at", fields).collect()}
    stated = {(1, "spec"): (1, "x, y", True), (2, "spec"): (5, "z", True)}
    assert run([spec]) == stated and len(calls) == 1  # the table of sources
    both = run([spec, survivor.plain_field("name")])
    assert {k: v for k, v in both.items() if k[1] == "spec"} == stated and both[2, "name"] == (4, "w", False)
    assert len(both) == 4 and len(calls) > 2


def test_hamming_search_is_the_same_in_crowded_places(spark, monkeypatch):
    rng = random.Random(8)
    name = lambda: rng.choice(["Tierarztpraxis", "Kleintierpraxis", "Tierklinik"]) + " " + "".join(rng.choice(["ros", "bel", "kel", "mir"]) for _ in range(2))
    rows = [(i, name(), f"Seeweg {i % 50}, {8000 + i % 3} Ort{i % 3}", 47.0 + i % 3 / 10, 8.0, f"https://h{i % 20}.example/") for i in range(240)]
    cols = "key bigint, name string, address string, latitude double, longitude double, website string"
    a, b = (entities.Source(spark.createDataFrame(rows[k::2], cols), "key") for k in (0, 1))
    made, real = [], entities._keys
    monkeypatch.setattr(entities, "_keys", lambda *x: made.append(real(*x)) or made[-1])
    run = lambda: {(r.key_a, r.key_b, round(r.score, 6), round(r.confidence, 6), r.match) for r in entities.match(a, b).collect()}
    found = run()
    assert all(k.count() <= 7 * 120 for k in made)  # a bucket for each place and host, not for each band
    monkeypatch.setattr(entities, "CROWDED", 10)
    assert found and run() == found and made[-1].count() > 7 * 120
