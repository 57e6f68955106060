import random

from pyspark.sql import functions as F

from herdbook.functions import fuzzy, html, text, url
from herdbook.operators import classify, fuzzyjoin, grid, relational
from herdbook.sources import readers, sinks


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def out(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_url_rules(spark):
    df = col(spark, ["https://x.ch/a/menu.pdf", "https://a.de/", "https://a.com/", "https://a.co.uk/", " NaN ", None, "ftp://a.ch", "https://localhost/", "HTTPS://WWW.A.CH/Team"])
    assert [r[0] for r in out(df, url.clean(F.col("x"), "ch"))] == ["https://x.ch/", None, "https://a.com/", None, None, None, None, None, "https://www.a.ch/team"]
    df = col(spark, ["https://hotel-vet.ch/", "https://www.facebook.com/x", None])
    assert out(df, url.blocked_exactly(F.col("x")), url.blocked_loosely(F.col("x"))) == [(False, True), (True, True), (False, False)]
    df = col(spark, ["b.html", "/c", "//h.ch/d", "https://z.ch/"])
    assert [r[0] for r in out(df, url.joined(F.lit("https://a.ch/x/y"), F.col("x")))] == ["https://a.ch/x/b.html", "https://a.ch/c", "https://h.ch/d", "https://z.ch/"]


def test_text_rules(spark):
    df = col(spark, ["  Éß-ﬁ, X ", None, "", " "])
    assert [r[0] for r in out(df, text.fold_words(F.col("x")))] == ["e fi x", None, "", ""]
    assert [r[0] for r in out(df, text.fold_hyphens(F.col("x")))] == ["e fi, x", "", "", ""]
    df = col(spark, [None, "Horses, small animals", " "])
    assert [r[0] for r in out(df, text.species_flag(F.col("x"), "horses"))] == [None, True, None]
    texts = ["x" * 250, "Verifying you are human " + "x" * 250, "waiting for a.ch to respond " + "x" * 250, "captcha " + "x" * 250, "x", None]
    assert [r[0] for r in out(col(spark, texts), text.valid_content(F.col("x")))] == [True, False, False, True, False, False]
    df = col(spark, [None, 0.0, 19999.0, 20000.0, 99999.0, 300000.0, 1000000.0], "double")
    assert [r[0] for r in out(df, relational.population_radius(F.col("x")))] == [20000, 20000, 15000, 25000, 25000, 50000, 65000]


def test_replies(spark):
    df = col(spark, ['Here: [{"Role":"Doctor","Gender":"Female"}] ok', "no list", "[]", None, '[{"Role":"x"}]'])
    got = out(df.select(classify.people(F.col("x")).alias("p")), *classify.team_counts(F.col("p")).values())
    assert got == [(1, 0, 0, 0), (None,) * 4, (None,) * 4, (None,) * 4, (None,) * 4]


def slow_lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, t[j + 1] = t[j + 1], last + 1 if x == y else max(t[j + 1], t[j])
    return t[-1]


def test_ratio_and_prefilter_lose_nothing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    words += [w[:i] + rng.choice("abc") + w[i + 1:] for w in words[:40] if w for i in [rng.randrange(len(w))]]
    for a in words[:30]:
        for b in words:
            assert fuzzy.lcs(a, b) == slow_lcs(a, b)
    left = spark.createDataFrame(list(enumerate(words)), "a bigint, x string")
    right = spark.createDataFrame(list(enumerate(reversed(words))), "b bigint, y string")
    got = {(r.a, r.b): round(r.score, 6) for r in fuzzyjoin.similar_pairs(left, right, "a", "b", "x", "y", 85).collect()}
    norm = lambda t: " ".join(sorted(t.split()))
    want = {(i, j): round(fuzzy.indel_ratio(norm(x), norm(y)), 6) for i, x in enumerate(words) for j, y in enumerate(reversed(words)) if norm(x) and norm(y) and fuzzy.indel_ratio(norm(x), norm(y)) >= 85}
    assert got == want
    best = {}
    for (i, j), s in sorted(want.items()):
        if i not in best or s > best[i][1]:
            best[i] = (j, s)
    taken, greedy = set(), {}
    for i in sorted(best):
        if best[i][0] not in taken:
            taken.add(best[i][0])
            greedy[i] = best[i][0]
    assert {r.a: r.b for r in fuzzyjoin.best_match(left, right, "a", "b", "x", "y", 85).collect()} == greedy
    assert fuzzyjoin.best_match(left.where("false"), right, "a", "b", "x", "y").count() == 0


def test_keep_first_and_nulls(spark):
    df = spark.createDataFrame([("A", 2), (None, 1), ("A", 1), (None, 3)], "name string, o int")
    assert sorted(map(tuple, relational.keep_first(df, ["name"], ["o"]).collect()), key=repr) == [("A", 1), (None, 1)]
    assert relational.keep_first(df.where("false"), ["name"], ["o"]).count() == 0
    s = spark.createDataFrame([("OPERATIONAL",), ("CLOSED",), (None,)], "s string")
    a, b = relational.split_by(s, F.col("s") == "OPERATIONAL")
    assert (a.count(), b.count()) == (1, 2)


def test_html(spark):
    page = '<body><nav>Menu</nav><div class="cookie-bar">Cookies</div><div id="content"><h1>Hi &amp; ho</h1><p>Text <b>x</b></p><script>bad()</script></div></body>'
    df = col(spark, [page, None, ""])
    assert [r[0] for r in out(df, html.main_text(F.col("x")))] == ["Hi & ho Text x", None, ""]
    assert [r[0] for r in out(df, html.full_text(F.col("x")))][0].startswith("Menu Cookies Hi")


def test_laea_there_and_back(spark):
    df = spark.createDataFrame([(52.0, 10.0), (50.0, 5.0), (47.37, 8.54), (69.0, 20.0)], "lat double, lon double")
    x, y = grid.to_laea(F.col("lat"), F.col("lon"))
    lat, lon = grid.from_laea(F.col("px"), F.col("py"))
    rows = df.select("lat", "lon", x.alias("px"), y.alias("py")).select("*", lat.alias("lat2"), lon.alias("lon2")).collect()
    assert abs(rows[0].px - 4321000) < 1e-3 and abs(rows[0].py - 3210000) < 1e-3
    assert abs(rows[1].px - 3962799.45) < 0.01 and abs(rows[1].py - 2999718.85) < 0.01  # the example point of the projection's public definition
    assert all(abs(r.lat - r.lat2) < 1e-8 and abs(r.lon - r.lon2) < 1e-8 for r in rows)


def test_nearest_cell_raster_and_moran(spark):
    cells = spark.createDataFrame([(0, 0, 4), (1, 0, 5), (5, 5, 0), (9, 9, 1)], "i int, j int, n int")
    p = spark.createDataFrame([(1, 0, 0), (2, 3, 3), (3, 2, 0), (4, 500, 500)], "k int, i int, j int")
    got = {r.k: (r.i, r.j) for r in grid.nearest_cells(p, "k", cells).collect()}
    assert got == {1: (0, 0), 2: (5, 5), 3: (1, 0), 4: (9, 9)}
    r = {(x.row, x.col): x.value for x in grid.rasterize(cells.where("i < 2"), "n", spark, 2, 2, -9.0).collect()}
    assert r == {(1, 0): 4.0, (1, 1): 5.0, (0, 0): -9.0, (0, 1): -9.0}
    m = {(x.i, x.j): x.quadrant for x in grid.local_moran(cells, "n").collect()}
    assert m[0, 0] == "High-High" and m[9, 9] == "None"


def test_elements_and_sinks(spark, tmp_path):
    rows = [("way", 7, None, None, None, {"amenity": "veterinary", "name": "A", "addr:street": "S", "addr:housenumber": "1", "website": "", "contact:website": "w"}, [{"lat": 2.0, "lon": 4.0}, {"lat": None, "lon": None}]), ("node", 8, 1.0, 2.0, None, {"amenity": "cafe"}, None)]
    got = readers.places_of(spark.createDataFrame(rows, readers.ELEMENT)).collect()
    assert [tuple(r) for r in got] == [("way/7", "A", "S 1", 1.0, 2.0, "w")]
    df = spark.createDataFrame([(1, 2.005, "a\nb"), (2, None, None)], "k int, v double, t string")
    sinks.write_csv(df, str(tmp_path / "c"), decimals=1)
    back = {r.k: (r.v, r.t) for r in readers.csv(spark, str(tmp_path / "c"), "k int, v string, t string").collect()}
    assert back[1] == ("2.0", "a\nb")
    path = str(tmp_path / "p")
    df.write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
    ok, failed = readers.csv_files(spark, [str(tmp_path / "c"), str(tmp_path / "none")], ["K", "T"])
    assert ok.count() == 2 and list(failed) == [str(tmp_path / "none")]


def test_paged_search(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"tile": "t", "page": 1, "places": [{"placeId": "p", "displayName": {"text": "N"}, "location": {"latitude": 1.5}}, {}]}\n')
    spark.dataSource.register(readers.PagedSearch)
    rows = spark.read.format("paged_search").option("path", str(tmp_path)).load().collect()
    assert [r.place_id for r in rows] == ["p", None] and rows[0].latitude == 1.5


def test_stream_of_new_keys(spark, tmp_path):
    from herdbook.streaming.incremental import append_to, new_keys

    src, dst, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS t UNION ALL SELECT 'a', timestamp'2024-01-01 01:00:00' UNION ALL SELECT 'b', timestamp'2024-01-01 00:00:00'").write.parquet(src)
    stream = spark.readStream.schema("k string, t timestamp").parquet(src)
    append_to(new_keys(stream, ["k"], "t"), dst, chk).awaitTermination(60)
    assert spark.read.parquet(dst).count() == 2


def test_profiles_and_labels(spark):
    main = "The team of the practice is here every day of the week and helps"
    rows = [("s", "u2", "Anna is a vet and likes cats", main, "x"), ("s", "u1", " ", main, "x"), ("s", "u3", main[:60], main, "x"), ("t", "u4", None, "only", "x")]
    df = spark.createDataFrame(rows, "site string, url string, text string, main string, merged string")
    got = {r.site: r.merged for r in classify.merged_profiles(df, "site", "url", "text", "main").collect()}
    assert got == {"s": f"{main}\n\n[Page: u2]\nAnna is a vet and likes cats", "t": "only"}
    df = col(spark, ["Accept all", "Zustimmne", "Mehr", None])
    assert [r[0] for r in out(df, classify.cookie_label(F.col("x")))] == [True, True, False, False]


def test_best_page_and_links(spark):
    rows = [("s", "https://s.ch/team", 5, True), ("s", "https://s.ch/x", 50, False), ("t", "https://t.ch/a", 0, False), ("u", "https://u.ch/a", 3, False), ("u", "https://u.ch/b", 9, False), ("v", "https://v.ch/t1", 3, True), ("v", "https://v.ch/t2", 9, True)]
    df = spark.createDataFrame(rows, "site string, url string, score int, pref boolean")
    got = {r.site: r.best for r in classify.best_page(df, "site", "url", "score", "pref", F.concat(F.lit("home "), F.col("site"))).collect()}
    assert got == {"s": "https://s.ch/team", "t": "home t", "u": "https://u.ch/b", "v": "https://v.ch/t2"}
    page = '<a href="/team">Team</a><a href="/team#x">Again</a><a href="https://o.ch/">Other</a><a href="/f.pdf">File</a><a href="#top">Top</a><a href="/app?os=x">App</a>'
    df = spark.createDataFrame([("https://s.ch/", page)], "url string, html string").select("url", html.links(F.col("html")).alias("l"))
    assert [(r.href, r.anchor) for r in classify.site_links(df, "url", "l").collect()] == [("https://s.ch/team", "Again")]


def test_lookups(spark):
    df = spark.createDataFrame([(1, "q1", None, None, None), (2, "q2", 1.0, 2.0, " "), (3, None, None, None, "A")], "k int, query string, latitude double, longitude double, address string")
    a, b = (spark.createDataFrame(r, "query string, lat double, lon double") for r in ([("q9", 0.0, 0.0)], [("q1", 5.0, 6.0), ("q2", 9.0, 9.0)]))
    got = {r.k: (r.latitude, r.longitude) for r in readers.geocoded(df, "query", [a, b]).collect()}
    assert got == {1: (5.0, 6.0), 2: (1.0, 2.0), 3: (None, None)}
    places = spark.createDataFrame([(1.00001, 2.0, "R", "4", "", None, "T", "V", "CH")], "lat double, lon double, road string, house_number string, postcode string, city string, town string, village string, country string")
    got = {r.k: r.address for r in readers.reverse_geocoded(df, places).collect()}
    assert got == {1: None, 2: "R, 4, T, CH", 3: "A"}
    results = spark.createDataFrame([("q1", 1, "https://facebook.com/x"), ("q1", 2, "https://a.ch/")], "query string, rank int, url string")
    got = {r.k: r.found for r in readers.first_result(df, results, "query", lambda u: ~url.blocked_exactly(u)).collect()}
    assert got == {1: "https://a.ch/", 2: None, 3: None}


def test_updates_caps_and_checks(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), (None, 3, "x"), ("b", 4, "y")], "name string, o int, v string")
    up = spark.createDataFrame([("a", "new"), ("b", None)], "name string, v string")
    assert {r.o: r.v for r in relational.update_first(df, up, "name", "o", ["v"]).collect()} == {1: "new", 2: None, 3: "x", 4: "y"}
    run = relational.within_cap(df, "o", F.lit(2), 6).collect()
    assert sorted((r.o, r.running) for r in run) == [(1, 2), (2, 4), (3, 6)]
    parts = df.groupBy("name").count()
    assert relational.check_total(parts, "count", df).count() == 3
    try:
        relational.check_total(parts, "count", df.limit(2)).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "rows were lost" in str(e)
    assert relational.align(spark.createDataFrame([(1, "n")], "`E-Mail` int, Names string"), ["Name", "Email", "City"]).collect()[0].asDict() == {"Name": "n", "Email": 1, "City": ""}


def test_poisson_fit_finds_coefficients(spark):
    import numpy as np

    from herdbook.operators import model

    rng = np.random.default_rng(0)
    rows = [(int(rng.poisson(np.exp(-1 + 0.8 * x) * 3.0)), 3.0, float(x)) for x in rng.normal(size=1500)] + [(3, 3.0, None)]
    out_, coef = model.poisson_fit(spark.createDataFrame(rows, "n int, area double, x double"), "n", "area", ["x"])
    c = {r.name: r.estimate for r in coef.collect()}
    assert abs(c["(Intercept)"] + 1) < 0.1 and abs(c["x"] - 0.8) < 0.1
    assert out_.where("resid_raw IS NULL").count() == 0


def test_square_cells_keep_slivers(spark):
    # a block of 9.9 km with a strip 400 m high, below the lowest probes, that reaches into the next square
    corners = [(0, 0), (18_000, 0), (18_000, 400), (9_900, 400), (9_900, 9_900), (0, 9_900)]
    df = spark.createDataFrame([(k, 4_300_000.0 + x, 3_200_000.0 + y) for k, (x, y) in enumerate(corners)], "k int, x double, y double")
    lat, lon = grid.from_laea(F.col("x"), F.col("y"))
    ring = [(r.lon, r.lat) for r in df.select("k", lat.alias("lat"), lon.alias("lon")).orderBy("k").collect()]
    far = [(x + 1.0, y) for x, y in ring]
    rows = [(1, "AAA", [ring]), (2, "BBB", [[*far, far[0]]])]
    b = spark.createDataFrame(rows, "region_id bigint, iso string, rings array<array<struct<x double, y double>>>")
    got = {(r.cell_id, r.i, r.j): r.share for r in grid.square_cells(b.where("iso = 'AAA'"), "iso", "region_id", "rings").collect()}
    assert set(got) == {("AAA_1", 0, 0), ("AAA_2", 1, 0)} and got["AAA_1", 0, 0] == 1 and got["AAA_2", 1, 0] == 0
    assert grid.square_cells(b, "iso", "region_id", "rings").where("code = 'BBB'").count() >= 2


def test_links_of_a_page_fetched_twice(spark, tmp_path):
    from herdbook.plans import survey

    pages = [(1, "https://s.ch/", '<a href="/team">Team</a>'), (2, "https://s.ch/", '<a href="/preise">Preise</a>'), (3, "https://s.ch/", None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/site_pages.parquet")
    assert sorted(r.href for r in survey.site_link_table(spark, str(tmp_path)).collect()) == ["https://s.ch/preise", "https://s.ch/team"]


def test_reaches_equals_the_best_window():
    rng = random.Random(5)
    hits = 0
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40)))
        for percent in (70, 85, 95):
            want = fuzzy.best_window(w, t) >= percent
            assert fuzzy.reaches(w, t, percent) == want, (w, t, percent)
            hits += want
    assert hits > 300


def test_nearest_occupied_is_exact_however_far(spark):
    rng = random.Random(6)
    cells = {(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(25)} | {(900, 5)}
    pts = [(k, rng.uniform(-300, 700), rng.uniform(-300, 300)) for k in range(150)] + [(500, None, 1.0)]
    got = {r.k: (r.i, r.j) for r in grid.nearest_occupied(spark.createDataFrame(pts, "k int, x double, y double"), "k", "x", "y", spark.createDataFrame(list(cells), "i int, j int")).collect()}
    far = lambda v, c: max(c - v, v - c - 1, 0.0)
    for k, x, y in pts[:-1]:
        assert got[k] == min((far(x, i) ** 2 + far(y, j) ** 2, i, j) for i, j in cells)[1:]
    assert got[500] == (None, None)
    assert grid.nearest_occupied(spark.createDataFrame(pts, "k int, x double, y double"), "k", "x", "y", spark.createDataFrame([], "i int, j int")).where("i IS NOT NULL").count() == 0


def test_row_numbers_and_texts_by_key(spark, tmp_path):
    from herdbook.sources import readers, sinks

    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)], "id int, v int")
    assert all(r.no == r.v for r in relational.row_numbers(df, ["v"], "no").collect())
    texts = spark.createDataFrame([("a b", "one\ntwo"), ("c", '{"n": 1}'), (None, "x"), ("d", None)], "name string, text string")
    sinks.write_texts(texts, str(tmp_path / "t"), "name", "text")
    assert {(r.name, r.text) for r in readers.texts(spark, str(tmp_path / "t"), "name").collect()} == {("a b", "one\ntwo"), ("c", '{"n": 1}'), ("d", "")}
