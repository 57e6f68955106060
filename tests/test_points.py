import math
import random

import numpy as np

from herdbook.operators.clusters import components, near_clusters
from herdbook.operators.points import EARTH_M, Slabs, containing_regions, near_pairs

SCHEMA = "k bigint, g string, lat double, lon double, key_a string"


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    s = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1, s)))


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lat, lon = rng.choice([(47.0, 8.0), (-39.0, 179.9999), (-39.0, -179.9999), (89.9999, 10.0), (0.0, 5.0)])
        rows.append((i, f"g{rng.randrange(200)}", lat + rng.uniform(-1, 1) * 6e-4, lon + rng.uniform(-1, 1) * 6e-4, "clash"))
    rows += [(900, "a", None, 8.0, ""), (901, "b", float("nan"), 8.0, ""), (902, "c", 0.0, 0.0, ""), (903, None, 47.0, 8.0, ""), (904, "d", 47.0, 8.0, ""), (905, "e", 47.0, 8.0, "")]
    got = {(r.key_a, r.key_b) for r in near_pairs(spark.createDataFrame(rows, SCHEMA), "k", "lat", "lon", 50.0, apart="g").collect()}
    ok = [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2] and (r[2], r[3]) != (0.0, 0.0)]
    want = {(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[1] != b[1] and metres(a[2:4], b[2:4]) <= 50}
    assert got == want and (904, 905) in got


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    regions = spark.createDataFrame([], "region_id bigint, rings array<array<struct<x:double,y:double>>>")
    assert near_pairs(empty, "k", "lat", "lon", 50.0).count() == 0
    assert containing_regions(empty, "k", "lat", "lon", regions, "region_id", "rings").count() == 0


def test_regions_with_openings_pieces_and_bad_rings(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ring = lambda ps, close=False, back=False: [{"x": float(a), "y": float(b)} for a, b in (ps[::-1] if back else ps) + ([(ps[::-1] if back else ps)[0]] if close else [])]
    regions = [(1, [ring(square(0, 0, 4), True), ring(square(1, 1, 1), False, True)]), (2, [ring(square(6, 0, 1)), ring(square(6, 3, 1), True)]), (3, [ring([(0, 0), (4, 4), (4, 0), (0, 4)])]), (4, None), (5, [[]]), (6, [ring([(0, 0), (1, 1)])])]
    r = spark.createDataFrame(regions, "region_id bigint, rings array<array<struct<x:double,y:double>>>")
    pts = [(10, 0.5, 0.5), (11, 1.5, 1.5), (12, 0.5, 6.5), (13, 3.5, 6.5), (14, 2.0, 6.5), (15, 2.0, 1.0), (16, 9.0, 9.0), (17, 2.1, 2.0)]
    p = spark.createDataFrame([(k, float(a), float(b), "x") for k, a, b in pts], "k bigint, lat double, lon double, region_id string")
    got = {(x.key_a, x.key_b) for x in containing_regions(p, "k", "lat", "lon", r, "region_id", "rings").collect()}

    def inside(px, py, ring_):
        odd = False
        for i in range(len(ring_)):
            a, b = ring_[i], ring_[(i + 1) % len(ring_)]
            if (a["y"] > py) != (b["y"] > py):
                lo, hi = (a, b) if a["y"] < b["y"] else (b, a)
                odd ^= px < lo["x"] + (hi["x"] - lo["x"]) * (py - lo["y"]) / (hi["y"] - lo["y"])
        return odd

    want = {(k, rid) for k, lat, lon in pts for rid, rings in regions if rings and sum(inside(lon, lat, x) for x in rings if len(x) > 2) % 2}
    assert got == want and (11, 1) not in got and (12, 2) in got


def test_slabs_with_crossing_edges():
    rng = np.random.default_rng(1)
    n = 40
    ring = rng.random((n, 2))  # a closed ring that crosses itself many times
    x, y = (np.stack([ring[:, k], np.roll(ring[:, k], -1)]) for k in (0, 1))
    low = y[0] < y[1]
    e = [np.where(low, x[0], x[1]), np.where(low, y[0], y[1]), np.where(low, x[1], x[0]), np.where(low, y[1], y[0])]
    s = Slabs(np.zeros(n, int), *e)
    px, py = rng.random(200), rng.random(200)
    at, _ = s.locate(px, py)
    cross = ((e[1][None] <= py[:, None]) & (py[:, None] < e[3][None]) & (px[:, None] < e[0][None] + (e[2] - e[0])[None] * (py[:, None] - e[1][None]) / (e[3] - e[1])[None])).sum(1)
    assert set(at) == set(np.flatnonzero(cross % 2))


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    n = 120
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(3, 3)]
    parent = {i: i for i in [*range(n), *range(200, 241)]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.k: r.cluster for r in components(spark.createDataFrame([(i,) for i in parent], "k bigint"), spark.createDataFrame(edges, "a bigint, b bigint"), "k", "a", "b").collect()}
    assert got == {i: root(i) for i in parent}


def test_chain_is_one_cluster_in_any_order(spark):
    rows = [(i, "x", 47.0 + i * 0.0003, 8.0, "") for i in range(6)] + [(9, "x", 47.1, 8.0, ""), (10, "x", None, None, "")]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = {r.k: r.cluster for r in near_clusters(spark.createDataFrame(rows, SCHEMA), "k", "lat", "lon").collect()}
        assert got == {**{i: 0 for i in range(6)}, 9: 9, 10: 10}


def test_regions_wider_than_a_tile_and_edges_round_the_globe(spark):
    ring = lambda *q: [{"x": float(x), "y": float(y)} for x, y in q]
    regions = [(1, [ring((-170, -80), (170, -80), (170, 80), (-170, 80)), ring((-1, -1), (1, -1), (1, 1), (-1, 1))]), (2, [ring((0.5, 0.1), (9.7, 0.2), (5, 70.3))])]
    r = spark.createDataFrame(regions, "rid bigint, rings array<array<struct<x:double,y:double>>>")
    rng = np.random.default_rng(5)
    p = [(int(i), float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-85, 85, 400), rng.uniform(-180, 180, 400)))] + [(1000, 0.5, 0.5), (1001, 0.0, 1.0), (1002, 30.0, 5.0)]
    got = {(a, b) for a, b in containing_regions(spark.createDataFrame(p, "k bigint, la double, lo double"), "k", "la", "lo", r, "rid", "rings").collect()}

    def inside(rings, x, y):
        n = 0
        for q in rings:
            for a, b in zip(q, q[1:] + q[:1]):
                (x1, y1), (x2, y2) = sorted([(a["x"], a["y"]), (b["x"], b["y"])], key=lambda t: t[1])
                n += y1 <= y < y2 and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1)
        return n % 2 == 1

    assert got == {(k, rid) for k, y, x in p for rid, rings in regions if inside(rings, x, y)}
