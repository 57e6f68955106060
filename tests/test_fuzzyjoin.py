import random

from herdbook.functions import fuzzy
from herdbook.operators import fuzzyjoin


def shuffled(spark):
    """Bytes of shuffle written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def practices(rng, n):
    """Names that share most of their n-grams."""
    part = lambda: rng.choice(["lom", "hil", "tiw", "gar", "ros", "kel", "bar", "vun", "zan", "dor", "mir", "pal"])
    return [f"cabinet vétérinaire {part()}{part()}{part()} {part()}{part()}" for _ in range(n)]


def test_similar_finds_every_pair():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab cdé日😀") for _ in range(n))
    left = [text(rng.randrange(1, 25)) for _ in range(120)] + [text(rng.randrange(60, 270)) for _ in range(30)] + ["x" * 300, "\0a", "y" * 64, "y" * 128]
    right = ["".join(c for c in t if rng.random() > 0.07) + rng.choice(["", "q"]) or "z" for t in left] + [text(rng.randrange(1, 25)) for _ in range(120)]
    ratios = {(i, j): fuzzy.indel_ratio(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
    for percent in (60, 85, 90, 100):
        got = {(int(i), int(j)): s for found in fuzzy.similar(left, right, percent) for i, j, s in zip(*found)}
        assert got == {k: s for k, s in ratios.items() if s >= percent}
    assert not list(fuzzy.similar([], right, 90)) and not list(fuzzy.similar(left, [], 90))


def test_rules_for_closed_rows_keep_plans_small(spark):
    rng = random.Random(5)
    names = practices(rng, 200)
    rows = [(i, n, f"seestrasse {i * 37 % 997}, {8000 + i} ort") for i, n in enumerate(names)]
    closed = [(i, n[:-1] + "x" if i % 3 else "anders", a if i % 4 else None) for i, n, a in rows[:40]]
    df, c = spark.createDataFrame(rows, "k bigint, n string, a string"), spark.createDataFrame(closed, "ck bigint, cn string, ca string")
    out = fuzzyjoin.without_closed(df, c, "k", "ck", [("n", "cn", 85), ("a", "ca", 90)])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") < 10
    norm = lambda t: " ".join(sorted((t or "").split()))
    hit = lambda x, y, p: bool(norm(x) and norm(y)) and fuzzy.indel_ratio(norm(x), norm(y)) >= p
    want = {k for k, n, a in rows if not any(hit(n, cn, 85) or hit(a, ca, 90) for _, cn, ca in closed)}
    assert {r.k for r in out.collect()} == want and 0 < len(want) < 200


def best(names, others, percent):
    norm = lambda t: " ".join(sorted(t.split()))
    right = [norm(o) for o in others]
    found = {}
    for i, n in enumerate(names):
        s, j = max((fuzzy.indel_ratio(norm(n), o), -j) for j, o in enumerate(right))
        if s >= percent:
            found[i] = -j, s
    return found


def test_best_match_shuffles_no_candidates(spark, monkeypatch):
    rng = random.Random(7)
    names, others = practices(rng, 600), practices(rng, 600)
    others[::5] = [" ".join(reversed(n.split())) for n in names[::5]]
    monkeypatch.setattr(fuzzyjoin, "TILE_TEXTS", 150)  # several tiles a class
    left, right = spark.createDataFrame(list(enumerate(names)), "a bigint, x string"), spark.createDataFrame(list(enumerate(others)), "b bigint, y string")
    before = shuffled(spark)
    got = {r.a: (r.b, r.score) for r in fuzzyjoin.best_of_each(left, right, "a", "b", "x", "y", 90).collect()}
    assert got == best(names, others, 90) and 120 <= len(got) < 600
    assert shuffled(spark) - before < 30 * sum(map(len, names + others))
    nbsp = spark.createDataFrame([(1, "rosenau praxis")], "a bigint, x string")
    assert [tuple(r) for r in fuzzyjoin.best_of_each(nbsp, spark.createDataFrame([(2, "praxis rosenau")], "b bigint, y string"), "a", "b", "x", "y", 90).collect()] == [(1, 2, 100.0)]


def test_exact_else_fuzzy_shuffles_no_candidates(spark):
    rng = random.Random(9)
    names, others = practices(rng, 600), practices(rng, 600)
    others[::4] = names[::4]
    left, right = spark.createDataFrame(list(enumerate(names)), "a bigint, x string"), spark.createDataFrame(list(enumerate(others)), "b bigint, y string")
    before = shuffled(spark)
    got = {r.a: (r.b, r.score) for r in fuzzyjoin.exact_else_fuzzy(left, right, "a", "b", "x", "y", 90).collect()}
    first = {n: j for j, n in reversed(list(enumerate(others)))}
    want = best(names, others, 90) | {i: (first[n], 100.0) for i, n in enumerate(names) if n in first}
    assert got == want and 150 <= len(got) < 600
    assert shuffled(spark) - before < 30 * sum(map(len, names + others))
