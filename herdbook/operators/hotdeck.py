"""Filling missing values from similar records: nearest-neighbour hot-deck over hash blocks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdbook.runtime import cut, salt_both


@dataclass(frozen=True)
class Gap:
    """A field to fill: numeric or a class code, its range of measured values, and codes within that range that mean "no value"."""

    name: str
    kind: str = "numeric"
    above: float | None = None
    least: float | None = None
    below: float = 1e30
    codes: tuple[float, ...] = ()

    def measured(self) -> Column:
        """True where the field holds a measured value; never null."""
        x = F.col(self.name).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < self.below)
        if self.above is not None:
            ok &= x > self.above
        if self.least is not None:
            ok &= x >= self.least
        if self.codes:
            ok &= ~x.isin([float(c) for c in self.codes])
        return F.coalesce(ok, F.lit(False))


@dataclass(frozen=True)
class Deck:
    """Who may give a value to whom.

    cell, area, wide, time: columns of the same place, the same area, the wider area and the time; None for cell leaves the
    own cell out. features: positive columns compared on a log scale; classes: gap fields of kind "class" compared as equal
    or not. k: donors of a gap.
    """

    key: str
    cell: str | None
    area: str
    wide: str
    time: str
    features: tuple[str, ...]
    classes: tuple[str, ...] = ()
    k: int = 5


#: Codes that stand for "no value" in rasters and statistical tables, in any field.
NO_VALUE_CODES = (-9999.0, -999.0, -99.0, -200.0, 65535.0, 9999.0, 99999.0)
#: Wanted blocks up to which they are broadcast to the donors; beyond, both sides are shuffled.
FEW_BLOCKS = 200_000


def _log(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < 1e30), F.log(1 + x))


def levels(deck: Deck) -> list[tuple[str, list[str], int]]:
    """The hash blocks, finest first: a name, what the rows of a block share (SQL expressions), and the donors it must have.

    A block is only made of observed values: a record without one of them skips that level.
    """
    fine = [f"floor(_f{i} * 2)" for i in range(len(deck.features))]
    mixed = ["_area", "_time", *fine[:2], *(f"_c{i}" for i in range(len(deck.classes)))]
    return [
        *([("cell", ["_cell"], 1)] if deck.cell else []), ("area-time-mixed", mixed, deck.k),
        *((f"area-time-{n}", ["_area", "_time", f], deck.k) for n, f in zip(deck.features, fine)), ("area-time", ["_area", "_time"], deck.k),
        ("area-size", ["_area", fine[0]], deck.k), ("wide-time-size", ["_wide", "_time", fine[0]], deck.k), ("time-size", ["_time", fine[0]], deck.k),
        ("size", ["floor(_f0)"], deck.k), ("time", ["_time"], deck.k), ("any", ["0"], 1)]


def _search(gaps: DataFrame, have: DataFrame, deck: Deck, steps: list[tuple[str, list[str], int]]) -> DataFrame:
    """(_key, field_name, tier, donor, value, dist): the k nearest donors of each gap in its finest block with enough donors."""
    feats, classes = [f"_f{i}" for i in range(len(deck.features))], [f"_c{i}" for i in range(len(deck.classes))]
    compared = ["_time", *feats, *classes]
    block = lambda i, cols: F.when(reduce(lambda a, b: a & b, (F.expr(c).isNotNull() for c in cols)), F.xxhash64(F.lit(i), F.col("field_name"), *map(F.expr, cols)))
    blocks = F.array(*(block(i, cols) for i, (_, cols, _) in enumerate(steps)))
    each = gaps.select("_key", "field_name", F.posexplode(blocks).alias("level", "block")).where("block IS NOT NULL")
    wanted = each.select("block").distinct()
    wanted = cut(wanted) if len(steps) > 1 else wanted
    small = len(steps) > 1 and wanted.count() <= FEW_BLOCKS
    donors = have.select("_key", "field_name", "_value", *compared, F.explode(blocks).alias("block")).join(F.broadcast(wanted) if small else wanted, "block", "left_semi")
    if len(steps) > 1:
        least = F.element_at(F.array(*(F.lit(n) for *_, n in steps)), F.col("level") + 1)
        sizes = donors.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        chosen = each.join(sizes, "block").where(F.col("n") >= least).groupBy("_key", "field_name").agg(F.min_by(F.struct("level", "block"), "level").alias("c"))
        g = gaps.join(cut(chosen.select("_key", "field_name", "c.level", "c.block")), ["_key", "field_name"])
    else:
        g = gaps.withColumns({"level": F.lit(0), "block": blocks[0]}).where("block IS NOT NULL")
    g = g.select("_key", "field_name", F.element_at(F.array(*(F.lit(n) for n, *_ in steps)), F.col("level") + 1).alias("tier"), "block", *(F.col(c).alias(f"{c}_g") for c in compared))
    d = donors.join(g.select("block").distinct(), "block", "left_semi") if len(steps) > 1 else donors
    # of donors that nothing compared tells apart, the k smallest keys come first anyway: copies don't make a block large
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("block", *compared).orderBy("_key"))).where(F.col("_n") <= deck.k).select("block", F.col("_key").alias("donor"), F.col("_value").alias("value"), *compared)
    g, d = salt_both(g, d, ["block"], F.col("_key"), F.col("donor"), 2_000)
    none = F.lit(0.0)
    off = [F.abs(F.col(f"{c}_g") - F.col(c)) for c in feats] + [F.when(F.col(f"{c}_g") == F.col(c), 0.0).when(F.col(f"{c}_g") != F.col(c), 1.0) for c in classes]
    total, seen = sum((F.coalesce(x, none) for x in off), none), sum((x.isNotNull().cast("int") for x in off), F.lit(0))
    dist = (total + 0.5) / (seen + 0.5) + 0.02 * F.abs(F.coalesce(F.col("_time_g") - F.col("_time"), none))
    near = g.join(d, ["block", "_salt"]).select("_key", "field_name", "tier", "donor", "value", (F.floor(dist * 1e6 + 0.5) / 1e6).alias("dist"))
    return near.withColumn("_r", F.row_number().over(W.partitionBy("_key", "field_name").orderBy("dist", "donor"))).where(F.col("_r") <= deck.k).drop("_r")


def hot_deck(df: DataFrame, gaps: list[Gap], deck: Deck) -> DataFrame:
    """One row for each gap: (key, field_name, filled_value, donor, tier, n_donors, donors, spread, filled).

    Gaps and measured records are hashed into blocks: the own cell first, then area, time and the observed features, mixed
    and one by one, ever coarser (levels). In the finest block that has enough donors, the k nearest records are found by a
    Gower-like distance over the features both sides have. The value is copied from one of them: the weighted median of the
    donors, for classes the weighted majority. `donors` lists them all, `donor` is the nearest that holds the copied value,
    `filled` marks the row. Blocks are salted by their gaps and their donors; of donors that are alike in all that is
    compared only the k smallest keys meet the gaps, which changes no result. Where nobody at all has a value, the gap
    stays: value null, tier 'none', filled false. Ties in distance go to the smaller key. `key` must be a unique integer.
    """
    by_name = {g.name: g for g in gaps}
    base = df.select(F.col(deck.key).cast("bigint").alias("_key"), (F.col(deck.cell) if deck.cell else F.lit(None).cast("string")).alias("_cell"), F.col(deck.area).alias("_area"), F.col(deck.wide).alias("_wide"), F.col(deck.time).cast("double").alias("_time"),
                     *(_log(c).alias(f"_f{i}") for i, c in enumerate(deck.features)), *(F.when(by_name[c].measured(), F.col(c).cast("double")).alias(f"_c{i}") for i, c in enumerate(deck.classes)),
                     F.array(*(F.struct(F.lit(g.name).alias("field_name"), F.lit(g.kind).alias("kind"), g.measured().alias("ok"), F.col(g.name).cast("double").alias("_value")) for g in gaps)).alias("_fields"))
    rows = base.withColumn("_x", F.explode("_fields")).drop("_fields").select("*", "_x.*").drop("_x")
    open_, have = cut(rows.where(~F.col("ok")).drop("ok", "_value")), rows.where("ok").drop("ok")
    steps = levels(deck)
    found = None
    rest = open_
    if deck.cell:  # most gaps end here, so the coarser blocks are only made for the rest
        found = cut(_search(open_, have, deck, steps[:1]))
        rest, steps = cut(open_.join(found.select("_key", "field_name").distinct(), ["_key", "field_name"], "left_anti")), steps[1:]
    if not rest.isEmpty():
        more = _search(rest, have, deck, steps)
        found = more if found is None else found.unionByName(more)
    found = open_.select("_key", "field_name", "kind").join(found, ["_key", "field_name"], "left") if found is not None else open_.select(
        "_key", "field_name", "kind", *(F.lit(None).cast(t).alias(n) for n, t in (("tier", "string"), ("donor", "bigint"), ("value", "double"), ("dist", "double"))))

    # at most k donors a gap: their weighted median or majority, and the nearest donor that holds it
    got = found.groupBy("_key", "field_name", "kind").agg(
        F.array_sort(F.collect_list(F.when(F.col("donor").isNotNull(), F.struct("value", (1 / (0.05 + F.col("dist"))).alias("w"), "dist", "donor")))).alias("v"), F.first("tier", ignorenulls=True).alias("tier"))
    half = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.w) / 2 - 1e-9
    median = F.aggregate("v", F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m")),
                         lambda a, x: F.struct((a.s + x.w).alias("s"), F.when(a.m.isNull() & (a.s + x.w >= F.col("_half")), x.value).otherwise(a.m).alias("m")))["m"]
    votes = F.transform(F.array_distinct(F.transform("v", lambda x: x.value)), lambda u: F.struct(F.round(F.aggregate(F.filter("v", lambda x: x.value == u), F.lit(0.0), lambda a, x: a + x.w), 6).alias("w"), (-u).alias("neg")))
    got = got.withColumn("_half", half).withColumn("filled_value", F.when(F.col("kind") == "class", -F.array_max(votes)["neg"]).otherwise(median))
    holders = F.transform(F.filter("v", lambda x: x.value == F.col("filled_value")), lambda x: F.struct(x.dist, x.donor))
    got = got.withColumns({"donor": F.array_min(holders)["donor"], "donors": F.array_sort(F.transform("v", lambda x: x.donor)), "spread": F.array_max("v")["value"] - F.array_min("v")["value"]})
    return got.select(F.col("_key").alias(deck.key), "field_name", "filled_value", "donor", F.coalesce("tier", F.lit("none")).alias("tier"), F.size("donors").alias("n_donors"), "donors", "spread", F.col("filled_value").isNotNull().alias("filled"))


def fill(df: DataFrame, found: DataFrame, gaps: list[Gap], key: str) -> DataFrame:
    """df with its gaps filled from hot_deck's rows, and a column `<field>_filled` (boolean) for each field."""
    wide = found.groupBy(key).pivot("field_name", [g.name for g in gaps]).agg(F.first("filled_value")).select(key, *(F.col(g.name).alias(f"_v_{g.name}") for g in gaps))
    out = df.join(wide, key, "left")
    types = dict(df.dtypes)
    return reduce(lambda d, g: d.withColumn(f"{g.name}_filled", ~g.measured() & F.col(f"_v_{g.name}").isNotNull()).withColumn(
        g.name, F.when(g.measured(), F.col(g.name)).otherwise(F.col(f"_v_{g.name}").cast(types[g.name]))), gaps, out).drop(*(f"_v_{g.name}" for g in gaps))
