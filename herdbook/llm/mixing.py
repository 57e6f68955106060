"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herdbook.runtime import cut, forget, hot_keys, salt_all, salt_one

#: Sources up to which their table is broadcast to the records; beyond, hot sources are salted in a shuffled join.
FEW_SOURCES = 100_000
#: So many records of each source, just below its threshold, are tried to fill the last gap. Only a few are taken.
FILLERS = 100
#: Bins of one histogram of a source, and how often the bin with the threshold is divided anew.
BINS, LEVELS = 2_048, 3


def _with(rows: DataFrame, state: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows joined with the table of sources."""
    if few:
        return rows.join(F.broadcast(state), "_s", how)
    hot = hot_keys(rows, ["_s"])
    return salt_one(rows, hot, ["_s"], F.xxhash64(*rows.columns)).join(salt_all(state, hot, ["_s"]), ["_s", "_salt"], how).drop("_salt")


def mix(sized: DataFrame, key: str, source: str, size: str, targets: DataFrame, share: str, repeats: str, total: float | None = None, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """(key, source, size, rate, copies): how often each record is drawn so that each source reaches its share of all tokens.

    Entropy balancing: of all rates between 0 and the source's cap, those nearest to drawing each record once (in relative
    entropy) that meet the source's token target are min(cap, exp(l x)), x the record's size over the source's mean size. The
    multipliers l solve a convex dual. A Newton step for all sources is one distributed join and sum over the histogram of
    (source, size), kept in a bracket so that it can't diverge; multipliers stay in a table, only the largest error comes to
    the driver. A source at its cap has all its records `cap` times.

    Rates are rounded to copies: the whole part, and one more where the fraction, less a hash of the key, is above the
    source's threshold. It is found by histograms, each dividing the bin of the one before, so that the source's tokens are
    as near its target as whole records allow; records just below it then fill the gap, the first that fit in that order.
    No source's records are ever brought together, and the result is the same on every run.

    `total` defaults to the largest mixture that the caps allow. Sources without a target, and records with no tokens or a
    null source, get 0 copies. Sources with a target but without tokens can't be met: the others share theirs in proportion
    (mix_report shows it). Targets that are null or not positive count as none; a null cap counts as 1; of a source named
    twice the largest share and cap hold.
    """
    wanted = targets.where((F.col(share) > 0) & F.col(source).isNotNull()).groupBy(F.col(source).alias("_s")).agg(F.max(F.col(share).cast("double")).alias("share"), F.max(F.coalesce(F.col(repeats), F.lit(1)).cast("double")).alias("cap"))
    rows = cut(sized.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_n")))
    sizes = cut(rows.where((F.col("_n") > 0) & F.col("_s").isNotNull()).groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("docs")))
    stats = sizes.groupBy("_s").agg(F.sum(F.col("_n") * F.col("docs")).cast("double").alias("tokens"), F.sum("docs").cast("double").alias("n"))
    state = cut(stats.join(wanted, "_s").where("cap >= 1").withColumn("mean", F.col("tokens") / F.col("n")))
    sums = state.agg(F.sum("share").alias("norm"), F.min(F.col("cap") * F.col("tokens") / F.col("share")).alias("most"), F.count(F.lit(1)).alias("n")).first()
    few = sums["n"] <= FEW_SOURCES
    norm = sums["norm"] or 1.0
    most = (sums["most"] or 0.0) * norm
    goal = F.lit(min(most, total) if total is not None else most) * F.col("share") / norm
    state = state.withColumn("goal", goal).withColumn("full", F.col("goal") >= F.col("cap") * F.col("tokens") * (1 - 1e-9))
    state = cut(state.select("_s", "goal", "cap", "mean", "n", "full", F.lit(0.0).alias("l"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(1.0).alias("off")))
    tilt = F.exp(F.least(F.col("l") * F.col("_n") / F.col("mean"), F.lit(50.0)))
    for _ in range(rounds):
        tokens = F.col("_n") * F.col("docs")
        inner = tilt <= F.col("cap")  # a rate beyond its cap does not move
        kept = ["goal", "cap", "mean", "n", "full", "l", "low", "high"]
        sums = _with(sizes, state.select("_s", *kept), few).groupBy("_s").agg(
            F.sum(tokens * F.least("cap", tilt)).alias("f"), F.sum(F.when(inner, tokens * tilt * F.col("_n") / F.col("mean")).otherwise(0.0)).alias("g"), *(F.first(c).alias(c) for c in kept))
        gap, l = F.col("f") - F.col("goal"), F.col("l")
        met = F.col("full") | (F.abs(gap) <= tolerance * F.col("goal"))
        low, high = F.when(gap < 0, l).otherwise(F.col("low")), F.when(gap > 0, l).otherwise(F.col("high"))
        step = F.when(F.col("g") > 0, l - F.log(F.col("f") / F.col("goal")) * F.col("f") / F.col("g"))  # Newton on the logarithm, which is nearly straight
        next_l = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        new = sums.select("_s", "goal", "cap", "mean", "n", "full", F.when(met, l).otherwise(next_l).alias("l"), low.alias("low"), high.alias("high"), F.when(met, 0.0).otherwise(F.abs(gap) / F.col("goal")).alias("off"))
        new = new.coalesce(1) if few else new
        new = cut(new)
        forget(state)
        state = new
        if not state.where("off > 0").limit(1).count():
            break

    u = (F.pmod(F.xxhash64(F.lit("round"), "_k"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rate = F.when(F.col("cap").isNull() | (F.col("_n") <= 0), 0.0).when(F.col("full"), F.col("cap")).otherwise(F.least("cap", tilt))
    drawn = _with(rows, state.select("_s", "cap", "mean", "l", "full"), few, "left").withColumn("rate", rate)
    drawn = cut(drawn.select("_k", "_s", "_n", "rate", F.floor(F.coalesce("cap", F.lit(0.0))).alias("cap"), F.col("full"), (F.col("rate") - F.floor("rate") - u).alias("v")))
    part = drawn.where("NOT full AND _n > 0 AND floor(rate) < cap").select("_s", "_k", "_n", "v")
    whole = drawn.where("NOT full").groupBy("_s").agg(F.sum(F.floor("rate") * F.col("_n")).cast("double").alias("base"))
    edge = cut(state.where("NOT full").join(whole, "_s", "left").select("_s", (F.col("goal") - F.coalesce("base", F.lit(0.0))).alias("need"), F.lit(-1.0).alias("at"), F.lit(2.0).alias("width"), (4.0 * FILLERS / F.col("n")).alias("reach"), F.lit(False).alias("all")))
    for _ in range(LEVELS):
        bin_ = F.floor((F.col("v") - F.col("at")) / (F.col("width") / BINS))
        hist = _with(part, edge.where("NOT all").select("_s", "at", "width"), few).withColumn("b", bin_).where((F.col("b") >= 0) & (F.col("b") < BINS)).groupBy("_s", "b").agg(F.sum("_n").cast("double").alias("t"))
        run = hist.withColumn("run", F.sum("t").over(W.partitionBy("_s").orderBy(F.desc("b")))).join(edge.select("_s", "need"), "_s")  # at most BINS rows of a source
        over = F.col("run") > F.col("need")
        first = run.groupBy("_s").agg(F.max(F.when(over, F.col("b"))).alias("b"), F.coalesce(F.max(F.when(~over, F.col("run"))), F.lit(0.0)).alias("got"))
        next_ = edge.join(first, "_s", "left").select(
            "_s", (F.col("need") - F.coalesce("got", F.lit(0.0))).alias("need"), F.when(F.col("b").isNotNull(), F.col("at") + F.col("b") * F.col("width") / BINS).otherwise(F.col("at")).alias("at"),
            F.when(F.col("b").isNotNull(), F.col("width") / BINS).otherwise(F.col("width")).alias("width"), "reach", (F.col("all") | F.col("b").isNull()).alias("all"))
        edge = cut(next_)
    # all above the last bin that didn't fit as a whole are drawn
    edge = cut(edge.select("_s", "need", F.when(F.col("all"), F.col("at")).otherwise(F.col("at") + F.col("width")).alias("edge"), "reach"))
    # what a record too large for the gap has left open is filled with smaller ones from just below the threshold
    below = _with(part, edge, few).where((F.col("v") < F.col("edge")) & (F.col("v") >= F.col("edge") - F.col("reach")))
    below = below.withColumn("_i", F.row_number().over(W.partitionBy("_s").orderBy(F.desc("v"), "_k"))).where(F.col("_i") <= FILLERS)
    taken = below.groupBy("_s").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("_i", "_k", "_n"))).alias("a"))
    start = F.struct(F.col("need").alias("need"), F.filter(F.transform("a", lambda x: x._k), lambda k: F.lit(False)).alias("ks"))
    fits = F.aggregate("a", start, lambda s, x: F.when(x._n <= s.need, F.struct((s.need - x._n).alias("need"), F.array_append(s.ks, x._k).alias("ks"))).otherwise(s))
    fillers = taken.select(F.explode(fits["ks"]).alias("_k"), F.lit(True).alias("_fill"))
    out = _with(drawn, edge.select("_s", "edge"), few, "left").join(fillers, "_k", "left")
    extra = F.when((F.floor("rate") < F.col("cap")) & (F.col("_n") > 0) & ((F.col("v") >= F.col("edge")) | F.col("_fill")), 1).otherwise(0)
    return out.select(F.col("_k").alias(key), F.col("_s").alias(source), F.col("_n").alias(size), "rate", (F.floor("rate") + extra).cast("int").alias("copies"))


def mix_report(mixed: DataFrame, source: str, size: str, targets: DataFrame, share: str, repeats: str) -> DataFrame:
    """(source, target_share, actual_share, tokens, records, copies, most_copies, max_repeats), one row for each source on either side."""
    tokens = F.sum(F.col(size) * F.col("copies"))
    by = mixed.groupBy(source).agg(tokens.alias("tokens"), F.sum((F.col("copies") > 0).cast("bigint")).alias("records"), F.sum("copies").cast("bigint").alias("copies"), F.max("copies").alias("most_copies"))
    whole = by.agg(F.sum("tokens").alias("_all"))
    out = by.join(targets.select(F.col(source).alias("_t"), F.col(share).alias("target_share"), F.col(repeats).alias("max_repeats")), F.col(source) == F.col("_t"), "full").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.coalesce(source, "_t").alias(source), "target_share", F.coalesce(F.col("tokens") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("records"), zero("copies"), zero("most_copies"), "max_repeats")
