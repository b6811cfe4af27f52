"""Keyed records over time: latest versions, bounded history, audits, durations, estimates, cohorts, samples, eviction.

A key may hold any share of all rows. What depends on a row's place in its key's order is computed in ranges of that
order (neighbour, running, filled): ranges are separate tasks, and only one row of each range travels to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds
STEPS = 50_000  # sequence numbers of a range


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _ranges(df: DataFrame, order: Column, width: int) -> DataFrame:
    return df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / width))


def _with_edge(x: DataFrame, edge: DataFrame, key: list[str]) -> DataFrame:
    """x with the edge value of each row's range; keys may be null."""
    names = [*key, "_b"]
    e = edge.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], "_e")
    same = [x[c].eqNullSafe(e[f"_k{i}"]) for i, c in enumerate(names)]
    return x.join(e, same, "left").drop(*[f"_k{i}" for i in range(len(names))])


def neighbour(df: DataFrame, key: list[str], order: Column, value: Column, width: int, ties: tuple[str, ...] = (), ahead: bool = False) -> DataFrame:
    """df with _near: the value of the row before (or after) in the key's order; null at its start (or end)."""
    x = _ranges(df, order, width).withColumn("_v", F.struct(value.alias("v")))
    step = F.lead if ahead else F.lag
    x = x.withColumn("_n", step("_v").over(W.partitionBy(*key, "_b").orderBy("_o", *ties)))
    place = F.struct("_o", *ties)
    edge = x.groupBy(*key, "_b").agg((F.min_by("_v", place) if ahead else F.max_by("_v", place)).alias("_e"))
    edge = edge.withColumn("_e", step("_e").over(W.partitionBy(*key).orderBy("_b")))
    return _with_edge(x, edge, key).withColumn("_near", F.coalesce("_n", "_e").getField("v")).drop("_o", "_b", "_v", "_n", "_e")


def running(df: DataFrame, key: list[str], order: Column, amount: Column, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with _sum: the sum of an amount over the key's rows up to and with this one."""
    x = _ranges(df, order, width).withColumn("_v", amount)
    x = x.withColumn("_n", F.sum("_v").over(W.partitionBy(*key, "_b").orderBy("_o", *ties).rowsBetween(W.unboundedPreceding, 0)))
    edge = x.groupBy(*key, "_b").agg(F.sum("_v").alias("_e"))
    edge = edge.withColumn("_e", F.sum("_e").over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    return _with_edge(x, edge, key).withColumn("_sum", F.coalesce("_n", F.lit(0)) + F.coalesce("_e", F.lit(0))).drop("_o", "_b", "_v", "_n", "_e")


def filled(df: DataFrame, key: list[str], order: Column, value: Column, width: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with _last: the latest value that is not null among the key's rows up to and with this one."""
    x = _ranges(df, order, width).withColumn("_v", value)
    x = x.withColumn("_n", F.last("_v", ignorenulls=True).over(W.partitionBy(*key, "_b").orderBy("_o", *ties).rowsBetween(W.unboundedPreceding, 0)))
    known = F.when(F.col("_v").isNotNull(), F.struct("_o", *ties))
    edge = x.groupBy(*key, "_b").agg(F.max_by("_v", known).alias("_e"))
    edge = edge.withColumn("_e", F.last("_e", ignorenulls=True).over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    return _with_edge(x, edge, key).withColumn("_last", F.coalesce("_n", "_e")).drop("_o", "_b", "_v", "_n", "_e")


def latest(df: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """One row for each key: its fields at the greatest order; combined before the shuffle, so hot keys cost no more."""
    best = F.max_by(F.struct(*fields), F.struct(*order))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("v")).select(key, "v.*")


def bounded(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first size rows in an order, over the whole table: a top-k, without a global sort."""
    return df.orderBy(*order).limit(size)


def bounded_by(df: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """At most size rows of each key; the rank limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= size)


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key the other frame lacks (anti-join)."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows whose key the other frame has (semi-join)."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, replaced and extended by the new ones of the same columns."""
    return without(old, new, key).unionByName(new)


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed) between two snapshots."""
    o = old.select(key, F.xxhash64(*fields).alias("h_old"))
    n = new.select(key, F.xxhash64(*fields).alias("h_new"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "removed").when(F.col("h_old") != F.col("h_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def audit(events: DataFrame, key: str, order: str, before: str, after: str, width: int = STEPS) -> DataFrame:
    """key, order, stated, expected: events whose stated earlier state is not the one that the event before left."""
    e = events.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    e = neighbour(e, [key], F.col(order), F.col(after), width, (before, after))
    return e.select(key, order, F.col(before).alias("stated"), F.col("_near").alias("expected")).where("expected is not null and expected <> stated")


def transitions(events: DataFrame, before: str, after: str) -> DataFrame:
    """from_state, to_state, n of every stated transition."""
    e = events.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    return e.groupBy(F.col(before).alias("from_state"), F.col(after).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


def spans(events: DataFrame, key: str, time: str, state: str, width: int = DAY) -> DataFrame:
    """state, visits, seconds: how often and how long keys were in each state; a key's last state has no end."""
    e = neighbour(events.where(F.col(time).isNotNull()), [key], micros(time), micros(time), width, (state,), ahead=True)
    e = e.select(F.col(state).alias("state"), (F.col("_near") - micros(time)).alias("d"))
    return e.groupBy("state").agg(F.count(F.lit(1)).alias("visits"), F.round(F.sum("d") / 1000000.0, 3).alias("seconds"))


def quantiles(df: DataFrame, keys: list[str], value: Column, shares: tuple[float, ...], step: float) -> DataFrame:
    """keys, samples, q: exact quantiles of a value, interpolated between neighbours, in the order of the shares.

    Equal values are counted before they move, and ranks come from counts that run over ranges of the value (step wide),
    so a key that holds any share of all rows is many small tasks and no state grows with it.
    """
    n = df.where(value.isNotNull()).select(*keys, value.cast("double").alias("_x")).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    total = n.groupBy(*keys).agg(F.sum("_c").alias("samples"))
    ranked = running(n, keys, F.col("_x"), F.col("_c"), step)
    x = ranked.alias("r").join(total.alias("t"), [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select(*[F.col(f"r.{k}") for k in keys], "_x", "_c", "_sum", "samples")
    at = lambda rank: F.max(F.when((F.col("_sum") - F.col("_c") <= rank) & (rank < F.col("_sum")), F.col("_x")))
    place = [(F.col("samples") - 1) * F.lit(q) for q in shares]
    g = x.groupBy(*keys).agg(F.max("samples").alias("samples"), *[at(F.floor(p)).alias(f"_l{i}") for i, p in enumerate(place)], *[at(F.ceil(p)).alias(f"_h{i}") for i, p in enumerate(place)])
    between = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * ((F.col("samples") - 1) * F.lit(q) - F.floor((F.col("samples") - 1) * F.lit(q))) for i, q in enumerate(shares)]
    return g.select(*keys, "samples", F.array(*between).alias("q"))


def estimate(facts: DataFrame, keys: list[str], units: str, seconds: str, wanted: float, base: float, step: float = 100.0) -> DataFrame:
    """keys, samples, lower, likely, upper: seconds for wanted units, from the rates of earlier runs of the same keys.

    The median rate is weighed against a base rate that counts max(0, 3 − n) times. From four runs on the band comes
    from the quartiles, with fewer it is a fixed share. step: width of the ranges of rates that are ranked together.
    """
    g = quantiles(facts.where(F.col(units) > 0), keys, F.col(seconds) / F.col(units), (0.5, 0.25, 0.75), step)
    n, prior = F.col("samples"), F.greatest(F.lit(0), 3 - F.col("samples"))
    mid = (F.col("q")[0] * n + base * prior) / (n + prior)
    likely = F.greatest(F.lit(15.0), F.bround(8 + mid * wanted))
    lower = F.when(n >= 4, (8 + F.col("q")[1] * wanted) * 0.85).otherwise(likely * 0.65)
    upper = F.when(n >= 4, (8 + F.col("q")[2] * wanted) * 1.2).otherwise(likely * 1.55)
    return g.select(*keys, "samples", F.greatest(F.lit(10.0), F.round(F.least(lower, likely), 3)).alias("lower"), likely.alias("likely"), F.round(F.greatest(likely, upper), 3).alias("upper"))


def combined(estimates: DataFrame, weak: int = 3) -> DataFrame:
    """One row: the sums of several estimates and the smallest number of samples behind any of them.

    sure: whether every part rests on at least weak samples. Nothing to add gives nulls and no samples.
    """
    return estimates.agg(F.round(F.sum("lower"), 3).alias("lower"), F.sum("likely").alias("likely"), F.round(F.sum("upper"), 3).alias("upper"), F.coalesce(F.min("samples"), F.lit(0)).alias("samples"), F.coalesce(F.min("samples") >= weak, F.lit(False)).alias("sure"))


def remaining(df: DataFrame, lower: str, likely: str, upper: str, elapsed: str, in_stage: str, current: str, total: str) -> DataFrame:
    """df with left_lower, left_likely, left_upper: what is left of an estimate after some seconds.

    Elapsed seconds are subtracted, not below zero. From ten seconds in a stage on, with at least two steps of which
    some are done, the rate observed in the stage counts as well: the band is widened to .75 and 1.35 of it, and the
    likely value is the mean of both, inside the band.
    """
    less = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col(elapsed))
    seen = F.when((F.col(in_stage) >= 10) & (F.col(current) > 0) & (F.col(current) < F.col(total)) & (F.col(total) >= 2), F.col(in_stage) * (F.col(total) - F.col(current)) / F.col(current))
    low = F.when(seen.isNotNull(), F.least(less(lower), 0.75 * seen)).otherwise(less(lower))
    high = F.when(seen.isNotNull(), F.greatest(less(upper), 1.35 * seen)).otherwise(less(upper))
    mid = F.when(seen.isNotNull(), F.least(high, F.greatest(low, (less(likely) + seen) / 2))).otherwise(less(likely))
    return df.select("*", F.round(low, 3).alias("left_lower"), F.round(mid, 3).alias("left_likely"), F.round(high, 3).alias("left_upper"))


def checked_early(kind: Column, units: Column, heavy: Column) -> Column:
    """Whether a job is tried on a few pages first: a PDF of 120 units, or of 60 with a heavy step."""
    return F.coalesce((kind == "pdf") & ((units >= 120) | ((units >= 60) & heavy)), F.lit(False))


def cohorts(df: DataFrame, by: list[str], value: str, good: Column, step: float = 100.0) -> DataFrame:
    """by, n, good, median, greatest of each cohort."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("good"), F.max(value).alias("greatest"))
    q = quantiles(df, by, F.col(value), (0.5,), step)
    j = g.alias("g").join(q.alias("q"), [F.col(f"g.{k}").eqNullSafe(F.col(f"q.{k}")) for k in by], "left")
    return j.select(*[F.col(f"g.{k}") for k in by], "n", "good", F.round(F.get("q", F.lit(0)), 6).alias("median"), "greatest")


def regressions(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, expected, actual of every measure that differs from its baseline."""
    side = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields])).alias("x")).select(key, "x.*")
    both = side(expected, "expected").join(side(actual, "actual"), [key, "field"], "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def spread_sample(df: DataFrame, by: str, order: str, parts: int, width: int = STEPS) -> DataFrame:
    """The rows at evenly spread ranks of each group, ordered by a number: at most parts of each."""
    x = running(df, [by], F.col(order), F.lit(1), width)
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumnRenamed(by, "_by")
    x = x.join(n, x[by].eqNullSafe(n["_by"])).drop("_by").withColumn("_r", F.col("_sum") - 1)
    step = lambda k: F.floor(k * parts / F.col("_n"))
    return x.where((F.col("_r") == 0) | (step(F.col("_r")) != step(F.col("_r") - 1))).drop("_n", "_r", "_sum")


def budget(df: DataFrame, by: str, score: str, tie: str, most: int, share: float) -> DataFrame:
    """The rows of each group with the best scores: at most `most`, and at most the share of the group, at least one.

    The rank limit cuts each group before the shuffle; group sizes are counted apart.
    """
    top = bounded_by(df, by, [F.desc(score), F.col(tie)], most)
    n = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    return top.join(n, top[by].eqNullSafe(n["_by"])).drop("_by").where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_n", "rank")


def evict(cache: DataFrame, by: str, bytes_: str, used: str, key: str, limit: int, width: int = 30 * DAY, now: Column | None = None, stale: int = 30 * DAY, fresh: int = DAY) -> DataFrame:
    """by, key of entries to drop: the stale ones, then the longest unused ones until each group's rest fits the limit.

    Entries unused for the stale time go whatever the size; entries used within the fresh time stay whatever the size.
    now: the present; without it no entry is stale or fresh.
    """
    age = F.lit(None).cast("bigint") if now is None else F.unix_micros(now) - micros(used)
    x = cache.withColumn("_age", age)
    live = x.where(F.coalesce(F.col("_age") < stale, F.lit(True)))
    big = running(live, [by], -micros(used), F.col(bytes_), width, (key,)).where((F.col("_sum") > limit) & F.coalesce(F.col("_age") >= fresh, F.lit(True)))
    return x.where(F.col("_age") >= stale).select(by, key).unionByName(big.select(by, key))


def prepend(history: DataFrame, new: DataFrame, by: str, identity: list[Column], order: str, size: int = 20) -> DataFrame:
    """by, order and the fields of a history with new rows put in front: of equal rows the first stays, at most size of each group.

    order: place in the history and among the new rows, from 0; new rows stand before all others.
    """
    both = new.withColumn("_side", F.lit(0)).unionByName(history.withColumn("_side", F.lit(1)))
    first = W.partitionBy(by, *identity).orderBy("_side", order)
    once = both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return once.withColumn(order, (F.row_number().over(W.partitionBy(by).orderBy("_side", order)) - 1).cast(dict(history.dtypes)[order])).where(F.col(order) < size).drop("_side")


def merged_strides(chapters: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """by, order, group: chapters beyond a number of files are merged by a fixed stride, so that at most so many are left."""
    n = chapters.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ranked = chapters.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).join(n, by)
    return ranked.select(by, order, F.floor(F.col("_r") / F.ceil(F.col("_n") / F.lit(most))).cast("int").alias("group"))


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str, width: int = DAY) -> DataFrame:
    """left with the value of the latest right row of the same key not later than it: a union and a running last, no range join."""
    l = left.withColumn("_right", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1))
    r = right.select(by, time, F.col(value).alias("_right")).withColumn("_side", F.lit(0))
    both = filled(l.unionByName(r, allowMissingColumns=True), [by], micros(time), F.col("_right"), width, ("_side",))
    return both.where("_side = 1").withColumnRenamed("_last", f"last_{value}").drop("_right", "_side")


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, width: int = DAY) -> DataFrame:
    """key, started, ended, n of runs of events of a key, parted where none comes for that long."""
    e = events.where(F.col(time).isNotNull()).groupBy(key, time).agg(F.count(F.lit(1)).alias("_m"))
    e = neighbour(e, [key], micros(time), micros(time), width)
    opens = F.when(F.col("_near").isNull() | (micros(time) - F.col("_near") >= gap_seconds * 1_000_000), 1).otherwise(0)
    e = running(e.withColumn("_opens", opens), [key], micros(time), F.col("_opens"), width)
    return e.groupBy(key, "_sum").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.sum("_m").alias("n")).drop("_sum")
