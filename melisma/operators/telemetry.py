"""Reach, sessions, velocity, badges and co-occurrence over an event table play(device, item, kind, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reach(plays: DataFrame, *keys: str) -> DataFrame:
    """Distinct devices: deduplicated first, so that the counting exchange carries one row for each pair."""
    return plays.select("device", *keys).distinct().groupBy(*keys).agg(F.count("device").alias("reach"))


def shrink(r: Column) -> Column:
    return r / (r + 3.0)


def skip_multiplier(listened: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.35), (listened + 2.5) / (total + 5.0) / 0.5))


def exposure_multiplier(exposed: Column, devices: Column) -> Column:
    share = F.when(devices > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), exposed / devices))).otherwise(F.lit(0.0))
    return 1.0 - 0.35 * share


def max_merge(*sources: DataFrame, key: str, value: str) -> DataFrame:
    """Overlapping sources: the largest value, never the sum."""
    out = sources[0].select(key, value)
    for s in sources[1:]:
        out = out.union(s.select(key, value))
    return out.groupBy(key).agg(F.max(value).alias(value))


def capped_default(ranked: DataFrame, value: str, cap: int) -> DataFrame:
    """One row: what an item absent from a list counts as. A full list hides values up to its least one; a short one hides none."""
    return ranked.agg(F.count("*").alias("_n"), F.min(value).alias("_least")).select(F.when(F.col("_n") >= cap, F.col("_least")).otherwise(F.lit(0)).alias("absent"))


def sessions(plays: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Each event's session number for its device: a new one begins after a gap of at least so many minutes."""
    w = Window.partitionBy("device").orderBy("t", "event_id")
    new = F.coalesce(F.unix_micros("t") - F.unix_micros(F.lag("t").over(w)) >= gap_minutes * 60_000_000, F.lit(True))
    return plays.withColumn("new", new.cast("long")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def cooccurrence(pairs: DataFrame, unit: list[str], support: int = 2, block: int = 500) -> DataFrame:
    """src, dst, score: cosine of two items over units (devices, sessions), with at least `support` common devices.

    The join pairs items within one unit. A unit's items are dealt to blocks of about `block`, and each pair of blocks has a key
    of its own, so that the pairs of a large unit are spread over the tasks.
    """
    seen = pairs.select(*dict.fromkeys([*unit, "device"]), "item").distinct()
    n = seen.groupBy("item").agg(F.count("*").alias("n"))
    blocks = seen.groupBy(*unit).agg(F.ceil(F.count("*") / block).alias("_n"))
    dealt = seen.join(blocks, unit).withColumn("_own", F.pmod(F.xxhash64("item"), F.col("_n")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    a = dealt.select(*dict.fromkeys([*unit, "device"]), F.col("item").alias("src"), F.col("_own").alias("_a"), every.alias("_b"))
    b = dealt.select(*unit, F.col("item").alias("dst"), every.alias("_a"), F.col("_own").alias("_b"))
    met = a.join(b, [*unit, "_a", "_b"]).filter("src <> dst")
    if list(unit) == ["device"]:  # a device has a pair once, so the count says it all, and adds up before the exchange
        both = met.groupBy("src", "dst").agg(F.count("*").alias("both")).filter(F.col("both") >= support)
    else:
        by_device = met.groupBy("src", "dst", "device").agg(F.count("*").alias("both"))
        both = by_device.groupBy("src", "dst").agg(F.sum("both").alias("both"), F.count("*").alias("devices")).filter(F.col("devices") >= support)
    na, nb = n.select(F.col("item").alias("src"), F.col("n").alias("na")), n.select(F.col("item").alias("dst"), F.col("n").alias("nb"))
    return both.join(na, "src").join(nb, "dst").select("src", "dst", (F.col("both") / F.sqrt(F.col("na") * F.col("nb"))).alias("score"))


def week_start(t: Column) -> Column:
    """Sunday 00:00 UTC of a time's week."""
    return F.date_sub(t.cast("date"), F.dayofweek(t) - 1)


def badges(current: DataFrame, anchor: DataFrame, first: DataFrame, now: Column, fresh_hours: int = 24) -> DataFrame:
    """rank, prev_rank, delta and badge of current(item, rank) against anchor(item, prev_rank) and first(item, first_t)."""
    age = F.unix_seconds(now) - F.unix_seconds("first_t")
    badge = F.when(F.col("prev_rank").isNotNull(), F.lit("move")).when(F.col("first_t").isNotNull() & (age > fresh_hours * 3600), "reentry").otherwise("new")
    joined = current.join(anchor, "item", "left").join(first, "item", "left")
    return joined.select("item", "rank", "prev_rank", (F.col("prev_rank") - F.col("rank")).alias("delta"), badge.alias("badge"))
