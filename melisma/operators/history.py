"""Charts on a run history: an append-only table of the lists that each run has made, and what movement and trends are read from it.

A history has rows (t, applied, list, formula, days, position, item, reach): one for each place of each list of each run. `days` is the
window of days that the run looked at. A run whose lists were rejected is kept with applied = false: its reach still counts as a
snapshot, but its lists were never shown. Rows of a list under another formula are never compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melisma.functions.calendar import dimension
from melisma.operators.ranking import ranked_within
from melisma.operators.telemetry import capped_default, week_start
from melisma.sources import landing

DDL = "t timestamp, applied boolean, list string, formula string, days int, position int, item long, reach long"
#: Hours that an item counts as new, that a first run needs to be an anchor, and that a baseline may miss its time by.
FRESH_HOURS, FIRST_ANCHOR_HOURS, MISS_HOURS = 24, 12, 48


def append(runs: DataFrame, path: str) -> None:
    """Append runs (one or more days' rows) to the history under path, which is partitioned by day; a run that is written again replaces
    its day's."""
    day = F.date_format("t", "yyyy-MM-dd")
    runs.withColumn("run_day", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_day").parquet(path)


def read(spark, path: str, last_day: str, keep_days: int = 60) -> DataFrame:
    """The history of the last days; older days aren't read."""
    return landing.history(spark, path, last_day, keep_days).select(*(c.split()[0] for c in DDL.split(", ")))


def current(history: DataFrame, now: Column) -> DataFrame:
    """The rows of each list's newest applied run up to now."""
    shown = history.filter(F.col("applied") & (F.col("t") <= now))
    last = shown.groupBy("list").agg(F.max("t").alias("t"))
    return shown.join(last, ["list", "t"], "left_semi")


def comparable(history: DataFrame, now: Column) -> DataFrame:
    """The applied rows up to now of each list under the formula of its newest run: after a new formula, history begins anew."""
    formula = current(history, now).select("list", "formula").distinct()
    return history.filter(F.col("applied") & (F.col("t") <= now)).join(formula, ["list", "formula"], "left_semi")


def anchors(history: DataFrame, now: Column) -> DataFrame:
    """list, t of the run that each list's movement is measured from.

    The first run of the last week before this one that has any; where all are of this week, the first of them if it is old enough.
    """
    runs = comparable(history, now).select("list", "t").distinct()
    past = runs.filter(week_start(F.col("t")) < week_start(now)).groupBy("list", week_start(F.col("t")).alias("week")).agg(F.min("t").alias("t"))
    weekly = past.groupBy("list").agg(F.max_by("t", "week").alias("weekly"))
    oldest = runs.groupBy("list").agg(F.min("t").alias("oldest"))
    old_enough = F.when(F.unix_millis(now.cast("timestamp")) - F.unix_millis("oldest") >= FIRST_ANCHOR_HOURS * 3_600_000, F.col("oldest"))
    return oldest.join(weekly, "list", "left").select("list", F.coalesce("weekly", old_enough).alias("t")).filter("t IS NOT NULL")


def badges(history: DataFrame, now: Column) -> DataFrame:
    """list, item, rank, prev_rank, delta, badge of the newest applied lists.

    move: it stood in the anchor; reentry: not there, but in an earlier run; new: in none, and first seen at most FRESH_HOURS ago; null:
    first seen before that. A list without an anchor has no badges.
    """
    now = now.cast("timestamp")
    rows, anchor = comparable(history, now), anchors(history, now).select("list", F.col("t").alias("anchor"))
    placed = rows.join(anchor, "list")
    before = placed.filter("t < anchor").select("list", "item", F.lit(True).alias("before")).distinct()
    at = placed.filter("t = anchor").select("list", "item", F.col("position").alias("prev_rank"))
    first = rows.groupBy("list", "item").agg(F.min("t").alias("first_t"))
    out = current(history, now).select("list", "item", F.col("position").alias("rank")).join(anchor, "list", "left")
    out = out.join(at, ["list", "item"], "left").join(before, ["list", "item"], "left").join(first, ["list", "item"], "left")
    fresh = F.unix_millis(now) - F.unix_millis("first_t") <= FRESH_HOURS * 3_600_000
    badge = F.when(F.col("anchor").isNull(), None).when(F.col("prev_rank").isNotNull(), "move").when(F.col("before"), "reentry").when(fresh, "new")
    return out.select("list", "item", "rank", "prev_rank", (F.col("prev_rank") - F.col("rank")).alias("delta"), badge.alias("badge"))


def clean(spark, ends: DataFrame, forced: str | None = None) -> DataFrame:
    """ends(t, days), those whose window (with both its first and its last day) holds no day of the season. forced: on or off, whatever
    the calendar says."""
    if forced:
        return ends.filter(F.lit(forced == "off"))
    span = ends.agg(F.min(F.date_sub(F.to_date("t"), F.col("days"))).alias("lo"), F.max(F.to_date("t")).alias("hi")).first()
    if span["lo"] is None:
        return ends
    season = dimension(spark, span["lo"], span["hi"]).filter("in_season").select("day")
    touched = ends.select("t", "days", F.explode(F.sequence(F.date_sub(F.to_date("t"), F.col("days")), F.to_date("t"))).alias("day")).join(F.broadcast(season), "day")
    return ends.join(touched.select("t", "days").distinct(), ["t", "days"], "left_anti")


def baseline(history: DataFrame, now: Column, list_: str, days: int, forced: str | None = None) -> DataFrame:
    """The rows of the run to measure velocity against, or none.

    The run nearest to one window before now (the earlier of two), among those that looked at as many days, if it is at most MISS_HOURS
    off; and only where neither its window nor today's touches the season. Runs that were not applied are snapshots too.
    """
    spark, now = history.sparkSession, now.cast("timestamp")
    runs = history.filter((F.col("list") == list_) & (F.col("days") == days))
    target = F.unix_millis(now) - days * 86_400_000
    gap = F.abs(F.unix_millis("t") - target)
    nearest = runs.select("t", "days", gap.alias("gap")).distinct().orderBy("gap", "t").limit(1).filter(F.col("gap") <= MISS_HOURS * 3_600_000)
    today = clean(spark, spark.range(1).select(now.alias("t"), F.lit(days).alias("days")), forced)
    kept = clean(spark, nearest.select("t", "days"), forced)
    if today.isEmpty():
        kept = kept.limit(0)
    return runs.join(kept.select("t"), "t", "left_semi")


def trending(now_rows: DataFrame, base: DataFrame, cap: int = 200, n: int = 25) -> DataFrame:
    """item, mode, score, tie, rank of now_rows(item, devices, skip, multiplier).

    With a baseline the score is the growth of reach over it, else reach itself, both less the skips and times the multiplier. An item
    that a full baseline of `cap` rows lacks counts with its least reach. Ties go by reach, then by id.
    """
    prev = base.select("item", F.col("reach").alias("before"))
    about = capped_default(prev, "before", cap).crossJoin(prev.agg((F.count("*") > 0).alias("some")))  # one row each
    damped = (1 - 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("skip", F.lit(0.0))))) * F.col("multiplier")
    tie = F.round(F.col("devices") * damped, 9)
    growth = F.round(F.greatest(F.lit(0), F.col("devices") - F.coalesce("before", F.coalesce("absent", F.lit(0)))) * damped, 9)
    both = now_rows.join(prev, "item", "left").crossJoin(F.broadcast(about))
    scored = both.select("item", F.when(F.col("some"), "velocity").otherwise("reach").alias("mode"), F.when(F.col("some"), growth).otherwise(tie).alias("score"), tie.alias("tie"))
    order = [F.desc("score"), F.desc("tie"), F.asc("item")]
    return ranked_within(scored.orderBy(*order).limit(n), ["mode"], order)
