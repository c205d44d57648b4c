"""Charts that are read from a stored history of runs: movement badges, and trending by growth or by reach."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from melisma.operators import history as h
from melisma.operators.ranking import ranked_within
from melisma.registry import query
from melisma.sources import shared
from melisma.sources import tables as t

#: Runs of every day's start, their window in days, and places of a list.
_FIRST, _RUNS, _DAYS, _PLACES = "2024-01-03", 28, 3, 20
_NOW = "2024-01-30 06:00:00"

_HISTORY = f"""r AS (SELECT TIMESTAMP '{_FIRST}' + i * INTERVAL 1 DAY AS t FROM range({_RUNS}) x(i)),
c AS (SELECT r.t, kind AS list, item, count(DISTINCT device) AS reach FROM r JOIN play p ON p.t >= r.t - INTERVAL {_DAYS} DAY AND p.t < r.t WHERE kind IN ('play', 'favorite', 'download') GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY t, list ORDER BY reach DESC, item) AS position, day(t) % 7 <> 0 AS applied,
  CASE WHEN list = 'favorite' AND t >= TIMESTAMP '2024-01-25' OR list = 'download' AND t >= TIMESTAMP '2024-01-30' THEN 'b' ELSE 'a' END AS formula FROM c QUALIFY position <= {_PLACES})"""


def made_runs(spark, d):
    """Each day's lists of plays, favourites and downloads; every seventh run is rejected, two lists get another formula on the way."""
    plays = t.plays(spark, d).filter("kind IN ('play', 'favorite', 'download')")
    seen = plays.select("device", "item", F.col("kind").alias("list"), F.explode(F.expr(f"transform(sequence(1, {_DAYS}), n -> date_add(to_date(t), n))")).alias("day"))
    first = F.lit(_FIRST).cast("date")
    seen = seen.filter((F.col("day") >= first) & (F.col("day") < F.date_add(first, _RUNS))).distinct()
    counted = seen.groupBy("day", "list", "item").agg(F.count("*").alias("reach"))
    placed = ranked_within(counted, ["day", "list"], [F.desc("reach"), F.asc("item")], "position").filter(F.col("position") <= _PLACES)
    changed = ((F.col("list") == "favorite") & (F.col("day") >= "2024-01-25")) | ((F.col("list") == "download") & (F.col("day") >= "2024-01-30"))
    return placed.select(
        F.col("day").cast("timestamp").alias("t"), (F.dayofmonth("day") % 7 != 0).alias("applied"), "list", F.when(changed, "b").otherwise("a").alias("formula"),
        F.lit(_DAYS).alias("days"), F.col("position").cast("int").alias("position"), "item", "reach",
    )


def kept_history(spark, d):
    """The runs appended to a history, half of the days by each of two writes, and read back."""
    path, runs = shared.new_path(spark, "history"), made_runs(spark, d)
    for half in ("t < '2024-01-16'", "t >= '2024-01-16'"):
        h.append(runs.filter(half), path)
    return h.read(spark, path, "2024-01-31")


@query("chart_history", f"""WITH {_HISTORY},
a AS (SELECT * FROM k WHERE applied AND t <= TIMESTAMP '{_NOW}'), cur AS (SELECT list, max(t) AS t FROM a GROUP BY 1),
v AS (SELECT a.* FROM a JOIN (SELECT DISTINCT list, formula FROM a JOIN cur USING (list, t)) USING (list, formula)),
wk AS (SELECT list, CAST(t AS DATE) - CAST(dayofweek(t) AS INT) AS week, min(t) AS t FROM v GROUP BY 1, 2),
anc AS (SELECT o.list, coalesce(w.t, CASE WHEN TIMESTAMP '{_NOW}' - o.t >= INTERVAL 12 HOUR THEN o.t END) AS anchor FROM (SELECT list, min(t) AS t FROM v GROUP BY 1) o
  LEFT JOIN (SELECT list, arg_max(t, week) AS t FROM wk WHERE week < DATE '2024-01-28' GROUP BY 1) w USING (list)),
f AS (SELECT list, item, min(t) AS first_t FROM v GROUP BY 1, 2),
b AS (SELECT DISTINCT list, item FROM v JOIN anc USING (list) WHERE t < anchor),
p AS (SELECT list, item, position AS prev_rank FROM v JOIN anc USING (list) WHERE t = anchor)
SELECT v.list, v.item, v.position AS rank, p.prev_rank, p.prev_rank - v.position AS delta, CASE WHEN anchor IS NULL THEN NULL WHEN p.prev_rank IS NOT NULL THEN 'move' WHEN b.item IS NOT NULL THEN 'reentry'
  WHEN TIMESTAMP '{_NOW}' - first_t <= INTERVAL 24 HOUR THEN 'new' END AS badge
FROM v JOIN cur ON cur.list = v.list AND cur.t = v.t JOIN anc ON anc.list = v.list LEFT JOIN p ON p.list = v.list AND p.item = v.item LEFT JOIN b ON b.list = v.list AND b.item = v.item JOIN f ON f.list = v.list AND f.item = v.item""")
def chart_history(spark, d):
    """Movement of the newest lists against the anchor in the stored history."""
    whole = ("rank", "prev_rank", "delta")
    return h.badges(kept_history(spark, d), F.lit(_NOW)).withColumns({c: F.col(c).cast("long") for c in whole})


#: Days by which the telemetry is moved, so that today's window and the one before it lie before, in and after the season of 2024.
_SHIFTS = (0, 172, 177, 198, 200, 204)


@query("trending_modes", f"""WITH {_HISTORY}, m AS (SELECT shift, DATE '2024-01-30' + CAST(shift AS INT) AS today FROM (SELECT unnest({list(_SHIFTS)}) AS shift)),
season AS (SELECT DATE '2024-07-23' AS lo, DATE '2024-08-13' AS hi),
mode AS (SELECT shift, CASE WHEN (today - {_DAYS} <= hi AND today >= lo) OR (today - {2 * _DAYS} <= hi AND today - {_DAYS} >= lo) THEN 'reach' ELSE 'velocity' END AS mode FROM m, season),
base AS (SELECT item, reach FROM k WHERE list = 'play' AND t = TIMESTAMP '2024-01-30' - INTERVAL {_DAYS} DAY), cap AS (SELECT CASE WHEN count(*) >= {_PLACES} THEN min(reach) ELSE 0 END AS absent FROM base),
cur AS (SELECT item, count(DISTINCT device) FILTER (kind = 'play') AS devices, avg(CAST(kind = 'skip' AS INT)) AS skip FROM play WHERE kind IN ('play', 'skip') AND t >= TIMESTAMP '2024-01-30' - INTERVAL {_DAYS} DAY AND t < TIMESTAMP '2024-01-30' GROUP BY 1),
s AS (SELECT shift, mode, item, round(CASE WHEN mode = 'velocity' THEN greatest(0, devices - coalesce(reach, absent)) ELSE devices END * (1 - 0.5 * skip), 9) AS score, round(devices * (1 - 0.5 * skip), 9) AS tie
  FROM mode, cur LEFT JOIN base USING (item), cap WHERE devices >= 2 AND skip < 0.5)
SELECT CAST(shift AS BIGINT) AS shift, mode, item, score, tie, row_number() OVER (PARTITION BY shift ORDER BY score DESC, tie DESC, item) AS rank FROM s QUALIFY rank <= 25""")
def trending_modes(spark, d):
    """What trends, by growth over the stored run of one window ago; by reach where either window touches the season."""
    history = kept_history(spark, d)
    plays = t.plays(spark, d).filter("kind IN ('play', 'skip') AND t >= timestamp'2024-01-30' - INTERVAL 3 DAYS AND t < timestamp'2024-01-30'")
    now_rows = plays.groupBy("item").agg(F.count_distinct(F.when(F.col("kind") == "play", F.col("device"))).alias("devices"), F.avg((F.col("kind") == "skip").cast("int")).alias("skip"))
    now_rows = shared.stored(now_rows.filter("devices >= 2 AND skip < 0.5").withColumn("multiplier", F.lit(1.0)))
    out = None
    for shift in _SHIFTS:
        moved = history.withColumn("t", F.col("t") + F.expr(f"INTERVAL {shift} DAYS"))
        base = h.baseline(moved, F.expr(f"timestamp'2024-01-30' + INTERVAL {shift} DAYS"), "play", _DAYS)
        found = h.trending(now_rows, base, _PLACES).select(F.lit(shift).cast("long").alias("shift"), "*")
        out = found if out is None else out.unionByName(found)
    return out
