"""Radio and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma import registry
from melisma.functions import hashing as h
from melisma.operators import recommend as r
from melisma.operators import telemetry as o
from melisma.operators.ranking import keep_first, ranked_within, top_ranked
from melisma.plans import telemetry as charts
from melisma.registry import query
from melisma.sources import shared
from melisma.sources import tables as t

_FNV = "CAST(list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(string_split({s}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS BIGINT)"


def fnv_sql(s: str, seed: int = 0) -> str:
    return _FNV.format(s=s, seed=2166136261 ^ seed)


def _sub(name: str) -> str:
    return f"({registry._FOUND[name][1]})"


def edges(spark, d):
    parts = (("sess", charts.cooc_session(spark, d)), ("lib", charts.cooc_library(spark, d)), ("art", charts.cooc_artist(spark, d)))
    out = None
    for kind, graph in parts:
        e = graph.select(F.lit(kind).alias("kind"), "src", "dst", "score")
        out = e if out is None else out.union(e)
    return out


def heard(spark, d):
    """item, artist_id, reach, multiplier, year and class of every track."""
    plays = t.plays(spark, d)
    reach = o.reach(plays.filter("kind = 'play'"), "item")
    skip = charts.skip_rate(spark, d).select("item", "multiplier")
    tracks = t.tracks(spark, d).select(F.col("track_id").alias("item"), "artist_id", "duration_sec", "genres", F.year(F.to_date("upload_date")).alias("year"))
    return tracks.join(reach, "item", "left").join(skip, "item", "left").select("item", "artist_id", "duration_sec", "genres", "year", (F.col("artist_id") % 4 == 0).alias("cls"), F.coalesce("reach", F.lit(0)).alias("reach"), F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"))


def song_seeds(spark, d):
    """A station of each song."""
    return t.tracks(spark, d).select(F.col("track_id").alias("station"), F.col("track_id").alias("item"), "artist_id")


@query("radio_score", f"""WITH hd AS (SELECT track_id AS item, artist_id, coalesce(reach, 0) AS reach, coalesce(multiplier, 1.0) AS multiplier FROM track LEFT JOIN (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1) a ON a.item = track_id LEFT JOIN {_sub('skip_rate')} b ON b.item = track_id),
 seed AS (SELECT item AS station, item, artist_id FROM hd),
 rel AS (SELECT station, dst AS artist_id, score, row_number() OVER (PARTITION BY station ORDER BY score DESC, dst) AS rn FROM seed JOIN {_sub('cooc_artist')} e ON e.src = artist_id),
 ft AS (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY reach DESC, item) AS rn FROM hd),
 s AS (SELECT station, e.dst AS item, 2.0 * score AS s FROM seed JOIN {_sub('cooc_session')} e ON e.src = seed.item UNION ALL SELECT station, e.dst, 1.25 * score FROM seed JOIN {_sub('cooc_library')} e ON e.src = seed.item
  UNION ALL SELECT station, hd.item, 0.2 * reach / (reach + 3.0) FROM seed JOIN hd USING (artist_id) UNION ALL SELECT station, ft.item, 0.08 * score * reach / (reach + 3.0) FROM rel JOIN ft USING (artist_id) WHERE rel.rn <= 15 AND ft.rn <= 5)
 SELECT station, s.item, round(sum(s) * any_value(multiplier) + 0.03 * (any_value({fnv_sql('CAST(s.item AS VARCHAR)')}) >> 8) / 16777216.0, 6) AS score FROM s JOIN hd ON hd.item = s.item WHERE s.item <> station GROUP BY 1, 2""")
def radio_score(spark, d):
    return r.scores(song_seeds(spark, d), shared.stored(edges(spark, d), "edges"), shared.stored(heard(spark, d), "heard")).withColumn("score", F.round("score", 6))


@query("radio_station", None)
def radio_station(spark, d):
    """The whole station of each artist's most heard song: head by score, backfill by popularity, then never more than two of one artist in
    a row."""
    tracks = heard(spark, d)
    best = keep_first(tracks, ["artist_id"], [F.desc("reach"), F.asc("item")])
    seeds = best.select(F.col("item").alias("station"), "item", "artist_id")
    head = r.scores(seeds, edges(spark, d), tracks)
    stations = seeds.join(tracks.select("item", "year", "cls"), "item").select("station", "year", "cls")
    queue = r.backfill(stations, head, tracks).join(tracks.select("item", "artist_id"), "item")
    return r.page(r.diversify(queue), 0, 50)


_SHUFFLE = 500


@query("radio_shuffle_order", f"""WITH hd AS (SELECT track_id AS item, coalesce(reach, 0) AS reach, coalesce(multiplier, 1.0) AS multiplier FROM track LEFT JOIN (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1) a ON a.item = track_id LEFT JOIN {_sub('skip_rate')} b ON b.item = track_id),
 p AS (SELECT *, row_number() OVER (ORDER BY reach DESC, item) AS pop FROM hd),
 k AS (SELECT item, pop, CASE WHEN pop <= {_SHUFFLE} THEN round(reach / (reach + 3.0) * multiplier + 0.35 * ({fnv_sql('CAST(item AS VARCHAR)', 9)} >> 8) / 16777216.0, 9) END AS score FROM p)
 SELECT item, score, row_number() OVER (ORDER BY score DESC NULLS LAST, pop) AS place FROM k""")
def radio_shuffle_order(spark, d):
    """The shuffle: the most heard tracks by popularity, skips and chance, then all others by popularity. No order is sorted in one task."""
    tracks = heard(spark, d)
    pool = top_ranked(tracks.select("item", "reach", "multiplier"), [F.desc("reach"), F.asc("item")], _SHUFFLE, "pop")
    score = F.round(o.shrink(F.col("reach")) * F.col("multiplier") + 0.35 * h.unit(F.col("item").cast("string"), 9), 9)
    head = ranked_within(pool.withColumn("score", score).withColumn("one", F.lit(0)), ["one"], [F.desc("score"), F.asc("pop")], "place").select("item", "score", "place")
    rest = tracks.join(F.broadcast(head.select("item")), "item", "left_anti")
    placed = r.numbered(rest, [F.desc("reach"), F.asc("item")], "place").select("item", F.lit(None).cast("double").alias("score"), (F.col("place") + F.lit(_SHUFFLE)).alias("place"))
    return head.unionByName(placed)


@query("artist_lists", "WITH r AS (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1), k AS (SELECT artist_id, track_id AS item, row_number() OVER (PARTITION BY artist_id ORDER BY coalesce(reach, 0) DESC, track_id) AS place FROM track LEFT JOIN r ON item = track_id) SELECT * FROM k WHERE place <= 8")
def artist_lists(spark, d):
    """The index of a radio: each artist's tracks by reach."""
    return ranked_within(heard(spark, d).select("artist_id", "item", "reach"), ["artist_id"], [F.desc("reach"), F.asc("item")], "place").filter("place <= 8").drop("reach")


def _finalised_sql(x: str) -> str:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"CAST((CAST(xor({x}, ({x}) >> {shift}) AS HUGEINT) * {factor}) % 4294967296 AS BIGINT)"
    return f"xor({x}, ({x}) >> 16)"


@query("daily_rotation", f"""WITH {charts.community_sql(charts._engaged_sql())},
 h AS (SELECT *, {fnv_sql("playlist_id || ':19727'")} AS f, row_number() OVER (ORDER BY view_count DESC, members DESC, playlist_id) AS v FROM cp WHERE kept > 0),
 k AS (SELECT playlist_id, kept AS song_count, cover, CASE WHEN v <= {charts.ROW_ANCHORS} THEN v ELSE 0 END AS anchor, {_finalised_sql('f')} AS hsh FROM h)
 SELECT playlist_id, song_count, cover, row_number() OVER (ORDER BY anchor = 0, anchor, hsh, playlist_id) AS place FROM k ORDER BY place LIMIT {charts.ROW_PLACES}""")
def daily_rotation(spark, d, day: int = 19727):
    """The community row of a day (days since 1970): the most viewed survivors of the filter, then the others in an order that the day
    decides. Their counts and covers are of the surviving members."""
    pool = top_ranked(charts.community_pool(spark, d, charts.engaged(spark, d)).filter("kept > 0"), [F.desc("view_count"), F.desc("members"), F.asc("playlist_id")], charts.ROW_POOL, "v")
    anchor = F.when(F.col("v") <= charts.ROW_ANCHORS, F.col("v")).otherwise(F.lit(0))
    ranked = pool.withColumn("anchor", anchor).withColumn("hsh", h.finalise(h.fnv1a(F.concat("playlist_id", F.lit(f":{day}")))))
    return top_ranked(ranked, [(F.col("anchor") == 0).asc(), F.asc("anchor"), F.asc("hsh"), F.asc("playlist_id")], charts.ROW_PLACES, "place").select("playlist_id", F.col("kept").alias("song_count"), "cover", "place")


def _pool(spark, d):
    return heard(spark, d).select(F.element_at("genres", 1).alias("station"), "item", "artist_id", F.col("duration_sec").alias("dur_sec"), "reach", "multiplier")


#: When schedules begin.
START_MS = 1_700_000_000_000


@query("schedule", None)
def schedule(spark, d):
    """A day of each genre's station."""
    pool = _pool(spark, d)
    return r.schedules(pool, START_MS, 24, 7, r.flow(pool, edges(spark, d)))


_SCHEDULE = "sch AS (SELECT genres[1] AS station, track_id AS item, duration_sec AS dur_sec, CAST(coalesce(sum(duration_sec) OVER (PARTITION BY genres[1] ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_s FROM track)"


@query("prefix_starts", f"WITH {_SCHEDULE} SELECT * FROM sch")
def prefix_starts(spark, d):
    """Start times as prefix sums of the durations before."""
    return r.prefix_sums(_pool(spark, d).select("station", "item", "dur_sec"), ["station"], "item", "dur_sec", "start_s")


@query("schedule_at", f"WITH {_SCHEDULE}, tm AS (SELECT genres[1] AS station, track_id * 23 AS at_s FROM track) SELECT station, at_s, item, start_s, dur_sec FROM tm JOIN sch USING (station) WHERE at_s >= start_s AND at_s < start_s + dur_sec")
def schedule_at(spark, d):
    times = t.tracks(spark, d).select(F.element_at("genres", 1).alias("station"), (F.col("track_id") * 23).alias("at_s"))
    return r.on_air(prefix_starts(spark, d), times)


@query("schedule_guard", f"WITH {_SCHEDULE} SELECT * FROM sch WHERE start_s + dur_sec > 20000 - 21600 AND start_s <= 20000 + 600")
def schedule_guard(spark, d):
    return r.guard(prefix_starts(spark, d), 20_000)
