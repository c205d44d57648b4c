"""Charts and surfaces from telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from melisma.operators import telemetry as o
from melisma.operators.ranking import cap_per_group, keep_first, round_robin, top_ranked
from melisma.registry import query
from melisma.sources import tables as t

NOW = "timestamp'2024-01-30 00:00:00'"


def _window(plays, start: int, end: int = 0):
    """Plays of the days from NOW - start (in) to NOW - end (out)."""
    return plays.filter(F.expr(f"t >= {NOW} - INTERVAL {start} DAYS AND t < {NOW} - INTERVAL {end} DAYS"))


@query("reach", "SELECT item, kind, count(DISTINCT device) AS reach FROM play GROUP BY 1, 2")
def reach(spark, d):
    return o.reach(t.plays(spark, d), "item", "kind")


@query("approx_reach", None)
def approx_reach(spark, d):
    """Reach from a sketch, for streams and very large windows."""
    return t.plays(spark, d).groupBy("item").agg(F.approx_count_distinct("device", 0.02).alias("reach"))


@query("skip_rate", "SELECT item, count(*) FILTER (kind = 'play') AS listened, count(*) FILTER (kind IN ('play', 'skip')) AS total, least(1.0, greatest(0.35, (count(*) FILTER (kind = 'play') + 2.5) / (count(*) FILTER (kind IN ('play', 'skip')) + 5.0) / 0.5)) AS multiplier FROM play GROUP BY 1")
def skip_rate(spark, d):
    n = t.plays(spark, d).groupBy("item").agg(F.count_if(F.col("kind") == "play").alias("listened"), F.count_if(F.col("kind").isin("play", "skip")).alias("total"))
    return n.withColumn("multiplier", o.skip_multiplier(F.col("listened"), F.col("total")))


@query("reach_maxmerge", "SELECT item, max(reach) AS reach FROM (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1 UNION ALL SELECT item, count(DISTINCT device) FROM play WHERE kind = 'download' GROUP BY 1) GROUP BY 1")
def reach_maxmerge(spark, d):
    r = o.reach(t.plays(spark, d).filter("kind IN ('play', 'download')"), "item", "kind")
    return r.groupBy("item").agg(F.max("reach").alias("reach"))


def _scores(plays):
    """Reach of each kind as columns, and the share of skips."""
    r = o.reach(plays, "item", "kind").groupBy("item").pivot("kind", ["play", "favorite", "download", "impression"]).agg(F.first("reach"))
    skip = plays.filter("kind IN ('play', 'skip')").groupBy("item").agg(F.avg((F.col("kind") == "skip").cast("double")).alias("skip"))
    return r.join(skip, "item", "left").fillna(0.0, ["skip"]).fillna(0, ["play", "favorite", "download", "impression"])


_SCORES = """s AS (SELECT item, count(DISTINCT device) FILTER (kind = 'play') AS play, count(DISTINCT device) FILTER (kind = 'favorite') AS favorite, count(DISTINCT device) FILTER (kind = 'download') AS download,
 coalesce(avg(CASE WHEN kind IN ('play', 'skip') THEN CAST(kind = 'skip' AS INT) END), 0.0) AS skip FROM play GROUP BY 1)"""


@query("top_played", f"WITH {_SCORES}, k AS (SELECT item, play / (play + 3.0) * (1 - least(skip, 0.8)) AS score, 1.2 * favorite / (favorite + 3.0) + 0.3 * download / (download + 3.0) AS tie FROM s), r AS (SELECT k.*, title, row_number() OVER (PARTITION BY title, artist_id ORDER BY round(score, 9) DESC, round(tie, 9) DESC, item) AS rn FROM k JOIN track ON track_id = item) SELECT item, title, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, round(tie, 9) DESC, item) AS rank FROM r WHERE rn = 1 ORDER BY rank LIMIT 50")
def top_played(spark, d, n: int = 50):
    """The play chart: shrunken reach less skips, ties by favourites and downloads, one of each (title, artist)."""
    s = _scores(t.plays(spark, d))
    score = F.round(o.shrink(F.col("play")) * (1 - F.least("skip", F.lit(0.8))), 9)
    tie = F.round(1.2 * o.shrink(F.col("favorite")) + 0.3 * o.shrink(F.col("download")), 9)
    order = [F.desc("score"), F.desc("tie"), F.asc("item")]
    k = s.select("item", score.alias("score"), tie.alias("tie")).join(t.tracks(spark, d).select(F.col("track_id").alias("item"), "title", "artist_id"), "item")
    return top_ranked(keep_first(k, ["title", "artist_id"], order), order, n).select("item", "title", "score", "rank")


@query("trending_velocity", "WITH cur AS (SELECT item, count(DISTINCT device) AS d FROM play WHERE kind = 'play' AND t >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND t < TIMESTAMP '2024-01-30' GROUP BY 1), prev AS (SELECT item, count(DISTINCT device) AS p FROM play WHERE kind = 'play' AND t >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY AND t < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY 1 ORDER BY p DESC, item LIMIT 60), cap AS (SELECT CASE WHEN count(*) >= 60 THEN min(p) ELSE 0 END AS absent FROM prev) SELECT item, d, coalesce(p, absent) AS baseline, greatest(0, d - coalesce(p, absent)) AS velocity FROM cur LEFT JOIN prev USING (item), cap WHERE d >= 3 ORDER BY velocity DESC, d DESC, item LIMIT 25")
def trending_velocity(spark, d, cap: int = 60):
    """Reach of this week over that of a capped list of the week before, floored at zero."""
    plays = t.plays(spark, d).filter("kind = 'play'")
    cur = o.reach(_window(plays, 7), "item").withColumnRenamed("reach", "d").filter("d >= 3")
    prev = o.reach(_window(plays, 14, 7), "item").withColumnRenamed("reach", "p").orderBy(F.desc("p"), "item").limit(cap)
    base = F.coalesce("p", "absent")
    found = cur.join(prev, "item", "left").join(F.broadcast(o.capped_default(prev, "p", cap)))
    return found.select("item", "d", base.alias("baseline"), F.greatest(F.lit(0), F.col("d") - base).alias("velocity")).orderBy(F.desc("velocity"), F.desc("d"), "item").limit(25)


@query("trending_reach", f"WITH {_SCORES} SELECT item, play, round(play * (1 - 0.5 * skip), 9) AS score FROM s WHERE play >= 3 AND skip < 0.5 ORDER BY score DESC, play DESC, item LIMIT 25")
def trending_reach(spark, d):
    s = _scores(t.plays(spark, d)).filter("play >= 3 AND skip < 0.5")
    return s.select("item", "play", F.round(F.col("play") * (1 - 0.5 * F.col("skip")), 9).alias("score")).orderBy(F.desc("score"), F.desc("play"), "item").limit(25)


@query("favorites", f"WITH {_SCORES} SELECT item, round(1.2 * favorite / (favorite + 3.0) + 0.3 * download / (download + 3.0), 9) AS score FROM s WHERE favorite > 0 ORDER BY score DESC, item LIMIT 30")
def favorites(spark, d):
    s = _scores(t.plays(spark, d)).filter("favorite > 0")
    return s.select("item", F.round(1.2 * o.shrink(F.col("favorite")) + 0.3 * o.shrink(F.col("download")), 9).alias("score")).orderBy(F.desc("score"), "item").limit(30)


@query("downloads_capped", f"WITH {_SCORES}, k AS (SELECT item, download, play, first_album AS album_id FROM s LEFT JOIN (SELECT track_id, min(album_id) AS first_album FROM album_track GROUP BY 1) ON track_id = item), r AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY download DESC, play DESC, item) AS rn FROM k) SELECT item, album_id, download FROM r WHERE album_id IS NULL OR rn <= 1 ORDER BY download DESC, play DESC, item LIMIT 30")
def downloads_capped(spark, d):
    """Downloads, one track of each album; tracks without one are not capped."""
    album = t.album_tracks(spark, d).groupBy(F.col("track_id").alias("item")).agg(F.min("album_id").alias("album_id"))
    order = [F.desc("download"), F.desc("play"), F.asc("item")]
    return cap_per_group(_scores(t.plays(spark, d)).join(album, "item", "left"), "album_id", order, 1).orderBy(*order).limit(30).select("item", "album_id", "download")


@query("season_top", "WITH w AS (SELECT item, count(DISTINCT device) AS d, avg(CAST(kind = 'skip' AS INT)) AS skip FROM play WHERE kind IN ('play', 'skip') AND t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20' AND item IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY 1) SELECT item, d, round(d * (1 - 0.5 * skip), 9) AS score FROM w ORDER BY score DESC, item LIMIT 50")
def season_top(spark, d):
    curated = t.load(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("item"))
    w = t.plays(spark, d).filter(F.expr("kind IN ('play', 'skip') AND t >= timestamp'2024-01-10' AND t < timestamp'2024-01-20'")).join(curated, "item", "left_semi")
    n = o.reach(w, "item").withColumnRenamed("reach", "d").join(w.groupBy("item").agg(F.avg((F.col("kind") == "skip").cast("double")).alias("skip")), "item")
    return n.select("item", "d", F.round(F.col("d") * (1 - 0.5 * F.col("skip")), 9).alias("score")).orderBy(F.desc("score"), "item").limit(50)


@query("exposure", "WITH e AS (SELECT item, count(DISTINCT device) FILTER (kind = 'impression') AS exposed, count(DISTINCT device) AS devices FROM play GROUP BY 1) SELECT item, exposed, devices, round(1.0 - 0.35 * least(1.0, exposed / devices), 9) AS multiplier FROM e")
def exposure(spark, d):
    plays = t.plays(spark, d)
    e = o.reach(plays, "item").withColumnRenamed("reach", "devices").join(o.reach(plays.filter("kind = 'impression'"), "item").withColumnRenamed("reach", "exposed"), "item", "left").fillna(0, ["exposed"])
    return e.select("item", "exposed", "devices", F.round(o.exposure_multiplier(F.col("exposed"), F.col("devices")), 9).alias("multiplier"))


@query("exposure_gate", "WITH s AS (SELECT 'surface' || (item % 4) AS surface, count(DISTINCT device) AS devices FROM play WHERE kind = 'impression' GROUP BY 1), g AS (SELECT count(*) FILTER (devices >= 10 AND surface IN ('surface0', 'surface1', 'surface2')) AS ok, (SELECT count(DISTINCT device) FROM play WHERE kind = 'impression') AS seen, (SELECT count(DISTINCT device) FROM play) AS every FROM s) SELECT CASE WHEN ok < 3 THEN 'missing-surface' WHEN seen < 20 THEN 'few-devices' WHEN seen < 0.6 * every THEN 'coverage' ELSE 'on' END AS reason, ok = 3 AND seen >= 20 AND seen >= 0.6 * every AS gate FROM g")
def exposure_gate(spark, d):
    """Whether exposure may be used: all surfaces measured, enough devices, enough coverage; the first reason against it."""
    plays = t.plays(spark, d)
    shown = plays.filter("kind = 'impression'").withColumn("surface", F.concat(F.lit("surface"), F.col("item") % 4))
    ok = o.reach(shown, "surface").filter((F.col("reach") >= 10) & F.col("surface").isin("surface0", "surface1", "surface2")).agg(F.count("*").alias("ok"))
    devices = plays.groupBy("device").agg(F.bool_or(F.col("kind") == "impression").alias("saw")).agg(F.count("*").alias("every"), F.count_if("saw").alias("seen"))
    reason = F.when(F.col("ok") < 3, "missing-surface").when(F.col("seen") < 20, "few-devices").when(F.col("seen") < 0.6 * F.col("every"), "coverage").otherwise("on")
    return ok.join(F.broadcast(devices)).select(reason.alias("reason"), (reason == "on").alias("gate"))


@query("home_albums", "WITH r AS (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1) SELECT x.album_id, max(reach) AS reach FROM album_track x JOIN r ON r.item = x.track_id GROUP BY 1 ORDER BY reach DESC, album_id LIMIT 40")
def home_albums(spark, d):
    """An album has the largest reach of its tracks."""
    r = o.reach(t.plays(spark, d).filter("kind = 'play'"), "item")
    return t.album_tracks(spark, d).join(r.withColumnRenamed("item", "track_id"), "track_id").groupBy("album_id").agg(F.max("reach").alias("reach")).orderBy(F.desc("reach"), "album_id").limit(40)


@query("home_videos", "WITH r AS (SELECT item, count(DISTINCT device) AS reach FROM play GROUP BY 1), v AS (SELECT artist_id, track_id, coalesce(reach, 0) AS reach FROM track LEFT JOIN r ON item = track_id WHERE is_video), a AS (SELECT artist_id, max(reach) AS best FROM v GROUP BY 1), k AS (SELECT v.*, best, row_number() OVER (PARTITION BY artist_id ORDER BY reach DESC, track_id) AS turn FROM v JOIN a USING (artist_id)) SELECT track_id, artist_id, turn, row_number() OVER (ORDER BY turn, best DESC, artist_id) AS rank FROM k ORDER BY rank LIMIT 60")
def home_videos(spark, d):
    """Videos dealt out round-robin over artists, the most heard artist first."""
    r = o.reach(t.plays(spark, d), "item").withColumnRenamed("item", "track_id")
    v = t.tracks(spark, d).filter("is_video").select("artist_id", "track_id").join(r, "track_id", "left").fillna(0, ["reach"])
    v = v.join(v.groupBy("artist_id").agg(F.max("reach").alias("best")), "artist_id")
    return round_robin(v, "artist_id", [F.desc("best"), F.asc("artist_id")], [F.desc("reach"), F.asc("track_id")], 60).select("track_id", "artist_id", "turn", "rank")


#: A community row: runtime in seconds from which a playlist counts, its pool by views, places, and how many of them are fixed.
MIN_RUNTIME, ROW_POOL, ROW_PLACES, ROW_ANCHORS = 2400, 400, 32, 8


def community_sql(engaged: str) -> str:
    """Common table expressions up to cp(playlist_id, view_count, runtime, members, kept, cover), the pool by views."""
    return f"""eng AS ({engaged}), mem AS (SELECT playlist_id, track_id, pos, duration_sec, is_female FROM playlist_track JOIN track USING (track_id) JOIN artist USING (artist_id)),
m AS (SELECT playlist_id, CAST(sum(duration_sec) AS BIGINT) AS runtime, count(*) AS members, bool_or(track_id IN (SELECT item FROM eng)) OR (SELECT count(*) FROM eng) = 0 AS engaged,
  count(*) FILTER (NOT is_female) AS kept, arg_min(track_id, struct_pack(a := pos, b := track_id)) FILTER (NOT is_female) AS cover FROM mem GROUP BY 1),
cp AS (SELECT playlist_id, view_count, runtime, members, kept, cover FROM playlist JOIN m USING (playlist_id) WHERE view_count IS NOT NULL AND runtime >= {MIN_RUNTIME} AND engaged ORDER BY view_count DESC, members DESC, playlist_id LIMIT {ROW_POOL})"""


def _engaged_sql() -> str:
    from melisma import registry

    return " UNION ".join(f"SELECT item FROM ({registry._FOUND[name][1]})" for name in ("top_played", "trending_velocity", "favorites"))


def community_pool(spark, d, engaged):
    """Playlists with views that are long enough and hold a track of the engaged ones (a small table of items; if it is empty, all do).

    kept and cover are those of the members that the strictest filter keeps.
    """
    some = not engaged.isEmpty()
    listed = F.broadcast(engaged.select(F.col("item").alias("track_id"), F.lit(True).alias("listed")).distinct())
    owners = t.artists(spark, d).select("artist_id", "is_female")
    members = t.playlist_tracks(spark, d).join(t.tracks(spark, d).select("track_id", "duration_sec", "artist_id").join(owners, "artist_id"), "track_id").join(listed, "track_id", "left")
    free = ~F.col("is_female")
    m = members.groupBy("playlist_id").agg(
        F.sum("duration_sec").alias("runtime"), F.count("*").alias("members"), F.count("listed").alias("hits"), F.count_if(free).alias("kept"), F.min(F.when(free, F.struct("pos", "track_id")))["track_id"].alias("cover")
    )
    fit = m.filter(F.col("runtime") >= MIN_RUNTIME).filter((F.col("hits") > 0) | F.lit(not some))
    found = t.playlists(spark, d).filter("view_count IS NOT NULL").join(fit, "playlist_id").orderBy(F.desc("view_count"), F.desc("members"), "playlist_id").limit(ROW_POOL)
    return found.select("playlist_id", "view_count", "runtime", "members", "kept", "cover")


def engaged(spark, d):
    """The items of the charts that listeners make."""
    return top_played(spark, d).select("item").union(trending_velocity(spark, d).select("item")).union(favorites(spark, d).select("item"))


@query("community_top", f"WITH {community_sql(_engaged_sql())} SELECT playlist_id, view_count, runtime FROM cp ORDER BY view_count DESC, members DESC, playlist_id LIMIT 40")
def community_top(spark, d):
    """Playlists long enough that hold an engaged track, by views."""
    return community_pool(spark, d, engaged(spark, d)).orderBy(F.desc("view_count"), F.desc("members"), "playlist_id").limit(40).select("playlist_id", "view_count", "runtime")


@query("rank_gaps", "WITH r AS (SELECT item, row_number() OVER (ORDER BY count(DISTINCT device) DESC, item) AS rank FROM play WHERE kind = 'play' GROUP BY 1) SELECT item, rank FROM r JOIN track ON track_id = item WHERE NOT is_video AND rank <= 50")
def rank_gaps(spark, d):
    """Ranks are those of the whole chart; a filter leaves gaps."""
    ranked = top_ranked(o.reach(t.plays(spark, d).filter("kind = 'play'"), "item"), [F.desc("reach"), F.asc("item")], 50)
    return ranked.join(t.tracks(spark, d).filter("NOT is_video").select(F.col("track_id").alias("item")), "item", "left_semi").select("item", "rank")


_CHART = "SELECT item, row_number() OVER (ORDER BY count(DISTINCT device) DESC, item) AS rank FROM play WHERE kind = 'play' AND t >= {a} AND t < {z} GROUP BY 1"


def _chart(plays, start: int, end: int, n: int = 50):
    return top_ranked(o.reach(_window(plays, start, end), "item"), [F.desc("reach"), F.asc("item")], n).select("item", "rank")


@query("badges", f"WITH cur AS ({_CHART.format(a='TIMESTAMP ' + repr('2024-01-23'), z='TIMESTAMP ' + repr('2024-01-30'))}), prev AS ({_CHART.format(a='TIMESTAMP ' + repr('2024-01-16'), z='TIMESTAMP ' + repr('2024-01-23'))}), old AS ({_CHART.format(a='TIMESTAMP ' + repr('2024-01-02'), z='TIMESTAMP ' + repr('2024-01-16'))}) SELECT cur.item, cur.rank, prev.rank AS prev_rank, prev.rank - cur.rank AS delta, CASE WHEN prev.rank IS NOT NULL THEN 'move' WHEN old.item IS NOT NULL THEN 'reentry' ELSE 'new' END AS badge FROM cur LEFT JOIN (SELECT * FROM prev WHERE rank <= 50) prev USING (item) LEFT JOIN (SELECT * FROM old WHERE rank <= 50) old USING (item) WHERE cur.rank <= 50")
def badges(spark, d):
    plays = t.plays(spark, d).filter("kind = 'play'")
    first = _chart(plays, 28, 14).select("item", F.expr(f"{NOW} - INTERVAL 14 DAYS").alias("first_t"))
    return o.badges(_chart(plays, 7, 0), _chart(plays, 14, 7).withColumnRenamed("rank", "prev_rank"), first, F.expr(NOW))


@query("anchor_pick", "WITH runs AS (SELECT date_trunc('day', ts) AS day, min(ts) AS t FROM events GROUP BY 1), w AS (SELECT t, CAST(date_trunc('day', t) AS DATE) - CAST(dayofweek(t) AS INT) AS week FROM runs) SELECT week, min(t) AS anchor FROM w GROUP BY 1")
def anchor_pick(spark, d):
    """The earliest run of each week (weeks start on Sunday)."""
    runs = t.load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("t"))
    return runs.groupBy(o.week_start(F.col("t")).alias("week")).agg(F.min("t").alias("anchor"))


@query("nearest_baseline", "WITH runs AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS t, count(*) AS n FROM events GROUP BY 1), k AS (SELECT a.day, b.day AS base_day, row_number() OVER (PARTITION BY a.day ORDER BY abs(epoch_us(b.t) - epoch_us(a.t - INTERVAL 7 DAY)), b.day) AS rn FROM runs a JOIN runs b ON abs(epoch_us(b.t) - epoch_us(a.t - INTERVAL 7 DAY)) <= 48 * 3600000000) SELECT day, base_day FROM k WHERE rn = 1")
def nearest_baseline(spark, d, days: int = 7, tolerance_h: int = 48):
    """As-of nearest: the run closest to a week before, within the tolerance. Equi join on the day bucket and its neighbours."""
    runs = t.load(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("t"))
    reach_days = tolerance_h // 24 + 1
    a = runs.select("day", F.expr(f"t - INTERVAL {days} DAYS").alias("target")).withColumn("near", F.explode(F.transform(F.sequence(F.lit(-reach_days), F.lit(reach_days)), lambda k: F.date_add(F.to_date("target"), k))))
    b = runs.select(F.col("day").alias("near"), F.col("t").alias("bt"))
    gap = F.abs(F.unix_micros(F.col("bt").cast("timestamp")) - F.unix_micros(F.col("target").cast("timestamp")))
    found = a.join(b, "near").withColumn("gap", gap).filter(F.col("gap") <= tolerance_h * 3_600_000_000)
    return found.groupBy("day").agg(F.min_by("near", F.struct("gap", "near")).alias("base_day"))


@query("first_charted", "WITH daily AS (SELECT CAST(ts AS DATE) AS day, item, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY count(*) DESC, item) AS rk FROM (SELECT t AS ts, item FROM play WHERE kind = 'play') GROUP BY 1, 2) SELECT item, min(day) AS first_day, count(*) AS days FROM daily WHERE rk <= 10 GROUP BY 1")
def first_charted(spark, d):
    daily = t.plays(spark, d).filter("kind = 'play'").groupBy(F.to_date("t").alias("day"), "item").agg(F.count("*").alias("n"))
    w = Window.partitionBy("day").orderBy(F.desc("n"), "item")
    return daily.withColumn("rk", F.row_number().over(w)).filter("rk <= 10").groupBy("item").agg(F.min("day").alias("first_day"), F.count("*").alias("days"))


@query("podcast_surface", "WITH ep AS (SELECT item % 20 AS show_id, item, count(DISTINCT device) AS reach, avg(value) AS completion FROM play WHERE kind = 'play' GROUP BY 1, 2), sub AS (SELECT item % 20 AS show_id, count(DISTINCT device) AS subs FROM play WHERE kind = 'download' GROUP BY 1) SELECT coalesce(e.show_id, s.show_id) AS show_id, CAST(coalesce(qualified, 0) + 3 * coalesce(subs, 0) AS BIGINT) AS score, coalesce(episodes, 0) AS episodes FROM (SELECT show_id, CAST(sum(reach) FILTER (completion >= 100) AS BIGINT) AS qualified, count(*) AS episodes FROM ep GROUP BY 1) e FULL JOIN sub s ON s.show_id = e.show_id")
def podcast_surface(spark, d):
    plays = t.plays(spark, d).withColumn("show_id", F.col("item") % 20)
    heard = plays.filter("kind = 'play'")
    ep = o.reach(heard, "show_id", "item").join(heard.groupBy("item").agg(F.avg("value").alias("completion")), "item").groupBy("show_id").agg(F.sum(F.when(F.col("completion") >= 100, F.col("reach"))).alias("qualified"), F.count("*").alias("episodes"))
    sub = o.reach(plays.filter("kind = 'download'"), "show_id").withColumnRenamed("reach", "subs")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ep.join(sub, "show_id", "full_outer").select("show_id", (zero("qualified") + 3 * zero("subs")).alias("score"), zero("episodes").alias("episodes"))


@query("trending_episodes", "SELECT item, round(count(DISTINCT device) * avg(value), 6) AS score FROM play WHERE kind = 'play' GROUP BY 1 ORDER BY score DESC, item LIMIT 20")
def trending_episodes(spark, d):
    heard = t.plays(spark, d).filter("kind = 'play'")
    found = o.reach(heard, "item").join(heard.groupBy("item").agg(F.avg("value").alias("completion")), "item")
    return found.select("item", F.round(F.col("reach") * F.col("completion"), 6).alias("score")).orderBy(F.desc("score"), "item").limit(20)


@query("home_dedup", "WITH a AS (SELECT c_custkey AS show_id, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer), top AS (SELECT show_id FROM a WHERE rn = 1), b AS (SELECT o_custkey AS show_id, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY max(o_orderdate) DESC, o_custkey) AS rn FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey NOT IN (SELECT show_id FROM top) GROUP BY 1, 2) SELECT 'top' AS home_row, show_id FROM top UNION ALL SELECT 'fresh', show_id FROM b WHERE rn = 1")
def home_dedup(spark, d):
    """One show of each channel in each row; a show stays in the first row that takes it."""
    shows = t.load(spark, d, "customer").select(F.col("c_custkey").alias("show_id"), "c_nationkey", "c_acctbal")
    top = keep_first(shows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("show_id")]).select("show_id")
    fresh = t.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("show_id")).agg(F.max("o_orderdate").alias("at")).join(shows, "show_id").join(top, "show_id", "left_anti")
    second = keep_first(fresh, ["c_nationkey"], [F.desc("at"), F.asc("show_id")]).select("show_id")
    return top.select(F.lit("top").alias("home_row"), "show_id").union(second.select(F.lit("fresh").alias("home_row"), "show_id"))


@query("sessions", "WITH g AS (SELECT device, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, event_id) >= INTERVAL 30 MINUTE OR lag(t) OVER (PARTITION BY device ORDER BY t, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM play), s AS (SELECT device, t, CAST(sum(new) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT device, session, min(t) AS started, max(t) AS ended, count(*) AS events FROM s GROUP BY 1, 2")
def sessions(spark, d):
    return o.sessions(t.plays(spark, d)).groupBy("device", "session").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count("*").alias("events"))


@query("session_windows", "WITH g AS (SELECT device, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, event_id) >= INTERVAL 30 MINUTE OR lag(t) OVER (PARTITION BY device ORDER BY t, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM play), s AS (SELECT device, t, sum(new) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT device, min(t) AS started, count(*) AS events FROM s GROUP BY device, session")
def session_windows(spark, d):
    return t.plays(spark, d).groupBy("device", F.session_window("t", "30 minutes")).agg(F.count("*").alias("events")).select("device", F.col("session_window.start").alias("started"), "events")


@query("tumbling_reach", "SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS day, kind, count(DISTINCT device) AS reach FROM play GROUP BY 1, 2")
def tumbling_reach(spark, d):
    return o.reach(t.plays(spark, d).withColumn("day", F.window("t", "1 day")["start"]), "day", "kind")


@query("sliding_reach", "WITH w AS (SELECT TIMESTAMP '2023-12-26' + i * INTERVAL 1 DAY AS start FROM range(60) r(i)) SELECT start, count(DISTINCT device) AS reach FROM w JOIN play ON t >= start AND t < start + INTERVAL 7 DAY WHERE kind = 'favorite' GROUP BY 1")
def sliding_reach(spark, d):
    return o.reach(t.plays(spark, d).filter("kind = 'favorite'").withColumn("start", F.window("t", "7 days", "1 day")["start"]), "start")


@query("new_release_artists", "SELECT DISTINCT l_suppkey AS artist_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def new_release_artists(spark, d):
    known = t.load(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return t.load(spark, d, "lineitem").filter(F.expr("l_shipdate >= timestamp'2001-06-01'")).join(known, "l_partkey", "left_anti").select(F.col("l_suppkey").alias("artist_id")).distinct()


#: Kinds of events that put a track into a device's library; history comes as plays.
LIBRARY = ["play", "favorite", "download"]


_SESSIONS = "WITH g AS (SELECT device, item, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, event_id) >= INTERVAL {gap} MINUTE OR lag(t) OVER (PARTITION BY device ORDER BY t, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM play WHERE kind = 'play'), s AS (SELECT DISTINCT device, sum(new) OVER (PARTITION BY device ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session, item FROM g), n AS (SELECT item, count(*) AS n FROM s GROUP BY 1), b AS (SELECT x.item AS src, y.item AS dst, count(*) AS both_n, count(DISTINCT x.device) AS devices FROM s x JOIN s y ON x.device = y.device AND x.session = y.session AND x.item <> y.item GROUP BY 1, 2) SELECT src, dst, round(both_n / sqrt(a.n * c.n), 9) AS score FROM b JOIN n a ON a.item = src JOIN n c ON c.item = dst WHERE devices >= 2"


@query("cooc_session", _SESSIONS.format(gap=30))
def cooc_session(spark, d, gap: int = 30):
    """Tracks played in the same listening sessions; only live plays make sessions here."""
    return o.cooccurrence(o.sessions(t.plays(spark, d).filter("kind = 'play'"), gap), ["device", "session"]).withColumn("score", F.round("score", 9))


@query("cooc_session_days", _SESSIONS.format(gap=36 * 60))
def cooc_session_days(spark, d):
    """The same where a session ends after a day and a half without a play, for telemetry in which plays are far apart."""
    return cooc_session(spark, d, 36 * 60)


@query("cooc_library", "WITH s AS (SELECT DISTINCT device, item FROM play WHERE kind IN ('play', 'favorite', 'download')), n AS (SELECT item, count(*) AS n FROM s GROUP BY 1), b AS (SELECT x.item AS src, y.item AS dst, count(*) AS both_n FROM s x JOIN s y ON x.device = y.device AND x.item <> y.item GROUP BY 1, 2) SELECT src, dst, round(both_n / sqrt(a.n * c.n), 9) AS score FROM b JOIN n a ON a.item = src JOIN n c ON c.item = dst WHERE both_n >= 2")
def cooc_library(spark, d):
    """Tracks that stand in the same devices' libraries."""
    return o.cooccurrence(t.plays(spark, d).filter(F.col("kind").isin(LIBRARY)), ["device"]).withColumn("score", F.round("score", 9))


@query("cooc_artist", "WITH s AS (SELECT DISTINCT device, artist_id AS item FROM play JOIN track ON track_id = play.item WHERE kind IN ('play', 'favorite', 'download')), n AS (SELECT item, count(*) AS n FROM s GROUP BY 1), b AS (SELECT x.item AS src, y.item AS dst, count(*) AS both_n FROM s x JOIN s y ON x.device = y.device AND x.item <> y.item GROUP BY 1, 2) SELECT src, dst, round(both_n / sqrt(a.n * c.n), 9) AS score FROM b JOIN n a ON a.item = src JOIN n c ON c.item = dst WHERE both_n >= 2")
def cooc_artist(spark, d):
    """Artists of which the same devices hold anything."""
    by = t.tracks(spark, d).select(F.col("track_id").alias("item"), "artist_id")
    plays = t.plays(spark, d).filter(F.col("kind").isin(LIBRARY)).join(by, "item").select("device", F.col("artist_id").alias("item"))
    return o.cooccurrence(plays, ["device"]).withColumn("score", F.round("score", 9))


@query("graph_in_corpus", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity < 10) SELECT src, dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def graph_in_corpus(spark, d):
    """Edges both of whose ends are in the corpus."""
    ids = t.load(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    e = t.load(spark, d, "lineitem").filter("l_quantity < 10").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return e.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
