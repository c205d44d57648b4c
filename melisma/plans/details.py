"""Stations of every kind, and the smaller surfaces: settings, limits, tokens, signatures, changes of files, home rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma import registry
from melisma.functions import pages, parse
from melisma.functions import text as tx
from melisma.operators import merge
from melisma.operators import recommend as r
from melisma.operators import telemetry as o
from melisma.operators.ranking import keep_first, ranked_within, top_ranked
from melisma.plans import recommend as radio
from melisma.plans.recommend import fnv_sql
from melisma.registry import query
from melisma.sources import landing, shared
from melisma.sources import tables as t


def _graph(name: str) -> str:
    return f"({registry._FOUND[name][1]})"


_UNIT = f"({fnv_sql('CAST(item AS VARCHAR)')} >> 8) / 16777216.0"
_HEARD = f"""hd AS (SELECT track_id AS item, artist_id, genres, coalesce(reach, 0) AS reach, coalesce(multiplier, 1.0) AS multiplier FROM track LEFT JOIN (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1) a ON a.item = track_id LEFT JOIN {_graph('skip_rate')} b ON b.item = track_id),
 se AS {_graph('cooc_session')}, li AS {_graph('cooc_library')}, ar AS {_graph('cooc_artist')}, ft AS (SELECT *, row_number() OVER (PARTITION BY artist_id ORDER BY reach DESC, item) AS rn FROM hd)"""


def _station_sql(members: str, seed: str, owner: str, placed: str) -> str:
    """Scores of stations from members mb(station, item, place), and what of them is seed, owner and placed."""
    return f"""WITH {_HEARD}, m0 AS ({members}), mb AS (SELECT m0.*, artist_id, reach, round(reach / (reach + 3.0) + 0.35 * {_UNIT}, 9) AS pull, row_number() OVER (PARTITION BY station ORDER BY reach DESC, item) AS pop, row_number() OVER (PARTITION BY station ORDER BY place, item) AS n FROM m0 JOIN hd USING (item)),
 seed AS ({seed}), owner AS ({owner}), placed AS ({placed}),
 rel AS (SELECT station, dst AS artist_id, score, row_number() OVER (PARTITION BY station ORDER BY score DESC, dst) AS rn FROM owner JOIN ar ON src = artist_id),
 s AS (SELECT station, dst AS item, 2.0 * score AS s FROM seed JOIN se ON src = seed.item UNION ALL SELECT station, dst, 1.25 * score FROM seed JOIN li ON src = seed.item
  UNION ALL SELECT station, hd.item, 0.2 * reach / (reach + 3.0) FROM owner JOIN hd USING (artist_id) UNION ALL SELECT station, ft.item, 0.08 * score * reach / (reach + 3.0) FROM rel JOIN ft USING (artist_id) WHERE rel.rn <= 15 AND ft.rn <= 5),
 total AS (SELECT station, item, sum(s) AS s FROM s WHERE (station, item) NOT IN (SELECT station, item FROM placed) GROUP BY 1, 2)
, sc AS (SELECT station, item, round(s * multiplier + 0.03 * {_UNIT}, 6) AS score FROM total JOIN hd USING (item))
 SELECT station, item, score, row_number() OVER (PARTITION BY station ORDER BY score DESC, item) AS place FROM sc QUALIFY place <= 25"""


def _station(spark, d, kind: str, members):
    """The first page of what follows each station's opening."""
    tracks, edges = shared.stored(radio.heard(spark, d), "heard"), shared.stored(radio.edges(spark, d), "edges")  # read many times below
    begin = r.start(kind, members, tracks, edges)
    placed = begin.opening.select("station", "item")
    return r.best(begin.seeds, edges, tracks, begin.owners, placed, 25)


_NONE = "SELECT station, artist_id FROM mb WHERE false"
_LEAD = "SELECT station, arg_max(item, struct_pack(a := pull, b := -item)) AS item FROM mb WHERE pop <= {n} GROUP BY 1"


@query("radio_song", _station_sql(
    "SELECT track_id AS station, track_id AS item, 1 AS place FROM track",
    "SELECT station, item FROM mb UNION SELECT mb.station, ft.item FROM mb JOIN ft USING (artist_id) WHERE ft.rn <= 8 AND mb.item NOT IN (SELECT src FROM se UNION SELECT src FROM li)",
    "SELECT station, artist_id FROM mb", "SELECT station, item FROM mb"))
def radio_song(spark, d):
    """A station of each song: it opens with the song; a song without neighbours draws on its artist's."""
    return _station(spark, d, "song", t.tracks(spark, d).select(F.col("track_id").alias("station"), F.col("track_id").alias("item"), F.lit(1).alias("place")))


@query("radio_artist", _station_sql("SELECT artist_id AS station, track_id AS item, 1 AS place FROM track", "SELECT station, item FROM mb WHERE pop <= 8", "SELECT DISTINCT station, artist_id FROM mb", _LEAD.format(n=1 << 40)))
def radio_artist(spark, d):
    """A station of each artist: it opens with one of the artist's own tracks, and draws on the most heard of them."""
    return _station(spark, d, "artist", t.tracks(spark, d).select(F.col("artist_id").alias("station"), F.col("track_id").alias("item"), F.lit(1).alias("place")))


@query("radio_album", _station_sql(
    "SELECT album_id AS station, track_id AS item, x.pos AS place FROM album_track x JOIN album USING (album_id)",
    "SELECT station, item FROM mb WHERE n <= 8", "SELECT station, artist_id FROM mb WHERE n = 1", "SELECT station, item FROM mb"))
def radio_album(spark, d):
    """A station of each album, which plays through first."""
    known = t.albums(spark, d).select("album_id")
    return _station(spark, d, "album", t.album_tracks(spark, d).join(known, "album_id").select(F.col("album_id").alias("station"), F.col("track_id").alias("item"), F.col("pos").alias("place")))


@query("radio_playlist", _station_sql("SELECT playlist_id AS station, track_id AS item, pos AS place FROM playlist_track", "SELECT station, item FROM mb WHERE n <= 50", _NONE, "SELECT station, item FROM mb WHERE false"))
def radio_playlist(spark, d):
    """A station of each playlist's taste: neighbours of its tracks, which may come again."""
    return _station(spark, d, "playlist", t.playlist_tracks(spark, d).select(F.col("playlist_id").alias("station"), F.col("track_id").alias("item"), F.col("pos").alias("place")))


@query("radio_genre", _station_sql("SELECT unnest(genres) AS station, track_id AS item, 1 AS place FROM track", "SELECT station, item FROM mb WHERE pop <= 50", _NONE, _LEAD.format(n=40)))
def radio_genre(spark, d):
    """A station of each genre: it opens with one of its popular tracks."""
    return _station(spark, d, "genre", t.tracks(spark, d).select(F.explode("genres").alias("station"), F.col("track_id").alias("item"), F.lit(1).alias("place")))


@query("voices_intent", "WITH v AS (SELECT track_id FROM track WHERE track_id % 4 < 2) SELECT artist_id AS station, 'artist' AS kind, count(*) FILTER (track_id % 4 < 2) * 2 > count(*) AS allowed FROM track GROUP BY 1 UNION ALL SELECT playlist_id, 'playlist', coalesce(bool_or(track_id % 4 < 2), false) FROM playlist LEFT JOIN playlist_track USING (playlist_id) GROUP BY 1")
def voices_intent(spark, d):
    """Whether a seed asks for recordings with voices only: most of an artist's tracks, or any of a playlist's."""
    tracks = t.tracks(spark, d)
    voices = tracks.filter("track_id % 4 < 2").select(F.col("track_id").alias("item"))
    own = tracks.select(F.col("artist_id").alias("station"), F.col("track_id").alias("item"))
    lists = t.playlist_tracks(spark, d).select(F.col("playlist_id").alias("station"), F.col("track_id").alias("item"))
    a = r.allowed_voices("artist", own.select("station").distinct(), own, voices).select("station", F.lit("artist").alias("kind"), "allowed")
    return a.union(r.allowed_voices("playlist", t.playlists(spark, d).select(F.col("playlist_id").alias("station")), lists, voices).select("station", F.lit("playlist").alias("kind"), "allowed"))


@query("voices_only", "SELECT track_id, track_id % 8 IN (0, 2, 3, 6) AS marked FROM track")
def voices_only(spark, d):
    """The strict mark admits what says so clearly, and no vocalist or vocals."""
    ends = F.array(*(F.lit(x) for x in (" a capella", " vocal", " (Vocal)", " Vocal  Version", " vocalist", " live", " A-Cappela mix", "")))
    return t.tracks(spark, d).select("track_id", tx.voices_only(F.concat("title", F.element_at(ends, (F.col("track_id") % 8 + 1).cast("int")))).alias("marked"))


@query("settings_put", "SELECT n_name AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'new' || n_nationkey ELSE 'r' || n_regionkey END AS v FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def settings_put(spark, d):
    """Key-value settings: new values over old ones, new keys beside them."""
    nation = t.load(spark, d, "nation")
    have = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("v"))
    return merge.put(have, nation.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), F.concat(F.lit("new"), "n_nationkey").alias("v")))


@query("clamped", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 25 ELSE greatest(1, least(200, p_partkey - 10)) END AS k FROM part")
def clamped(spark, d):
    """Request parameters within their limits, and a default for what is no number."""
    asked = F.when(F.col("p_partkey") % 5 == 0, "many").otherwise((F.col("p_partkey") - 10).cast("string"))
    return t.load(spark, d, "part").select(F.col("p_partkey").alias("id"), parse.clamp(asked, 1, 200, 25).alias("k"))


@query("separated_parts", "SELECT p_partkey AS id, 3 AS parts, [p_type, p_brand, CAST(p_size AS VARCHAR)] AS first_of_each, [p_type, p_brand, 'and', CAST(p_size AS VARCHAR)] AS odd FROM part")
def separated_parts(spark, d):
    """Runs of a subtitle between marks, and every other run."""
    runs = F.array("p_type", F.lit(" • "), "p_brand", F.lit(" • "), F.col("p_size").cast("string"))
    parts = pages.separated(F.array("p_type", F.lit(" • "), "p_brand", F.lit("x"), F.lit(" • "), F.col("p_size").cast("string")))
    odd = pages.every_other(F.array("p_type", F.lit(","), "p_brand", F.lit(","), F.lit("and"), F.lit(","), F.col("p_size").cast("string")))
    found = t.load(spark, d, "part").withColumn("runs", runs)
    return found.select(F.col("p_partkey").alias("id"), F.size(parts).alias("parts"), F.transform(parts, lambda x: x[0]).alias("first_of_each"), odd.alias("odd"))


@query("paging_token", "SELECT o_orderkey AS id, rtrim(replace(replace(base64(encode('{\"o\":' || o_orderkey || ',\"q\":\"' || o_orderpriority || '\"}')), '+', '-'), '/', '_'), '=') AS token, o_orderkey AS o, sha1(o_orderpriority || o_orderkey) AS signature FROM orders")
def paging_token(spark, d):
    """An opaque token of a page (JSON in URL-safe base 64), read again, and a signature."""
    told = F.struct(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("q"))
    made = t.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse.token(told).alias("token"), F.sha1(F.concat("o_orderpriority", "o_orderkey").cast("binary")).alias("signature"))
    return made.select("id", "token", parse.from_token(F.col("token"), "o bigint, q string")["o"].alias("o"), "signature")


@query("formula_of", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'trend|win7|min3' WHEN event_id % 3 = 1 THEN 'old' ELSE 'reach' END AS formula, coalesce(lag(CASE WHEN event_id % 3 = 0 THEN 'trend|win7|min3' WHEN event_id % 3 = 1 THEN 'old' ELSE 'reach' END) OVER (PARTITION BY user_id ORDER BY event_id) <> CASE WHEN event_id % 3 = 0 THEN 'trend|win7|min3' WHEN event_id % 3 = 1 THEN 'old' ELSE 'reach' END, false) AS reset FROM events")
def formula_of(spark, d):
    """The signature behind a run's list: its own, else that of the run, else the first there was; badges are reset where it changes."""
    from pyspark.sql import Window

    k = F.col("event_id") % 3
    signature = F.concat_ws("|", F.lit("trend"), F.lit("win7"), F.lit("min3"))
    formulas = F.when(k == 0, F.create_map(F.lit("auto-trending"), signature))
    formula = F.coalesce(F.try_element_at(formulas, F.lit("auto-trending")), F.when(k == 1, "old"), F.lit("reach"))
    runs = t.load(spark, d, "events").select("event_id", "user_id", formula.alias("formula"))
    before = F.lag("formula").over(Window.partitionBy("user_id").orderBy("event_id"))
    return runs.select("event_id", "formula", F.coalesce(before != F.col("formula"), F.lit(False)).alias("reset"))


@query("search_kept", "WITH f AS (SELECT x.playlist_id, x.track_id, x.pos, t.is_video FROM playlist_track x JOIN track t USING (track_id) JOIN playlist p USING (playlist_id) WHERE contains(lower(p.playlist_title), '7')) SELECT playlist_id, count(*) FILTER (NOT is_video) AS kept, arg_min(track_id, struct_pack(a := pos, b := track_id)) FILTER (NOT is_video) AS cover FROM f GROUP BY 1 HAVING count(*) FILTER (NOT is_video) > 0")
def search_kept(spark, d):
    """Playlists that a search has found, with the number and the first of their tracks that pass the filters; those without any go."""
    found = t.playlists(spark, d).filter(F.contains(F.lower("playlist_title"), F.lit("7"))).select("playlist_id")
    members = t.playlist_tracks(spark, d).join(found, "playlist_id", "left_semi").join(t.tracks(spark, d).filter("NOT is_video").select("track_id"), "track_id", "left_semi")
    return members.groupBy("playlist_id").agg(F.count("*").alias("kept"), F.min_by("track_id", F.struct("pos", "track_id")).alias("cover"))


@query("home_hydration", "WITH h AS (SELECT 'row' || (o_custkey % 3) AS home_row, o_orderkey AS ref_id, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders), k AS (SELECT * FROM h WHERE pos <= 400) SELECT home_row, ref_id, pos, album_title, artist_name, EXISTS (SELECT 1 FROM album_track x JOIN track USING (track_id) WHERE x.album_id = ref_id AND is_video) AS has_video FROM k JOIN album ON album_id = ref_id JOIN artist USING (artist_id) WHERE NOT is_female")
def home_hydration(spark, d):
    """Ranked references of home rows with their albums and artists, without those that the filters stop; a flag from their tracks."""
    rows = t.load(spark, d, "orders").select(F.concat(F.lit("row"), F.col("o_custkey") % 3).alias("home_row"), F.col("o_orderkey").alias("ref_id"), "o_totalprice")
    top = ranked_within(rows, ["home_row"], [F.desc("o_totalprice"), F.asc("ref_id")], "pos").filter("pos <= 400").drop("o_totalprice")
    video = t.album_tracks(spark, d).join(t.tracks(spark, d).filter("is_video").select("track_id"), "track_id").select(F.col("album_id").alias("ref_id"), F.lit(True).alias("v")).distinct()
    albums = t.albums(spark, d).join(t.artists(spark, d).filter("NOT is_female"), "artist_id").select(F.col("album_id").alias("ref_id"), "album_title", "artist_name")
    return top.join(albums, "ref_id").join(video, "ref_id", "left").select("home_row", "ref_id", "pos", "album_title", "artist_name", F.coalesce("v", F.lit(False)).alias("has_video"))


@query("changed_files", "SELECT 'f' || p_partkey AS file, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 10 = 1 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE p_partkey % 10 IN (0, 1, 2)")
def changed_files(spark, d):
    """Files whose time or size differs between two listings: what a rebuild has to look at."""
    k = F.col("p_partkey")
    listing = t.load(spark, d, "part").select(F.concat(F.lit("f"), k).alias("file"), k.alias("k"), F.col("p_size").cast("long").alias("size"), F.lit(1).cast("long").alias("modified"))
    before, after = listing.filter("k % 10 <> 0"), listing.filter("k % 10 <> 1").withColumn("modified", F.when(F.col("k") % 10 == 2, 2).otherwise(F.col("modified")))
    return landing.changes(before.drop("k"), after.drop("k"))


def ask(spark, path: str, text: str, k: int = 10):
    """One query over a saved index, as from a command line."""
    from melisma.operators import impact
    from melisma.operators import search as s

    return impact.search(impact.open_saved(spark, path), s.query_tokens(spark.createDataFrame([(1, text)], "qid long, text string")), k).orderBy("category", "rank")


_NOW, _SPLIT = "2024-01-30", "2024-01-16"


@query("top_loved", f"""WITH s AS (SELECT item, count(DISTINCT device) FILTER (kind = 'play' AND t < TIMESTAMP '{_SPLIT}') AS bp, count(DISTINCT device) FILTER (kind = 'play' AND t >= TIMESTAMP '{_SPLIT}') AS lp,
  count(DISTINCT device) FILTER (kind = 'favorite') AS fav, count(DISTINCT device) FILTER (kind = 'download') AS dl, coalesce(avg(CASE WHEN kind IN ('play', 'skip') AND t >= TIMESTAMP '{_SPLIT}' THEN CAST(kind = 'skip' AS INT) END), 0.0) AS skip FROM play GROUP BY 1),
 k AS (SELECT item, title, artist_id, round(bp / (bp + 3.0) + 0.6 * lp / (lp + 3.0) * (1 - least(skip, 0.8)), 9) AS score, round(1.2 * fav / (fav + 3.0) + 0.3 * dl / (dl + 3.0), 9) AS tie FROM s JOIN track ON track_id = item),
 r AS (SELECT *, row_number() OVER (PARTITION BY title, artist_id ORDER BY score DESC, tie DESC, item) AS rn FROM k) SELECT item, title, score, tie, row_number() OVER (ORDER BY score DESC, tie DESC, item) AS rank FROM r WHERE rn = 1 ORDER BY rank LIMIT 50""")
def top_loved(spark, d, n: int = 50):
    """The chart of what is loved: earlier plays, and later ones less their skips; favourites and downloads only break ties."""
    live = F.col("t") >= F.lit(_SPLIT).cast("timestamp")
    devices = lambda condition, name: F.count_distinct(F.when(condition, F.col("device"))).alias(name)
    is_kind = lambda k: F.col("kind") == k
    skip = F.coalesce(F.avg(F.when(F.col("kind").isin("play", "skip") & live, is_kind("skip").cast("int"))), F.lit(0.0))
    s = t.plays(spark, d).groupBy("item").agg(devices(is_kind("play") & ~live, "bp"), devices(is_kind("play") & live, "lp"), devices(is_kind("favorite"), "fav"), devices(is_kind("download"), "dl"), skip.alias("skip"))
    score = F.round(o.shrink(F.col("bp")) + 0.6 * o.shrink(F.col("lp")) * (1 - F.least("skip", F.lit(0.8))), 9)
    tie = F.round(1.2 * o.shrink(F.col("fav")) + 0.3 * o.shrink(F.col("dl")), 9)
    order = [F.desc("score"), F.desc("tie"), F.asc("item")]
    named = s.select("item", score.alias("score"), tie.alias("tie")).join(t.tracks(spark, d).select(F.col("track_id").alias("item"), "title", "artist_id"), "item")
    return top_ranked(keep_first(named, ["title", "artist_id"], order), order, n).select("item", "title", "score", "tie", "rank")


@query("trending", f"""WITH e AS (SELECT * FROM play WHERE t >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY AND t < TIMESTAMP '{_NOW}'),
 cur AS (SELECT item, count(DISTINCT device) FILTER (kind = 'play') AS d, coalesce(avg(CASE WHEN kind IN ('play', 'skip') THEN CAST(kind = 'skip' AS INT) END), 0.0) AS skip, count(DISTINCT device) FILTER (kind = 'impression') AS seen FROM e GROUP BY 1),
 prev AS (SELECT item, count(DISTINCT device) AS p FROM play WHERE kind = 'play' AND t >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAY AND t < TIMESTAMP '{_NOW}' - INTERVAL 7 DAY GROUP BY 1 ORDER BY p DESC, item LIMIT 60), cap AS (SELECT CASE WHEN count(*) >= 60 THEN min(p) ELSE 0 END AS absent FROM prev),
 every AS (SELECT count(DISTINCT device) AS n FROM e WHERE kind = 'impression'),
 k AS (SELECT item, title, artist_id, round(greatest(0, d - coalesce(p, absent)) * (1 - 0.5 * least(1, skip)) * (1 - 0.35 * least(1.0, seen / n)), 9) AS score, round(d * (1 - 0.5 * least(1, skip)) * (1 - 0.35 * least(1.0, seen / n)), 9) AS tie
  FROM cur LEFT JOIN prev USING (item) JOIN track ON track_id = item, cap, every WHERE d >= 3 AND skip < 0.5 AND item % 10 <> 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY title, artist_id ORDER BY score DESC, tie DESC, item) AS rn FROM k) SELECT item, title, score, tie, row_number() OVER (ORDER BY score DESC, tie DESC, item) AS rank FROM r WHERE rn = 1 ORDER BY rank LIMIT 25""")
def trending(spark, d, cap: int = 60, n: int = 25):
    """What rises: this week's devices over those of a capped list of the week before, less skips and exposure. Recordings of voices only are
    out (here every tenth track), and of one title and artist one stays; ties go by the week's own reach."""
    plays, now = t.plays(spark, d), F.lit(_NOW).cast("timestamp")
    week = plays.filter((F.col("t") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("t") < now))
    before = plays.filter((F.col("kind") == "play") & (F.col("t") >= now - F.expr("INTERVAL 14 DAYS")) & (F.col("t") < now - F.expr("INTERVAL 7 DAYS")))
    devices = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("device")))
    skip = F.coalesce(F.avg(F.when(F.col("kind").isin("play", "skip"), (F.col("kind") == "skip").cast("int"))), F.lit(0.0))
    cur = week.groupBy("item").agg(devices("play").alias("d"), skip.alias("skip"), devices("impression").alias("seen")).filter("d >= 3 AND skip < 0.5 AND item % 10 <> 3")
    prev = o.reach(before, "item").withColumnRenamed("reach", "p").orderBy(F.desc("p"), "item").limit(cap)
    one = o.capped_default(prev, "p", cap).join(week.agg(devices("impression").alias("n")))  # a row each
    damp = (1 - 0.5 * F.least(F.lit(1.0), "skip")) * o.exposure_multiplier(F.col("seen"), F.col("n"))
    found = cur.join(prev, "item", "left").join(F.broadcast(one)).join(t.tracks(spark, d).select(F.col("track_id").alias("item"), "title", "artist_id"), "item")
    scored = found.select("item", "title", "artist_id", F.round(F.greatest(F.lit(0), F.col("d") - F.coalesce("p", "absent")) * damp, 9).alias("score"), F.round(F.col("d") * damp, 9).alias("tie"))
    order = [F.desc("score"), F.desc("tie"), F.asc("item")]
    return top_ranked(keep_first(scored, ["title", "artist_id"], order), order, n).select("item", "title", "score", "tie", "rank")


@query("day_numbers", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INT) AS day FROM events")
def day_numbers(spark, d):
    """ISO times as milliseconds, and the number of the day."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = F.to_timestamp(iso)
    return t.load(spark, d, "events").select("event_id", F.unix_millis(at).alias("ms"), F.datediff(at, F.lit("1970-01-01").cast("date")).alias("day"))


@query("genre_lead", f"WITH {_HEARD}, m0 AS (SELECT unnest(genres) AS station, track_id AS item, 1 AS place FROM track), mb AS (SELECT m0.*, round(reach / (reach + 3.0) + 0.35 * {_UNIT}, 9) AS pull, row_number() OVER (PARTITION BY station ORDER BY reach DESC, item) AS pop FROM m0 JOIN hd USING (item)) {_LEAD.format(n=40)}")
def genre_lead(spark, d):
    """The track that a genre's station opens with: one of its forty most heard, by reach and chance."""
    members = t.tracks(spark, d).select(F.explode("genres").alias("station"), F.col("track_id").alias("item"), F.lit(1).alias("place"))
    return r.start("genre", members, radio.heard(spark, d), radio.edges(spark, d)).opening.select("station", "item")


_NOW_S = 9000


@query("schedule_upcoming", f"""WITH sch AS (SELECT genres[1] AS station, track_id AS item, duration_sec AS dur_sec, is_video, CAST(coalesce(sum(duration_sec) OVER (PARTITION BY genres[1] ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_s FROM track),
 k AS (SELECT station, item, start_s, start_s - {_NOW_S} AS offset_s, row_number() OVER (PARTITION BY station ORDER BY start_s, item) AS place FROM sch WHERE start_s + dur_sec > {_NOW_S} AND dur_sec >= 30 AND NOT is_video) SELECT * FROM k WHERE place <= 5""")
def schedule_upcoming(spark, d, now_s: int = _NOW_S, n: int = 5):
    """What each station plays now, if it may be served, else what comes next, and the entries after it; an entry that runs has a negative offset."""
    ok = t.tracks(spark, d).filter("NOT is_video").select(F.col("track_id").alias("item"))
    entries = radio.prefix_starts(spark, d).filter((F.col("start_s") + F.col("dur_sec") > now_s) & (F.col("dur_sec") >= 30)).join(ok, "item", "left_semi")
    ranked = ranked_within(entries, ["station"], [F.asc("start_s"), F.asc("item")], "place").filter(F.col("place") <= n)
    return ranked.select("station", "item", "start_s", (F.col("start_s") - now_s).alias("offset_s"), "place")


@query("validate_sources", "WITH doc AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END AS year, CASE WHEN o_orderkey % 4 < 2 THEN 2 ELSE 0 END AS ids FROM orders) SELECT id, CASE WHEN year IS NOT NULL THEN 'both' ELSE 'neither' END AS fault FROM doc WHERE (year IS NOT NULL) = (ids > 0)")
def validate_sources(spark, d):
    """Lists that name a year and ids, or none of them: a list is made from exactly one. Nothing is written."""
    k = F.col("o_orderkey")
    doc = t.load(spark, d, "orders").select(k.alias("id"), F.when(k % 3 != 0, F.year("o_orderdate")).alias("year"), F.when(k % 4 < 2, F.array(k, k + 1)).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    dated, named = F.col("year").isNotNull(), F.size("ids") > 0
    return doc.filter(dated == named).select("id", F.when(dated, "both").otherwise("neither").alias("fault"))


@query("podcast_stats", "WITH e AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT count(DISTINCT conv_id) AS shows, count(*) AS episodes, max(n) AS longest FROM e JOIN (SELECT conv_id, count(*) AS n FROM e GROUP BY 1) USING (conv_id)")
def podcast_stats(spark, d):
    eps = t.load(spark, d, "conversations").select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("*").alias("n"))
    return eps.agg(F.count("*").alias("shows"), F.sum("n").alias("episodes"), F.max("n").alias("longest"))


@query("rejected_names", "WITH k AS (SELECT l_suppkey AS channel_id, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT channel_id, count(*) AS rejected, any_value(s_name) AS name, arg_min('T' || l_partkey, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey)) AS title FROM k JOIN supplier ON s_suppkey = channel_id GROUP BY 1")
def rejected_names(spark, d):
    """Rejected uploads of each channel: how many, its name, and the title that was met first."""
    lines = t.load(spark, d, "lineitem").filter("l_returnflag = 'R'")
    tally = lines.groupBy(F.col("l_suppkey").alias("channel_id")).agg(F.count("*").alias("rejected"), F.min_by(F.concat(F.lit("T"), "l_partkey"), F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("title"))
    return tally.join(t.load(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.col("s_name").alias("name")), "channel_id").select("channel_id", "rejected", "name", "title").orderBy(F.desc("rejected"), "channel_id")
