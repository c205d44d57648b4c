"""Surfaces that put several operators together: releases, live lists, names, limits and policies by name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from melisma.functions import text as tx
from melisma.operators.ranking import keep_first, ranked_within, top_ranked
from melisma.registry import query
from melisma.sources import tables as t


@query("first_seen", "SELECT c_custkey AS show_id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS BIGINT) END, CAST(c_nationkey AS BIGINT)) AS first_seen FROM customer")
def first_seen(spark, d):
    """Additive migration: a new column that is seeded from an old one."""
    shows = t.load(spark, d, "customer").select(F.col("c_custkey").alias("show_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("first_seen"), F.col("c_nationkey").cast("long").alias("harvested"))
    return shows.select("show_id", F.coalesce("first_seen", "harvested").alias("first_seen"))


@query("display_titles", "SELECT p_brand AS slug, coalesce(CASE p_brand WHEN 'Brand#1' THEN 'First' WHEN 'Brand#2' THEN 'Second' END, p_brand) AS title, count(*) AS n FROM part GROUP BY 1, 2")
def display_titles(spark, d):
    names = F.create_map(F.lit("Brand#1"), F.lit("First"), F.lit("Brand#2"), F.lit("Second"))
    return t.load(spark, d, "part").groupBy(F.col("p_brand").alias("slug")).agg(F.count("*").alias("n")).select("slug", F.coalesce(F.try_element_at(names, F.col("slug")), "slug").alias("title"), "n")


@query("lead_track", "WITH r AS (SELECT item, count(DISTINCT device) AS reach FROM play WHERE kind = 'play' GROUP BY 1), k AS (SELECT artist_id, track_id, coalesce(reach, 0) AS reach FROM track LEFT JOIN r ON item = track_id) SELECT artist_id, arg_max(track_id, struct_pack(a := reach, b := -track_id)) AS lead FROM k GROUP BY 1")
def lead_track(spark, d):
    """Of each artist the most heard track, the lesser id of ties."""
    from melisma.operators.telemetry import reach

    heard = reach(t.plays(spark, d).filter("kind = 'play'"), "item").withColumnRenamed("item", "track_id")
    tracks = t.tracks(spark, d).select("artist_id", "track_id").join(heard, "track_id", "left")
    return tracks.groupBy("artist_id").agg(F.max_by("track_id", F.struct(F.coalesce("reach", F.lit(0)), -F.col("track_id"))).alias("lead"))


@query("name_sort", "SELECT n_nationkey, n_name FROM nation ORDER BY lower(n_name), n_nationkey")
def name_sort(spark, d):
    """Channels by name in the order of a reader, not of code points."""
    return t.load(spark, d, "nation").select("n_nationkey", "n_name").orderBy(F.collate("n_name", "UNICODE_CI"), "n_nationkey")


@query("removed_playlist", "SELECT playlist_id, count(*) AS members FROM playlist_track WHERE playlist_id <> 12 GROUP BY 1")
def removed_playlist(spark, d):
    return t.playlist_tracks(spark, d).filter("playlist_id <> 12").groupBy("playlist_id").agg(F.count("*").alias("members"))


@query("rate_limited", "WITH k AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup') SELECT event_id, n > 1 AS refused FROM k")
def rate_limited(spark, d, most: int = 1):
    """Creations of a device beyond its daily number are refused."""
    made = t.load(spark, d, "events").filter("event_type = 'signup'").withColumn("day", F.to_date("ts"))
    n = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return made.select("event_id", (n > most).alias("refused"))


@query("live_purity", "SELECT l_orderkey AS playlist_id, l_partkey AS track_id, coalesce(t.is_video, false) AS is_video, coalesce(a.is_female, b.is_female, false) AS is_female FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) m LEFT JOIN (SELECT * FROM track WHERE track_id % 3 <> 0) t ON t.track_id = l_partkey LEFT JOIN artist a ON a.artist_id = t.artist_id LEFT JOIN (SELECT * FROM artist WHERE artist_id % 2 = 0) b ON b.artist_id = l_suppkey WHERE t.track_id IS NOT NULL OR b.artist_id IS NOT NULL")
def live_purity(spark, d):
    """Members of a live list that are in the catalog or by a whitelisted channel; flags from the catalog, else from the channel."""
    members = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("channel")).distinct()
    artists = t.artists(spark, d).select("artist_id", "is_female")
    known = t.tracks(spark, d).filter("track_id % 3 <> 0").join(artists, "artist_id").select("track_id", "is_video", F.col("is_female").alias("own"), F.lit(True).alias("known"))
    white = artists.filter("artist_id % 2 = 0").select(F.col("artist_id").alias("channel"), F.col("is_female").alias("theirs"), F.lit(True).alias("white"))
    found = members.join(known, "track_id", "left").join(white, "channel", "left").filter("known OR white")
    return found.select("playlist_id", "track_id", F.coalesce("is_video", F.lit(False)).alias("is_video"), F.coalesce("own", "theirs", F.lit(False)).alias("is_female"))


@query("new_releases", "WITH k AS (SELECT al.album_id, al.artist_id, al.album_date, row_number() OVER (ORDER BY al.album_date DESC NULLS LAST, al.album_id) AS rn FROM album al), f AS (SELECT k.album_id, k.album_date, rn FROM k JOIN artist a USING (artist_id) WHERE rn <= 160 AND NOT a.is_female) SELECT album_id, album_date, row_number() OVER (ORDER BY rn) AS place FROM f ORDER BY place LIMIT 20")
def new_releases(spark, d, k: int = 20):
    """Newest first: eight times as many as asked for, then the filter, then the cut."""
    newest = top_ranked(t.albums(spark, d).select("album_id", "artist_id", "album_date"), [F.desc_nulls_last("album_date"), F.asc("album_id")], 8 * k, "rn")
    kept = newest.join(t.artists(spark, d).filter("NOT is_female").select("artist_id"), "artist_id", "left_semi")
    return top_ranked(kept, [F.asc("rn")], k, "place").select("album_id", "album_date", "place")


@query("curated_list", "WITH item AS (SELECT p_brand AS list, p_partkey AS track_id, p_size AS place FROM part), f AS (SELECT item.*, is_video FROM item JOIN track USING (track_id)) SELECT list, count(*) AS total, count(*) FILTER (NOT is_video) AS kept, arg_min(track_id, struct_pack(a := place, b := track_id)) FILTER (NOT is_video) AS cover FROM f GROUP BY 1 HAVING count(*) FILTER (NOT is_video) > 0")
def curated_list(spark, d):
    items = t.load(spark, d, "part").select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("track_id"), F.col("p_size").alias("place")).join(t.tracks(spark, d).select("track_id", "is_video"), "track_id")
    first = F.min(F.when(~F.col("is_video"), F.struct("place", "track_id")))
    return items.groupBy("list").agg(F.count("*").alias("total"), F.count_if(~F.col("is_video")).alias("kept"), first["track_id"].alias("cover")).filter("kept > 0")


@query("servable_at", "SELECT track_id, duration_sec FROM track WHERE duration_sec >= 30 AND NOT is_video AND artist_id % 5 <> 0")
def servable_at(spark, d):
    """What a station may play when its time comes: long enough, and passing the filters of that moment."""
    ok = t.artists(spark, d).filter("NOT is_female").select("artist_id")
    return t.tracks(spark, d).filter("duration_sec >= 30 AND NOT is_video").join(ok, "artist_id", "left_semi").select("track_id", "duration_sec")


#: Guests by a track's number, and names by an artist's: the first two and the last guest are listed, the third has one letter less.
_GUESTS, _LISTED = ("Dudi Polak", "anna bell", "Ana Bel", "", "שרה לוי"), ("דודי פולק", "Anna Bell", "שרה לוי")


@query("cross_script_credits", "SELECT p_partkey AS track_id FROM part WHERE p_partkey % 5 IN (0, 1, 4)")
def cross_script_credits(spark, d):
    """Credits matched to listed names: the same normalised name, or the same skeleton (from three letters) across scripts only."""
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    guest = pick(_GUESTS, F.col("p_partkey"))
    titles = t.load(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.when(guest == "", F.col("p_name")).otherwise(F.concat("p_name", F.lit(" (feat. "), guest, F.lit(")"))).alias("title"))
    names = t.artists(spark, d).select(pick(_LISTED, F.col("artist_id")).alias("name")).distinct()
    key = lambda c: F.array_join(tx.plain_tokens(c), " ")
    bones = lambda c: F.array_join(F.transform(tx.plain_tokens(c), tx.skeleton), "")
    hebrew = lambda c: c.rlike(f"[{tx.HEBREW_RANGE}]")
    listed = names.select(key(F.col("name")).alias("k"), bones(F.col("name")).alias("s"), hebrew(F.col("name")).alias("h"))
    guests = titles.select("track_id", F.explode(tx.credits(F.col("title"))).alias("g")).select("track_id", key(F.col("g")).alias("k"), bones(F.col("g")).alias("s"), hebrew(F.col("g")).alias("h"))
    same = guests.join(listed.select("k"), "k", "left_semi").select("track_id")
    across = guests.filter(F.length("s") >= 3).join(listed.select("s", (~F.col("h")).alias("h")), ["s", "h"], "left_semi").select("track_id")
    return same.union(across).distinct()


@query("owner_hide", "SELECT playlist_id FROM playlist WHERE lower(playlist_title) NOT IN (SELECT lower('Customer#00000000' || (s_suppkey % 10)) FROM supplier WHERE s_suppkey % 5 = 0)")
def owner_hide(spark, d):
    """Playlists whose curator's normalised name is a listed artist's are hidden."""
    name = F.array_join(tx.tokens_of_plain(F.concat(F.lit("Customer#00000000"), F.col("artist_id") % 10)), " ")
    listed = t.artists(spark, d).filter("is_female").select(name.alias("k")).distinct()
    keyed = t.playlists(spark, d).withColumn("k", F.array_join(tx.plain_tokens(F.col("playlist_title")), " "))
    return keyed.join(listed, "k", "left_anti").select("playlist_id")


@query("community_detail", "SELECT m.playlist_id, m.track_id, t.title, row_number() OVER (PARTITION BY m.playlist_id ORDER BY m.pos, m.track_id) AS place FROM playlist_track m JOIN track t USING (track_id) WHERE NOT t.is_video")
def community_detail(spark, d):
    members = t.playlist_tracks(spark, d).join(t.tracks(spark, d).filter("NOT is_video").select("track_id", "title"), "track_id")
    return ranked_within(members, ["playlist_id"], [F.asc("pos"), F.asc("track_id")], "place").select("playlist_id", "track_id", "title", "place")


@query("podcast_detail", "WITH e AS (SELECT conv_id AS show_id, turn AS episode, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2)) SELECT show_id, episode, rn AS place FROM e WHERE rn <= 3")
def podcast_detail(spark, d):
    eps = t.load(spark, d, "conversations").select(F.col("conv_id").alias("show_id"), F.col("turn").alias("episode")).distinct()
    return ranked_within(eps, ["show_id"], [F.desc("episode")], "place").filter("place <= 3")


@query("new_episodes", "SELECT show_id, episode FROM (SELECT conv_id AS show_id, max(turn) AS episode FROM conversations GROUP BY 1) ORDER BY episode DESC, show_id LIMIT 30")
def new_episodes(spark, d):
    """One episode of each show, newest first."""
    eps = t.load(spark, d, "conversations").select(F.col("conv_id").alias("show_id"), F.col("turn").alias("episode"))
    return keep_first(eps, ["show_id"], [F.desc("episode")]).orderBy(F.desc("episode"), "show_id").limit(30)
