"""Snapshot merges and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import merge as m
from melisma.operators.ranking import keep_first
from melisma.registry import query
from melisma.sources import tables as t


@query("upsert_catalog", "WITH old AS (SELECT p_partkey AS id, p_name AS title, CAST(p_size AS BIGINT) AS duration, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END AS plays, p_brand AS alt FROM part WHERE p_partkey % 10 <> 0), new AS (SELECT p_partkey AS id, upper(p_name) AS title, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 100 AS BIGINT) END AS duration, CASE WHEN p_partkey % 7 = 0 THEN CAST(20 AS BIGINT) END AS plays FROM part WHERE p_partkey % 4 = 0) SELECT id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.duration, o.duration) AS duration, nullif(greatest(coalesce(o.plays, 0), coalesce(n.plays, 0)), 0) AS plays, o.alt FROM old o FULL JOIN new n USING (id)")
def upsert_catalog(spark, d):
    part = t.load(spark, d, "part")
    size, k = F.col("p_size").cast("long"), F.col("p_partkey")
    old = part.filter(k % 10 != 0).select(k.alias("id"), F.col("p_name").alias("title"), size.alias("duration"), F.when(k % 2 == 0, size).alias("plays"), F.col("p_brand").alias("alt"))
    new = part.filter(k % 4 == 0).select(k.alias("id"), F.upper("p_name").alias("title"), F.when(k % 3 == 0, size + 100).alias("duration"), F.when(k % 7 == 0, F.lit(20).cast("long")).alias("plays"))
    return m.upsert(old, new, ["id"], {"title": "overwrite", "duration": "prefer_new", "plays": "positive_max", "alt": "untouched"})


@query("replace_rows", "SELECT playlist_id, track_id, pos FROM playlist_track WHERE playlist_id % 5 <> 0 UNION ALL SELECT playlist_id, track_id, CAST(-1 AS BIGINT) FROM playlist_track WHERE playlist_id % 5 = 0 AND track_id % 2 = 0")
def replace_rows(spark, d):
    members = t.playlist_tracks(spark, d)
    fresh = members.filter("playlist_id % 5 = 0 AND track_id % 2 = 0").withColumn("pos", F.lit(-1).cast("long"))
    emptied = members.filter("playlist_id % 5 = 0").select("playlist_id").distinct().join(fresh.select("playlist_id").distinct(), "playlist_id", "left_anti")
    return m.replace_keys(members.join(emptied, "playlist_id", "left_anti"), fresh, ["playlist_id"]).select("playlist_id", "track_id", "pos")


@query("replace_first_wins", "WITH r AS (SELECT 'row' || (o_custkey % 3) AS home_row, o_custkey AS ref_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey % 3, o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT home_row, ref_id, score FROM r WHERE rn = 1")
def replace_first_wins(spark, d):
    """Of a row's repeated references the first stays."""
    rows = t.load(spark, d, "orders").select(F.concat(F.lit("row"), F.col("o_custkey") % 3).alias("home_row"), F.col("o_custkey").alias("ref_id"), F.col("o_totalprice").alias("score"), "o_orderkey")
    return keep_first(rows, ["home_row", "ref_id"], [F.col("o_orderkey")]).select("home_row", "ref_id", "score")


@query("validate_document", "WITH doc AS (SELECT o_orderkey - CAST(o_orderkey % 5 = 1 AS BIGINT) AS id, CASE WHEN o_orderkey % 9 = 0 THEN year(o_orderdate) + 300 ELSE year(o_orderdate) END AS year FROM orders) SELECT id, count(*) > 1 AS duplicate, bool_or(year NOT BETWEEN 1900 AND 2100) AS bad_year FROM doc GROUP BY 1 HAVING count(*) > 1 OR bool_or(year NOT BETWEEN 1900 AND 2100)")
def validate_document(spark, d):
    year = F.year("o_orderdate")
    doc = t.load(spark, d, "orders").select((F.col("o_orderkey") - (F.col("o_orderkey") % 5 == 1).cast("long")).alias("id"), F.when(F.col("o_orderkey") % 9 == 0, year + 300).otherwise(year).alias("year"))
    return doc.groupBy("id").agg((F.count("*") > 1).alias("duplicate"), F.bool_or(~F.col("year").between(1900, 2100)).alias("bad_year")).filter("duplicate OR bad_year")


@query("prune_episodes", "SELECT c.conv_id AS show_id, c.turn AS episode FROM conversations c WHERE c.conv_id % 2 = 1 OR c.turn % 2 = 0")
def prune_episodes(spark, d):
    """Shows that were read again keep only the episodes that were seen; others keep all."""
    eps = t.load(spark, d, "conversations").select(F.col("conv_id").alias("show_id"), F.col("turn").alias("episode"))
    seen = eps.filter("show_id % 2 = 0 AND episode % 2 = 0")
    return eps.filter("show_id % 2 = 1").union(eps.filter("show_id % 2 = 0").join(seen, ["show_id", "episode"], "left_semi"))


@query("fill_null", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 5 END, CASE WHEN o_orderkey % 2 = 0 THEN 9 END) AS duration, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'new' END, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END) AS published FROM orders")
def fill_null(spark, d):
    k = F.col("o_orderkey")
    base = t.load(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, 5).alias("duration"), F.when(k % 3 == 0, "old").alias("published"))
    values = t.load(spark, d, "orders").filter(k % 2 == 0).select(k.alias("id"), F.lit(9).alias("duration"), F.lit("new").alias("published"))
    return m.fill_null(base, values, "id", {"duration": False, "published": True})


@query("vocab_apply", "SELECT p_partkey AS track_id, nullif(list_sort(list_filter([p_type, p_brand], lambda x: list_contains(['ECONOMY', 'PROMO', 'Brand#1', 'Brand#2', 'SMALL'], x))), []) AS genres FROM part")
def vocab_apply(spark, d):
    return t.load(spark, d, "part").select(F.col("p_partkey").alias("track_id"), m.vocabulary_array(F.array("p_type", "p_brand"), ["ECONOMY", "PROMO", "Brand#1", "Brand#2", "SMALL"]).alias("genres"))


@query("range_apply", "SELECT count(*) FILTER (e BETWEEN 0 AND 1) AS applied, count(*) FILTER (e > 1) AS malformed, count(*) FILTER (e IS NULL) AS missing FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity / 40 END AS e FROM lineitem)")
def range_apply(spark, d):
    e = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 40)
    return t.load(spark, d, "lineitem").select(e.alias("e")).agg(F.count_if(F.col("e").between(0, 1)).alias("applied"), F.count_if(F.col("e") > 1).alias("malformed"), F.count_if(F.col("e").isNull()).alias("missing"))


@query("prune_cascade", "WITH keep AS (SELECT artist_id FROM artist WHERE artist_id % 10 <> 3) SELECT 'album' AS kind, count(*) AS kept FROM album WHERE artist_id IN (SELECT artist_id FROM keep) UNION ALL SELECT 'track', count(*) FROM track WHERE artist_id IN (SELECT artist_id FROM keep) UNION ALL SELECT 'album_track', count(*) FROM album_track x WHERE EXISTS (SELECT 1 FROM album a WHERE a.album_id = x.album_id AND a.artist_id IN (SELECT artist_id FROM keep)) AND EXISTS (SELECT 1 FROM track t WHERE t.track_id = x.track_id AND t.artist_id IN (SELECT artist_id FROM keep))")
def prune_cascade(spark, d):
    keep = t.artists(spark, d).filter("artist_id % 10 <> 3")
    albums, tracks = m.prune(t.albums(spark, d), keep, "artist_id"), m.prune(t.tracks(spark, d), keep, "artist_id")
    links = m.prune(m.prune(t.album_tracks(spark, d), albums, "album_id"), tracks, "track_id")
    count = lambda kind, df: df.agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "kept")
    return count("album", albums).union(count("track", tracks)).union(count("album_track", links))


@query("prune_plan", "SELECT count(*) AS total, count(*) FILTER (s_suppkey % 10 <> 3) AS survivors, count(*) FILTER (s_suppkey % 10 <> 3) >= 0.5 * count(*) AS safe FROM supplier")
def prune_plan(spark, d):
    a = t.artists(spark, d)
    return m.prune_plan(a, a.filter("artist_id % 10 <> 3"), "artist_id", None)


@query("prune_blocklist", "SELECT m.playlist_id, count(*) AS total FROM playlist_track m WHERE m.track_id NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') AND m.playlist_id % 17 <> 0 GROUP BY 1")
def prune_blocklist(spark, d):
    """Blocked playlists and members go; the counts are those of what is left."""
    blocked = t.load(spark, d, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("track_id"))
    return t.playlist_tracks(spark, d).filter("playlist_id % 17 <> 0").join(blocked, "track_id", "left_anti").groupBy("playlist_id").agg(F.count("*").alias("total"))


@query("orphan_channels", "SELECT n_nationkey AS channel_id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def orphan_channels(spark, d):
    """Channels that still have a show once shows are pruned."""
    shows = t.load(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return t.load(spark, d, "nation").join(shows, "n_nationkey", "left_semi").select(F.col("n_nationkey").alias("channel_id"))


@query("video_flip", "SELECT track_id, is_video OR track_id IN (SELECT l_partkey FROM lineitem WHERE l_tax = 0.08) AS is_video FROM track")
def video_flip(spark, d):
    listed = t.load(spark, d, "lineitem").filter("l_tax = 0.08").select(F.col("l_partkey").alias("track_id")).distinct().withColumn("listed", F.lit(True))
    return t.tracks(spark, d).join(listed, "track_id", "left").select("track_id", (F.col("is_video") | F.coalesce("listed", F.lit(False))).alias("is_video"))


@query("standalone_videos", "SELECT p_partkey AS track_id FROM part WHERE p_partkey % 31 = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def standalone_videos(spark, d):
    """Songs on no album, together with those already on the list."""
    part = t.load(spark, d, "part").select(F.col("p_partkey").alias("track_id"))
    alone = part.join(t.load(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("track_id")), "track_id", "left_anti")
    return alone.union(part.filter("track_id % 31 = 0")).distinct()


@query("stale_claims", "SELECT artist_id FROM artist WHERE artist_id % 6 = 0 OR artist_id % 9 < 4")
def stale_claims(spark, d):
    """Artists never refreshed, or before the cutoff: the batch form of a claim."""
    a = t.artists(spark, d).withColumn("refreshed", F.when(F.col("artist_id") % 6 != 0, F.col("artist_id") % 9))
    return a.filter(F.col("refreshed").isNull() | (F.col("refreshed") < 4)).select("artist_id")


@query("oplog_latest", "WITH l AS (SELECT user_id AS id, event_type AS op, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT id, op, value FROM l WHERE rn = 1 AND op <> 'error'")
def oplog_latest(spark, d):
    """Last write wins; a deletion leaves nothing."""
    log = t.load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("op"), "value", "ts", "event_id")
    return m.latest(log, ["id"], [F.desc("ts"), F.desc("event_id")]).filter("op <> 'error'").select("id", "op", "value")


@query("rejected_report", "SELECT l_suppkey AS channel, count(*) AS n, min(l_partkey) AS sample FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1 ORDER BY n DESC, channel LIMIT 100")
def rejected_report(spark, d):
    ok = t.load(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    tally = t.load(spark, d, "lineitem").join(ok, "l_suppkey", "left_anti").groupBy(F.col("l_suppkey").alias("channel")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("sample"))
    return tally.orderBy(F.desc("n"), "channel").limit(100)


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, d):
    e = t.load(spark, d, "events").select("event_id", "ts")
    return e.join(F.broadcast(e.agg(F.max("ts").alias("last")))).filter(F.expr("ts >= last - INTERVAL 7 DAYS")).select("event_id")
