"""Page parsing, snapshot export, the calendar and the streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from melisma.functions import calendar, parse
from melisma.operators import export
from melisma.registry import query
from melisma.sources import tables as t
from melisma.streaming import telemetry as st


@query("parse_counts", "SELECT p_partkey AS id, CAST(p_size * 60 + p_partkey % 60 AS BIGINT) AS sec, CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 2 THEN p_partkey * 1000 ELSE CAST(round((10 + p_partkey % 90) / 10.0 * 1000000) AS BIGINT) END AS plays, CAST(1990 + p_size % 30 AS INT) AS year FROM part")
def parse_counts(spark, d):
    k = F.col("p_partkey")
    views = F.format_string("%d.%dM ", F.floor((k % 90 + 10) / 10), (k % 90 + 10) % 10)
    views = F.when(k % 4 == 3, "2024 • 3 songs").when(k % 4 == 2, F.concat(F.lit("by 5 • "), F.format_number(k * 1000, 0), F.lit(" views • 9 tracks"))).otherwise(F.concat(views, F.lit("plays")))
    part = t.load(spark, d, "part").select(k.alias("id"), F.format_string("%d:%02d", "p_size", k % 60).alias("time"), views.alias("views"), F.concat(F.lit("Album • "), (1990 + F.col("p_size") % 30).cast("string")).alias("sub"))
    return part.select("id", parse.duration_sec(F.col("time")).alias("sec"), parse.count(F.col("views")).alias("plays"), parse.year(F.col("sub")).alias("year"))


@query("subtitle_meta", "SELECT p_partkey AS id, CAST(p_size * 60 + 5 AS BIGINT) AS sec, p_brand AS label FROM part")
def subtitle_meta(spark, d):
    parts = F.array(F.lit("3,201 views"), F.format_string("%d:05", "p_size"), F.col("p_brand"))
    return t.load(spark, d, "part").select(F.col("p_partkey").alias("id"), parse.subtitle_duration(parts).alias("sec"), parse.subtitle_label(parts).alias("label"))


@query("page_rows", "SELECT o_orderkey AS page_id, l_partkey AS track_id, 'T' || l_partkey AS title FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def page_rows(spark, d):
    """Nested page JSON: alternative paths, one row for each item of its shelf."""
    lines = t.load(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    item = F.struct(F.col("l_partkey").alias("id"), F.struct(F.concat(F.lit("T"), F.col("l_partkey")).alias("text")).alias("title"))
    pages = lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("shelf"))).alias("json"))
    shelf = F.coalesce(F.try_variant_get("v", "$.contents", "array<variant>"), F.try_variant_get("v", "$.shelf.items", "array<variant>"))
    rows = pages.select("page_id", F.try_parse_json("json").alias("v")).select("page_id", F.explode(shelf).alias("i"))
    return rows.select("page_id", F.try_variant_get("i", "$.id", "bigint").alias("track_id"), parse.first_path(F.col("i"), ["$.name", "$.title.text"]).alias("title"))


@query("typed_rows", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN 'no-id' ELSE 'unknown-kind' END AS reason, event_id % 5 <> 0 AND event_type = 'click' AS ok FROM events")
def typed_rows(spark, d):
    kind = F.when(F.col("event_type") == "click", "song").when(F.col("event_type") == "view", "album").otherwise(F.col("event_type"))
    body = F.to_json(F.struct(kind.alias("kind"), F.when(F.col("event_type") != "view", F.col("event_id").cast("string")).alias("id"), F.struct(F.lit("t").alias("title")).alias("renderer")))
    json = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(body)
    rows = t.load(spark, d, "events").select("event_id", parse.typed_row(F.try_parse_json(json)).alias("r"))
    return rows.select("event_id", "r.reason", "r.ok")


@query("id_list", "SELECT p_partkey AS track_id, p_name AS title FROM part WHERE p_partkey IN (3, 14, 159, 265, 358)")
def id_list(spark, d, ids: str = "[3, 14, 159, 265, 358]"):
    """An IN-list given as JSON, of any length."""
    wanted = spark.range(1).select(F.explode(F.from_json(F.lit(ids), "array<bigint>")).alias("p_partkey"))
    return t.load(spark, d, "part").join(F.broadcast(wanted), "p_partkey", "left_semi").select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"))


@query("merged_playlists", "WITH a AS (SELECT 'auto-' || p_type AS id, p_partkey AS track_id FROM part), c AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'auto-' ELSE 'cur-' END || p_brand AS id, p_partkey AS track_id FROM part) SELECT 0 AS src, id, track_id FROM a UNION ALL SELECT 1, id, track_id FROM c WHERE id NOT LIKE 'auto-%'")
def merged_playlists(spark, d):
    """Made lists first; curated ones may not use their names."""
    part, k = t.load(spark, d, "part"), F.col("p_partkey")
    made = part.select(F.lit(0).alias("src"), F.concat(F.lit("auto-"), F.col("p_type")).alias("id"), k.alias("track_id"))
    curated = part.select(F.lit(1).alias("src"), F.concat(F.when(k % 4 == 0, "auto-").otherwise("cur-"), F.col("p_brand")).alias("id"), k.alias("track_id"))
    return made.union(curated.filter(~F.col("id").startswith("auto-")))


@query("shard_counts", "SELECT CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) % 16 AS INT) AS shard, count(*) AS n FROM part GROUP BY 1")
def shard_counts(spark, d):
    return export.sharded(t.load(spark, d, "part"), "p_partkey", 16).groupBy("shard").agg(F.count("*").alias("n"))


@query("shard_manifest", None)
def shard_manifest(spark, d):
    return export.manifest(t.load(spark, d, "part"), "p_partkey", 16)


@query("manifest_diff", "SELECT DISTINCT CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) % 64 AS INT) AS shard, 'changed' AS change FROM part WHERE p_partkey % 400 = 7")
def manifest_diff(spark, d):
    """Shards that differ once a few rows have changed."""
    part = t.load(spark, d, "part")
    after = part.withColumn("p_size", F.when(F.col("p_partkey") % 400 == 7, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return export.changes(export.manifest(part, "p_partkey", 64), export.manifest(after, "p_partkey", 64))


#: The first and last day of the three weeks in each year of the orders, as printed calendars have them.
_SEASONS = ", ".join(f"(CAST({y} AS INT), DATE '{a}', DATE '{z}')" for y, a, z in (
    (5755, "1995-07-15", "1995-08-05"), (5756, "1996-07-04", "1996-07-25"), (5757, "1997-07-22", "1997-08-12"), (5758, "1998-07-11", "1998-08-01"),
    (5759, "1999-07-01", "1999-07-22"), (5760, "2000-07-20", "2000-08-10"), (5761, "2001-07-08", "2001-07-29"),
))


@query("season_events", f"WITH w(heb_year, a, z) AS (VALUES {_SEASONS}) SELECT heb_year, count(*) AS n FROM orders JOIN w ON CAST(o_orderdate AS DATE) BETWEEN a AND z GROUP BY 1")
def season_events(spark, d):
    """Orders of each year's season, by a broadcast date dimension."""
    days = calendar.dimension(spark, dt.date(1995, 1, 1), dt.date(2001, 12, 31)).filter("in_season")
    orders = t.load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.join(F.broadcast(days), "day").groupBy("heb_year").agg(F.count("*").alias("n"))


def _events(spark, d):
    return st.events(spark, f"{d}/event*.parquet", t.load(spark, d, "events").schema)


@query("stream_tumbling", "WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events, w WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """Windows that the watermark has closed: the stream's rows are those of the batch."""
    return st.drain(st.tumbling(_events(spark, d))).select("start", "event_type", "n")


@query("stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM g WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_sessions(spark, d):
    return st.drain(st.sessions(_events(spark, d)))


@query("stream_state", "SELECT user_id, count(*) AS seen, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS last_ms FROM events GROUP BY 1")
def stream_state(spark, d):
    """State for each device, as it stands after the last micro-batch."""
    return st.drain(st.running_counts(_events(spark, d)), "update")


@query("stream_merge", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1")
def stream_merge(spark, d):
    """Micro-batches merged into snapshots; the newest is the result."""
    folder = st.shared_folder(spark)
    sink = st.merge_batches(f"{folder}/state", ["user_id"], {"event_type": "overwrite", "value": "overwrite"})
    stream = _events(spark, d)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return st.merged(spark, f"{folder}/state", stream.select("user_id", "event_type", "value").schema)
