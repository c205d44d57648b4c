"""Loaders: the driver's tables, schema evolution, fail-soft JSON, and the catalog roles that the tables play."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive schema evolution: missing columns are null, known ones are cast, unknown ones dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON that may be missing or malformed: then an empty table, or null fields."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup; Parquet statistics prune the scan."""
    return df.filter(F.col(column) == F.lit(value))


def among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """IN-list of any length as a semi join."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def artists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return load(spark, d, "supplier").select(k.alias("artist_id"), F.col("s_name").alias("artist_name"), (k % 5 == 0).alias("is_female"), (k % 3 == 0).alias("is_kid"), (k % 4 == 0).alias("is_class"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """A part is a track; its artist is the smallest supplier that ships it."""
    k = F.col("p_partkey")
    owner = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("track_id")).agg(F.min("l_suppkey").alias("artist_id"), F.max("l_shipdate").alias("uploaded"))
    part = load(spark, d, "part").select(k.alias("track_id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("genres"), (F.col("p_size") * 10).cast("long").alias("duration_sec"), (k % 7 == 0).alias("is_video"))
    upload = F.when(k_mod("track_id", 3) != 0, F.date_format("uploaded", "yyyy-MM-dd"))
    return part.join(owner, "track_id").select("track_id", "title", "artist_id", "is_video", "genres", "duration_sec", upload.alias("upload_date"))


def k_mod(column: str, n: int):
    return F.col(column) % n


def albums(spark: SparkSession, d: str) -> DataFrame:
    """An order is an album; its artist is the smallest supplier of its lines."""
    owner = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("album_id")).agg(F.min("l_suppkey").alias("artist_id"))
    kind = F.when(F.col("o_orderstatus") == "F", "album").when(F.col("o_orderstatus") == "O", "single").otherwise("ep")
    dated = F.when(k_mod("o_orderkey", 5) != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    order = load(spark, d, "orders").select(F.col("o_orderkey").alias("album_id"), F.col("o_custkey").alias("owner_id"), F.concat(F.lit("Album "), F.col("o_orderpriority")).alias("album_title"), kind.alias("album_type"), dated.alias("album_date"), F.year("o_orderdate").cast("long").alias("year"))
    return order.join(owner, "album_id")


def album_tracks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("album_id"), F.col("l_partkey").alias("track_id")).agg(F.min("l_linenumber").cast("long").alias("pos"))


def playlists(spark: SparkSession, d: str) -> DataFrame:
    views = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("long"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("playlist_id"), F.col("c_name").alias("playlist_title"), F.col("c_mktsegment").alias("author"), views.alias("view_count"))


def playlist_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Members: tracks of the owner's albums, at their first place."""
    order = load(spark, d, "orders").select(F.col("o_orderkey").alias("album_id"), F.col("o_custkey").alias("playlist_id"))
    return album_tracks(spark, d).join(order, "album_id").groupBy("playlist_id", "track_id").agg(F.min(F.col("album_id") * 8 + F.col("pos")).alias("pos"))


def plays(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry: device, item, kind and time of each event."""
    kind = F.create_map(*(F.lit(x) for x in ("click", "play", "view", "impression", "purchase", "favorite", "signup", "download", "error", "skip")))
    return load(spark, d, "events").select(F.col("user_id").alias("device"), F.get_json_object("props", "$.k").cast("long").alias("item"), kind[F.col("event_type")].alias("kind"), F.col("ts").cast("timestamp").alias("t"), "value", "event_id")


#: The same roles for an SQL engine on the same tables.
ROLES = {
    "artist": "SELECT s_suppkey AS artist_id, s_name AS artist_name, s_suppkey % 5 = 0 AS is_female, s_suppkey % 3 = 0 AS is_kid, s_suppkey % 4 = 0 AS is_class FROM supplier",
    "track": """SELECT p_partkey AS track_id, p_name AS title, artist_id, p_partkey % 7 = 0 AS is_video, [p_type, p_brand] AS genres, CAST(p_size * 10 AS BIGINT) AS duration_sec,
        CASE WHEN p_partkey % 3 <> 0 THEN strftime(uploaded, '%Y-%m-%d') END AS upload_date
        FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS artist_id, max(l_shipdate) AS uploaded FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "album": """SELECT o_orderkey AS album_id, o_custkey AS owner_id, 'Album ' || o_orderpriority AS album_title, CASE o_orderstatus WHEN 'F' THEN 'album' WHEN 'O' THEN 'single' ELSE 'ep' END AS album_type,
        CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS album_date, CAST(year(o_orderdate) AS BIGINT) AS year, artist_id
        FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS artist_id FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "album_track": "SELECT l_orderkey AS album_id, l_partkey AS track_id, CAST(min(l_linenumber) AS BIGINT) AS pos FROM lineitem GROUP BY 1, 2",
    "playlist": "SELECT c_custkey AS playlist_id, c_name AS playlist_title, c_mktsegment AS author, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS view_count FROM customer",
    "playlist_track": "SELECT o_custkey AS playlist_id, track_id, CAST(min(album_id * 8 + pos) AS BIGINT) AS pos FROM album_track JOIN orders ON o_orderkey = album_id GROUP BY 1, 2",
    "play": """SELECT user_id AS device, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, CASE event_type WHEN 'click' THEN 'play' WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'favorite'
        WHEN 'signup' THEN 'download' WHEN 'error' THEN 'skip' END AS kind, ts AS t, value, event_id FROM events""",
}


def with_roles(sql: str) -> str:
    """The query with the roles that it names, as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        names = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text))
        for role, body in ROLES.items():
            if role in names and role not in need:
                add(body)
                need.append(role)

    add(sql)
    head = ", ".join(f"{r} AS ({ROLES[r]})" for r in need)
    sql = sql.strip()
    if not head:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
