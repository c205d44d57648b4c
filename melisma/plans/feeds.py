"""Paged collections in a landing folder, and a station's schedule kept by a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import recommend as r
from melisma.plans import recommend as radio
from melisma.registry import query
from melisma.sources import paged, shared
from melisma.sources import tables as t
from melisma.streaming import schedule as s
from melisma.streaming.telemetry import shared_folder

_PAGE = 20


def land_pages(spark, d) -> str:
    """Each nation's customers as pages of a collection; of every fifth nation the third page is lost."""
    path = shared.new_path(spark, "pages")
    rows = t.load(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("collection"), "c_custkey", "c_name")
    placed = r.prefix_sums(rows.withColumn("one", F.lit(1)), ["collection"], "c_custkey", "one", "place")
    pages = placed.groupBy("collection", F.floor(F.col("place") / _PAGE).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("place", "c_name"))).alias("rows"))
    n = pages.groupBy("collection").agg(F.max("page").alias("last"))
    token = lambda p: F.when(p == 0, paged.FIRST).otherwise(F.concat(F.lit("t"), p))
    kept = pages.join(n, "collection").filter((F.col("page") != 2) | (F.col("collection").cast("int") % 5 != 0))
    kept.select("collection", token(F.col("page")).alias("token"), F.transform("rows", lambda x: x["c_name"]).alias("rows"), F.when(F.col("page") < F.col("last"), token(F.col("page") + 1)).alias("next")).repartition("collection", "token").write.partitionBy("collection", "token").json(path)
    return path


@query("paged_collections", f"WITH k AS (SELECT CAST(c_nationkey AS VARCHAR) AS collection, c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer) SELECT collection, CAST(place // {_PAGE} AS INTEGER) AS page, CAST(place % {_PAGE} AS INTEGER) AS position, c_name AS row FROM k WHERE place < 80 * {_PAGE} AND (c_nationkey % 5 <> 0 OR place < 2 * {_PAGE})")
def paged_collections(spark, d):
    """Collections followed page by page; a lost page ends its collection."""
    path = land_pages(spark, d)
    spark.dataSource.register(paged.Paged)
    return spark.read.format("paged").load(path)


def schedule_input(spark, d, hours: int):
    """Pools, links and a request for each genre's station, as the stream takes them."""
    pool = radio._pool(spark, d)
    weight = (F.pow(F.col("reach") / (F.col("reach") + 3.0), r.POWER) + r.LEAST) * F.col("multiplier")
    none = lambda kind: F.lit(None).cast(kind)
    tracks = pool.select("station", F.lit("track").alias("kind"), "item", F.col("artist_id").alias("artist"), "dur_sec", weight.alias("weight"), none("long").alias("other"), none("long").alias("until_ms"))
    links = r.flow(pool, radio.edges(spark, d)).select("station", F.lit("link").alias("kind"), F.col("src").alias("item"), none("long").alias("artist"), none("long").alias("dur_sec"), F.col("strength").alias("weight"), F.col("dst").alias("other"), none("long").alias("until_ms"))
    asked = pool.select("station").distinct().select("station", F.lit("extend").alias("kind"), *(none(k).alias(c) for c, k in (("item", "long"), ("artist", "long"), ("dur_sec", "long"), ("weight", "double"), ("other", "long"))), F.lit(radio.START_MS + hours * 3_600_000).alias("until_ms"))
    return tracks.unionByName(links).unionByName(asked)


@query("stream_schedule", None)
def stream_schedule(spark, d):
    """A day of each genre's station by a stream in two runs, the second of which goes on from the first's state: the rows of `schedule`."""
    folder, store = shared_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    s.with_state(spark)
    try:
        for hours in (7, 24):
            given = schedule_input(spark, d, hours)
            (given if hours == 7 else given.filter("kind = 'extend'")).repartition(8, "station").write.mode("append").parquet(f"{folder}/in")
            stream = s.schedule(spark.readStream.schema(s.INPUT).parquet(f"{folder}/in"), radio.START_MS, 7)
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.parquet(f"{folder}/out").select("station", "place", "item", "start_ms", "dur_sec")
