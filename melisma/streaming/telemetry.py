"""Structured Streaming forms of the windowed and stateful parts. A micro-batch that comes again changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.operators.merge import upsert


def events(spark: SparkSession, pattern: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events; NTZ times become timestamps, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, devices (a sketch: exact distinct counts would need unbounded state)."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("devices")).select(F.col("window.start").alias("start"), "event_type", "n", "devices")


def sliding(stream: DataFrame, size: str = "7 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def running_counts(stream: DataFrame) -> DataFrame:
    """user_id, seen, last_ms: state for each device, carried across micro-batches."""

    def count(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        for frame in frames:
            n += len(frame)
            last = max(last, int(frame["ts"].max().value // 1_000_000))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [n], "last_ms": [last]})

    return stream.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(count, "user_id long, seen long, last_ms long", "n long, last long", "update", "NoTimeout")


def merge_batches(path: str, key: list[str], rules: dict[str, str], parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is merged into the state under path, of which only the touched parts are written again.

    Rows lie in `parts` folders by the hash of their key, each in a folder named after the batch that wrote it. A batch that is
    delivered again starts from what was there before it, and overwrites its own folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*key).agg(*(F.max_by(c, F.struct("ts", "event_id")).alias(c) for c in rules)).withColumn("part", _part(key, parts)).persist()
        try:
            touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most `parts` numbers
            if not touched:
                return
            before = _parts_at(spark, path, number - 1, new.schema, touched)
            merged = upsert(before.drop("part"), new.drop("part"), key, rules).withColumn("part", _part(key, parts))
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
        finally:
            new.unpersist()

    return write


def _part(key: list[str], parts: int):
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def _parts_at(spark: SparkSession, path: str, number: int, schema, only: list[int] | None = None) -> DataFrame:
    """The rows of each part as the newest batch up to `number` left them. Only folder names are looked at to find it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last: dict[int, int] = {}
    for batch in files.listStatus(at) if files.exists(at) else []:
        n = batch.getPath().getName().removeprefix("batch=")
        if n.isdigit() and int(n) <= number and files.exists(hadoop.Path(batch.getPath(), "_SUCCESS")):
            for part in files.listStatus(batch.getPath()):
                name = part.getPath().getName()
                if name.startswith("part=") and (only is None or int(name[5:]) in only):
                    last[int(name[5:])] = max(last.get(int(name[5:]), -1), int(n))
    paths = [f"{path}/batch={n}/part={p}" for p, n in sorted(last.items())]
    fields = [f for f in schema.fields if f.name != "part"]
    rows = spark.read.schema(type(schema)(fields)).parquet(*paths) if paths else spark.createDataFrame([], type(schema)(fields))
    return rows.withColumn("part", F.lit(None).cast("int"))


def merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The state that merge_batches() has left under path."""
    return _parts_at(spark, path, 1 << 62, schema).drop("part")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    import re
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="melisma-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give its rows. In update mode the last row of each first column counts."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}/out"
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    key, rest = stream.columns[0], stream.columns[1:]
    return rows.groupBy(key).agg(*(F.max_by(c, "_batch").alias(c) for c in rest))
