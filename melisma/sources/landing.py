"""Landing folders: pages that a fetcher has left as JSON files, read in bulk with a time to live, and last-good snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melisma.operators.ranking import keep_first

PAGE = T.StructType([T.StructField("collection", T.StringType()), T.StructField("page", T.LongType()), T.StructField("rows", T.ArrayType(T.StringType())), T.StructField("next_token", T.StringType())])


def fresh_files(spark: SparkSession, path: str, max_age: str | None = None, schema: T.StructType = PAGE) -> DataFrame:
    """JSON documents of files not older than an interval, the filter applied to file metadata before any is opened."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_modification_time").alias("fetched"), F.col("_metadata.file_path").alias("file"))
    return df.filter(F.col("fetched") >= F.current_timestamp() - F.expr(f"INTERVAL {max_age}")) if max_age else df


def collection(pages: DataFrame, most_pages: int = 80) -> DataFrame:
    """collection, position, row of paged listings: the newest fetch of each page, pages in order, none after a missing one."""
    newest = keep_first(pages.filter(F.col("page") < most_pages), ["collection", "page"], [F.desc("fetched"), F.desc("file")])
    have = newest.groupBy("collection").agg(F.array_sort(F.collect_set("page")).alias("have"))  # at most most_pages numbers
    unbroken = F.size(F.filter(F.transform("have", lambda p, i: p == i), lambda ok: ok))
    kept = newest.join(have.select("collection", unbroken.alias("n")), "collection").filter(F.col("page") < F.col("n"))
    return kept.select("collection", "page", F.posexplode("rows").alias("pos", "row")).select("collection", (F.col("page") * 1_000_000 + F.col("pos")).alias("position"), "row")


def last_good(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first snapshot, newest first, that can be read and has rows; else an empty table."""
    for path in paths:
        try:
            df = spark.read.schema(schema).parquet(path)
            if df.limit(1).count():
                return df
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def write_if_changed(df: DataFrame, path: str, key: str) -> bool:
    """Write a snapshot unless the newest one under path has the same content; whether it was written.

    Each has a folder of its own, which counts only once Spark has marked it as complete, so a write that fails leaves the last good
    snapshot as it is.
    """
    from melisma.operators.export import manifest

    spark = df.sparkSession
    made = versions(spark, path)
    if made:
        before = {tuple(r) for r in manifest(spark.read.parquet(f"{path}/{made[-1]}"), key, 16).collect()}  # 16 rows
        if before == {tuple(r) for r in manifest(df, key, 16).collect()}:
            return False
    df.write.mode("overwrite").parquet(f"{path}/v{(int(made[-1][1:]) if made else 0) + 1:08d}")
    return True


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete snapshots under path, in the order in which they were written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("v")]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if files.exists(done(p, "_SUCCESS")))


def newest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest complete snapshot that write_if_changed() has left, or an empty table."""
    made = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{made[-1]}") if made else spark.createDataFrame([], schema)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change of two listings (file, size, modified): what was added, removed, or has another size or time."""
    b, a = (x.select("file", F.struct("size", "modified").alias(name)) for x, name in ((before, "_b"), (after, "_a")))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return b.join(a, "file", "full_outer").select("file", change.alias("change")).filter("change IS NOT NULL")


def append_run(df: DataFrame, path: str, day: str) -> None:
    """Append a run to the history, under its day; a run of the same day written again replaces it."""
    df.withColumn("run_day", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_day").parquet(path)


def history(spark: SparkSession, path: str, last_day: str, keep_days: int = 60) -> DataFrame:
    """The runs of the last days; older partitions are not read."""
    return spark.read.parquet(path).filter(F.col("run_day").cast("date") > F.date_sub(F.lit(last_day).cast("date"), keep_days))
