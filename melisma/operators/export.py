"""Hash-sharded, content-addressed snapshots and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melisma.functions import hashing as h


def sharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Each row's shard: it depends on the key only, so a change touches one shard."""
    return df.withColumn("shard", F.pmod(h.times31(F.col(key).cast("string")), F.lit(shards)).cast("int"))


def manifest(df: DataFrame, key: str, shards: int) -> DataFrame:
    """shard, n, digest. The digest combines row digests without order, so no shard is gathered anywhere."""
    columns = [c for c in sorted(df.columns)]
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    parts = [F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    sums = sharded(df, key, shards).groupBy("shard").agg(F.count("*").alias("n"), *(F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)))
    return sums.select("shard", "n", F.sha2(F.concat_ws("-", *(f"s{k}" for k in range(4)), "n"), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """shard and what happened to it: added, removed or changed."""
    a, b = old.select("shard", F.col("digest").alias("before")), new.select("shard", F.col("digest").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, "shard", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after"))).select("shard", kind.alias("change"))


def write(df: DataFrame, key: str, shards: int, path: str) -> None:
    """One folder for each shard."""
    sharded(df, key, shards).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
