"""Snapshot merges: an old and a new table in, the next snapshot out. Re-delivery of a batch changes nothing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a column of the next snapshot comes from the old and the new value.
RULES = {
    "overwrite": lambda old, new, there: F.when(there, new).otherwise(old),
    "prefer_new": lambda old, new, there: F.coalesce(new, old),
    "keep_old": lambda old, new, there: F.coalesce(old, new),
    "untouched": lambda old, new, there: old,
    "max": lambda old, new, there: F.greatest(old, new),
    "positive_max": lambda old, new, there: F.nullif(F.greatest(F.coalesce(old, F.lit(0)), F.coalesce(new, F.lit(0))), F.lit(0)),
}


def upsert(old: DataFrame, new: DataFrame, key: list[str], rules: Mapping[str, str], blocked: DataFrame | None = None) -> DataFrame:
    """Full outer merge on the key by a rule for each column; rows that the batch lacks stay.

    Of several rows that the batch has for a key the greatest in the order of its columns counts. Keys in blocked(key) are neither
    taken from the batch nor kept.
    """
    there = [c for c in rules if c in new.columns]
    one = new.groupBy(*key).agg(F.max(F.struct(*there)).alias("_row")) if there else new.select(*key).distinct().withColumn("_row", F.struct(F.lit(1)))
    n = one.select(*key, *(F.col("_row")[c].alias(f"_new_{c}") for c in there), F.lit(True).alias("_there"))
    joined = old.join(n, key, "full_outer")
    if blocked is not None:
        joined = joined.join(blocked.select(*key).distinct(), key, "left_anti")
    fresh = F.coalesce("_there", F.lit(False))
    value = lambda c: F.col(f"_new_{c}") if c in there else F.lit(None)
    return joined.select(*key, *(RULES[r](F.col(c), value(c), fresh).alias(c) for c, r in rules.items()))


def put(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """A key-value table (k, v) once changes are written over it."""
    return upsert(settings, changes, ["k"], {"v": "overwrite"})


def replace_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows of keys that the batch has give way to the batch's rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def fill_null(df: DataFrame, values: DataFrame, key: str, columns: Mapping[str, bool]) -> DataFrame:
    """Values into columns: True prefers the new one, False keeps what is there."""
    v = values.select(key, *(F.col(c).alias(f"_v_{c}") for c in columns))
    out = df.join(v, key, "left")
    for c, newer in columns.items():
        out = out.withColumn(c, F.coalesce(f"_v_{c}", c) if newer else F.coalesce(c, f"_v_{c}"))
    return out.select(df.columns)


def prune(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return df.join(keep.select(key).distinct(), key, "left_semi")


def prune_plan(have: DataFrame, keep: DataFrame, key: str, least: float | None) -> DataFrame:
    """One row: rows, survivors and whether a prune is safe. An invalid ratio counts as one half; an empty table is safe."""
    ratio = least if least is not None and 0 < least <= 1 else 0.5
    marked = have.join(keep.select(key, F.lit(1).alias("_k")).distinct(), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count("_k").alias("survivors")).select("*", ((F.col("total") == 0) | (F.col("survivors") >= ratio * F.col("total"))).alias("safe"))


def vocabulary_array(values: Column, vocabulary: list[str]) -> Column:
    """Known values only, sorted; null if none is left."""
    known = F.array_sort(F.array_intersect(values, F.array(*(F.lit(v) for v in vocabulary))))
    return F.when(F.size(known) > 0, known)


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Last write wins over an operation log."""
    from melisma.operators.ranking import keep_first

    return keep_first(log, key, order)
