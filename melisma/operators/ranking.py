"""Ranking, paging and keep-first operators over windows with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """Of each key the first row in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def cap_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group; rows without a group are not capped."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col(group).isNull() | (F.col("_rn") <= n)).drop("_rn")


def top_ranked(df: DataFrame, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows with their ranks. The limit runs as a distributed top-n; only n rows are then numbered."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 .. offset + limit, with next_offset if there is a row beyond them (one row is looked ahead)."""
    seen = top_ranked(df, order, offset + limit + 1, "_rn")
    more = seen.agg((F.max("_rn") > offset + limit).alias("_more"))
    return seen.filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)).join(F.broadcast(more)).withColumn("next_offset", F.when(F.col("_more"), F.lit(offset + limit))).drop("_rn", "_more")


def round_robin(df: DataFrame, group: str, group_order: list[Column], within: list[Column], n: int) -> DataFrame:
    """First the best of each group in group order, then the second of each, and so on."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*within)).cast("long"))
    return top_ranked(turn, [F.col("turn").asc(), *group_order], n)


def floor_of_best(df: DataFrame, group: list[str], score: str, share: float) -> DataFrame:
    """Rows with at least a share of their group's best score."""
    return df.withColumn("_best", F.max(score).over(Window.partitionBy(*group))).filter(F.col(score) >= share * F.col("_best")).drop("_best")
