"""Content policy as column expressions and semi joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Flags:
    """What a listener filters; the defaults let everything pass. Literals, so that Catalyst folds what is off."""

    allow_female: bool = True
    kid_only: bool = False
    block_videos: bool = False

    @property
    def active(self) -> bool:
        return not self.allow_female or self.kid_only or self.block_videos


def flag(c: str | Column) -> Column:
    """An absent flag is false."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def allowed(flags: Flags, female: Column, kid: Column, video: Column) -> Column:
    keep = F.lit(True)
    if not flags.allow_female:
        keep &= ~flag(female)
    if flags.kid_only:
        keep &= flag(kid)
    if flags.block_videos:
        keep &= ~flag(video)
    return keep


def allowed_classes(flags: Flags) -> int:
    """Bits of the member classes (4 female + 2 video + kid) that pass."""
    return sum(1 << c for c in range(8) if (flags.allow_female or not c & 4) and (not flags.kid_only or c & 1) and (not flags.block_videos or not c & 2))


def survives(flags: Flags, mask: Column, fallback: Column, owned: Column) -> Column:
    """Whether a playlist keeps any member: open where nothing is known, hidden where its owner is."""
    if not flags.active:
        return F.lit(True)
    open_ = flag(fallback) | (F.coalesce(mask, F.lit(0)) == 0) | (mask.bitwiseAND(F.lit(allowed_classes(flags)).cast("long")) != 0)
    return open_ if flags.allow_female else open_ & ~flag(owned)


def without_blocked(df: DataFrame, id_columns: list[str], blocked: DataFrame, flags: Flags) -> DataFrame:
    """Rows none of whose ids is blocked: blocked(id, conditional); conditional ids only where female voices are filtered."""
    ids = blocked.filter(~F.col("conditional") | F.lit(not flags.allow_female)).select(F.col("id").alias("_blocked"))
    for c in id_columns:  # one equi anti join for each id space, never an OR of keys
        df = df.join(ids, F.col(c) == F.col("_blocked"), "left_anti")
    return df


def admission(total: Column, whitelisted: Column, least: int = 4, ratio: float = 0.5) -> Column:
    """struct(ok, reason) of the playlist gate; both bounds belong to it."""
    few, thin = whitelisted < least, whitelisted / F.greatest(total, F.lit(1)) < ratio
    return F.struct((~few & ~thin).alias("ok"), F.when(few, "few").when(thin, "ratio").otherwise("ok").alias("reason"))


def screened(text: Column, terms: list[str]) -> Column:
    """Whether any term stands in the text, without case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*(F.lit(x.lower()) for x in terms)), lambda x: F.contains(low, x)) if terms else F.lit(False)


def trusted(df: DataFrame, uploader: str, whitelist: DataFrame) -> DataFrame:
    """Rows without an uploader or with a whitelisted one."""
    known = whitelist.select(F.col(whitelist.columns[0]).alias("_ok")).distinct().withColumn("_in", F.lit(True))
    return df.join(known, F.col(uploader) == F.col("_ok"), "left").filter(F.col(uploader).isNull() | F.col("_in")).drop("_ok", "_in")
