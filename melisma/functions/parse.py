"""Parsers for durations, counts, years and nested page JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_sec(text: Column) -> Column:
    """h:mm:ss or m:ss in seconds, or null."""
    part = lambda i: F.regexp_extract(text, r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})\s*$", i)
    return F.when(text.rlike(r"^\s*(?:\d+:)?\d{1,2}:\d{2}\s*$"), F.concat(F.lit("0"), part(1)).try_cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long"))


def count(text: Column, unit: str = "plays?|views?") -> Column:
    """'1.2M plays', '12,345 views' as a number, or null: only a number that such a word follows counts. Each part of the text is named once, as
    expressions within lambdas are computed wherever they are named."""
    found = rf"(?i)([\d.,]+)\s*([kmb]?)\s*(?:{unit})(?![A-Za-z0-9_])"
    number = F.regexp_extract(F.regexp_replace(F.regexp_extract(text, found, 1), ",", ""), r"^(\d+(?:\.\d*)?|\.\d+)", 1)
    size = F.instr(F.lit(" kmb"), F.translate(F.regexp_extract(text, found, 2), "KMB", "kmb"))  # 1 for none
    return F.round(number.try_cast("double") * F.get(F.array(*(F.lit(x) for x in (1.0, 1e3, 1e6, 1e9))), size - 1)).cast("long")


def year(text: Column) -> Column:
    """The first 19xx or 20xx."""
    return F.nullif(F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int")


def album_type(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.contains("single"), "single").when(low.rlike("(?<![a-z])ep(?![a-z])"), "ep").otherwise("album")


def subtitle_duration(parts: Column) -> Column:
    """Seconds of the first part that is a time."""
    return duration_sec(F.get(F.filter(parts, lambda p: p.rlike(r"^\d+(:\d{2})+$")), 0))


def subtitle_label(parts: Column) -> Column:
    """The first part that is neither a time nor a count of views or plays."""
    return F.get(F.filter(parts, lambda p: ~p.rlike(r"^\d+(:\d{2})+$") & ~p.rlike(r"(?i)\d.*(views|plays)")), 0)


def clamp(text: Column, least: int, most: int, default: int) -> Column:
    """A parameter as a whole number within its limits, or the default."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(text.try_cast("long"), F.lit(default)))).cast("long")


def token(value: Column) -> Column:
    """A struct as JSON in URL-safe base 64 without padding."""
    return F.rtrim(F.translate(F.base64(F.to_json(value).cast("binary")), "+/", "-_"), F.lit("="))


def from_token(text: Column, schema: str) -> Column:
    """The struct that token() has written, or null."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)


def first_path(json: Column, paths: list[str], kind: str = "string") -> Column:
    """The first of alternative paths that is there."""
    return F.coalesce(*(F.try_variant_get(json, p, kind) for p in paths))


def typed_row(json: Column) -> Column:
    """struct(ok, kind, id, title, reason) of a result row: what can't be used keeps the reason why."""
    kind, ident, title = (first_path(json, [f"$.{a}", f"$.renderer.{a}"]) for a in ("kind", "id", "title"))
    reason = F.when(json.isNull(), "malformed").when(kind.isNull(), "no-kind").when(~kind.isin("song", "album", "artist", "playlist"), "unknown-kind").when(F.coalesce(ident, F.lit("")) == "", "no-id").when(F.coalesce(title, F.lit("")) == "", "no-title")
    return F.struct(reason.isNull().alias("ok"), kind.alias("kind"), ident.alias("id"), title.alias("title"), reason.alias("reason"))
