"""Page parsing over JSON that is composed from the tables in the shapes that pages have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from melisma.functions import pages as pg
from melisma.registry import query
from melisma.sources import tables as t


def _nested(path: str, value: Column) -> Column:
    """value under a path of struct fields; the outermost is named by the path's first part."""
    for name in reversed(path.split(".")):
        value = F.struct(value.alias(name))
    return value


def _run(text: Column, browse: Column | None = None, watch: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    target = F.struct(_nested("browseId", none if browse is None else browse).alias("browseEndpoint"), _nested("videoId", none if watch is None else watch).alias("watchEndpoint"))
    return F.struct(text.alias("text"), target.alias("navigationEndpoint"))


def _columns(*runs: Column) -> Column:
    return F.array(*(_nested(pg.COLUMN, r) for r in runs)).alias("flexColumns")


def _song_row(ident: Column, title: Column, channel: Column, plays: Column, time: Column, direct: Column, explicit: Column) -> Column:
    """A row whose id stands at the item itself, or else at its title's run."""
    none = F.lit(None).cast("string")
    columns = _columns(F.array(_run(title, watch=F.when(~direct, ident))), F.array(_run(F.lit("by ")), _run(F.concat(F.lit("C"), channel), browse=F.concat(F.lit("UC"), channel))), F.array(_run(plays)))
    badge = F.array(_nested("musicInlineBadgeRenderer.icon.iconType", F.when(explicit, pg.EXPLICIT).otherwise(none)))
    fixed = F.array(_nested("musicResponsiveListItemFixedColumnRenderer.text.runs", F.array(_nested("text", time))))
    return F.struct(_nested("videoId", F.when(direct, ident)).alias("playlistItemData"), columns, badge.alias("badges"), fixed.alias("fixedColumns"))


def _order_pages(spark, d):
    """page_id, contents: the songs of each order, a row for each of its lines. Only their keys are shuffled, once; rows are composed after that."""
    line = t.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a number keeps few bytes from becoming one task
    keys = line.repartition(tasks, "page_id").groupBy("page_id", "pos").agg(F.min("p").alias("p"), F.min("s").alias("s"))

    def row(p: Column, s: Column) -> Column:
        return _song_row(
            F.when(p % 11 != 0, F.concat(F.lit("v"), p)), F.concat(F.lit("T"), p), s.cast("string"), F.when(p % 3 == 0, F.concat(p, F.lit("K plays"))).otherwise(F.lit("2001")),
            F.concat((p % 60).cast("string"), F.lit(":07")), p % 2 == 0, p % 5 == 0,
        )

    lines = keys.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p", "s"))).alias("lines"))
    return lines.select("page_id", F.transform("lines", lambda x: F.struct(row(x["p"], x["s"]).alias(pg.ROW))).alias("contents"))


def _page(rows, renderer: str = pg.ROW):
    """page_id, contents: the rows of each page in order, each under its renderer's name."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: F.struct(x["row"].alias(renderer)))
    return rows.groupBy("page_id").agg(held.alias("contents"))


_SONGS = """l AS (SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS pos, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
 so AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, 'v' || p AS video_id, 'T' || p AS title, 'UC' || s AS artist_id, 'C' || s AS artist_name, p % 5 = 0 AS explicit,
  CAST((p % 60) * 60 + 7 AS BIGINT) AS duration_sec, CASE WHEN p % 3 = 0 THEN p * 1000 END AS plays FROM l WHERE p % 11 <> 0)"""
_FIELDS = ("video_id", "title", "artist_id", "artist_name", "explicit", "duration_sec", "plays")


def _songs_of(df, column: str, *more: str):
    """The songs of each page. The outer form, as the other one filters by the list's size, which would parse each page once more."""
    rows = df.select("page_id", *more, F.posexplode_outer(column).alias("place", "x")).filter("place IS NOT NULL")
    return rows.select("page_id", (F.col("place") + 1).cast("long").alias("place"), *(F.col(f"x.{c}").alias(c) for c in _FIELDS), *more)


@query("playlist_page", f"WITH {_SONGS} SELECT so.*, CASE WHEN page_id % 2 = 0 THEN 'next' || page_id END AS continuation, CASE WHEN page_id % 3 <> 0 THEN (page_id % 50) * 100 + 1000 END AS views FROM so")
def playlist_page(spark, d):
    """Playlist pages of either layout: their songs, the token of the next page and the views in the header."""
    k = F.col("page_id")
    parts = _order_pages(spark, d)
    shelf = F.struct("contents", F.when(k % 2 == 0, F.array(_nested("nextContinuationData.continuation", F.concat(F.lit("next"), k)))).alias("continuations"))
    head = _nested("musicDetailHeaderRenderer.secondSubtitle.runs", F.array(_nested("text", F.concat(F.when(k % 3 == 0, "5 tracks").otherwise(F.concat(F.format_string("%d.%d", F.floor(k % 50 / 10) + 1, k % 10), F.lit("K views"))))), _nested("text", F.lit(" • 50+ hours"))))
    wide = _nested("secondaryContents.sectionListRenderer.contents", F.array(F.struct(shelf.alias(pg.LIST_SHELF))))
    tall = _nested("tabs", F.array(_nested("tabRenderer.content.sectionListRenderer.contents", F.array(F.struct(shelf.alias(pg.SHELF))))))
    contents = F.struct(F.when(k % 4 < 2, wide).alias("twoColumnBrowseResultsRenderer"), F.when(k % 4 >= 2, tall).alias("singleColumnBrowseResultsRenderer"))
    found = parts.select("page_id", pg.playlist_page(F.try_parse_json(F.to_json(F.struct(head.alias("header"), contents.alias("contents"))))).alias("v"))
    return _songs_of(found.select("page_id", "v.songs", "v.continuation", "v.views"), "songs", "continuation", "views")


@query("items_page", f"WITH {_SONGS} SELECT so.*, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'more' || page_id END AS continuation FROM so")
def items_page(spark, d):
    """An artist's items: a first shelf, a later one, or rows that were only added."""
    k = F.col("page_id")
    parts = _order_pages(spark, d)
    shelf = F.struct("contents", F.array(_nested("nextRadioContinuationData.continuation", F.concat(F.lit("more"), k))).alias("continuations"))
    first = _nested("singleColumnBrowseResultsRenderer.tabs", F.array(_nested("tabRenderer.content.sectionListRenderer.contents", F.array(F.struct(shelf.alias(pg.LIST_SHELF))))))
    page = F.struct(
        F.when(k % 3 == 0, first).alias("contents"), F.when(k % 3 == 1, _nested("musicPlaylistShelfContinuation", shelf)).alias("continuationContents"),
        F.when(k % 3 == 2, F.array(_nested("appendContinuationItemsAction.continuationItems", F.col("contents")))).alias("onResponseReceivedActions"),
    )
    found = parts.select("page_id", pg.items_page(F.try_parse_json(F.to_json(page))).alias("v"))
    return _songs_of(found.select("page_id", "v.songs", "v.continuation"), "songs", "continuation")


_KINDS = (("MPRE", "album"), ("VL", "playlist"), ("UC", None))


@query("artist_page", """WITH o AS (SELECT artist_id, track_id, row_number() OVER (PARTITION BY artist_id ORDER BY track_id) AS n FROM track)
 SELECT artist_id AS page_id, 'songs' AS section, 'T' || artist_id || ' videos' AS heading, 'v' || track_id AS id, NULL AS kind, NULL AS subtitle, 'ch' || artist_id AS channel_id FROM o
 UNION ALL SELECT artist_id, 'carousel', 'Albums', CASE track_id % 3 WHEN 0 THEN 'MPRE' || track_id ELSE 'VL' || track_id END, CASE track_id % 3 WHEN 0 THEN 'album' ELSE 'playlist' END, 'Album • ' || track_id, 'ch' || artist_id FROM o WHERE track_id % 3 <> 2""")
def artist_page(spark, d):
    """Sections of artists' pages: a shelf of songs and a carousel of albums and playlists; cards of other kinds are left out."""
    k = F.col("track_id")
    own = t.tracks(spark, d).select(F.col("artist_id").alias("page_id"), k.alias("pos"), "track_id")
    row = _song_row(F.concat(F.lit("v"), k), F.concat(F.lit("T"), k), F.col("page_id").cast("string"), F.lit("9 plays"), F.lit("3:00"), F.lit(True), F.lit(False))
    target = F.concat(F.element_at(F.array(*(F.lit(a) for a, _ in _KINDS)), (k % 3 + 1).cast("int")), k)
    card = F.struct(_nested("browseEndpoint.browseId", target).alias("navigationEndpoint"), _nested("runs", F.array(_nested("text", F.concat(F.lit("A"), k)))).alias("title"), _nested("runs", F.array(_nested("text", F.lit("Album • ")), _nested("text", k.cast("string")))).alias("subtitle"))
    ordered = lambda x, name: F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("row")))), lambda y: F.struct(y["row"].alias(name)))
    parts = own.groupBy("page_id").agg(ordered(row, pg.ROW).alias("rows"), ordered(card, pg.CARD).alias("cards"))
    shelf = F.struct(_nested("runs", F.array(_nested("text", F.concat(F.lit("T"), F.col("page_id"), F.lit(" videos"))))).alias("title"), F.col("rows").alias("contents"))
    carousel = F.struct(_nested("musicCarouselShelfBasicHeaderRenderer.title.runs", F.array(_nested("text", F.lit("Albums")))).alias("header"), F.col("cards").alias("contents"))
    sections = F.array(F.struct(shelf.alias(pg.SHELF), F.lit(None).cast(_kind_of(parts, carousel)).alias(pg.CAROUSEL)), F.struct(F.lit(None).cast(_kind_of(parts, shelf)).alias(pg.SHELF), carousel.alias(pg.CAROUSEL)))
    contents = _nested("singleColumnBrowseResultsRenderer.tabs", F.array(_nested("tabRenderer.content.sectionListRenderer.contents", sections)))
    head = _nested("musicImmersiveHeaderRenderer.subscriptionButton.subscribeButtonRenderer.channelId", F.concat(F.lit("ch"), F.col("page_id")))
    found = parts.select("page_id", pg.artist_page(F.try_parse_json(F.to_json(F.struct(head.alias("header"), contents.alias("contents"))))).alias("v"))
    section = found.select("page_id", "v.channel_id", F.explode("v.sections").alias("s"))
    rows = section.select("page_id", F.col("s.kind").alias("section"), F.col("s.title").alias("heading"), "channel_id", F.col("s.songs").alias("songs"), F.col("s.cards").alias("cards"))
    none = F.lit(None).cast("string")
    listed = rows.select("page_id", "section", "heading", F.explode("songs").alias("x"), "channel_id").select("page_id", "section", "heading", F.col("x.video_id").alias("id"), none.alias("kind"), none.alias("subtitle"), "channel_id")
    return listed.union(rows.select("page_id", "section", "heading", F.explode("cards").alias("x"), "channel_id").select("page_id", "section", "heading", "x.id", "x.kind", "x.subtitle", "channel_id"))


def _kind_of(df, column: Column):
    return df.select(column.alias("x")).schema["x"].dataType


@query("podcast_page", """WITH e AS (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2)
 SELECT conv_id AS page_id, 'show ' || conv_id AS name, CASE WHEN conv_id % 2 = 0 THEN 'UC' || conv_id END AS channel_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, 'e' || conv_id || '-' || turn AS video_id,
  CASE WHEN turn % 2 = 0 THEN CAST(turn * 60 + 5 AS BIGINT) ELSE CAST(3600 + turn * 60 + 5 AS BIGINT) END AS duration_sec, 'day ' || turn AS published, 'tok' || conv_id AS continuation FROM e""")
def podcast_page(spark, d):
    """Shows with episodes of both kinds of rows; the last element of a page may hold the token of the next."""
    k, n = F.col("page_id"), F.col("pos")
    eps = t.load(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos")).distinct()
    time = F.concat(F.when(n % 2 == 1, "1:").otherwise(""), F.lpad(n.cast("string"), 2, "0"), F.lit(":05"))
    parts = F.array(*(_run(x) for x in (F.concat(F.lit("day "), n), F.lit(" • "), F.lit("7 views"), F.lit(" • "), time)))
    ident, title = F.concat(F.lit("e"), k, F.lit("-"), n), F.concat(F.lit("E"), n)
    multi = F.struct(_nested("watchEndpoint.videoId", ident).alias("onTap"), _nested("runs", F.array(_run(title))).alias("title"), _nested("runs", parts).alias("subtitle"))
    plain = F.struct(_nested("videoId", ident).alias("playlistItemData"), _columns(F.array(_run(title)), parts))
    item = F.struct(F.when(n % 3 == 0, multi).alias("musicMultiRowListItemRenderer"), F.when(n % 3 != 0, plain).alias(pg.ROW), _nested("continuationEndpoint.continuationCommand.token", F.lit(None).cast("string")).alias("continuationItemRenderer"))
    last = _nested("continuationEndpoint.continuationCommand.token", F.concat(F.lit("tok"), k))
    held = eps.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(item["musicMultiRowListItemRenderer"].alias("musicMultiRowListItemRenderer"), item[pg.ROW].alias(pg.ROW)).alias("row")))), lambda x: x["row"]).alias("rows"))
    more = F.array(F.struct(*(F.lit(None).cast(_kind_of(eps, c)).alias(name) for name, c in (("musicMultiRowListItemRenderer", multi), (pg.ROW, plain))), last.alias("continuationItemRenderer")))
    rows = F.transform("rows", lambda x: F.struct(x["musicMultiRowListItemRenderer"].alias("musicMultiRowListItemRenderer"), x[pg.ROW].alias(pg.ROW), F.lit(None).cast(_kind_of(held, last)).alias("continuationItemRenderer")))
    shelf = F.struct(F.concat(rows, more).alias("contents"))
    strap = _nested("runs", F.array(_run(F.lit("author"), browse=F.concat(F.when(k % 2 == 0, "UC").otherwise("XX"), k))))
    head = F.struct(F.struct(_nested("runs", F.array(_run(F.concat(F.lit("show "), k)))).alias("title"), strap.alias("straplineTextOne")).alias("musicResponsiveHeaderRenderer"))
    two = F.struct(F.array(_nested("tabRenderer.content.sectionListRenderer.contents", F.array(head))).alias("tabs"), _nested("sectionListRenderer.contents", F.array(F.struct(shelf.alias(pg.SHELF)))).alias("secondaryContents"))
    found = held.select("page_id", pg.podcast_page(F.try_parse_json(F.to_json(_nested("contents.twoColumnBrowseResultsRenderer", two)))).alias("v"))
    rows = found.select("page_id", "v.name", "v.channel_id", F.posexplode("v.episodes").alias("place", "x"), "v.continuation")
    return rows.select("page_id", "name", "channel_id", (F.col("place") + 1).cast("long").alias("place"), "x.video_id", "x.duration_sec", "x.published", "continuation")


@query("search_shelf", "SELECT n_regionkey AS page_id, count(*) AS n_rows, count(*) FILTER (n_nationkey % 3 <> 0) AS playlists, min(CASE WHEN n_nationkey % 3 <> 0 THEN 'PL' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END) AS first_id, min(CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'U' || n_name ELSE 'by' END END) AS author, 'c' || n_regionkey AS continuation FROM nation GROUP BY 1")
def search_shelf(spark, d):
    """Search results read leniently: of all rows the playlists, whatever else they lack."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    ident = F.concat(F.lit("VLPL"), F.lpad(k.cast("string"), 2, "0"))
    kind = F.when(k % 3 != 0, "MUSIC_PAGE_TYPE_PLAYLIST").otherwise("MUSIC_PAGE_TYPE_ARTIST")
    browse = F.struct(ident.alias("browseId"), _nested("browseEndpointContextMusicConfig.pageType", kind).alias("browseEndpointContextSupportedConfigs"))
    row = F.struct(_nested("browseEndpoint", browse).alias("navigationEndpoint"), _columns(F.array(_run(name), _run(F.lit(""))), F.array(_run(F.lit("by")), _run(F.concat(F.lit("U"), name), browse=F.when(k % 2 == 0, F.concat(F.lit("UC"), k))))))
    parts = _page(t.load(spark, d, "nation").select(F.col("n_regionkey").alias("page_id"), k.alias("pos"), row.alias("row")))
    shelf = F.struct("contents", F.array(_nested("nextContinuationData.continuation", F.concat(F.lit("c"), F.col("page_id")))).alias("continuations"))
    first = _nested("tabbedSearchResultsRenderer.tabs", F.array(_nested("tabRenderer.content.sectionListRenderer.contents", F.array(F.struct(shelf.alias(pg.SHELF))))))
    page = F.struct(F.when(F.col("page_id") % 2 == 0, first).alias("contents"), F.when(F.col("page_id") % 2 == 1, _nested("musicShelfContinuation", shelf)).alias("continuationContents"))
    v = parts.select("page_id", pg.search_shelf(F.try_parse_json(F.to_json(page))).alias("v")).select("page_id", "v.*")
    return v.select("page_id", F.col("n_rows").cast("long").alias("n_rows"), F.size("playlists").cast("long").alias("playlists"), F.array_min(F.transform("playlists", lambda p: p["id"])).alias("first_id"), F.array_min(F.transform("playlists", lambda p: p["author"])).alias("author"), "continuation")


@query("channel_shows", "SELECT DISTINCT n_regionkey AS page_id, 'MPSP' || (n_nationkey % 7) AS id, 'show ' || (n_nationkey % 7) AS name FROM nation WHERE n_nationkey % 7 <> 3")
def channel_shows(spark, d):
    """Shows that lie somewhere in a channel's page, each once; rows that are no shows and other carousels don't count."""
    k = F.col("n_nationkey") % 7
    card = F.struct(_nested("browseEndpoint.browseId", F.concat(F.when(k == 3, "VL").otherwise("MPSP"), k)).alias("navigationEndpoint"), _nested("runs", F.array(_nested("text", F.concat(F.lit("show "), k)))).alias("title"))
    held = t.load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.collect_list(F.struct(card.alias(pg.CARD))).alias("contents"))

    def carousel(name: str) -> Column:
        return F.struct(F.struct(_nested("musicCarouselShelfBasicHeaderRenderer.title.runs", F.array(_nested("text", F.lit(name)))).alias("header"), (F.col("contents") if name == "Podcasts" else F.slice("contents", 1, 0)).alias("contents")).alias(pg.CAROUSEL))

    page = F.to_json(_nested("contents.tabs", F.array(F.array(carousel("Albums")), F.array(carousel("Podcasts"), carousel("Podcasts")))))
    return held.select("page_id", F.explode(pg.channel_shows(page)).alias("x")).select("page_id", "x.id", "x.name")
