"""Rows of nested page JSON as variant expressions. What a page lacks is null, and a row without an id or a title is left out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from melisma.functions.parse import count, duration_sec

_LIST, _TEXT, _ANY = "array<variant>", "string", "variant"
#: Names of the page format.
ROW, CARD, SHELF, LIST_SHELF, CAROUSEL = "musicResponsiveListItemRenderer", "musicTwoRowItemRenderer", "musicShelfRenderer", "musicPlaylistShelfRenderer", "musicCarouselShelfRenderer"
TAB = "tabs[0].tabRenderer.content.sectionListRenderer.contents"
ONE, TWO = "contents.singleColumnBrowseResultsRenderer", "contents.twoColumnBrowseResultsRenderer"
COLUMN = "musicResponsiveListItemFlexColumnRenderer.text.runs"
PLAYED = "overlay.musicItemThumbnailOverlayRenderer.content.musicPlayButtonRenderer.playNavigationEndpoint.watchEndpoint.videoId"
EXPLICIT = "MUSIC_EXPLICIT_BADGE"


def at(v: Column, *paths: str, kind: str = _TEXT) -> Column:
    """The first of alternative paths that is there."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{p}", kind) for p in paths))


def listed(v: Column, *paths: str) -> Column:
    return F.coalesce(at(v, *paths, kind=_LIST), F.array().cast(_LIST))


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it: expressions within lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), 0)


def first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), 0)


def having(values: Column, *keys: str) -> Column:
    """What the first element that has one of the keys holds under it."""
    return F.get(F.filter(F.transform(values, lambda c: at(c, *keys, kind=_ANY)), lambda x: x.isNotNull()), 0)


def texts(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: at(r, "text")), "")


def rows_of(contents: Column, key: str = ROW) -> Column:
    return F.filter(F.transform(contents, lambda c: at(c, key, kind=_ANY)), lambda x: x.isNotNull())


def continuation(container: Column, contents: Column) -> Column:
    """The token of the next page: of the container, else of an element among its contents."""
    own = at(container, "continuations[0].nextContinuationData.continuation", "continuations[0].nextRadioContinuationData.continuation")
    return F.coalesce(own, more_of(contents))


def more_of(contents: Column) -> Column:
    return at(having(contents, "continuationItemRenderer"), "continuationEndpoint.continuationCommand.token")


def image(v: Column, path: str) -> Column:
    """The largest thumbnail, which is the last."""
    every = listed(v, f"{path}.musicThumbnailRenderer.thumbnail.thumbnails", f"{path}.croppedSquareThumbnailRenderer.thumbnail.thumbnails")
    return at(F.try_element_at(every, F.lit(-1)), "url")


def channel_run(runs: Column) -> Column:
    return first(runs, lambda r: at(r, "navigationEndpoint.browseEndpoint.browseId").startswith("UC"))


def separated(values: Column, mark: str = " • ") -> Column:
    """Runs of elements between marks: one more than there are marks."""
    step = lambda done, x: F.when(x == mark, F.concat(done, F.array(F.array().cast("array<string>")))).otherwise(
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.array(x))))
    )
    return F.aggregate(values, F.array(F.array().cast("array<string>")), step)


def every_other(values: Column) -> Column:
    return F.filter(values, lambda _, i: i % 2 == 0)


_RUN_LIST = "array<struct<text: string, navigationEndpoint: struct<browseEndpoint: struct<browseId: string>, watchEndpoint: struct<videoId: string>>>>"
_RUNS = f"struct<text: struct<runs: {_RUN_LIST}>>"
_IMAGES = "struct<thumbnail: struct<thumbnails: array<struct<url: string>>>>"
#: What song() reads of a row, so that one pass over the variant takes it all.
_SONG_ROW = f"""struct<playlistItemData: struct<videoId: string>, flexColumns: array<struct<musicResponsiveListItemFlexColumnRenderer: {_RUNS}>>,
 fixedColumns: array<struct<musicResponsiveListItemFixedColumnRenderer: {_RUNS}>>, badges: array<struct<musicInlineBadgeRenderer: struct<icon: struct<iconType: string>>>>,
 overlay: struct<musicItemThumbnailOverlayRenderer: struct<content: struct<musicPlayButtonRenderer: struct<playNavigationEndpoint: struct<watchEndpoint: struct<videoId: string>>>>>>,
 thumbnail: struct<musicThumbnailRenderer: {_IMAGES}, croppedSquareThumbnailRenderer: {_IMAGES}>>"""


def song(element: Column) -> Column:
    """video_id, title, artist_id, artist_name (the row's own channel), explicit, duration_sec, plays, thumbnail of an element that holds a row."""
    return bound(F.try_variant_get(element, f"$.{ROW}", _SONG_ROW), _columns_of_song)


def _columns_of_song(r: Column) -> Column:
    column = lambda i: F.coalesce(F.get(r["flexColumns"], i)["musicResponsiveListItemFlexColumnRenderer"]["text"]["runs"], F.array().cast(_RUN_LIST))
    return bound(F.struct(r.alias("r"), column(0).alias("c0"), column(1).alias("c1"), column(2).alias("c2"), column(3).alias("c3")), _song_of)


def _song_of(x: Column) -> Column:
    r, named = x["r"], F.get(x["c0"], 0)
    owner = first(F.concat(x["c1"], x["c2"]), lambda c: c["navigationEndpoint"]["browseEndpoint"]["browseId"].startswith("UC"))
    counted = F.filter(F.transform(F.concat(x["c1"], x["c2"], x["c3"]), lambda c: c["text"]), lambda t: t.rlike("(?i)plays?(?![A-Za-z0-9_])"))
    plays = first(F.transform(counted, lambda t: count(t, "plays?")), lambda n: n.isNotNull())
    fixed = F.array_join(F.transform(F.coalesce(F.get(r["fixedColumns"], 0)["musicResponsiveListItemFixedColumnRenderer"]["text"]["runs"], F.array().cast(_RUN_LIST)), lambda c: c["text"]), "")
    image = lambda k: r["thumbnail"][k]["thumbnail"]["thumbnails"]
    every = F.coalesce(image("musicThumbnailRenderer"), image("croppedSquareThumbnailRenderer"))
    played = r["overlay"]["musicItemThumbnailOverlayRenderer"]["content"]["musicPlayButtonRenderer"]["playNavigationEndpoint"]["watchEndpoint"]["videoId"]
    whole = lambda o: F.struct(
        F.coalesce(r["playlistItemData"]["videoId"], named["navigationEndpoint"]["watchEndpoint"]["videoId"], played).alias("video_id"), named["text"].alias("title"),
        o["navigationEndpoint"]["browseEndpoint"]["browseId"].alias("artist_id"), o["text"].alias("artist_name"),
        F.coalesce(F.exists(r["badges"], lambda b: F.coalesce(b["musicInlineBadgeRenderer"]["icon"]["iconType"] == EXPLICIT, F.lit(False))), F.lit(False)).alias("explicit"),
        bound(fixed, duration_sec).alias("duration_sec"), plays.alias("plays"), F.try_element_at(every, F.lit(-1))["url"].alias("thumbnail"),
    )
    return bound(owner, whole)


def songs(contents: Column) -> Column:
    return F.filter(F.transform(contents, song), lambda s: F.coalesce((s["video_id"] != "") & (s["title"] != ""), F.lit(False)))


def card(row: Column) -> Column:
    """kind (song, album, playlist or null), id, playlist_id, title, subtitle, artist_id, thumbnail of a two-row item."""
    watch, browse = at(row, "navigationEndpoint.watchEndpoint.videoId"), at(row, "navigationEndpoint.browseEndpoint.browseId")
    kind = F.when(watch != "", "song").when(browse.startswith("MPRE"), "album").when(browse.startswith("VL"), "playlist")
    over = "thumbnailOverlay.musicItemThumbnailOverlayRenderer.content.musicPlayButtonRenderer.playNavigationEndpoint"
    listing = F.when(kind == "playlist", F.substring(browse, 3, 1 << 30)).when(kind == "album", at(row, f"{over}.watchPlaylistEndpoint.playlistId", f"{over}.watchEndpoint.playlistId"))
    runs = listed(row, "subtitle.runs")
    return F.struct(
        kind.alias("kind"), F.when(kind == "song", watch).otherwise(browse).alias("id"), listing.alias("playlist_id"), at(row, "title.runs[0].text").alias("title"), texts(runs).alias("subtitle"),
        at(channel_run(runs), "navigationEndpoint.browseEndpoint.browseId").alias("artist_id"), image(row, "thumbnailRenderer").alias("thumbnail"),
    )


def cards(contents: Column) -> Column:
    return F.filter(F.transform(rows_of(contents, CARD), card), lambda c: F.coalesce(c["kind"].isNotNull() & (c["title"] != ""), F.lit(False)))


def artist_page(page: Column) -> Column:
    """sections (kind, title, is_video, songs, cards, more), thumbnail and channel_id (where the artist uploads otherwise)."""

    def section(c: Column) -> Column:
        return bound(F.struct(at(c, SHELF, kind=_ANY).alias("shelf"), at(c, CAROUSEL, kind=_ANY).alias("row")), lambda x: of_parts(x["shelf"], x["row"]))

    def of_parts(shelf: Column, row: Column) -> Column:
        header = "header.musicCarouselShelfBasicHeaderRenderer"
        title = F.coalesce(F.when(shelf.isNotNull(), at(shelf, "title.runs[0].text")).otherwise(at(row, f"{header}.title.runs[0].text")), F.lit(""))
        more = F.when(shelf.isNotNull(), at(shelf, "title.runs[0].navigationEndpoint.browseEndpoint.browseId")).otherwise(at(row, f"{header}.moreContentButton.buttonRenderer.navigationEndpoint.browseEndpoint.browseId"))
        kind = F.when(shelf.isNotNull(), "songs").when(row.isNotNull(), "carousel")
        return F.struct(kind.alias("kind"), title.alias("title"), (shelf.isNotNull() & title.rlike("(?i)video")).alias("is_video"), songs(listed(shelf, "contents")).alias("songs"), cards(listed(row, "contents")).alias("cards"), more.alias("more"))

    def of_page(page: Column) -> Column:
        sections = F.filter(F.transform(listed(page, f"{ONE}.{TAB}"), section), lambda s: s["kind"].isNotNull())
        head = at(page, "header.musicImmersiveHeaderRenderer", "header.musicVisualHeaderRenderer", kind=_ANY)
        return F.struct(sections.alias("sections"), F.coalesce(image(head, "foregroundThumbnail"), image(head, "thumbnail")).alias("thumbnail"), at(head, "subscriptionButton.subscribeButtonRenderer.channelId").alias("channel_id"))

    return bound(page, of_page)


def items_page(page: Column) -> Column:
    """songs, cards, continuation of a page of one artist's items, the first (a grid or a shelf) or a later one."""

    def parts(page: Column) -> Column:
        first_of = lambda p: F.get(listed(p, f"{ONE}.{TAB}"), 0)
        grid = F.coalesce(at(first_of(page), "gridRenderer", kind=_ANY), at(page, "continuationContents.gridContinuation", kind=_ANY))
        shelf = F.coalesce(at(first_of(page), LIST_SHELF, kind=_ANY), at(page, "continuationContents.musicPlaylistShelfContinuation", kind=_ANY))
        return F.struct(grid.alias("grid"), shelf.alias("shelf"), listed(page, "onResponseReceivedActions[0].appendContinuationItemsAction.continuationItems").alias("added"))

    def lists(x: Column) -> Column:
        rows = F.when(x["shelf"].isNotNull(), listed(x["shelf"], "contents")).otherwise(x["added"])
        return F.struct(x["grid"].alias("grid"), x["shelf"].alias("shelf"), rows.alias("rows"), listed(x["grid"], "items").alias("items"))

    def read(x: Column) -> Column:
        token = F.when(x["grid"].isNotNull(), continuation(x["grid"], x["items"])).when(x["shelf"].isNotNull(), continuation(x["shelf"], x["rows"])).otherwise(more_of(x["rows"]))
        return F.struct(songs(F.when(x["grid"].isNull(), x["rows"]).otherwise(F.array().cast(_LIST))).alias("songs"), cards(x["items"]).alias("cards"), token.alias("continuation"))

    return bound(bound(bound(page, parts), lists), read)


def playlist_page(page: Column) -> Column:
    """songs, continuation and views of an album's or a playlist's page, in one or two columns."""

    def parts(page: Column) -> Column:
        shelf = having(listed(page, f"{TWO}.secondaryContents.sectionListRenderer.contents", f"{ONE}.{TAB}"), LIST_SHELF, SHELF)
        head = F.coalesce(
            having(listed(page, f"{TWO}.{TAB}"), "musicResponsiveHeaderRenderer"),
            at(page, "header.musicDetailHeaderRenderer", "header.musicResponsiveHeaderRenderer", "header.musicEditablePlaylistDetailHeaderRenderer.header.musicDetailHeaderRenderer", kind=_ANY),
        )
        return F.struct(shelf.alias("shelf"), head.alias("head"))

    def lists(x: Column) -> Column:
        return F.struct(x["shelf"].alias("shelf"), x["head"].alias("head"), listed(x["shelf"], "contents").alias("rows"))

    def read(x: Column) -> Column:
        views = F.coalesce(*(count(texts(listed(x["head"], f"{k}.runs")), "views?") for k in ("secondSubtitle", "subtitle", "straplineTextOne")))
        return F.struct(songs(x["rows"]).alias("songs"), continuation(x["shelf"], x["rows"]).alias("continuation"), views.alias("views"))

    return bound(bound(bound(page, parts), lists), read)


def episode(item: Column) -> Column:
    """video_id, title, duration_sec, published of an episode's row of either kind."""
    multi, row = at(item, "musicMultiRowListItemRenderer", kind=_ANY), at(item, ROW, kind=_ANY)
    runs = F.when(multi.isNotNull(), listed(multi, "subtitle.runs")).otherwise(listed(row, f"flexColumns[1].{COLUMN}"))
    parts = F.filter(F.transform(separated(F.transform(runs, lambda r: F.coalesce(at(r, "text"), F.lit("")))), lambda s: F.get(s, 0)), lambda x: F.coalesce(x != "", F.lit(False)))
    is_time = lambda x: x.rlike(r"^\d+(:\d+){1,2}$")
    time = F.transform(F.split(first(parts, is_time), ":"), lambda x: x.cast("long"))
    return F.struct(
        F.coalesce(at(multi, "onTap.watchEndpoint.videoId"), at(row, "playlistItemData.videoId", PLAYED)).alias("video_id"),
        F.coalesce(at(multi, "title.runs[0].text"), at(row, f"flexColumns[0].{COLUMN}[0].text")).alias("title"),
        F.aggregate(time, F.lit(0).cast("long"), lambda a, x: a * 60 + x).alias("duration_sec"),
        first(parts, lambda x: ~is_time(x) & ~x.rlike(r"(?i)(?<![A-Za-z0-9_])views?(?![A-Za-z0-9_])")).alias("published"),
    )


def podcast_page(page: Column) -> Column:
    """name, author, channel_id, categories, episode_count, episodes and continuation of a show's first or later page."""

    def of_page(page: Column) -> Column:
        head = F.coalesce(having(listed(page, f"{TWO}.{TAB}"), "musicResponsiveHeaderRenderer"), having(listed(page, f"{ONE}.{TAB}"), "musicResponsiveHeaderRenderer"))
        shelf = F.coalesce(
            having(listed(page, f"{TWO}.secondaryContents.sectionListRenderer.contents"), SHELF, LIST_SHELF), having(listed(page, f"{ONE}.{TAB}"), SHELF, LIST_SHELF),
            at(page, "continuationContents.musicShelfContinuation", "continuationContents.musicPlaylistShelfContinuation", kind=_ANY),
        )
        contents = F.when(shelf.isNotNull(), listed(shelf, "contents")).otherwise(listed(page, "onResponseReceivedActions[0].appendContinuationItemsAction.continuationItems"))
        strap = "straplineTextOne.runs[0]"
        channel = at(head, f"{strap}.navigationEndpoint.browseEndpoint.browseId")
        episodes = F.filter(F.transform(contents, episode), lambda e: F.coalesce((e["video_id"] != "") & (e["title"] != ""), F.lit(False)))
        return F.struct(
            F.coalesce(at(head, "title.runs[0].text"), F.lit("")).alias("name"), at(head, f"{strap}.text").alias("author"), F.when(channel.startswith("UC"), channel).alias("channel_id"),
            F.filter(F.transform(listed(head, "subtitle.runs"), lambda r: at(r, "text")), lambda x: F.trim(x) != "•").alias("categories"), at(head, "secondSubtitle.runs[0].text").alias("episode_count"),
            episodes.alias("episodes"), continuation(shelf, contents).alias("continuation"),
        )

    return bound(page, of_page)


def search_shelf(page: Column) -> Column:
    """rows and continuation of a search's first page or a later one; of the rows the playlists (id, title, author)."""

    def of_page(page: Column) -> Column:
        shelf = F.coalesce(having(listed(page, "contents.tabbedSearchResultsRenderer." + TAB, "contents.sectionListRenderer.contents"), SHELF), at(page, "continuationContents.musicShelfContinuation", kind=_ANY))

        def playlist(row: Column) -> Column:
            browse, second = at(row, "navigationEndpoint.browseEndpoint.browseId"), listed(row, f"flexColumns[1].{COLUMN}")
            kind = at(row, "navigationEndpoint.browseEndpoint.browseEndpointContextSupportedConfigs.browseEndpointContextMusicConfig.pageType")
            author = F.coalesce(at(first(second, lambda r: at(r, "navigationEndpoint.browseEndpoint.browseId").isNotNull()), "text"), at(F.get(second, 0), "text"))
            ident = F.when(browse.startswith("VL"), F.substring(browse, 3, 1 << 30)).otherwise(browse)
            return F.struct(F.when(kind == "MUSIC_PAGE_TYPE_PLAYLIST", ident).alias("id"), at(row, f"flexColumns[0].{COLUMN}[0].text").alias("title"), author.alias("author"))

        rows = rows_of(listed(shelf, "contents"))
        found = F.filter(F.transform(rows, playlist), lambda p: F.coalesce((p["id"] != "") & (p["title"] != ""), F.lit(False)))
        return F.struct(F.size(rows).alias("n_rows"), found.alias("playlists"), continuation(shelf, listed(shelf, "contents")).alias("continuation"))

    return bound(page, of_page)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])))
def channel_shows(pages: pd.Series) -> pd.Series:
    """Shows of every carousel named Podcasts, wherever it lies in a channel's page, each once."""
    return pages.map(_shows, na_action="ignore")


def _shows(text: str) -> list[dict]:
    try:
        waiting, found = [json.loads(text)], {}
    except ValueError:
        return []
    while waiting:
        node = waiting.pop()
        inside = node if isinstance(node, list) else list(node.values()) if isinstance(node, dict) else []
        waiting.extend(x for x in reversed(inside) if isinstance(x, (dict, list)))
        carousel = node.get(CAROUSEL) if isinstance(node, dict) else None
        if isinstance(carousel, dict):
            runs = _dig(carousel, "header", "musicCarouselShelfBasicHeaderRenderer", "title", "runs") or []
            if "".join(str(_dig(r, "text") or "") for r in runs) == "Podcasts":
                for item in carousel.get("contents") or []:
                    row = _dig(item, CARD)
                    ident = _dig(row, "navigationEndpoint", "browseEndpoint", "browseId")
                    if isinstance(ident, str) and ident.startswith("MPSP"):
                        found.setdefault(ident, _dig(row, "title", "runs", 0, "text") or "")
    return [{"id": k, "name": v} for k, v in found.items()]


def _dig(node, *keys):
    for key in keys:
        try:
            node = node[key]
        except (KeyError, IndexError, TypeError):
            return None
    return node
