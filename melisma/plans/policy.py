"""Content policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.operators import policy as p
from melisma.functions import text as tx
from melisma.registry import query
from melisma.sources import tables as t


@query("content_filter", "SELECT t.track_id, t.title FROM track t LEFT JOIN artist a USING (artist_id) WHERE NOT coalesce(a.is_female, false) AND coalesce(a.is_kid, false) AND NOT t.is_video")
def content_filter(spark, d, flags: p.Flags = p.Flags(False, True, True)):
    found = t.tracks(spark, d).join(t.artists(spark, d), "artist_id", "left")
    return found.filter(p.allowed(flags, F.col("is_female"), F.col("is_kid"), F.col("is_video"))).select("track_id", "title")


@query("blocked_ids", "SELECT al.album_id, al.artist_id FROM album al WHERE al.album_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AND al.artist_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500)")
def blocked_ids(spark, d):
    """Albums neither of whose ids is on a block list; the second list counts only where female voices are filtered."""
    blocked = t.load(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("id"), F.lit(False).alias("conditional")).distinct()
    artists = t.load(spark, d, "supplier").filter("s_acctbal < 500").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("conditional"))
    flags = p.Flags(allow_female=False)
    return p.without_blocked(p.without_blocked(t.albums(spark, d), ["album_id"], blocked, flags), ["artist_id"], artists, flags).select("album_id", "artist_id")


@query("entity_gate", "SELECT al.album_id, al.album_title FROM album al JOIN artist a USING (artist_id) WHERE NOT a.is_female")
def entity_gate(spark, d):
    """Detail rows of owners that pass; none for one that doesn't."""
    return t.albums(spark, d).join(t.artists(spark, d).filter("NOT is_female").select("artist_id"), "artist_id", "left_semi").select("album_id", "album_title")


@query("survival", "WITH c AS (SELECT m.playlist_id, bool_or(t.track_id IS NULL) AS fb, bit_or(CAST(1 << CAST(4 * CAST(coalesce(a.is_female, false) AS INT) + 2 * CAST(coalesce(t.is_video, false) AS INT) + CAST(coalesce(a.is_kid, false) AS INT) AS INT) AS BIGINT)) AS mask FROM playlist_track m LEFT JOIN track t ON t.track_id = m.track_id AND t.track_id % 1000 <> 0 LEFT JOIN artist a ON a.artist_id = t.artist_id GROUP BY 1) SELECT p.playlist_id FROM playlist p LEFT JOIN c USING (playlist_id) WHERE (coalesce(fb, false) OR coalesce(mask, 0) = 0 OR (mask & 2) <> 0) AND NOT p.playlist_id % 13 = 0")
def survival(spark, d):
    """One bitwise AND against the classes that pass the conjunction of filters."""
    from melisma.plans.catalog import flag_class

    known = t.tracks(spark, d).filter("track_id % 1000 <> 0").join(t.artists(spark, d), "artist_id", "left").select("track_id", "is_video", "is_female", "is_kid", F.lit(True).alias("known"))
    members = t.playlist_tracks(spark, d).join(known, "track_id", "left")
    masks = members.groupBy("playlist_id").agg(F.bool_or(F.col("known").isNull()).alias("fb"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), flag_class())).alias("mask"))
    keep = p.survives(p.Flags(False, True, True), F.col("mask"), F.col("fb"), F.col("playlist_id") % 13 == 0)
    return t.playlists(spark, d).join(masks, "playlist_id", "left").filter(keep).select("playlist_id")


@query("admission_gate", "SELECT playlist_id, total, ok_members, ok_members >= 4 AND ok_members / total >= 0.5 AS ok, CASE WHEN ok_members < 4 THEN 'few' WHEN ok_members / total < 0.5 THEN 'ratio' ELSE 'ok' END AS reason FROM (SELECT m.playlist_id, count(*) AS total, count(*) FILTER (t.artist_id % 2 = 0) AS ok_members FROM playlist_track m JOIN track t USING (track_id) GROUP BY 1)")
def admission_gate(spark, d):
    counts = t.playlist_tracks(spark, d).join(t.tracks(spark, d), "track_id").groupBy("playlist_id").agg(F.count("*").alias("total"), F.count_if(F.col("artist_id") % 2 == 0).alias("ok_members"))
    return counts.withColumn("gate", p.admission(F.col("total"), F.col("ok_members"))).select("playlist_id", "total", "ok_members", "gate.ok", "gate.reason")


@query("term_screen", "SELECT p_partkey AS track_id FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'widget') OR contains(lower(p_name || ' ' || p_brand), 'brand#7')")
def term_screen(spark, d):
    return t.load(spark, d, "part").filter(p.screened(F.concat_ws(" ", "p_name", "p_brand"), ["Widget", "BRAND#7"])).select(F.col("p_partkey").alias("track_id"))


@query("whitelist_purity", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount = 0 OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def whitelist_purity(spark, d):
    lines = t.load(spark, d, "lineitem").withColumn("uploader", F.when(F.col("l_discount") != 0, F.col("l_suppkey")))
    return p.trusted(lines, "uploader", t.load(spark, d, "supplier").filter("s_acctbal > 5000").select("s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("recency_window", "SELECT album_id, album_date FROM album WHERE album_date >= strftime(DATE '2001-08-02' - INTERVAL 10 DAY, '%Y-%m-%d')")
def recency_window(spark, d, now: str = "2001-08-02", days: int = 10):
    """Releases of the last days; undated ones are out. ISO dates compare as text, so the filter reaches the scan."""
    return t.albums(spark, d).filter(F.col("album_date") >= F.date_format(F.date_sub(F.lit(now).cast("date"), days), "yyyy-MM-dd")).select("album_id", "album_date")


@query("acapella_veto", "SELECT track_id FROM track t WHERE track_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1) OR regexp_matches(title, '(?i)(^|[^a-z])(ring|bolt)([^a-z]|$)') OR list_contains(genres, 'PROMO')")
def acapella_veto(spark, d):
    """Curated, or by a strict word in the title, or by genre."""
    curated = t.load(spark, d, "lineitem").filter("l_quantity = 1").select(F.col("l_partkey").alias("track_id")).distinct().withColumn("curated", F.lit(True))
    found = t.tracks(spark, d).join(curated, "track_id", "left")
    return found.filter(p.flag("curated") | F.col("title").rlike("(?i)(^|[^a-z])(ring|bolt)([^a-z]|$)") | F.array_contains("genres", "PROMO")).select("track_id")


@query("season_exclusion", "SELECT track_id FROM track WHERE NOT list_has_any(genres, ['PROMO', 'Brand#3', 'Brand#5'])")
def season_exclusion(spark, d):
    slugs = F.array(*(F.lit(x) for x in ("PROMO", "Brand#3", "Brand#5")))
    return t.tracks(spark, d).filter(~F.arrays_overlap("genres", slugs)).select("track_id")


#: Shares and sizes from which a station goes on air: tracks of a genre, heard ones among them, artists with a required tag.
MIN_POOL, MIN_HEARD, MIN_TAGGED = 150, 0.20, 0.30


@query("pool_gates", f"""WITH p AS (SELECT track_id, genres, is_kid, is_class, n.item IS NOT NULL AS heard FROM track JOIN artist USING (artist_id) LEFT JOIN (SELECT DISTINCT item FROM play WHERE kind = 'play') n ON n.item = track_id
  WHERE NOT is_video AND NOT is_female AND duration_sec >= 30 AND NOT contains(lower(title), 'capella')),
g AS (SELECT unnest(genres) AS station, 'genre' AS kind, heard, 1.0 AS share FROM p UNION ALL SELECT 'kid', 'tag', heard, (SELECT avg(CAST(is_kid AS INT)) FROM artist) FROM p WHERE is_kid UNION ALL SELECT 'class', 'tag', heard, (SELECT avg(CAST(is_class AS INT)) FROM artist) FROM p WHERE is_class)
SELECT station, kind, count(*) AS pool, count(*) FILTER (heard) AS listened, CASE WHEN kind = 'tag' THEN max(share) >= {MIN_TAGGED} ELSE count(*) >= {MIN_POOL} AND count(*) FILTER (heard) >= {MIN_HEARD} * count(*) END AS on_air FROM g GROUP BY 1, 2""")
def pool_gates(spark, d):
    """What of each genre's or tag's tracks a station may play, and whether that is enough to go on air.

    The pool: songs of at least 30 s, without an upper bound, of artists that the strictest filter keeps, no voices-only recording. A genre
    needs MIN_POOL tracks of which MIN_HEARD were heard; a tag needs MIN_TAGGED of the artists to carry it.
    """
    heard = t.plays(spark, d).filter("kind = 'play'").select(F.col("item").alias("track_id"), F.lit(True).alias("heard")).distinct()
    artists = t.artists(spark, d)
    tracks = t.tracks(spark, d).filter("NOT is_video AND duration_sec >= 30").filter(~tx.voices_only(F.col("title")))
    pool = tracks.join(artists.filter("NOT is_female").select("artist_id", "is_kid", "is_class"), "artist_id").join(heard, "track_id", "left")
    tag = lambda name, column: F.when(F.col(column), F.struct(F.lit(name).alias("station"), F.lit("tag").alias("kind")))
    stations = F.concat(F.transform("genres", lambda g: F.struct(g.alias("station"), F.lit("genre").alias("kind"))), F.array_compact(F.array(tag("kid", "is_kid"), tag("class", "is_class"))))
    sums = pool.select(F.explode(stations).alias("s"), "heard").groupBy("s.station", "s.kind").agg(F.count("*").alias("pool"), F.count("heard").alias("listened"))
    shares = artists.agg(F.avg(F.col("is_kid").cast("int")).alias("kid"), F.avg(F.col("is_class").cast("int")).alias("class"))  # one row
    tagged = F.when(F.col("station") == "kid", F.col("kid")).otherwise(F.col("class")) >= MIN_TAGGED
    on_air = F.when(F.col("kind") == "tag", tagged).otherwise((F.col("pool") >= MIN_POOL) & (F.col("listened") >= MIN_HEARD * F.col("pool")))
    return sums.crossJoin(F.broadcast(shares)).select("station", "kind", "pool", "listened", on_air.alias("on_air"))


@query("podcast_gates", "SELECT DISTINCT conv_id AS show_id FROM conversations WHERE conv_id % 4 <> 1 AND conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def podcast_gates(spark, d):
    """Shows of approved channels without blocked ones."""
    shows = t.load(spark, d, "conversations").select(F.col("conv_id").alias("show_id")).filter("show_id % 4 <> 1").distinct()
    return shows.join(t.load(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("show_id")), "show_id", "left_anti")


@query("quality_gate", "SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 AND d.n_chars >= 500")
def quality_gate(spark, d):
    good = t.load(spark, d, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return t.load(spark, d, "documents").filter("n_chars >= 500").select("doc_id", "lang", "n_chars").join(good, "doc_id")


@query("quiet_windows", "SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT TIMESTAMP '2024-01-05 15:00:00' + i * INTERVAL 7 DAY AS a, TIMESTAMP '2024-01-06 17:00:00' + i * INTERVAL 7 DAY AS z FROM range(4) r(i)) w WHERE e.ts >= w.a AND e.ts < w.z)")
def quiet_windows(spark, d):
    """Events in half-open weekly windows: a day-bucketed equi join, not a nested loop."""
    week = spark.range(4).select(F.expr("timestamp'2024-01-05 15:00:00' + make_interval(0, 0, 0, cast(id * 7 as int))").alias("a"), F.expr("timestamp'2024-01-06 17:00:00' + make_interval(0, 0, 0, cast(id * 7 as int))").alias("z"))
    days = week.withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("z"))))
    events = t.load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t")).withColumn("day", F.to_date("t"))
    return events.join(F.broadcast(days), "day").filter((F.col("t") >= F.col("a")) & (F.col("t") < F.col("z"))).select("event_id").distinct()
