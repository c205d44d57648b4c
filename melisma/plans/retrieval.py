"""Text functions and the retrieval engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from melisma.functions import hashing as h
from melisma.functions import text as tx
from melisma.operators import impact
from melisma.operators import search as s
from melisma.operators.ranking import keep_first
from melisma.registry import query
from melisma.sources import tables as t

_PLAIN = "list_filter(string_split(regexp_replace(regexp_replace(lower(strip_accents({c})), '[''’‘`´\"׳״]', '', 'g'), '[^a-z0-9֐-׿]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _skeleton(w: str) -> str:
    out = w
    for pattern, to in tx.FOLDS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return out


@query("tokens_plain", f"SELECT doc_id, {_PLAIN.format(c='text')} AS tokens FROM documents")
def tokens_plain(spark, d):
    return t.load(spark, d, "documents").select("doc_id", tx.plain_tokens(F.col("text")).alias("tokens"))


@query("skeletons", f"SELECT p_partkey AS track_id, list_filter(list_transform({_PLAIN.format(c='p_name')}, lambda w: {_skeleton('w')}), lambda w: length(w) >= 2) AS skel FROM part")
def skeletons(spark, d):
    return t.load(spark, d, "part").select(F.col("p_partkey").alias("track_id"), tx.skeleton_tokens(tx.plain_tokens(F.col("p_name"))).alias("skel"))


@query("bigrams", "SELECT DISTINCT p_name AS title, list_concat(list_concat(['^' || p_name[1]], list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2))), [p_name[-1] || '$']) AS grams FROM part")
def bigrams(spark, d):
    return t.load(spark, d, "part").select(F.col("p_name").alias("title")).distinct().select("title", tx.bigrams(F.col("title")).alias("grams"))


@query("one_edit", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT unnest(string_split(replace(replace(p_name, 'ed', 'de'), 'ol', 'l'), ' ')) FROM part) SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND damerau_levenshtein(a.w, b.w) <= 1")
def one_edit(spark, d):
    """Word pairs at one edit: candidates share a padded bigram, as any such pair of words does from two letters on."""
    part = t.load(spark, d, "part")
    words = lambda c: part.select(F.explode(F.split(c, " ")).alias("w"))
    w = words(F.col("p_name")).union(words(F.replace(F.replace("p_name", F.lit("ed"), F.lit("de")), F.lit("ol"), F.lit("l")))).distinct()
    g = w.select("w", F.explode(tx.bigrams(F.col("w"))).alias("g"))
    near = g.withColumnRenamed("w", "a").join(g.withColumnRenamed("w", "b"), "g").filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)).select("a", "b").distinct()
    return near.filter(tx.one_edit(F.col("a"), F.col("b")))


#: Endings of titles by a track's number: what they add to the mark and to the rest of the key.
_ENDINGS = (("", "", ""), (" (Live)", "2", " live"), (" A-Capella!", "0", " a capella"), (" accapella", "0", " accapella"), (" - vocal", "0", " vocal"), (" vocalist", "", " vocalist"), (" karaoke", "", " karaoke"), (" Cover & Remix", "34", " cover remix"), (" instrumental", "1", " instrumental"), (" mashup", "", " mashup"), (" (בהופעה)", "2", " בהופעה"), (" don't", "", " dont"))
_ENDING = lambda k: "[" + ", ".join("'" + e[k].replace("'", "''") + "'" for e in _ENDINGS) + f"][track_id % {len(_ENDINGS)} + 1]"


@query("dup_key", f"WITH k AS (SELECT track_id, artist_id || '||' || {_ENDING(1)} || '|' || lower(title) || {_ENDING(2)} AS key, duration_sec FROM track), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY duration_sec DESC, track_id) AS rn FROM k) SELECT track_id, key FROM r WHERE rn = 1")
def dup_key(spark, d):
    """Near-duplicate recordings: of each key the longest stays. Titles end in marks of variants, real and apparent ones."""
    ending = F.element_at(F.array(*(F.lit(e[0]) for e in _ENDINGS)), (F.col("track_id") % len(_ENDINGS) + 1).cast("int"))
    keyed = t.tracks(spark, d).withColumn("key", tx.duplicate_key(F.concat("title", ending), F.col("artist_id").cast("string"), F.lit("")))
    return keep_first(keyed, ["key"], [F.desc("duration_sec"), F.asc("track_id")]).select("track_id", "key")


@query("credits", "SELECT p_partkey AS track_id, list_sort(list_distinct([split_part(p_name, ' ', 1), p_brand])) AS guests FROM part")
def credits(spark, d):
    """Guests named in a title, here two composed of the row's own words, in each place where a title can name them."""
    names = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" & "), F.col("p_brand"))
    forms = ((" (feat. ", ")"), (" (Live feat. ", ")"), (" [Remix] {duet with ", "} [Bonus]"), (" ft. ", " (Live)"), (" (Acoustic, with ", ")"))
    title = F.concat("p_name", F.element_at(F.array(*(F.concat(F.lit(a), names, F.lit(b)) for a, b in forms)), (F.col("p_partkey") % len(forms) + 1).cast("int")))
    return t.load(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.array_sort(tx.credits(title)).alias("guests"))


def _finalised(x: str) -> str:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = f"CAST((CAST(xor({x}, ({x}) >> {shift}) AS HUGEINT) * {factor}) % 4294967296 AS BIGINT)"
    return f"xor({x}, ({x}) >> 16)"


_ID_HASH = "CAST(list_reduce(list_prepend(CAST({seed} AS BIGINT), list_transform(string_split(id, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) & 4294967295) AS BIGINT)"


@query("hash_fnv", f"WITH i AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part), h AS (SELECT id, {_ID_HASH.format(seed=2166136261)} AS fnv, {_ID_HASH.format(seed=2166136261 ^ 7)} AS seeded FROM i) SELECT id, fnv, {_finalised('fnv')} AS final, (seeded >> 8) / 16777216.0 AS unit, (fnv * 1664525 + 1013904223) & 4294967295 AS next FROM h")
def hash_fnv(spark, d):
    ids = t.load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return ids.select("id", h.fnv1a(F.col("id")).alias("fnv"), h.finalise(h.fnv1a(F.col("id"))).alias("final"), h.unit(F.col("id"), 7).alias("unit"), h.lcg(h.fnv1a(F.col("id"))).alias("next"))


@query("hash_bucket", "SELECT s_name AS id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(s_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) AS BIGINT) AS h31 FROM supplier")
def hash_bucket(spark, d):
    return t.load(spark, d, "supplier").select(F.col("s_name").alias("id"), h.times31(F.col("s_name")).alias("h31"))


@query("idf", "WITH tok AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT token, count(*) AS df, round(ln(1 + (SELECT count(*) FROM part) / count(*)), 6) AS idf FROM tok GROUP BY 1")
def idf(spark, d):
    part = t.load(spark, d, "part")
    df = part.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(part.agg(F.count("*").alias("n")))).select("token", "df", F.round(F.log1p(F.col("n") / F.col("df")), 6).alias("idf"))


@query("prefix_match", "WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), q AS (SELECT unnest(['re', 'bl', 'wid', 'bo', 'gre']) AS qt) SELECT qt, token FROM q JOIN v ON starts_with(token, qt)")
def prefix_match(spark, d):
    v = t.load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct().withColumn("head", F.substring("token", 1, 2))
    q = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("re", "bl", "wid", "bo", "gre")))).alias("qt")).withColumn("head", F.substring("qt", 1, 2))
    return v.join(F.broadcast(q), "head").filter(F.col("token").startswith(F.col("qt"))).select("qt", "token")


@query("like_baseline", "SELECT p_partkey AS track_id, p_name AS title FROM part WHERE contains(lower(p_name), 'ed w') ORDER BY p_partkey LIMIT 5")
def like_baseline(spark, d):
    return t.load(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("ed w"))).select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title")).orderBy("track_id").limit(5)


#: Batch of queries: complete, being typed, misspelled, finished by a space, and one that finds an artist.
QUERIES = ((1, "red widget"), (2, "blu"), (3, "smal bolt"), (4, "green "), (5, "supplier 000000007"), (6, "widgte"), (7, "zzzz"))


def _docs(spark, d):
    found = t.tracks(spark, d).join(t.artists(spark, d).select("artist_id", "artist_name"), "artist_id")
    return found.select(F.when(F.col("is_video"), "videos").otherwise("songs").alias("category"), F.col("track_id").alias("doc_id"), "title", F.col("artist_name").alias("artist"))


def _queries(spark):
    return spark.createDataFrame(list(QUERIES), "qid long, text string")


def _asked(queries) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in queries) + ") x(qid, text)"


def _search_sql(k: int) -> str:
    return _search_ctes(_asked(QUERIES)) + f"""
SELECT CAST(qid AS BIGINT) AS qid, category, doc_id, round(score, 6) AS score, CAST(cov AS BIGINT) AS coverage, rank FROM rk WHERE score >= 0.4 * best AND rank <= {k}"""


def _search_ctes(asked: str, docs: str = "track JOIN artist USING (artist_id)", alt: str = "NULL", more: str = "") -> str:
    """The engine up to ranks, for queries (qid, text), docs of a condition, other names, and further tokens (qid, field, qt, bit, last)."""
    tokens = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    key = lambda c: f"array_to_string(list_transform({tokens.format(c=c)}, lambda w: CASE WHEN length({_skeleton('w')}) >= 2 THEN {_skeleton('w')} ELSE w END), ' ')"
    return f"""
WITH doc AS (SELECT CASE WHEN is_video THEN 'videos' ELSE 'songs' END AS category, track_id AS doc_id, title, artist_name, array_to_string({tokens.format(c='title')}, ' ') AS title_p, {key('title')} AS title_s,
  array_to_string({tokens.format(c='artist_name')}, ' ') AS artist_p, {key('artist_name')} AS artist_s, {alt} AS alt_title FROM {docs}),
pl AS (SELECT category, doc_id, 1 AS mask, unnest({tokens.format(c='title')}) AS token, true AS main FROM doc UNION ALL SELECT category, doc_id, 2, unnest({tokens.format(c='artist_name')}), true FROM doc
  UNION ALL SELECT category, doc_id, 1, unnest({tokens.format(c="coalesce(CAST(alt_title AS VARCHAR), '')")}), false FROM doc),
po AS (SELECT category, 'plain' AS field, token, doc_id, bit_or(mask) AS mask, bool_or(main) AS main FROM pl GROUP BY category, token, doc_id
  UNION ALL SELECT category, 'skel', {_skeleton('token')} AS token, doc_id, bit_or(mask), bool_or(main) FROM pl WHERE length({_skeleton('token')}) >= 2 GROUP BY category, 3, doc_id),
n AS (SELECT category, count(*) AS n FROM doc GROUP BY 1),
v AS (SELECT category, field, token, ln(1 + any_value(n) / count(*)) AS idf, bool_or(main) AS fuzzy FROM po JOIN n USING (category) GROUP BY 1, 2, 3),
q0 AS ({asked}),
q1 AS (SELECT qid, text, list_distinct({tokens.format(c='text')}) AS u, {tokens.format(c='text')} AS p FROM q0),
q2 AS (SELECT qid, text, p, list_filter(list_transform(p, lambda w: {_skeleton('w')}), lambda w: length(w) >= 2) AS s FROM q1),
q AS (SELECT qid, p, s, greatest(len(p), len(s)) AS orig, text NOT LIKE '% ' AS typing, array_to_string(p, ' ') AS key_p, {key('text')} AS key_s FROM q2),
qt AS (SELECT qid, 'plain' AS field, unnest(p) AS qt, generate_subscripts(p, 1) - 1 AS i, typing, len(p) AS m FROM q UNION ALL SELECT qid, 'skel', unnest(s), generate_subscripts(s, 1) - 1, typing, len(s) FROM q),
tk AS (SELECT qid, field, qt, CAST(1 << CAST(i AS INT) AS BIGINT) AS bit, typing AND i = m - 1 AS last FROM qt WHERE field = 'plain' OR length(qt) >= 3{more}),
mt AS (SELECT qid, category, v.field, bit, token, CASE WHEN v.field = 'plain' THEN 10 ELSE 8 END * idf AS w, true AS strong FROM tk JOIN v ON v.field = tk.field AND token = qt
  UNION ALL SELECT qid, category, v.field, bit, token, CASE WHEN v.field = 'plain' THEN 9 ELSE 7 END * idf, true FROM tk JOIN v ON v.field = tk.field AND starts_with(token, qt) AND token <> qt WHERE last AND length(qt) >= 2
  UNION ALL SELECT qid, category, 'plain', bit, token, 5 * idf, false FROM tk JOIN v ON v.field = 'plain' AND v.fuzzy AND token <> qt AND length(token) >= 3 AND damerau_levenshtein(token, qt) <= 1 WHERE tk.field = 'plain' AND length(qt) >= 3),
pt AS (SELECT qid, category, doc_id, field, bit, max(w) AS w, max(CASE WHEN strong AND mask >= 2 THEN 1 ELSE 0 END) AS art FROM mt JOIN po USING (category, field, token) GROUP BY 1, 2, 3, 4, 5),
pd AS (SELECT qid, category, doc_id, sum(w) AS w, greatest(count(*) FILTER (field = 'plain'), count(*) FILTER (field = 'skel')) AS cov, greatest(count(*) FILTER (field = 'plain' AND art = 1), count(*) FILTER (field = 'skel' AND art = 1)) AS acov FROM pt GROUP BY 1, 2, 3),
sc AS (SELECT qid, category, doc_id, title, cov, (w + 8 * cov + CASE WHEN orig >= 2 THEN 25 * acov ELSE 0 END) * (1 + CASE WHEN cov >= orig THEN 0.4 ELSE 0 END
  + CASE WHEN artist_p = key_p OR (length(key_s) >= 3 AND artist_s = key_s) THEN 2.5 WHEN starts_with(artist_p, key_p) OR (length(key_s) >= 3 AND starts_with(artist_s, key_s)) THEN 1.6 WHEN acov >= orig THEN 0.8 ELSE 0 END
  + CASE WHEN title_p = key_p OR (length(key_s) >= 3 AND title_s = key_s) THEN 2.0 WHEN starts_with(title_p, key_p) OR (length(key_s) >= 3 AND starts_with(title_s, key_s)) THEN 1.4 ELSE 0 END) AS score
  FROM pd JOIN q USING (qid) JOIN doc USING (category, doc_id) WHERE cov >= greatest(1, ceil(orig / 2))),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, category ORDER BY round(score, 9) DESC, length(title), doc_id) AS rank, max(score) OVER (PARTITION BY qid, category) AS best FROM sc)"""


@query("search_score", _search_sql(10))
def search_score(spark, d):
    """The whole retrieval engine over two categories and a batch of queries."""
    return impact.search(impact.build(_docs(spark, d)), s.query_tokens(_queries(spark)), 10)


@query("search_grouped", f"WITH hit AS ({_search_sql(40).strip()}), ok AS (SELECT h.*, row_number() OVER (PARTITION BY qid, category ORDER BY rank) AS place FROM hit h JOIN track ON track_id = doc_id JOIN artist USING (artist_id) WHERE NOT is_female) SELECT qid, category, doc_id, place FROM ok WHERE place <= 10".replace("WITH hit AS (WITH", "WITH hit AS (WITH"))
def search_grouped(spark, d):
    """Four times as many results are fetched, filtered, and then cut: the filter must not move below the first cut."""
    from melisma.operators.ranking import ranked_within

    found = impact.search(impact.build(_docs(spark, d)), s.query_tokens(_queries(spark)), 40)
    owners = t.tracks(spark, d).join(t.artists(spark, d), "artist_id").filter("NOT is_female").select(F.col("track_id").alias("doc_id"))
    kept = ranked_within(found.join(owners, "doc_id", "left_semi"), ["qid", "category"], [F.col("rank")], "place")
    return kept.filter("place <= 10").select("qid", "category", "doc_id", "place")


@query("search_batch", None)
def search_batch(spark, d):
    """A batch over the whole texts of all documents by language: the second and third word of every hundredth document, both finished."""
    docs = t.load(spark, d, "documents").select(F.col("lang").alias("category"), "doc_id", F.col("text").alias("title"), F.col("source").alias("artist"))
    asked = t.load(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.concat(F.array_join(F.slice(F.split("text", r"\s+", 5), 2, 2), " "), F.lit(" ")).alias("text"))
    return impact.search(impact.build(docs), s.query_tokens(asked), 10)


#: Synonyms, and what they add to the tokens of the queries below.
SYNONYMS = [["gadget", "widget"], ["tiny", "small"]]
NAMED = ((8, "gadget "), (9, "gizmo"), (10, "gizmp "), (11, "tiny bolt"))
_ADDED = "".join(f" UNION ALL SELECT {i}, '{f}', '{w}', CAST({b} AS BIGINT), false" for i, f, w, b in ((8, "plain", "widget", 2), (8, "skel", "dgt", 2), (11, "plain", "small", 4), (11, "skel", "smll", 4)))


@query("search_names", _search_ctes(_asked(NAMED), alt="CASE WHEN track_id % 50 = 0 THEN 'Gizmo' END", more=_ADDED) + " SELECT CAST(qid AS BIGINT) AS qid, category, doc_id, round(score, 6) AS score, CAST(cov AS BIGINT) AS coverage, rank FROM rk WHERE score >= 0.4 * best AND rank <= 10")
def search_names(spark, d):
    """Other names of a title are found, though never by a typo, and synonyms bring in each other's tokens."""
    docs = _docs(spark, d).withColumn("alt_title", F.when(F.col("doc_id") % 50 == 0, "Gizmo"))
    asked = spark.createDataFrame(list(NAMED), "qid long, text string")
    return impact.search(impact.build(docs), s.query_tokens(asked, SYNONYMS), 10)


_TITLES = _search_ctes("SELECT CAST(row_number() OVER (ORDER BY title) AS BIGINT) AS qid, title AS text FROM (SELECT DISTINCT title FROM track WHERE NOT is_video)", "track JOIN artist USING (artist_id) WHERE NOT is_video")


@query("relevance_metrics", _TITLES + """, tr AS (SELECT q0.qid, doc.doc_id FROM q0 JOIN doc ON doc.title = q0.text), hit AS (SELECT qid, doc_id, rank FROM rk WHERE score >= 0.4 * best AND rank <= 5),
b AS (SELECT tr.qid, min(rank) AS r FROM tr LEFT JOIN hit USING (qid, doc_id) GROUP BY 1)
SELECT avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) AS p_at_1, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END) AS p_at_3, avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(coalesce(1 / r, 0.0)) AS mrr, count(*) AS n FROM b""")
def relevance_metrics(spark, d):
    """Each distinct title asked for in full: how often a track of that title comes first."""
    docs = _docs(spark, d).filter("category = 'songs'")
    truth = docs.select(F.xxhash64("title").alias("qid"), "doc_id", "title")
    found = impact.search(impact.build(docs), s.query_tokens(truth.select("qid", F.col("title").alias("text")).distinct()), 5)
    return s.metrics(found, truth.select("qid", "doc_id"))


@query("female_involved", "SELECT p_partkey AS track_id FROM part WHERE p_brand IN (SELECT 'Brand#' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)")
def female_involved(spark, d):
    """Titles that credit a listed artist: credits exploded, one equi join on the normalised name."""
    listed = t.artists(spark, d).filter("is_female").select(F.array_join(tx.tokens_of_plain(F.concat(F.lit("Brand#"), F.col("artist_id"))), " ").alias("name"))
    title = F.concat(F.col("p_name"), F.lit(" feat. "), F.col("p_brand"))
    named = t.load(spark, d, "part").select(F.col("p_partkey").alias("track_id"), F.explode(tx.credits(title)).alias("guest"))
    return named.withColumn("name", F.array_join(tx.plain_tokens(F.col("guest")), " ")).join(listed, "name", "left_semi").select("track_id").distinct()
