"""What plans must not do, as it shows in tables of some GB only."""

import pytest
from pyspark.sql import functions as F

from melisma.functions import parse
from melisma.plans import pages

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["playlist_page", "items_page"])
def test_a_page_is_parsed_once(spark, name):
    plan = getattr(pages, name)(spark, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1


def test_hours_that_no_number_holds(spark):
    rows = spark.createDataFrame([("1:02:03",), ("2:03",), ("9" * 24 + ":10:11",)], "t string").select(parse.duration_sec(F.col("t"))).collect()
    assert [r[0] for r in rows] == [3723, 123, None]


def test_best_is_the_head_of_scores(spark):
    """Stations that share an artist's list, with neighbours in and beside it, tracks already placed, equal scores and a short limit."""
    from melisma.operators import recommend as r

    tracks = spark.createDataFrame([(i, i % 3, (i * 7) % 5, 1.0 - (i % 4) / 10) for i in range(90)], "item long, artist_id long, reach long, multiplier double")
    edges = [("sess", 0, 3, 0.5), ("sess", 0, 4, 0.25), ("lib", 0, 3, 0.1), ("lib", 3, 6, 0.9), ("lib", 1, 0, 0.4), ("art", 0, 1, 0.7), ("art", 0, 2, 0.2), ("art", 1, 0, 0.3)]
    edges = spark.createDataFrame(edges, "kind string, src long, dst long, score double")
    seeds = spark.createDataFrame([(100, 0, 0), (100, 3, 0), (101, 1, 1), (102, 2, 2), (103, 0, 0)], "station long, item long, artist_id long")
    owners = spark.createDataFrame([(100, 0), (101, 1), (102, 2)], "station long, artist_id long")
    placed = spark.createDataFrame([(100, i) for i in range(0, 60, 3)] + [(101, 1), (102, 77)], "station long, item long")
    whole = r.scores(seeds, edges, tracks, owners=owners, placed=placed).withColumn("score", F.round("score", 6)).collect()
    for n in (4, 25):
        want = {(s, *row) for s in (100, 101, 102, 103) for row in ((x["item"], x["score"], i + 1) for i, x in enumerate(sorted((x for x in whole if x["station"] == s), key=lambda x: (-x["score"], x["item"]))[:n]))}
        assert {tuple(x) for x in r.best(seeds, edges, tracks, owners, placed, n).select("station", "item", "score", "place").collect()} == want


def test_pairs_of_a_device_add_up_before_the_exchange(spark):
    from melisma.operators import telemetry

    held = spark.createDataFrame([(d, i) for d in range(3) for i in range(4)], "device long, item long")
    plan = telemetry.cooccurrence(held, ["device"])._jdf.queryExecution().optimizedPlan().toString()
    assert "devices" not in plan and "count(distinct" not in plan


def test_tokens_need_no_python(spark):
    """Every character between two letters and alone, against Python's normaliser; and no text leaves the JVM."""
    from melisma.functions import text as tx

    every = [(i, f"a{chr(i)}b {chr(i)}") for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    wanted = {i: tx.strip_marks(t) for i, t in every}
    rows = spark.createDataFrame([(i, t, wanted[i]) for i, t in every], "i long, t string, w string")
    found = rows.select("i", tx.plain_tokens(F.col("t")).alias("a"), tx.tokens_of_plain(F.col("w")).alias("b"))
    assert found.filter("a <> b").count() == 0
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_skeletons_of_a_line_are_those_of_its_words(spark):
    """Pairs, folds that meet only over a space, words without a skeleton; and the index of long texts makes no skeleton word by word."""
    from melisma.functions import text as tx

    rows = [(0, []), (1, ["a"]), (2, ["cats", "hat", "t", "zoo", "s", "h", "xkhqu", "whyaeiou", "tsh", "thsch"]), (3, ["שלום", "אבג", "eye", "tzץx", "12v"])]
    got = spark.createDataFrame(rows, "i long, w array<string>").select(tx.skeletons_in_line(F.col("w")).alias("a"), F.transform("w", tx.skeleton).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and [len(r["a"]) for r in got] == [len(w) for _, w in rows]


def test_of_long_texts_only_asked_terms_become_rows(spark, monkeypatch, tmp_path):
    """The same scores whether the asked tokens go to the documents as an array or not, and fewer rows where they do."""
    from melisma.operators import impact, search

    docs = spark.range(60).select(F.lit("en").alias("category"), F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") + 1)) % 997)), " ").alias("title"), F.lit("red").alias("artist"))
    index = impact.save(docs, str(tmp_path / "index"))
    tokens = search.query_tokens(spark.createDataFrame([(1, "w7 w12 "), (2, "w1"), (3, "red w600 ")], "qid long, text string"))
    lists = impact.matches(index, tokens)
    whole = tokens.select("qid", "orig", "need", "key_p", "key_s").distinct()
    found = index.docs.select("category", "doc_id").crossJoin(spark.range(1, 4).select(F.col("id").alias("qid")))
    got = {}
    for most in (impact.ASKED, 0):
        monkeypatch.setattr(impact, "ASKED", most)
        got[most] = sorted(map(tuple, impact.scores(index, lists, whole, found).withColumn("score", F.round("score", 6)).collect()))
    assert len(got[0]) > 20 and got[0] == got[1 << 12]


def test_pairs_of_albums_and_playlists_travel_as_lists(spark):
    """The exchange by playlist carries a row for each track of a playlist and range of albums, and pairs are counted behind it."""
    from melisma.plans import catalog

    plan = catalog.playlist_albums_kept(spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "explode(lows" in plan and "hashpartitioning(playlist_id" in plan.split("explode(lows")[1]
    assert "hashpartitioning" not in plan.split("explode(lows")[0]


def test_documents_that_tie_are_not_all_scored(spark, monkeypatch, tmp_path):
    """Of 500 documents with both words, all of one score, no more than the likeliest are scored in full; and typos need no grams."""
    from melisma.operators import impact, search

    titles = [(i, " ".join((f"t{i}", *["red"] * (i % 2), *["blue"] * (i % 3 == 0), *["pad"] * (i % 7)))) for i in range(3000)]
    docs = spark.createDataFrame([("songs", i, title, "") for i, title in titles], "category string, doc_id long, title string, artist string")
    seen, scores = [], impact.scores
    monkeypatch.setattr(impact, "scores", lambda index, lists, whole, found: seen.append(found.count()) or scores(index, lists, whole, found))
    got = impact.search(impact.save(docs, str(tmp_path / "index")), search.query_tokens(spark.createDataFrame([(1, "red blue ")], "qid long, text string")), 10)
    both = sorted((len(title), i) for i, title in titles if "red" in title and "blue" in title)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == [i for _, i in both[:10]] and len(both) == 500
    assert sum(seen) <= 2 * impact.EARLY * 10
    words = spark.createDataFrame([("abcd",), ("abdc",), ("abc",), ("xbcd",), ("abcde",), ("wxyz",)], "w string").withColumn("h", impact.less_a_letter(F.col("w")))
    assert [r["w"] for r in words.filter(F.arrays_overlap("h", impact.less_a_letter(F.lit("abcd")))).orderBy("w").collect()] == ["abc", "abcd", "abcde", "abdc", "xbcd"]


def test_artists_tracks_are_scored_once_for_all_stations(spark):
    """No exchange by station and item: what an artist gives is scored before stations meet it."""
    from melisma.operators import recommend as r

    tracks = spark.createDataFrame([(i, i % 3, i % 5, 1.0) for i in range(30)], "item long, artist_id long, reach long, multiplier double")
    edges = spark.createDataFrame([("lib", 0, 3, 0.5), ("lib", 0, 4, 0.5), ("art", 0, 1, 0.7)], "kind string, src long, dst long, score double")
    seeds = tracks.select(F.col("item").alias("station"), "item", "artist_id")
    found = r.scores(seeds, edges, tracks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(apart" in plan and plan.split("Union")[1].split("array_contains(apart")[0].count("Aggregate") == 0
    rows = found.collect()
    assert len({(x["station"], x["item"]) for x in rows}) == len(rows) and all(x["station"] != x["item"] for x in rows)


def test_albums_of_a_large_catalog_travel_in_one_list(spark, tmp_path):
    """A track in albums far apart, as in 54 million orders and beyond: one range of numbers, and the same pairs beyond a range too."""
    from melisma.plans import catalog

    orders = [5, 1 << 23, (1 << 25) + 1, (1 << 31) - 1, (1 << 31) + 7, (1 << 33) + 5]
    assert len({o >> catalog.ALBUM_BITS for o in orders[:4]}) == 1
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table([(p,) for p in (1, 2, 3, 7)], "p_partkey long", "part")
    table([(o, 10 + i % 2) for i, o in enumerate(orders)], "o_orderkey long, o_custkey long", "orders")
    table([(o, p, 1, n) for o in orders for n, p in enumerate((1, 2, 7))] + [(5, 3, 1, 4)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", "lineitem")
    got = {tuple(r) for r in catalog.playlist_albums_kept(spark, str(tmp_path)).collect()}
    assert got == {(c, o, 3 if (c, o) == (10, 5) else 2) for c in (10, 11) for o in orders}
