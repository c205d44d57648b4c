"""Literal cases of behaviour that is easy to miss, and invariants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from melisma.functions import calendar, hashing, parse
from melisma.functions import text as tx
from melisma.operators import impact, merge, policy, recommend, search, telemetry
from melisma.operators.ranking import cap_per_group, keep_first, page, top_ranked


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_hash_constants(spark):
    assert one(spark, "abc", hashing.fnv1a) == 440920331
    assert one(spark, "abc", hashing.times31) == 96354
    assert 0 <= one(spark, "abc", hashing.unit) < 1


def test_tokens_join_marks_and_scripts(spark):
    assert one(spark, "Rock'n'Roll  Café—live!", tx.plain_tokens) == ["rocknroll", "cafe", "live"]
    assert one(spark, "דודי פולק", lambda c: tx.skeleton_key(tx.plain_tokens(c))) == "dd plk"
    assert one(spark, "Dudi Polak", lambda c: tx.skeleton_key(tx.plain_tokens(c))) == "dd plk"
    assert one(spark, None, tx.plain_tokens) == []


def test_bigrams(spark):
    assert one(spark, "abc", tx.bigrams) == ["^a", "ab", "bc", "c$"]
    assert one(spark, "a", tx.bigrams) == ["^a", "a$"]
    assert one(spark, "", tx.bigrams) == []


@pytest.mark.parametrize("a, b, near", [("abcd", "abdc", True), ("abcd", "abcd", True), ("abcd", "abc", True), ("abcd", "badc", False), ("ab", "ba", True), ("abc", "cab", False)])
def test_one_edit(spark, a, b, near):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(tx.one_edit(F.col("a"), F.col("b"))).first()[0] is near


def test_credits(spark):
    assert one(spark, "Song (feat. A & B) with C", tx.credits) == ["A", "B"]
    assert one(spark, "Song feat. A and B", tx.credits) == ["A", "B"]
    assert one(spark, "Song [with D]", tx.credits) == ["D"]
    assert one(spark, "Plain song", tx.credits) == []


def test_duplicate_key_tells_variants_apart(spark):
    key = lambda title: one(spark, title, lambda c: tx.duplicate_key(c, F.lit("a"), F.lit("")))
    assert key("My  Song!") == key("my song")
    assert key("My Song (Live)") != key("My Song")
    assert key("Olive Song") == "a|||olive song"


def test_synonyms_cascade():
    plain, skel = tx.expand(["rebbe"], ["rb"], [["rebbe", "rabbi"], ["rabbi", "rav"], ["single"]])
    assert plain == ["rebbe", "rabbi", "rav"] and "rb" in skel


@pytest.mark.parametrize("text, sec", [("3:45", 225), ("1:02:03", 3723), ("x", None), ("", None), (None, None), ("3:4", None)])
def test_duration(spark, text, sec):
    assert one(spark, text, parse.duration_sec) == sec


@pytest.mark.parametrize("text, n", [("1.2M plays", 1_200_000), ("12,345 views", 12345), ("7K plays", 7000), ("7K", None), ("2024, 3 songs", None), ("1 view", 1), ("3 viewers", None), ("no", None), (None, None)])
def test_count(spark, text, n):
    assert one(spark, text, parse.count) == n


DOCS = [("songs", 1, "hello world", "anna bell"), ("songs", 2, "say hello", "carl"), ("songs", 3, "world tour", "hello band"), ("songs", 4, "שלום עולם", "דודי פולק"), ("songs", 5, "elimelech", "zed")]


def results(spark, text, docs=DOCS, **more):
    index = search.build(spark.createDataFrame(docs, "category string, doc_id long, title string, artist string"))
    tokens = search.query_tokens(spark.createDataFrame([(1, text)], "qid long, text string"), **more)
    return [r["doc_id"] for r in search.search(index, tokens).orderBy("rank").collect()]


def test_search_exact_title_first(spark):
    assert results(spark, "hello world")[0] == 1


def test_search_begins_before_contains(spark):
    docs = [("songs", 1, "big hello", "x"), ("songs", 2, "hello big", "y")]
    assert results(spark, "hello ", docs) == [2, 1]


def test_search_typo_and_cross_script(spark):
    assert set(results(spark, "helo world")[:2]) == {1, 3}
    assert results(spark, "dudi polak")[0] == 4


def test_search_trailing_space_finishes_the_word(spark):
    assert 5 in results(spark, "elim")
    assert results(spark, "elim ") == []


def test_search_nothing_and_empty(spark):
    assert results(spark, "zzzzqq") == []
    assert results(spark, "") == []
    assert results(spark, None) == []


def test_flags_default_open_and_exact_conjunction(spark):
    row = spark.createDataFrame([(None, None, None)], "f boolean, k boolean, v boolean")
    check = lambda flags: row.select(policy.allowed(flags, F.col("f"), F.col("k"), F.col("v"))).first()[0]
    assert check(policy.Flags()) and check(policy.Flags(allow_female=False)) and not check(policy.Flags(kid_only=True))
    assert policy.allowed_classes(policy.Flags(False, True, True)) == 0b10


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5, None), (2, "b", None, 3)], "id long, title string, dur int, plays int")
    new = spark.createDataFrame([(1, "A", None, 0), (3, "c", 7, 9)], "id long, title string, dur int, plays int")
    rules = {"title": "overwrite", "dur": "prefer_new", "plays": "positive_max"}
    once = merge.upsert(old, new, ["id"], rules)
    twice = merge.upsert(once, new, ["id"], rules)
    want = [(1, "A", 5, None), (2, "b", None, 3), (3, "c", 7, 9)]
    assert [tuple(r) for r in once.orderBy("id").collect()] == want == [tuple(r) for r in twice.orderBy("id").collect()]


def test_prune_plan_edges(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert merge.prune_plan(ids(), ids(1), "id", 0.9).first()["safe"]
    assert not merge.prune_plan(ids(1, 2, 3), ids(1), "id", 5.0).first()["safe"]


def test_ranking(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "x long, g string")
    assert sorted(r["x"] for r in cap_per_group(df, "g", [F.asc("x")], 1).collect()) == [1, 3, 4, 5]
    assert [r["x"] for r in keep_first(df.filter("g IS NOT NULL"), ["g"], [F.desc("x")]).orderBy("x").collect()] == [2, 5]
    assert [r["rank"] for r in top_ranked(df, [F.desc("x")], 2).orderBy("rank").collect()] == [1, 2]
    assert {r["next_offset"] for r in page(df, [F.asc("x")], 2, 2).collect()} == {4}
    assert {r["next_offset"] for r in page(df, [F.asc("x")], 3, 2).collect()} == {None}


def test_upsert_takes_one_row_of_each_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "x"), (1, "y"), (3, "p"), (3, None), (4, "q")], "id long, v string")
    blocked = spark.createDataFrame([(2,), (4,)], "id long")
    assert sorted(map(tuple, merge.upsert(old, new, ["id"], {"v": "overwrite"}).collect())) == [(1, "y"), (2, "b"), (3, "p"), (4, "q")]
    assert sorted(map(tuple, merge.upsert(old, new, ["id"], {"v": "overwrite"}, blocked).collect())) == [(1, "y"), (3, "p")]


def test_merged_batches_rewrite_only_touched_parts(spark, tmp_path):
    from melisma.streaming import telemetry as st

    sink = st.merge_batches(str(tmp_path / "s"), ["k"], {"v": "overwrite"}, parts=8)
    batch = lambda rows: spark.createDataFrame(rows, "k long, v string, ts long, event_id long")
    sink(batch([(i, "a", 1, i) for i in range(30)]), 0)
    for _ in range(2):  # delivered twice
        sink(batch([(3, "b", 2, 1), (3, "c", 3, 2), (99, "d", 2, 3)]), 1)
    assert len([p for p in (tmp_path / "s" / "batch=1").iterdir() if p.name.startswith("part=")]) <= 2
    got = {r["k"]: r["v"] for r in st.merged(spark, str(tmp_path / "s"), batch([]).select("k", "v").schema).collect()}
    assert got == {i: "a" for i in range(30)} | {3: "c", 99: "d"}


def test_diverse_order():
    items = list(range(12))
    artists = ["a"] * 6 + ["b"] * 3 + ["c"] * 3
    order = recommend.diverse(items, artists)
    assert sorted(order) == items and order == recommend.diverse(items, artists)
    by = [artists[i] for i in order]
    last = len(by) - by[::-1].index("b")
    assert all(len(set(by[i : i + 3])) > 1 for i in range(last - 2))
    assert recommend.diverse([1, 2, 3], ["a", "a", "a"]) == [1, 2, 3]


def pool(n, artists):
    return [{"item": i, "artist": i % artists, "dur": 120 + i, "weight": 1.0} for i in range(n)]


def test_schedule_invariants():
    start = 1_700_000_000_000
    entries, state = recommend.extend(pool(40, 8), {}, [], {"seed": 3}, start + 6 * 3_600_000, start)
    assert entries == recommend.extend(pool(40, 8), {}, [], {"seed": 3}, start + 6 * 3_600_000, start)[0]
    assert all(a[1] + a[2] * 1000 == b[1] for a, b in zip(entries, entries[1:]))
    assert all(e[0] % 8 not in [p[0] % 8 for p in entries[max(0, k - 3) : k]] for k, e in enumerate(entries))
    longer, _ = recommend.extend(pool(40, 8), {}, entries, state, start + 9 * 3_600_000, start)
    assert longer[: len(entries)] == entries


def test_schedule_by_hand():
    """The draws one by one, the pick by going down the weights, and neighbours that pull."""
    tracks, near = [{**x, "weight": 0.1 + x["item"] % 7} for x in pool(12, 5)], {i: {(i + 5) % 12: 0.8} for i in range(12)}
    got, _ = recommend.extend(tracks, near, [], {"seed": 9}, 3_600_000, 0)
    seed, clock, entries = 9, 0, []
    while clock < 3_600_000:
        open_ = [x for x in tracks if x["item"] not in [e[0] for e in entries[-6:]] and x["artist"] not in [e[0] % 5 for e in entries[-3:]]]
        weights = []
        for x in open_:
            seed = (seed * 1664525 + 1013904223) % 2**32
            weights.append(x["weight"] * (1 + 3.0 * (near[entries[-1][0]].get(x["item"], 0) if entries else 0)) * (1 + 0.5 * seed / 2**32))
        seed = (seed * 1664525 + 1013904223) % 2**32
        left = seed / 2**32 * sum(weights)
        for x, w in zip(open_, weights):
            left -= w
            if left <= 0:
                break
        entries.append((x["item"], clock, x["dur"]))
        clock += x["dur"] * 1000
    assert got == entries and len(got) > 20


def test_schedule_of_few_artists_ends():
    assert len(recommend.extend(pool(5, 2), {}, [], {}, 3_600_000, 0)[0]) > 10
    assert recommend.extend([], {}, [], {}, 3_600_000, 0)[0] == []


def test_hebrew_dates():
    assert calendar.hebrew_date(dt.date(2024, 10, 3)) == (5785, "Tishri", 1)
    assert calendar.hebrew_date(dt.date(2024, 7, 23)) == (5784, "Tammuz", 17)
    assert calendar.in_three_weeks(dt.date(2024, 8, 13)) and not calendar.in_three_weeks(dt.date(2024, 8, 14))
    assert calendar.clean_window(dt.date(2024, 8, 20), 6) and not calendar.clean_window(dt.date(2024, 8, 20), 7)


def test_streams_agree_with_batch_on_empty_and_missing_json(spark, tmp_path):
    from pyspark.sql import types as T

    from melisma.sources.tables import conform, read_json

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert read_json(spark, str(tmp_path / "none.json"), schema).count() == 0
    assert conform(spark.createDataFrame([(1,)], "a int"), schema).first().asDict() == {"a": 1, "b": None}


def test_landing_pages_and_last_good(spark, tmp_path):
    import json

    from pyspark.sql import types as T

    from melisma.sources import landing

    for page, rows in ((0, ["a", "b"]), (1, ["c"]), (3, ["lost"])):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"collection": "w", "page": page, "rows": rows, "next_token": None}))
    (tmp_path / "bad.json").write_text("{")
    found = landing.collection(landing.fresh_files(spark, str(tmp_path), "1 DAY"))
    assert [r["row"] for r in found.orderBy("position").collect()] == ["a", "b", "c"]
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    out = str(tmp_path / "snap")
    assert landing.write_if_changed(df, out, "id") and not landing.write_if_changed(df.orderBy(F.desc("id")), out, "id")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    assert landing.last_good(spark, [str(tmp_path / "none"), f"{out}/v00000001"], schema).count() == 2
    (tmp_path / "snap" / "v00000002").mkdir()  # a write that failed
    assert landing.newest(spark, out, schema).count() == 2
    assert landing.write_if_changed(df.limit(1), out, "id") and landing.newest(spark, out, schema).count() == 1
    for day in ("2024-01-01", "2024-03-01", "2024-03-01"):
        landing.append_run(df, str(tmp_path / "runs"), day)
    assert landing.history(spark, str(tmp_path / "runs"), "2024-03-02").count() == 2


def test_schedule_and_relevance_cover_all_tracks(spark, monkeypatch):
    from melisma.plans import recommend as plans
    from melisma.plans import retrieval

    path, indexed, build = "/root/testdata/sf0.01", [], impact.build
    assert plans.schedule(spark, path).agg(F.max("item")).first()[0] >= 800
    monkeypatch.setattr(impact, "build", lambda docs: indexed.append(docs.count()) or build(docs))
    retrieval.relevance_metrics(spark, path)
    assert indexed == [retrieval._docs(spark, path).filter("category = 'songs'").count()]


def test_backfill_scores_every_track(spark):
    tracks = [(i, 1 if i < 20 else 0, 0.5, 1950, False) for i in range(40)] + [(40, 0, 1.0, 2000, True), (41, 5, 0.35, 2000, True), (42, 0, 1.0, None, True)]
    tracks = spark.createDataFrame(tracks, "item long, reach long, multiplier double, year int, cls boolean")
    stations = spark.createDataFrame([(7, 2000, True), (8, None, True)], "station long, year int, cls boolean")
    head = spark.createDataFrame([(7, 3, 9.0)], "station long, item long, score double")
    got = recommend.backfill(stations, head, tracks, 3).orderBy("station", "place").collect()
    shrunk = lambda r: r / (r + 3)
    for station, year in ((7, 2000), (8, None)):
        key = lambda r: round((shrunk(r["reach"]) + (0.15 * math.exp(-abs(r["year"] - year) / 8) if year and r["year"] else 0) + 0.05 * r["cls"]) * r["multiplier"], 9)  # noqa: B023, E731
        first = [3] if station == 7 else []
        rest = [r["item"] for r in sorted(tracks.collect(), key=lambda r: (-key(r), r["item"])) if r["item"] not in first]
        assert [r["item"] for r in got if r["station"] == station] == (first + rest)[:3]


def test_cooccurrence_of_large_units(spark):
    wide = spark.createDataFrame([(d, i) for d in (1, 2) for i in range(510)], "device long, item long")
    found = telemetry.cooccurrence(wide, ["device"]).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most")).first()
    assert (found["n"], round(found["least"], 9), round(found["most"], 9)) == (510 * 509, 1.0, 1.0)


def test_radio_station_uses_whole_libraries(spark, monkeypatch):
    from melisma.plans import recommend as plans
    from melisma.sources import tables

    path, seen, scores = "/root/testdata/sf0.001", [], recommend.scores
    monkeypatch.setattr(recommend, "scores", lambda seeds, edges, tracks, *more, **named: seen.append(edges.filter("kind = 'lib'").count()) or scores(seeds, edges, tracks, *more, **named))
    plans.radio_station(spark, path)
    held = tables.plays(spark, path).filter("kind IN ('play', 'favorite', 'download')")
    assert seen == [telemetry.cooccurrence(held, ["device"]).count()]


def test_search_batch_reads_whole_texts(spark, tmp_path):
    late = "opening words that say nothing of interest to anybody at all here\nthen comes quixotic zeppelin at last"
    rows = [(100, "a quixotic zeppelin", "en", "x"), (101, late, "en", "x"), (102, "nothing like it", "en", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    from melisma.plans import retrieval

    assert {r["doc_id"] for r in retrieval.search_batch(spark, str(tmp_path)).filter("qid = 100").collect()} == {100, 101}


CREDITS = [
    ("Shiru (Remix) (feat. Anna)", ["Anna"]), ("Song (Live feat. Anna & Bo)", ["Anna", "Bo"]), ("Song [duet with Anna]", ["Anna"]), ("Song {Acoustic, with Anna, Bo}", ["Anna", "Bo"]),
    ("Take Me with Your Words", []), ("Song ft. Anna (Live)", ["Anna"]), ("Niggun (feat. אנהעםבני)", ["אנה", "בני"]), ("Song (Live)", []), ("", []), (None, None),
]


@pytest.mark.parametrize("title, names", CREDITS)
def test_credits_anywhere(spark, title, names):
    found = spark.createDataFrame([(title,)], "t string").select(tx.credits(F.col("t"))).first()[0]
    assert found == names


def test_history_of_one_list(spark):
    """An anchor of this week must be half a day old; what is first seen counts as new for a day."""
    from melisma.operators import history

    runs = lambda *rows: spark.createDataFrame([(dt.datetime.fromisoformat(t), True, "l", f, 7, p, i, 1) for t, f, items in rows for p, i in enumerate(items, 1)], history.DDL)
    of = lambda h, now: {r["item"]: (r["badge"], r["delta"]) for r in history.badges(h, F.lit(now)).collect()}
    week = runs(("2024-01-22T00:00:00", "a", [1, 2, 3]), ("2024-01-20T00:00:00", "a", [9]), ("2024-01-29T00:00:00", "a", [2, 1, 5]), ("2024-01-30T00:00:00", "a", [2, 5, 9, 6]))
    assert of(week, "2024-01-30 06:00:00") == {2: ("move", 1), 5: (None, None), 9: ("reentry", None), 6: ("new", None)}
    young = runs(("2024-01-29T00:00:00", "a", [1]), ("2024-01-30T00:00:00", "b", [1, 2]))
    assert of(young, "2024-01-30 06:00:00") == {1: (None, None), 2: (None, None)}
    assert of(young, "2024-01-30 12:00:00") == {1: ("move", 0), 2: ("move", 0)}
