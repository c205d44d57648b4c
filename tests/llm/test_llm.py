"""The training-data operators against brute force on small tables with nulls, empty, long and repeated rows."""

import collections
import hashlib
import html as htmllib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from melisma.llm import bm25_decontam, graph, gru_lm, host_paths, ngram_join, quality_fm, soft_mixing, suffix_dedup, url_filter, warc, winnowing
from melisma.llm.html_blocks import read, text_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count int, component string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0d]+", lower(s or ""))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, nulls, empty, short, long and repeated rows, and clashing column names."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Wo{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(k))
    passage = text(110)
    out = [text(rng.choice([4, 30, 120, 300])) for _ in range(n)]
    out += [out[3], out[5], out[5]]
    for k in (1, 2, 3):
        w = out[k * 7].split(" ")
        for cut in (3, 5):
            if len(w) > 20:
                w = w[:cut] + ["Changed"] + w[cut + 1 :]
        out.append(" ".join(w))
    out += [text(40) + "\n" + passage + "\t" + text(30) for _ in range(4)]
    out += [None, "", "   ", "one", "one", "two words", "x" * 5000, text(4000), "\x0bodd\x1cspace here"]
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or ""), 1, "c") for i, t in enumerate(out)]
    return rows + [rows[10], (None, out[12], None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], int(len(r[1] or "") % 4 != 0), int(len(r[1] or "") % 7 == 0)) for r in rows if r[0] is not None] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


# ---- near duplicates


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_by_hand(sets, linked):
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(sets))]


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def expected_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    tops = components_by_hand(sets, linked)
    first = {}
    for r, top in zip(rows, tops):
        if r[0] is not None:
            first[top] = min(first.get(top, r[0]), r[0])
    return sorted(((r[0], len(s), first.get(top)) for r, s, top in zip(rows, sets, tops)), key=repr)


def test_near_duplicates(docs, rows):
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == expected_groups(rows)


def test_near_duplicates_in_a_large_group(spark):
    """Copies with many edits: some link to a few others only."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), None, None, None, None, None))
    got = sorted(map(tuple, ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == expected_groups(rows)


def test_heavy_shingles(spark, monkeypatch):
    """Shingles that stand in most texts, in some tasks' shares more often than in others, change no result."""
    monkeypatch.setattr(ngram_join, "LEAST_HEAVY", 3)
    monkeypatch.setattr(ngram_join, "FLUSH", 600)
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [[word() for _ in range(12)] for _ in range(4)]
    rows = []
    for k in range(160):
        own = [word() for _ in range(rng.choice([8, 16, 24]))]
        rows.append((k, " ".join(sum(rng.sample(common, rng.randint(0, 4)), own)), None, None, None, None, None))
        if k % 5 == 0:
            rows.append((1000 + k, rows[-1][1] + " more", None, None, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=repr) == expected_groups(rows)
    flushed = [r for b in ngram_join._postings(3, 5, 3)([pa.record_batch({"text": [r[1] for r in rows]})]) for r in b.to_pylist()]
    assert any(r["place"] is None for r in flushed) and any(r["heavy"] for r in flushed)


def test_keep_first(spark, docs, rows):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    groups = {d: c for d, _, c in expected_groups([r for r in rows if r[0] is not None])}
    want = sorted(d for d, c in groups.items() if d == c)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == want


def test_keep_first_keeps_other_texts_with_the_same_id(spark):
    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    odd = [(1, text("zebra"), "z"), (1, text("apple"), "a"), (1, text("apple"), "a"), (2, text("apple"), "b"), (3, "", "c"), (3, "", "c"), (4, None, "d"), (None, text("apple"), "e"), (5, text("zebra", 39), "f")]
    kept = ngram_join.keep_first(spark.createDataFrame(odd, "doc_id long, text string, __id string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([odd[0], odd[1], *odd[4:8]], key=repr)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    more = graph.merge(graph.components(links), spark.createDataFrame([(40, 102), (7, 500)], "a long, b long"))
    assert {r["component"] for r in more.collect()} == {0} and more.count() == 45


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        a, b = np.unique(common), np.unique(np.r_[common[:-6], rng.integers(0, 1 << 62, 6).astype(np.uint64)])
        df = {t: 2 + int(t) % 5 for t in np.r_[a, b].tolist()}
        shared = np.intersect1d(a, b)
        pa_, pb = (ngram_join.other_prefixes(np.array([t for t in x if t in shared]), np.array([df[t] for t in x.tolist() if np.uint64(t) in shared]), len(x)) for x in (a, b))
        assert all(len(np.intersect1d(x, y)) for x, y in zip(pa_, pb))


# ---- repeated strings


def removed_by_hand(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append((len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def passages_by_hand(texts, length=200, words=50):
    """Number and bytes of the repeated runs that hold over so many words."""
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = [m for m in re.finditer(rb"\x01+", bytes(gone)) if len(re.findall(rb"[^\x20\x09-\x0d]+", t[m.start() : m.end()])) > words]
        out.append((len(runs), sum(m.end() - m.start() for m in runs)))
    return out


@pytest.mark.parametrize("length, block, passage", [(400, 512 << 10, 200), (150, 1500, 100)])
def test_repeated_strings(docs, rows, length, block, passage):
    """The second case has blocks so small that anchors go on from block to block."""
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(((r[0], *x, *y) for r, x, y in zip(rows, removed_by_hand(texts, length), passages_by_hand(texts, passage))), key=repr)
    assert sorted(map(tuple, suffix_dedup.digests(docs, length, block, passage).collect()), key=repr) == want


def test_passages_of_over_50_words_are_reported(spark):
    """Passages under 400 bytes: nothing is removed, but each document that holds one says so, and no other."""
    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passages = [text(n) for n in (51, 52, 55, 60)]
    rows = [(i, f"{text(80)} {passages[i % 4] if i % 3 else text(40)} {text(70)}") for i in range(60)]
    got = {r["doc_id"]: r["n_passages"] for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i % 3 > 0) for i in range(60)}


def test_repeats_in_one_hot_anchor(spark):
    """One short passage in very many different texts, some of which share more around it."""
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, around = text(90), [text(60) for _ in range(5)]
    rows = [(i, text(200) + (around[i % 5] if i % 4 == 0 else text(60)) + passage + text(200)) for i in range(400)]
    texts = [t.encode() for _, t in rows]
    want = sorted((r[0], *x) for r, x in zip(rows, removed_by_hand(texts, 120)))
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), 120, 4000, 100)
    assert sorted(tuple(r)[:5] for r in got.collect()) == want


def test_remove_keeps_columns(docs, rows):
    """Columns with the names that the operator uses inside keep their values."""
    odd = docs.withColumn("rid", F.lit(7)).withColumn("found", F.lit("f")).withColumn("ah", F.lit(None).cast("double"))
    out = suffix_dedup.remove(odd, 200)
    assert out.columns == odd.columns
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(hashed for _, _, _, hashed in removed_by_hand(texts, 200))
    got = out.collect()
    assert all(r["rid"] == 7 and r["found"] == "f" and r["ah"] is None for r in got)
    clean = [t for t, (_, gone, _, _) in zip(texts, removed_by_hand(texts, 200)) if not gone]
    assert len(got) == len(want) and collections.Counter(clean) <= collections.Counter(r["text"].encode() for r in got)


def shared_by_hand(text, i, others, depth):
    """Longest prefix of text[i:] (at most depth bytes) at any of the (other text, place)."""
    best = 0
    for other, j in others:
        n = 0
        while n < depth and i + n < len(text) and j + n < len(other) and text[i + n] == other[j + n]:
            n += 1
        best = max(best, n)
    return best


def test_blocks_merge_by_binary_search():
    rng = random.Random(2)
    text = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    shared = text(60)
    a, b = [text(80) + shared + text(20), text(100)], [text(10) + shared + text(90), text(70)]
    whole = lambda chunks: [(c, len(c)) for c in chunks]
    x, y = suffix_dedup.Block(whole(a), 50), suffix_dedup.Block(whole(b), 50)
    assert x.best.max() < 50 and y.best.max() < 50
    x.merge([0, 1], y, [0, 1])
    for block, own, other in ((x, a, b), (y, b, a)):
        there = [(c, j) for c in other for j in range(len(c))]
        for k, c in enumerate(own):
            got = block.best[block.starts[k] : block.starts[k] + len(c)]
            assert all(g >= 50 if (n := shared_by_hand(c, i, there, 50)) == 50 else g >= n for i, g in enumerate(got.tolist()))
            assert [g >= 50 for g in got] == [shared_by_hand(c, i, there, 50) == 50 for i in range(len(c))]


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_suffix_array_and_common_prefixes(share):
    """Only a share of each chunk are windows."""
    rng = random.Random(4)
    for _ in range(30):
        chunks = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 90))) for _ in range(6)] + [b"abab" * 15]
        chunks.append(chunks[0][:30] + b"b")
        counts = [max(1, int(share * len(c))) for c in chunks]
        depth = rng.choice([8, 20, 40])
        block = suffix_dedup.Block(list(zip(chunks, counts)), depth)
        places = [(k, i) for k, n in enumerate(counts) for i in range(n)]
        for k, i in places:
            others = [(chunks[o], j) for o, j in places if (o, j) != (k, i)]
            want = shared_by_hand(chunks[k], i, others, depth)
            assert min(depth, block.best[block.starts[k] + i]) == min(depth, want), (k, i)


# ---- fingerprints


def gram_by_hand(codes, k):
    """The hash of a gram from its code points: a polynomial, scaled so that its place doesn't count, with its bits spread."""
    m, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(codes)) & m
    h ^= 0 if len(codes) == k else len(codes)  # a shorter text is one gram, apart from longer ones
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & m
    h = ((h ^ (h >> 29)) * 0xA3B195354A39B70D) & m
    return h ^ (h >> 32)


def winnow_by_hand(text, k=winnowing.K, window=winnowing.WINDOW):
    codes = [ord(c) for c in text]
    grams = [gram_by_hand(codes[i : i + k], k) for i in range(max(1, len(codes) - k + 1))] if codes else []
    chosen = []
    for i in range(max(1, len(grams) - window + 1)) if grams else ():
        part = [(g >> 32, -p) for p, g in enumerate(grams[i : i + window], i)]
        h, p = min(part)
        if not chosen or chosen[-1] != (h, -p):
            chosen.append((h, -p))
    return np.array([h for h, _ in chosen], np.uint32), np.array([p for _, p in chosen], np.uint32)


def likeness_by_hand(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints_by_hand(spark, rows):
    ranks = {r["t"]: r["h"] for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ranks[r[1] or ""], r[1] or ""))
    want = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = map(winnow_by_hand, (text, edited, after))
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_string(*own), winnowing.as_string(*other), likeness_by_hand(own[0], other[0]), likeness_by_hand(own[0], following[0])))
    return sorted(want, key=repr)


def test_fingerprints(spark, docs, rows):
    got = winnowing.fingerprints(docs).collect()
    assert sorted(map(tuple, got), key=repr) == fingerprints_by_hand(spark, rows)
    long = [r for r in got if r["n_chars"] > 600]
    assert np.mean([r["near_edited"] for r in long]) > 0.2 > np.mean([r["near_next"] for r in long])


@pytest.mark.parametrize("hot", [7, None])
def test_fingerprints_of_one_hot_id(spark, monkeypatch, hot):
    """Most rows share one doc_id, or have none: they are dealt over several ranges in their order."""
    monkeypatch.setattr(winnowing, "PARTITION_CHARS", 400)
    rng = random.Random(18)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90)))
    rows = [(hot, text()) for _ in range(80)] + [(i, text()) for i in range(20)] + [(3, "same"), (3, "same")]
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == fingerprints_by_hand(spark, rows)


def test_ranges_keep_the_order():
    rng = np.random.default_rng(4)
    cuts = np.array([2, 5, 5, 5, 9])
    ids, spread = rng.integers(0, 12, 500), rng.random(500)
    part = winnowing.places_of(cuts, ids, spread)
    order = np.lexsort((spread, ids))
    assert (np.diff(part[order]) >= 0).all() and set(part[ids == 5]) == {2, 3, 4} and set(part) <= set(range(6))


def test_a_common_run_leaves_a_common_hash():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(30):
        shared = text(winnowing.K + winnowing.WINDOW - 1)
        a, b = (winnowing.winnow(text(rng.randint(0, 300)) + shared + text(rng.randint(0, 300)))[0] for _ in range(2))
        assert len(np.intersect1d(a, b))


def test_short_texts_keep_a_common_hash_when_half_is_edited(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short = spark.createDataFrame([(i, text(rng.randint(62, 250))) for i in range(60)], "doc_id long, text string")
    assert all(r["near_edited"] > 0 for r in winnowing.fingerprints(short).collect())


def test_one_document_is_its_own_next(spark):
    one = spark.createDataFrame([(7, "short text", None, None, None, None, None)], SCHEMA)
    r = winnowing.fingerprints(one).first()
    assert r["n_chars"] == 10 and r["near_next"] == 1.0


# ---- language model


def test_language_model(docs, rows):
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r for r in gru_lm.scores(docs).collect()}
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    count = collections.Counter(w for r in train for w in [*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        toks = [*words(r[1]), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks)
        g = got[r[0], len(toks), round(base, 6)]
        assert g["n_known"] == sum(count[w] > 0 for w in toks) and g["train_tokens"] == n
        assert g["held_out"] == (zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2)
        assert -40 * len(toks) < g["score"] < 0


def small_network():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.choice(1 << 60, 30, replace=False).astype(np.uint64))
    vocabulary = gru_lm.build_vocabulary(hashes, np.arange(3, 33), 700, 45, 20)
    net = gru_lm.Network(vocabulary)
    for p in net.parameters():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    return vocabulary, net


def test_network_is_a_distribution():
    _, net = small_network()
    h = np.random.default_rng(2).normal(0, 1, (3, gru_lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.outputs(h, np.full(3, w))) for w in range(net.tail + 1))
    assert np.allclose(total, 1, atol=1e-4)


def by_hand(net, ids):
    """log probability of one text, a token after the other, from the equations of the network."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    softmax = lambda v: v - np.log(np.exp(v).sum())
    n = gru_lm.HIDDEN
    h, before, total = np.zeros(n), net.end, 0.0
    for t in ids.tolist():
        x = net.x[before].astype(float)
        z, r = sigmoid(x[:n] + h @ net.u[:, :n]), sigmoid(x[n : 2 * n] + h @ net.u[:, n:])
        h = (1 - z) * h + z * np.tanh(x[2 * n :] + (r * h) @ net.c)
        k = int(net.klass[t])
        total += softmax(h @ net.class_w + net.class_b)[k]
        if k < len(net.starts) - 1:
            a, b = net.starts[k], net.starts[k + 1]
            total += softmax(net.word_w[a:b] @ h + net.word_b[a:b])[t - a]
        before = t
    return total


def test_state_is_carried_through_windows():
    """Scores of texts side by side equal those of each alone, step by step."""
    _, net = small_network()
    rng = np.random.default_rng(3)
    lengths = [1, 70, 3, 200]
    lo = np.r_[0, np.cumsum(lengths)]
    ids = rng.integers(0, net.tail + 1, lo[-1]).astype(np.int32)
    want = [by_hand(net, ids[a:z]) / math.log(10) for a, z in zip(lo[:-1], lo[1:])]
    assert np.allclose(gru_lm.score(net, ids, lo), want, rtol=1e-4)


def test_scores_of_a_corpus_from_its_network(spark, docs, rows, monkeypatch):
    """score: the network's log probability, and for words without an output their add-one share of the tail class."""
    monkeypatch.setattr(gru_lm, "HEAD", 50)
    fitted = []
    train = gru_lm.train
    monkeypatch.setattr(gru_lm, "train", lambda d, v: fitted.append((v, train(d, v))) or fitted[0][1])
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in gru_lm.scores(docs).collect()}
    vocabulary, net = fitted[0]
    taught = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    count = collections.Counter(w for r in taught for w in [*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    numbers = {w: i for w in count if w is not None for i in [int(vocabulary.output[np.searchsorted(vocabulary.hashes, gru_lm.words(*gru_lm.text_bytes(pa.array([w])))[3])][0])]} | {None: net.end}
    tail = (n - sum(c for w, c in count.items() if numbers[w] < net.tail)) + (v - net.tail) + 1
    assert net.tail == 50 and tail > 100
    for r in rows:
        toks = [*words(r[1]), None]
        ids = np.array([numbers.get(w, net.tail) for w in toks])
        want = by_hand(net, ids) / math.log(10) + sum(math.log10((count[w] + 1) / tail) for w, i in zip(toks, ids) if i == net.tail)
        key = r[0], len(toks), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in toks), 6)
        assert math.isclose(got[key], want, rel_tol=1e-3), key


def test_gradients_agree_with_differences():
    vocabulary, net = small_network()
    rng = np.random.default_rng(4)
    lo = np.array([0, 12, 20])
    ids = rng.integers(0, net.tail + 1, 20).astype(np.int32)
    grads = {name: np.zeros(getattr(net, name).shape) for name in net.NAMES}

    class Probe(gru_lm.Trainer):
        def move(self, name, grad, at=slice(None)):
            grads[name][at] += grad

    Probe(net).texts(ids, lo)
    loss = lambda: -gru_lm.score(net, ids, lo).sum() * math.log(10) / 256
    for name in net.NAMES:
        p = getattr(net, name)
        for flat in rng.choice(p.size, 6):
            at = np.unravel_index(flat, p.shape)
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-4 + 0.05 * abs(grads[name][at]), name


def test_training_lowers_held_out_loss():
    rng = np.random.default_rng(5)
    vocabulary, net = small_network()
    cycle = lambda n: ((np.arange(n) + rng.integers(20)) % 20).astype(np.int32)
    texts = [cycle(60) for _ in range(200)]
    lo = np.arange(201) * 60
    before = gru_lm.score(net, np.concatenate(texts[:20]), lo[:21]).sum()
    trainer = gru_lm.Trainer(net)
    for _ in range(3):
        trainer.texts(np.concatenate(texts[20:]), lo[:181])
    assert gru_lm.score(net, np.concatenate(texts[:20]), lo[:21]).sum() > 0.7 * before


def test_every_window_teaches():
    _, net = small_network()
    moves = []

    class Probe(gru_lm.Trainer):
        def move(self, name, grad, at=slice(None)):
            moves.append(name)

    trainer = Probe(net)
    trainer.texts(np.zeros(5 * gru_lm.WINDOW + 3, np.int32), np.array([0, 5 * gru_lm.WINDOW + 3]))
    assert moves.count("u") == 6 and trainer.tokens == 5 * gru_lm.WINDOW + 3


# ---- decontamination


def test_decontamination(spark, docs, rows):
    passage = next(r[1] for r in rows if r[1] and "\t" in r[1]).split("\n")[1].split("\t")[0]
    items = [(1, " ".join(passage.split()[5:40]) + "."), (2, "What is never asked here? The answer stays outside."), (3, None), (4, ""), (5, rows[8][1])]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in bm25_decontam.leaks(docs, bench).collect()}
    norm = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())) + " "
    want = {(r[0], i) for r in rows for i, t in items if t and norm(t) in norm(r[1])}
    assert got == want and len(want) >= 5
    assert {(r["doc_id"], r["item_id"]) for r in bm25_decontam.leaks(docs, bench, max_items=2).collect()} == want
    kept = bm25_decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want if d is not None}


def test_long_items_are_found_wherever_their_copies_start(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(i, f"{text(int(n * 0.6))}. {text(int(n * 0.4))}.") for i, n in enumerate((40, 1100, 3000))]
    docs = [(10 * i + k, f"{text(before)} {t} {text(900)}") for i, t in items for k, before in enumerate((0, 300, 700))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in bm25_decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(10 * i + k, i) for i, _ in items for k in range(3)}


def test_scores_do_not_depend_on_the_number_of_shards(spark):
    rng = random.Random(10)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    items = [(i, f"{text(12 + 4 * i)}. {text(8 + i)}.") for i in range(12)]
    docs = [(i, f"{text(50)} {t[: rng.randint(len(t) // 2, len(t))]} {text(90)}") for i, t in items for _ in range(3)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole, split = (sorted(tuple(round(x, 9) for x in r) for r in bm25_decontam.leaks(docs, bench, threshold=0.3, max_items=m).collect()) for m in (4096, 3))
    assert whole == split and whole


def bm25_by_hand(items, query):
    """Each item's score for a set of words, as a share of the score for its own words."""
    texts = [t.split() for _, t in items]
    mean = sum(map(len, texts)) / len(texts)
    df = collections.Counter(w for t in texts for w in set(t))
    idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}

    def total(t, asked):
        tf = collections.Counter(t)
        return sum(idf[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(t) & asked)

    return [total(t, query) / total(t, set(t)) for t in texts]


@pytest.mark.parametrize("skew", [0, 3])
def test_search_finds_all_above_the_threshold(skew):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(120)]
    draw = lambda n: " ".join(vocabulary[int(120 * rng.random() ** (1 + skew))] for _ in range(n))
    items = [(i, draw(rng.randint(5, 30))) for i in range(90)]
    index = bm25_decontam.build(items)
    texts = [draw(rng.choice([0, 3, 50, 64, 65, 200, 333])) for _ in range(40)] + [t for _, t in items[:5]]
    h, at = bm25_decontam.hashed(texts)
    half = index.passage // 2
    want = {}
    for d, text in enumerate(texts):
        own = text.split()
        n = -(-len(own) // half)
        for k in range(max(1, n - 1) if n else 0):
            for i, value in enumerate(bm25_by_hand(items, set(own[k * half : (k + 2) * half]))):
                if value >= 0.5:
                    want[d, k * half, i] = value
    got = {(d, int(a - at[d]), i): value for d, a, _, i, value in bm25_decontam.search(index, h, at, 0.5)}
    assert got == pytest.approx(want, rel=1e-9) and want


def test_wand_skips_and_finds_all():
    rng = random.Random(16)
    for _ in range(200):
        lists, total = [], collections.Counter()
        for _ in range(rng.randint(1, 12)):
            items = sorted(rng.sample(range(300), rng.randint(1, 60)))
            impacts = [rng.random() ** 4 for _ in items]
            blocks = [(k, min(len(items), k + 8)) for k in range(0, len(items), 8)]
            lists.append((items, impacts, max(impacts), [items[z - 1] for _, z in blocks], [max(impacts[a:z]) for a, z in blocks]))
            total.update(dict(zip(items, impacts)))
        assert dict(bm25_decontam.wand(lists, 0.9)) == pytest.approx({i: v for i, v in total.items() if v >= 0.9})


# ---- quality


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) + "."
    bad = lambda: " | ".join(rng.choice(["alpha", "BETA!!", "gamma", "DELTA!!"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), None, None, None, None, None) for i in range(300)] + [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (1, good(), None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = quality_fm.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert len(held) > 30 and np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) > 0.95
    kept = quality_fm.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_metadata_enters_the_score(spark):
    """Rows whose stated length is far from the text's are the bad ones; nothing else tells them apart."""
    rng = random.Random(19)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    rows = [(i, t, str(len(t) if i % 2 else 7 * len(t))) for i in range(400) for t in [text()]] + [(900, text(), None), (901, text(), "many"), (902, text(), "-3")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    held = [r for r in quality_fm.score(docs, labels).collect() if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert quality_fm.score(docs.drop("n_chars"), labels).count() == 403 and quality_fm.keep_good(docs, labels).columns == docs.columns


def test_quality_of_held_out_labels(spark):
    """Area under the curve on the labels that teach nothing."""
    read_table = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    scored = quality_fm.score(read_table("documents"), read_table("labels")).filter("held_out").join(read_table("labels"), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    order = np.argsort(np.argsort(np.r_[good, bad]))
    area = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    assert len(good) > 100 and len(bad) > 20 and area > 0.95


def test_sum_of_squares_identity():
    rng = np.random.default_rng(7)
    width = (1 << quality_fm.BITS) + len(quality_fm.STATS)
    m = quality_fm.Machine(0.3, rng.normal(0, 1, width), rng.normal(0, 1, (width, 3)), np.zeros(len(quality_fm.STATS)), np.ones(len(quality_fm.STATS)))
    bucket, x, stats = np.array([3, 70, 900], np.int32), np.array([0.5, 0.2, 0.7]), rng.normal(0, 0.5, (1, len(quality_fm.STATS)))
    index, value = np.r_[bucket, np.arange(1 << quality_fm.BITS, width)], np.r_[x, stats[0]]
    pairs = sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
    assert np.isclose(quality_fm.margins(m, bucket, x, np.array([0, 3]), stats)[0], 0.3 + m.w[index] @ value + pairs)


# ---- mixing


def test_mixing(spark, docs, rows):
    out = soft_mixing.mix(docs, labels_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out if r["doc_id"] is not None) == sorted((r[0], len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))) for r in rows if r[0] is not None)
    names = list(soft_mixing.DOMAINS)
    assert all(r["rate"] >= 0 and math.isclose(sum(r[f"p_{d}"] for d in names), 1, abs_tol=1e-9) for r in out)


def test_posteriors_by_hand(spark, docs, rows):
    """Naive Bayes written out, with the smoothing shared out as the buckets stand in all domains."""
    labels, names = labels_of(spark, rows), list(soft_mixing.DOMAINS)
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
    every = sorted({w for r in rows for w in split(r[1])})
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(soft_mixing.BUCKETS)).alias("b")).collect()}
    domain: dict = {}
    for doc_id, quality, toxic in labels.collect():
        found = "toxic" if toxic == 1 else "low" if quality == 0 else "good" if quality == 1 else None
        if doc_id is not None and found:
            domain[doc_id] = min(found, domain.get(doc_id, found))
    count = {d: collections.Counter(bucket[w] for r in rows if domain.get(r[0]) == d for w in split(r[1])) for d in names}
    sums = {d: sum(c.values()) for d, c in count.items()}
    pseudo = soft_mixing.SMOOTHING * soft_mixing.BUCKETS
    known = set().union(*count.values())
    prior = {d: math.log((sum(x == d for x in domain.values()) + 1) / (len(domain) + len(names))) for d in names}
    want = []
    for r in rows:
        logs = dict(prior)
        for b in (bucket[w] for w in split(r[1])):
            if b in known:
                share = sum(c[b] for c in count.values()) / sum(sums.values())
                for d in names:
                    logs[d] += math.log((count[d][b] + pseudo * share) / (sums[d] + pseudo))
        whole = sum(math.exp(v - max(logs.values())) for v in logs.values())
        want.append((str(r[0]), len(split(r[1])), *(math.exp(logs[d] - max(logs.values())) / whole for d in names)))
    got = sorted((str(r["doc_id"]), r["n_tokens"], *(r[f"p_{d}"] for d in names)) for r in soft_mixing.mix(docs, labels).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and np.allclose([x[2:] for x in got], [x[2:] for x in sorted(want)], atol=1e-9)


def test_mixing_reaches_its_targets(spark):
    read_table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    out = soft_mixing.mix(read_table("documents"), read_table("labels")).collect()
    total = sum(r["n_tokens"] for r in out)
    for d, share in soft_mixing.TARGETS.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in out) - share * total) < 1e-3 * total


def test_rates_by_hand(spark):
    rng = random.Random(3)
    members = [(i, rng.randint(0, 50), p := rng.random(), 1 - p) for i in range(80)]
    out = soft_mixing.fit_rates(spark.createDataFrame(members, "doc_id long, n_tokens long, p_a double, p_b double"), {"a": 0.8, "b": 0.2}).collect()
    n, p = np.array([m[1] for m in members]), np.array([m[2:] for m in members])
    rate, aim = np.ones(80), np.array([0.8, 0.2]) * n.sum()
    have = n @ p
    for _ in range(soft_mixing.STEPS):
        now = (rate * n) @ p
        if (abs(now - aim) <= soft_mixing.TOLERANCE * max(1, n.sum())).all():
            break
        rate = np.maximum(0, rate - soft_mixing.STEP_SIZE * p @ ((now - aim) / have))
    assert np.allclose([r["rate"] for r in sorted(out, key=lambda r: r["doc_id"])], rate, atol=1e-6)


def test_mixing_plan_is_native(spark, docs, rows):
    plan = soft_mixing.mix(docs, labels_of(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- pages

PAGES = [
    (1, "https://a.example.com/en/1", '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/x">x</a></nav><div class="post-12"><p>First &amp; best text.</p><p>Second <b>bold</b>ly put &eacute;.</div><div class="sidebar">Links</div><footer>f</footer>'),
    (2, "https://a.example.com/en/2", '<body><div class="post-7"><p>Short.</p><div class="comments"><p>A very long reader comment that is longer than the article itself by far.</p></div></div><div class="ad">Buy now</div></body>'),
    (3, "https://b.example.org/", "<article><h1>Head</h1><p>One<br>two<script>var x = '</p>';</script><p>three &am"),
    (4, None, None), (5, "nonsense", ""), (6, "https://a.example.com/en/2", "<nav>only menus</nav>"), (1, "https://a.example.com/en/1", "plain text, no markup"),
]
PAGE_SCHEMA = "page_id long, url string, html string"


def test_main_text(spark):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    want = sorted([(1, "First & best text. Second boldly put é."), (2, "Short."), (3, "Head One two three &am"), (4, ""), (5, ""), (6, ""), (1, "plain text, no markup")])
    got = host_paths.main_text(pages)
    assert sorted((r["page_id"], r["text"]) for r in got.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert sorted((r["page_id"], r["text"]) for r in host_paths.main_text(pages, broadcast_hosts=0).collect()) == want


def test_pages_of_the_test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in host_paths.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        flat = re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", body))
        assert r["text"] == " ".join(htmllib.unescape(flat).split())


def test_consensus_beats_a_page_of_its_own():
    page = read(PAGES[1][2])
    assert host_paths.extract(page, ["body>div.post-#"]) == "Short."


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    records = warc.as_responses(pages)
    out = warc.derivatives(records).collect()
    assert len(out) == 2 * len(PAGES)
    by = {(r["refers_to"], r["record_type"]): r for r in out}
    for data in (r["record"] for r in records.collect()):
        head, block = warc.parse_record(data)
        ident = warc.header(head, "WARC-Record-ID")
        meta, text = by[ident, "metadata"], by[ident, "conversion"]
        assert meta["source_payload_digest"] == warc.header(head, "WARC-Payload-Digest") and text["source_block_digest"] == warc.digest(block)
        assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
        assert b"source-http-content-type: text/html; charset=utf-8" in meta["block"]
        assert text["block"].decode() == text_of(read(warc.payload(block)[2].decode()))
        again, body = warc.parse_record(bytes(text["record"]))
        assert warc.header(again, "WARC-Refers-To") == ident and body == text["block"] and warc.digest(body) == text["block_digest"]


def test_warc_files_and_odd_records(spark, tmp_path):
    import gzip

    rows = [r["record"] for r in warc.as_responses(spark.createDataFrame(PAGES, PAGE_SCHEMA)).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r)) for r in rows))
    (tmp_path / "b.warc").write_bytes(b"".join(map(bytes, rows)))
    assert warc.derivatives(warc.read_files(spark, str(tmp_path))).count() == 4 * len(rows)
    odd = [(b"",), (None,), (b"WARC/1.0\r\nWARC-Type: request\r\n\r\n",), (b"junk",), (b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nHTTP/1.1 ",)]
    assert warc.derivatives(spark.createDataFrame(odd, "record binary")).count() == 2
    assert warc.dechunk(b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n") == b"Wikipedia"


def test_a_host_outvotes_its_odd_pages(spark):
    """Three pages vote for the same path; the fourth alone would take its longer box, the fifth has other digits in its class."""
    page = lambda k, text, more="": f'<body><div class="col-{k}"><p>{text}</p></div><div class="box"><p>{more}</p></div></body>'
    rows = [(i, f"http://h.test/{i}", page(i, "Main text of this page, long enough.")) for i in range(3)]
    rows += [(3, "http://h.test/3", page(77, "Short one.", "A box with much more words than the text of the page beside it has."))]
    rows += [(4, "http://other.test/4", page(4, "Short one.", "A box with much more words than the text of the page beside it has."))]
    got = {r["page_id"]: r["text"] for r in host_paths.main_text(spark.createDataFrame(rows, PAGE_SCHEMA)).collect()}
    assert got[3] == "Short one." and got[4].startswith("A box") and all(got[i].startswith("Main text") for i in range(3))


def test_names_are_weighed():
    text = lambda html: host_paths.extract(read(html), [])
    assert text('<div hidden>no</div><div style="display: none">no</div><p>yes</p>') == "yes"
    assert text('<div class="post tags"><p>Kept as an article.</p></div>') == "Kept as an article."
    assert text('<section class="related-work"><p>Kept, it is prose.</p></section>') == "Kept, it is prose."
    assert text('<p>Article.</p><div class="related-posts"><a href="/1">One</a> <a href="/2">Two</a></div>') == "Article."
    assert text('<p>Article.</p><div class="tags">Tags</div><div class="post-comments"><p>No.</p></div><div id="cookieNotice">No.</div>') == "Article."


def test_names_within_longer_ones_and_article_heads_keep_their_text():
    text = lambda html: host_paths.extract(read(html), [])
    for inner in ('<section id="Header_files">{}</section>', '<div class="share-prices">{}</div>', '<div class="entry-header">{}</div>', '<p id="notice-1">{}</p>', '<p class="comment">{}</p>', '<h2 id="Social_life">{}</h2>', "<header><h1>{}</h1></header>"):
        assert text(f"<article>{inner.format('Kept words.')}<p>The article goes on.</p></article>") == "Kept words. The article goes on."
    assert text("<article><header><h1>Title</h1><div>By me</div><nav><h2>No</h2></nav></header><p>Text.</p></article>") == "Title Text."
    assert text("<header><h1>Site</h1></header><article><p>Text.</p></article>") == "Text."
    for name in ("comments", "share-buttons", "site-header", "top-nav", "cookie-banner", "post-comments", "sidebar_left", "adBox", "social-links-list"):
        assert text(f'<article><p>Text.</p><div class="{name}"><p>Gone.</p></div></article>') == "Text."


ODD_PAGES = {
    "quotes": "<a " + "'\"" * 10000, "lone quotes": "<a '" * 5000, "values": "<a " + "=\"'" * 10000, "no end": '<a b="x" ' * 5000, "mixed": "<a b='\"' c=\"" * 5000 + ">x",
    "deep": "<div class=x>" * 20000 + "t" + "</p>" * 20000, "signs": "<" * 50000, "comments": "<!--" * 20000, "scripts": "<script>" * 20000, "ends": "</" * 20000,
    "references": "&" * 50000 + "&#xD800;&#99999999999;", "blanks": ("<a" + " " * 200 + "=") * 500,
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_odd_pages_take_no_time(name):
    began = time.perf_counter()
    host_paths.extract(read(ODD_PAGES[name]), ["body>div.x"])
    assert time.perf_counter() - began < 1


def test_random_bytes_never_fail():
    rng = random.Random(11)
    marks = ["<", "a", ">", "'", '"', "=", "/", "!--", "--", "p", "div", " ", "script", "&", "#x", "title", "\r\n", "charset=", "idna", "unicode_escape", "\\ud800"]
    for k in range(2000):
        b = bytes(rng.randrange(256) for _ in range(rng.randrange(300))) if k % 2 else "".join(rng.choice(marks) for _ in range(120)).encode()
        kind = rng.choice(["text/html; charset=idna", "text/html; charset=unicode_escape", "text/html; charset=utf-16", "text/plain; charset=x", "text/html"])
        coding = rng.choice(["gzip", "identity"])
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Encoding: {coding}\r\nTransfer-Encoding: {rng.choice(['chunked', 'x'])}\r\n\r\n".encode() + b
        assert len(warc.derive([("WARC-Type", "response")], block)) == 2
        warc.parse_record(b)
        host_paths.extract(read(b.decode("utf-8", "replace")), ["div"])


def test_malformed_responses(spark):
    """A gzip body cut off or not one, odd charsets and lengths: each still has its two records."""
    import gzip

    page = b"<title>\\ud800</title><p>Text</p>"
    head = lambda extra: f"HTTP/1.1 200 OK\r\nContent-Type: text/html; {extra}".encode()
    blocks = [head("") + b"\r\nContent-Encoding: gzip\r\n\r\n" + x for x in (gzip.compress(page)[:-9], gzip.compress(page)[:12] + b"\xff" * 30, page)]
    blocks += [head(f"charset={c}") + b"\r\n\r\n" + page for c in ("idna", "undefined", "unicode_escape", "utf-7", "none", "rot13")]
    rows = [(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n".encode() + b,) for b in blocks for n in (len(b), "\u00b2", "9" * 5000, "-1")]
    out = warc.derivatives(spark.createDataFrame(rows, "record binary")).collect()
    assert len(out) == 2 * len(rows)
    assert sum(bytes(r["block"]) == b"Text" for r in out if r["record_type"] == "conversion") >= 6


def test_content_codings(spark):
    """Deflate with and without its frame, two codings, several members, a bomb, and codings that can't be read."""
    import gzip
    import zlib as z

    page = b"<p>Read me</p>"
    raw = lambda x: (c := z.compressobj(wbits=-15)).compress(x) + c.flush()
    bodies = [("gzip", gzip.compress(page)), ("deflate", z.compress(page)), ("deflate", raw(page)), ("deflate, gzip", gzip.compress(z.compress(page))), ("x-gzip", gzip.compress(page[:5]) + gzip.compress(page[5:]))]
    bodies += [("br", b"\x0b\x02"), ("zstd", b"(\xb5/\xfd"), ("gzip", gzip.compress(b"<p>" + b"0" * (warc.MOST_BYTES + 5))), ("deflate", b"no")]
    rows = []
    for coding, body in bodies:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: {coding}\r\n\r\n".encode() + body
        rows.append((f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{len(rows)}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block,))
    out = {(r["refers_to"], r["record_type"]): bytes(r["block"]) for r in warc.derivatives(spark.createDataFrame(rows, "record binary")).collect()}
    texts = [out[f"<r{n}>", "conversion"] for n in range(len(bodies))]
    assert texts[:5] == [b"Read me"] * 5 and texts[5:7] == [b"", b""] and len(texts[7]) == warc.MOST_BYTES - 3 and texts[8] == b"no"
    said = [re.findall(rb"unpacking: ([^\r]*)", out[f"<r{n}>", "metadata"]) for n in range(len(bodies))]
    assert said == [[]] * 5 + [[b"unknown br"], [b"unknown zstd"], [b"cut"], [b"malformed"]]


#: Addresses of well-known kinds, written down without a look at any table.
HELD_OUT_BAD = """
https://www.1xbet.com/en https://www.pornhub.com/video https://www.xvideos.com/tags https://www.pokerstars.com/poker/games https://www.888casino.com/promotions
https://www.bet365.com/betting https://thepiratebay.org/top https://nulledscripts.net/forum http://free-viagra-online.ru/order https://cialis-without-rx.biz/buy
http://crackedgames.net/keygen https://serialkeys.org/windows http://live-sex-cams.tv/girls https://escort-berlin.com/hookup http://fake-rolex-replica.cn/watches
https://paydayloans.us/apply https://lottery-winner-prize.info/claim http://buybacklinks.io/cheap http://linkfarm-network.biz/links http://click.adserver.net/popunder
https://spam-mailer.info/bulkmail http://phishing-login.tk/bank http://malware-host.ru/spyware.exe https://bitcoin-doubler.org/ponzi http://hentai-porn.xxx/
""".split()
HELD_OUT_GOOD = """
https://github.com/features https://www.ikea.com/catalogue https://www.amazon.com/books https://kubernetes.io/docs/concepts https://en.wikipedia.org/wiki/Rome
https://www.bbc.co.uk/news/world https://www.nytimes.com/section/politics https://docs.python.org/library/json.html https://www.mit.edu/research https://arxiv.org/abs
https://www.lemonde.fr/international https://www.spiegel.de/kultur https://elpais.com/economia https://www.nature.com/articles https://stackoverflow.com/questions
https://www.gov.uk/browse/driving https://www.who.int/health-topics https://www.nasa.gov/missions https://www.louvre.fr/en/visit https://www.allrecipes.com/bread
https://www.weather.gov/forecast https://www.imdb.com/title https://www.booking.com/hotels https://www.ams.org/journals https://www.mozilla.org/firefox
""".split()


def blocked_share(urls, w=None):
    w = url_filter.train() if w is None else w
    hosts, paths = (pa.array(x, pa.string()) for x in zip(*map(url_filter.split_url, urls)))
    return float(np.mean(1 / (1 + np.exp(-url_filter.logits(w, *url_filter.features(hosts, paths)))) >= url_filter.THRESHOLD))


def test_url_classifier_on_held_out_addresses():
    """What it is worth on addresses that it hasn't seen; README has the figures."""
    assert blocked_share(HELD_OUT_BAD) >= 0.6
    assert blocked_share(HELD_OUT_GOOD) <= 0.1


def test_url_table_owes_nothing_to_the_pages(spark):
    hosts, paths = set(), set()
    for f in ("sf0.001", "sf0.01", "sf0.1"):
        for r in spark.read.parquet(f"/root/testdata/{f}/pages.parquet").select("url").collect():
            host, path = url_filter.split_url(r["url"])
            hosts.add(host)
            paths.add(path)
    for _, url in url_filter.LABELLED:
        host, path = url_filter.split_url(url)
        assert host not in hosts and (path == "/" or path not in paths) and not re.search(r"\d", url)
    assert not {label for h in hosts for label in re.split(r"[.-]", h)[:1]} & {w for w in url_filter.ALLOWED}
    assert {re.sub("|".join(url_filter.BLOCKED), "?", u) for y, u in url_filter.LABELLED if y}  # both labels have the same forms
    used = {y: {n for n, form in enumerate(url_filter.FORMS) for z, u in url_filter.LABELLED if z == y and re.fullmatch(re.escape(form).replace(r"\{a\}", "[a-z]+").replace(r"\{b\}", "[a-z]+"), u)} for y in (0, 1)}
    assert used[0] == used[1] == set(range(len(url_filter.FORMS)))


def test_url_verdicts_do_not_lean_on_few_rows(spark):
    """Ten rows of either label taken away move the share of blocked ordinary pages by less than 0.02."""
    pages = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect() if r["url"]]
    ordinary = [u for u in pages if not any(w in url_filter.split_url(u)[0] for w in ("spam", "pills", "bets", "adult", "casino", "track"))]
    whole, rng = blocked_share(ordinary), random.Random(7)
    for side in (0, 1, 0, 1):
        gone = set(rng.sample([n for n, (y, _) in enumerate(url_filter.LABELLED) if y == side], 10))
        w = url_filter.train([x for n, x in enumerate(url_filter.LABELLED) if n not in gone])
        assert abs(blocked_share(ordinary, w) - whole) < 0.02


def test_url_features_and_fit_by_hand():
    """Every n-gram once, and gradient descent written out row by row."""
    few = [(1, "http://Pills.test/BUY"), (0, "http://news.test/a"), (0, "no scheme"), (1, "https://casino.test")]
    bucket, lo = url_filter.features(*(pa.array(x, pa.string()) for x in zip(*(url_filter.split_url(u) for _, u in few))))
    grams = [{(tag, t[i : i + n]) for tag, t in (("h", f"^{h}$"), ("p", f"^{p.lower()}$")) for n in url_filter.SIZES for i in range(len(t) - n + 1)} for h, p in (url_filter.split_url(u) for _, u in few)]
    own = [set(bucket[a:z].tolist()) for a, z in zip(lo[:-1], lo[1:])]
    assert [len(x) for x in own] == [len(x) for x in grams] and len(own[0] & own[1]) == len(grams[0] & grams[1])
    w = url_filter.train(few, epochs=20)
    v = collections.Counter()
    for _ in range(20):
        errors = [1 / (1 + math.exp(-(sum(v[k] for k in f) / math.sqrt(max(1, len(f)))))) - y for f, (y, _) in zip(own, few)]
        step = collections.Counter()
        for f, e in zip(own, errors):
            for k in f:
                step[k] += e / math.sqrt(len(f)) / 8
        for k in set(step) | set(v):
            v[k] -= 0.5 * (step[k] + 1e-3 * v[k])
    assert all(w[k] == pytest.approx(x) for k, x in v.items())


def test_url_filter(spark):
    urls = ["http://x.example.net/en/1", "http://example.net/fr/1", "https://NET/", "http://sub.example.com/de/a?b", "http://www.org/fr/x", "http://org/fr", "http://free-casino-poker.example.com/en", None, "no scheme", "http://porn-escort.test.com", "http://news.example.com/2024/a", "ftp://h?q/de/"]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    rules = ["example.net/en/", "net/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert [got[i]["rule"] for i in range(len(urls))] == rules
    assert [got[i]["verdict"] for i in (0, 1, 3, 4, 6, 7, 8, 9, 10)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "block", "allow"]
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"]) == url_filter.split_url(u)


# ---- all of them


def test_clashing_columns(spark):
    """Further columns under the names that the operators use inside change nothing."""
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    odd = pages.withColumns({c: F.lit("x") for c in ("host", "path", "paths", "votes", "rule", "ruled", "record", "salt", "text", "block_probability")})
    for f in (host_paths.main_text, url_filter.judge, lambda p: warc.derivatives(warc.as_responses(p))):
        same = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert same(f(odd)) == same(f(pages))
    docs = spark.createDataFrame([(i, f"word{i % 3} text {i} " * 9) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    extra = {c: F.lit("y") for c in ("label", "score", "bucket", "held_out", "domain", "p", "n_tokens", "rate", "token")}
    for f in (quality_fm.score, soft_mixing.mix):
        assert sorted(map(str, f(docs.withColumns(extra), labels.withColumns(extra)).collect())) == sorted(map(str, f(docs, labels).collect()))


def test_texts_of_20000_words(spark):
    rng = random.Random(20)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    long = text(20_000)
    rows = [(1, long), (2, long + " end"), (3, text(20_000)), (4, "short text here"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    cut = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digests(docs).collect()}
    assert cut == {1: len(long), 2: len(long), 3: 0, 4: 0, 5: 0}
    assert all(r["n_tokens"] == len((t or "").split()) + 1 for r in gru_lm.scores(docs).collect() for i, t in rows if i == r["doc_id"])
    item = spark.createDataFrame([(9, f"{text(40)}. {text(20)}.")], "item_id long, text string")
    holder = docs.union(spark.createDataFrame([(6, f"{text(15_000)} {item.first()['text']} {text(5_000)}")], "doc_id long, text string"))
    assert [r["doc_id"] for r in bm25_decontam.leaks(holder, item).collect()] == [6]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], PAGE_SCHEMA)
    for df in (
        ngram_join.near_duplicates(empty), suffix_dedup.digests(empty), suffix_dedup.remove(empty), winnowing.fingerprints(empty), gru_lm.scores(empty), bm25_decontam.leaks(empty, bench),
        quality_fm.score(empty, labels), soft_mixing.mix(empty, labels), host_paths.main_text(pages), warc.derivatives(warc.as_responses(pages)), url_filter.judge(pages),
    ):
        assert df.count() == 0


def test_no_labels_and_no_benchmark(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_fm.score(docs, labels).count() == len(rows)
    assert soft_mixing.mix(docs, labels).filter(F.col("rate").isNull()).count() == 0
    assert bm25_decontam.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def test_pipeline(spark):
    import corpus_pipeline

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert name == "mixing" or docs.columns == columns
        docs = corpus_pipeline.durable(docs)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[2] and sizes[-1] > 50
    assert corpus_pipeline.run(spark, path).count() == sizes[-1]


def test_a_token_costs_few_bytes_in_many_ranges():
    """In many hash ranges each holds few tokens of a set; what says which set they belong to must stay small beside them, once compressed."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, n)) for n in rng.integers(100, 900, 600)]
    batches = list(ngram_join._postings(10, 5, 1 << 20)([pa.record_batch({"text": texts})]))
    n = sum(len(x.as_buffer()) // 8 for b in batches for x in b.column("tokens"))
    told = sum(len(pa.compress(x.as_buffer(), "lz4_raw", asbytes=True)) for b in batches for c in ("sigs", "sizes") for x in b.column(c))
    assert n > 250_000 and told < 8.2 * n


def test_postings_are_sorted_in_little_memory():
    """What a task takes to sort its postings stays small beside the sets themselves."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 1000))) for _ in range(600)]
    batch = pa.record_batch({"text": texts})
    n = 600 * 996
    tracemalloc.start()
    try:
        out = [b.column("tokens")[0].as_py() for b in ngram_join._postings(3, 5, 1 << 20)([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, out)) == 8 * n
    assert peak < 48 * n


def test_outputs_are_those_of_a_plain_softmax():
    """Also with classes of one word, the tail, and scores to be cut; a step writes where it is told to."""
    rng = np.random.default_rng(5)
    for n, scale in ((5, 1), (300, 1), (300, 60)):
        counts = np.sort((1e6 / np.arange(1, n + 1)).astype(np.int64))[::-1]
        vocabulary = gru_lm.build_vocabulary(np.arange(1, n + 1).astype(np.uint64), counts, int(counts.sum()) + 5000, n + 300, 900)
        net = gru_lm.Network(vocabulary)
        net.word_w *= scale
        h, targets = np.tanh(rng.normal(size=(500, gru_lm.HIDDEN))).astype(np.float32), rng.integers(0, net.tail + 1, 500).astype(np.int32)
        log_class = np.minimum(h @ net.class_w + net.class_b, gru_lm.TOP)
        log_class -= np.log(np.exp(log_class).sum(1, keepdims=True))
        expected = []
        for row, (state, t) in enumerate(zip(h, targets)):
            k = net.klass[t]
            value = log_class[row, k]
            if t < net.tail:
                a, z = net.starts[k], net.starts[k + 1]
                e = np.minimum(net.word_w[a:z] @ state + net.word_b[a:z], gru_lm.TOP)
                value += e[t - a] - np.log(np.exp(e).sum()) if z - a > 1 else 0
            expected.append(value)
        logp, back, grads = net.outputs(h, targets, train=True)
        assert np.allclose(logp, expected, atol=1e-4) and np.allclose(net.outputs(h, targets), expected, atol=1e-4)
        assert np.allclose(grads["class_b"].sum(), 0, atol=1e-2) and np.isfinite(back).all() and grads["word_w"].shape == net.word_w.shape
        gates, cand = net.halves(targets)
        zr, rh, new, after = (np.empty((500, k * gru_lm.HIDDEN), np.float32) for k in (2, 1, 1, 1))
        assert net.step(gates, cand, h, net.u * np.float32(0.5), zr, rh, new, after) is after
        assert np.allclose(after, h + zr[:, : gru_lm.HIDDEN] * (new - h), atol=1e-6)


def test_few_and_many_pairs_give_the_same_links(spark, monkeypatch):
    """Few pairs go to every task, and no other set is moved; many are shuffled."""
    text = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "another text of seven words in all")], "doc_id long, text string")
    for rows in (0, 1 << 18):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
