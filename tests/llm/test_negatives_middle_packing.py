"""Hard negatives, fill-in-middle and packing against brute force, on tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, corpus
from tokenizers import Tokenizer

from melisma.llm import best_fit_packing, fill_in_middle, vp_negatives

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "id long, label int, anchor boolean, vector array<float>, row int, leaf string"


def by_hand(rows, k, positives, low, high, scale):
    """All negatives of all positives of all anchors, from all scores."""
    whole = []
    for i, label, anchor, v, *_ in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]
        if sum(x * x for x in v) < vp_negatives.MOST_NORM:
            whole.append((i, label, anchor, v))
    order = lambda hit: (-hit[0], hit[1] is None, hit[1] or 0, hit[2])
    out = []
    for n, (i, label, anchor, v) in enumerate(whole):
        if not anchor:
            continue
        hits = [(sum(x * y for x, y in zip(v, w)), j, m, other) for m, (j, other, _, w) in enumerate(whole) if m != n]
        for p in sorted((h for h in hits if h[3] == label), key=order)[:positives]:
            fits = sorted((h for h in hits if h[3] != label and low * p[0] <= 100 * h[0] <= high * p[0]), key=order)
            out += [(i, p[1], rank, h[1], p[0], h[0]) for rank, h in enumerate(fits[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed, n, dims=6):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(dims)]
    out = []
    for i in range(n):
        v = hot if rng.random() < 0.35 else [rng.gauss(0, 1) * rng.choice([0.2, 1, 3]) for _ in range(dims)]
        out.append((i, rng.randrange(4), i % 9 == 0, v, i, "x"))
    out += [out[9], out[9], out[10], (None, 1, True, hot, 0, ""), (7, None, True, hot, 0, ""), (8, 2, True, None, 0, ""), (11, 1, None, hot, 0, "")]
    out += [(12, 1, True, [1.0, None] + hot[2:], 0, ""), (13, 1, True, [float("nan")] + hot[1:], 0, ""), (14, 1, True, [float("inf")] + hot[1:], 0, ""), (15, 0, True, [0.0] * dims, 0, "")]
    return out + [(16, 2, True, hot[:3], 0, ""), (17, 3, False, [], 0, ""), (18, 1, True, [3e38] * dims, 0, ""), (19, 99, True, hot, 0, "")]


@pytest.mark.parametrize(("n", "shard_rows", "leaf_rows"), [(60, 1 << 15, 256), (400, 60, 8), (300, 7, 3)])
def test_hard_negatives(spark, monkeypatch, n, shard_rows, leaf_rows):
    monkeypatch.setattr(vp_negatives, "BLOCK", 5)
    rows = vectors(n, n)
    found = vp_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), scale=16.0, shard_rows=shard_rows, leaf_rows=leaf_rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows, 5, 5, 80, 100, 16.0)


def test_hard_negatives_of_odd_tables(spark):
    assert vp_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    alone = [(0, 1, True, [1.0, 2.0], 0, ""), (1, 2, False, [1.0, 2.0], 0, "")]
    assert vp_negatives.hard_negatives(spark.createDataFrame(alone, VECTORS)).collect() == []  # no positive
    below = [(0, 1, True, [1.0], 0, ""), (1, 1, False, [-4.0], 0, ""), (2, 2, False, [-4.0], 0, "")]
    assert vp_negatives.hard_negatives(spark.createDataFrame(below, VECTORS)).collect() == []  # no window below zero


def test_shard_gives_rows_nearest_first_and_opens_few():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (40, 8))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 9, (4000, 8))).astype(np.int32)
    norms, labels = (x.astype(float) ** 2).sum(1), rng.integers(0, 3, 4000)
    top = norms.max()
    shard = vp_negatives.Shard.read(vp_negatives.Shard.build(x, norms, labels, list(range(4000)), np.arange(4000), top, 32).blob())
    opened = 0
    for i in range(0, 4000, 400):
        scores = (x.astype(np.int64) @ x[i].astype(np.int64)).tolist()
        window = (int(norms[i] * 0.9), int(norms[i]))
        anchor = vp_negatives.Anchor(i, int(labels[i]), x[i].astype(float), int(norms[i] + top), shard.tree.from_anchors(x[i : i + 1].astype(float), norms[i : i + 1])[0].tolist(), 5)
        want = sorted((-s, j) for j, s in enumerate(scores) if labels[j] != labels[i] and window[0] <= s <= window[1])[:5]
        got = [(-s, j) for (_, j, s), _ in zip(shard.nearest_first(anchor, window, False), range(5))]
        assert got == want
        opened += len(anchor.scores)
    assert opened < 0.4 * 10 * len(shard.tree.leaves)


def middle_by_hand(doc_id, text):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts(seed, n):
    rng = random.Random(seed)
    alphabet = [*" \t\n\x0b\x0c\r\x1c\x85 　", *"ab<>PSM", "é", "日", "𝄞", "<P", "S>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_fill_in_middle(spark):
    texts = [(i, t, "en", "s", len(t), 1, "c") for i, t in enumerate(odd_texts(2, 300))]
    rows = corpus() + texts + [(None, "a null id, twice", None, None, None, None, None)] * 2 + [(5000 + i, f"{a} b {c}", "", "", 0, 0, "") for i, a in enumerate("<P> <P <".split()) for c in ("<S>", ">")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fill_in_middle.transform(docs)
    got = collections.Counter(tuple(r) for r in made.collect())
    assert got == collections.Counter((r[0], *middle_by_hand(r[0], r[1] or "")) for r in rows)
    assert {r["form"] for r in made.collect()} == {"plain", "spm", "psm"}
    back = made.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((r[0], r[1] or "") for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = collections.Counter((r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in fill_in_middle.digests(docs).collect())
    assert digests == collections.Counter((r[0], sha(middle_by_hand(r[0], r[1] or "")[4]), sha(r[1] or "")) for r in rows)


def test_fill_in_middle_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_in_middle.digests(empty).collect() == []


def pieces_by_hand(rows, room):
    model, out = Tokenizer.from_file(VOCABULARY), []
    for doc_id, text, *_ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % room + 1
        for k, a in enumerate([0, *range(first, len(ids), room)]):
            own = np.array(ids[a : first if k == 0 else a + room], "<u4")
            out.append((doc_id, k, a, len(own), zlib.crc32(own.tobytes())))
    return out


@pytest.mark.parametrize("room", [1024, 64])
def test_packing(spark, room):
    rows = corpus() + [(9000 + i, None, "", "", 0, 0, "") for i in range(90)]
    got = best_fit_packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), VOCABULARY, room).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(pieces_by_hand(rows, room))
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    assert len(held) <= 1.01 * -(-sum(r["length"] for r in got) // room) + 1
    assert sorted(held) == list(range(len(held)))


def test_sequences_hold_the_ids(spark):
    rows = [(i, t, "", "", 0, 0, "") for i, t in enumerate(["one two three", "four " * 40, "", None, "five <|endoftext|> six", "é日" * 30])]
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = best_fit_packing.pack(docs, VOCABULARY, 32)
    made = {r["sequence_id"]: r["ids"] for r in best_fit_packing.sequences(docs, packed, VOCABULARY).collect()}
    for r in packed.collect():
        own = np.array(made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
    assert sum(map(len, made.values())) == sum(r["length"] for r in packed.collect())
    assert best_fit_packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def fewest(lengths, room):
    """The least number of sequences, by trying all places for each piece."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for gap in {b for b in bins if b >= lengths[i]}:
            rest = list(bins)
            rest.remove(gap)
            put(i + 1, [*rest, gap - lengths[i]])
        put(i + 1, [*bins, room - lengths[i]])

    put(0, [])
    return best[0]


def test_plans_are_near_the_best():
    rng = random.Random(4)
    worse = 0
    for _ in range(150):
        room = rng.choice([8, 12, 20])
        lengths = [rng.randint(1, room) for _ in range(rng.randrange(1, 9))]
        n = sum(times for _, times in best_fit_packing.patterns(np.bincount(lengths, minlength=room + 1)))
        assert n >= fewest(lengths, room)
        worse += n - fewest(lengths, room)
    assert worse <= 5


def test_plans_use_singles_pairs_triples_and_best_fit():
    of = lambda lengths, room=20: sorted((sorted(x for x, c in p for _ in range(c)), n) for p, n in best_fit_packing.patterns(np.bincount(lengths, minlength=room + 1)))
    assert of([13, 7, 7, 5, 2]) == [([2, 5, 7], 1), ([7, 13], 1)]
    assert of([13, 4, 3, 6]) == [([3, 4, 13], 1), ([6], 1)]
    assert of([11, 4, 3, 2]) == [([2, 3, 4, 11], 1)]
    assert of([12, 12, 4, 4, 4, 4]) == [([4, 4, 12], 2)]
    assert of([12, 7, 5]) == [([5], 1), ([7, 12], 1)]  # no complement: the longest that fits
    assert of([20] * 3 + [1] * 45) == [([1] * 5, 1), ([1] * 20, 2), ([20], 3)]


def test_a_hot_length_is_planned_in_few_patterns():
    counts = np.zeros(1025, np.int64)
    counts[[1, 1024, 1023, 700, 324, 100]] = [10**12, 10**11, 5 * 10**10, 10**10, 10**9, 3]
    planned = best_fit_packing.plan(counts)
    assert len(planned.keys) < 60
    assert planned.n_sequences == counts[513:].sum()  # each of these needs a sequence of its own
    sequences, places = planned.place(np.array([1, 1]), np.array([0, 10**12 - 1]))
    assert sequences.max() < planned.n_sequences and (places < 1024).all()
