"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, and an overlap check.

A term's impact on an item is its share of the score that the item's own text has. Every passage of the documents is a query. The
passages of a batch first add up the impacts of items' rare terms together: an item of whose score all other terms make too
little to pass alone needs some of these. Where the sum and those others leave any item a chance, the passage's posting lists are
gone through by block-max WAND.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, distinct, durable, grams, pieces, runs, text_bytes, tidy, unused, without, words

K1, B = 1.2, 0.75
#: A passage is retrieved for an item at this share of the score that the item's own text has.
THRESHOLD = 0.5
#: Shares of the question's and of the answer's word n-grams that a passage must hold.
QUESTION, ANSWER, GRAM = 0.5, 0.5, 5
#: Postings in a block with a maximum of its own.
BLOCK = 8
#: An item's frequent terms, as long as they make this share of the threshold together, don't bring the item up by themselves.
FREQUENT = 0.5
#: Items in one index; a larger benchmark is taken in several passes over the documents.
MAX_ITEMS = 4096
#: Words of a passage at least; it holds twice the longest item, so that a copy lies within one passage wherever it starts.
PASSAGE = 64


@dataclass
class Whole:
    """What the scores of a part of a benchmark take from all of its items."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray  # sorted, at least those of the part
    df: np.ndarray


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes of all terms
    lists: list[tuple]  # of each term: items in ascending order, impacts, the largest impact, each block's last item and largest impact
    rare_lo: np.ndarray  # where each term's rare postings start
    rare_items: np.ndarray
    rare_impacts: np.ndarray
    rest: np.ndarray  # of each item: the sum of the impacts that are no rare postings
    item_ids: list
    parts: list[tuple[int, np.ndarray, np.ndarray]]  # gram size, grams of question and answer
    passage: int


def split_item(text: str) -> tuple[str, str]:
    """The answer is the last sentences with at least three words and a fifth of all words; without another one, all is both."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    size, need = 0, max(3, len(text.split()) / 5)
    for k in range(len(sentences) - 1, 0, -1):
        size += len(sentences[k].split())
        if size >= need:
            return " ".join(sentences[:k]), " ".join(sentences[k:])
    return text, text


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts and their offsets, without punctuation."""
    return folded_words(pa.array(texts, pa.large_string()))


def folded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (any script) of a text column, and each text's offsets among them."""
    _, _, at, h = words(*text_bytes(pc.utf8_lower(column)), PUNCTUATION)
    return h, at


def build(items: list[tuple], k1: float = K1, b: float = B, whole: Whole | None = None, threshold: float = THRESHOLD) -> Index:
    """Index of (item_id, text) rows, all or a part of them, for one threshold. Null and wordless texts match nothing and are left out."""
    items = [(i, t) for i, t in items if t and len(hashed([t])[0])]
    h, at = hashed([t for _, t in items])
    lengths = np.diff(at)
    terms, term = np.unique(h, return_inverse=True)
    item = np.repeat(np.arange(len(items)), lengths)
    pair, tf = np.unique(item.astype(np.int64) * max(1, len(terms)) + term, return_counts=True)
    item, term = pair // max(1, len(terms)), pair % max(1, len(terms))
    df = np.bincount(term, minlength=len(terms))
    if whole is None:
        whole = Whole(len(items), float(lengths.mean()) if len(items) else 1.0, int(lengths.max()) if len(items) else 0, terms, df)
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log1p((whole.items - df + 0.5) / (df + 0.5))
    norm = k1 * (1 - b + b * lengths / max(1.0, whole.mean))
    impact = idf[term] * tf * (k1 + 1) / (tf + norm[item])
    impact = impact / np.bincount(item, impact, len(items))[item]
    # an item's terms from the most frequent on, as long as their sum is small, are not rare
    order = np.lexsort((term, -df[term], item))
    before = np.cumsum(impact[order]) - impact[order]
    within = before - before[runs(item[order])][item[order]] + impact[order] if len(items) else before
    rare = np.ones(len(item), bool)
    rare[order[within <= FREQUENT * threshold]] = False
    rest = np.bincount(item[~rare], impact[~rare], len(items))
    order = np.lexsort((item, term))
    item, term, impact, rare = item[order], term[order], impact[order], rare[order]
    cut = np.searchsorted(term, np.arange(len(terms) + 1)).tolist()
    lists = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        blocks = [(lo + k, min(hi, lo + k + BLOCK)) for k in range(0, hi - lo, BLOCK)]
        lists.append((item[lo:hi].tolist(), impact[lo:hi].tolist(), float(impact[lo:hi].max()), [int(item[z - 1]) for _, z in blocks], [float(impact[a:z].max()) for a, z in blocks]))
    parts = []
    for _, text in items:
        q, a = (hashed([x])[0] for x in split_item(text))
        n = max(1, min(GRAM, len(q) or GRAM, len(a) or GRAM))
        parts.append((n, *(np.unique(grams(x, np.array([0, len(x)]), n)[0]) for x in (q, a))))
    passage = max(PASSAGE, 2 * whole.longest)
    return Index(terms, lists, np.searchsorted(term[rare], np.arange(len(terms) + 1)), item[rare], impact[rare], rest, [i for i, _ in items], parts, passage)


def wand(lists: list[tuple], threshold: float) -> list[tuple[int, float]]:
    """Items and their scores of at least the threshold, from a query's posting lists.

    Each list has a cursor. In the order of the cursors' items, the list whose largest impact brings the sum of these to the
    threshold gives the pivot: no item before it can pass. If the blocks that the cursors' lists have there can't bring the pivot
    to the threshold, neither can any item up to the nearest of their ends, and the cursors skip all of them; else they go up to
    the pivot, which is scored once all stand there.
    """
    out = []
    heads = sorted((own[0][0], k, 0) for k, own in enumerate(lists))
    while heads:
        bound, upto = 0.0, 0
        for upto, (_, k, _) in enumerate(heads, 1):
            bound += lists[k][2]
            if bound >= threshold:
                break
        else:
            return out
        pivot = heads[upto - 1][0]
        while upto < len(heads) and heads[upto][0] == pivot:
            upto += 1
        bound, nearest = 0.0, pivot
        ends = []
        for _, k, _ in heads[:upto]:
            _, _, _, last, most = lists[k]
            block = bisect_left(last, pivot)
            if block < len(last):
                bound += most[block]
                ends.append(last[block])
        if bound < threshold:
            nearest = min(ends) + 1 if ends else pivot + 1
            if upto < len(heads):
                nearest = min(nearest, heads[upto][0])
        elif heads[0][0] == pivot:
            total = sum(lists[k][1][at] for _, k, at in heads[:upto])
            if total >= threshold:
                out.append((pivot, total))
            nearest = pivot + 1
        moved = []
        for item, k, at in heads[:upto]:
            if item < nearest:
                at = bisect_left(lists[k][0], nearest, at)
                if at == len(lists[k][0]):
                    continue
                item = lists[k][0][at]
            moved.append((item, k, at))
        heads = sorted(moved + heads[upto:])
    return out


def search(index: Index, h: np.ndarray, doc_words: np.ndarray, threshold: float = THRESHOLD):
    """Every (document, first word, word after the last, item, score) of passages with at least the threshold.

    Passages are windows of index.passage words, each starting half a window after the one before; a last half window belongs to the
    one before. A passage's query is its set of terms.
    """
    out = []
    if not len(index.terms) or not len(h):
        return out
    half, n_items = index.passage // 2, len(index.item_ids)
    halves = -(-np.diff(doc_words) // half)
    first = np.cumsum(halves) - halves
    term = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    at = np.flatnonzero(index.terms[term] == h)
    term = term[at]
    doc = np.searchsorted(doc_words, at, "right") - 1
    cell = (at - doc_words[doc]) // half
    alone = halves[doc] == 1
    # a word counts for the passage that starts with its half window, and for the one that ends with it
    opens, ends = alone | (cell < halves[doc] - 1), cell > 0
    passage = np.r_[(first[doc] + cell)[opens], (first[doc] + cell - 1)[ends]]
    key = distinct(passage * len(index.terms) + np.r_[term[opens], term[ends]])
    passage, term = key // len(index.terms), key % len(index.terms)
    # rare postings, added up for each passage and item
    n = np.diff(index.rare_lo)[term]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.rare_lo[term], n)
    pair = np.repeat(passage, n) * n_items + index.rare_items[at]
    order = np.argsort(pair, kind="stable")
    lo = runs(pair[order])
    if not len(lo):
        return out
    pair, total = pair[order[lo]], np.add.reduceat(index.rare_impacts[at[order]], lo)
    slack = 1e-9
    open_ = distinct(pair[total + index.rest[pair % n_items] >= threshold - slack] // n_items)
    starts, stops = np.searchsorted(passage, open_), np.searchsorted(passage, open_, "right")
    filled = np.flatnonzero(halves)
    of = filled[np.searchsorted(first[filled], open_, "right") - 1]
    for p, d, a, z in zip(open_.tolist(), of.tolist(), starts.tolist(), stops.tolist()):
        found = wand([index.lists[t] for t in term[a:z].tolist()], threshold - slack)
        begin = int(doc_words[d] + (p - first[d]) * half)
        out += [(d, begin, int(min(begin + 2 * half, doc_words[d + 1])), item, total) for item, total in found]
    return out


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_HITS_DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _leaks(index: Index, threshold: float, question: float, answer: float):
    def verified(batches):
        for batch in batches:
            for piece in pieces(batch):
                h, doc_words = folded_words(piece.column("text"))
                ids, out = piece.column("doc_id"), []
                for d, a, z, item, score in search(index, h, doc_words, threshold):
                    n, q, r = index.parts[item]
                    own = distinct(grams(h[a:z], np.array([0, z - a]), n)[0])
                    shares = [float(np.isin(x, own, assume_unique=True).mean()) if len(x) else 0.0 for x in (q, r)]
                    if shares[0] >= question and shares[1] >= answer:
                        out.append((ids[d].as_py(), index.item_ids[item], score, *shares))
                if out:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), _HITS)], schema=_HITS)
        tidy()

    return verified


def _item_words(batches):
    """Each item's number of words, with a null term, and its distinct terms."""
    for batch in batches:
        h, at = folded_words(batch.column("text"))
        for a, z in zip(at[:-1], at[1:]):
            if z > a:
                own = distinct(h[a:z])
                yield pa.record_batch({"term": pa.array([None, *own.view(np.int64)], pa.int64()), "n": pa.array([z - a, *[1] * len(own)], pa.int64())})


def _wholes(items: DataFrame, parts: list[DataFrame]):
    """The Whole of each part: figures of all items, and the document frequencies of the part's own terms."""
    found = durable(items.select("text").mapInArrow(_item_words, "term long, n long").groupBy("term").agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")))
    total = found.filter("term IS NULL").first()
    for part in parts:
        own = part.select("text").mapInArrow(_item_words, "term long, n long").select("term").distinct()
        table = found.join(own, "term", "left_semi").select("term", "items").toArrow()  # the words of one part; nulls don't join
        terms, df = table.column("term").to_numpy().view(np.uint64), table.column("items").to_numpy()
        order = np.argsort(terms)
        yield Whole(total["items"], total["words"] / total["items"], total["longest"], terms[order], df[order]) if total else None


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, n_passages: what each document holds of which test item.

    Every passage of every text queries the index; a leak is a passage above the BM25 threshold that also holds the given shares
    of the item's question and of its answer. Of a document's passages for an item the largest figures are given. Null and
    wordless texts and items match nothing, rows with one doc_id count as one document, repeated items each match, empty tables
    give empty results, and further columns are dropped.

    An index of at most `max_items` items goes to the tasks; a larger benchmark is split by item and takes several passes, which
    score by the figures of all items.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = items.count()
    shards = max(1, -(-n // max_items))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    owns = [items] if shards == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k) for k in range(shards)]
    for own, whole in zip(owns, [None] if shards == 1 else _wholes(items, owns)):
        index = build([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()], whole=whole, threshold=threshold)
        part = texts.mapInArrow(_leaks(index, threshold, question, answer), _HITS_DDL)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")), F.count("*").alias("n_passages"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without those whose doc_id leaks a test item. Rows with a null doc_id stay."""
    name = unused(docs, "leaking")
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return without(docs, durable(bad), F.col("doc_id") == F.col(name))
