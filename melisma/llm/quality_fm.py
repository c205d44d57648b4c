"""Quality classifier: a factorisation machine over hashed words, structure statistics and a row's metadata.

Of the metadata the stated number of characters counts (n_chars, where there is such a column): itself, whether it is missing, and
how far it is from the text's own. Language, source, identifiers and labels are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, runs, text_bytes, tidy, words

BITS = 14
RANK = 8
STATS = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "letter", "wide", "bar", "bang", "symbol", "stop_comma", "lines",
    "distinct_words", "top_word", "repeated_lines", "symbol_ended_words", "stated_chars", "unstated", "misstated",
)
#: At most so many labelled rows (those with the smallest hashes of doc_id) are gathered to fit the machine.
MAX_LABELLED = 6000
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[ord("|")], _CLASS[ord("!")], _CLASS[[44, 46]], _CLASS[10] = 1, 2, 3, 4, 5, 6, 8, 9
_CLASS[[ord(c) for c in "#$%&*@^~=<>{}[]\\_+"]] = 7


@dataclass
class Machine:
    """w0 + Σ w_i x_i + ½ Σ_f ((Σ v_if x_i)² - Σ v_if² x_i²), and the means and deviations of the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % 5 == 0


def features_of(piece: pa.RecordBatch):
    """featurize() of a batch's text and n_chars."""
    stated = piece.column("n_chars")
    return featurize(*text_bytes(piece.column("text")), np.where(stated.is_valid().to_numpy(zero_copy_only=False), stated.fill_null(0.0).to_numpy(), np.nan))


def inputs(docs: DataFrame) -> list[Column]:
    """What a score is made of: text, and n_chars as a number (null without such a column)."""
    stated = F.col("n_chars").cast("string").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col("text").cast("string").alias("text"), F.when(stated >= 0, stated).alias("n_chars")]


def featurize(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray):
    """For each text: distinct word buckets with L2-normalised root counts (flat, with offsets), and its statistics."""
    n = len(offsets) - 1
    starts, ends, doc_words, h = words(data, offsets)
    counts = np.diff(doc_words)
    key = np.sort((np.repeat(np.arange(n, dtype=np.int64), counts) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    at = runs(key)
    x = np.sqrt(np.diff(np.r_[at, len(key)]).astype(np.float64))
    key = key[at]
    own, bucket = key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)
    lo = np.searchsorted(own, np.arange(n + 1))
    norm = np.sqrt(np.bincount(own, x * x, n))
    x = x / np.maximum(norm[own], 1e-9)
    size = np.maximum(np.diff(offsets), 1)
    kinds = _CLASS[data]
    share = lambda k: np.diff(np.r_[0, np.cumsum(kinds == k)][offsets]) / size
    lines = np.diff(np.r_[0, np.cumsum(kinds == 9)][offsets])
    per = np.maximum(counts, 1)
    top = np.zeros(n)
    if len(own):
        filled = np.flatnonzero(np.diff(lo))
        top[filled] = np.maximum.reduceat(np.square(x * norm[own]), lo[:-1][filled])
    ended = np.zeros(n)
    if len(ends):
        last = kinds[ends - 1]
        ended = np.diff(np.r_[0, np.cumsum((last == 6) | (last == 7))][doc_words]) / per
    chars = np.diff(np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets])  # bytes that begin a character
    missing = np.isnan(stated)
    told = np.log1p(np.where(missing, chars, stated))
    stats = np.column_stack([
        np.log1p(np.diff(offsets)), np.log1p(counts), np.diff(np.r_[0, np.cumsum(ends - starts)][doc_words]) / per,
        share(1), share(3), share(2), share(4), share(5), share(6), share(7), share(8), lines / per,
        np.diff(lo) / per, top / per, np.log1p(lines) / np.log1p(per + 1), ended,
        told, missing, np.minimum(np.abs(told - np.log1p(chars)), 4),
    ])
    return bucket, x, lo, stats


def margins(m: Machine, bucket: np.ndarray, x: np.ndarray, lo: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """The machine's values, in time linear in the features by the sum-of-squares identity."""
    n = len(stats)
    own = np.repeat(np.arange(n), np.diff(lo))
    z = np.clip((stats - m.mean) / m.deviation, -4, 4)
    w, v, ws, vs = m.w[: 1 << BITS], m.v[: 1 << BITS], m.w[1 << BITS :], m.v[1 << BITS :]
    out = m.w0 + np.bincount(own, w[bucket] * x, n) + z @ ws
    for f in range(m.v.shape[1]):
        vx = v[bucket, f] * x
        total = np.bincount(own, vx, n) + z @ vs[:, f]
        out += 0.5 * (total**2 - np.bincount(own, vx * vx, n) - (z * z) @ (vs[:, f] ** 2))
    return out


def fit(samples: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.05, l2: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the log-loss over (label, buckets, values, statistics) rows, in minibatches of 32."""
    rng = np.random.default_rng(seed)
    width = (1 << BITS) + len(STATS)
    stats = np.array([s for *_, s in samples]).reshape(-1, len(STATS))
    y = np.array([s[0] for s in samples], float)
    mean, deviation = (stats.mean(0), stats.std(0) + 1e-6) if len(y) else (np.zeros(len(STATS)), np.ones(len(STATS)))
    prior = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(width), rng.normal(0, 0.02, (width, RANK)), mean, deviation)
    gw, gv, g0 = np.full(width, 1e-4), np.full((width, RANK), 1e-4), 1e-4
    z = np.clip((stats - mean) / deviation, -4, 4)
    tail = np.arange(1 << BITS, width)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(order), 32):
            rows = order[begin : begin + 32]
            index = np.concatenate([np.r_[samples[r][1], tail] for r in rows])
            value = np.concatenate([np.r_[samples[r][2], z[r]] for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(samples[r][1]) + len(tail) for r in rows])
            vx = m.v[index] * value[:, None]
            total = np.column_stack([np.bincount(own, vx[:, f], len(rows)) for f in range(RANK)])
            square = np.column_stack([np.bincount(own, vx[:, f] ** 2, len(rows)) for f in range(RANK)])
            margin = m.w0 + np.bincount(own, m.w[index] * value, len(rows)) + 0.5 * (total**2 - square).sum(1)
            e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            near, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, e[own] * value, len(near)) + l2 * m.w[near]
            dv = (e[own] * value)[:, None] * (total[own] - vx)
            dv = np.column_stack([np.bincount(place, dv[:, f], len(near)) for f in range(RANK)]) + l2 * m.v[near]
            gw[near] += dw**2
            gv[near] += dv**2
            g0 += e.sum() ** 2
            m.w[near] -= rate * dw / np.sqrt(gw[near])
            m.v[near] -= rate * dv / np.sqrt(gv[near])
            m.w0 -= rate * e.sum() / np.sqrt(g0)
    return m


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bucket", pa.binary()), ("x", pa.binary()), ("stats", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _sampled(batches):
    for batch in batches:
        for piece in pieces(batch):
            bucket, x, lo, stats = features_of(piece)
            cut = [(lo[i], lo[i + 1]) for i in range(piece.num_rows)]
            yield pa.record_batch([
                piece.column("doc_id"), piece.column("label"),
                pa.array([bucket[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([x[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary()),
                pa.array([s.tobytes() for s in stats], pa.binary()),
            ], schema=_SAMPLE)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on at most `max_labelled` labelled texts: those with the smallest hashes of doc_id.

    Rows with a null label or doc_id teach nothing; of several labels for a doc_id the largest counts; of several texts with
    one doc_id each counts, within the bound.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = chosen.collect()
    table = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, label int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *inputs(docs)).join(F.broadcast(table), "doc_id")  # bounded by max_labelled
    found = found.select("doc_id", "label", "text", "n_chars").mapInArrow(_sampled, "doc_id long, label int, bucket binary, x binary, stats binary")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "stats", "label").limit(max_labelled).collect()
    return fit([(r["label"], np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["x"], np.float32).astype(float), np.frombuffer(r["stats"])) for r in got])


def score(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; nothing but the text and n_chars enters a score.

    Null and empty texts are scored by the bias and the statistics of the empty text; an n_chars that is null, negative or no number
    counts as missing. Repeated rows give repeated results. With
    no labels the score is the prior 0.5. An empty table gives an empty result; further columns are dropped.
    """
    held = held_out()
    train = labels.filter(~held if train_rows is None else train_rows)
    machine = learn(docs, train, max_labelled)

    def scored(batches):
        for batch in batches:
            for piece in pieces(batch):
                value = margins(machine, *features_of(piece))
                yield pa.record_batch([piece.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))], schema=_SCORES)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *inputs(docs)).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, all columns, that score() would predict as good. Rows are filtered where they are read."""
    machine = learn(docs, labels.filter(~held_out() if train_rows is None else train_rows), max_labelled)
    least = float(np.log(threshold / (1 - threshold)))

    columns = [f"c{k}" for k in range(len(docs.columns))]
    names = docs.columns

    def kept(batches):
        for batch in batches:
            for piece in pieces(batch):
                rows = pa.record_batch([piece.column(c) for c in columns], names=names)
                yield rows.filter(pa.array(margins(machine, *features_of(piece)) >= least))
        tidy()

    return docs.select(*(F.col(f"`{name}`").alias(c) for name, c in zip(names, columns)), *inputs(docs)).mapInArrow(kept, docs.schema)
