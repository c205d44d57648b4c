"""Document fingerprints by winnowing: rolling hashes of k-grams, of each window the smallest, the rightmost of ties."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, powers, tidy

#: Every common run of K + WINDOW - 1 code points leaves a common hash in both fingerprints.
K = 16
WINDOW = 16
PARTITION_CHARS = 24 << 20
_LOWEST = -(1 << 63)


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every k-gram, from prefix sums: a window's sum is the difference of two, scaled back to its start."""
    n = len(codes) - k + 1
    if n < 1:
        return mix(np.array([_rolled(codes)], np.uint64), len(codes)) if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = power_tables(len(codes))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[:n])


def _rolled(codes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return ((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes))).sum(dtype=np.uint64)


_POWERS: list = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, kept for the longest text so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = [powers(size, base), powers(size, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def sliding_min(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every `window` consecutive keys, by doubling."""
    width, out = 1, keys
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = window - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 32-bit hashes and their positions (code points), in order. A shorter text is one gram, the empty text none."""
    hashes = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)
    if not len(hashes):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    place = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    low = sliding_min(keys, min(window, len(keys)))
    low = low[np.flatnonzero(np.r_[True, low[1:] != low[:-1]])]
    return (low >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def as_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """16 hex digits for each chosen gram: 8 of its hash, 8 of its position."""
    return np.column_stack([hashes, positions]).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct sorted hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, next text) of a partition's own rows; guests come last, and the first of them follows the last own row."""
    before = None
    for batch in (piece for batch in batches for piece in pieces(batch)):
        for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
            if before is not None:
                yield (*before, text)
            if guest:
                return
            before = (doc_id, text)


def _compare(batches, k: int, window: int):
    out: list[list] = [[] for _ in _OUT]
    size, ahead = 0, None
    for doc_id, text, after in _neighbours(batches):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own = ahead if ahead is not None and ahead[0] == text else (text, *winnow(text, k, window))
        ahead = (after, *winnow(after, k, window))
        other = (edited, *winnow(edited, k, window)) if edited != text else own
        mine, theirs, following = np.unique(own[1]), np.unique(other[1]), np.unique(ahead[1])
        row = (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_string(*own[1:]), as_string(*other[1:]), likeness(mine, theirs), likeness(mine, following))
        for column, value in zip(out, row):
            column.append(value)
        size += len(row[3]) + len(row[4]) + 128
        if size > 8 << 20:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(out, _OUT)], schema=_OUT)
            out, size = [[] for _ in _OUT], 0
    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(out, _OUT)], schema=_OUT)
    tidy()


def places_of(cuts: np.ndarray, ids: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The range of each (id, spread in [0, 1)): an id that takes several cuts is dealt over their ranges in the order of spread."""
    lo, hi = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    return np.where(hi - lo > 1, lo + 1 + np.minimum((spread * (hi - lo)).astype(np.int64), hi - lo - 1), hi).astype(np.int32)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint of every text and of its edited text: the last half replaced by the start of the next document's.

    The next document follows in ascending order of doc_id, nulls first, then of a hash of the text, then of the text; the first
    follows the last. Null texts are empty. Repeated rows are documents of their own, and for one single document the next is
    itself. Empty tables give empty results; further columns are dropped. Positions are those of code points.

    Documents are dealt out by ranges of doc_id, so each text is shuffled once; a doc_id that many rows have (or none) takes several
    ranges, by the hash. The first document of each range also goes to the range before it. A task reads its range in order and holds
    a slice of it and two documents' fingerprints at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(_LOWEST))
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = int(min(1 << 16, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // PARTITION_CHARS)))
    at = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (2 * parts)) if parts > 1 else []
    cuts = np.array(at, np.float64).astype(np.int64)
    rank = F.xxhash64("text")

    def spread(ranks: pa.Array) -> np.ndarray:
        return ranks.to_numpy(zero_copy_only=False) / 2.0**64 + 0.5

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, ranks: pa.Array) -> pa.Array:
        return pa.array(places_of(cuts, ids.to_numpy(zero_copy_only=False), spread(ranks)), pa.int32())

    keyed = docs.withColumns({"key": key, "rank": rank}).withColumn("part", part_of("key", "rank"))
    heads = keyed.groupBy("part").agg(F.min(F.struct("key", "rank")).alias("head")).orderBy("part").collect()  # a row for each range
    first = {(h["head"]["key"], h["head"]["rank"]): heads[i - 1]["part"] for i, h in enumerate(heads)}
    earliest = (heads[0]["head"]["key"], heads[0]["head"]["rank"]) if heads else None

    @F.arrow_udf("array<struct<part:int,guest:int>>")
    def places(parts: pa.Array, ids: pa.Array, ranks: pa.Array) -> pa.Array:
        out = [[{"part": p, "guest": 0}] for p in parts.to_pylist()]
        for own, i, r in zip(out, ids.to_pylist(), ranks.to_pylist()):
            if (i, r) in first:
                own.append({"part": first[i, r], "guest": 2 if (i, r) == earliest else 1})
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("guest", pa.int32())])))

    dealt = keyed.withColumn("place", F.explode(places("part", "key", "rank"))).select("doc_id", "text", "rank", "place.part", "place.guest")
    ordered = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("guest", F.asc_nulls_first("doc_id"), "rank", "text")
    return ordered.select("doc_id", "text", "guest").mapInArrow(lambda batches: _compare(batches, k, window), _OUT_DDL)
