"""Removal of repeated byte strings: suffix arrays for each shard, Kasai's common prefixes, shards merged by binary search.

Windows of bytes are dealt to shards by content, so that equal windows meet: each belongs to the chunk around the smallest
64-byte gram hash in it (the rightmost of ties). An anchor that occurs once has no repeated window. A shard is a range of
anchors. Equal chunks are counted, which settles them; where an anchor also has a single chunk, one of each goes to its shard.
These get suffix arrays in blocks of bounded size, and the longest prefix that each window shares with another one is read from
them. Where one anchor's chunks fill several blocks, the windows of each block are looked up in the other blocks' arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, durable, mix, pieces, raw, rows, runs, text_bytes, tidy
from .winnowing import power_tables

LENGTH = 400
#: Repeated strings from this many bytes on are put together to passages, which count if they hold more words than that.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
GRAM = 64
BLOCK_BYTES = 512 << 10
PIECE_BYTES = 128 << 10
#: Stands between chunks: no byte of UTF-8.
BETWEEN = b"\xff"
_STEPS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all runs of `size` bytes (a power of two): twice as long ones from two neighbours."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while width < size:
            h = h[:-width] * np.uint64(base) + h[width:] if len(h) > width else h[:0]
            width, base = 2 * width, base * base % (1 << 64)
    return mix(h)


def lowest(keys: np.ndarray, widths: list[int]):
    """Minimum of every `width` consecutive keys, for ascending widths: each doubling serves all of them."""
    have, out = 1, keys
    for width in widths:
        while 2 * have <= width:
            out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
            have *= 2
        rest = width - have
        yield np.minimum(out[: max(0, len(out) - rest)], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, own_hash: bool = True):
    """For each length the chunks of windows with one anchor: the text, the first window's start, the windows, the anchor's hash, the chunk's own."""
    hashes = gram_hashes(data, gram)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    if own_hash:
        up, down = power_tables(len(hashes))
        total = np.zeros(len(hashes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    for length, low in zip(lengths, lowest(key, [length - gram + 1 for length in lengths])):
        windows = np.maximum(np.diff(offsets) - length + 1, 0)
        filled = windows > 0
        first, after = offsets[:-1][filled], (offsets[:-1] + windows)[filled]
        inside = np.zeros(len(low) + 1, np.int8)
        inside[first] += 1
        inside[after] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        new = inside.copy()
        new[1:] &= low[1:] != low[:-1]
        new[first] = True
        start = np.flatnonzero(new)
        doc = np.searchsorted(offsets, start, "right") - 1
        count = np.minimum(np.r_[start[1:], len(low)], (offsets[:-1] + windows)[doc]) - start
        place = (np.uint64(0xFFFFFFFF) - (low[start] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        own = np.zeros(0, np.uint64)
        if own_hash:
            size = count + length - 1
            with np.errstate(over="ignore"):
                own = mix((total[start + size - gram + 1] - total[start]) * down[start] + size.astype(np.uint64))
        yield doc, start, count, mix(hashes[place], length), own


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, in the order of the bytes; zeros follow the last."""
    out = np.zeros(len(data) + 8, np.uint64)
    out[: len(data)] = data
    for width in (1, 2, 4):
        out[:-width] = (out[:-width] << np.uint64(8 * width)) | out[width:]
    return out[: len(data)]


def suffix_array(key: np.ndarray, place: np.ndarray, count: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text in the order of their suffixes' first `depth` bytes, and ranks, which ties share; exact for windows' starts.

    key: eights() of the text; place and count: each byte's place in its chunk and that chunk's windows. Larsson and Sadakane's
    refinement: suffixes ordered by h bytes are ordered by 2 h through the ranks of their continuations, and groups of one
    suffix are not touched again. For windows at p < count the order by 2 h bytes is asked for where p is 0 to count - 1 modulo
    2 h; other suffixes stay as they are.
    """
    n = len(key)
    order = np.argsort(key).astype(np.int32)
    lo = runs(key[order])
    size = np.diff(np.r_[lo, n])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(lo.astype(np.int32), size)
    slots = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while h < depth and len(slots):
        member = order[slots]
        asked = place[member] % (2 * h) < count[member]
        slots, member = slots[asked], member[asked]
        after = np.minimum(member.astype(np.int64) + h, n)
        beyond = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = (rank[member].astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64)
        by = np.argsort(both)
        member, both = member[by], both[by]
        order[slots] = member
        lo = runs(both)
        size = np.diff(np.r_[lo, len(slots)])
        rank[member] = np.repeat(slots[lo], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def same_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes pairs of eights() have in common."""
    d = x ^ y
    out = np.full(len(d), 7, np.int32)
    for step in _STEPS:
        out -= d >= step
    out[d == 0] = 8
    return out


class Block:
    """Chunks of one shard: their text, the order of their windows, and the longest prefix that each window shares with another.

    chunks: text and number of windows (the first so many places).
    """

    def __init__(self, chunks: list[tuple[bytes, int]], depth: int = LENGTH):
        self.depth = depth
        sizes = np.array([len(c) + 1 for c, _ in chunks], np.int32)
        self.starts = np.cumsum(sizes, dtype=np.int32) - sizes
        self.counts = np.array([n for _, n in chunks], np.int32)
        self.key = eights(np.frombuffer(BETWEEN.join([c for c, _ in chunks]) + BETWEEN, np.uint8))
        self.stop = np.repeat(self.starts + sizes - 1, sizes)
        place = np.arange(len(self.key), dtype=np.int32) - np.repeat(self.starts, sizes)
        count = np.repeat(self.counts, sizes)
        order, group = suffix_array(self.key, place, count, depth)
        window = place < count
        self.order = order[window[order]]
        self.best = self._kasai(window, group)

    def _kasai(self, window: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Each window's longest common prefix (at most depth) with its neighbours in the order; 0 elsewhere.

        Kasai's rule, a suffix shares at most one byte less than the suffix one byte earlier, carried through all chunks side by
        side: in each round every chunk either compares eight more bytes or goes on to its next window. Windows that are tied need
        no comparison. They carry nothing on, as their order says nothing of the next windows', nor does a chunk's last window.
        """
        rank = np.zeros(len(self.key), np.int32)
        rank[self.order] = np.arange(len(self.order), dtype=np.int32)
        follows = np.r_[window[1:], False]
        out = np.zeros(len(self.key), np.int32)
        at, last = self.starts.copy(), self.starts + self.counts
        at, last = at[at < last], last[at < last]
        shared = np.zeros(len(at), np.int32)
        while len(at):
            r = rank[at]
            other = self.order[np.maximum(r - 1, 0)]
            room = np.where(r > 0, np.minimum(np.minimum(self.stop[at] - at, self.stop[other] - other), self.depth), 0)
            tied = group[at] == group[other]
            step = same_bytes(self.key[at + shared], self.key[other + shared])
            shared = np.where(tied, room, np.minimum(shared + step, room))
            done = tied | (step < 8) | (shared == room)
            out[at[done]] = shared[done]
            shared = np.where(done, np.where(follows[other] & ~tied, np.maximum(shared - 1, 0), 0), shared)
            at = at + done
            if (at >= last).any():
                left = at < last
                at, last, shared = at[left], last[left], shared[left]
        both = out.copy()
        both[self.order[:-1]] = np.maximum(out[self.order[:-1]], out[self.order[1:]])
        return both

    def compare(self, at: np.ndarray, other: Block, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of each window here against a suffix there by their first `depth` bytes, and their common bytes."""
        shared, sign, left = np.zeros(len(at), np.int32), np.zeros(len(at), np.int8), np.arange(len(at))
        while len(left):
            x = self.key[np.minimum(at[left] + shared[left], len(self.key) - 1)]
            y = other.key[np.minimum(suffix[left] + shared[left], len(other.key) - 1)]
            sign[left] = np.where(x < y, -1, np.where(x > y, 1, 0))
            shared[left] += same_bytes(x, y)
            left = left[(x == y) & (shared[left] < self.depth)]
        return sign, np.minimum(np.minimum(shared, self.depth), np.minimum(self.stop[at] - at, other.stop[suffix] - suffix))

    def look_up(self, at: np.ndarray, other: Block) -> None:
        """The longest prefixes that windows share with the other block, by binary search in its order."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(other.order))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            up = (self.compare(at, other, other.order[np.minimum(mid, len(other.order) - 1)])[0] > 0) & (lo < hi)
            lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, np.minimum(mid, hi))
        for near in (lo - 1, lo):
            found = self.compare(at, other, other.order[np.clip(near, 0, len(other.order) - 1)])[1]
            self.best[at] = np.maximum(self.best[at], found)

    def merge(self, mine: list[int], other: Block, theirs: list[int]) -> None:
        """Look up the windows of some chunks in the other block, and the other way round."""
        for a, own, b in ((self, mine, other), (other, theirs, self)):
            at = np.concatenate([np.arange(a.starts[k], a.starts[k] + a.counts[k]) for k in own])
            at = at[a.best[at] < np.minimum(a.depth, a.stop[at] - at)]
            if len(at):
                a.look_up(at, b)

    def spans(self, chunk: int) -> bytes:
        """Runs of a chunk's windows that share `depth` bytes with another: starts and lengths as int32 pairs."""
        return mask_runs(self.best[self.starts[chunk] : self.starts[chunk] + self.counts[chunk]] >= self.depth).tobytes()


def mask_runs(mask: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return np.column_stack([edge[::2], edge[1::2] - edge[::2]]).astype(np.int32).reshape(-1)


_HASHES = pa.schema([("ah", pa.int64())])
_ANCHORS = pa.schema([("rid", pa.int64()), ("sid", pa.int64()), ("length", pa.int32()), ("start", pa.int32()), ("count", pa.int32()), ("ah", pa.int64()), ("ch", pa.int64())])
_ANCHORS_DDL = "rid long, sid long, length int, start int, count int, ah long, ch long"
_CHUNKS = pa.schema([("length", pa.int32()), ("ah", pa.int64()), ("ch", pa.int64()), ("count", pa.int32()), ("copied", pa.bool_()), ("chunk", pa.binary())])
_CHUNKS_DDL = "length int, ah long, ch long, count int, copied boolean, chunk binary"
_MARKS = pa.schema([("ah", pa.int64()), ("ch", pa.int64()), ("spans", pa.binary())])
_MARKS_DDL = "ah long, ch long, spans binary"


def _anchored(lengths: tuple[int, ...], hashes_only: bool):
    def found(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                data, offsets = text_bytes(piece.column("text"))
                for length, (doc, start, count, h, own) in zip(lengths, anchors(data, offsets, lengths, own_hash=not hashes_only)):
                    if hashes_only:
                        yield rows(_HASHES, [h.view(np.int64)])
                        continue
                    at = pa.array(doc)
                    yield rows(_ANCHORS, [piece.column("rid").take(at), piece.column("sid").take(at), np.full(len(doc), length), start - offsets[doc], count, h.view(np.int64), own.view(np.int64)])
        tidy()

    return found


def _cut(batches):
    for batch in batches:
        for text, need in zip(batch.column("text"), batch.column("need")):
            text, need = text.as_py().encode("utf-8", "surrogatepass"), need.as_py()
            columns = [[x[k] for x in need] for k in _CHUNKS.names[:-1]]
            yield rows(_CHUNKS, [*columns, [text[x["start"] : x["start"] + x["count"] + x["length"] - 1] for x in need]])
    tidy()


def _marked(block_bytes: int):
    """Chunks by length and anchor → the repeated windows of those that aren't copied. Blocks are kept only while one anchor goes on in the next."""

    def emit(done: list):
        for keys, block in done:
            own = [(a, c, block.spans(k)) for k, (a, c, copied) in enumerate(keys) if not copied]
            yield rows(_MARKS, [list(x) for x in zip(*own)] if own else [[]] * len(_MARKS))
        done.clear()

    def close(length: int, keys: list, chunks: list, waiting: list):
        """Waiting blocks all end with one anchor, which may go on in this block."""
        block = Block(chunks, length)
        for before, other in waiting:
            anchor = before[-1][0]
            theirs = [k for k, (a, *_) in enumerate(before) if a == anchor]
            mine = [k for k, (a, *_) in enumerate(keys) if a == anchor]
            if mine:
                block.merge(mine, other, theirs)
        if keys[0][0] != keys[-1][0] or waiting and waiting[-1][0][-1][0] != keys[0][0]:
            yield from emit(waiting)
        waiting.append((keys, block))

    def marked(batches):
        keys, chunks, size, waiting, length = [], [], 0, [], 0
        for batch in batches:
            for own, a, c, count, copied, text in zip(*(batch.column(k).to_pylist() for k in _CHUNKS.names)):
                if keys and keys[-1][:2] == (a, c):
                    continue  # cut from a repeated row
                if keys and (size >= block_bytes or own != length):
                    yield from close(length, keys, chunks, waiting)
                    keys, chunks, size = [], [], 0
                length = own
                keys.append((a, c, copied))
                chunks.append((text, count))
                size += len(text)
        if keys:
            yield from close(length, keys, chunks, waiting)
        yield from emit(waiting)
        tidy()

    return marked


def content_numbers() -> tuple[Column, Column]:
    """Two numbers of a row's doc_id and text; equal rows have equal ones, and other rows don't share both."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))]
    return F.xxhash64(*parts), F.xxhash64(F.lit("again"), *parts)


def repeats(texts: DataFrame, lengths: tuple[int, ...] = (LENGTH,), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, sid, found: for each of the texts with repeated windows, its chunks with any: length, start, windows, the runs that are repeated (null: all).

    texts has text (not null), rid and sid; its further columns are kept beside the text in the exchange by rid and sid, so that
    a caller who joins the same texts with the result by these reuses it.
    """
    own = texts.select("rid", "sid", "text")
    often = durable(own.select("text").mapInArrow(_anchored(lengths, True), "ah long").groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah"))  # apart, so that a hot anchor's side of the join can be split
    live = durable(own.mapInArrow(_anchored(lengths, False), _ANCHORS_DDL).join(often, "ah"))
    chunks = durable(live.groupBy("ah", "ch").agg((F.count("*") > 1).alias("copied"), F.min(F.struct("rid", "sid", "start", "length", "count")).alias("rep")))
    mixed = chunks.groupBy("ah").agg(F.count("*").alias("n"), F.every("copied").alias("settled")).filter("n > 1 AND NOT settled").select("ah")
    need = chunks.join(mixed, "ah").select("rep.rid", "rep.sid", F.struct("ah", "ch", "copied", "rep.start", "rep.length", "rep.count").alias("x"))
    sent = texts.join(need.groupBy("rid", "sid").agg(F.collect_list("x").alias("need")), ["rid", "sid"]).mapInArrow(_cut, _CHUNKS_DDL)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = sent.repartition(parts, "ah").sortWithinPartitions("length", "ah", "ch").mapInArrow(_marked(block_bytes), _MARKS_DDL).filter(F.octet_length("spans") > 0)
    marks = marks.union(chunks.filter("copied").select("ah", "ch", F.lit(None).cast("binary").alias("spans")))
    return live.join(marks, ["ah", "ch"]).groupBy("rid", "sid").agg(F.collect_list(F.struct("length", "start", "count", "spans")).alias("found"))


def removed_runs(found: pa.ListArray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed byte runs of documents, from their chunks' repeated windows of that length: document, first byte, byte after the last."""
    whole = found.flatten()
    doc = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy())
    mine = np.flatnonzero(whole.field("length").to_numpy() == length)
    doc, start, count, spans = doc[mine], whole.field("start").to_numpy()[mine], whole.field("count").to_numpy()[mine], whole.field("spans").take(pa.array(mine))
    part = spans.is_valid().to_numpy(zero_copy_only=False)
    pairs = np.frombuffer(b"".join(x.as_buffer() for x in spans.filter(spans.is_valid())), np.int32).reshape(-1, 2)
    of = np.repeat(np.flatnonzero(part), pc.binary_length(spans).drop_null().to_numpy() // 8)
    doc, first, n = np.r_[doc[~part], doc[of]], np.r_[start[~part], start[of] + pairs[:, 0]].astype(np.int64), np.r_[count[~part], pairs[:, 1]]
    end = first + n + length - 1
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], end[order]
    if not len(doc):
        return doc, first, end
    base = doc * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    lo = np.flatnonzero(np.r_[True, (first + base)[1:] > reach[:-1]])
    return doc[lo], first[lo], np.r_[reach[lo[1:] - 1], reach[-1]] - base[lo]


def kept_bytes(data: bytes | memoryview, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:z] for a, z in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(data)]))


def _by_document(found: pa.ListArray, length: int) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list] = {}
    for d, a, z in zip(*(x.tolist() for x in removed_runs(found, length))):
        out.setdefault(d, []).append((a, z))
    return out


_DIGESTS = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64())])
_DIGESTS_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long"


def digests(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, passage: int = PASSAGE_BYTES, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row once all repeated strings are removed; n_passages, passage_bytes.

    Each byte in a string of `length` bytes that also starts anywhere else in the table is removed, wherever it stands. Null texts
    are empty; texts under `length` bytes keep all; repeated rows are repeats of each other; an empty table gives an empty result;
    further columns are dropped. Passages are only reported: maximal runs of bytes in strings of `passage` bytes that start
    anywhere else too, if they hold over `words` words (runs of bytes other than white space).
    """
    rid, sid = content_numbers()
    texts = docs.select(rid.alias("rid"), sid.alias("sid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def measured(batches):
        for batch in (piece for batch in batches for piece in pieces(batch)):
            data, offsets = text_bytes(batch.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            cuts, passages = (_by_document(batch.column("found"), n) for n in (length, passage))
            out = []
            for d, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                spans = cuts.get(d, [])
                kept = kept_bytes(view[lo:hi], spans) if spans else view[lo:hi]
                told = [z - a for a, z in passages.get(d, ()) if len(bytes(view[lo + a : lo + z]).split()) > words]
                out.append((hi - lo, hi - lo - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(told), sum(told)))
            yield rows(_DIGESTS, [batch.column("doc_id"), *map(list, zip(*out))])
        tidy()

    joined = texts.join(repeats(texts, tuple(sorted({passage, length})), block_bytes), ["rid", "sid"], "left")
    return joined.select("doc_id", "text", "found").mapInArrow(measured, _DIGESTS_DDL)


def remove(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, with the repeated strings cut out of text; a character that a cut leaves incomplete goes too.

    Cases are as in digests(); a null text becomes the empty text.
    """
    columns = [f"c{k}" for k in range(len(docs.columns))]
    place = docs.columns.index("text")
    rid, sid = content_numbers()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(rid.alias("rid"), sid.alias("sid"), *(F.col(f"`{name}`").alias(c) for name, c in zip(docs.columns, columns) if name != "text"), text.alias("text"))

    def cut(batches):
        for batch in (piece for batch in batches for piece in pieces(batch)):
            texts, cuts = batch.column("text"), _by_document(batch.column("found"), length)
            if cuts:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(cuts)] = True
                left = [kept_bytes(texts[d].as_py().encode("utf-8", "surrogatepass"), cuts[d]).decode("utf-8", "ignore") for d in sorted(cuts)]
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(left, texts.type))
            yield pa.record_batch([texts if k == place else batch.column(c) for k, c in enumerate(columns)], names=docs_columns)
        tidy()

    docs_columns = docs.columns
    joined = texts.join(repeats(texts, (length,), block_bytes), ["rid", "sid"], "left")
    return joined.mapInArrow(cut, T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]))
