"""N-gram Jaccard join with several global token orders.

Two sets with Jaccard similarity t share at least ceil(t n) tokens with a set of n, so under any one order of all tokens they
share one of each other's first n - ceil(t n) + 1. Pairs are formed by the prefixes of the first order; what is left of them
under the prefixes of the second and of the third are the candidates, and only these fetch their sets' tokens and are verified.
All orders put tokens that no other set has first, so those fill most prefixes and can be left out unseen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, by_range, distinct, durable, grams, joined, mix, pack, pieces, range_bits, raw, rows, runs, text_bytes, tidied, tidy, unpack, unused, without, words
from .graph import merge

WORDS = 5
PERCENT = 75
#: Postings that a task holds before it sends them on, and characters of text whose postings meet in one range.
FLUSH = 2 << 20
RANGE_CHARS = 12 << 20
#: The frequency that a heavy token counts as, and the fewest sets of one task's share that make a token heavy.
HEAVY, LEAST_HEAVY = 1 << 30, 16
#: Upper bits of a token that tell the slices apart in which a task sorts its postings; hash ranges have at least as many.
SLICE_BITS = 3
#: Bits of the parity bitmap that bounds the overlap of two sets before their tokens are fetched.
BITMAP = 512
#: Cheap rounds against one representative go on until at most this many unlinked pairs are left for each posting.
CROSS_PER_POSTING = 4
MAX_STAR_ROUNDS = 5


def least_common(n, percent: int = PERCENT):
    """Tokens that a set of n shares with any set at that similarity, at least."""
    return (percent * n + 99) // 100


def shingle_sets(column: pa.Array, n: int = WORDS):
    """For each text its distinct shingles' hashes, sorted; the whole sequence is the one shingle of fewer words."""
    data, offsets = text_bytes(column)
    _, _, at, h = words(data, offsets)
    shingles, owner, _ = grams(h, at, n)
    cut = np.searchsorted(owner, np.arange(len(at)))
    for d in range(len(at) - 1):
        size = at[d + 1] - at[d]
        if size >= n:
            yield distinct(shingles[cut[d] : cut[d + 1]])
        else:
            yield grams(h[at[d] : at[d + 1]], np.array([0, size]), int(size))[0] if size else np.zeros(0, np.uint64)


def signature(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


_INFO = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64())])
_POSTINGS = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("place", pa.binary()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("heavy", pa.binary())])
_SHARED = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("place", pa.binary()), ("sigs", pa.binary()), ("sizes", pa.binary()), ("df", pa.binary())])
_SHARED_DDL = "part int, tokens binary, place binary, sigs binary, sizes binary, df binary"
_SETS = pa.schema([
    ("sig", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), *((f"bits{k}", pa.int64()) for k in range(BITMAP // 64)),
    ("tokens", pa.list_(pa.int64())), ("second", pa.list_(pa.int32())), ("third", pa.list_(pa.int32())),
])
_BITS = [f"bits{k}" for k in range(BITMAP // 64)]
_PREFIX = pa.schema([("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("rest", pa.int64())])


def set_sizes(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, row (a hash of all columns), n_shingles and sig of every row: equal sets have equal sig, empty ones null."""

    def sized(batches):
        for batch in batches:
            for piece in pieces(batch):
                sets = [(len(s), signature(s) if len(s) else None) for s in shingle_sets(piece.column("text"), n)]
                yield rows(_INFO, [piece.column("doc_id"), piece.column("row"), *map(list, zip(*sets))])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(sized, "doc_id long, row long, n_shingles long, sig long")


def row_hash(docs: DataFrame) -> Column:
    """Equal rows have equal hashes; columns of kinds that Spark can't hash don't count."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))


def _postings(bits: int, n: int, heavy: int):
    """Each distinct set's tokens, sorted and cut into hash ranges; sets that a task meets again are left out.

    A token that over `heavy` of the sets held have is shared by any count. It goes straight to its sets' ranges, and its own range
    only learns that it is heavy, so that no range holds more of a token than `heavy` postings from each share.
    """

    def flush(sets: dict):
        sigs = np.sort(np.array(list(sets), np.int64).view(np.uint64)).view(np.int64)  # in order, so that their upper bytes shrink
        held = [sets.pop(s) for s in sigs.tolist()]
        sizes = np.array([len(s) for s in held], np.int32)
        every = np.concatenate(held)
        del held
        owner = np.repeat(np.arange(len(sigs), dtype=np.int32), sizes)
        top = (every >> np.uint64(64 - SLICE_BITS)).astype(np.uint8)
        far, of = [], []
        for k in range(1 << SLICE_BITS):  # sorted slice by slice, so that what a sort takes is small beside the sets
            at = np.flatnonzero(top == k)
            at = at[np.argsort(every[at])]
            tokens, own = every[at], owner[at]
            del at
            lo = runs(tokens)
            count = np.diff(np.r_[lo, len(tokens)])
            loud = tokens[lo[count > heavy]]
            told = {part: loud[a:z] for part, a, z in by_range(loud, bits)}
            if len(loud):
                mask = np.repeat(count > heavy, count)
                far.append(tokens[mask])
                of.append(own[mask])
                tokens, own = tokens[~mask], own[~mask]
            for part, a, z in by_range(tokens, bits):
                here = np.zeros(len(sigs), bool)
                here[own[a:z]] = True
                near = np.flatnonzero(here)
                place = (np.cumsum(here) - 1)[own[a:z]].astype(np.uint16 if len(near) <= 1 << 16 else np.uint32)
                yield rows(_POSTINGS, [[part], [pack(tokens[a:z])], [pack(place)], [pack(sigs[near])], [pack(sizes[near])], [told.pop(part, loud[:0]).tobytes()]])
            for part, own_loud in told.items():
                yield rows(_POSTINGS, [[part], [b""], [b""], [b""], [b""], [own_loud.tobytes()]])
        if far:
            far, of = np.concatenate(far), np.concatenate(of)
            order = np.argsort(sigs[of].view(np.uint64), kind="stable")
            far, of = far[order], of[order]
            for part, a, z in by_range(sigs[of].view(np.uint64), bits):
                yield rows(_POSTINGS, [[part], [pack(far[a:z])], [None], [pack(sigs[of[a:z]])], [pack(sizes[of[a:z]])], [None]])

    def posted(batches):
        sets: dict = {}
        size = 0
        for batch in batches:
            for piece in pieces(batch):
                for tokens in shingle_sets(piece.column("text"), n):
                    if len(tokens) and (key := signature(tokens)) not in sets:
                        sets[key] = tokens
                        size += len(tokens)
                if size >= FLUSH:
                    yield from flush(sets)
                    sets, size = {}, 0
        if sets:
            yield from flush(sets)
        del sets
        tidy()

    return posted


def _shared(bits: int):
    """Of one hash range the tokens that several sets have, with their frequencies, sent on by set."""

    def told(part: int, tokens, sigs, sizes, df) -> tuple:
        """A row for the range of these sets: each set once, in order, and the place of each token's set among them."""
        own, first, place = np.unique(sigs.view(np.uint64), return_index=True, return_inverse=True)
        place = place.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
        return part, pack(tokens), pack(place), pack(own), pack(sizes[first]), pack(df)

    def shared(table: pa.Table) -> pa.Table:
        tokens, sigs, sizes, loud, out = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], []
        for part, t, p, s, z, h in zip(*(table.column(c) for c in _POSTINGS.names)):
            t = unpack(t.as_buffer(), np.uint64)
            s, z = unpack(s.as_buffer(), np.int64), unpack(z.as_buffer(), np.int32)
            if not p.is_valid:  # heavy tokens of sets of this range
                out.append(told(part.as_py(), t, s, z, np.full(len(t), HEAVY, np.int32)))
                continue
            p = unpack(p.as_buffer(), np.uint16 if len(p.as_buffer()) == 2 * len(t) else np.uint32)
            tokens.append(t)
            sigs.append(s[p])
            sizes.append(z[p])
            loud.append(raw(h.as_buffer(), np.uint64))
        tokens, sigs, sizes, loud = map(np.concatenate, (tokens, sigs, sizes, loud))
        order = np.argsort(tokens)
        lo = runs(in_order := tokens[order])
        count = np.diff(np.r_[lo, len(order)])
        often = np.repeat((count > 1) | np.isin(in_order[lo], loud), count)
        order = order[often]
        del in_order
        order = order[np.lexsort((sigs[order], tokens[order]))]  # the same set can come from several tasks
        tokens, sigs, sizes = tokens[order], sigs[order], sizes[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])
        tokens, sigs, sizes = tokens[first], sigs[first], sizes[first]
        lo = runs(tokens)
        count = np.diff(np.r_[lo, len(tokens)])
        df = np.repeat(np.where(np.isin(tokens[lo], loud), HEAVY, count), count).astype(np.int32)
        tokens, sigs, sizes, df = (x[df > 1] for x in (tokens, sigs, sizes, df))
        order = np.argsort(sigs.view(np.uint64) >> np.uint64(64 - bits), kind="stable")
        for k, a, z in by_range(sigs.view(np.uint64)[order], bits):
            at = order[a:z]
            out.append(told(k, tokens[at], sigs[at], sizes[at], df[at]))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(_SHARED), _SHARED)], schema=_SHARED)

    return tidied(shared)


def parity(tokens: np.ndarray) -> list[int]:
    """A bitmap that each token flips one bit of. Two sets differ in at least as many tokens as their bitmaps in bits."""
    bits = (np.bincount((mix(tokens, 4) >> np.uint64(55)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def _sets(percent: int):
    """The sets of one range that share enough tokens to have any partner, their shared tokens in the first order."""

    def whole(table: pa.Table) -> pa.Table:
        sigs, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for t, p, s, z in zip(*(table.column(c) for c in ("tokens", "place", "sigs", "sizes"))):
            p = unpack(p.as_buffer(), np.uint16 if 4 * len(p.as_buffer()) == len(t.as_buffer()) else np.uint32)
            sigs.append(unpack(s.as_buffer(), np.int64)[p])
            sizes.append(unpack(z.as_buffer(), np.int32)[p])
        sigs, sizes, tokens, df = np.concatenate(sigs), np.concatenate(sizes), joined(table.column("tokens"), np.uint64), joined(table.column("df"), np.int32)
        if len(df) and df.max() == HEAVY:  # these may come from several tasks
            order = np.lexsort((tokens, sigs))
            order = order[np.r_[True, (sigs[order][1:] != sigs[order][:-1]) | (tokens[order][1:] != tokens[order][:-1])]]
            sigs, sizes, tokens, df = sigs[order], sizes[order], tokens[order], df[order]
        order = np.argsort(sigs, kind="stable")
        lo = runs(sigs[order])
        count = np.diff(np.r_[lo, len(order)])
        size = sizes[order[lo]].astype(np.int64)
        out = []
        for k in np.flatnonzero(count >= least_common(size, percent)):
            at = order[lo[k] : lo[k] + count[k]]
            at = at[np.lexsort((tokens[at], df[at]))]
            second, third = other_prefixes(tokens[at], df[at], int(size[k]), percent)
            out.append((int(sigs[at[0]]), int(size[k]), len(at), *parity(tokens[at]), tokens[at].view(np.int64), *(x.astype(np.uint32).view(np.int32) for x in (second, third))))  # half of a token will do where a match is checked again
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(_SETS), _SETS)], schema=_SETS)

    return tidied(whole)


def _prefix(percent: int):
    """The prefix under the first order, each token with the number of tokens from there on."""

    def prefixes(batches):
        for batch in batches:
            sig, n, own = (batch.column(c).to_numpy() for c in ("sig", "n", "shared"))
            tokens, lo = batch.column("tokens").flatten().to_numpy(), np.cumsum(own) - own
            size = own - least_common(n, percent) + 1
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield rows(_PREFIX, [tokens[np.repeat(lo, size) + place], np.repeat(sig, size), np.repeat(n, size), np.repeat(own, size) - place])

    return prefixes


def other_prefixes(tokens: np.ndarray, df: np.ndarray, n: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes under the second order (coarse frequency, then a hash) and the third (a hash); tokens of one set come first in both."""
    size = len(tokens) - least_common(n, percent) + 1
    h2, h3 = mix(tokens, 2), mix(tokens, 3)
    coarse = np.frexp(df.astype(np.float64))[1]
    return np.sort(tokens[np.lexsort((h2, coarse))[:size]]), np.sort(tokens[np.argsort(h3)[:size]])


def linked_sets(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """node, component: the sets (by sig) that have links, and the smallest one that their links reach.

    Sets are first compared with one representative for each prefix token. Members of one component need no further comparison;
    all other pairs that share a prefix token are verified, so no component is missed.
    """
    bits = range_bits(docs, RANGE_CHARS)
    heavy = max(LEAST_HEAVY, FLUSH >> bits)  # a range has about FLUSH postings, and there are about as many shares as ranges
    postings = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_postings(bits, n, heavy), "part int, tokens binary, place binary, sigs binary, sizes binary, heavy binary")
    shared = postings.groupBy("part").applyInArrow(_shared(bits), _SHARED_DDL)
    sets = durable(shared.groupBy("part").applyInArrow(_sets(percent), f"sig long, n long, shared long, {' long, '.join(_BITS)} long, tokens array<long>, second array<int>, third array<int>"))
    posts = sets.select("sig", "n", "shared", "tokens").mapInArrow(_prefix(percent), "token long, sig long, n long, rest long")
    posts = durable(posts.join(posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token"), "token"))

    def overlap(x: str, y: str) -> Column:
        """Whether the bitmaps leave room for the overlap that the similarity takes."""
        differ = sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in _BITS), F.lit(0))
        return (100 + percent) * (F.col(f"{x}shared") + F.col(f"{y}shared") - differ) >= 2 * percent * (F.col(f"{x}n") + F.col(f"{y}n"))

    def few(table: DataFrame) -> bool:
        """Whether a stored table goes to every task, so that what it is joined to stays where it is."""
        return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def both(pairs: DataFrame, *names: str, known: bool = False) -> DataFrame:
        """pairs(a, b) with columns of either side's set, as x and y. known: few stored pairs, beside which no other set is moved."""
        sides = [sets.select(F.col("sig").alias(c), *(F.col(k).alias(f"{side}_{k}") for k in names)) for c, side in (("a", "x"), ("b", "y"))]
        if known:
            x, y = (side.join(F.broadcast(pairs), c) for c, side in zip("ab", sides))
            return x.join(y, ["a", "b"])
        return pairs.join(sides[0], "a").join(sides[1], "b")

    def verify(pairs: DataFrame) -> DataFrame:
        """a, b, linked of the pairs that the bitmaps and the other orders leave: these are filtered before tokens are fetched."""
        near = durable(both(pairs, "n", "shared", *_BITS).filter(overlap("x_", "y_")).select("a", "b"))
        found = durable(both(near, "second", "third", known=few(near)).filter(F.arrays_overlap("x_second", "y_second") & F.arrays_overlap("x_third", "y_third")).select("a", "b"))
        common = F.size(F.array_intersect("x_tokens", "y_tokens"))
        return durable(both(found, "n", "tokens", known=few(found)).select("a", "b", (100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)).alias("linked")))

    def close(x: str, y: str) -> Column:
        """Whether sizes allow the similarity and, if this is the first token that both have, what follows in both allows it too."""
        common = F.least(f"{x}rest", f"{y}rest")
        return (100 * F.least(f"{x}n", f"{y}n") >= percent * F.greatest(f"{x}n", f"{y}n")) & ((100 + percent) * common >= percent * (F.col(f"{x}n") + F.col(f"{y}n")))

    labelled = posts.withColumn("component", F.col("sig"))
    seen = labels = None
    for turn in range(MAX_STAR_ROUNDS):
        order = F.xxhash64(F.lit(turn), "sig")
        star = labelled.groupBy("token").agg(F.min(F.struct(order.alias("o"), "sig", "n", "rest", "component")).alias("hub"))
        pairs = labelled.join(star, "token").filter((F.col("hub.component") != F.col("component")) & close("", "hub."))
        pairs = pairs.select(F.least("sig", "hub.sig").alias("a"), F.greatest("sig", "hub.sig").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        fresh = verify(pairs)
        seen = fresh if seen is None else seen.union(fresh)
        if not fresh.filter("linked").limit(1).count():
            break
        labels = merge(labels, fresh.filter("linked"))
        named = labels.withColumnRenamed("node", "sig")
        labelled = posts.join(F.broadcast(named) if few(labels) else named, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        groups = labelled.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        left = groups.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("cross"), F.sum("n").alias("posts")).first()
        if not left["cross"] or left["cross"] <= CROSS_PER_POSTING * left["posts"]:
            break
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    open_ = labelled.join(mixed, "token").join(sets.select("sig", "shared", *_BITS), "sig").select("token", "sig", "n", "rest", "component", "shared", *_BITS)
    x, y = open_.alias("x"), open_.alias("y")
    cross = x.join(y, F.col("x.token") == F.col("y.token")).filter((F.col("x.sig") < F.col("y.sig")) & (F.col("x.component") != F.col("y.component")) & close("x.", "y.") & overlap("x.", "y."))
    cross = cross.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")
    return merge(labels, verify(cross).filter("linked"))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row.

    Two rows link when 100 |A ∩ B| >= percent |A ∪ B| for their sets of distinct n-word shingles (lower-cased A-Z words). Null,
    empty and wordless texts have no shingle and link with nothing. Repeated rows link with each other; a null doc_id is never
    the smallest unless its whole component has none; empty tables give empty results; further columns are dropped.

    Sets stand for all rows that have them, so copies are never expanded into pairs. Shingles are 64-bit hashes.
    """
    info = durable(set_sizes(docs, n))
    known = _known(docs, info, n, percent)
    first = durable(known.groupBy("component").agg(F.min("doc_id").alias("component_id")))  # apart, so that a hot component's side of the join can be split
    alone = info.filter("sig IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.join(first, "component").select("doc_id", "n_shingles", "component_id").union(alone)


def _known(docs: DataFrame, info: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, component of the rows that have shingles."""
    labels = linked_sets(docs, n, percent).select(F.col("node").alias("sig"), "component")
    return info.filter("sig IS NOT NULL").join(labels, "sig", "left").select("doc_id", "row", "n_shingles", F.coalesce("component", "sig").alias("component"))


def keep_first(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps one: the least doc_id and, of its rows, that with the least hash.

    Rows that share a doc_id are rows of their own: each stays that is the first of its component. Of equal rows one stays. Rows
    without a doc_id or without words stay.
    """
    own_id, own_row, mine = (unused(docs, name) for name in ("first_id", "first_row", "row"))
    named = docs.filter("doc_id IS NOT NULL")
    known = _known(named, durable(set_sizes(named, n)), n, percent)
    first = durable(known.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("component", "first"))
    others = durable(known.join(first, "component").select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), (F.struct("doc_id", "row") == F.col("first")).alias("is_first")))
    gone = others.filter("NOT is_first").select(own_id, own_row).distinct()
    again = durable(others.filter("is_first").groupBy(own_id, own_row).agg(F.count("*").alias("n")).filter("n > 1").select(own_id, own_row))
    columns, here = docs.columns, (F.col("doc_id") == F.col(own_id)) & (F.col(mine) == F.col(own_row))
    kept = without(docs.withColumn(mine, row_hash(docs)), durable(gone), here)
    if not again.limit(1).count():
        return kept.select(columns)
    once = without(kept, again, here).select(columns)
    return once.union(kept.join(again, here, "left_semi").dropDuplicates(["doc_id", mine]).select(columns))
