"""Gated recurrent language model with a class-factored softmax, trained by truncated backpropagation in numpy.

The frequent words have outputs of their own in frequency classes; all others share one class, within which they have their
add-one unigram probability, so the model is a distribution over the whole vocabulary and one unknown word. State is carried
from window to window through a whole text, in training and in scoring.

Counts of all words of all training texts are kept in hash ranges. Words with at least 1 / HOT of all tokens (at most HOT words)
go to every task; all others are looked up by a shuffle. Each task trains a copy of the network on its texts; the copies are
averaged by their tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_range, carried, durable, joined, pack, pieces, range_bits, raw, rows, runs, text_bytes, tidy, words

HEAD = 4096
HIDDEN = 16
CLASSES = 64
WINDOW = 24
HOT = 1 << 18
RATE = 0.2
#: Tokens that a task reads before it sorts their texts by length, and texts that then run side by side.
GROUP_TOKENS = 1_500_000
SCORE_LANES, TRAIN_LANES = 1024, 384
#: States that are held until their outputs are taken together.
HELD = 1 << 14
#: States whose class outputs are taken at once, so that these stay in the processor's cache.
ROWS = 1 << 10
FLUSH = 1 << 20
RANGE_CHARS = 48 << 20
BLOCKS = 32
#: Scores are cut here before they are raised to powers; a softmax needs no shift below it.
TOP = np.float32(60)
#: The hash that stands for the end of a text.
END = np.uint64(0x51ED270B1F8A3C4D)
LOG10 = np.float32(np.log(10))


def training_rows() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2


@dataclass
class Vocabulary:
    """Hot words' hashes (sorted) with their log10(count + 1) and outputs; N, V and the log10 weight of the tail class."""

    hashes: np.ndarray
    log_counts: np.ndarray
    output: np.ndarray
    tokens: int
    distinct: int
    tail_log: float
    head_counts: np.ndarray
    end: int
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first output of each class; then the number of outputs

    @property
    def tail(self) -> int:
        return len(self.head_counts)


def build_vocabulary(hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, ends: int) -> Vocabulary:
    """From hot words' counts, without the end of text; `ends` is its count, already in tokens and distinct."""
    order = np.lexsort((hashes, -counts))[: HEAD - 1]
    chosen = np.r_[hashes[order], END]
    head = np.r_[counts[order], ends].astype(np.float64)
    order = np.lexsort((chosen, -head))
    chosen, head = chosen[order], head[order]
    hot, hot_counts = np.r_[hashes, END], np.r_[counts, ends]
    at = np.argsort(hot)
    hot, hot_counts = hot[at], hot_counts[at]
    output = np.full(len(hot), len(head), np.int32)
    output[np.searchsorted(hot, chosen)] = np.arange(len(head))
    tail = (tokens - head.sum()) + (distinct - len(head)) + 1
    # classes of about equal mass of the root counts
    mass = np.cumsum(np.sqrt(head + 1))
    klass = np.minimum((mass / mass[-1] * CLASSES).astype(int), CLASSES - 1)
    starts = np.r_[runs(klass), len(head)]
    return Vocabulary(hot, np.log10(hot_counts + 1.0), output, tokens, distinct, float(np.log10(max(tail, 1.0))), head, int(np.flatnonzero(chosen == END)[0]), starts)


class Network:
    """Parameters: input rows x of all three gates, recurrences u and c, class and word outputs with biases."""

    NAMES = ("x", "u", "c", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, vocabulary: Vocabulary, seed: int = 11):
        rng = np.random.default_rng(seed)
        n, k = vocabulary.tail, len(vocabulary.starts)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.starts, self.end, self.tail = vocabulary.starts, vocabulary.end, n
        self.klass = np.r_[np.repeat(np.arange(k - 1), np.diff(vocabulary.starts)), k - 1]
        self.x, self.u, self.c = normal(n + 1, 3 * HIDDEN), normal(HIDDEN, 2 * HIDDEN), normal(HIDDEN, HIDDEN)
        self.class_w, self.word_w = 0.1 * normal(HIDDEN, k), 0.1 * normal(n, HIDDEN)
        head = vocabulary.head_counts + 1
        mass = np.r_[np.add.reduceat(head, vocabulary.starts[:-1]), max(10**vocabulary.tail_log, 1.0)]
        self.class_b = np.log(mass / mass.sum()).astype(np.float32)
        self.word_b = np.log(head / mass[self.klass[:-1]]).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, values: np.ndarray) -> None:
        for p in self.parameters():
            p[...] = values[: p.size].reshape(p.shape)
            values = values[p.size :]

    def halves(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the gates (halved) and of the candidate for each id."""
        a = np.take(self.x, ids, 0)
        a[:, : 2 * HIDDEN] *= np.float32(0.5)
        return a[:, : 2 * HIDDEN], a[:, 2 * HIDDEN :]

    def step(self, gates: np.ndarray, cand: np.ndarray, h: np.ndarray, half_u: np.ndarray, zr: np.ndarray, rh: np.ndarray, new: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The next states from inputs of halves(), into `after`, with all on the way; half_u is u / 2, as the gates are (1 + tanh) / 2."""
        np.matmul(h, half_u, out=zr)
        zr += gates
        np.tanh(zr, out=zr)
        zr += 1
        zr *= np.float32(0.5)
        np.multiply(zr[:, HIDDEN:], h, out=rh)
        np.matmul(rh, self.c, out=new)
        new += cand
        np.tanh(new, out=new)
        np.subtract(new, h, out=after)
        after *= zr[:, :HIDDEN]
        after += h
        return after

    def outputs(self, h: np.ndarray, targets: np.ndarray, train: bool = False):
        """log probabilities of the targets; in training also the gradients with respect to h and the output parameters.

        States get a one for the biases, and weights a one for the sums of powers, so that products give both. The targets' own
        terms are added for all rows together: rows lie in the order of their targets, and so of their classes.
        """
        order = np.argsort(targets.astype(np.uint16) if self.tail < 1 << 16 else targets, kind="stable")
        h, targets = np.take(h, order, 0), targets[order]
        klass = self.klass[targets]
        cut = np.searchsorted(klass, np.arange(len(self.starts)))
        inner = int(cut[-1])  # what follows has the tail as its class
        one = np.ones((max(len(h), self.tail, len(self.class_b)), 1), np.float32)
        h1 = np.hstack([h, one[: len(h)]])
        class_w, word_w = np.hstack([self.class_w.T, self.class_b[:, None]]), np.hstack([self.word_w, self.word_b[:, None]])
        class_1, word_1 = np.hstack([self.class_w.T, one[: len(class_w)]]), np.hstack([self.word_w, one[: len(word_w)]])
        # no state is beyond 1, so few networks have scores to be cut
        high = any(len(w) and (np.abs(w[:, :-1]).sum(1) + w[:, -1]).max() > TOP for w in (class_w, word_w))
        own_class, own_word = np.take(class_w, klass, 0), np.take(word_w, targets[:inner], 0)
        picked, picked_word = np.einsum("ij,ij->i", h1, own_class), np.einsum("ij,ij->i", h1[:inner], own_word)
        if high:
            np.minimum(picked, TOP, out=picked)
            np.minimum(picked_word, TOP, out=picked_word)
        total, total_word = np.empty(len(h), np.float32), np.ones(inner, np.float32)
        if train:
            back, back_word = np.empty_like(h), np.zeros((inner, HIDDEN), np.float32)
            grad, grad_word = np.zeros_like(class_w), np.zeros_like(word_w)

        def powers(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
            e = rows @ w.T
            if high:
                np.minimum(e, TOP, out=e)
            return np.exp(e, out=e)

        def shares(e: np.ndarray, w_1: np.ndarray, total: np.ndarray, back: np.ndarray) -> np.ndarray:
            """Fills the sums and what goes back to the states; gives what rows are multiplied by on the way to the weights."""
            both = e @ w_1
            total[:] = both[:, -1]
            inverse = 1 / both[:, -1:]
            np.multiply(both[:, :-1], inverse, out=back)
            return inverse

        for lo in range(0, len(h), ROWS):
            own = h1[lo : lo + ROWS]
            e = powers(own, class_w)
            if train:
                grad += e.T @ (own * shares(e, class_1, total[lo : lo + ROWS], back[lo : lo + ROWS]))
            else:
                np.matmul(e, one[: len(class_w), 0], out=total[lo : lo + ROWS])
        for lo, hi, a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if lo == hi:
                continue
            if z - a == 1:  # its one word is certain
                picked_word[lo:hi] = 0
                if train:
                    back_word[lo:hi] = self.word_w[a]
                    grad_word[a] = h1[lo:hi].sum(0)
                continue
            own = h1[lo:hi]
            e = powers(own, word_w[a:z])
            if train:
                np.matmul(e.T, own * shares(e, word_1[a:z], total_word[lo:hi], back_word[lo:hi]), out=grad_word[a:z])
            else:
                np.matmul(e, one[: z - a, 0], out=total_word[lo:hi])
        logp = picked - np.log(total)
        logp[:inner] += picked_word - np.log(total_word)
        out = np.empty_like(logp)
        out[order] = logp
        if not train:
            return out
        back -= own_class[:, :-1]
        back_word -= own_word[:, :-1]
        back[:inner] += back_word
        for g, at, of in ((grad, runs(klass), klass), (grad_word, runs(targets[:inner]), targets)):
            if len(at):
                g[of[at]] -= np.add.reduceat(h1[: inner if g is grad_word else len(h1)], at)
        ordered = np.empty_like(back)
        ordered[order] = back
        return out, ordered, {"class_w": grad[:, :-1].T, "class_b": grad[:, -1], "word_w": grad_word[:, :-1], "word_b": grad_word[:, -1]}


def packed(lo: np.ndarray, lanes: int):
    """Texts of like length side by side: their numbers, longest first, their starts, and how many still run at each time."""
    lengths = np.diff(lo)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), lanes):
        own = order[at : at + lanes]
        size = lengths[own]
        yield own, lo[:-1][own], len(own) - np.searchsorted(size[::-1], np.arange(size[0]), "right")


def side_by_side(ids: np.ndarray, first: np.ndarray, active: np.ndarray, begin: int, end: int, start: int):
    """For times begin to end of texts side by side: where each time's rows start, and each row's lane, input (start at time 0) and target."""
    n = active[begin:end]
    cut = np.r_[0, np.cumsum(n)]
    lane = np.arange(cut[-1]) - np.repeat(cut[:-1], n)
    at = first[lane] + np.repeat(np.arange(begin, end), n)
    prior = ids[np.maximum(at - 1, 0)]
    if begin == 0:
        prior[: n[0]] = start
    return cut.tolist(), lane, prior, ids[at]


def score(net: Network, ids: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """log10 probability of each text ids[lo[i]:lo[i+1]]; every text is read from an empty state after the end of another."""
    out = np.zeros(len(lo) - 1)
    half_u = net.u * np.float32(0.5)
    for own, first, active in packed(lo, SCORE_LANES):
        total = np.zeros(len(own))
        h = np.zeros((len(own), HIDDEN), np.float32)
        begin = 0
        while begin < len(active):
            end = min(len(active), begin + max(1, HELD // int(active[begin])))
            cut, lane, prior, targets = side_by_side(ids, first, active, begin, end, net.end)
            gates, cand = net.halves(prior)
            states = np.empty((cut[-1], HIDDEN), np.float32)
            zr, rh, new = (np.empty((cut[1], k * HIDDEN), np.float32) for k in (2, 1, 1))
            for a, z in zip(cut[:-1], cut[1:]):
                n = z - a
                h = net.step(gates[a:z], cand[a:z], h[:n], half_u, zr[:n], rh[:n], new[:n], states[a:z])
            total += np.bincount(lane, net.outputs(states, targets).astype(np.float64), len(own))
            begin = end
        out[own] = total / np.log(10)
    return out


class Trainer:
    """Adagrad over windows of texts side by side."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.tokens = net, rate, 0
        self.seen = {name: np.full(getattr(net, name).shape, 1e-7, np.float32) for name in net.NAMES}

    def move(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        seen = self.seen[name]
        seen[at] += grad * grad
        getattr(self.net, name)[at] -= self.rate * grad / np.sqrt(seen[at])

    def texts(self, ids: np.ndarray, lo: np.ndarray) -> None:
        """One pass over whole texts: backpropagation within windows, all of them, the state carried on from one to the next."""
        for _, first, active in packed(lo, TRAIN_LANES):
            h = np.zeros((len(first), HIDDEN), np.float32)
            for begin in range(0, len(active), WINDOW):
                h = self.window(h, *side_by_side(ids, first, active, begin, min(begin + WINDOW, len(active)), self.net.end))

    def window(self, h: np.ndarray, cut: list[int], lane: np.ndarray, prior: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Forward and back through one window from the states h; gives the states after it."""
        net, size = self.net, len(targets)
        gates, cand = net.halves(prior)
        half_u = net.u * np.float32(0.5)
        before, zr, rh, new, after = (np.empty((size, k * HIDDEN), np.float32) for k in (1, 2, 1, 1, 1))
        for a, z in zip(cut[:-1], cut[1:]):
            before[a:z] = h[: z - a]
            h = net.step(gates[a:z], cand[a:z], h[: z - a], half_u, zr[a:z], rh[a:z], new[a:z], after[a:z])
        _, back, grads = net.outputs(after, targets, train=True)
        # what a state's gradient is multiplied by on its way to the gates' and the candidate's inputs, for all times together
        update, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
        keep = 1 - update
        to_update = (new - before) * update * keep
        to_new = update * (1 - new * new)
        to_reset = before * reset * (1 - reset)
        gate = np.empty((size, 3 * HIDDEN), np.float32)
        carry = np.zeros((0, HIDDEN), np.float32)
        back_c, back_u = np.ascontiguousarray(net.c.T), np.ascontiguousarray(net.u.T)
        for a, z in zip(cut[-2::-1], cut[:0:-1]):
            dh = back[a:z]
            dh[: len(carry)] += carry
            own = gate[a:z]
            np.multiply(dh, to_new[a:z], out=own[:, 2 * HIDDEN :])
            through = own[:, 2 * HIDDEN :] @ back_c
            np.multiply(dh, to_update[a:z], out=own[:, :HIDDEN])
            np.multiply(through, to_reset[a:z], out=own[:, HIDDEN : 2 * HIDDEN])
            carry = own[:, : 2 * HIDDEN] @ back_u
            carry += dh * keep[a:z]
            carry += through * reset[a:z]
        scale = np.float32(1 / max(size, 256))
        by = np.argsort(prior.astype(np.uint16) if net.tail < 1 << 16 else prior, kind="stable")
        at = runs(prior[by])
        self.move("x", np.add.reduceat(np.take(gate, by, 0), at) * scale, prior[by][at])
        self.move("u", before.T @ gate[:, : 2 * HIDDEN] * scale)
        self.move("c", rh.T @ gate[:, 2 * HIDDEN :] * scale)
        for name, grad in grads.items():
            self.move(name, grad * scale)
        self.tokens += size
        return h


def read_texts(column: pa.Array, vocabulary: Vocabulary, hot_too: bool = True):
    """For each text's words and its end: place among the hot words (or -1; all -1 if not asked for), hash, output; and the texts' offsets."""
    _, _, at, h = words(*text_bytes(column))
    n = len(at) - 1
    lo = at + np.arange(n + 1)
    full = np.empty(int(lo[-1]), np.uint64)
    ends = lo[1:] - 1
    inside = np.ones(len(full), bool)
    inside[ends] = False
    full[ends], full[inside] = END, h
    # most words are among the few with outputs, which are looked for first
    head = np.flatnonzero(vocabulary.output < vocabulary.tail)
    place, known = found(vocabulary.hashes[head], full)
    ids = np.where(known, vocabulary.output[head[place]], vocabulary.tail).astype(np.int32)
    hot = np.where(known, head[place], -1).astype(np.int32)
    if hot_too:
        rest = np.flatnonzero(~known)
        place, known = found(vocabulary.hashes, full[rest])
        hot[rest[known]] = place[known]
    return hot, full, ids, lo


def found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place in a sorted table, and whether it is there."""
    place = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return place, table[place] == values


_COUNTS = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_COUNTS_DDL = "part int, hashes binary, counts binary"
_PARAMS = pa.schema([("block", pa.int32()), ("tokens", pa.int64()), ("values", pa.binary())])
_PARTIAL = pa.schema([("part", pa.int32()), ("rids", pa.binary()), ("known", pa.binary()), ("logs", pa.binary()), ("own", pa.binary())])
_PARTIAL_DDL = "part int, rids binary, known binary, logs binary, own binary"
_LOOKUP = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("place", pa.binary()), ("rids", pa.binary()), ("partial", pa.struct(list(_PARTIAL)))])
_OWN = np.dtype([("doc_id", np.int64), ("has_id", np.int64), ("copies", np.int64), ("n_tokens", np.int64), ("tail", np.int64), ("network", np.float64)])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    lo = runs(hashes[order])
    return hashes[order][lo], np.add.reduceat(counts[order], lo) if len(lo) else counts


def count_words(docs: DataFrame, bits: int) -> DataFrame:
    """part, hashes, counts: the words of all texts with their counts, a row for each hash range."""

    def emit(held: list):
        hashes, counts = summed(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
        for part, a, z in by_range(hashes, bits):
            yield rows(_COUNTS, [[part], [pack(hashes[a:z])], [pack(counts[a:z])]])

    def counted(batches):
        held: list = []
        for batch in batches:
            for piece in pieces(batch):
                h = words(*text_bytes(piece.column("text")))[3]
                held.append(summed(h, np.ones(len(h), np.int64)))
                if sum(len(x) for x, _ in held) > FLUSH:
                    held = [summed(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) > FLUSH:
                        yield from emit(held)
                        held = []
        if held:
            yield from emit(held)

    def merged(table: pa.Table) -> pa.Table:
        hashes, counts = summed(joined(table.column("hashes"), np.uint64), joined(table.column("counts"), np.int64))
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([pack(hashes)], pa.binary()), pa.array([pack(counts)], pa.binary())], schema=_COUNTS)

    return docs.select("text").mapInArrow(counted, _COUNTS_DDL).groupBy("part").applyInArrow(merged, _COUNTS_DDL)


def vocabulary_of(counts: DataFrame, n_texts: int) -> Vocabulary:
    """Only words with over 1 / HOT of all tokens come to the driver: fewer than HOT."""

    def sums(batches):
        for batch in batches:
            c = joined(pa.chunked_array([batch.column("counts")]), np.int64)
            yield pa.record_batch({"n": pa.array([int(c.sum())], pa.int64()), "v": pa.array([len(c)], pa.int64())})

    got = counts.select("counts").mapInArrow(sums, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, distinct = (got["n"] or 0) + n_texts, (got["v"] or 0) + (n_texts > 0)

    def hot(batches):
        for batch in batches:
            for h, c in zip(batch.column("hashes"), batch.column("counts")):
                h, c = unpack_pair(h, c)
                keep = c * HOT > tokens
                yield pa.record_batch({"h": pa.array([h[keep].tobytes()], pa.binary()), "c": pa.array([c[keep].tobytes()], pa.binary())})

    found = counts.select("hashes", "counts").mapInArrow(hot, "h binary, c binary").collect()
    hashes = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    numbers = np.concatenate([np.frombuffer(r["c"], np.int64) for r in found] or [np.zeros(0, np.int64)])
    return build_vocabulary(hashes, numbers, tokens, distinct, n_texts)


def unpack_pair(h: pa.Scalar, c: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return joined(pa.chunked_array([[h.as_py()]], pa.binary()), np.uint64), joined(pa.chunked_array([[c.as_py()]], pa.binary()), np.int64)


def groups(batches, vocabulary: Vocabulary, hot_too: bool = True):
    """What read_texts() gives for the texts of several pieces, about GROUP_TOKENS tokens together, and the pieces' other columns."""

    def together(held: list):
        at = np.cumsum([0, *(x[4][-1] for x in held)])
        lo = np.concatenate([x[4][:-1] + a for x, a in zip(held, at)] + [at[-1:]])
        return pa.Table.from_batches([x[0] for x in held]).combine_chunks(), *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)), lo

    held: list = []
    for batch in batches:
        others = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        for piece in pieces(batch):
            held.append((piece.select(others) if others else piece, *read_texts(piece.column("text"), vocabulary, hot_too)))
            if sum(len(x[1]) for x in held) >= GROUP_TOKENS:
                yield together(held)
                held = []
    if held:
        yield together(held)


def train(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """One pass over all training texts: every task trains from the same start, and the results are averaged by tokens."""
    shared = carried(docs.sparkSession, vocabulary)  # fewer than HOT words

    def trained(batches):
        vocabulary = shared()
        trainer = Trainer(Network(vocabulary))
        for _, _, _, ids, lo in groups(batches, vocabulary, hot_too=False):
            trainer.texts(ids, lo)
        if trainer.tokens:
            for block, part in enumerate(np.array_split(trainer.net.flat(), BLOCKS)):
                yield rows(_PARAMS, [[block], [trainer.tokens], [part.tobytes()]])
        tidy()

    def averaged(batches):
        totals: dict = {}
        for batch in batches:
            for block, tokens, values in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), batch.column("values")):
                n, total = totals.get(block, (0, 0.0))
                totals[block] = n + tokens, total + tokens * raw(values.as_buffer(), np.float32).astype(np.float64)
        for block, (n, total) in totals.items():
            yield rows(_PARAMS, [[block], [n], [(total / n).astype(np.float32).tobytes()]])

    ddl = "block int, tokens long, values binary"
    parts = docs.select("text").mapInArrow(trained, ddl).repartition(BLOCKS, "block").mapInArrow(averaged, ddl).collect()  # BLOCKS rows, the size of one network
    net = Network(vocabulary)
    if parts:
        net.load(np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(parts, key=lambda r: r["block"])]))
    return net


def scores(docs: DataFrame, train_rows: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    Null and empty texts are the end of text alone. A null doc_id counts as the empty text in the split. Repeated rows are scored
    each. Without training rows all words are unknown and the network is as it starts. Empty tables give empty results; further
    columns are dropped. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learn = docs.filter(training_rows() if train_rows is None else train_rows)
    bits = range_bits(docs, RANGE_CHARS)
    counts = durable(count_words(learn, bits))
    vocabulary = vocabulary_of(counts, learn.count())
    net = train(learn, vocabulary)
    shared = carried(spark, (vocabulary, net))

    per_token, n_train = np.log10(vocabulary.tokens + vocabulary.distinct + 1.0), vocabulary.tokens

    def looked_up(batches):
        """Texts' own figures, and the words that are not hot, by hash range."""
        vocabulary, net = shared()
        log_counts = vocabulary.log_counts
        for piece, hot, hashes, ids, lo in groups(batches, vocabulary):
            n = piece.num_rows
            rids = np.ascontiguousarray(piece.column("rid").to_numpy())
            text = np.repeat(np.arange(n), np.diff(lo))
            own = np.zeros(n, _OWN)
            own["doc_id"] = piece.column("doc_id").fill_null(0).to_numpy()
            own["has_id"] = piece.column("doc_id").is_valid().to_numpy()
            own["copies"], own["n_tokens"] = 1, np.diff(lo)
            own["tail"] = np.bincount(text[ids == vocabulary.tail], minlength=n)
            own["network"] = score(net, ids, lo)
            is_hot = hot >= 0
            if vocabulary.tokens:
                known = np.bincount(text[is_hot], minlength=n).astype(np.int64)
                logs = np.bincount(text[is_hot], log_counts[hot[is_hot]], n)
                head = is_hot & (ids != vocabulary.tail)
                tail_logs = logs - np.bincount(text[head], log_counts[hot[head]], n)
            else:
                known, logs, tail_logs = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            own["network"] += tail_logs - own["tail"] * vocabulary.tail_log
            part = (rids.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
            out = {"part": [], "hashes": [], "place": [], "rids": [], "partial": []}
            for k in np.unique(part):
                at = part == k
                for name, value in zip(out, (int(k), None, None, None, {"part": int(k), "rids": rids[at].tobytes(), "known": known[at].tobytes(), "logs": logs[at].tobytes(), "own": own[at].tobytes()})):
                    out[name].append(value)
            rare, rare_text = hashes[~is_hot], text[~is_hot]
            order = np.argsort(rare)
            rare, rare_text = rare[order], rare_text[order].astype(np.uint32)
            for k, a, z in by_range(rare, bits):
                near, place = np.unique(rare_text[a:z], return_inverse=True)
                place = place.astype(np.uint16 if len(near) <= 1 << 16 else np.uint32)
                for name, value in zip(out, (k, pack(rare[a:z]), pack(place), rids[near].tobytes(), None)):
                    out[name].append(value)
            yield rows(_LOOKUP, list(out.values()))
        tidy()

    def resolved(lookups: pa.Table, table: pa.Table) -> pa.Table:
        """Counts of one range's words, summed for each text and sent on by text."""
        hashes, numbers = joined(table.column("hashes"), np.uint64), joined(table.column("counts"), np.int64)
        out = [x for x in lookups.column("partial").to_pylist() if x is not None]
        sums: dict = {}
        for h, p, r in zip(*(lookups.column(c) for c in ("hashes", "place", "rids"))):
            if not h.is_valid or not len(hashes):
                continue
            h = joined(pa.chunked_array([[h.as_py()]], pa.binary()), np.uint64)
            p = joined(pa.chunked_array([[p.as_py()]], pa.binary()), np.uint16 if len(p.as_buffer()) == 2 * len(h) else np.uint32)
            rids = raw(r.as_buffer(), np.int64)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            known = np.bincount(p[hit], minlength=len(rids)).astype(np.int64)
            logs = np.bincount(p[hit], np.log10(numbers[at[hit]] + 1.0), len(rids))
            part = (rids.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
            for k in np.unique(part[known > 0]):
                on = (part == k) & (known > 0)
                sums.setdefault(int(k), []).append((rids[on], known[on], logs[on]))
        for k, found in sums.items():
            r, n, x = map(np.concatenate, zip(*found))
            out.append({"part": k, "rids": r.tobytes(), "known": n.tobytes(), "logs": x.tobytes(), "own": None})
        return pa.Table.from_pylist(out, schema=_PARTIAL)

    def finished(table: pa.Table) -> pa.Table:
        rids, known, logs = (joined(table.column(c), t, raw) for c, t in (("rids", np.int64), ("known", np.int64), ("logs", np.float64)))
        has_own = [o.is_valid for o in table.column("own")]
        mine = np.repeat(has_own, [len(x.as_buffer()) // 8 for x in table.column("rids")])
        own = np.concatenate([raw(o.as_buffer(), _OWN) for o in table.column("own") if o.is_valid] or [np.zeros(0, _OWN)])
        uniq, place = np.unique(rids, return_inverse=True)
        n_known, total, rare = np.bincount(place, known, len(uniq)), np.bincount(place, logs, len(uniq)), np.bincount(place[~mine], logs[~mine], len(uniq))
        at = place[mine]
        copies = np.bincount(at, minlength=len(uniq))
        per = np.maximum(copies, 1)[at]  # equal rows have equal sums, added up
        base = total[at] / per - own["n_tokens"] * per_token
        final = own["network"] + rare[at] / per
        ids = pa.array(own["doc_id"], pa.int64(), mask=own["has_id"] == 0)
        return pa.table([ids, pa.array(own["n_tokens"]), pa.array(np.round(n_known[at] / per).astype(np.int64)), pa.array(base), pa.array(final)], schema=_SCORES)

    struct = f"struct<{', '.join(x.replace(' ', ':') for x in _PARTIAL_DDL.split(', '))}>"
    rid = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("rid")
    sent = docs.select("doc_id", "text", rid).mapInArrow(looked_up, f"part int, hashes binary, place binary, rids binary, partial {struct}")
    partial = sent.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(resolved, _PARTIAL_DDL)
    out = partial.groupBy("part").applyInArrow(finished, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~training_rows()).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
