"""Best-fit packing: token pieces fill sequences by exact complements of lengths, and what is left by best fit.

Which lengths go together is planned from the counts of the lengths alone, of which there are as many as a sequence has tokens. Spark
numbers the pieces of each length, and the plan turns these numbers into sequences and places.
"""

from __future__ import annotations

import collections
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces, tidy

ROOM = 1024
END = 2
#: Words that a Python worker remembers the ids of (about 250 bytes each).
REMEMBERED = 1 << 20
_WORD = re.compile(r" (?=\S)")
#: Words of ASCII characters but the apostrophe and of Latin letters, and their runs of letters, digits and others.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ʯ]+")
_RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-ʯ]+|[0-9]+|[^A-Za-z0-9À-ÖØ-öø-ʯ]+")
#: How a byte-level vocabulary shows each byte: printable characters of Latin-1 as themselves, the others from U+0100 on, in order.
_SHOWN = [chr(b) if b in range(33, 127) or b in range(161, 173) or b in range(174, 256) else "" for b in range(256)]
for _n, _b in enumerate([b for b in range(256) if not _SHOWN[b]]):
    _SHOWN[_b] = chr(256 + _n)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


class Odd(Exception):
    """White space begins a word: its space can belong to what stands before."""


class Encoder(dict):
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers, by a file of the tokenizers library with a byte-level vocabulary.

    Such a vocabulary never joins what stands before a space to a word behind it, and the word takes the space ("Ġ") along. So texts are
    looked up word by word, in this dictionary, and only words not met before are encoded: a plain one as runs of letters, digits and
    others, which the vocabulary keeps apart, any other by the library's whole path. The ids are those of the whole text.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.runs: dict[str, bytes] = {}

    @classmethod
    def here(cls, path: str) -> Encoder:
        """This process's encoder for a file: Spark's Python workers go on to further tasks, and the words they know go along.

        It is kept beside the library's module, as classes of this subpackage are made anew for each task.
        """
        import tokenizers

        made = tokenizers.__dict__.setdefault("_melisma_encoders", {})
        if path not in made:
            made[path] = cls(path)
        return made[path]

    def __call__(self, text: str) -> bytes:
        head, *words = text.split(" ")
        try:
            ids = b"".join(map(self.__getitem__, words))
        except Odd:
            head, *words = _WORD.split(text)
            ids = b"".join(map(self.__getitem__, words))
        return self.of(head) + ids if head else ids

    def of(self, text: str) -> bytes:
        return packed(self.whole.encode(text, add_special_tokens=False).ids)

    def __missing__(self, w: str) -> bytes:
        """The ids of a word with a space before it."""
        if w.isascii() and w.isalpha():
            ids = self.of_run("Ġ" + w)
        elif not w or w[0].isspace():
            raise Odd
        elif not _PLAIN.fullmatch(w):
            ids = self.of(" " + w)
        else:
            first, *rest = _RUNS.findall(w)
            ids = self[first] + b"".join(map(self.later, rest)) if rest else self.of_run("Ġ" + shown(w))
        if len(self) >= REMEMBERED:
            self.clear()
            self.runs.clear()
        self[w] = ids
        return ids

    def of_run(self, run: str) -> bytes:
        return packed([t.id for t in self.model.tokenize(run)])

    def later(self, run: str) -> bytes:
        """The ids of a run within a word."""
        ids = self.runs.get(run)
        if ids is None:
            ids = self.runs[run] = self.of_run(shown(run))
        return ids


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def shown(run: str) -> str:
    return run if run.isascii() else "".join(map(_SHOWN.__getitem__, run.encode()))


def cuts(n: int, room: int = ROOM) -> list[int]:
    """Where the pieces of n ids begin: all have `room` ids, but for the first."""
    return [0, *range((n - 1) % room + 1, n, room)]


def _encode(batches, path: str, room: int, end: int):
    encode, met = Encoder.here(path), collections.Counter()
    last = packed([end])
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    for batch in (p for b in batches for p in pieces(b, "text", 1 << 20)):
        out = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), map(encode, batch.column("text").fill_null("").to_pylist())):
            ids += last
            starts = cuts(len(ids) // 4, room)
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids) // 4])):
                out.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, met[b - a]))
                met[b - a] += 1
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "number")
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    tidy()


class Stock:
    """How many pieces of each length there are, and which sums one, two or three of them have."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        self.there = self.counts > 0
        self.pairs: np.ndarray | None = None

    def take(self, lengths: dict[int, int], times: int) -> None:
        for length, copies in lengths.items():
            self.counts[length] -= copies * times
            if self.counts[length] < 1 and self.there[length]:
                self.there[length], self.pairs = False, None

    def pair_sums(self) -> np.ndarray:
        """For each sum, how many ordered pairs of lengths have it (counts of equal lengths are looked at when a pair is taken)."""
        if self.pairs is None:
            n = len(self.counts)
            self.pairs = np.rint(np.fft.irfft(np.fft.rfft(self.there, 2 * n) ** 2, 2 * n)[:n]).astype(np.int64)
        return self.pairs

    def left(self, used: dict[int, int], length: int) -> int:
        return int(self.counts[length]) - used.get(length, 0)

    def pair(self, used: dict[int, int], gap: int, most: int) -> tuple[int, int] | None:
        """Two lengths that fill the gap, the larger as large as can be but not over `most`."""
        high = min(gap - 1, most)
        low = (gap + 1) // 2
        if high < low:
            return None
        both = np.flatnonzero(self.there[low : high + 1] & self.there[gap - high : gap - low + 1][::-1])
        for a in (both[::-1] + low).tolist():
            need = collections.Counter((a, gap - a))
            if all(self.left(used, x) >= c for x, c in need.items()):
                return a, gap - a
        return None

    def exact(self, used: dict[int, int], gap: int) -> tuple[int, ...]:
        """One, two or three lengths that fill the gap and are there beside those used, or none."""
        if self.left(used, gap) > 0:
            return (gap,)
        if found := self.pair(used, gap, gap):
            return found
        sums = self.pair_sums()
        first = np.flatnonzero(self.there[1:gap] & (sums[gap - 1 : 0 : -1] > 0)) + 1
        for a in first[::-1].tolist():
            if 3 * a < gap:
                break
            if self.left(used, a) > 0 and (found := self.pair(used | {a: used.get(a, 0) + 1}, gap - a, a)):
                return (a, *found)
        return ()

    def best(self, used: dict[int, int], gap: int) -> int:
        """The largest length that fits and is there beside those used, or 0."""
        for a in np.flatnonzero(self.there[: gap + 1])[::-1].tolist():
            if self.left(used, a) > 0:
                return a
        return 0


def patterns(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Which lengths share a sequence, as [(length, copies), ...], and in how many sequences; counts[n] pieces have length n.

    The longest piece comes first. One, two or three pieces that fill its gap exactly are taken if they are there; if not, the longest
    that fits, and the rest of the gap is looked at again. The same choice is made for as many sequences as the counts allow, so there are
    few more patterns than lengths, however many pieces there are.
    """
    stock, room = Stock(counts), len(counts) - 1
    made = []
    while stock.there.any():
        longest = int(np.flatnonzero(stock.there)[-1])
        used, gap = {longest: 1}, room - longest
        while gap:
            chosen = stock.exact(used, gap) or ((fit,) if (fit := stock.best(used, gap)) else ())
            if not chosen:
                break
            for a in chosen:
                used[a] = used.get(a, 0) + 1
                gap -= a
        times = min(int(stock.counts[a]) // c for a, c in used.items())
        made.append((list(used.items()), times))
        stock.take(used, times)
    return made


@dataclass
class Plan:
    """Pieces of a length from some number on: their first sequence, place and copies in each sequence."""

    keys: np.ndarray
    sequences: np.ndarray
    places: np.ndarray
    copies: np.ndarray
    n_sequences: int

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (lengths << 48) | numbers, "right") - 1
        nth = numbers - (self.keys[at] & ((1 << 48) - 1))
        return self.sequences[at] + nth // self.copies[at], self.places[at] + lengths * (nth % self.copies[at])


def plan(counts: np.ndarray) -> Plan:
    """The sequence and place of the n-th piece of each length."""
    given = np.zeros(len(counts), np.int64)
    out, sequence = [], 0
    for lengths, times in patterns(counts):
        place = 0
        for length, copies in lengths:
            out.append(((length << 48) | int(given[length]), sequence, place, copies))
            given[length] += copies * times
            place += length * copies
        sequence += times
    columns = np.array(sorted(out), np.int64).reshape(-1, 4).T
    return Plan(*columns, sequence)


def pack(docs: DataFrame, vocabulary: str, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A document's ids are those of its text by the vocabulary (a path that every executor can read) and then `end`; over `room` ids are cut
    into pieces, of which only the first can be shorter. Null and empty texts are the end alone; repeated rows and null doc_ids are
    documents of their own; an empty table gives an empty result; further columns are dropped. Sequences are numbered from 0 and hold
    their pieces without gaps.

    Each text is encoded once. What goes to the driver is a count for each length. Pieces are numbered in two steps: by length within
    the task that encoded them (written, so that the numbers hold when executors are lost), then by the tasks before it.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = durable(given.mapInArrow(lambda batches: _encode(batches, vocabulary, room, end), _PIECES_DDL))
    tasks = cut.groupBy("length", "task").agg(F.count("*").alias("n")).select(
        "length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"),
    )
    counts = np.zeros(room + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # a row for each length
        counts[row["length"]] = row["count"]
    planned = plan(counts)

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def placed(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        sequences, places = planned.place(*(c.to_numpy(zero_copy_only=False) for c in (lengths, numbers)))
        return pa.StructArray.from_arrays([pa.array(sequences), pa.array(places)], ["sequence_id", "offset"])

    numbered = cut.join(tasks, ["length", "task"]).withColumn("at", placed("length", F.col("before") + F.col("number")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def _spans(batches, path: str, end: int):
    encode, last = Encoder.here(path), packed([end])
    for batch in (p for b in batches for p in pieces(b, "text", 1 << 20)):
        columns = [batch.column(c).to_pylist() for c in ("start", "length", "sequence_id", "offset")]
        ids = [(np.frombuffer(i + last, "<u4")[a : a + n].tolist(), s, o) for i, a, n, s, o in zip(map(encode, batch.column("text").fill_null("").to_pylist()), *columns)]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ids), (pa.list_(pa.int32()), pa.int64(), pa.int64()))], names=("ids", "sequence_id", "offset"))


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """sequence_id, ids for what pack() placed; doc_id must be unique and not null. A group holds one sequence."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = packed.select("doc_id", "start", "length", "sequence_id", "offset").join(texts, "doc_id").drop("doc_id")
    ids = spans.mapInArrow(lambda batches: _spans(batches, vocabulary, end), "ids array<int>, sequence_id long, offset long")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return ids.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
