"""Hard negatives by a vantage-point tree over norm-augmented vectors.

With M the largest norm, a vector x gets the further component sqrt(M^2 - |x|^2) and an anchor a gets 0: then all rows have norm M, and
|a - x|^2 = |a|^2 + M^2 - 2 a.x, so the highest scores are nearest, and a window of scores is an annulus around the anchor. A tree over
a bounded sample deals all rows to shards, each shard has a tree of its own, and anchors read them nearest first.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, durable, tidy

#: Rows of a shard; rows of a leaf of its tree; anchors that travel together.
SHARD_ROWS = 1 << 15
LEAF_ROWS = 256
BLOCK = 256
#: Sample rows from which the shards are laid out, and at most so many of them (a leaf with more rows than SHARD_ROWS is dealt by row number).
SAMPLE_ROWS = 1 << 14
MOST_LEAVES = 1 << 11
#: Anchors for which a shard is sent out once.
SLICE = 1 << 16
#: Integer norms up to here have exact scores in double precision.
MOST_NORM = 1 << 53
_ROWS_DDL = "row long, id long, label long, anchor boolean, norm long, vector binary"
_RESULT_DDL = "anchor long, anchor_id long, tag long, tag_id long, tag_score long, row long, id long, score long"
_RESULT = pa.schema([(name, pa.int64()) for name in ("anchor", "anchor_id", "tag", "tag_id", "tag_score", "row", "id", "score")])


def _prepare(batches, scale: float):
    """Components times scale, rounded down, as bytes of int32; rows with null or non-finite components stay out."""
    for batch in batches:
        keep = {name: [] for name in ("row", "id", "label", "anchor", "norm", "vector")}
        vectors = batch.column("vector")
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(np.diff(vectors.offsets.to_numpy()))
        columns = [batch.column(c).to_pylist() for c in ("row", "id", "label", "anchor")]
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.floor(flat * scale)
        for k, values in enumerate(zip(*columns)):
            v = whole[ends[k - 1] if k else 0 : ends[k]]
            with np.errstate(invalid="ignore", over="ignore"):
                norm = float(v @ v)
            if not norm < MOST_NORM:  # also not a number
                continue
            for name, value in zip(keep, (*values, int(norm), v.astype(np.int32).tobytes())):
                keep[name].append(value)
        yield pa.record_batch([pa.array(keep[n], t) for n, t in (("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("norm", pa.int64()), ("vector", pa.binary()))], names=list(keep))


def matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    """Rows of int32 components; a shorter vector ends in zeros."""
    if all(len(v) == 4 * dims for v in vectors):
        return np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), dims)
    return np.array([np.pad(np.frombuffer(v, np.int32), (0, dims - len(v) // 4)) for v in vectors], np.int32).reshape(len(vectors), dims)


def distances(x: np.ndarray, norms: np.ndarray, v: np.ndarray, norm: float, top: float) -> np.ndarray:
    """From augmented rows x to one augmented vector v."""
    lift = np.sqrt(np.maximum(0, top - norms)) - math.sqrt(max(0, top - norm))
    return np.sqrt(np.maximum(0, norms + norm - 2 * (x @ v) + lift * lift))


@dataclass
class Tree:
    """Inner nodes with a vantage point, and what distances from it the rows of both children have; leaves are ranges of rows.

    A child below 0 is the leaf ~child. `labels` holds the smallest and largest label under each child.
    """

    vantage: np.ndarray
    norms: np.ndarray
    top: float
    children: np.ndarray
    spans: np.ndarray
    labels: np.ndarray
    leaves: list[tuple[int, int]] = field(default_factory=list)

    @property
    def slack(self) -> float:
        """More than the rounding errors of a distance."""
        return 1e-6 * math.sqrt(self.top) + 1e-9

    def from_anchors(self, a: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Distances from anchors (their further component is 0) to all vantage points."""
        return np.sqrt(np.maximum(0, norms[:, None] + self.top - 2 * (a @ self.vantage.T)))


def grow(x: np.ndarray, norms: np.ndarray, labels: np.ndarray, top: float, leaf_rows: int, most_depth: int = 62) -> tuple[Tree, np.ndarray]:
    """A tree, and the order of rows in which its leaves are ranges. A node's vantage point is its row farthest from its first row.

    Rows are halved by their rank in distance, so rows at equal distances part too.
    """
    vantage, children, spans, seen, leaves, order, at = [], [], [], [], [], [], 0
    stack: list = [(np.arange(len(x)), None, most_depth)]
    while stack:
        own, place, depth = stack.pop()
        if len(own) <= leaf_rows or not depth:
            number = ~len(leaves)
            leaves.append((at, at + len(own)))
            order.append(own)
            at += len(own)
        else:
            first = own[0]
            v = own[int(np.argmax(distances(x[own], norms[own], x[first], norms[first], top)))]
            d = distances(x[own], norms[own], x[v], norms[v], top)
            ranked = np.argsort(d, kind="stable")
            half = len(own) // 2
            number = len(vantage)
            vantage.append(v)
            children.append([0, 0])
            spans.append([[d[s].min(), d[s].max()] for s in (ranked[:half], ranked[half:])])
            seen.append([[labels[own[s]].min(), labels[own[s]].max()] for s in (ranked[:half], ranked[half:])])
            stack += [(own[ranked[half:]], (number, 1), depth - 1), (own[ranked[:half]], (number, 0), depth - 1)]
        if place:
            children[place[0]][place[1]] = number
    v = np.array(vantage, np.int64)
    tree = Tree(x[v], norms[v], top, np.array(children, np.int64).reshape(-1, 2), np.array(spans, float).reshape(-1, 2, 2), np.array(seen, np.int64).reshape(-1, 2, 2), leaves)
    return tree, np.concatenate(order) if order else np.zeros(0, np.int64)


def as_partition(tree: Tree) -> Tree:
    """The tree of a sample as a rule for all rows: the near child takes what is no farther than the sample's near rows."""
    border = tree.spans[:, 0, 1]
    tree.spans = np.stack([np.column_stack([np.zeros(len(border)), border]), np.column_stack([border, np.full(len(border), np.inf)])], 1)
    return tree


def leaves_of(tree: Tree, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The leaf of the partition that each row falls in."""
    out = np.zeros(len(x), np.int64)
    stack = [(0, np.arange(len(x)))] if len(tree.children) else []
    while stack:
        node, own = stack.pop()
        if not len(own):
            continue
        if node < 0:
            out[own] = ~node
            continue
        near = distances(x[own], norms[own], tree.vantage[node], tree.norms[node], tree.top) <= tree.spans[node, 0, 1]
        stack += [(int(tree.children[node, 0]), own[near]), (int(tree.children[node, 1]), own[~near])]
    return out


def leaf_bounds(tree: Tree, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances from anchors to the rows of each leaf; d: from anchors to vantage points."""
    n = max(1, len(tree.leaves))
    low, high = np.zeros((len(d), n)), np.full((len(d), n), np.inf)
    stack = [(0, np.zeros(len(d)), np.full(len(d), np.inf))] if len(tree.children) else []
    while stack:
        node, lo, hi = stack.pop()
        if node < 0:
            low[:, ~node], high[:, ~node] = lo, hi
            continue
        for side in (0, 1):
            a, b = tree.spans[node, side]
            here = d[:, node]
            stack.append((int(tree.children[node, side]), np.maximum(lo, np.maximum(a - here, here - b) - tree.slack), np.minimum(hi, here + b + tree.slack)))
    return low, high


@dataclass
class Shard:
    """A tree with its rows in the leaves' order; the rows of a leaf are sorted by (id, row), null ids last."""

    tree: Tree
    x: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    rows: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, norms: np.ndarray, labels: np.ndarray, ids: list, rows: np.ndarray, top: float, leaf_rows: int) -> Shard:
        known = np.array([i is not None for i in ids], bool)
        ids = np.array([i or 0 for i in ids], np.int64)
        sorted_rows = np.lexsort((rows, ids, ~known))
        x, norms, labels, ids, known, rows = (c[sorted_rows] for c in (x, norms, labels, ids, known, rows))
        tree, order = grow(x.astype(float), norms, labels, top, leaf_rows)
        order = np.concatenate([np.sort(order[a:b]) for a, b in tree.leaves]) if len(order) else order
        return cls(tree, x[order], labels[order], ids[order], known[order], rows[order])

    def blob(self) -> bytes:
        """Plain arrays: classes of this subpackage need not be known where it is read."""
        t = self.tree
        narrow = np.int16 if not self.x.size or np.abs(self.x).max() < 1 << 15 else np.int32
        return pickle.dumps(((t.vantage, t.norms, t.top, t.children, t.spans, t.labels, t.leaves), (self.x.astype(narrow), self.labels, self.ids, self.known, self.rows)))

    @classmethod
    def read(cls, blob) -> Shard:
        tree, (x, *others) = pickle.loads(blob)
        return cls(Tree(*tree), x.astype(float), *others)

    def nearest_first(self, anchor: Anchor, window: tuple[int, int], same: bool):
        """Rows whose label is the anchor's (or another), whose scores lie in the window, by falling score and rising id.

        One heap holds nodes by the least distance they can have and rows by their own, so a row that comes up first is the next one,
        and what is never reached is never opened. Nodes wholly within or beyond the annulus are left out.
        """
        tree, (lowest, highest) = self.tree, window
        inner, outer = (math.sqrt(max(0, anchor.base - 2 * s)) for s in (highest, lowest))
        heap: list = [(0.0, 0, 0 if len(tree.children) else ~0, 0.0, math.inf)] if len(self.rows) else []
        slack = tree.slack
        while heap:
            item = heapq.heappop(heap)
            if item[1]:
                yield item[-1]
                continue
            _, _, node, low, high = item
            if node < 0:
                for entry in self._of_leaf(~node, anchor, lowest, highest, same):
                    heapq.heappush(heap, entry)
                continue
            d = anchor.distances[node]
            for side in (0, 1):
                a, b = tree.spans[node, side]
                lo, hi = max(low, a - d - slack, d - b - slack), min(high, d + b + slack)
                least, most = tree.labels[node, side]
                if lo > outer + slack or hi < inner - slack or (least > anchor.label or most < anchor.label if same else least == most == anchor.label):
                    continue
                heapq.heappush(heap, (lo * lo - slack * slack, 0, int(tree.children[node, side]), lo, hi))

    def _of_leaf(self, leaf: int, anchor: Anchor, lowest: int, highest: int, same: bool):
        a, b = self.tree.leaves[leaf]
        scores = anchor.scores.get(leaf)
        if scores is None:
            scores = anchor.scores[leaf] = self.x[a:b] @ anchor.vector
        fits = ((self.labels[a:b] == anchor.label) == same) & (scores >= lowest) & (scores <= highest) & (self.rows[a:b] != anchor.row)
        at = np.flatnonzero(fits)
        if len(at) > anchor.k:
            at = at[np.argsort(-scores[at], kind="stable")[: anchor.k]]
        for i in at.tolist():
            score, known = int(scores[i]), bool(self.known[a + i])
            number, row = int(self.ids[a + i]), int(self.rows[a + i])
            yield (anchor.base - 2 * score, 1, not known, number, row, (row, number if known else None, score))


@dataclass
class Anchor:
    """What a search needs of one anchor: |a|^2 + M^2 as base, distances to the shard's vantage points, scores of leaves once read."""

    row: int
    label: int
    vector: np.ndarray
    base: int
    distances: list[float]
    k: int
    scores: dict[int, np.ndarray] = field(default_factory=dict)


def _search(batches, k: int, same: bool):
    """Rows of a task: each shard, then the blocks of anchors that read it."""
    shard, out = None, []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("payload")):
            if kind == 0:
                shard = Shard.read(blob.as_buffer())
                continue
            given = pickle.loads(blob.as_buffer())
            a = given["vectors"].astype(float)
            away = shard.tree.from_anchors(a, given["norms"]).tolist()
            for n, (row, number, label, windows) in enumerate(given["anchors"]):
                anchor = Anchor(row, label, a[n], int(given["norms"][n]) + int(shard.tree.top), away[n], k)
                for tag, tag_id, tag_score, lowest, highest in windows:
                    if lowest <= highest:
                        for found, _ in zip(shard.nearest_first(anchor, (lowest, highest), same), range(k)):
                            out.append((row, number, tag, tag_id, tag_score, *found))
            if len(out) > 1 << 15:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=_RESULT)
                out = []
    if out:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=_RESULT)
    del shard
    tidy()


@dataclass
class Index:
    """The written rows, the partition of all rows, how many shards each of its leaves has, and the shards."""

    rows: DataFrame
    shards: DataFrame
    partition: Tree
    split: np.ndarray
    dims: int


def index(vectors: DataFrame, scale: float = 1.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> Index:
    """Index of rows (id, label, anchor, vector); the vectors' components are multiplied by scale and rounded down."""
    given = vectors.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), "vector")
    rows = durable(given.mapInArrow(lambda batches: _prepare(batches, scale), _ROWS_DDL))
    facts = rows.agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(F.length("vector")).alias("bytes")).first()
    n, top, dims = facts["n"], float(facts["top"] or 0), (facts["bytes"] or 0) // 4
    wanted = min(MOST_LEAVES, -(-n // shard_rows))
    sample = rows.orderBy(F.xxhash64("row")).select("vector", "norm").limit(SAMPLE_ROWS).collect() if wanted > 1 else []
    x = matrix([bytes(r["vector"]) for r in sample], dims).astype(float)
    tree, _ = grow(x, np.array([r["norm"] for r in sample], float), np.zeros(len(sample), np.int64), top, 1, (max(1, wanted) - 1).bit_length())
    partition = as_partition(tree)
    held = carried(rows.sparkSession, partition)

    @F.arrow_udf("int")
    def leaf_of(vector: pa.Array, norm: pa.Array) -> pa.Array:
        return pa.array(leaves_of(held(), matrix(vector.to_pylist(), dims).astype(float), norm.to_numpy(zero_copy_only=False).astype(float)), pa.int32())

    placed = rows.withColumn("leaf", leaf_of("vector", "norm"))
    if len(partition.children):
        placed = durable(placed)
    split = np.zeros(max(1, len(partition.leaves)), np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row for each leaf
        split[r["leaf"]] = -(-r["count"] // shard_rows)
    starts, counts = (F.array(*[F.lit(int(v)) for v in values]) for values in (np.r_[0, np.cumsum(split)][:-1], split))
    of_leaf = lambda values: F.element_at(values, F.col("leaf") + 1)
    dealt = placed.withColumn("shard", (of_leaf(starts) + F.pmod(F.col("row"), of_leaf(counts))).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        found = matrix(table["vector"].to_pylist(), dims)
        numbers = (table[c].to_numpy() for c in ("norm", "label", "row"))
        norms, labels, own = (next(numbers) for _ in range(3))
        shard = Shard.build(found, norms.astype(float), labels, table["id"].to_pylist(), own, top, leaf_rows)
        return pa.table({"shard": table["shard"][:1], "payload": pa.array([shard.blob()], pa.binary())})

    shards = durable(dealt.groupBy("shard").applyInArrow(build, "shard int, payload binary"))
    return Index(rows, shards, partition, split, dims)


def _blocks(batches, partition: Tree, split: np.ndarray, dims: int, elsewhere: bool):
    """Packs anchors (sorted by leaf) into blocks, each with the shards that it must read: the first one of its own leaf, or, `elsewhere`,
    all others that can hold a row of one of its windows."""
    before = np.r_[0, np.cumsum(split)]
    waiting: list = []

    def pack():
        a = matrix([r["vector"] for r in waiting], dims)
        norms = np.array([r["norm"] for r in waiting], float)
        home = waiting[0]["leaf"]
        targets = [int(before[home])]
        if elsewhere:
            low, high = leaf_bounds(partition, partition.from_anchors(a.astype(float), norms))
            ends = np.array([(w["lowest"], w["highest"], n) for n, r in enumerate(waiting) for w in r["windows"] if w["lowest"] <= w["highest"]], float).reshape(-1, 3)
            own = ends[:, 2].astype(np.int64)
            base = norms[own] + partition.top
            outer, inner = np.sqrt(np.maximum(0, base - 2 * ends[:, 0])), np.sqrt(np.maximum(0, base - 2 * ends[:, 1]))
            reached = ((low[own] <= outer[:, None] + partition.slack) & (high[own] >= inner[:, None] - partition.slack)).any(0)
            targets = [s for leaf in np.flatnonzero(reached).tolist() for s in range(int(before[leaf]), int(before[leaf + 1])) if s != targets[0]]
        anchors = [(r["row"], r["id"], r["label"], [tuple(w[c] for c in ("tag", "tag_id", "tag_score", "lowest", "highest")) for w in r["windows"]]) for r in waiting]
        blob = pickle.dumps({"vectors": a, "norms": norms, "anchors": anchors})
        number = waiting[0]["row"]
        waiting.clear()
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([targets], pa.list_(pa.int32())), pa.array([blob], pa.binary())], names=["block", "targets", "payload"])

    for batch in batches:
        for r in batch.to_pylist():
            if waiting and (len(waiting) == BLOCK or waiting[0]["leaf"] != r["leaf"]):
                yield pack()
            waiting.append(r)
    if waiting:
        yield pack()


def _read(found: Index, anchors: DataFrame, number: int, k: int, same: bool, elsewhere: bool) -> DataFrame:
    """The first k rows of each window of the anchors (so many of them), from each shard that must be read."""
    spark = anchors.sparkSession
    partition, split, dims = found.partition, found.split, found.dims
    held = carried(spark, partition)

    @F.arrow_udf("int")
    def home_of(vector: pa.Array, norm: pa.Array) -> pa.Array:
        tree = held()
        low, _ = leaf_bounds(tree, tree.from_anchors(matrix(vector.to_pylist(), dims).astype(float), norm.to_numpy(zero_copy_only=False).astype(float)))
        return pa.array(np.where(split > 0, low, np.inf).argmin(1), pa.int32())

    shards, parallel = max(1, int(split.sum())), spark.sparkContext.defaultParallelism
    near = anchors.withColumn("leaf", home_of("vector", "norm")).repartitionByRange(parallel, "leaf", "row").sortWithinPartitions("leaf", "row")
    blocks = near.mapInArrow(lambda batches: _blocks(batches, held(), split, dims, elsewhere), "block long, targets array<int>, payload binary")
    slices = max(1, -(-number // SLICE), min(-(-2 * parallel // shards), -(-number // BLOCK)))
    sent = blocks.select(F.explode("targets").alias("shard"), F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "block", "payload")
    held_out = found.shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "payload")
    parts = min(shards * slices, 1 << 16)
    dealt = held_out.unionByName(sent).withColumn("part", ((F.col("shard").cast("long") * slices + F.col("slice")) % parts).cast("int"))
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("shard", "slice", "kind", "block").select("kind", "payload")
    return ordered.mapInArrow(lambda batches: _search(batches, k, same), _RESULT_DDL)


def top(found: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The first k rows of each window of the anchors, in all shards, with their rank.

    The shard that each anchor falls in is read first. Its k-th score, if it has k rows, narrows the window for all other shards, so
    they are read only where their rows can still come in, and give few rows.
    """
    number = anchors.count()
    first = durable(_read(found, anchors, number, k, same, False))
    bound = first.groupBy("anchor", "tag").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    opened = anchors.select("row", F.explode("windows").alias("w"))
    match = (opened["row"] == bound["anchor"]) & opened["w.tag"].eqNullSafe(bound["tag"])
    narrowed = opened.join(bound, match, "left").groupBy("row").agg(
        F.collect_list(F.struct("w.tag", "w.tag_id", "w.tag_score", F.greatest("w.lowest", F.coalesce("kth", "w.lowest")).alias("lowest"), "w.highest")).alias("windows")
    )
    rest = _read(found, anchors.drop("windows").join(narrowed, "row"), number, k, same, True)
    order = Window.partitionBy("anchor", "tag").orderBy(F.col("score").desc(), F.asc_nulls_last("id"), "row")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(*columns: Column) -> Column:
    return F.struct(*(c.cast("long").alias(n) for c, n in zip(columns, ("tag", "tag_id", "tag_score", "lowest", "highest"))))


def hard_negatives(
    vectors: DataFrame, k: int = 5, positives: int = 5, low: int = 80, high: int = 100, scale: float = 1.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: id, label, anchor (boolean), vector (array of numbers); further columns are ignored. The score of a row is its inner product
    with the anchor, both multiplied by scale and rounded down. An anchor's positives are its first rows of the same label, itself
    left out; negatives of a positive with score p are the first k rows of other labels with low * p <= 100 * score <= high * p. Higher
    scores come first, then smaller ids, null ids last. Everything is exact, whatever the index prunes.

    Rows with a null label, vector or component, with a component that is not finite, or with an integer norm squared of 2^53 or more
    (whose scores wouldn't be exact) take no part. Shorter vectors end in zeros. A null anchor is false. Repeated rows are rows of their
    own, anchors too. Empty tables, anchors without positives and positives without negatives give no rows.

    The partition is laid out on at most SAMPLE_ROWS rows; all rows are indexed. Equal or near vectors of any number share leaves, which
    are dealt to as many shards as they need by row number. A task holds one shard and a block of anchors; each window gives k rows of
    each shard at most, merged by a window function.
    """
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull())
    cast = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "anchor", F.col("vector").cast("array<double>").alias("vector"))
    found = index(cast.where(usable), scale, shard_rows, leaf_rows)
    anchors = found.rows.where("anchor").drop("anchor")
    most = F.lit(MOST_NORM)
    nothing = F.lit(None)
    own = durable(top(found, anchors.withColumn("windows", F.array(_windows(nothing, nothing, nothing, -most, most))), positives, True))
    lowest = F.expr(f"if(score >= 0, (score * {low} + 99) div 100, score * {low} div 100)")
    highest = F.expr(f"if(score >= 0, score * {high} div 100, (score * {high} - 99) div 100)")
    asked = own.groupBy("anchor").agg(F.collect_list(_windows(F.col("row"), F.col("id"), F.col("score"), lowest, highest)).alias("windows"))
    negatives = top(found, durable(anchors.join(asked.withColumnRenamed("anchor", "row"), "row")), k, False)
    return negatives.select(
        F.col("anchor_id"), F.col("tag_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("tag_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
