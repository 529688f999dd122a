"""Hard negatives by bounds along a spanning tree of anchors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.scale import number_rows
from tideline.session import materialise, shared_table_path

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percents of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Bytes of anchor vectors in one pass over the rows, anchors of a tree, rows that are bounded together.
PASS_BYTES = 1 << 24
TREE_ANCHORS = 512
CHUNK_ROWS = 4096
_LONG = 2**63
_EXACT = 2.0**53
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
SCORES = "anchor long, slot int, vec_id long, score long"


def usable_rows(rows: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                moved_every: int | None = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, vector of whole numbers): rows with an id, a label and finite components throughout.

    Components become floor(256 x) and saturate at the range of a long. Where the id is divisible by
    ``moved_every`` the label first becomes (label + 1) % ``labels``.
    """
    label = F.col(label_column).cast("long")
    if moved_every:
        label = F.when(F.col(id_column) % moved_every == 0, (label + 1) % labels).otherwise(label)
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite
    ).withColumn("vector", F.transform("vector", lambda x: F.floor(x * 256.0).cast("long")))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of whole vectors given as doubles or Python integers.

    Doubles are exact while the lengths' product is below 2**53; otherwise Python's integers are used
    and a product saturates at the range of a long.
    """
    if a.dtype != object and b.dtype != object:
        reach = np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0)) * np.sqrt(np.einsum("ij,ij->i", b, b).max(initial=0))
        if reach < _EXACT / 4:
            return (a @ b.T).astype(np.int64)
    a, b = (x if x.dtype == object else x.astype(np.int64).astype(object) for x in (a, b))
    whole = a @ b.T
    return np.clip(whole, -_LONG, _LONG - 1).astype(np.int64) if whole.size else np.zeros(whole.shape, np.int64)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(float)
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of one matrix; a shorter one is filled with zeros. Python integers where doubles are not exact."""
    if all(len(v) == width for v in vectors):
        whole = np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    else:
        whole = np.zeros((len(vectors), width), np.int64)
        for row, v in zip(whole, vectors):
            row[: len(v)] = v
    if whole.size and (whole.max() > 2**50 or whole.min() < -(2**50)):
        return whole.astype(object)
    return whole.astype(float)


@dataclass
class Tree:
    """Anchors of one label, each with its parent and its distance to it; parents come first."""

    label: int
    vectors: np.ndarray
    numbers: np.ndarray
    ids: np.ndarray
    parent: np.ndarray = field(init=False)
    edge: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order, parent, edge = spanning_tree(self.vectors)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.vectors, self.numbers, self.ids = self.vectors[order], self.numbers[order], self.ids[order]
        self.parent, self.edge = np.where(parent[order] >= 0, place[parent[order]], -1), edge[order]


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent and edge length of a least spanning tree, grown from the anchor nearest to their mean."""
    v = vectors.astype(float)
    n = len(v)
    parent, edge, order = np.full(n, -1), np.zeros(n), []
    best = _lengths(v - v.mean(axis=0))
    near, open_ = np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        i = int(np.flatnonzero(open_)[np.argmin(best[open_])])
        order.append(i)
        open_[i] = False
        parent[i], edge[i] = near[i], best[i] if near[i] >= 0 else 0.0
        to = _lengths(v - v[i])
        closer = open_ & ((to < best) | (near < 0))
        best[closer], near[closer] = to[closer], i
    return np.array(order, np.int64), parent, edge


def bounded_scores(tree: Tree, vectors: np.ndarray, lengths: np.ndarray, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, exact scores) for the rows whose bounds meet the anchor's window.

    The score at an anchor differs from the score at its parent by at most the edge's length times
    the row's length. A row whose bounds miss the window keeps them, widened by each further edge; any
    other is scored exactly. ``window(anchor)`` is asked when the anchor is reached: (low, high) or None.
    Scores that may saturate have no such bounds; then all rows are scored.
    """
    bounded = tree.vectors.dtype != object and vectors.dtype != object
    low, high = np.empty((len(tree.parent), len(vectors))), np.empty((len(tree.parent), len(vectors)))
    for i, p in enumerate(tree.parent):
        wanted = window(i)
        if p < 0:
            rows = np.arange(len(vectors))
        else:
            reach = tree.edge[i] * lengths
            np.subtract(low[p], reach, out=low[i])
            np.add(high[p], reach, out=high[i])
            if wanted is None:
                continue
            # a part in 10**9 is far more than the bounds lose by rounding
            slack = 1.0 + 1e-9 * (np.abs(low[i]) + np.abs(high[i]))
            rows = np.flatnonzero((high[i] + slack >= wanted[0]) & (low[i] - slack <= wanted[1])) if bounded else np.arange(len(vectors))
        scores = inner(tree.vectors[i : i + 1], vectors[rows])[0] if len(rows) else np.zeros(0, np.int64)
        low[i, rows] = high[i, rows] = scores
        if wanted is not None and len(rows):
            yield i, rows, scores


class _Best:
    """The best ``k`` (score, id) seen for each key: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def least(self, key) -> int | None:
        """The score of the k-th, if there are k."""
        held = self.held.get(key)
        return int(held[0][-1]) if held and len(held[0]) == self.k else None

    def offer(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.held:
            scores, ids = np.concatenate([self.held[key][0], scores]), np.concatenate([self.held[key][1], ids])
        if len(scores) > 8 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        order = np.lexsort((ids, ~scores))[: self.k]
        self.held[key] = scores[order], ids[order]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        sizes = [len(s) for s, _ in self.held.values()]
        anchors, slots = (np.repeat(np.array([k[i] for k in self.held], np.int64), sizes) for i in (0, 1))
        scores, ids = (np.concatenate([v[i] for v in self.held.values()]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(slots, pa.int32()), pa.array(ids), pa.array(scores)], ["anchor", "slot", "vec_id", "score"])


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, ids, vectors) of some thousand rows of one label at a time."""
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        vectors = batch.column("vector")
        lists = matrix([v.values.to_numpy(zero_copy_only=False) for v in vectors], width)
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            for a in range(0, len(mine), CHUNK_ROWS):
                rows = mine[a : a + CHUNK_ROWS]
                yield int(label), ids[rows], lists[rows]


def _positives(rows: DataFrame, trees, width: int, k: int) -> DataFrame:
    """The best ``k`` rows of each anchor's label, as each task knows them."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for label, ids, vectors in _chunks(batches, width):
            lengths = _lengths(vectors)
            for tree in trees.value:
                if tree.label != label:
                    continue

                def window(i):
                    least = best.least((int(tree.numbers[i]), 0))
                    return (-np.inf if least is None else least, np.inf)

                for i, at, scores in bounded_scores(tree, vectors, lengths, window):
                    other = ids[at] != tree.ids[i]
                    best.offer((int(tree.numbers[i]), 0), scores[other], ids[at][other])
        yield from best.batches()

    return rows.mapInArrow(search, SCORES)


def _negatives(rows: DataFrame, trees, wanted, width: int, k: int) -> DataFrame:
    """The best ``k`` rows of other labels in the window of each of an anchor's positives, as each task knows them."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for label, ids, vectors in _chunks(batches, width):
            lengths = _lengths(vectors)
            for tree in trees.value:
                if tree.label == label:
                    continue

                def windows(i):
                    """What still counts for each positive: within k of the best so far, or in the whole window."""
                    for slot, low, high in wanted.value.get(int(tree.numbers[i]), ()):
                        least = best.least((int(tree.numbers[i]), slot))
                        yield slot, low if least is None else max(low, least), high

                def window(i):
                    found = list(windows(i))
                    return (min(w[1] for w in found), max(w[2] for w in found)) if found else None

                for i, at, scores in bounded_scores(tree, vectors, lengths, window):
                    for slot, low, high in windows(i):
                        inside = (scores >= low) & (scores <= high)
                        if inside.any():
                            best.offer((int(tree.numbers[i]), slot), scores[inside], ids[at][inside])
        yield from best.batches()

    return rows.mapInArrow(search, SCORES)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of what all tasks know of each anchor and slot."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, *, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT, pass_bytes: int = PASS_BYTES,
                   tree_anchors: int = TREE_ANCHORS, **columns) -> DataFrame:
    """For each anchor and each of its positives, the first rows of other labels in the positive's window.

    ``rows`` are those of :func:`usable_rows`, which takes ``columns``; rows it leaves out take no part.
    Anchors are rows whose id is divisible by ``anchor_every``. They are taken in blocks of at most
    ``pass_bytes`` of vectors, by label; a block's anchors become spanning trees of one label each, and
    two passes over all rows walk the trees: one for the positives, one for the rows in their windows.
    A task keeps the best few for each anchor only, so what it sends does not grow with its rows, and
    each block's result is written before the next is read.

    Rows that repeat an id all take part as they stand, but no row is paired with its own id; anchors
    equal in id, label and vector are one. A vector shorter than another counts as filled with
    zeros, scores beyond the range of a long saturate; ties go to the smaller id. A positive without
    a row in its window, as any with a negative score, has no result. Without rows or anchors the result
    is empty; other columns are not read.
    """
    spark = rows.sparkSession
    usable = materialise(usable_rows(rows, **columns))
    anchors = usable.where(F.col("vec_id") % anchor_every == 0).distinct().withColumn("all", F.lit(0))
    anchors = materialise(number_rows(anchors, ["all"], [F.col("label"), F.col("vec_id"), F.xxhash64("vector")], out="anchor"))
    n, width = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    width = max(width, usable.agg(F.max(F.size("vector"))).first()[0])
    at_once = max(1, pass_bytes // (8 * max(1, width)))
    done = []
    for a in range(0, n, at_once):
        block = anchors.where(F.col("anchor").between(a + 1, a + at_once))
        done.append(_mined(spark, usable, block, width, positives, negatives, least_percent, most_percent, tree_anchors))
    return spark.read.schema(RESULT).parquet(*done)


def _mined(spark: SparkSession, usable: DataFrame, block: DataFrame, width: int, positives: int, negatives: int,
           least_percent: int, most_percent: int, tree_anchors: int) -> str:
    """The table with the results of one block of anchors, whose number ``pass_bytes`` bounds."""
    trees = []
    members = block.select("anchor", "vec_id", "label", "vector").orderBy("anchor").collect()
    for label in sorted({m["label"] for m in members}):
        mine = [m for m in members if m["label"] == label]
        for a in range(0, len(mine), tree_anchors):
            part = mine[a : a + tree_anchors]
            trees.append(Tree(label, matrix([m["vector"] for m in part], width), np.array([m["anchor"] for m in part]), np.array([m["vec_id"] for m in part])))
    shared = spark.sparkContext.broadcast(trees)
    found = materialise(_first(_positives(usable, shared, width, positives), positives).select(
        "anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    for r in found.collect():  # a few rows for each anchor of the block
        low, high = -((-least_percent * r["positive_score"]) // 100), (most_percent * r["positive_score"]) // 100
        if low <= high:
            wanted.setdefault(r["anchor"], []).append((r["slot"], low, high))
    windows = spark.sparkContext.broadcast(wanted)
    chosen = _first(_negatives(usable, shared, windows, width, negatives), negatives)
    names = block.select("anchor", F.col("vec_id").alias("anchor_id"))
    path = shared_table_path(spark, "negatives")
    chosen.join(found, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    ).write.parquet(path)
    shared.unpersist()
    windows.unpersist()
    return path
