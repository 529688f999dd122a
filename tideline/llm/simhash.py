"""SimHash fingerprints, and their links within a Hamming radius by BK-trees of shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import spread
from tideline.llm.components import connected
from tideline.session import materialise

RADIUS = 4
#: Blocks that fingerprints are cut into; within the radius at least blocks - radius of them are equal.
BLOCKS = 6
#: Largest tree; a shard with more fingerprints is dealt to several trees, each searched by all others.
TREE_NODES = 4096


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word runs of a text, A-Z lowered, repeats included; a shorter text is one run, none has none."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def hashes_of(runs: list[bytes], seed: int = 42) -> np.ndarray:
    one = xxhash.xxh64_digest
    return np.frombuffer(b"".join([one(run, seed) for run in runs]), ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as a signed 64-bit number; 0 without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fingerprint long) of every row; NULL and empty texts have fingerprint 0."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(hashes_of(shingles(text.as_py(), width))) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fingerprint long")


class BKTree:
    """A BK-tree: each child hangs on the integer Hamming distance to its parent.

    Values are held in an array; ``children[node]`` maps a distance to a node.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        waiting = [(0, np.arange(1, len(values)))] if len(values) else []
        while waiting:
            node, rest = waiting.pop()
            if not len(rest):
                continue
            distance = np.bitwise_count(values[rest] ^ values[node])
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            for part in np.split(rest[order], cuts):
                child = int(part[0])
                self.children[node][int(np.bitwise_count(values[child] ^ values[node]))] = child
                waiting.append((child, part[1:]))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, queries at most ``radius`` from it); a query follows only edges that can still hold a hit."""
        waiting = [(0, np.arange(len(queries)))] if len(self.values) else []
        while waiting:
            node, asked = waiting.pop()
            distance = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int64)
            near = asked[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asked[np.abs(distance - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


def tree_links(values: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same components as all links between values and queries within the radius.

    Every link is looked at; one is kept where it joins two groups that were apart, so a dense group of
    n fingerprints gives n - 1 links.
    """
    if len(values) == 2 and queries is values:
        return [(int(values[0]), int(values[1]))] if int(np.bitwise_count(values[0] ^ values[1])) <= radius else []
    everything = values if queries is values else np.concatenate([values, queries])
    shift = 0 if queries is values else len(values)
    group = np.arange(len(everything))
    links = []
    for node, near in BKTree(values).within(queries, radius):
        labels, first = np.unique(group[near + shift], return_index=True)
        other = labels != group[node]
        if other.any():
            links += [(int(values[node]), int(queries[near[i]])) for i in first[other]]
            group[np.isin(group, labels[other])] = group[node]
    return links


def _shard_keys(column: str, radius: int, blocks: int) -> Column:
    """Array of shard keys: all choices of blocks - radius blocks, packed behind the choice's number."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        packed, width = F.lit(0).cast("long"), 0
        for b in chosen:
            size = bounds[b + 1] - bounds[b]
            packed = F.shiftleft(packed, size).bitwiseOR(F.shiftrightunsigned(column, bounds[b]).bitwiseAND(F.lit((1 << size) - 1)))
            width += size
        keys.append(F.lit(number << width).cast("long").bitwiseOR(packed) if width < 58 else F.xxhash64(F.lit(number), packed))
    return F.array(*keys)


def near_links(distinct: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect what lies within the radius.

    ``distinct`` has one column, fingerprint. A fingerprint goes to one shard for each choice of
    blocks - radius of its blocks; two within the radius agree in at least that many blocks and so
    meet in a shard, whose BK-tree finds them. A shard with more than ``tree_nodes`` members is dealt
    to several trees: a member is a node of one and a query of each, so no task holds a whole hot
    shard and no link is lost.
    """
    spark = distinct.sparkSession
    sharded = distinct.select("fingerprint", F.explode(_shard_keys("fingerprint", radius, blocks)).alias("shard"))
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("trees", F.expr(f"(n - 1) div {tree_nodes} + 1").cast("int"))
    members = sharded.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("trees")).cast("int"))
    # a member meets every other tree once: as node where its tree's number is the smaller one
    dealt = members.select("shard", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("other")).select(
        "shard", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("by"), (F.col("own") > F.col("other")).alias("asks"), "fingerprint")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links(rows: np.ndarray) -> list[tuple[int, int]]:
            values = rows["fingerprint"].view(np.uint64)
            if rows["tree"][0] == rows["by"][0]:
                return tree_links(values, values, radius)
            asks = rows["asks"]
            return tree_links(values[~asks], values[asks], radius)

        kind = np.dtype([("shard", "i8"), ("tree", "i4"), ("by", "i4"), ("asks", "?"), ("fingerprint", "i8")])
        for batch in batches:
            rows = np.empty(batch.num_rows, kind)
            for name in kind.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            if not len(rows):
                continue
            change = np.flatnonzero((rows["shard"][1:] != rows["shard"][:-1]) | (rows["tree"][1:] != rows["tree"][:-1]) | (rows["by"][1:] != rows["by"][:-1])) + 1
            out = []
            for part in np.split(rows, change):
                mine = (part["shard"][0], part["tree"][0], part["by"][0])
                if mine != key and held:
                    out += links(np.concatenate(held))
                    held = []
                key = mine
                held.append(part)
            if out:
                yield _links_batch(out)
        if held:
            yield _links_batch(links(np.concatenate(held)))

    keys = ["shard", "tree", "by"]
    ordered = dealt.repartition(spread(spark), *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(search, "a long, b long")


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def document_components(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 4, radius: int = RADIUS,
                        blocks: int = BLOCKS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: components of links within the radius.

    Rows with one fingerprint are one node, so copies never multiply; texts without words share
    fingerprint 0 and link like any other. component_id is the smallest id in the component, NULL ids
    taking part without being it; repeated rows are given each; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, id_column=id_column, text_column=text_column, width=width))
    nodes = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = connected(near_links(nodes.select("fingerprint"), radius=radius, blocks=blocks, tree_nodes=tree_nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialise(rooted.join(named, "root").select("fingerprint", "component_id"))
    return rows.join(known, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
