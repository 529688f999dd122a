"""Near copies of whole texts: SimHash BK-trees over candidate shards, links verified by word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import spread
from tideline.llm.components import connected
from tideline.llm.simhash import BKTree, fingerprint, hashes_of, shingles
from tideline.session import materialise

WIDTH = 5
SIMILARITY = 0.8
#: Hamming radius of the trees. Bits of different places are independent, and one differs between texts that
#: share four fifths of their distinct shingles with a chance of at most 0.19 (five shingles; 0.152 from
#: fifty on), so more than 32 of 64 differ with a chance below 4e-9, whatever the length.
RADIUS = 32
#: Shards of candidates: bands of so many min-hashes each; a pair at the similarity misses all of them
#: with probability (1 - 0.8^ROWS)^BANDS, which is 2e-4.
BANDS, ROWS = 16, 4
#: Most members of a tree, and about how many shingles they have together.
TREE_NODES = 2048
TREE_SHINGLES = 1 << 21
#: Tasks that the rows of one class are dealt to where they are marked.
SALTS = 16
_FACTORS = np.random.default_rng(77).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band: the hash of its min-hashes."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1 << 14):
        least = np.minimum(least, (hashes[a : a + (1 << 14), None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - 2**63 for b, r in enumerate(rows)]


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, node, fingerprint, size, bands): node is a digest of the lowered words, size the number of distinct shingles."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, sizes, bands = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                # distinct, as in the bands and the similarity: how often a line repeats moves no bit
                hashes = np.unique(hashes_of(shingles(text, width)).astype(np.uint64))
                nodes.append(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())))
                prints.append(fingerprint(hashes.astype(">u8")))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "text_key", "node", "fingerprint", "size", "bands"])

    return rows.mapInArrow(sketch, "doc_id long, text_key long, node binary, fingerprint long, size long, bands array<long>")


class _Members:
    """Members of one tree or of two: fingerprints and sorted distinct shingle hashes."""

    def __init__(self, rows: list[tuple], width: int):
        self.nodes = [r[0] for r in rows]
        self.prints = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        press = zstandard.ZstdDecompressor()
        self.sets = [np.unique(hashes_of(shingles(press.decompress(r[2]).decode(), width)).astype(np.uint64)) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets])

    def similar(self, a: int, others: np.ndarray, at_least: float) -> np.ndarray:
        """Those of ``others`` whose shingle sets have at least this Jaccard similarity with set a."""
        mine = self.sets[a]
        # sets whose sizes differ too much cannot be similar
        sizes = self.sizes[others]
        others = others[np.minimum(sizes, len(mine)) >= at_least * np.maximum(sizes, len(mine))]
        if not len(others) or not len(mine):
            return others[:0]
        flat = np.concatenate([self.sets[i] for i in others])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(self.sizes[others])[:-1])))
        return others[shared >= at_least * (len(mine) + self.sizes[others] - shared) - 1e-9]


def verified_links(rows: list[tuple], asks: np.ndarray | None, width: int, radius: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Verified links that join the same groups as all verified links would; at most one per member."""
    members = _Members(rows, width)
    inside = np.arange(len(rows)) if asks is None else np.flatnonzero(~asks)
    asked = inside if asks is None else np.flatnonzero(asks)
    group, links = np.arange(len(rows)), []
    for node, near in BKTree(members.prints[inside]).within(members.prints[asked], radius):
        node, near = int(inside[node]), asked[near]
        near = near[group[near] != group[node]]
        for other in members.similar(node, near, similarity).tolist() if len(near) else ():
            if group[other] != group[node]:
                links.append((members.nodes[node], members.nodes[other]))
                group[group == group[other]] = group[node]
    return links


def _shards(nodes: DataFrame, tree_nodes: int, tree_shingles: int) -> DataFrame:
    """(shard, trees, node): nodes that share a band of min-hashes; bands with the same members are one shard.

    Two near copies share some seven bands, which are told apart by their number of members and a sum
    over them, so that their texts travel once and not seven times.
    """
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    whole = F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("size"), whole[0].alias("s0"), whole[1].alias("s1")).where("n > 1")
    kept = groups.groupBy("n", "size", "s0", "s1").agg(F.min("band").alias("band"))
    trees = F.expr(f"cast(greatest((n - 1) div {tree_nodes}, (size - 1) div {tree_shingles}) + 1 as int)")
    return banded.select("node", "band").join(kept.select("band", trees.alias("trees")), "band").select(F.col("band").alias("shard"), "trees", "node")


def _searched(dealt: DataFrame, texts: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """Verified links (a, b) inside each (shard, tree); where some rows ask, only those between them and the others."""
    keys = ["shard", "tree"]
    names = (*keys, "asks", "node", "fingerprint", "packed")
    rows = dealt.join(texts, "node").select(*names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            asks = np.array([r[3] for r in held])
            found = verified_links(held, asks if asks.any() else None, width, radius, similarity)
            ends = list(zip(*found)) if found else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.binary()) for e in ends], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:2] != key:
                    if len(held) > 1:
                        yield links()
                    key, held = row[:2], []
                held.append((row[3], row[4], row[5], row[2]))
        if len(held) > 1:
            yield links()

    ordered = rows.repartition(spread(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(search, "a binary, b binary")


def copy_classes(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, similarity: float = SIMILARITY,
                 radius: int = RADIUS, tree_nodes: int = TREE_NODES, tree_shingles: int = TREE_SHINGLES) -> DataFrame:
    """(doc_id, text_key, node, class_node) of every row: connected by copies and verified near copies.

    Texts whose lowered words are equal are one node. Nodes that share a band of min-hashes form a
    shard; its BK-tree finds for each member those within the radius, and the shares of common
    shingles decide. A large shard is dealt to several trees. Each is searched on its own first; what that
    and the other shards connect is then one class. Of the pairs between two trees of a shard only those
    between different classes can still matter, so in a second pass the members outside the shard's
    largest class ask the trees that they are not in: a group of near copies of any size costs its texts a
    fixed number of times. Texts without words are copies of each other.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    made = materialise(sketches(rows, width))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_key")).alias("first")
    nodes = materialise(made.groupBy("node").agg(first, F.first("fingerprint").alias("fingerprint"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    shards = _shards(nodes, tree_nodes, tree_shingles).withColumn("own", F.pmod(F.xxhash64("node", "shard"), F.col("trees")).cast("int"))
    shards = materialise(shards)
    texts = materialise(_texts(rows, nodes.join(shards.select("node").distinct(), "node", "left_semi")))
    first_links = materialise(_searched(shards.select("shard", F.col("own").alias("tree"), F.lit(False).alias("asks"), "node"), texts, width, radius, similarity))
    classes = connected(first_links)

    split = shards.where("trees > 1").join(classes.withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    largest = split.groupBy("shard", "class").agg(F.count("*").alias("n")).groupBy("shard").agg(F.max_by("class", F.struct("n", "class")).alias("largest"))
    open_ = materialise(split.join(largest, "shard").withColumn("outside", F.col("class") != F.col("largest")))
    others = open_.where("outside").select("shard", "own", "node", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree")).where("tree <> own")
    asked = others.select("shard", "tree").distinct()
    dealt = others.select("shard", "tree", F.lit(True).alias("asks"), "node").unionByName(
        open_.select("shard", F.col("own").alias("tree"), F.lit(False).alias("asks"), "node").join(asked, ["shard", "tree"], "left_semi"))
    links = first_links.unionAll(_searched(dealt, texts, width, radius, similarity)) if not open_.where("outside").isEmpty() else None
    classes = classes if links is None else connected(links)
    return made.join(classes.select("node", F.col("root").alias("class_node")), "node", "left").select(
        "doc_id", "text_key", "node", F.coalesce("class_node", "node").alias("class_node"))


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fingerprint, packed): one compressed text for each of the nodes; a row that repeats id and text counts once."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress(x.as_py().encode()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id_key"), batch.column("text_key"), pa.array(packed, pa.binary())], ["id_key", "text_key", "packed"])

    id_key = F.coalesce("doc_id", F.lit(-(2**63))).alias("id_key")
    packed = rows.select(id_key, "text_key", "text").mapInArrow(pack, "id_key long, text_key long, packed binary")
    wanted = nodes.select("node", "fingerprint", F.coalesce("first.doc_id", F.lit(-(2**63))).alias("id_key"), F.col("first.text_key").alias("text_key"))
    return wanted.join(packed, ["id_key", "text_key"]).groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("packed").alias("packed"))


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The documents less their copies and near copies: of each class the smallest id stays.

    All columns are kept as they are. Of rows that repeat id and text one stays; an id compares as
    smaller when it is not NULL, so a NULL id stays only in a class without ids; ties of an id go to the
    smaller text hash.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    rows = materialise(copy_classes(docs, id_column=id_column, text_column=text_column, **settings))
    best = rows.groupBy("class_node").agg(F.min(key).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a class of a third of all documents is met in several tasks
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    marked = salted.join(best, ["class_node", "salt"]).withColumn("stays", F.col("best").eqNullSafe(key))
    leaving = marked.where(~F.col("stays")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    twice = materialise(marked.where("stays").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().where("count > 1").drop("count"))
    text_key = F.xxhash64(F.coalesce(docs[text_column].cast("string"), F.lit("")))

    def same(rows: DataFrame):
        return docs[id_column].eqNullSafe(rows["_id"]) & (text_key == rows["_key"])

    kept = docs.join(leaving, same(leaving), "left_anti")
    return kept.join(twice, same(twice), "left_anti").unionByName(kept.join(twice, same(twice), "left_semi").dropDuplicates([id_column, text_column]))
