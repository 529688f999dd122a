"""Windows that start earlier elsewhere: segments sorted by Spark, settled or left for a closer look."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import spread
from tideline.llm.windows import segments
from tideline.session import materialise

#: Bits of a place that hold the position; above them is the number of a text among those of one id.
PLACE_BITS = 40
#: Letters whose segments a task settles among themselves before anything is shuffled.
BATCH_LETTERS = 1 << 23
#: Segments that it holds at most; those of single windows are as many as the letters.
BATCH_SEGMENTS = 1 << 19
#: Letters that are hashed at once.
GROUP_LETTERS = 1 << 16
_NO_ID = -(2**63)
SEGMENTS = "core long, body long, doc_id long, place long, n long"
SETTLED = "core long, doc_id long, place long, n long"

Letters = Callable[[bytes], np.ndarray]


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, variant, text): different texts of one id are numbered, a NULL id is the smallest id.

    Only ids with several texts are looked at twice; they are normally none.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    several = (
        rows.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("doc_id")
    )
    keys = materialise(rows.select("doc_id", "text_key").join(several, "doc_id", "left_semi").distinct()
                       .withColumn("variant", F.row_number().over(Window.partitionBy("doc_id").orderBy("text_key"))))
    return rows.join(keys, ["doc_id", "text_key"], "left").select("doc_id", F.coalesce("variant", F.lit(0)).cast("long").alias("variant"), "text")


def _sorted_firsts(core, body, doc, place):
    """Order by (core, body, doc, place), and for each sorted row whether it opens its (core, body)."""
    order = np.lexsort((place, doc, body, core))
    c, b = core[order], body[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
    return order, opens


def _locally_settled(core, body, doc, place, n):
    """Rows that still have to meet other tasks', and rows settled as repeats, stretches made one.

    Of equal segments in one batch only the first can be a first anywhere. Settled rows carry n < 0.
    """
    order, opens = _sorted_firsts(core, body, doc, place)
    lead = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[lead]) | (place[order] != place[lead])
    kept = np.zeros(len(order), bool)
    kept[order[opens]] = True
    d, p, m = doc[later], place[later], n[later]
    order = np.lexsort((p, d))
    d, p, m = d[order], p[order], m[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + m[:-1])
    start = np.flatnonzero(fresh)
    total = np.add.reduceat(m, start) if len(start) else m
    return (core[kept], body[kept], doc[kept], place[kept], n[kept]), (d[start], p[start], total)


def _emit(core, body, doc, place, n) -> Iterator[pa.RecordBatch]:
    if not len(core):
        return
    first, later = _locally_settled(core, body, doc, place, n)
    spread_by = (later[0] * np.int64(-7046029254386353131)) ^ later[1]
    columns = [
        np.concatenate([first[0].view(np.int64), spread_by]), np.concatenate([first[1].view(np.int64), np.zeros(len(later[0]), np.int64)]),
        np.concatenate([first[2], later[0]]), np.concatenate([first[3], later[1]]), np.concatenate([first[4], -later[2]]),
    ]
    for a in range(0, len(columns[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 17)]) for c in columns], ["core", "body", "doc_id", "place", "n"])


class _Group:
    """Pieces that are hashed and cut together, which spares most of the work of short ones."""

    def __init__(self) -> None:
        self.doc, self.place, self.letters, self.size = [], [], [], 0

    def add(self, doc: int, place: int, letters: np.ndarray) -> None:
        self.doc.append(doc)
        self.place.append(place)
        self.letters.append(letters)
        self.size += len(letters)

    def segments(self, length: int, gram: int, step: int | None) -> list:
        """One tuple (core, body, doc_id, place, n) of arrays, or none."""
        if not self.letters:
            return []
        sizes = np.array([len(x) for x in self.letters], np.int64)
        first, count, core, body = segments(np.concatenate(self.letters), length, gram, step, sizes)
        if not len(first):
            return []
        start = np.cumsum(sizes) - sizes
        # a sequence without letters starts where the next one does, which is the one to find
        mine = np.searchsorted(start, first, "right") - 1
        return [(core, body, np.array(self.doc, np.int64)[mine], first - start[mine] + np.array(self.place, np.int64)[mine], count)]


def segment_rows(pieces: DataFrame, letters: Letters, length: int, gram: int, step: int | None = None) -> DataFrame:
    """Segments of every piece (doc_id, place, piece binary), with repeats inside a batch settled.

    A row with n > 0 is a segment of n windows from ``place`` on; one with n < 0 is -n windows known to
    start earlier elsewhere. A batch of text settles its own repeats first, so a passage of a third of
    all documents leaves one row for each batch, not for each document.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, _Group()
        for batch in batches:
            for doc, place, piece in zip(batch.column("doc_id").to_numpy(), batch.column("place").to_numpy(), batch.column("piece")):
                group.add(doc, place, letters(piece.as_py()))
                if group.size < GROUP_LETTERS:
                    continue
                size += group.size
                held += group.segments(length, gram, step)
                group = _Group()
                if size >= BATCH_LETTERS or sum(len(x[0]) for x in held) >= BATCH_SEGMENTS:
                    yield from _emit(*map(np.concatenate, zip(*held))) if held else ()
                    held, size = [], 0
        held += group.segments(length, gram, step)
        if held:
            yield from _emit(*map(np.concatenate, zip(*held)))

    return pieces.mapInArrow(cut, SEGMENTS)


def whole_texts(rows: DataFrame) -> DataFrame:
    """Numbered rows as pieces of one text each."""
    return rows.select("doc_id", F.expr(f"shiftleft(variant, {PLACE_BITS})").alias("place"), F.col("text").cast("binary").alias("piece"))


def settled(cut: DataFrame) -> DataFrame:
    """(core, doc_id, place, n): repeats, whose core is NULL, and segments that need a closer look.

    Spark sorts the segments by (core, body, document, place). In that order a segment after an equal
    one is a repeat; one whose core no other body shares has no window in common with any other
    segment and is done; what remains shares its core with other bodies. One pass over the sorted
    rows decides this with a row or two at hand, whatever a group's size.
    """
    keys = ["core", "body", "doc_id", "place"]
    ordered = cut.repartition(spread(cut.sparkSession), "core").sortWithinPartitions(*keys)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # core, body, and the first place of the open (core, body)
        waiting = None  # the last body's first row, and whether its core has been seen with another body
        for batch in batches:
            core, body, doc, place, n = (batch.column(c).to_numpy() for c in (*keys, "n"))
            known = n < 0
            if known.any():
                yield _settled_batch(None, doc[known], place[known], -n[known])
                core, body, doc, place, n = (x[~known] for x in (core, body, doc, place, n))
            if not len(core):
                continue
            opens = np.ones(len(core), bool)
            opens[1:] = (core[1:] != core[:-1]) | (body[1:] != body[:-1])
            if before is not None:
                opens[0] = (core[0], body[0]) != before[:2]
            lead = np.maximum.accumulate(np.where(opens, np.arange(len(core)), -1))
            first_doc, first_place = np.where(lead >= 0, doc[lead], 0), np.where(lead >= 0, place[lead], 0)
            if before is not None:
                first_doc[lead < 0], first_place[lead < 0] = before[2:]
            later = ~opens & ((doc != first_doc) | (place != first_place))
            if later.any():
                yield _settled_batch(None, doc[later], place[later], n[later])
            before = (core[-1], body[-1], first_doc[-1], first_place[-1])
            at = np.flatnonzero(opens)
            if not len(at):
                continue
            heads = [core[at], doc[at], place[at], n[at]]
            shared = np.zeros(len(at), bool)
            if waiting is not None:
                heads = [np.concatenate(([w], h)) for w, h in zip(waiting[0], heads)]
                shared = np.concatenate(([waiting[1]], shared))
            same = heads[0][1:] == heads[0][:-1]
            shared[1:] |= same
            shared[:-1] |= same
            waiting = (tuple(h[-1] for h in heads), bool(shared[-1]))
            out = np.flatnonzero(shared[:-1])
            if len(out):
                yield _settled_batch(heads[0][out], heads[1][out], heads[2][out], heads[3][out])
        if waiting is not None and waiting[1]:
            yield _settled_batch(*(np.array([x], np.int64) for x in waiting[0]))

    return ordered.mapInArrow(decide, SETTLED)


def _settled_batch(core, doc, place, n) -> pa.RecordBatch:
    cores = pa.nulls(len(doc), pa.int64()) if core is None else pa.array(core)
    return pa.RecordBatch.from_arrays([cores, pa.array(doc), pa.array(place), pa.array(n)], ["core", "doc_id", "place", "n"])


def with_texts(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Numbered rows with the marks (place, n, core) of each as a list, their texts packed on the way.

    ``how`` is left to keep texts without marks, inner to drop them. The texts cross one shuffle,
    compressed; a text's list of marks is never longer than the text.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress(x.as_py().encode()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("variant"), pa.array(packed, pa.binary())], ["doc_id", "variant", "packed"])

    lists = (
        marks.select("doc_id", F.expr(f"shiftright(place, {PLACE_BITS})").alias("variant"), F.expr(f"place & {(1 << PLACE_BITS) - 1}").alias("at"), "n", "core")
        .groupBy("doc_id", "variant").agg(F.collect_list(F.struct("at", "n", "core")).alias("marks"))
    )
    return rows.mapInArrow(pack, "doc_id long, variant long, packed binary").join(lists, ["doc_id", "variant"], how)


def marks_of(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of row ``i`` as arrays (at, n, core) in order of at; core is 0 where it is NULL."""
    scalar = column[i]
    if not scalar.is_valid:
        return (np.zeros(0, np.int64),) * 3
    values = scalar.values
    at, n = values.field("at").to_numpy(), values.field("n").to_numpy()
    core = values.field("core").fill_null(0).to_numpy()
    order = np.argsort(at, kind="stable")
    return at[order], n[order], core[order]


def covered(size: int, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which letters lie in some of the windows [at, at + n) of ``length`` letters."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def unpacked(packed) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py())


def known_id(column: pa.Array) -> pa.Array:
    """Ids with the stand-in for NULL taken out again."""
    return pa.array([None if x == _NO_ID else x for x in column.to_pylist()], pa.int64())
