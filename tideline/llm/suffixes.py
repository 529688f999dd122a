"""Repeated byte strings removed by sparse prefix doubling over position ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.repeats import covered, known_id, marks_of, numbered, segment_rows, settled, unpacked, whole_texts, with_texts
from tideline.llm.windows import byte_letters
from tideline.session import materialise

#: Bytes of a repeated string, and of the first rank that positions are sorted by.
LENGTH = 100
FIRST_RANK = 32
#: Windows per run in the later rounds: the shared letters grow from FIRST_RANK over LENGTH - 7 to LENGTH.
STEPS = (8, 1)
PIECES = "doc_id long, place long, piece binary"
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>"


def open_pieces(rows: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Stretches of text (doc_id, place, piece) whose windows no round has decided yet."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, variant = (batch.column(c).to_numpy() for c in ("doc_id", "variant"))
            out = []
            for i in range(batch.num_rows):
                at, n, _ = marks_of(batch.column("marks"), i)
                text = unpacked(batch.column("packed")[i])
                out += [(int(doc[i]), (int(variant[i]) << 40) + a, text[a : b + length - 1]) for a, b in _stretches(at, n)]
            yield _piece_batch(out)

    return with_texts(rows, marks, "inner").mapInArrow(take, PIECES)


def _stretches(at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Runs of windows [a, b) that adjacent segments make together."""
    starts = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + n[:-1]))) if len(at) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(at)) - 1
    return [(int(at[s]), int(at[e] + n[e])) for s, e in zip(starts, ends)]


def _piece_batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "place", "piece"])


def narrowed(pieces: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The parts of the pieces that the marks (doc_id, place, n) still name, cut out where they lie."""
    lists = marks.select("doc_id", F.expr("shiftright(place, 40)").alias("variant"), F.struct("place", "n").alias("mark")).groupBy("doc_id", "variant").agg(F.collect_list("mark").alias("marks"))
    inside = pieces.withColumn("variant", F.expr("shiftright(place, 40)")).join(lists, ["doc_id", "variant"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                place, piece = batch.column("place")[i].as_py(), batch.column("piece")[i].as_py()
                values = batch.column("marks")[i].values
                at, n = values.field("place").to_numpy() - place, values.field("n").to_numpy()
                mine = (at >= 0) & (at + n + length - 1 <= len(piece))
                at, n = at[mine], n[mine]
                order = np.argsort(at)
                out += [(batch.column("doc_id")[i].as_py(), place + a, piece[a : b + length - 1]) for a, b in _stretches(at[order], n[order])]
            yield _piece_batch(out)

    return inside.mapInArrow(take, PIECES)


def repeated_windows(rows: DataFrame, *, length: int = LENGTH, first_rank: int = FIRST_RANK, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(doc_id, place, n): runs of windows whose strings also start earlier.

    Positions are sorted by rank pairs in rounds, the ranks naming ever longer strings: names of 2k
    bytes are made from pairs of names of k bytes at offset k. Round one sorts anchors, positions
    chosen by content so that each window has one, by the name of their first ``first_rank`` bytes
    and of their surroundings; later rounds sort what is left by the names of length - step + 1
    bytes, up to the whole window. A rank that is unique drops out, equal surroundings are settled
    at once, and the rest goes on; with step 1 every rank is past the threshold.
    """
    state = materialise(settled(segment_rows(whole_texts(rows), byte_letters, length, first_rank)))
    found = state.where("core is null").select("doc_id", "place", "n")
    pieces = materialise(open_pieces(rows, state.where("core is not null"), length))
    for i, step in enumerate(steps):
        state = materialise(settled(segment_rows(pieces, byte_letters, length, first_rank, step)))
        found = found.unionAll(state.where("core is null").select("doc_id", "place", "n"))
        if i + 1 < len(steps):
            pieces = narrowed(pieces, state.where("core is not null"), length)
    return found


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, first_rank: int = FIRST_RANK,
                    texts: bool = False) -> DataFrame:
    """Per document what is left when every byte in a string of ``length`` bytes that starts earlier goes.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops of the removed runs, and with
    ``texts`` the bytes kept). Earlier is a smaller id or the same document further left; strings are
    judged on the input. NULL texts are empty, a NULL id is smaller than any other; several texts of
    one id count as documents in the order of a hash of theirs, and rows that repeat id and text are
    one document, all given the same result; other columns are not read.
    """
    rows = numbered(docs, id_column, text_column)
    found = repeated_windows(rows, length=length, first_rank=first_rank).withColumn("core", F.lit(None).cast("long"))
    schema = SPANS + (", kept binary" if texts else "")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = unpacked(batch.column("packed")[i])
                at, n, _ = marks_of(batch.column("marks"), i)
                gone = covered(len(text), at, n, length) if len(at) else np.zeros(len(text), bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edges) else text
                out.append((len(text), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2].tolist(), edges[1::2].tolist(), kept)[: 7 if texts else 6])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            if columns:
                yield pa.RecordBatch.from_arrays([known_id(batch.column("doc_id")), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "kept"][: 1 + len(columns)])

    return with_texts(rows, found, "left").mapInArrow(assemble, schema)
