"""Recurring passages removed: confirmed by counting, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import spread
from tideline.llm.repeats import covered, known_id, marks_of, numbered, segment_rows, settled, unpacked, whole_texts, with_texts
from tideline.llm.windows import RunHashes
from tideline.session import materialise

#: Words of a passage, and of the phrase inside it that segments are anchored at.
LENGTH = 20
PHRASE = 8
#: Passages of one automaton, and stretches of text that one task streams past it, about.
SHARD_PASSAGES = 5_000
SHARD_STRETCHES = 50_000
STRETCHES = "core long, doc_id long, place long, n long, piece string"
WINDOWS = "a long, b long, core long, doc_id long, place long, stretch long"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Hashes(dict):
    """Word to 64-bit letter; forgets when the vocabulary seen grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 3)
        return found


_HASHES = _Hashes()


def word_letters(text: bytes) -> np.ndarray:
    """A letter for each word; bytes.split cuts at the same six separators as the contract's words."""
    words = text.split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def open_stretches(rows: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """Words of every segment that needs a closer look, one space between them."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, variant = (batch.column(c).to_numpy() for c in ("doc_id", "variant"))
            out = []
            for i in range(batch.num_rows):
                words = unpacked(batch.column("packed")[i]).split()
                for a, n, core in zip(*(x.tolist() for x in marks_of(batch.column("marks"), i))):
                    out.append((core, int(doc[i]), (int(variant[i]) << 40) + a, n, b" ".join(words[a : a + n + length - 1]).decode()))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["core", "doc_id", "place", "n", "piece"])

    return with_texts(rows, marks, "inner").mapInArrow(take, STRETCHES)


def confirmed_passages(stretches: DataFrame, length: int) -> DataFrame:
    """Stretches with a passage's first place: (core, doc_id, place, piece, offsets of the passages).

    Every window of every stretch is counted under a name of two 64-bit hashes; those found twice are
    passages, kept where they start first.
    """
    size = 1 << (length.bit_length() - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for core, doc, place, n, piece in zip(*(batch.column(c).to_pylist() for c in ("core", "doc_id", "place", "n", "piece"))):
                runs = RunHashes(word_letters(piece.encode()), size).levels[-1].view(np.int64)
                at = np.arange(n)
                parts.append((runs[at], runs[at + length - size], np.full(n, core), np.full(n, doc), at + place, np.full(n, place)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["a", "b", "core", "doc_id", "place", "stretch"])

    first = F.min(F.struct("doc_id", "place", "stretch", "core"))
    passages = stretches.mapInArrow(cut, WINDOWS).groupBy("a", "b").agg(first.alias("first"), F.count("*").alias("times")).where("times > 1")
    lists = passages.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.stretch").alias("place")).agg(F.collect_list(F.col("first.place") - F.col("first.stretch")).alias("offsets"))
    return stretches.join(lists, ["doc_id", "place"]).select("core", "doc_id", "place", "piece", "offsets")


def located(stretches: DataFrame, passages: DataFrame, length: int, shard_passages: int = SHARD_PASSAGES, shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """(doc_id, place, n): windows in which an automaton finds a passage after its first place.

    Passages and the stretches that can hold them share their anchor phrase, so both go to the shard
    of its hash. A shard with many passages is dealt to several automata, each of which meets all the
    shard's stretches; one with many stretches is dealt to several tasks, each with the automaton. In
    a task the passages come first and are compiled, then the stretches stream by.
    """
    total = passages.agg(F.sum(F.size("offsets"))).first()[0] or 0
    shard = F.pmod("core", F.lit(max(1, total // shard_passages))).cast("int")
    passages, stretches = passages.withColumn("shard", shard), stretches.withColumn("shard", shard)
    chunks = passages.groupBy("shard").agg(F.sum(F.size("offsets")).alias("n")).select("shard", F.expr(f"cast(n div {2 * shard_passages} + 1 as int)").alias("chunks"))
    salts = stretches.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.expr(f"cast(n div {shard_stretches} + 1 as int)").alias("salts"))
    plan = materialise(chunks.join(salts, "shard"))
    own = F.xxhash64("doc_id", "place")
    nothing = F.array().cast("array<long>")
    first = passages.join(plan, "shard").select(
        "shard", F.pmod(own, F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "doc_id", "place", "piece", "offsets")
    then = stretches.join(plan, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(own, F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "place", "piece", nothing.alias("offsets"))
    keys = ["shard", "chunk", "salt"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, automaton, ready = None, {}, None, False
        for batch in batches:
            out = []
            for mine, kind, doc, place, piece, offsets in zip(zip(*(batch.column(c).to_pylist() for c in keys)), *(batch.column(c).to_pylist() for c in ("kind", "doc_id", "place", "piece", "offsets"))):
                if mine != key:
                    key, ids, ready = mine, {}, False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                words = piece.split(" ")
                if kind == 0:
                    letters = [ids.setdefault(w, len(ids) + 1) for w in words]
                    for a in offsets:
                        automaton.add_word(tuple(letters[a : a + length]), (doc, place + a))
                    continue
                if not len(automaton):
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                run = None
                for end, start in automaton.iter(tuple([ids.get(w, 0) for w in words])):
                    a = place + end - length + 1
                    if (doc, a) <= start:
                        continue
                    if run and run[1] + run[2] == a:
                        run[2] += 1
                        continue
                    run = [doc, a, 1]
                    out.append(run)
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "place", "n"])

    rows = first.unionAll(then).repartition(spread(stretches.sparkSession), *keys).sortWithinPartitions(*keys, "kind")
    return rows.mapInArrow(stream, "doc_id long, place long, n long")


def repeated_passages(rows: DataFrame, *, length: int = LENGTH, phrase: int = PHRASE, **shards: int) -> DataFrame:
    """(doc_id, place, n): runs of windows whose word sequences also start earlier.

    Segments anchored at the same phrase are sorted; those equal as a whole are settled there, those
    whose phrase never recurs hold no passage, and the others are searched by automata.
    """
    state = materialise(settled(segment_rows(whole_texts(rows), word_letters, length, phrase)))
    stretches = materialise(open_stretches(rows, state.where("core is not null"), length))
    passages = materialise(confirmed_passages(stretches, length))
    return state.where("core is null").select("doc_id", "place", "n").unionAll(located(stretches, passages, length, **shards))


def without_passages(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, phrase: int = PHRASE, texts: bool = False, **shards: int) -> DataFrame:
    """Per document what is left when every word in a passage of ``length`` words that starts earlier goes.

    (doc_id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words joined by a space).
    Earlier is a smaller id or the same document further left; passages are judged on the input. NULL
    and empty texts have no words, a NULL id is smaller than any other; several texts of one id count
    as documents in the order of a hash of theirs, and rows that repeat id and text are one document,
    all given the same result; other columns are not read.
    """
    rows = numbered(docs, id_column, text_column)
    found = repeated_passages(rows, length=length, phrase=phrase, **shards).withColumn("core", F.lit(None).cast("long"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words = unpacked(batch.column("packed")[i]).split()
                at, n, _ = marks_of(batch.column("marks"), i)
                kept = words
                if len(at):
                    kept = [w for w, gone in zip(words, covered(len(words), at, n, length).tolist()) if not gone]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode())[: 4 if texts else 3])
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            if columns:
                yield pa.RecordBatch.from_arrays([known_id(batch.column("doc_id")), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 1 + len(columns)])

    return with_texts(rows, found, "left").mapInArrow(assemble, KEPT + (", kept string" if texts else ""))
