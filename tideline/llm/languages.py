"""Language of a text by unigram pieces, summed over all ways to cut its words."""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import materialise

#: A public vocabulary of pieces of bytes, one "base64 number" a line.
VOCABULARY = os.environ.get("TIDELINE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Bytes of the longest piece; longer entries of the vocabulary are not pieces.
LONGEST = 16
#: Rounds of expectation and maximisation, and what is added to the count of each piece of each language.
ROUNDS = 2
ADDED = 0.1
#: Bytes of words that are cut up together, words that a task remembers, words it counts before handing them on.
LATTICE_BYTES = 1 << 18
REMEMBERED = 1 << 19
COUNTED = 1 << 18
UNKNOWN = "und"
#: Expected counts are added up as whole multiples of this, so that their sum has no order.
UNIT = 2.0**-20
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PIECE = regex.compile(r" ?\p{L}[\p{L}\p{M}]*|[\p{L}\p{M}]+")
_B = np.uint64(0x100000001B3)
_C = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 19


def letter_words(text: str | None) -> list[bytes]:
    """The lower-case letter sequences of a whole text, each with the space that opens a piece."""
    return [b" " + w.encode() for w in _WORD.findall((text or "").lower())]


def vocabulary_pieces(path: str = VOCABULARY, longest: int = LONGEST) -> list[bytes]:
    """All single bytes, and the vocabulary's lower-case letter sequences of at most ``longest`` bytes."""
    found = {bytes([b]) for b in range(256)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            try:
                text = piece.decode()
            except UnicodeDecodeError:
                continue
            if len(piece) <= longest and text == text.lower() and _PIECE.fullmatch(text):
                found.add(piece)
    return sorted(found)


class Pieces:
    """Numbers 1, 2, ... of the pieces, and a hash table of all their prefixes to walk words with."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces))
        number = dict.fromkeys((p[:k] for p in pieces for k in range(1, len(p) + 1)), 0) | {p: i + 1 for i, p in enumerate(pieces)}
        slots = 1 << _SLOT_BITS
        self.keys, self.numbers = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        hashes = {}
        for p in sorted(number, key=len):
            h = (hashes.get(p[:-1], 0) * int(_B) + p[-1] + 1) % 2**64
            hashes[p] = h
            at = (h * int(_C) % 2**64) >> (64 - _SLOT_BITS)
            while self.keys[at]:
                at = (at + 1) % slots
            self.keys[at], self.numbers[at] = h, number[p]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece's number for each hash, 0 for a mere prefix of pieces, -1 for neither."""
        at = (hashes * _C) >> np.uint64(64 - _SLOT_BITS)
        out = np.where(self.keys[at] == hashes, self.numbers[at], np.int32(-1))
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != 0) & (self.keys[at] != hashes))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) % np.uint64(len(self.keys))
            key = self.keys[at[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.numbers[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out


class Lattice:
    """All pieces of several words at once, longest word first; place e of all words lies together."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        top = int(self.lengths[0])
        #: Words that reach beyond each place, and where the place's bytes begin.
        self.active = np.searchsorted(-self.lengths, -np.arange(top), "left")
        self.start = np.concatenate(([0], np.cumsum(self.active)))
        data = np.frombuffer(b"".join(words[i] for i in self.order), np.uint8).astype(np.uint64)
        offset = np.cumsum(self.lengths) - self.lengths
        place = np.repeat(np.arange(top), self.active)
        row = np.arange(len(place)) - self.start[place]
        letters = data[offset[row] + place] + np.uint64(1)
        self.ending = [np.zeros(len(place), np.int32) for _ in range(pieces.longest)]
        at, size = np.arange(len(place)), 0
        hashes = np.zeros(len(place), np.uint64)
        while len(at) and size < pieces.longest:
            here = self.start[place[at] + size] + row[at]
            hashes = hashes * _B + letters[here]
            number = pieces.find(hashes)
            whole = number > 0
            self.ending[size][here[whole]] = number[whole]
            size += 1
            go = (number >= 0) & (place[at] + size < self.lengths[row[at]])
            at, hashes = at[go], hashes[go]

    def steps(self) -> Iterator[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each place e: (e, words that reach it, [(length, those words with such a piece ending there, its number)])."""
        for e, n in enumerate(self.active):
            lo = self.start[e]
            found = []
            for size in range(1, min(e + 1, len(self.ending)) + 1):
                number = self.ending[size - 1][lo : lo + n]
                rows = np.flatnonzero(number)
                if len(rows):
                    found.append((size, rows, number[rows]))
            yield e, n, found


def word_scores(pieces: Pieces, words: list[bytes], chances: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability in each language: the sum over all ways to cut it.

    ``chances`` has a row for each piece's number and a column for each language. The forward sums are
    kept relative to the last place, so no word is too long.
    """
    lattice = Lattice(pieces, words)
    total = np.zeros((len(words), chances.shape[1]))
    sums: list[np.ndarray] = [np.ones((len(words), chances.shape[1]))]
    for _, n, found in lattice.steps():
        here = np.zeros((n, chances.shape[1]))
        for size, rows, number in found:
            here[rows] += sums[-size][rows] * chances[number]
        total[:n] += np.log(here)
        sums = [s[:n] / here for s in sums[-pieces.longest + 1 :]] + [np.ones_like(here)]
    out = np.empty_like(total)
    out[lattice.order] = total
    return out


def expected_pieces(pieces: Pieces, words: list[bytes], language: np.ndarray, times: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected count of each piece of each language in words that occur ``times`` in ``language``, in UNITs."""
    lattice = Lattice(pieces, words)
    language, times = language[lattice.order], times[lattice.order]
    sums, steps = [np.ones(len(words))], []
    for e, n, found in lattice.steps():
        here, shares = np.zeros(n), []
        for size, rows, number in found:
            share = sums[-size][rows] * chances[number, language[rows]]
            here[rows] += share
            shares.append(share)
        steps.append((e, n, found, [share / here[rows] for share, (_, rows, _) in zip(shares, found)]))
        sums = [s[:n] / here for s in sums[-pieces.longest + 1 :]] + [np.ones(n)]
    # ends[e]: chance that a piece ends at place e, all cuts of the word weighed
    ends = [np.zeros(n) for n in lattice.active]
    cells, amounts = [], []
    for e, n, found, shares in reversed(steps):
        ends[e][lattice.lengths[:n] == e + 1] = 1.0
        for (size, rows, number), share in zip(found, shares):
            mass = ends[e][rows] * share
            if size <= e:
                ends[e - size][rows] += mass
            cells.append(number.astype(np.int64) * chances.shape[1] + language[rows])
            amounts.append(np.rint(mass * times[rows] / UNIT))
    return np.bincount(np.concatenate(cells), np.concatenate(amounts), chances.size).reshape(chances.shape)


def _groups(words: list[bytes]) -> Iterator[slice]:
    a, size = 0, 0
    for i, w in enumerate(words):
        size += len(w)
        if size >= LATTICE_BYTES:
            yield slice(a, i + 1)
            a, size = i + 1, 0
    if a < len(words):
        yield slice(a, len(words))


def counted_words(texts: DataFrame) -> DataFrame:
    """(lang, word, n): how often a language's texts have each word; the empty word counts the texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                mine = seen.setdefault(lang, Counter())
                mine.update(letter_words(text.as_py()))
                mine[b""] += 1
                if sum(map(len, seen.values())) >= COUNTED:
                    yield from handed(seen)
                    seen = {}
        yield from handed(seen)

    def handed(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    return texts.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, the logarithm of each one's share of the texts, and the chance of every piece in it."""

    def __init__(self, languages: list[str], shares: np.ndarray, chances: np.ndarray):
        self.languages, self.shares, self.chances = languages, shares, chances


def _chances(counts: np.ndarray, added: float) -> np.ndarray:
    """From counts, one row for each piece's number, whose row 0 stays 0."""
    out = counts + added
    out[0] = 0
    return out / out.sum(axis=0)


def fitted(texts: DataFrame, pieces: Pieces, *, rounds: int = ROUNDS, added: float = ADDED) -> Model | None:
    """Piece chances of each language by expectation and maximisation over the words of all ``texts`` (lang, text).

    Spark counts every word of every text once; each round sends the counted words through the lattices
    and adds up expected pieces by language. The driver sees pieces times languages only.
    """
    spark = texts.sparkSession
    words = materialise(counted_words(texts))
    shares = {r["lang"]: r["n"] for r in words.where("word = X''").collect()}
    languages = sorted(shares)
    if not languages:
        return None
    number = spark.sparkContext.broadcast({x: i for i, x in enumerate(languages)})
    table = spark.sparkContext.broadcast(pieces)
    counts = np.ones((pieces.size + 1, len(languages)))
    for _ in range(rounds):
        chances = spark.sparkContext.broadcast(_chances(counts, added))

        def expect(batches: Iterator[pa.RecordBatch], chances=chances) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(chances.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = batch.column("word").to_pylist()
                language = np.array([number.value[x] for x in batch.column("lang").to_pylist()])
                times = batch.column("n").to_numpy()
                for part in _groups(found):
                    total += expected_pieces(table.value, found[part], language[part], times[part], chances.value)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[piece, language].astype(np.int64))], ["piece", "language", "n"])

        rows = words.where("word <> X''").mapInArrow(expect, "piece int, language int, n long").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(counts)
        counts[rows.column("piece").to_numpy(), rows.column("language").to_numpy()] = rows.column("n").to_numpy() * UNIT
        chances.unpersist()
    total = sum(shares.values())
    return Model(languages, np.log([shares[x] / total for x in languages]), _chances(counts, added))


class _Remembered:
    """Scores of words met before, forgotten all at once when they are too many."""

    def __init__(self, pieces: Pieces, chances: np.ndarray):
        self.pieces, self.chances = pieces, chances
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((0, chances.shape[1]))

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The summed scores of each text's words."""
        if len(self.place) > REMEMBERED:
            self.place, self.scores = {}, self.scores[:0]
        new = list({w for words in texts for w in words if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.scores = np.concatenate([self.scores, *(word_scores(self.pieces, new[part], self.chances) for part in _groups(new))])
        place = self.place
        # math.fsum is not needed: the same words in the same order give the same sum
        return [self.scores[[place[w] for w in words]].sum(axis=0) for words in texts]


def predicted(docs: DataFrame, pieces: Pieces, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of rows (doc_id, held_out, text)."""
    spark = docs.sparkSession
    table, learned = spark.sparkContext.broadcast(pieces), spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Remembered(table.value, learned.value.chances) if learned.value else None
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [letter_words(x.as_py()) for x in part.column("text")]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, words in enumerate(texts) if words and memory]
                for i, likely in zip(known, memory.of([texts[i] for i in known]) if known else ()):
                    likely = likely + learned.value.shares
                    best = int(np.argmax(likely))
                    lang[i], score[i] = learned.value.languages[best], float(1 / np.exp(likely - likely[best]).sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def document_languages(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5,
                       vocabulary: str = VOCABULARY, longest: int = LONGEST, rounds: int = ROUNDS, added: float = ADDED) -> DataFrame:
    """Per row the likeliest language of its whole text, learned from the rows whose CRC-32 of the id is not 0 modulo ``folds``.

    A text is its lower-case letter sequences; each one's probability in a language is the sum, over all ways to
    cut it into the vocabulary's pieces, of the product of their chances, and the score is the language's
    share of the total over all languages, weighed by their shares of the learned texts. The
    vocabulary is given and fixed, and holds every byte, so any text has a score.

    NULL texts and texts without a letter are ``und`` with score 0, as is everything where nothing could be
    learned. Rows with a NULL language or text teach nothing, nor do rows with a NULL id, which count as
    held out. Repeated rows teach as often as they come and each get the same result; ties go to the
    language that sorts first; other columns are not read. The learned table is pieces times languages.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"),
        F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(True)).alias("held_out"))
    pieces = Pieces(vocabulary_pieces(vocabulary, longest))
    model = fitted(rows.where("not held_out and lang is not null and text is not null"), pieces, rounds=rounds, added=added)
    return predicted(rows, pieces, model)
