"""Benchmark items found in documents within an edit budget, by exact pieces and bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.windows import RunHashes
from tideline.session import materialise

#: Edits (words replaced, added or lost) allowed for each word of an item.
EDIT_RATE = 0.2
#: Text of benchmark items that one pass over the documents looks for at most, as long as items are not longer.
BLOCK_CHARACTERS = 16_000_000
#: Words of documents that are searched together.
_BATCH_WORDS = 1 << 17
_WORD = re.compile(r"\w+")
MATCHES = "doc_id long, text_key long, item_id long, distance int, item_words int, first_word long, last_word long, start long, stop long"


def myers_search(item: list[int], words: np.ndarray | list[int], budget: int) -> tuple[int, int]:
    """(least edit distance of the item to any run of ``words``, end of the first such run).

    Myers' bit-parallel search: column differences of the distance matrix live in the bits of two
    integers, one step per word; runs may start anywhere at no cost. Distances above the budget still
    come back as found.
    """
    size = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for j, w in enumerate(words):
        same = at.get(int(w), 0)
        vertical = same | down
        same |= (((same & up) + up) ^ up)
        rise, fall = down | ~(same | up) & full, up & same
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | ~(vertical | rise) & full, rise & vertical
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return best, end


def _start(item: list[int], words, end: int, distance: int) -> int:
    """Start of the shortest run ending at ``end`` that is at ``distance`` from the item."""
    tail = list(words[max(0, end - len(item) - distance) : end])[::-1]
    row = list(range(len(item) + 1))
    back = item[::-1]
    for j, w in enumerate(tail, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(back, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != w))
        if row[-1] == distance:
            return end - j
    return end - len(tail)


def item_words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


class PieceIndex:
    """Pieces of a block of items: each item cut into one piece more than its edit budget."""

    def __init__(self, items: list[tuple[int, str | None]], edit_rate: float):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int], int]] = []
        pieces: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item_words(text)]
            if not words:
                continue
            budget = int(edit_rate * len(words) + 1e-9)
            bounds = [len(words) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(bounds, bounds[1:]):
                pieces.setdefault(b - a, {}).setdefault(tuple(words[a:b]), []).append((len(self.items), a))
            self.items.append((item_id, words, budget))
        letters = np.random.default_rng(5).integers(0, 2**63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.letters = letters * np.uint64(2) + np.uint64(1)
        self.pieces = {}
        for size, known in pieces.items():
            rows = np.array(list(known), dtype=np.int64)
            hashes = np.array([RunHashes(self.letters[r], size).at(slice(None), size)[0] for r in rows], dtype=np.uint64)
            self.pieces[size] = (np.sort(hashes), known)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, piece's place, place where the item would start) of every exact piece in the word ids."""
        known = ids > 0
        runs = RunHashes(self.letters[ids], max(self.pieces, default=1))
        reach = np.cumsum(np.concatenate(([0], known)))
        for size, (hashes, owners) in self.pieces.items():
            if len(ids) < size:
                continue
            # a piece can only stand where all its words belong to some item
            places = np.flatnonzero(reach[size:] - reach[:-size] == size)
            found = runs.at(places, size)
            near = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            for place in places[hashes[near] == found]:
                for item, offset in owners.get(tuple(ids[place : place + size].tolist()), ()):
                    yield item, int(place), int(place) - offset

    def matches(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, distance, first word, last word + 1) of the best match of each pair in a batch.

        Documents lie one after another in ``ids`` from ``starts`` on, one unknown word between them.
        Runs around the pieces that touch are searched as one, so a text full of hits costs its length.
        """
        runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, at, place in self.hits(ids):
            _, words, budget = self.items[item]
            doc = int(np.searchsorted(starts, at, "right")) - 1
            low, high = int(starts[doc]), int(starts[doc + 1]) - 1 if doc + 1 < len(starts) else len(ids) - 1
            runs.setdefault((doc, item), []).append((max(low, place - budget), min(high, place + len(words) + budget)))
        for (doc, item), found in runs.items():
            _, words, budget = self.items[item]
            best = None
            found.sort()
            a, b = found[0]
            for c, d in [*found[1:], (len(ids) + 1, 0)]:
                if c <= b:
                    b = max(b, d)
                    continue
                distance, end = myers_search(words, ids[a:b], budget)
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, a + _start(words, ids[a:b], end, distance), a + end)
                a, b = c, d
            if best:
                yield doc, item, best[0], best[1] - int(starts[doc]), best[2] - int(starts[doc])


class _Ids(dict):
    """Word to id, 0 for words of no item; forgets when the vocabulary seen grows large."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = self.vocabulary.get(word.lower(), 0)
        return found


def _search(index: PieceIndex):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(index.vocabulary)
        lookup = ids.__getitem__
        held: list[tuple[int | None, int, str]] = []
        parts: list[np.ndarray] = []
        length = 0

        def rows() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            out = []
            for doc, item, distance, a, b in index.matches(np.concatenate(parts), starts):
                doc_id, text_key, text = held[doc]
                spans = [m.span() for m in _WORD.finditer(text)]
                item_id, words, _ = index.items[item]
                out.append((doc_id, text_key, item_id, distance, len(words), a, b, spans[a][0], spans[b - 1][1]))
            columns = list(zip(*out)) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc_id, text_key, text in zip(batch.column("doc_id"), batch.column("text_key"), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                words = _WORD.findall(text)
                held.append((doc_id.as_py(), text_key.as_py(), text))
                parts.append(np.array([*map(lookup, words), 0], dtype=np.int64))
                length += len(words)
                if length > _BATCH_WORDS:
                    yield rows()
                    held, parts, length = [], [], 0
        if parts:
            yield rows()

    return search


def item_matches(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edit_rate: float = EDIT_RATE,
                 block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """Best match of every (document row, item) pair within the item's edit budget.

    Words are runs of letters, digits and underscore, lowered; the budget is ``edit_rate`` edits for
    each word of the item. A run within the budget holds one of budget + 1 pieces unchanged, so exact
    piece hits miss nothing; Myers' distance then decides. Columns: doc_id, item_id, distance,
    item_words, the words and the characters of the matching run. Items are searched in blocks of
    bounded text, each block in one pass over all documents; an item of under five words is found
    unchanged only, as a fifth of it is no whole word. NULL and empty texts and items match
    nothing; repeated rows give repeated matches; other columns are not read.
    """
    return _keyed_matches(docs, items, id_column, text_column, edit_rate, block_characters).drop("text_key")


def _keyed_matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", edit_rate: float = EDIT_RATE,
                   block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """The matches with ``text_key``, a hash of the document's text."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_characters))
    found = None
    for block in range(blocks):
        dealt = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        index = PieceIndex([(r.item_id, r.text) for r in dealt.collect()], edit_rate)
        part = rows.mapInArrow(_search(index), MATCHES)
        # matches are written block by block, so only one block's index is alive
        part = materialise(part) if blocks > 1 else part
        found = part if found is None else found.unionAll(part)
    return found


def without_items(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that match no item, all their columns unchanged.

    Rows are told apart by id and text, so a NULL or repeated id goes only with the texts that match.
    """
    bad = _keyed_matches(docs, items, **settings).select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    text_key = F.xxhash64(docs[settings.get("text_column", "text")].cast("string"))
    return docs.join(bad, docs[settings.get("id_column", "doc_id")].eqNullSafe(bad["_bad_id"]) & (text_key == bad["_bad_key"]), "left_anti")
