"""Periodic runs of words by seeds on diagonals.

A run of period q and at least max(24, 3q) words agrees with itself q words further on over at least
max(24 - q, 2q) words. Of the gram lengths 16, 32, 64, ... one is therefore at least the period and
at most that overlap: 16 up to period 15, and 2b for the periods b to 2b - 1. In a run of smallest
period q the next place of such a gram is exactly q words on. A nearer one, r words on, would give the
gram the period r as well. Where r divides q, the gram holds a whole period of the run, which would
then have period r. Otherwise the gram's places within its own length lie r apart (those of a word that
overlaps itself are an arithmetic progression), so q would be a multiple of r after all. Hence one seed
for each place and gram length finds every run, however often a gram recurs: work and memory are
n log n for a text of n words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a run, and least number of its periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of the shortest gram: the overlap of every run on its diagonal is at least this.
FIRST_GRAM = 16
#: Words of short texts that are indexed together.
GROUP_WORDS = 1 << 18
RESULT = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long,"
          " runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def seeds(letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram length, places, lags): grams of texts laid end to end whose next place is in the length's class of lags.

    A gram is named by a hash, so a seed is only a candidate: extending it compares the letters.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams, size = letters.astype(np.uint64), 1
    longest = int(sizes.max(initial=0))
    while 2 * size <= longest:
        grams = _mixed(grams[:-size] * _FACTOR + grams[size:])
        size *= 2
        # a run of a period of this class is no shorter than three of its least periods
        if size < FIRST_GRAM or longest < max(LEAST_WORDS, LEAST_PERIODS * size // 2):
            continue
        low, high = (1, size) if size == FIRST_GRAM else (size // 2, size)
        at = np.flatnonzero(text[: len(grams)] == text[size - 1 :])
        order = at[np.argsort(grams[at], kind="stable")]
        lag = order[1:] - order[:-1]
        same = (grams[order[1:]] == grams[order[:-1]]) & (text[order[1:]] == text[order[:-1]]) & (lag >= low) & (lag < high)
        yield size, order[:-1][same], lag[same]


def _stretch(letters: np.ndarray, begin: int, end: int, at: int, lag: int) -> tuple[int, int]:
    """The stretch [a, b) around ``at``, inside [begin, end - lag), whose letters equal those ``lag`` further on."""
    a, b, step = at, at, 64
    while b < end - lag:
        stop = min(b + step, end - lag)
        differ = np.flatnonzero(letters[b:stop] != letters[b + lag : stop + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = stop, step * 2
    step = 64
    while a > begin:
        stop = max(a - step, begin)
        differ = np.flatnonzero(letters[stop:a] != letters[stop + lag : a + lag])
        if len(differ):
            a = stop + int(differ[-1]) + 1
            break
        a, step = stop, step * 2
    return a, b


def runs_of(letters: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of several texts laid end to end, by start and period.

    Seeds are taken by lag and place. For each text and lag the furthest place that an extension has
    covered is kept; a seed before it lies on a diagonal already known and is passed over.
    """
    ends = np.cumsum(sizes)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for _, at, lag in seeds(letters, sizes):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # seeds side by side on a diagonal are one stretch, so only its first is looked at
        lead = np.ones(len(at), bool)
        lead[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        at, lag = at[lead], lag[lead]
        whose = np.searchsorted(ends, at, "right")
        covered: dict[tuple[int, int], int] = {}
        for p, q, t in zip(at.tolist(), lag.tolist(), whose.tolist()):
            if p < covered.get((t, q), -1):
                continue
            end = int(ends[t])
            a, b = _stretch(letters, end - int(sizes[t]), end, p, q)
            covered[t, q] = max(b, p + 1)
            if b - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found[t].append((a - end + int(sizes[t]), b - a + q, q))
    return [sorted(set(x)) for x in found]


def _periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail laid in where the id asks for it; a NULL id never does."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _results(group: list[tuple[int | None, list[bytes]]], ids: dict[bytes, int]) -> list[tuple]:
    sizes = np.array([len(w) for _, w in group], np.int64)
    letters = np.fromiter((ids.setdefault(w, len(ids)) for _, ws in group for w in ws), np.int64, int(sizes.sum()))
    out = []
    for (doc_id, words), runs in zip(group, runs_of(letters, sizes)):
        n, kept = len(words), words
        best = None
        if runs:
            edge = np.zeros(n + 1, np.int64)
            for start, length, period in runs:
                edge[start + period] += 1
                edge[start + length] -= 1
                # exact: length / period against the best so far, runs come by start and period
                if best is None or length * best[2] > best[1] * period:
                    best = (start, length, period)
            kept = [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not gone]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        out.append((doc_id, n, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
                    [{"start": s, "length": length, "period": q} for s, length, q in runs], b" ".join(kept).decode()))
    return out


def periodic_runs(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", planted: bool = False, texts: bool = False) -> DataFrame:
    """Per row its runs: stretches of words with smallest period q, of at least max(24, 3q) words.

    (doc_id, n_words, n_runs, the run of greatest exponent, digests, all runs, and with ``texts`` the
    words kept when all of a run but its first period goes). With ``planted`` a tail of the texts
    whose id's CRC-32 is divisible by ten is first made periodic, as a check of what is found. NULL and empty
    texts have no words and no runs; rows that repeat an id or a text each get their own result; a NULL
    id is kept and plants nothing; ties go to the smaller start, then period; other columns are not
    read. A text is one row of one task, which holds some 50 bytes for each of its words; nothing
    is shuffled.
    """
    columns = [c.split()[0] for c in RESULT.split(", ")] + ["kept"]
    given = len(columns) if texts else len(columns) - 1

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns, dtype=object)
        return out.iloc[:, :given]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = (text or "").encode().split()
                group.append((doc_id, _periodic(words, doc_id) if planted else words))
                size += len(words)
                if size >= GROUP_WORDS:
                    yield frame(_results(group, {}))
                    group, size = [], 0
        if group:
            yield frame(_results(group, {}))

    # ids as text: a NULL among whole numbers would make them floats
    rows = docs.select(F.col(id_column).cast("long").cast("string").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInPandas(scan, RESULT + (", kept string" if texts else ""))
