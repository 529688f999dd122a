"""Windows of a sequence cut into segments that content alone decides.

A window is ``length`` consecutive letters (bytes, or hashed words). The anchor of a window is the
``gram`` letters in it with the smallest hash, the leftmost of equals, so equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a segment. Two segments with equal
``(core, body)`` hashes hold the same letters, hence the same windows; a window can only recur in a
segment whose core, the letters that all its windows share, recurs. Long repeats thus shrink to one
row for some dozens of letters.
"""

from __future__ import annotations

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_LETTERS = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * _B
    return x ^ (x >> np.uint64(29))


def byte_letters(data: bytes) -> np.ndarray:
    return _BYTE_LETTERS[np.frombuffer(data, np.uint8)]


class RunHashes:
    """Hashes of all runs of 1, 2, 4, ... letters; any other length is two runs that overlap."""

    def __init__(self, letters: np.ndarray, longest: int):
        self.n = len(letters)
        self.levels = [letters]
        step = 1
        while 2 * step <= longest and len(self.levels[-1]) > step:
            last = self.levels[-1]
            self.levels.append(mixed(last[:-step] * _A + last[step:]))
            step *= 2

    def at(self, starts: np.ndarray | slice, size: int) -> np.ndarray:
        """Hashes of the runs of ``size`` letters at ``starts``; all of them for ``slice(None)``."""
        level = size.bit_length() - 1
        whole = 1 << level
        runs = self.levels[level]
        if isinstance(starts, slice):
            starts = np.arange(self.n - size + 1)
            if whole == size:
                return runs
            return mixed(runs[: len(starts)] * _B + runs[size - whole : size - whole + len(starts)])
        if whole == size:
            return runs[starts]
        return mixed(runs[starts] * _B + runs[starts + (size - whole)])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step, best = 1, values
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < width:
        best = np.minimum(best[: len(values) - width + 1], best[width - step : width - step + len(values) - width + 1])
    return best


def _anchors(runs: RunHashes, length: int, gram: int) -> np.ndarray:
    """Place of the anchor of every window."""
    grams = runs.at(slice(None), gram)
    # hash in the high half, place in the low half: the minimum is the leftmost of the smallest
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    return (_sliding_min(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(letters: np.ndarray, length: int, gram: int, step: int | None = None, sizes: np.ndarray | None = None):
    """(first window, windows, core hash, body hash) of every segment; empty below one window.

    The core is what all windows of a segment hold: the anchor, or, where segments are cut further into
    runs of ``step`` windows counted from the anchor, the letters that all windows of such a run share.
    The body is all letters of the segment. With step 1 a segment is a window, its core and its body.
    With ``sizes`` the letters are sequences of so many letters, one after the other; no segment
    reaches over the end of one.
    """
    n = len(letters) - length + 1
    if n < 1:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none.astype(np.int64), none, none
    runs = RunHashes(letters, length)
    anchor = _anchors(runs, length, gram)
    change = anchor[1:] != anchor[:-1]
    if step:
        turn = (anchor - np.arange(n)) // step
        change |= turn[1:] != turn[:-1]
    opens = np.concatenate(([True], change))
    inside = None
    if sizes is not None:
        stop = np.cumsum(sizes)
        edge = np.zeros(n + 1, np.int64)
        has = sizes >= length
        np.add.at(edge, (stop - sizes)[has], 1)
        np.add.at(edge, (stop - length + 1)[has], -1)
        opens |= edge[:-1] != 0
        inside = np.cumsum(edge[:-1]) > 0
        # where one sequence of a single window ends and the next begins, the two edges cancel out
        opens[(stop - sizes)[has]] = True
    first = np.flatnonzero(opens)
    count = np.diff(np.append(first, n))
    if inside is not None:
        first, count = first[inside[first]], count[inside[first]]
    at = anchor[first]
    core = runs.at(at - step * turn[first], length - step + 1) if step else runs.at(at, gram)
    body = runs.at(first, length) * _A + runs.at(first + count - 1, length)
    body = mixed(body + (count.astype(np.uint64) << np.uint64(20)) + (at - first).astype(np.uint64))
    return first, count, mixed(core + _B), body
