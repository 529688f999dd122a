"""Hard negatives, periodic runs and languages against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import languages, negatives, periods, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, every=100, positives=5, negatives_=10):
    usable = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * float(np.float32(x))) for x in v])
              for i, v, k in rows if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {(i, k, tuple(v)) for i, k, v in usable if i % every == 0}
    for a, ka, va in anchors:
        scored = sorted(((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(va, v)))), i, k) for i, k, v in usable if i != a))
        for ps, p, _ in [x for x in scored if x[2] == ka][:positives]:
            inside = [x for x in scored if x[2] != ka and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:negatives_]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside, 1)]
    return sorted(out)


def clustered(n, dims=8, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, dims))
    return [(i, (centres[rng.integers(6)] + rng.normal(0, spread, dims)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"pass_bytes": 8 * 8 * 5, "tree_anchors": 3}])
def test_negatives_match_all_pairs(spark, bounds):
    rows = clustered(900)
    for i, v, k in rows[:40]:
        rows.append((i, v, k))  # repeated rows, anchors and others
    rows += [(1000, None, 1), (1001, [1.0] * 8, None), (1002, [1.0, None] * 4, 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] * 8, 1), (None, [0.1] * 8, 2)]
    rows += [(1100, [0.5] * 3, 2), (1101, [], 1), (1200, [0.0] * 8, 1), (-100, [0.3] * 8, 0), (1300, [1e30] * 8, 3), (1301, [1e30] * 8, 3), (1302, [-1e30] * 8, 3)]
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit("x").alias("anchor"), F.lit("y").alias("vector"), F.lit(1).alias("score"), F.lit(2).alias("slot"), F.lit(3).alias("all"), F.lit(4).alias("rank"))
    small = [r for r in rows if r[0] is None or r[0] < 1300]
    got = negatives.hard_negatives(df.where("vec_id < 1300 or vec_id is null"), anchor_every=50, **bounds)
    assert sorted(map(tuple, got.collect())) == plain_negatives(small, 50)
    if not bounds:  # scores beyond a long saturate
        sat = [(i, [math.copysign(2**63 / 256 if abs(x) > 1e20 else x, x) for x in v], k) for i, v, k in rows if v and None not in v and k is not None]
        huge = negatives.hard_negatives(df, anchor_every=50).where("anchor_id in (1300)").collect()
        assert {r.positive_score for r in huge} <= {2**63 - 1} and len(sat) > 0


def test_negatives_without_rows(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).collect() == []


def test_bounds_spare_work_and_lose_nothing():
    rows = clustered(3000, dims=16, seed=3)
    v = negatives.matrix([[math.floor(256 * x) for x in r[1]] for r in rows], 16)
    tree = negatives.Tree(0, v[:200], np.arange(200), np.arange(200))
    assert (tree.parent[1:] < np.arange(1, 200)).all() and tree.parent[0] == -1
    for i, p in enumerate(tree.parent[1:], 1):
        assert tree.edge[i] == pytest.approx(np.linalg.norm(tree.vectors[i] - tree.vectors[p]))
    truth, scored = negatives.inner(tree.vectors, v), 0
    low = np.quantile(truth, 0.97)
    for i, at, scores in negatives.bounded_scores(tree, v, negatives._lengths(v), lambda i: (low, np.inf)):
        scored += len(at)
        assert (truth[i, at] == scores).all()
        assert set(np.flatnonzero(truth[i] >= low)) <= set(at)
    assert scored < 0.3 * truth.size


def plain_runs(w):
    out, n = set(), len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out)


@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 39)), max_size=4), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs_of_any_texts(parts):
    texts = [[x for unit, times, more in text for x in unit * times + unit[:more]] for text in parts]
    got = periods.runs_of(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]))
    assert got == [plain_runs(t) for t in texts]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query(spark):
    rng = random.Random(2)
    rows = [(i, " \t".join(rng.choices("abcdefgh", k=rng.randint(0, 150))), "en", "s", 0) for i in range(80)]
    rows += [(100, "x " * 5000, "en", "s", 0), (101, "one two three\n" * 9, "en", "s", 0), (102, None, "en", "s", 0), (103, "", "en", "s", 0), (None, "z " * 30, "en", "s", 0), (101, "one two three\n" * 9, "en", "s", 0)]
    rows += [(104, " ".join(map(str, range(3000))) + " a b c d" * 400, "en", "s", 0), (105, ("é " + "\x85 ") * 20, "fr", "s", 0), (-7, " ".join(map(str, range(60))) * 4, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).select("*", F.lit("c").alias("n_runs"), F.lit("c").alias("start"), F.lit("c").alias("runs"), F.lit("c").alias("kept"))
    got = sorted(periods.periodic_runs(df, planted=True, texts=True).collect(), key=str)
    expected = []
    for i, text, *_ in rows:
        w = planted(i, [x.decode() for x in (text or "").encode().split()])
        runs = plain_runs(w) if len(w) < 4000 else [(0, len(w), 1)] if w[0] == w[-1] else [(3000, 1600, 4)]
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        expected.append((i, len(w), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                         hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), runs, kept))
    plain = sorted((tuple(r[:9]) + ([tuple(x) for x in r.runs], r.kept) for r in got), key=str)
    assert plain == sorted(expected, key=str)
    assert periods.periodic_runs(df.where("false")).collect() == []


def small_pieces():
    names = sorted({bytes([b]) for b in b"abcde"} | {b"ab", b"abc", b"bc", b"cd", b"ca", b"aa", b"aaa"})
    return names, languages.Pieces(names)


def cuts(word, number):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in number:
            for rest in cuts(word[k:], number):
                yield [number[word[:k]], *rest]


def test_forward_sums_all_cuts():
    names, pieces = small_pieces()
    number = {p: i + 1 for i, p in enumerate(names)}
    rng = np.random.default_rng(0)
    chances = rng.random((pieces.size + 1, 3))
    chances[0] = 0
    chances /= chances.sum(axis=0)
    words = [bytes(rng.integers(97, 102, rng.integers(1, 9)).astype(np.uint8)) for _ in range(60)] + [b"a", b"aaaaaaa", b"abcabcab"]
    scores = languages.word_scores(pieces, words, chances)
    which, times = rng.integers(0, 3, len(words)), rng.integers(1, 5, len(words))
    expected = np.zeros_like(chances)
    for w, row, k, n in zip(words, scores, which, times):
        ways = list(cuts(w, number))
        assert row == pytest.approx([math.log(sum(math.prod(chances[i, j] for i in c) for c in ways)) for j in range(3)])
        weight = [math.prod(chances[i, k] for i in c) for c in ways]
        for c, x in zip(ways, weight):
            for i in c:
                expected[i, k] += n * x / sum(weight)
    assert languages.expected_pieces(pieces, words, which, times, chances) * languages.UNIT == pytest.approx(expected, abs=1e-4)
    long = languages.word_scores(pieces, [b"ab" * 3000], chances)  # no underflow
    assert np.isfinite(long).all() and (long < -1000).all()


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in languages.document_languages(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = Counter()
    for r in rows:
        mine = got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= mine.score <= 1
        if mine.held_out:
            right[mine.lang_pred == r.lang] += 1
    assert right[True] >= 0.9 * sum(right.values())
    # neither the language nor the source nor the id of a held-out row matters
    changed = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).withColumn(
        "lang", F.when(F.col("held"), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s")).drop("held")
    again = {r.doc_id: r for r in languages.document_languages(changed.repartition(7)).collect()}
    assert all((again[i].lang_pred, again[i].score) == (r.lang_pred, r.score) for i, r in got.items())


def test_languages_edges(spark):
    rows = [(i, t, k, "s", 0) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)]
    odd = [(None, "the dog", "en", None, None), (100, None, "en", "s", 0), (101, "", "fr", "s", 0), (102, "123 ... \n", "en", "s", 0), (103, "le chien " * 20000, None, "s", 0),
           (104, "日本語のテキスト", "fr", "s", 0), (105, "chat" * 5000, "fr", "s", 0), (106, "THE CAT", None, "s", 0), (106, "THE CAT", None, "s", 0)]
    df = spark.createDataFrame(rows + odd, DOCS).select("*", F.lit(1).alias("held_out"), F.lit(1).alias("word"), F.lit(2).alias("n"), F.lit("x").alias("score"), F.lit("x").alias("lang_pred"))
    found = languages.document_languages(df).collect()
    assert len(found) == len(rows + odd)
    got = {r.doc_id: r for r in found}
    assert {(got[i].lang_pred, got[i].score) for i in (100, 101, 102)} == {("und", 0.0)}
    assert got[None].held_out and got[None].lang_pred == "en" and got[103].lang_pred == "fr" and got[106].lang_pred == "en"
    assert got[104].lang_pred in ("en", "fr")
    assert languages.document_languages(df.where("false")).collect() == []
    unlabelled = languages.document_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_new_queries_read_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op12_diagonal_runs", "op13_piece_languages"):
        assert queries.QUERIES[name](spark, SF).count() == n
