"""Cases that were once cut, and models and stages recomputed by plain code."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import chats, decontaminate, fmquality, linefreq, mixing, nearcopies, secretscan, warc
from tideline.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_urls_are_archived_and_read_back(spark):
    rows = [(1, "https://x/" + "é" * 500_000, "<html>"), (2, "u" * 3_000_000, None), (3, None, "<html>"), (4, "a\r\nWARC-Type: evil", "z")]
    got = {r.page_id: tuple(r)[1:] for r in warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert got == {1: (6, digest("<html>"), "revisit", 3), 2: (0, digest(""), "response", None), 3: (6, digest("<html>"), "response", None), 4: (1, digest("z"), "response", None)}


def test_short_items_have_their_budget(spark):
    items = spark.createDataFrame([(1, "one two three four five"), (2, "alpha beta gamma delta"), (3, "p q r s t u v w x y")], "item_id long, text string")
    texts = ["one two three four five", "so one two wrong four five then", "one two three four", "one three four five", "one two wrong wrong five", "alpha beta gamma delta", "alpha beta gone delta",
             "p q r s t u v w", "p q r s t u v"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.item_matches(docs, items).collect()}
    assert found == {(0, 1): 0, (1, 1): 1, (2, 1): 1, (3, 1): 1, (5, 2): 0, (7, 3): 2}
    blocks = {(r.doc_id, r.item_id): r.distance for r in decontaminate.item_matches(docs, items, block_characters=20).collect()}
    assert blocks == found


def test_parts_go_by_place_not_by_number(spark):
    rows = [(1, 1000 * k, "user", f"t{k}") for k in range(4)] + [(2, k // 3, "user", f"r{k}") for k in range(600)] + [(3, None, "user", f"n{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chats.rendered(df).collect()
    assert Counter(r.conv_id for r in got) == {1: 1, 2: 3, 3: 2}
    assert {(r.conv_id, r.part): r.rendered.count("<|end|>") for r in got} == {(1, 0): 4, (2, 0): 256, (2, 1): 256, (2, 2): 88, (3, 0): 256, (3, 1): 44}
    db = duckdb.connect()
    db.register("frame", df.toPandas().astype({"turn": "Int64"}))
    db.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    want = db.execute(ORACLES["op8_snapshot_collapse"]).fetchall()
    assert sorted((r.conv_id, r.part, r.turns, r.copies, r.rendered) for r in got) == sorted(want)


def test_scores_are_the_factorisation_machine(spark):
    """Every pair of inputs added up one by one, from the fitted bias, weights and factors."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fmquality.fit(fmquality.training_rows(docs, labels), iterations=10)
    few = docs.orderBy("doc_id").limit(12)
    inputs = {r.doc_id: r.features for r in fmquality.features(few.select("doc_id", "text", "n_chars"), size_column="n_chars").select("doc_id", "features").collect()}
    weights, factors = model.linear.toArray(), model.factors.toArray()
    for r in fmquality.scored(few, model).collect():
        x = inputs[r.doc_id].toArray()
        at = np.flatnonzero(x)
        pairs = sum(x[i] * x[j] * float(factors[i] @ factors[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        raw = model.intercept + weights @ x + pairs
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_repeated_ids_do_not_stretch_the_training_rows(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i} of some words", "en", "s", 10 + i) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(7))
    assert fmquality.training_rows(docs, labels).count() == 7 - held


def reviewed_documents(n, seed):
    """Secrets and lookalikes of formats that no pattern of the library knows, with the truth by construction."""
    rng = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, truth = [], {}
    for i in range(n):
        random_token = "".join(rng.choices(alphabet, k=rng.randint(24, 60)))
        words = rng.sample(["river", "stone", "garden", "window", "market", "letter", "summer", "winter", "bridge", "forest"], 4)
        plain = f"{words[0].title()}{words[1].title()}{words[2].title()}{words[3].title()}{rng.randint(10, 99)}"
        secret = rng.random() < 0.5
        token = random_token if secret else plain
        before = rng.choice(["the value", "we saw", "entry", "name of it"])
        text = f"{' '.join(rng.choices(words, k=20))} {before} {token} {' '.join(rng.choices(words, k=20))}"
        rows.append((i, text, "en", "a/b.py", 0))
        truth[i] = (token, secret)
    return rows, truth


def test_forest_learns_from_reviewed_findings(spark):
    """Trained on reviewed findings, the forest judges tokens of formats that no pattern of the library labels."""
    rows, truth = reviewed_documents(400, 5)
    docs = spark.createDataFrame(rows, DOCS)
    found = secretscan.findings(docs, path_column="source")
    mine = spark.createDataFrame([(i, t, float(s)) for i, (t, s) in truth.items()], "doc_id long, candidate string, label double")
    reviewed = found.join(mine, ["doc_id", "candidate"])
    assert reviewed.where("label = 1 and known is not null").count() == 0  # no pattern knows them
    judged = secretscan.secret_findings(docs, reviewed.where("doc_id < 200").select("features", "label"), path_column="source").where("doc_id >= 200").collect()
    right = [r.is_secret == truth[r.doc_id][1] for r in judged if r.candidate == truth[r.doc_id][0]]
    assert len(right) == 200 and sum(right) >= 0.95 * len(right)


def plain_features(text, start, stop, path):
    """Shares and counts of a candidate, by the words of the docstrings."""
    value = text[start:stop]
    kind = lambda c: "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"
    kinds = "".join(map(kind, value))
    n = len(value)
    pairs = list(zip(kinds, kinds[1:]))
    share = lambda f: sum(map(f, pairs)) / n
    line = text[:start].rsplit("\n", 1)[-1] + value + text[stop:].split("\n", 1)[0]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return {
        "length": n, "digits": kinds.count("d") / n, "upper": kinds.count("u") / n, "lower": kinds.count("l") / n, "other": kinds.count("o") / n,
        "hex": len(re.findall("[0-9a-fA-F]", value)) / n, "entropy": entropy, "class_changes": share(lambda p: p[0] != p[1]),
        "letter_digit_changes": share(lambda p: "d" in p and set(p) & {"l", "u"} != set()), "case_changes": share(lambda p: set(p) == {"u", "l"}),
        "repeats": sum(a == b for a, b in zip(value, value[1:])) / n, "padding": n - len(value.rstrip("=")), "all_digits": float(value.isdigit()),
        "line_share": n / len(line), "path_depth": (path or "").count("/"),
    }


def test_features_are_what_they_are_called(spark):
    rows, _ = reviewed_documents(40, 9)
    rows += [(900, 'key = "AbC123dEf456=="\nnext 2024-01-05T10:11 line\n\ndeadbeefdeadbeef00', "en", None, 0), (901, "a1b2c3d4e5f6", "en", "x/y/z.txt", 0)]
    text_of = {r[0]: r for r in rows}
    for r in secretscan.findings(spark.createDataFrame(rows, DOCS), path_column="source").collect():
        text, path = text_of[r.doc_id][1], text_of[r.doc_id][3]
        assert text[r.start : r.stop] == r.candidate
        have = dict(zip(secretscan.FEATURES, r.features))
        for name, want in plain_features(text, r.start, r.stop, path).items():
            assert have[name] == pytest.approx(want), (name, r.candidate)


def test_long_lines_cost_their_length():
    rng = random.Random(3)
    def spent(n):
        text = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(n))
        breaks = []
        began = time.perf_counter()
        for a, b in secretscan.candidates(text):
            secretscan.finding_features(text, a, b, set(), set(), None, breaks)
        return (time.perf_counter() - began) / n
    spent(500)
    assert spent(40_000) < 4 * spent(2_000)


def plain_distance(item, words):
    """Least edits that make the item a run of the words, row by row."""
    row = np.zeros(len(words) + 1, np.int64)
    reach = np.arange(len(words) + 1)
    for i, w in enumerate(item, 1):
        here = np.minimum(row + 1, np.concatenate(([row[0] + 1], row[:-1] + np.array([x != w for x in words], np.int64))))
        here[0] = i
        row = np.minimum.accumulate(here - reach) + reach
    return int(row.min())


def test_every_stage_against_plain_code(spark):
    """Each stage is given what the one before kept; what it must keep is worked out without the library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).unionByName(
        spark.createDataFrame([(5000 + i, t, "en", None if i % 2 else "odd", len(t or "")) for i, t in enumerate([None, "", "short", " \n", "same words here " * 30, "same words here " * 30])], DOCS))
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    secret = lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    docs = docs.unionByName(spark.createDataFrame([(6000 + i, f"{prose()} {secret() if i % 2 else rng.randrange(10**15, 10**16)} {prose()}", "en", "odd", 7) for i in range(24)], DOCS))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = [r.asDict() for r in docs.collect()]
    words = lambda t: [w.decode() for w in (t or "").encode().split()]

    # 1: no line of this table is in more than 100 texts of a host, so only the base rules decide
    hosts = defaultdict(set)
    for r in rows:
        for line in set((r["text"] or "").split("\n")):
            hosts[r["source"], line.strip()].add(r["text"])
    assert all(len(x) <= linefreq.MAX_DOCUMENTS for (_, line), x in hosts.items() if line)

    def passes(text):
        w = words(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(windows)
        repeated = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(3)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    one = corpus_pipeline.quality_rules(spark, docs, SF)
    kept = [r for r in rows if passes(r["text"])]
    assert sorted(r.doc_id for r in one.collect()) == sorted(r["doc_id"] for r in kept) and one.columns == docs.columns
    one = spark.createDataFrame(one.collect(), docs.schema)

    # 2
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [[x.lower() for x in words(r["text"])]] for i in range(max(1, len(w) - 4))} for r in kept}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    two = corpus_pipeline.near_copies(spark, one, SF)
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(group.values()))
    two = spark.createDataFrame(two.collect(), docs.schema)

    # 3
    items = [[w.lower() for w in re.findall(r"\w+", r.text or "")] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    texts = {r.doc_id: [w.lower() for w in re.findall(r"\w+", r.text)] for r in two.collect()}
    clean = {i for i, t in texts.items() if not any(set(item) & set(t) and plain_distance(item, t) <= int(0.2 * len(item)) for item in items if item)}
    few = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    three = decontaminate.without_items(two, few)
    assert {r.doc_id for r in three.collect()} == clean
    three = spark.createDataFrame(corpus_pipeline.benchmark_decontamination(spark, two, SF).collect(), docs.schema)

    # 4: what the forest accepts is gone, everything else is as it was
    found = [r for r in secretscan.secret_findings(three, path_column="source").collect() if r.is_secret]
    four = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, three, SF).collect()}
    for r in three.collect():
        text = r.text
        for f in sorted((f for f in found if f.doc_id == r.doc_id), key=lambda f: -f.start):
            text = text[: f.start] + "[SECRET]" + text[f.stop :]
        assert four[r.doc_id].text == text and four[r.doc_id].n_chars == (len(text) if text != r.text else r.n_chars)
    assert found and len(four) == three.count()

    # 5
    mixed = corpus_pipeline.source_mix(spark, spark.createDataFrame(list(four.values()), docs.schema), SF).collect()
    sizes = {i: len(words(r.text)) for i, r in four.items()}
    assert {r.doc_id: r["size"] for r in mixed} == sizes and all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    taken, target = Counter(), {}
    for r in mixed:
        taken[four[r.doc_id].source] += r.taken
        target[four[r.doc_id].source] = r.target
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - t) <= max(256, 0.1 * t) for s, t in target.items())
