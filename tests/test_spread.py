"""Scans, sweeps and folds whose groups lie in many partitions, against plain loops."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import align, benchmark, risk, scale
from tideline.operators.sweep import first_cover

DAY0 = datetime.date(2024, 1, 1)


@pytest.fixture()
def split(spark):
    """A session whose range partitions are not put together, however small."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)


def day(n):
    return None if n is None else DAY0 + datetime.timedelta(n)


def test_first_cover_equals_all_pairs(split):
    rng = random.Random(3)
    notices, asked = [], []
    for i in range(700):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        a = rng.randrange(400)
        b = a + rng.choice([0, 1, 5, 60, 300, -3])
        notices.append((rng.randrange(10**6), key, None if rng.random() < 0.01 else day(a), None if rng.random() < 0.01 else day(b)))
    notices.append((5, None, day(0), day(900)))
    for _ in range(1500):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(8)}"
        asked.append((key, day(rng.randrange(-20, 420))))
    asked += [(None, day(3)), ("hot", None)]
    n = split.createDataFrame(notices, "pos long, code string, start_d date, end_d date")
    q = split.createDataFrame(asked, "code string, d date")
    got = {(r.code, r.d): r.pos for r in first_cover(n, q, "code", "start_d", "end_d", "pos", "d").collect()}
    expected, closed = {}, {}
    for key, d in set(asked):
        if key is None or d is None:
            continue
        for out, unknown in ((expected, False), (closed, True)):
            hit = [p for p, k, a, b in notices if k == key and ((unknown and (a is None or b is None)) or ((a is None or a <= d) and (b is None or d <= b)))]
            if hit:
                out[key, d] = min(hit)
    assert got == expected and len(got) > 300
    assert {(r.code, r.d): r.pos for r in align.cover_days(n, q).collect()} == closed
    assert first_cover(n.where("false"), q, "code", "start_d", "end_d", "pos", "d").collect() == []
    assert first_cover(n, q.where("false"), "code", "start_d", "end_d", "pos", "d").collect() == []


def test_a_long_notice_is_never_opened(split, capsys):
    n = split.createDataFrame([(1, "a", datetime.date(1900, 1, 1), datetime.date(2024, 1, 1))], "pos long, code string, start_d date, end_d date")
    q = split.createDataFrame([("a", day(0)), ("a", day(1))], "code string, d date")
    cover = first_cover(n, q, "code", "start_d", "end_d", "pos", "d")
    assert [tuple(r) for r in cover.collect()] == [("a", day(0), 1)]
    cover.explain()
    assert "sequence" not in capsys.readouterr().out


ROWS = [("hot" if i % 3 else f"g{i % 7}", i, None if i % 13 == 0 else ((i * 37) % 101 - 50) / 25.0) for i in range(600)]


def test_scans_of_every_step(split):
    df = split.createDataFrame(ROWS, "g string, i long, v double").repartition(5)
    v = F.col("v")
    placed = scale.place(df, ["g"], [F.col("i")])
    parts = placed.rows.groupBy("g").agg(F.countDistinct("_part").alias("n")).where("g = 'hot'").first().n
    assert parts > 3
    got = placed.scan(top=scale.running_max(v), total=scale.running_sum(v), last=scale.running_last(v), prev=scale.previous(v), prod=scale.running_product(1 + v / 10))
    # a second scan over the same placement sees what the first added
    rows = sorted(got.scan(peak=scale.running_max(F.col("total"))).done().collect(), key=lambda r: r.i)
    assert len(rows) == len(ROWS)
    state = {}
    for r, (g, i, v) in zip(rows, ROWS):
        s = state.setdefault(g, dict(top=None, total=None, last=None, prev=None, prod=1.0, peak=None))
        if v is not None:
            s["top"] = v if s["top"] is None else max(s["top"], v)
            s["total"] = (s["total"] or 0) + v
            s["last"] = v
            s["prod"] *= 1 + v / 10
        if s["total"] is not None:
            s["peak"] = s["total"] if s["peak"] is None else max(s["peak"], s["total"])
        for name, want in s.items():
            have = r[name]
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, rel=1e-9, abs=1e-12)), (name, i)
        s["prev"] = v


def test_affine_steps_fold(split):
    df = split.createDataFrame([(g, i, 0.0 if i % 31 == 0 else 0.9, float(v or 0)) for g, i, v in ROWS], "g string, i long, a double, b double")
    folded = scale.place(df, ["g"], [F.col("i").desc()]).fold(
        "x", ["a", "b"], "a double, b double", (1.0, 0.0), lambda s, a, b: (s[0] * a, s[1] * a + b),
        lambda old, own: F.struct((old["a"] * own["a"]).alias("a"), (old["b"] * own["a"] + own["b"]).alias("b")))
    now = {}
    for r in sorted(folded.done().collect(), key=lambda r: -r.i):
        now[r.g] = now.get(r.g, 0.0) * r.a + r.b
        assert math.isclose(r.x.b, now[r.g], rel_tol=1e-9, abs_tol=1e-12)


def test_daily_volatility_of_a_split_code_with_a_large_mean(split):
    """Old returns of a giant size still count, and a large common part costs no digits."""
    rng = random.Random(5)
    values = [1e12] + [rng.gauss(0, 0.02) for _ in range(150)] + [1000 + rng.gauss(0, 1e-4) for _ in range(450)]
    rows = [(1, i, v) for i, v in enumerate(values)] + [(2, i, values[-i - 1]) for i in range(40)]
    df = split.createDataFrame(rows, "code long, i long, r double").withColumn("d", F.date_add(F.lit(DAY0), F.col("i").cast("int")))
    for span, start in ((100, 0), (3, 0), (100, 160)):
        got = risk.ewm_std_daily(df.where(F.col("i") >= start), span).where("code = 1").orderBy("i").toPandas()
        weights = [(1 - 2 / (span + 1)) ** k for k in range(len(values))]
        for n in list(range(1, len(got), 37)) + [len(got) - 1]:
            part = values[start : start + n + 1][::-1]
            w = weights[: len(part)]
            total, squares = math.fsum(w), math.fsum(x * x for x in w)
            mean = math.fsum(a * b for a, b in zip(w, part)) / total
            spread = math.fsum(a * (b - mean) ** 2 for a, b in zip(w, part))
            assert got["sigma"][n] == pytest.approx(math.sqrt(spread * total / (total * total - squares)), rel=1e-7)
        assert list(got["observations"]) == list(range(1, len(got) + 1))


def test_returns_index_and_drawdown_of_a_split_code(split):
    rng = random.Random(6)
    closes, price = [], 100.0
    for i in range(500):
        price *= math.exp(rng.gauss(0, 0.03))
        closes.append((1, day(i), None if i % 50 == 7 else (0.0 if i % 90 == 3 else price)))
    df = split.createDataFrame([r for r in closes if r[2] is not None] + [(2, day(i), 10.0 + i) for i in range(5)], "code long, d date, close double")
    cal = align.calendar(split.createDataFrame([(day(i),) for i in range(500)], "d date"))
    numbered = df.join(cal, "d")
    got = {r.i: r.r for r in risk.log_returns(numbered).where("code = 1").collect()}
    want = {i + 1: math.log(b[2] / a[2]) for i, (a, b) in enumerate(zip(closes, closes[1:]), 1) if a[2] and b[2] and a[2] > 0 and b[2] > 0}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)

    events = split.createDataFrame([(1, day(20), 0.5, 0.0, 1), (1, day(57), 0.1, 2.0, 2), (1, day(57), 0.0, 1.0, 3)], "code long, ex_date date, ratio double, cash double, batch long").withColumn("rights", F.lit(False))
    placed = benchmark.placed_index(df, cal, events)
    index = placed.done().where("code = 1").orderBy("i").toPandas()
    level, expected, last, peak, fall = 100.0, [], None, 0.0, 0.0
    acts = {20: (1.5, 0.0), 57: (1.1, 3.0)}
    factor, cash = 1.0, 0.0
    for i, (_, _, close) in enumerate(closes):
        if i in acts:
            cash, factor = cash + factor * acts[i][1], factor * acts[i][0]
        if close is None:
            continue
        level *= (close * factor + cash) / last if last else 1.0
        last, factor, cash = close, 1.0, 0.0
        expected.append(level)
        peak = max(peak, level)
        fall = max(fall, (peak - level) / peak if peak > 0 else 0)
    assert list(index["total_return_index"]) == pytest.approx(expected)
    assert benchmark.max_drawdown(placed).where("code = 1").first().max_drawdown == pytest.approx(fall)


def test_greedy_limits_walk_a_split_day_piece_by_piece(split):
    rng = random.Random(8)
    own = [None, None, None, "below_one_lot", "odds_below_one"]
    rows, states = [], []
    for d in range(12):
        size = 2500 if d == 3 else rng.randrange(1, 60)
        rows += [(day(d), c, c + 1, rng.choice(own), 1, rng.choice([1.0, 4.0, 15.0, 70.0]), rng.choice([50.0, 400.0, 3000.0])) for c in range(size)]
        states.append((day(d), rng.randrange(0, 5), rng.randrange(0, 3), 10.0 * rng.randrange(0, 4), float(rng.randrange(0, 18))))
    states[3] = (day(3), 0, 0, 0.0, 0.0)
    sized = split.createDataFrame(rows, "d date, code long, rank long, own_reason string, shares long, position_pct double, position_value double")
    state = split.createDataFrame(states, "d date, entries int, open_positions int, exposure_pct double, drawdown_pct double")
    for cfg in (risk.RiskConfig(), risk.RiskConfig(max_concurrent=40, monthly_entry_cap=30, max_total_exposure_pct=200.0, daily_buy_budget=9000.0),
                risk.RiskConfig(max_concurrent=4000, monthly_entry_cap=4000, max_total_exposure_pct=3000.0)):
        want = {}
        for d, entries, open_, exposure, drawdown in states:
            money = cfg.daily_buy_budget
            for _, code, rank, why, _, pct, value in sorted((r for r in rows if r[0] == d), key=lambda r: r[2]):
                reason = ("circuit_breaker" if drawdown >= cfg.circuit_breaker_pct else "monthly_turnover_cap" if entries >= cfg.monthly_entry_cap
                          else "concurrent_position_cap" if open_ >= cfg.max_concurrent else why if why
                          else "total_exposure_cap" if exposure + pct > cfg.max_total_exposure_pct else "daily_buy_budget" if money is not None and value > money else None)
                if reason is None:
                    entries, open_, exposure, money = entries + 1, open_ + 1, exposure + pct, None if money is None else money - value
                want[d, rank] = reason
        got = {(r.d, r.rank): r.reject_reason for r in risk.capped_greedy(sized, state, cfg).collect()}
        assert got == want
    assert risk.capped_greedy(sized.where("false"), state, risk.RiskConfig()).collect() == []
    with pytest.raises(Exception, match="no risk state"):
        risk.capped_greedy(sized, state.where("d > '2024-01-02'"), risk.RiskConfig()).collect()
