"""The whole daily chain against a plain loop, and terms and limits with effective dates."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.operators import chain, cost, risk
from tideline.sources import ledger

DAY0 = datetime.date(2024, 5, 1)


def day(n):
    return DAY0 + datetime.timedelta(n)


def test_chain_equals_a_loop_over_days(spark):
    rng = random.Random(2)
    codes = list(range(1, 31))
    ranked, bars, sigmas = [], [], []
    for d in range(4):
        order = rng.sample(codes, 25)
        for rank, c in enumerate(order, 1):
            ranked.append((day(d), c, rank, round(1 - rank / 100, 6)))
            bars.append((day(d), c, 10.0 + c))
            if c % 6:
                sigmas.append((day(d), c, 0.01 + c / 2000))
    hits = [[(d, c, rule, "why", "proof") for d, c, r, _ in ranked if rng.random() < 0.15] for rule in ("attention", "disposition")]
    tasks = [(i, i, day(rng.randrange(4)), rng.choice(codes), "s", f"e{i}") for i in range(60)]
    verdicts = [(i, rng.choice(["veto", "no_veto"])) for i in range(0, 60, 2)]
    roster = [(c, "M0") for c in codes if c != 7]
    config = risk.RiskConfig(equity=1_000_000.0, max_concurrent=4, monthly_entry_cap=5, max_total_exposure_pct=100.0)
    states = [(day(d), d, 0, 0.0, 20.0 if d == 3 else 0.0) for d in range(4)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    r = frame(ranked, "d date, code long, rank long, composite double")
    hit_kind = "d date, code long, rule_id string, reason string, evidence string"
    made = chain.daily_chain(
        r, frame(bars, "d date, code long, close double"), [frame(h, hit_kind) for h in hits],
        frame(tasks, "task_key long, task_pos long, d date, code long, subject string, evidence string"), frame(verdicts, "task_key long, verdict string"),
        frame(sigmas, "d date, code long, sigma double"), frame(states, "d date, entries int, open_positions int, exposure_pct double, drawdown_pct double"),
        frame(roster, "code long, market string"), config, market="MX")

    by_rules = {(d, c) for rows in hits for d, c, *_ in rows}
    said = {k for k, v in verdicts if v == "veto"}
    first = {}
    for key, _, d, c, *_ in tasks:
        if key in said and (d, c) not in by_rules and any((x[0], x[1]) == (d, c) for x in ranked):
            first.setdefault((d, c), key)
    everybody = {(d, c) for d, c, *_ in ranked}
    passed = everybody - by_rules - set(first)
    assert {(x.d, x.code) for x in made.passed.collect()} == passed and made.passed.count() == len(passed)
    found = made.hits.collect()
    assert {(x.d, x.code) for x in found if x.layer == chain.TEXT} == set(first) and sum(x.layer == chain.RULES for x in found) == sum(map(len, hits))
    assert {(x.d, x.code, x.evidence) for x in found if x.layer == chain.TEXT} == {(d, c, f"e{k}") for (d, c), k in first.items()}

    # the limits, by the sizes that the library gives each candidate alone
    prices = {(d, c): x for d, c, x in bars}
    vols = {(d, c): x for d, c, x in sigmas}
    alone = spark.createDataFrame([(d, c, k, prices[d, c], vols.get((d, c))) for d, c, k, _ in ranked], "d date, code long, rank long, entry double, sigma double")
    size = {(x.d, x.code): x for x in risk.size_candidates(alone, config).collect()}
    approved = defaultdict(list)
    for d, entries, open_, exposure, drawdown in states:
        for _, c, k, _ in sorted((x for x in ranked if x[0] == d and (d, x[1]) in passed), key=lambda x: x[2]):
            one = size[d, c]
            if drawdown >= config.circuit_breaker_pct or entries >= config.monthly_entry_cap or open_ >= config.max_concurrent or one.own_reason or exposure + one.position_pct > config.max_total_exposure_pct:
                continue
            entries, open_, exposure = entries + 1, open_ + 1, exposure + one.position_pct
            approved[d].append(c)
    assert not approved[day(3)] and all(approved[day(d)] for d in range(3))
    picks = made.picks.collect()
    assert {(x.d, x.code) for x in picks if x.list_kind == "trade_signal"} == {(d, c) for d, cs in approved.items() for c in cs}
    assert {(x.d, x.code) for x in picks if x.list_kind == "watchlist"} == {(d, c) for d, c, k, _ in ranked if k <= 5}
    assert all(x.stop_price < x.entry_price < x.target_price and x.shares > 0 for x in picks if x.list_kind == "trade_signal")
    events = made.veto_events.collect()
    assert len(events) == len(found) and {x.market for x in events if x.code == 7} <= {"MX"} and all(x.rank is not None for x in events)


def test_terms_in_force_on_the_day(spark):
    terms = spark.createDataFrame([("a", day(0), 1425, 10_000, 20, 3000, 1500), ("a", day(10), 1425, 5000, 1, 2000, 1500)], cost.TERMS)
    trades = spark.createDataFrame([(i, "a", day(i), 10_000, 11_000, 1000) for i in (0, 9, 10, 50)], "id long, terms string, d date, entry_cents long, exit_cents long, shares long")
    got = {r.id: (r.buy_fee, r.sell_fee, r.tax) for r in cost.scheduled_round_trip(trades, terms).collect()}
    old, new = (142, 156, 330), (71, 78, 220)
    assert got == {0: old, 9: old, 10: new, 50: new}
    # the same figures as the fixed terms give
    fixed = {r.id: (r.buy_fee, r.sell_fee, r.tax) for r in cost.round_trip(trades.where("id < 10")).collect()}
    assert fixed == {0: old, 9: old}
    with pytest.raises(Exception, match="no terms for a on 2024-04-30"):
        cost.scheduled_round_trip(trades.withColumn("d", F.lit(day(-1))), terms).collect()
    with pytest.raises(Exception, match="legal range"):
        cost.scheduled_round_trip(trades, terms.withColumn("commission_ppm", F.lit(1426))).collect()


def test_days_before_the_first_limits_are_an_error(spark):
    rows = spark.createDataFrame([(day(0), 1, 1, 50.0, 0.02), (day(5), 1, 1, 50.0, 0.02)], "d date, code long, rank long, entry double, sigma double")
    state = spark.createDataFrame([(day(0), 0, 0, 0.0, 0.0), (day(5), 0, 0, 0.0, 0.0)], "d date, entries int, open_positions int, exposure_pct double, drawdown_pct double")
    table = spark.createDataFrame([(day(3), "v2", 0), (day(0), "v1", 3)], "effective_from date, version string, max_concurrent int")
    got = {r.d: (r.version, r.reject_reason) for r in risk.approvals_by_version(rows, state, risk.load_configs(table)).collect()}
    assert got == {day(0): ("v1", None), day(5): ("v2", "concurrent_position_cap")}
    with pytest.raises(Exception, match="no limits in force"):
        risk.approvals_by_version(rows, state, risk.load_configs(table.where("version = 'v2'"))).collect()
    with pytest.raises(ValueError, match="no version"):
        risk.approvals_by_version(rows, state, [])


def test_ledger_rows_are_only_added(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, "a"), (1, "a")], "id long, state string")
    ledger.append_ledger(rows, path)
    ledger.append_ledger(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 3
