"""Queries of many steps write them one after the other, so that no job's plan grows with their number."""

import datetime
from collections import Counter

import pytest

from tideline.operators import veto
from tideline.plans import load_queries
from tideline.plans.ranking_queries import ranked
from tideline.plans.veto_queries import hits
from tideline.plans.views import Tables

QUERIES = load_queries()[0]
# more tables than the largest single step reads, fewer than the steps of any of these queries read together
MOST_SCANS = 14


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of its own: twelve days, twenty codes, some rows twice and some without a code."""
    path = str(tmp_path_factory.mktemp("tables"))
    first = datetime.datetime(2024, 1, 1, 9)
    kinds = ("purchase", "error", "view", "click", "signup")
    events = [(i, first + datetime.timedelta(i % 12, i), i * 7 % 20 if i % 97 else None, kinds[i * 3 % 5 if i % 4 else i % 2], float(i % 50 + 1), f'{{"k": {i * 37 % 100}}}') for i in range(900)]
    orders = [(i, i % 25, "O", 100.0 + i, datetime.datetime(1995 + i % 5, 1 + i % 12, 3), "1-URGENT") for i in range(300)]
    customers = [(i, f"name{i}", i % 5, 1.0, "MACHINERY" if i % 6 == 0 else "BUILDING") for i in range(25)]
    documents = [(i, f"text {i % 17}", "en", f"src{i % 20}", 8) for i in range(60)]
    for name, rows, schema in (
        ("events", events + events[::90], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        ("customer", customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars int"),
        ("labels", [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def scans(spark, monkeypatch):
    """How many tables the plan of each written job reads."""
    kind, seen = type(spark.range(1)), []
    write = kind.write

    def counted(df):
        seen.append(leaves(df))
        return write.fget(df)

    monkeypatch.setattr(kind, "write", property(counted))
    return seen


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.fixture(scope="module")
def events(spark, folder):
    """Every veto event, from one plan."""
    t = Tables(spark, folder)
    found = veto.with_rank(hits(t), ranked(t), t.roster(), "M0").collect()
    assert {e.rule_id for e in found} == set(veto.RULES) - {"llm_material_news"} and any(e.rank for e in found) and not all(e.rank for e in found)
    return found


def in_steps(spark, folder, scans, name):
    """Rows of a query of which no job reads the tables of all steps."""
    result = QUERIES[name](spark, folder)
    assert max([*scans, leaves(result)]) <= MOST_SCANS, scans
    return Counter(map(tuple, result.collect()))


def test_veto_events_equal_those_of_one_plan(spark, folder, events, scans):
    assert in_steps(spark, folder, scans, "veto_events") == Counter((e.d, e.code, e.rule_id, e.rank, e.composite, e.market) for e in events)


def test_todays_vetoes_are_all_events_of_the_last_day(spark, folder, events, scans):
    last = max(e.d for e in events)
    assert in_steps(spark, folder, scans, "todays_vetoes") == Counter((e.d, e.code, e.rule_id, e.rank) for e in events if e.d == last)


def test_rank_distribution_counts_every_event(spark, folder, events, scans):
    counts = Counter((e.rule_id, e.rank and (e.rank - 1) // 10) for e in events)
    assert in_steps(spark, folder, scans, "veto_rank_distribution") == Counter((*k, n) for k, n in counts.items())


def test_audit_reports_every_rule_of_every_table(spark, folder, events, scans):
    found = {(r[0], r[1]): r[2:] for r in in_steps(spark, folder, scans, "constraint_audit_tables")}
    assert len(found) == 30 and len({table for table, _ in found}) == 6
    keys = Counter((e.d, e.code, e.rule_id) for e in events)
    assert found["vetoes", "unique_key"] == (len(events), len(events) - len(keys))
    assert found["vetoes", "evidence_not_blank"] == (len(events), sum(e.code % 9 == 0 for e in events))
