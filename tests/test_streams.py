"""Streams over several batches, each started anew from its checkpoint, with late rows."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideline.streaming import barriers, daily, streams
from tideline.streaming.store import PrefixStore

DAY0 = datetime.date(2024, 3, 1)


def day(n):
    return DAY0 + datetime.timedelta(n)


def at(d, hour):
    return datetime.datetime.combine(day(d), datetime.time(hour), datetime.timezone.utc)


def fed(spark, tmp_path, schema, batches, run):
    """Write each batch as files and drain the stream; what each start returns."""
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    out = []
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(folder)
        out.append(run(streams.stream_files(spark, folder, "*.parquet", df.schema, files_per_trigger=None), checkpoint))
    return out


def test_bars_on_time_and_late_make_all(spark, tmp_path):
    batches = [
        [(1, at(0, 9), 5.0), (1, at(0, 10), 7.0), (2, at(1, 3), 1.0)],
        [(1, at(0, 23), 4.0), (1, at(2, 8), 9.0), (2, at(1, 2), 2.0)],  # day 0 is still open for the first row
        [(1, at(0, 11), 100.0), (1, at(0, 12), 50.0), (2, at(2, 9), 3.0), (2, at(1, 1), 8.0), (3, at(9, 1), 6.0), (3, None, 6.0)],  # days 0 and 1 are closed
        [(1, at(2, 9), 1.0), (3, at(9, 2), 2.0)],
    ]
    days = daily.bar_days(spark, str(tmp_path / "bars"))
    fed(spark, tmp_path, "code long, ts timestamp, value double", batches, days.run)
    closed = {(r.code, r.d): tuple(r)[2:] for r in days.closed().collect()}
    assert closed == {(1, day(0)): (5.0, 7.0, 4.0, 4.0, 3), (2, day(1)): (2.0, 2.0, 1.0, 1.0, 2), (1, day(2)): (9.0, 9.0, 9.0, 9.0, 1), (2, day(2)): (3.0, 3.0, 3.0, 3.0, 1)}
    again = daily.bar_days(spark, str(tmp_path / "bars"))  # a later program reads the same
    assert {(r.code, r.d): r.vol for r in again.flush().collect()} == {(3, day(9)): 2}
    late = {(r.code, r.d): r.n for r in again.late().collect()}
    assert late == {(1, day(0)): 2, (2, day(1)): 1, (3, None): 1, (1, day(2)): 1}
    assert sum(r[-1] for r in closed.values()) + 2 + sum(late.values()) == sum(map(len, batches))


def test_health_counts_repeat_of_a_batch(spark, tmp_path):
    days = daily.health_days(spark, str(tmp_path / "health"))
    schema = "source_id string, status string, ts timestamp"
    first = spark.createDataFrame([("a", "ok", at(0, 1)), ("a", "ok", at(0, 2)), ("b", "drift", at(1, 7))], schema)
    for _ in range(2):  # the same batch twice, as after a failure before it was committed
        days._batch(first, 0)
    for _ in range(2):
        days._batch(spark.createDataFrame([("a", "ok", at(0, 5)), ("b", "ok", at(1, 9))], schema), 1)
    assert [tuple(r) for r in days.closed().collect()] == [(day(0), "a", "ok", 2)]
    assert sorted(tuple(r) for r in days.flush().collect()) == [(day(1), "b", "drift", 1), (day(1), "b", "ok", 1)]
    assert [tuple(r) for r in days.late().collect()] == [("a", day(0), 1)]


PICK = "pick_id long, k int, day date, deadline date, stop double, target double, high double, low double, factor double, cash double"


def bar(pick, k, high=10.0, low=9.0, start=0, horizon=4, stop=5.0, target=20.0):
    return (pick, k, day(start + k), day(start + horizon), stop, target, high, low, 1.0, 0.0)


def state_rows(spark, checkpoint):
    read = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "progress")
    return {r.key.pick_id for r in read.load().collect()}


def test_barriers_over_batches_with_late_bars(spark, tmp_path):
    out = str(tmp_path / "exits")
    batches = [
        # 1 waits for its second day, 2 is stopped at once, 3 has a gap, 4 is only begun
        [bar(1, 1), bar(1, 3, high=30.0), bar(2, 1, low=1.0), bar(3, 1), bar(3, 3, low=2.0), bar(4, 1)],
        [bar(1, 2, low=3.0, high=50.0), bar(2, 2, high=40.0), bar(5, 1, start=20), bar(5, 2, start=20)],
        # far beyond the deadlines of 1 to 4: the gap of 3 is closed, 4 has not lived to its horizon
        [bar(4, 2, high=99.0), bar(5, 3, start=20), bar(5, 4, start=20), bar(6, 1, start=60)],
        [bar(6, 2, start=60, high=25.0)],
    ]
    queries = fed(spark, tmp_path, PICK, batches, lambda rows, c: barriers.stream_barriers(rows, out, c, 4, lateness="5 days"))
    got = {r.pick_id: (r.exit_kind, r.exit_day, r.days_used) for r in spark.read.schema(barriers.OUTPUT).parquet(out).collect()}
    assert got == {1: ("stop", day(2), 2), 2: ("stop", day(1), 1), 3: ("stop", day(3), 3), 5: ("time", day(24), 4), 6: ("target", day(62), 2)}
    assert spark.read.schema(barriers.OUTPUT).parquet(out).count() == 5
    assert [barriers.late_rows(q) for q in queries] == [0, 0, 1, 0]  # the bar of 4 that came behind the watermark
    assert state_rows(spark, str(tmp_path / "checkpoint")) == {6}  # finished or not, the others have left


def test_store_reads_grow_with_the_batch_only(spark, tmp_path):
    store = PrefixStore(spark, str(tmp_path / "store"), ["k"], "k long, v long", rows_per_prefix=10, compact_every=4)
    reads, have = [], set()
    for n in range(14):
        keys = list(range(100 * n, 100 * n + 100)) if n < 10 else [7, 5000 + n]
        batch = spark.createDataFrame([(k, n) for k in keys], "k long, v long")
        store.begin(n)
        known = {r.k for r in store.lookup(batch, n).collect()}
        assert known & set(keys) == have & set(keys) and known <= have
        store.append(batch.where(~F.col("k").isin(list(known)) if known else F.lit(True)), n, batch)
        reads.append(store.read_by(n))
        have |= set(keys)
    assert sorted(r.k for r in store.rows().collect()) == sorted(have)
    # two keys meet two prefixes of some thousand rows' store, not the store
    assert max(reads[10:]) < 100 < len(have)
    # a batch repeated replaces itself, a new start sees the same
    store.append(spark.createDataFrame([(5013, 1)], "k long, v long"), 13)
    again = PrefixStore(spark, str(tmp_path / "store"), ["k"], "k long, v long")
    assert Counter(r.k for r in again.rows().collect()) == Counter(have)


def test_landing_last_wins_and_queue_over_batches(spark, tmp_path):
    store, ledger = streams.body_store(spark, str(tmp_path / "bodies"), rows_per_prefix=2, compact_every=1), str(tmp_path / "ledger")
    snaps = [[(1, "a", None, "x"), (2, "a", None, "x"), (3, "b", None, "y")], [(4, "b", None, "x"), (5, "a", None, "z")], [(6, "a", None, "z"), (7, "a", None, None)], [(8, "a", None, "w")]]
    fed(spark, tmp_path / "land", "id long, source_id string, data_as_of date, body string", snaps, lambda rows, c: streams.stream_land(rows, store, ledger, c))
    assert {r.id for r in spark.read.parquet(ledger).where("written").collect()} >= {1, 3, 5, 8}
    assert not {r.id for r in spark.read.parquet(ledger).where("written").collect()} & {2, 4, 6}
    assert sorted(r.body for r in store.rows().where("body is not null").collect()) == ["w", "x", "y", "z"]

    state = streams.effective_store(spark, str(tmp_path / "state"), rows_per_prefix=2, compact_every=1)
    records = [[(day(0), "1", at(0, 5), 1, "buy", 1, 1.0), (day(0), None, at(0, 5), 2, "note", None, None)], [(day(0), "1", at(0, 3), 3, "sell", 1, 1.0)],
               [(day(0), "1", at(0, 9), 4, "hold", None, None), (day(0), None, at(0, 7), 5, "note", None, None), (day(1), "1", at(1, 1), 6, "buy", 2, 2.0)], [(day(1), "1", at(1, 1), 7, "sell", 2, 2.0)]]
    fed(spark, tmp_path / "wins", streams.EFFECTIVE, records, lambda rows, c: streams.stream_last_wins(rows, state, c))
    assert sorted((r.d, str(r.code), r.message_id) for r in state.rows().collect()) == [(day(0), "1", 4), (day(0), "None", 5), (day(1), "1", 7)]

    queue = streams.queue_store(spark, str(tmp_path / "queue"), compact_every=1)
    judged = spark.createDataFrame([(2,)], "task_key long")
    fed(spark, tmp_path / "items", "task_key long, code string", [[(1, "a"), (2, "a"), (1, "a")], [(1, "a"), (3, "b")], [(4, "c"), (3, "b"), (2, "a")]], lambda rows, c: streams.stream_queue(rows, judged, queue, c))
    assert sorted(r.task_key for r in queue.rows().collect()) == [1, 3, 4]


def test_resent_messages_are_recorded_once(spark, tmp_path):
    out = str(tmp_path / "records")
    message = lambda i, h, text: (i, at(0, h), 1, text)
    fed(spark, tmp_path, "message_id long, sent_at timestamp, sender long, text string",
        [[message(1, 1, "/rec 備註 one"), message(1, 1, "/rec 備註 one")], [message(1, 1, "/rec 備註 one"), message(2, 1, "/rec 備註 two")]],
        lambda rows, c: streams.stream_records(rows, out, c))
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == [1, 2]


@pytest.mark.parametrize("n", [0])
def test_empty_first_batch(spark, tmp_path, n):
    days = daily.bar_days(spark, str(tmp_path / "bars"))
    empty = spark.createDataFrame([], "code long, ts timestamp, value double")
    days._batch(empty, n)
    assert days.closed().count() == 0 and days.late().count() == 0
