"""Open positions watching a stream of bars: first barrier touch or time exit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUTPUT = "pick_id long, exit_kind string, exit_day date, days_used int"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BAR = "day date, stop double, target double, high double, low double, factor double, cash double"
_COLUMNS = [c.split()[0] for c in _BAR.split(", ")]


class BarrierWatch(StatefulProcessor):
    """State per pick: how many days it has lived through, its bars that wait for an earlier one, its deadline.

    Input rows of a pick carry the trading day's number since the signal, the day, the levels, the bar, and
    the action factor and cash folded up to that day; a low at the stop wins over a high at the target
    on the same day. Days are taken in their order, whatever batch they come in: a bar waits for those
    before it. When the watermark has passed the pick's deadline, a missing day is not waited for any
    longer, and the pick leaves the state, finished or not; a pick that finished before leaves it then too,
    so that its later bars are known to be of no use until then.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "last_k int, done boolean, deadline long")
        self.waiting = handle.getMapState("waiting", "k int", _BAR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last_k, done, deadline = self.progress.get() if self.progress.exists() else (0, False, None)
        for part in rows:
            if deadline is None:
                deadline = int(pd.Timestamp(part["deadline"].max()).value // 10**6) + 1
                self.handle.registerTimer(deadline)
            if done:
                continue
            for k, *bar in part[["k", *_COLUMNS]].itertuples(index=False):
                if last_k < k <= self.horizon:
                    self.waiting.updateValue((int(k),), tuple(None if pd.isna(x) else x for x in bar))
        found = None
        while not done and found is None and self.waiting.containsKey((last_k + 1,)):
            last_k += 1
            found = self._exit(last_k)
        self._remember(key, last_k, done or found is not None, deadline)
        if found is not None:
            yield self._row(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The deadline has passed: take the days there are, and forget the pick."""
        _, done, _ = self.progress.get() if self.progress.exists() else (0, True, None)
        found = None
        if not done:
            for k in sorted(k for (k,) in self.waiting.keys()):
                found = self._exit(k)
                if found is not None:
                    break
        self.waiting.clear()
        self.progress.clear()
        if found is not None:
            yield self._row(key, found)

    def _exit(self, k: int) -> tuple | None:
        """(kind, day, days used) if the pick leaves on its ``k``-th day; the bar is taken off the waiting ones."""
        day, stop, target, high, low, factor, cash = self.waiting.getValue((k,))
        self.waiting.removeKey((k,))
        if low is not None and stop is not None and low <= (stop - cash) / factor:
            return "stop", day, k
        if high is not None and target is not None and high >= (target - cash) / factor:
            return "target", day, k
        return ("time", day, k) if k >= self.horizon else None

    def _remember(self, key, last_k: int, done: bool, deadline: int | None) -> None:
        if done:
            self.waiting.clear()
        self.progress.update((last_k, done, deadline))

    def _row(self, key, found: tuple) -> pd.DataFrame:
        return pd.DataFrame({"pick_id": [key[0]], "exit_kind": [found[0]], "exit_day": [found[1]], "days_used": [found[2]]})

    def close(self) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows of a finished query that came behind its watermark and were left out."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_barriers(pick_days: DataFrame, out: str, checkpoint: str, horizon: int, lateness: str = "5 days") -> StreamingQuery:
    """Watch a stream of (pick, trading day) rows, each with the pick's ``deadline``, the last day it can use.

    A bar more than ``lateness`` older than the newest bar of earlier batches is late: it is left out, and
    :func:`late_rows` of the returned query counts it.
    """
    from pyspark import cloudpickle

    import tideline.streaming.barriers as module
    from tideline.streaming.streams import run_available

    cloudpickle.register_pickle_by_value(module)
    spark, name = pick_days.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    timed = pick_days.withColumn("at", F.col("day").cast("timestamp")).withColumn("deadline", F.col("deadline").cast("timestamp")).withWatermark("at", lateness)
    exits = timed.groupBy("pick_id").transformWithStateInPandas(
        statefulProcessor=BarrierWatch(horizon), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    # a query takes the setting when it starts; the session keeps its own
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        return run_available(exits.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    finally:
        spark.conf.set(name, before)
