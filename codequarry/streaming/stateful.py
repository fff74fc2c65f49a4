"""Stateful streams: health alerts with a cooldown, debouncing, selector subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import grade
from ..operators.metrics import alerts

_RANK = {"A": 0, "B": 1, "C": 2, "D": 3, "F": 4}
ALERTS = "file string, id bigint, previous string, grade string, at double"


def due(previous: str | None, now: str, threshold: str) -> bool:
    """Whether a reading calls for an alert: see ``metrics.alerts``."""
    bad, a = _RANK[threshold], _RANK[now]
    if previous is None:
        return a >= bad
    b = _RANK[previous]
    return a > b and (a >= bad or b >= bad or a - b >= 2)


def step(state: tuple[str | None, float | None], readings: pd.DataFrame, threshold: str, cooldown_s: float) -> tuple[tuple[str | None, float | None], list[dict]]:
    """One file's readings in order: the state after them and the alerts that the cooldown lets pass."""
    previous, last = state
    out = []
    for r in readings.sort_values(["at", "id"]).itertuples():
        if due(previous, r.grade, threshold) and (last is None or r.at - last >= cooldown_s):
            out.append({"file": r.file, "id": r.id, "previous": previous, "grade": r.grade, "at": r.at})
            last = r.at
        previous = r.grade
    return (previous, last), out


def readings(health: DataFrame) -> DataFrame:
    return health.select("file", "id", grade(F.col("total")).alias("grade"), F.col("ts").cast("timestamp").cast("double").alias("at"))


def alerts_with_cooldown(health: DataFrame, threshold: str = "D", cooldown_s: float = 3600) -> DataFrame:
    """Batch twin of ``alert_stream``.

    A window finds the readings that call for an alert; only these go through
    the greedy scan of their file.
    """
    due_ = alerts(health, threshold, "ts").select("file", "id", "previous", "grade", F.col("ts").cast("timestamp").cast("double").alias("at"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        keep, last = [], None
        for at in pdf["at"]:
            keep.append(last is None or at - last >= cooldown_s)
            last = at if keep[-1] else last
        return pdf[keep]

    return due_.groupBy("file").applyInPandas(run, ALERTS)


def alert_stream(health: DataFrame, threshold: str = "D", cooldown_s: float = 3600) -> DataFrame:
    """Alerts of a stream of readings; a file's state is its last grade and the time of its last alert."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (None, None)
        after, out = step((before[0] or None, before[1]), pd.concat(list(parts)), threshold, cooldown_s)
        state.update(after)
        yield pd.DataFrame(out, columns=["file", "id", "previous", "grade", "at"])

    return readings(health).groupBy("file").applyInPandasWithState(run, ALERTS, "grade string, last double", "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, gap_s: int) -> DataFrame:
    """(user_id, events, first, last): runs of a user's events with gaps of ``gap_s`` at most."""
    at = F.col("ts").cast("timestamp")
    # A session ends one gap after its last event; the bound itself still belongs to it.
    e = events.withColumn("at", at).groupBy("user_id", F.session_window("at", f"{gap_s * 1_000_000 + 1} microseconds").alias("w"))
    g = e.agg(F.count("*").alias("events"), F.min("at").alias("a"), F.max("at").alias("b"))
    return g.select("user_id", "events", F.unix_timestamp("a").alias("first"), F.unix_timestamp("b").alias("last"))


class Subscriptions:
    """Snapshots of selections by (session, selector); ``push`` reports what came and went since the last one."""

    def __init__(self, evaluate: Callable[[str], DataFrame], min_interval_s: float = 0.0):
        self.evaluate, self.min_interval_s = evaluate, min_interval_s
        self._last: dict[tuple[str, str], tuple[float, DataFrame]] = {}

    def subscribe(self, session: str, selector: str, now: float) -> None:
        self._last[session, selector] = (now, self._snapshot(selector))

    def unsubscribe(self, session: str, selector: str) -> bool:
        return self._last.pop((session, selector), None) is not None

    def _snapshot(self, selector: str) -> DataFrame:
        from ..storage import cut

        return cut(self.evaluate(selector).select("name", "file", "line"))

    def push(self, now: float) -> dict[tuple[str, str], DataFrame]:
        """Changes of the subscriptions whose interval has passed; silent ones are left out."""
        from ..operators.sets import delta

        out = {}
        for key, (at, old) in list(self._last.items()):
            if now - at < self.min_interval_s:
                continue
            new = self._snapshot(key[1])
            change = delta(old, new)
            if not change.isEmpty():
                out[key] = change
            self._last[key] = (now, new)
        return out


def notify(target: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that hands each alert to ``target``; a batch's alerts are streamed to the driver."""

    def write(batch: DataFrame, epoch: int) -> None:
        for row in batch.toLocalIterator():
            target(row.asDict() | {"epoch": epoch})

    return write
