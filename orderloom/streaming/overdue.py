"""Entries that wait too long: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

CREATED, SETTLED = "created", "settled"
OVERDUE = "id string, createdAt timestamp, settledAt timestamp, dueAt timestamp"


def _millis(times: pd.Series) -> int | None:
    least = times.min()
    return None if pd.isna(least) else int(least.timestamp() * 1000)


class Waiting(StatefulProcessor):
    """An entry's earliest creation and settling. A timer stands where it falls due, and another where it is forgotten: that is the state's time to live, since with event
    times Spark has none of its own. An entry is told once, whether by its timer or by a settling that came too late."""

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit, self.keep = limit_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created long, settled long, told boolean")

    def _told(self, key: tuple, created: int, settled: int | None) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms") if ms is not None else pd.NaT
        times = {n: pd.Series([at(v)], dtype="datetime64[ns]") for n, v in (("createdAt", created), ("settledAt", settled), ("dueAt", created + self.limit))}
        return pd.DataFrame({"id": pd.Series([key[0]], dtype=object)} | times)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        created, settled, told = self.entry.get() if self.entry.exists() else (None, None, False)
        before = created
        for chunk in rows:
            for kind in (CREATED, SETTLED):
                own = _millis(chunk.loc[chunk["kind"] == kind, "at"])
                if own is not None and kind == CREATED:
                    created = own if created is None else min(created, own)
                elif own is not None:
                    settled = own if settled is None else min(settled, own)
        late = created is not None and settled is not None and settled > created + self.limit
        if late and not told:
            told = True
            yield self._told(key, created, settled)
        self.entry.update((created, settled, told))
        if created is not None and created != before:
            self.handle.registerTimer(created + self.limit)
        self.handle.registerTimer((created if created is not None else settled) + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        created, settled, told = self.entry.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if created is not None and settled is None and not told and now >= created + self.limit:
            self.entry.update((created, settled, True))
            yield self._told(key, created, settled)
        if now >= (created if created is not None else settled) + self.keep:
            self.entry.clear()

    def close(self) -> None:
        pass


def overdue(events: DataFrame, limit: str, keep: str, late: str = "10 minutes") -> DataFrame:
    """A stream of (id, kind, at), kinds ``created`` and ``settled``: entries that aren't settled within ``limit`` of their creation, each
    once, also across restarts. ``keep`` says how long after its creation an entry is remembered, and must be longer.

    An entry that is never settled is told when the watermark passes the limit; one that is settled too late has its
    settling's time if that comes before. Settlings of unknown entries are remembered as long; rows without id or time count for nothing. State is kept in RocksDB, which
    the session must have as its state store.
    """
    spark = events.sparkSession
    spans = [spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP_SECONDS(0) + INTERVAL {x}) AS BIGINT)").first()[0] for x in (limit, keep)]
    if spans[1] <= spans[0]:
        raise ValueError(f"{keep} isn't longer than {limit}")
    rows = events.where(F.col("id").isNotNull() & F.col("at").isNotNull()).select("id", "kind", "at").withWatermark("at", late)
    return rows.groupBy("id").transformWithStateInPandas(Waiting(*spans), OVERDUE, "append", "eventtime")
