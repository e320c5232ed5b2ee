"""Keyed state of streams: how many insights are open, and consolidations that wait for approval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark import schema as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Let streams of ``spark`` keep their state in RocksDB, which state with timers and a time to live needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class OpenCount(StatefulProcessor):
    """Open insights of a scope: up with each new one, down as one is processed, looked at by a timer.

    State is the number and, so that repeated rows count once, the open ids. Every ``check_ms`` from the first row on the timer reports the
    number if it is at least ``least``; a scope without open insights has no timer.
    """

    def __init__(self, least: int, check_ms: int):
        self.least, self.check_ms = least, check_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id string", "seen boolean")
        self.count = handle.getValueState("count", "n long")

    def _now(self) -> int:
        return self.count.get()[0] if self.count.exists() else 0

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = n = self._now()
        for batch in rows:
            for id_, processed in zip(batch["id"], batch["processed"], strict=True):
                known = self.open.containsKey((id_,))
                if processed and known:
                    self.open.removeKey((id_,))
                    n -= 1
                elif not processed and not known:
                    self.open.updateValue((id_,), (True,))
                    n += 1
        self.count.update((n,))
        if n and not before:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.check_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        n = self._now()
        if n:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.check_ms)
        yield pd.DataFrame({"scope": [key[0]], "pending": [n]}) if n >= self.least else pd.DataFrame()

    def close(self) -> None:
        pass


def due(insights: DataFrame, least: int = S.PENDING_TRIGGER, check_ms: int = 5_000) -> DataFrame:
    """Stream of (scope, pending): every ``check_ms`` each scope with at least ``least`` open insights, from a stream (scope, id, processed).

    An insight comes once open and again, processed, when it is done. Run a salience cycle for what comes out. Rows of a scope are one key; a
    scope is an agent, so that no key holds a large share.
    """
    use_state(insights.sparkSession)
    keyed = insights.select("scope", "id", "processed").groupBy("scope")
    return keyed.transformWithStateInPandas(OpenCount(least, check_ms), "scope string, pending long", "append", "ProcessingTime")


class Waiting(StatefulProcessor):
    """One pending consolidation: kept with a time to live, handed out on approval, dropped when discarded."""

    FIELDS = "summary string, confidence double, source_ids array<bigint>, preserved_facts array<string>, uncertainties array<string>"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.FIELDS, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = [f.split(" ")[0] for f in self.FIELDS.split(", ")]
        for batch in rows:
            for row in batch.sort_values("seq").itertuples(index=False):
                if row.action == "add":
                    values = [getattr(row, n) for n in names]
                    self.held.update(tuple(list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for v in values))
                    continue
                if row.action == "approve" and self.held.exists():
                    yield pd.DataFrame([(key[0], *self.held.get())], columns=["pending_id", *names])
                self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def approved(requests: DataFrame, hours: float = S.PENDING_HOURS) -> DataFrame:
    """Stream of approved consolidations from a stream of (pending_id, seq, action, summary, confidence, source_ids, preserved_facts, uncertainties).

    action is add, approve or discard; the last two need no more than the id. What is neither approved nor discarded within ``hours`` is
    forgotten by the state's time to live, so its approval gives nothing. Requests of one batch go in the order of ``seq``.
    """
    use_state(requests.sparkSession)
    return requests.groupBy("pending_id").transformWithStateInPandas(Waiting(int(hours * 3_600_000)), f"pending_id string, {Waiting.FIELDS}", "append", "ProcessingTime")


def run_when_due(pending: DataFrame, action: Callable[[list[str]], object], checkpoint: str) -> StreamingQuery:
    """Call ``action`` with the scopes of each batch of ``due``, such as to run their salience cycles."""

    def batch(df: DataFrame, number: int) -> None:
        scopes = sorted(r.scope for r in df.select("scope").distinct().collect())
        if scopes:
            action(scopes)

    return pending.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
