"""Structured Streaming: insights are scored and promoted in micro-batches; budgets are keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import schema as S
from tidemark.operators import salience


def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One process's hourly budget, as ``salience.budget`` counts it."""
    now = state.get if state.exists else (None, 0, 0)
    for b in batches:
        b = b.sort_values(["ts", "id"])
        modes = []
        for ts in b["ts"]:
            now, mode = salience.spend(now, int(ts.timestamp() * 1000))
            modes.append(mode)
        yield pd.DataFrame({"process": key[0], "id": b["id"].to_numpy(), "mode": modes})
    if now[0] is not None:
        state.update(now)


def budgeted(calls: DataFrame) -> DataFrame:
    """Stream of (process, id, mode) for a stream of calls (process, id, ts)."""
    return calls.groupBy("process").applyInPandasWithState(spend, "process string, id string, mode string", "start long, used long, hour long", "append", GroupStateTimeout.NoTimeout)


def compress_phases(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One conversation's context, as ``salience.phase_tokens`` counts it."""
    held, tokens, short = state.get if state.exists else (0, [], [])
    now = (held, list(zip(tokens, short, strict=True)))
    for b in batches:
        rows = []
        for seq, n, less, most in b.sort_values("seq")[["seq", "tokens", "short", "max_tokens"]].itertuples(index=False):
            now, done = salience.compress(now, int(n), int(less), int(most))
            rows.append((key[0], seq, now[0], done))
        yield pd.DataFrame(rows, columns=["conv_id", "seq", "held", "compressed"])
    state.update((now[0], [n for n, _ in now[1]], [n for _, n in now[1]]))


def compressed(phases: DataFrame) -> DataFrame:
    """Stream of (conv_id, seq, held, compressed) for a stream of phases (conv_id, seq, tokens, short, max_tokens), short being the tokens of the summary."""
    return phases.groupBy("conv_id").applyInPandasWithState(
        compress_phases, "conv_id long, seq long, held long, compressed boolean", "held long, tokens array<long>, short array<long>", "append", GroupStateTimeout.NoTimeout
    )


def run_salience(
    insights: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, related: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Score each micro-batch of ``insights`` with ``score`` (-> insight_id, raw) and hand its actions to ``sink``.

    ``related`` (open insights -> id, n) counts the memories that each insight is related to; without it none is. Without ``every`` it works off
    what is there and stops; otherwise it runs at that interval. ``sink`` gets the batch number, so that a repeated batch can overwrite its
    first attempt. ``Memory.run_salience`` is the cycle over a store, with budget, related lookup, writes and extraction.
    """

    def batch(df: DataFrame, number: int) -> None:
        open_ = df.where(~F.col("processed"))
        known = related(open_) if related else open_.select("id").limit(0).withColumn("n", F.lit(0))
        sink(salience.actions(open_, score(open_), known), number)

    writer = insights.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def schedule(spark: SparkSession, seconds: int, action: Callable[[], object], checkpoint: str) -> StreamingQuery | None:
    """Run ``action`` every ``seconds`` as a stream of clock ticks, one at a time, until the query is stopped; 0 seconds is no schedule."""
    if not seconds:
        return None
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, n: action() and None).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def log_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events (name, at, payload) to an event log that any reader may follow; a repeated batch is written once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
