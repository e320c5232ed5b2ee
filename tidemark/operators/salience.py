"""From short-term insights to records: batches, budgets, promotion and bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X
from tidemark.operators.graph import cut
from tidemark.sources.store import number_rows

HOUR_MS = 3_600_000


def select_batch(insights: DataFrame, failures: DataFrame | None = None, size: int = S.BATCH_SIZE) -> DataFrame:
    """The oldest ``size`` insights that are open, not skipped for good and failed less than three times; ``failures`` are (id, failures)."""
    ready = insights.where(~F.col("processed") & ~F.array_contains("tags", "permanently_skipped"))
    if failures is not None:
        ready = ready.join(failures.where(F.col("failures") >= S.MAX_FAILURES).select("id"), "id", "left_anti")
    return ready.orderBy("ts", "id").limit(size)


def retried(score: Callable[[DataFrame], DataFrame], times: int = S.SCORE_ATTEMPTS) -> Callable[[DataFrame], DataFrame]:
    """A scorer that asks ``score`` (id, prompt -> insight_id, raw) again for what it gave no answer to, ``times`` in all: (insight_id, raw, attempts)."""

    def ask(asked: DataFrame) -> DataFrame:
        open_, done = asked, None
        for attempt in range(1, times + 1):
            got = cut(open_.select("id").join(score(open_).select(F.col("insight_id").alias("id"), "raw"), "id", "left"))
            answered = got.where(F.col("raw").isNotNull() | F.lit(attempt == times)).select(F.col("id").alias("insight_id"), "raw", F.lit(attempt).alias("attempts"))
            done = answered if done is None else done.unionByName(answered)
            open_ = open_.join(got.where("raw is null").select("id"), "id", "left_semi")
        return done

    return ask


def actions(insights: DataFrame, scores: DataFrame, related: DataFrame) -> DataFrame:
    """What each scored insight leads to: (id, action, tier, importance, stability, target_id, edge_type, tags, entities).

    A relate without a target is an insert. An insert of high importance without related records (``related``: id, n) becomes semantic.
    """
    s = X.parse_score(F.col("raw"))
    joined = insights.join(scores.withColumnRenamed("insight_id", "id"), "id").join(related, "id", "left").withColumn("s", s)
    action = F.when((F.col("s.action") == "relate") & F.col("s.target_id").isNull(), "insert").otherwise(F.col("s.action"))
    alone = (action == "insert") & (F.col("s.importance") >= S.PROMOTION_IMPORTANCE) & (F.coalesce("n", F.lit(0)) == 0)
    related_to = action == "relate"
    return joined.select(
        "id", action.alias("action"), F.when(alone, "semantic").otherwise("episodic").alias("tier"), F.col("s.importance").alias("importance"),
        X.initial_stability(F.col("s.importance")).alias("stability"), F.when(related_to, F.col("s.target_id").try_cast("bigint")).alias("target_id"),
        F.when(related_to, F.coalesce("s.edge_type", F.lit("elaborates"))).alias("edge_type"), X.external_tags(F.col("tags")).alias("tags"), F.col("s.entities").alias("entities"),
    )


def spend(state: tuple[int | None, int, int], ms: int) -> tuple[tuple[int | None, int, int], str]:
    """One call at ``ms`` milliseconds: the new (start of the hour, calls in it, number of the hour from 0) and the call's mode.

    An hour starts at the first call after the one before has ended.
    """
    start, used, hour = state
    if start is None or ms - start >= HOUR_MS:
        start, used, hour = ms, 0, hour + (start is not None)
    used += 1
    return (start, used, hour), "limited" if used > S.HOURLY_CALLS else "low_cost" if used > S.LOW_COST_CALLS else "normal"


def related(results: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (id, related array of (id, data)): of recall ``results`` for ``asked`` (query_id, id, mode) the first ones, fewer in low-cost mode."""
    most = F.when(F.col("mode") == "low_cost", S.RELATED_LOW_COST).otherwise(S.RELATED_ROWS)
    near = results.select("query_id", "position", "id", "data").join(asked.select("query_id", F.col("id").alias("insight_id"), "mode"), "query_id").where(F.col("position") <= most)
    listed = near.groupBy("insight_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "data"))).alias("l"))
    return listed.select(F.col("insight_id").alias("id"), F.transform("l", lambda r: F.struct(r["id"].alias("id"), r["data"].alias("data"))).alias("related"))


def hour_starts(calls: DataFrame) -> DataFrame:
    """Rows (process, start, hour) of calls (process, ms): the calls at which a process's hours begin, numbered from 0.

    An hour begins at the first call, and then at the first call an hour or more after the last beginning. Each call points to the first one at
    least an hour later. Calls lie in slots of an hour, so that one is in the next slot, or is the first of a later one: no window is larger than
    a slot. From the first call on the chain of pointers is found by doubling: what is marked jumps, and every pointer then reaches twice as
    far, so a chain of n hours takes the logarithm of n rounds, each a join and a written table.
    """
    slot = lambda ms: F.floor(F.col(ms) / HOUR_MS)
    at = cut(calls.select("process", "ms").distinct().withColumn("slot", slot("ms")))
    firsts = at.groupBy("process", "slot").agg(F.min("ms").alias("first"))
    later = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("process").orderBy("slot")))
    firsts = later.withColumn("next_slot", F.lead("slot").over(Window.partitionBy("process").orderBy("slot")))  # a row an hour
    # A call and the probe of another, an hour after it, lie in one slot; a probe takes the first call from it on.
    probes = at.select("process", F.col("ms").alias("from"), (F.col("ms") + HOUR_MS).alias("ms"), (F.col("slot") + 1).alias("slot"), F.lit(True).alias("probe"))
    both = at.select("process", F.lit(None).cast("long").alias("from"), "ms", "slot", F.lit(False).alias("probe")).unionByName(probes)
    onward = Window.partitionBy("process", "slot").orderBy(F.col("ms").desc(), "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("to", F.min(F.when(~F.col("probe"), F.col("ms"))).over(onward)).where("probe")
    of = firsts.select("process", F.col("slot").alias("own"), "later", "next_slot")
    jumps = found.join(of, (found["process"] == of["process"]) & (found["slot"] == of["own"] + 1)).select(found["process"], "from", "slot", "to", "later", "next_slot")
    # The next slot with calls may be the probe's own, in which all were too early: then it is the first of the one after.
    after = firsts.select("process", F.col("slot").alias("s"), F.col("later").alias("beyond"))
    jumps = jumps.join(after, (jumps["process"] == after["process"]) & (jumps["slot"] == after["s"]), "left").select(
        jumps["process"], "from", F.coalesce("to", F.when(F.col("next_slot") == F.col("slot"), F.col("beyond")).otherwise(F.col("later"))).alias("to")
    )
    jumps = cut(jumps.where("to is not null"))
    marked = cut(at.groupBy("process").agg(F.min("ms").alias("start")))
    while not jumps.isEmpty():
        reached = marked.join(jumps.withColumnRenamed("from", "start"), ["process", "start"]).select("process", F.col("to").alias("start"))
        marked = cut(marked.unionByName(reached).distinct())
        twice = jumps.join(jumps.select("process", F.col("from").alias("to"), F.col("to").alias("far")), ["process", "to"])
        jumps = cut(twice.select("process", "from", F.col("far").alias("to")))
    return marked.withColumn("hour", F.row_number().over(Window.partitionBy("process").orderBy("start")).cast("long") - 1)  # a row an hour


def budget(calls: DataFrame) -> DataFrame:
    """Rows (id, process, hour, call, mode) of calls (id, process, ts): the number of the call in its hour, and whether it is low-cost or over the limit.

    Hours come from ``hour_starts``. A call's number is that of its second in the hour, from counts by second, and its own in the second, so
    neither a process nor an hour has to lie in one task. A null time has no hour, call or mode.
    """
    timed = cut(calls.select("process", "id", F.unix_millis("ts").alias("ms")))
    starts = cut(hour_starts(timed.where("ms is not null")))
    slot = lambda ms: F.floor(ms / HOUR_MS)
    # At most one hour begins in a slot, so a call is in that one or in the last that began in an earlier slot.
    begun = starts.select("process", slot(F.col("start")).alias("slot"), "start", "hour")
    slots = timed.select("process", slot(F.col("ms")).alias("slot")).distinct().join(begun, ["process", "slot"], "left")
    before = Window.partitionBy("process").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("last", F.max(F.struct("start", "hour")).over(before))  # a row an hour
    placed = timed.withColumn("slot", slot(F.col("ms"))).join(slots, ["process", "slot"], "left")
    here = F.col("start").isNotNull() & (F.col("ms") >= F.col("start"))
    placed = placed.select("process", "id", "ms", F.when(here, F.struct("start", "hour")).otherwise(F.col("last")).alias("h")).select("process", "id", "ms", "h.start", "h.hour")
    placed = cut(placed.withColumn("second", F.floor((F.col("ms") - F.col("start")) / 1000)))
    sizes = placed.groupBy("process", "hour", "second").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("process", "hour").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("process", "hour", "second", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # at most 3,600 rows an hour
    own = F.row_number().over(Window.partitionBy("process", "hour", "second").orderBy("ms", "id"))
    numbered = placed.where("ms is not null").withColumn("own", own).join(offsets, ["process", "hour", "second"])
    call = F.col("own") + F.col("before")
    mode = F.when(call > S.HOURLY_CALLS, "limited").when(call > S.LOW_COST_CALLS, "low_cost").otherwise("normal")
    none = placed.where("ms is null").select("id", "process", F.lit(None).cast("long").alias("hour"), F.lit(None).cast("long").alias("call"), F.lit(None).cast("string").alias("mode"))
    return numbered.select("id", "process", "hour", call.cast("long").alias("call"), mode.alias("mode")).unionByName(none)


def promoted(acted: DataFrame, insights: DataFrame, as_of: Column, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(records, edges) that ``actions`` lead to: a record for each insert and relate, with what it came from as metadata, and an edge for each relate.

    Records take ids from ``next_id`` in the order of the insights' ids; an edge to a record that does not exist is left to the caller to drop.
    """
    new = acted.where("action in ('insert', 'relate')").join(insights.select("id", "summary"), "id")
    new = number_rows(new.withColumnRenamed("id", "insight_id"), "insight_id", next_id - 1).withColumnsRenamed({"id": "record_id", "insight_id": "id"})
    metadata = F.to_json(F.struct(F.lit("salience").alias("source"), F.col("id").alias("insightId"), "tags", "entities"))
    records = new.select(
        F.col("record_id").alias("id"), F.col("summary").alias("data"), metadata.alias("metadata"), "tier", "importance", "stability", as_of.alias("last_accessed_at"), F.lit(0).alias("access_count"),
        as_of.alias("created_at"), F.lit(False).alias("tombstoned"), F.lit(None).cast("timestamp").alias("tombstoned_at"), F.col("summary").alias("episode_summary"),
    )
    edges = new.where("action = 'relate' and target_id is not null")
    return records, edges.select(F.col("record_id").alias("from_id"), F.col("target_id").alias("to_id"), F.col("edge_type").alias("type"), "stability")


def tags_after(tags: Column, outcome: Column) -> Column:
    """Tags of an insight after a cycle with ``outcome`` limited, failed or done: limited and failed add theirs, a third failure one more; done drops the mark of the limit."""
    failures = F.size(F.filter(tags, lambda t: t == S.FAILED_TAG)) + 1
    none = F.array().cast("array<string>")
    failed = F.concat(tags, F.array(F.lit(S.FAILED_TAG)), F.when(failures >= S.MAX_FAILURES, F.array(F.lit("permanently_skipped"))).otherwise(none))
    return F.when(outcome == "limited", F.array_append(tags, "llm_rate_limited")).when(outcome == "failed", failed).when(outcome == "done", F.array_remove(tags, "llm_rate_limited")).otherwise(tags)


def failure_tags(attempts: DataFrame) -> DataFrame:
    """Rows (id, failures, tags) after failed attempts (id, failed): one tag from the first failure, a second one from the third on."""
    n = attempts.groupBy("id").agg(F.count_if(F.col("failed")).alias("failures"))
    tags = F.array_compact(F.array(F.when(F.col("failures") >= 1, S.FAILED_TAG), F.when(F.col("failures") >= S.MAX_FAILURES, "permanently_skipped")))
    return n.select("id", "failures", tags.alias("tags"))


def mark_processed(insights: DataFrame, done: DataFrame) -> DataFrame:
    """``insights`` with those in ``done`` (id) processed; unknown ids are ignored."""
    hit = done.select("id", F.lit(True).alias("_done")).distinct()
    return insights.join(hit, "id", "left").withColumn("processed", F.col("processed") | F.coalesce("_done", F.lit(False))).drop("_done")


def stm_stats(insights: DataFrame, as_of: Column) -> DataFrame:
    """One row: open insights, and their mean and largest age in milliseconds (0 if none)."""
    age = (F.unix_micros(as_of) - F.unix_micros("ts")) / F.lit(1000.0)
    zero = F.lit(0.0)
    return insights.where(~F.col("processed")).agg(F.count("*").alias("pending"), F.coalesce(F.avg(age), zero).alias("avg_age_ms"), F.coalesce(F.max(age), zero).alias("max_age_ms"))


def cycle_counters(events: DataFrame) -> DataFrame:
    """Sums over cycle-end events (processed, failures, llm_calls), with the estimate of tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return events.agg(F.count("*").alias("cycles"), total("processed").alias("processed"), total("failures").alias("failures"), total("llm_calls").alias("llm_calls"), (total("llm_calls") * S.TOKENS_PER_CALL).alias("estimated_tokens"))


def compress(state: tuple[int, list[tuple[int, int]]], tokens: int, short: int, most: int) -> tuple[tuple[int, list[tuple[int, int]]], bool]:
    """One more phase: the new (tokens held, whole phases as pairs of tokens and tokens of their summary) and whether a phase was compressed.

    If the tokens reach the share of ``most``, the oldest whole phase, which may be the new one, gives way to its summary; one at a time.
    """
    held, whole = state[0] + tokens, [*state[1], (tokens, short)]
    full = held / most >= S.COMPRESSION_RATIO
    if full:
        (old, new), whole = whole[0], whole[1:]
        held += new - old
    return (held, whole), full


def sized_phases(phases: DataFrame, summary: Column) -> DataFrame:
    """Rows (conv_id, seq, tokens, short): tokens of each phase and of its ``summary``."""
    size = X.tokens(X.render_phase(F.col("tool_call"), F.col("tool_result"), F.col("agent_reaction")))
    return phases.select("conv_id", "seq", size.cast("bigint").alias("tokens"), X.tokens(summary).cast("bigint").alias("short"))


def phase_tokens(phases: DataFrame, summary: Column, max_tokens: int) -> DataFrame:
    """Rows (conv_id, seq, tokens, held, compressed): after each phase, the tokens held in its conversation and whether a phase was compressed.

    Conversations are scanned in order; a task holds one conversation's whole phases as numbers.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, (0, [])
        for b in batches:
            rows = []
            for c, seq, tokens, short in zip(b["conv_id"], b["seq"], b["tokens"], b["short"], strict=True):
                if c != conv:
                    conv, state = c, (0, [])
                state, done = compress(state, tokens, short, max_tokens)
                rows.append((c, seq, tokens, state[0], done))
            yield pd.DataFrame(rows, columns=["conv_id", "seq", "tokens", "held", "compressed"])

    sized = sized_phases(phases, summary).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "tokens", "short")
    return sized.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInPandas(scan, "conv_id long, seq long, tokens long, held long, compressed boolean")


def purge_pending(pending: DataFrame, as_of: Column, hours: float = S.PENDING_HOURS) -> DataFrame:
    """Pending consolidations that are not older than ``hours``."""
    return pending.where(F.unix_micros(as_of) - F.unix_micros("created_at") <= F.lit(int(hours * 3_600_000_000)))
