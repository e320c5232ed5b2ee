"""Requests as a stream of JSON lines: each batch goes to the memory by type, and the answers to a folder of JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.filters import RecallOptions
from tidemark.plans.memory import Memory
from tidemark.sources import text


class Router:
    """Answers a table of requests (id, type, payload) with one of (id, ok, result, error), result as JSON.

    Requests that carry data, however many, are handled as one table per type. The others steer the memory or read it whole; equal ones
    are handled once, and a request that fails gets its error while the others go on. What is logged, inserted or imported in a batch is
    seen by its recalls and by what comes after. ``clock`` gives the time of a batch.
    """

    def __init__(
        self, memory: Memory, clock: Callable[[], datetime], extract: Callable[[Column], Column], score: Callable[[DataFrame], DataFrame], summarise: Callable[[DataFrame], DataFrame], folder: str | None = None
    ):
        self.memory, self.clock, self.extract, self.score, self.summarise, self.folder = memory, clock, extract, score, summarise, folder
        self.spark = memory.spark

    def answer(self, requests: DataFrame) -> DataFrame:
        """Answers to all of ``requests``; ids that come twice are answered twice."""
        now, out = self.clock(), None
        there = {r.type for r in requests.select("type").distinct().collect()}
        whole = {"logInsight": self._log, "insertMemory": self._insert, "importText": self._import, "recall": self._recall}
        each = {"getContext": self._context, "getStats": self._stats, "getRecent": self._recent, "consolidate": self._consolidate, "fork": self._fork}
        order = [t for t in (*whole, *each) if t in there]
        for kind in order:
            some = requests.where(F.col("type") == kind).select("id", "payload")
            try:
                got = whole[kind](some, now) if kind in whole else self._one_by_one(some, each[kind], now)
            except Exception as e:  # the answer to these requests, whatever went wrong with them
                got = some.select("id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("result"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
            out = got if out is None else out.unionByName(got)
        return out if out is not None else self.spark.createDataFrame([], "id string, ok boolean, result string, error string")

    @staticmethod
    def _done(rows: DataFrame, result: Column) -> DataFrame:
        return rows.select("id", F.lit(True).alias("ok"), result.cast("string").alias("result"), F.lit(None).cast("string").alias("error"))

    def _one_by_one(self, requests: DataFrame, action: Callable[[dict, datetime], object], now: datetime) -> DataFrame:
        rows = []
        for r in requests.select(F.coalesce("payload", F.lit("{}")).alias("payload")).distinct().toLocalIterator():
            try:
                rows.append((r.payload, True, json.dumps(action(json.loads(r.payload), now), default=str), None))
            except Exception as e:  # this request's answer
                rows.append((r.payload, False, None, f"{type(e).__name__}: {e}"[:500]))
        told = self.spark.createDataFrame(rows, "payload string, ok boolean, result string, error string")
        return requests.withColumn("payload", F.coalesce("payload", F.lit("{}"))).join(told, "payload").select("id", "ok", "result", "error")

    def _log(self, requests: DataFrame, now: datetime) -> DataFrame:
        schema = "summary string, contextFile string, tags array<string>"
        p = requests.select("id", F.from_json("payload", schema).alias("p"))
        rows = p.where("p.summary is not null").select("id", "p.summary", F.col("p.contextFile").alias("context_file"), F.coalesce("p.tags", F.array().cast("array<string>")).alias("tags"))
        self.memory.log_insights(rows.withColumns({"ts": F.lit(now), "processed": F.lit(False), "safe_to_delete": F.lit(None).cast("boolean")}))
        bad = p.where("p.summary is null").select("id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("result"), F.lit("no summary").alias("error"))
        return self._done(rows, F.lit("null")).unionByName(bad)

    def _insert(self, requests: DataFrame, now: datetime) -> DataFrame:
        schema = "data string, options struct<importance: double, tier: string, category: string, engramId: string, metadata: string>"
        p = requests.select("id", F.from_json("payload", schema).alias("p"))
        good = p.where("p.data is not null")
        rows = good.select(
            "p.data", F.coalesce("p.options.tier", F.lit("episodic")).alias("tier"), F.coalesce("p.options.importance", F.lit(0.0)).alias("importance"),
            F.coalesce("p.options.engramId", F.lit("legacy")).alias("session_id"), F.col("p.options.category").alias("category"), F.col("p.options.metadata").alias("metadata"),
        )
        version = self.memory.insert(rows, now)
        bad = p.where("p.data is null").select("id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("result"), F.lit("no data").alias("error"))
        return self._done(good, F.lit(version)).unionByName(bad)

    def _import(self, requests: DataFrame, now: datetime) -> DataFrame:
        texts = requests.select("id", F.get_json_object("payload", "$.text").alias("text"))
        return self._done(requests, F.lit(json.dumps(self.memory.import_text(texts, self.extract, "legacy", now))))

    def _recall(self, requests: DataFrame, now: datetime) -> DataFrame:
        """All recalls of a batch with the same options are one recall."""
        schema = "query string, options struct<limit: int, threshold: double, sort: string, tier: string>"
        p = requests.select("id", F.from_json("payload", schema).alias("p")).select("id", F.col("p.query").alias("data"), "p.options.*")
        p = self.memory.embed(p.where("data is not null")).withColumn("query_id", F.xxhash64("data"))
        out = None
        options = p.select("limit", "threshold", "sort", "tier").distinct().collect()  # kinds of recall, not recalls
        for o in options:
            given = {k: v for k, v in o.asDict().items() if v is not None}
            mine = p.where(F.struct("limit", "threshold", "sort", "tier").eqNullSafe(F.struct(*(F.lit(o[k]).cast(t).alias(k) for k, t in (("limit", "int"), ("threshold", "double"), ("sort", "string"), ("tier", "string"))))))
            got = self.memory.recall(mine.select("query_id", F.col("embedding").alias("vector")).dropDuplicates(["query_id"]), now, RecallOptions(min_results=1, strengthen=False, **given))
            listed = got.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "data", "effective_score"))).alias("l"))
            answered = self._done(mine.join(listed, "query_id", "left"), F.coalesce(F.to_json("l"), F.lit("[]")))
            out = answered if out is None else out.unionByName(answered)
        bad = requests.where(F.get_json_object("payload", "$.query").isNull()).select("id", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("result"), F.lit("no query").alias("error"))
        return bad if out is None else out.unionByName(bad)

    def _context(self, payload: dict, now: datetime) -> object:
        asked = [payload["query"], *payload.get("more", [])]
        rows = self.memory.embed(self.spark.createDataFrame(list(enumerate(asked)), "query_id long, data string"))
        return self.memory.context(rows.select("query_id", F.col("embedding").alias("vector")), payload.get("engramId", "legacy"), payload.get("category"), now, self.folder).first()[0]

    def _stats(self, payload: dict, now: datetime) -> object:
        files = None if self.folder is None else text.context_files(self.spark, self.folder)
        return self.memory.stats(now, files).first().asDict()

    def _recent(self, payload: dict, now: datetime) -> object:
        return [{"id": r.id, "data": r.data} for r in self.memory.recent(int(payload["limit"])).collect()]

    def _consolidate(self, payload: dict, now: datetime) -> object:
        target = {"amygdala": "salience", "hippocampus": "consolidation"}.get(payload.get("target", "all"), "all")
        return self.memory.cycle(self.score, self.summarise, now, target)

    def _fork(self, payload: dict, now: datetime) -> object:
        self.memory.fork(payload["outputPath"])
        return None


def serve(lines: DataFrame, router: Router, answers: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Answer a stream of JSON lines (value); a batch's answers go to ``answers``/<number>, so that a repeated batch overwrites its first attempt.

    Without ``every`` it works off what is there and stops. Malformed lines and unknown types are left out.
    """

    def batch(df: DataFrame, number: int) -> None:
        requests = df.persist()
        try:
            router.answer(requests).write.mode("overwrite").json(f"{answers}/{number}")
        finally:
            requests.unpersist()

    writer = text.parse_requests(lines).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
