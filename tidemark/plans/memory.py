"""The memory facade: one object over a store, with pluggable embedding and language-model callables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import prompts
from tidemark.functions import scalars as X
from tidemark.operators import consolidate, entities, graph, recall, salience, serialize
from tidemark.operators.filters import RecallOptions, live, lookup
from tidemark.sources import store as st
from tidemark.sources import text

Embed = Callable[[DataFrame], DataFrame]


def cleans_up(method: Callable) -> Callable:
    """Delete the intermediate tables of a method that returns plain values when it ends."""

    @wraps(method)
    def inner(self: Memory, *args, **kwargs):
        with graph.scratch(self.spark):
            return method(self, *args, **kwargs)

    return inner


class Memory:
    """Layered memory of one or many sessions.

    ``embed`` takes rows with a text column ``data`` and adds ``embedding``, on the executors; ``model_id`` names its model. Every method
    that depends on time takes ``as_of``; nothing reads the clock. ``kind`` and ``purpose`` describe the agent to the scorer.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Embed, model_id: str, kind: str | None = None, purpose: str | None = None):
        self.spark, self.store, self.embed, self.model_id, self.closed = spark, st.Store(spark, path), embed, model_id, False
        self.kind, self.purpose, self.state = kind, purpose, None

    def set_agent_state(self, state: str | None) -> None:
        """What the agent does now (see ``prompts.STATES``), which the scorer's system prompt names from the next cycle on."""
        self.state = state

    def _at(self, as_of: datetime):
        return F.lit(as_of)

    # Short-term insights

    def log_insights(self, insights: DataFrame) -> None:
        """Append insights; after ``drain`` they are ignored."""
        if not self.closed:
            self.store.commit(append={"insights": insights})

    def clear_processed(self) -> None:
        self.store.commit(insights=self.store.read("insights").where(~F.col("processed")))

    @cleans_up
    def run_salience(self, score: Callable[[DataFrame], DataFrame], as_of: datetime, extract: Callable | None = None, verdict: Callable | None = None) -> dict:
        """One salience cycle under its lease; returns (processed, failures, llm_calls), or nothing if the lease is taken.

        The oldest open insights are scored by ``score`` (id, prompt, system -> insight_id, raw, attempts; a null raw is a failure) within the hourly budget.
        Their prompts name the memories that recall relates to them and quote the beginning of their context files; when calls run low, fewer
        memories and no file. Inserts and relates become records and edges, outcomes
        become tags, and all of it is one commit with the budget and the events. With ``extract`` an entity extraction follows.
        """
        now, store = self._at(as_of), self.store
        if not store.acquire("salience", 2 * S.SALIENCE_CADENCE_S, as_of):
            return {}
        try:
            insights, records = store.read("insights"), store.read("records")
            start, used = self._budget("salience", as_of)
            batch = salience.select_batch(insights).withColumn("_n", used + F.row_number().over(Window.orderBy("ts", "id")))
            mode = F.when(F.col("_n") > S.HOURLY_CALLS, "limited").when(F.col("_n") > S.LOW_COST_CALLS, "low_cost").otherwise("normal")
            batch = graph.cut(batch.withColumn("mode", mode).drop("_n"))
            open_ = batch.where("mode <> 'limited'")
            related = graph.cut(self._related(open_, records, store.read("edges"), as_of))
            asked = open_.join(related, "id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<struct<id:bigint,data:string>>")))
            asked = asked.join(self._excerpts(open_), "id", "left")
            told = prompts.system(self.kind, self.purpose, self.state)
            scores = graph.cut(score(asked.select("id", prompts.scoring(F.col("summary"), F.col("related"), F.col("excerpt")).alias("prompt"), F.lit(told).alias("system"))))
            good = scores.where("raw is not null")
            acted = graph.cut(salience.actions(open_, good.select("insight_id", "raw"), asked.select("id", F.size("related").alias("n"))))
            new, edges = salience.promoted(acted, open_, now, store.next_id("records"))
            whole = self._whole(self.embed(new))
            known = edges.join(records.select(F.col("id").alias("to_id")), "to_id", "left_semi")
            linked = st.number_rows(known, "from_id", store.next_id("edges") - 1).select("id", "from_id", "to_id", "type", "stability", now.alias("last_accessed_at"), now.alias("created_at"))
            outcome = batch.select("id", "mode").join(good.select(F.col("insight_id").alias("id"), F.lit(True).alias("_ok")), "id", "left").join(acted.select("id", "action"), "id", "left")
            outcome = graph.cut(outcome.select("id", "action", F.when(F.col("mode") == "limited", "limited").when(F.col("_ok"), "done").otherwise("failed").alias("outcome")))
            calls, done, lost = scores.agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0], outcome.where("outcome = 'done'").count(), outcome.where("outcome <> 'done'").count()
            report = {"processed": done, "failures": lost, "llm_calls": good.count()}

            def after(rows: DataFrame) -> DataFrame:
                o = rows.join(outcome, "id", "left")
                stored = (F.col("outcome") == "done") & F.col("action").isin("insert", "relate")
                return o.withColumns({
                    "tags": salience.tags_after(F.col("tags"), F.coalesce("outcome", F.lit(""))), "processed": F.col("processed") | F.coalesce(F.col("outcome") == "done", F.lit(False)),
                    "safe_to_delete": F.when(F.coalesce(stored, F.lit(False)), True).otherwise(F.col("safe_to_delete")),
                })

            scored = acted.select(F.lit("salience:entry:scored").alias("name"), now.alias("at"), F.to_json(F.struct(F.col("id").alias("insightId"), "action", "importance", "target_id", "edge_type")).alias("payload"))
            budgets = store.read("budgets").where("process <> 'salience'").unionByName(self.spark.createDataFrame([("salience", start, used + int(calls))], S.BUDGETS))
            store.commit(
                append={"records": whole, "edges": linked, "events": scored.unionByName(self._event("salience:cycle:end", as_of, report))},
                change={"insights": (outcome, ("id",), after)}, budgets=graph.cut(budgets),
            )
        finally:
            store.release("salience")
        if extract is not None:
            self.extract_entities(extract, verdict, as_of)
        return report

    def _budget(self, process: str, as_of: datetime) -> tuple[datetime, int]:
        """(start of the hour, calls in it) of a process."""
        row = self.store.read("budgets").where(F.col("process") == process).first()
        return (row.start, row.used) if row and (as_of - row.start).total_seconds() < 3_600 else (as_of, 0)

    def _related(self, open_: DataFrame, records: DataFrame, edges: DataFrame, as_of: datetime) -> DataFrame:
        """Rows (id, related array of (id, data)) of insights with memories at or above the recall threshold: three at most, one in low-cost mode."""
        asked = graph.cut(self.embed(open_.select("id", F.col("summary").alias("data"), "mode")).withColumn("query_id", F.row_number().over(Window.orderBy("id")).cast("long")))  # a batch of ten
        got = recall.recall(records, edges, asked.select("query_id", F.col("embedding").alias("vector")), RecallOptions(limit=S.RELATED_ROWS, strengthen=False), self._at(as_of)).results
        return salience.related(got, asked)

    def _excerpts(self, open_: DataFrame) -> DataFrame:
        """Rows (id, excerpt) of insights whose context file is there, outside of low-cost mode; the executors read the files."""
        normal = open_.where("mode = 'normal' and context_file is not null").select("id", F.col("context_file").alias("name"))
        files = text.named_files(self.spark, [r.name for r in normal.select("name").distinct().collect()])  # a batch of ten
        return normal.join(files, "name").select("id", F.nullif(X.excerpt(F.col("text")), F.lit("")).alias("excerpt"))

    def _event(self, name: str, as_of: datetime, payload: dict) -> DataFrame:
        return self.spark.createDataFrame([(name, as_of, json.dumps(payload))], S.EVENTS)

    def _whole(self, rows: DataFrame) -> DataFrame:
        """``rows`` with all columns of records, null where they have none."""
        schema = dict(f.split(" ", 1) for f in S.RECORDS.split(", "))
        extra = {"embedding_model_id": F.lit(self.model_id), "embedding_dimensions": F.size("embedding"), "tombstoned": F.lit(False), "session_id": F.lit("legacy")}
        return rows.withColumns({c: extra.get(c, F.lit(None)).cast(t) for c, t in schema.items() if c not in rows.columns}).select(*schema)

    @cleans_up
    def extract_entities(self, extract: Callable, verdict: Callable | None, as_of: datetime) -> dict:
        """Extract entities of the live records that have none linked, under a lease of a minute; returns totals, or nothing if the lease is taken.

        ``extract`` (record_id, prompt -> entities (record_id, name, type, vector), edges (record_id, from_name, to_name, type)) names them;
        ``verdict`` (probe_id, prompt -> probe_id, same) decides open cases, which are distinct without it.
        """
        store, now = self.store, self._at(as_of)
        if not store.acquire("extraction", S.EXTRACTION_LEASE_S, as_of):
            return {}
        try:
            todo = entities.processable(store.read("records"), store.read("links"))
            asked = graph.cut(todo.select(F.col("id").alias("record_id"), prompts.extraction(F.col("data"), X.entities_of(F.col("metadata"))).alias("prompt")))
            named, edges = extract(asked)
            named = graph.cut(st.number_rows(named.withColumn("_o", F.xxhash64("record_id", "name", "type")), "_o", 0).withColumnRenamed("id", "probe_id").drop("_o"))
            known = store.read("entities")
            plan = graph.cut(entities.resolve(named, known))
            same = self.spark.createDataFrame([], "probe_id long, same boolean")
            if verdict is not None:
                pair = named.join(plan.where("decision = 'llm-needed'"), "probe_id").join(known.select(F.col("id").alias("entity_id"), F.col("name").alias("candidate")), "entity_id")
                pair = pair.select("probe_id", prompts.same_entity(F.array(F.struct("name", "type", "candidate", F.col("entity_id").alias("candidate_id")))).alias("prompt"))
                same = graph.cut(verdict(pair))
            settled = graph.cut(entities.settle(plan, same))
            added, links, relations = entities.persist(settled, named, edges, store.next_id("entities"))
            fresh = st.number_rows(relations, "from_id", store.next_id("entity_edges") - 1).select("id", "from_id", "to_id", "type", F.lit(1.0).alias("weight"), now.alias("created_at"))
            totals = entities.totals(asked, settled)
            report = totals.first().asDict()
            store.commit(append={
                "entities": added.withColumn("created_at", now), "links": st.number_rows(links, "record_id", store.next_id("links") - 1).withColumn("created_at", now),
                "entity_edges": graph.new_edges(store.read("entity_edges"), fresh), "events": self._event("extraction:end", as_of, report),
            })
            return report
        finally:
            store.release("extraction")

    def drain(self, score: Callable[[DataFrame], DataFrame], as_of: datetime, queries: Iterable = ()) -> dict:
        """Shut down: work off and stop the streams, run one last salience cycle, ignore insights from now on; returns a report."""
        self.closed = True
        for q in queries:
            q.processAllAvailable()
            q.stop()
        before = self.store.read("insights").where(~F.col("processed")).count()
        self.run_salience(score, as_of)
        return {"insights_drained": before, "records_at_close": live(self.store.read("records")).count()}

    # Records

    @cleans_up
    def insert(self, rows: DataFrame, as_of: datetime) -> int:
        """Insert (data, tier, importance, session_id, category, metadata) all or none; returns the version. A semantic row without a confidence gets 1."""
        return self._insert(self.embed(rows), as_of)

    def _insert(self, rows: DataFrame, as_of: datetime) -> int:
        now = self._at(as_of)
        known = F.get_json_object("metadata", "$.confidence").isNotNull() | (F.col("tier") != "semantic")
        patched = X.merge_metadata(F.coalesce("metadata", F.lit("{}")), F.lit('{"confidence": 1}'))
        full = st.number_rows(rows.withColumn("_o", F.xxhash64("data", "session_id")), "_o", self.store.next_id("records") - 1).select(
            "id", "data", F.when(known, F.coalesce("metadata", F.lit("{}"))).otherwise(patched).alias("metadata"), "embedding", "tier", "importance", X.initial_stability(F.col("importance")).alias("stability"),
            now.alias("last_accessed_at"), F.lit(0).alias("access_count"), now.alias("created_at"), "session_id", "category",
        )
        return self.store.commit(append={"records": self._whole(full)})

    @cleans_up
    def import_text(self, texts: DataFrame, extract, session_id: str, as_of: datetime) -> dict:
        """Insert what ``extract`` finds in ``texts``, item by item: an item to which the model gives no vector is left out. Returns how many were inserted and skipped."""
        found = text.import_text(texts, extract)
        rows = found.select("data", F.lit("episodic").alias("tier"), F.lit(0.0).alias("importance"), F.lit(session_id).alias("session_id"), F.lit(None).cast("string").alias("category"), F.lit("{}").alias("metadata"))
        seen = Observation()
        made = graph.cut(self.embed(rows).observe(seen, F.count("*").alias("items"), F.count("embedding").alias("inserted")))
        if seen.get["inserted"]:
            self._insert(made.where("embedding is not null"), as_of)
        return {"inserted": seen.get["inserted"], "skipped": seen.get["items"] - seen.get["inserted"]}

    def get(self, record_id: int) -> DataFrame:
        """The record, or of a tombstone only that it is one and since when."""
        return lookup(self.store.read("records"), [record_id])

    def recall_full(self, record_id: int) -> DataFrame:
        """The live record with its episode summary; no row for a missing or tombstoned one."""
        return live(self.store.read("records")).where(F.col("id") == record_id)

    def recent(self, limit: int) -> DataFrame:
        return live(self.store.read("records")).orderBy(F.desc("created_at"), "id").limit(limit).drop("embedding")

    def update(self, record_id: int, metadata: str | None) -> bool:
        """Merge a JSON object into a record's metadata; false without one, or if the record is missing or tombstoned."""
        if metadata is None or self.recall_full(record_id).isEmpty():
            return False
        hit = F.col("id") == record_id
        merged = F.when(hit, X.merge_metadata(F.coalesce("metadata", F.lit("{}")), F.lit(metadata))).otherwise(F.col("metadata"))
        ids = self.spark.createDataFrame([(record_id,)], "id long")
        self.store.commit(change={"records": (ids, ("id",), lambda rows: rows.withColumn("metadata", merged))})
        return True

    def reembed(self, embed: Embed, model_id: str) -> int:
        """Embed every live record anew with another model; all or none. Returns how many."""
        records = self.store.read("records")
        n = live(records).count()
        new = embed(live(records).drop("embedding")).withColumns({"embedding_model_id": F.lit(model_id), "embedding_dimensions": F.size("embedding")})
        self.store.commit(records=new.select(*records.columns).unionByName(records.where("tombstoned")))
        self.embed, self.model_id = embed, model_id
        return n

    @cleans_up
    def delete(self, ids: DataFrame) -> None:
        ids = graph.cut(ids.select("id").distinct())
        none = self.store.read
        self.store.commit(change={
            "records": (ids, ("id",), lambda rows: st.delete(rows, none("edges").limit(0), ids)[0]), "edges": (ids, ("from_id", "to_id"), lambda rows: st.delete(none("records").limit(0), rows, ids)[1]),
        })

    def relate(self, wanted: DataFrame, as_of: datetime) -> None:
        new = st.number_rows(st.relate(self.store.read("records"), wanted), "from_id", self.store.next_id("edges") - 1)
        now = self._at(as_of)
        self.store.commit(append={"edges": new.select("id", "from_id", "to_id", "type", "stability", now.alias("last_accessed_at"), now.alias("created_at"))})

    # Recall

    def recall(self, queries: DataFrame, as_of: datetime, options: RecallOptions | None = None) -> DataFrame:
        """Results for ``queries`` (query_id, vector). At least one result, and no strengthening, unless ``options`` say otherwise."""
        options = options or RecallOptions(min_results=1, strengthen=False)
        records, edges = self.store.read("records"), self.store.read("edges")
        recall.check_model(records, self.model_id)
        got = recall.recall(records, edges, queries, options, self._at(as_of))
        if options.strengthen:
            latest = got.record_updates.groupBy("id").agg(F.max_by("stability", "query_id").alias("stability"), F.max("last_accessed_at").alias("last_accessed_at"), F.max("access_count").alias("access_count"))
            of_edges = got.edge_updates.groupBy("id").agg(F.max_by("stability", "query_id").alias("stability"), F.max("last_accessed_at").alias("last_accessed_at"))
            latest, of_edges = graph.cut(latest), graph.cut(of_edges)
            self.store.commit(change={"records": (latest, ("id",), lambda rows: st.apply_updates(rows, latest)), "edges": (of_edges, ("id",), lambda rows: st.apply_updates(rows, of_edges))})
        return got.results

    def recall_session(self, queries: DataFrame, session_id: str, as_of: datetime, options: RecallOptions | None = None) -> DataFrame:
        """Recall within a session; no rows if the stored vectors are of another model."""
        own = replace(options or RecallOptions(), session_id=session_id, strengthen=False, min_results=0)
        try:
            return self.recall(queries, as_of, own)
        except recall.ModelMismatch:
            return self.spark.createDataFrame([], recall.RESULTS)

    def context(self, queries: DataFrame, session_id: str, category: str | None, as_of: datetime, folder: str | None = None) -> DataFrame:
        """One row with the text of the merged recalls of ``queries``, the first of which may give five records and the others two; then the session's newest context files in ``folder``."""
        results = self.recall(queries, as_of, RecallOptions(min_results=1, strengthen=False, limit=S.CONTEXT_ROWS)).withColumnRenamed("query_id", "list_no")
        first = queries.agg(F.min("query_id").alias("f"))
        rows = results.crossJoin(first).where((F.col("list_no") == F.col("f")) | (F.col("position") <= S.CONTEXT_SECONDARY_ROWS))
        told = serialize.context_text(serialize.merge_context(rows, session_id, category))
        if folder is None:
            return told
        recent = text.files_text(text.recent_files(text.context_files(self.spark, folder).where(F.col("session_id") == session_id)))
        parts = F.filter(F.array("context", "files"), lambda p: p != "")
        return told.crossJoin(recent).select(F.array_join(parts, "\n\n===\n\n").alias("context"))  # one row each

    def enrich(self, results: DataFrame, query: DataFrame, seeds: DataFrame) -> DataFrame:
        """Every result, the first three that link to entities with these and the path from ``seeds``."""
        read = self.store.read
        found = entities.enrich(results, query, read("links"), read("entities"), read("entity_edges"), seeds)
        return entities.with_entities(results, found, read("links"), read("entities"))

    def find_entity_path(self, pairs: DataFrame, max_hops: int = S.PATH_HOPS) -> DataFrame:
        """Shortest paths (from_id, to_id, hops, path, reliability) between entities."""
        found = graph.shortest_paths(self.store.read("entity_edges"), pairs, max_hops)
        return found.withColumn("reliability", graph.reliability(F.col("hops")))

    # Maintenance

    @cleans_up
    def consolidate(self, summarise: Callable[[DataFrame], DataFrame], as_of: datetime, similarity: float = S.PROCESS_SIMILARITY) -> dict:
        """One consolidation cycle under its lease: cluster and summarise, prune, delete context files; returns counts, or nothing if the lease is taken or the hour's calls are used up.

        ``summarise`` (cluster_id, id, data, ... -> cluster_id, summary, confidence, preserved_facts, uncertainties) is asked twice for a cluster at
        most, and each time counts as a call. Unsure summaries wait for approval and are told as an event.
        """
        if not self.store.acquire("consolidation", 2 * S.CONSOLIDATION_CADENCE_S, as_of):
            return {}
        try:
            start, used = self._budget("consolidation", as_of)
            if used >= S.HOURLY_CALLS:
                return {}
            report, calls, events = self._consolidate(summarise, as_of, similarity)
            report |= {"pruned": self.prune(as_of).first()["pruned"], "files": self.clean_context(), "calls": calls}
            budgets = self.store.read("budgets").where("process <> 'consolidation'").unionByName(self.spark.createDataFrame([("consolidation", start, used + calls)], S.BUDGETS))
            self.store.commit(append={"events": events.unionByName(self._event("consolidation:end", as_of, report))}, budgets=graph.cut(budgets))
            return report
        finally:
            self.store.release("consolidation")

    def _consolidate(self, summarise: Callable[[DataFrame], DataFrame], as_of: datetime, similarity: float) -> tuple[dict, int, DataFrame]:
        records, now = self.store.read("records"), self._at(as_of)
        pool = consolidate.consolidation_candidates(records)
        clusters = consolidate.greedy_clusters(consolidate.similar_pairs(pool, similarity))
        timed = clusters.join(pool.select("id", "created_at"), "id")
        parts = graph.cut(consolidate.large_parts(consolidate.temporal_split(timed)))
        members = parts.select((F.col("cluster_id") * 2 + F.col("part")).alias("cluster_id"), "id")
        summaries, calls = consolidate.retried(summarise, members.join(pool, "id"))
        sure, unsure = consolidate.gate(summaries)
        waiting = graph.cut(consolidate.pending(unsure, members, now))
        self._write_summaries(records, sure, members, now, waiting)
        risky = waiting.select(F.lit("consolidation:false-memory-risk").alias("name"), now.alias("at"), F.to_json(F.struct("pending_id", "confidence", "source_ids")).alias("payload"))
        return {"clusters": sure.count(), "pending": waiting.count()}, calls, risky

    def cycle(self, score: Callable[[DataFrame], DataFrame], summarise: Callable[[DataFrame], DataFrame], as_of: datetime, target: str = "all") -> dict:
        """Drop what has waited too long, then run the salience cycle, the consolidation cycle or (``target="all"``) both; returns their reports."""
        if target not in ("salience", "consolidation", "all"):
            raise ValueError(f"target is {target!r}")
        self.purge_pending(as_of)
        reports = {}
        if target != "consolidation":
            reports["salience"] = self.run_salience(score, as_of)
        if target != "salience":
            reports["consolidation"] = self.consolidate(summarise, as_of)
        return reports

    def _write_summaries(self, records: DataFrame, summaries: DataFrame, members: DataFrame, now: Column, waiting: DataFrame | None = None, pending: DataFrame | None = None) -> None:
        """Commit the records, edges and halved stabilities of ``summaries``, with what waits or what is left waiting."""
        new, edges, halves = consolidate.consolidate(records, summaries, members, now, self.store.next_id("records"))
        halves = graph.cut(halves)
        linked = st.number_rows(edges, "to_id", self.store.next_id("edges") - 1).withColumn("created_at", now)
        append = {"records": self._whole(self.embed(new)), "edges": linked} | ({} if waiting is None else {"pending": waiting})
        self.store.commit(append=append, change={"records": (halves, ("id",), lambda rows: st.apply_updates(rows, halves))}, **({} if pending is None else {"pending": pending}))

    @cleans_up
    def approve_pending(self, pending_id: str, as_of: datetime) -> bool:
        """Consolidate what waits under ``pending_id`` and take it off the list; false if nothing does."""
        waits = graph.cut(self.pending().where(F.col("pending_id") == pending_id))
        if waits.isEmpty():
            return False
        summaries = waits.select(F.lit(1).cast("long").alias("cluster_id"), "summary", "confidence", "preserved_facts", "uncertainties")
        members = waits.select(F.lit(1).cast("long").alias("cluster_id"), F.explode("source_ids").alias("id"))
        self._write_summaries(self.store.read("records"), summaries, members, self._at(as_of), pending=graph.cut(self.pending().where(F.col("pending_id") != pending_id)))
        return True

    def pending(self) -> DataFrame:
        return self.store.read("pending")

    @cleans_up
    def discard_pending(self, pending_id: str) -> None:
        self.store.commit(pending=graph.cut(self.pending().where(F.col("pending_id") != pending_id)))

    @cleans_up
    def purge_pending(self, as_of: datetime) -> None:
        self.store.commit(pending=graph.cut(salience.purge_pending(self.pending(), self._at(as_of))))

    def prune(self, as_of: datetime, least: float = S.PRUNE_RETENTION, tier: str | None = None) -> DataFrame:
        """Tombstone or delete what has decayed; returns one row (pruned, remaining)."""
        records, edges, now = self.store.read("records"), self.store.read("edges"), self._at(as_of)
        plan = graph.cut(consolidate.prune(records, edges, now, least, tier))
        gone, none = plan.where("action = 'delete'"), edges.limit(0)
        self.store.commit(change={
            "records": (plan, ("id",), lambda rows: st.delete(st.tombstone(rows, plan.where("action = 'tombstone'"), now), none, gone)[0]),
            "edges": (gone, ("from_id", "to_id"), lambda rows: st.delete(records.limit(0), rows, gone)[1]),
        })
        return plan.agg(F.count("*").alias("pruned")).join(live(self.store.read("records")).agg(F.count("*").alias("remaining")))

    def clean_context(self) -> int:
        """Delete the context files whose insights allow it; returns how many."""
        return text.delete_files(text.deletable_files(self.store.read("insights")).withColumnRenamed("context_file", "path"))

    def prune_context(self, folder: str, days: float, as_of: datetime) -> int:
        """Delete context files of at least ``days`` that no open insight names; returns how many."""
        return text.delete_files(text.stale_files(text.context_files(self.spark, folder), self.store.read("insights"), self._at(as_of), days))

    def stats(self, as_of: datetime, files: DataFrame | None = None) -> DataFrame:
        """One row: records, open insights, totals of past cycles from the event log, and with ``files`` the context folder's."""
        now, events = self._at(as_of), self.store.read("events")
        cycles = events.where("name = 'salience:cycle:end'").select(*(F.get_json_object("payload", f"$.{c}").cast("long").alias(c) for c in ("processed", "failures", "llm_calls")))
        found = events.where("name = 'extraction:end'").agg(*(F.coalesce(F.sum(F.get_json_object("payload", f"$.{c}").cast("long")), F.lit(0)).alias(c) for c in ("records_processed", "entities_inserted", "entities_reused")))
        parts = [consolidate.stats(self.store.read("records"), now), salience.stm_stats(self.store.read("insights"), now), salience.cycle_counters(cycles), found]
        whole = parts[0]
        for more in parts[1:] + ([] if files is None else [text.disk_stats(files, now)]):
            whole = whole.crossJoin(more)  # one row each
        return whole

    def fork(self, path: str) -> Memory:
        other = Memory(self.spark, path, self.embed, self.model_id)
        self.store.fork(path)
        return other
