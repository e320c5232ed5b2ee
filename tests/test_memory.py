import json
import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators.filters import RecallOptions
from tidemark.plans.memory import Memory
from tidemark.sources.store import ConcurrentCommit


def embed(df):
    """Two numbers from a text, good enough to tell texts apart."""
    return df.withColumn("embedding", F.array((F.length("data") % 7).cast("float"), (F.crc32(F.col("data").cast("binary")) % 11).cast("float")))


def test_round(spark, tmp_path):
    now = datetime(2024, 1, 2)
    memory = Memory(spark, str(tmp_path / "m"), embed, "toy")
    rows = spark.createDataFrame([(f"memory {i}" * (i + 1), "semantic" if i % 2 else "episodic", 0.5, "s1", None, None) for i in range(6)], "data string, tier string, importance double, session_id string, category string, metadata string")
    memory.insert(rows, now)
    first = memory.recent(10).collect()
    assert sorted(r.id for r in first) == list(range(1, 7))
    assert {r.tier: r.metadata for r in first} == {"episodic": "{}", "semantic": '{"confidence":1}'}
    memory.relate(spark.createDataFrame([(1, 2, "supersedes"), (1, 99, "supersedes")], "from_id long, to_id long, type string"), now)
    assert memory.store.read("edges").count() == 1
    query = memory.get(3).select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"))
    got = memory.recall(query, datetime(2024, 1, 3), RecallOptions(threshold=0.1, limit=3)).orderBy("position").collect()
    assert len(got) == 3 and got[0].sim == max(r.sim for r in got)
    assert memory.store.read("records").where("access_count = 1").count() == 3
    assert "record (score: " in memory.context(query, "s1", None, now).first()[0]
    fork = memory.fork(str(tmp_path / "f"))
    assert memory.prune(datetime(2030, 1, 1)).first()[0] == 6
    assert memory.stats(now).first()["total"] == 0 and fork.stats(now).first()["total"] == 6
    assert memory.update(1, '{"source": {"n": [1, 2]}}') is False and fork.update(1, None) is False and fork.update(2, '{"n": [1, 2]}')
    assert json.loads(fork.get(2).first().metadata)["n"] == [1, 2]
    assert fork.recall_full(99).isEmpty() and fork.recall_full(2).first().episode_summary is None
    assert fork.reembed(lambda df: embed(df), "other") == 6 and {r.embedding_model_id for r in fork.store.read("records").collect()} == {"other"}


def answers(df):
    """Insert a, relate b to record 1 and to a missing one, skip s, fail f."""
    kind = F.substring("prompt", len("Observation: ") + 1, 1)
    told = F.lit('"importanceScore": 0.9, "entities": [{"name": "Ann", "type": "person"}, {"name": "Bob", "type": "person"}]}')
    raw = F.when(kind == "a", F.concat(F.lit('{"action": "insert", '), told)).when(kind == "b", F.concat(F.lit('{"action": "relate", "targetId": "1", '), told)).when(kind == "c", F.concat(F.lit('{"action": "relate", "targetId": "77", '), told)).when(kind == "s", F.concat(F.lit('{"action": "skip", '), told))
    return df.select(F.col("id").alias("insight_id"), raw.alias("raw"), F.when(raw.isNull(), 3).otherwise(1).alias("attempts"))


def names(asked):
    """Ann of every record, and Bob whom she knows."""
    spark = asked.sparkSession
    who = spark.createDataFrame([("Ann", [1.0, 0.0]), ("Bob", [0.0, 1.0])], "name string, vector array<float>")
    found = asked.select("record_id").crossJoin(who.withColumn("type", F.lit("person")))
    return found, asked.select("record_id", F.lit("ann").alias("from_name"), F.lit("BOB").alias("to_name"), F.lit("knows").alias("type"))


def test_cycle(spark, tmp_path):
    """Insights to records, edges, tags, entities and events, in three cycles."""
    now = datetime(2024, 1, 2)
    memory = Memory(spark, str(tmp_path / "m"), embed, "toy")
    memory.insert(spark.createDataFrame([("known", "episodic", 0.5, "s1", None, None)], "data string, tier string, importance double, session_id string, category string, metadata string"), now)
    seen = [("1", "a new one", []), ("2", "b related", ["x", "llm_rate_limited"]), ("3", "c lost", []), ("4", "skip", []), ("5", "fails", []), ("6", "fails twice", ["importance_scoring_failed"] * 2), ("7", "never", ["permanently_skipped"])]
    rows = [(i, s, f"/{i}", tags, datetime(2024, 1, 1, int(i)), False, None) for i, s, tags in seen]
    memory.log_insights(spark.createDataFrame(rows, S.INSIGHTS))
    assert memory.store.acquire("salience", 60, now) and not memory.store.acquire("salience", 60, now) and memory.run_salience(answers, now) == {}
    later = datetime(2024, 1, 2, 0, 2)
    assert memory.store.acquire("salience", 60, later)  # the lease had run out
    memory.store.release("salience")
    assert memory.run_salience(answers, now, names) == {"processed": 4, "failures": 2, "llm_calls": 4}
    records = {r.data: r for r in memory.store.read("records").collect()}
    assert set(records) == {"known", "a new one", "b related", "c lost"} and records["b related"].id == 3
    assert json.loads(records["b related"].metadata) == {"source": "salience", "insightId": "2", "tags": ["x"], "entities": [{"name": "ann", "type": "person"}, {"name": "bob", "type": "person"}]}
    assert [(r.from_id, r.to_id, r.type) for r in memory.store.read("edges").collect()] == [(3, 1, "elaborates")]
    state = {r.id: (r.processed, r.tags, r.safe_to_delete) for r in memory.store.read("insights").collect()}
    failed = "importance_scoring_failed"
    assert state["2"] == (True, ["x"], True) and state["4"] == (True, [], None) and state["5"] == (False, [failed], None) and state["6"] == (False, [failed] * 3 + ["permanently_skipped"], None)
    assert memory.store.read("budgets").first().used == 10
    # Three records with entities; nobody was known, so each names both anew.
    assert memory.store.read("links").count() == 6 and memory.store.read("entities").count() == 6 and memory.store.read("entity_edges").count() == 3
    assert memory.extract_entities(names, None, now)["records_processed"] == 0
    assert memory.find_entity_path(memory.store.read("entity_edges").select("from_id", "to_id")).count() == 3
    whole = memory.stats(now).first()
    assert (whole["processed"], whole["failures"], whole["entities_inserted"], whole["pending"]) == (4, 2, 6, 3)
    # At the limit nothing is asked.
    memory.store.commit(budgets=spark.createDataFrame([("salience", now, 200)], S.BUDGETS))
    assert memory.run_salience(answers, datetime(2024, 1, 2, 0, 30)) == {"processed": 0, "failures": 1, "llm_calls": 0}
    assert [r.tags for r in memory.store.read("insights").where("id = 5").collect()] == [[failed, "llm_rate_limited"]]
    assert memory.drain(answers, datetime(2024, 1, 2, 5))["insights_drained"] == 3
    memory.log_insights(spark.createDataFrame(rows, S.INSIGHTS))
    assert memory.store.read("insights").count() == 7


def test_pending_and_commits(spark, tmp_path):
    now = datetime(2024, 1, 2)
    memory = Memory(spark, str(tmp_path / "m"), embed, "toy")
    rows = [(f"same{i % 2}", "episodic", 0.5, "s1", None, None) for i in range(8)]
    memory.insert(spark.createDataFrame(rows, "data string, tier string, importance double, session_id string, category string, metadata string"), now)
    records = memory.store.read("records")
    memory.store.commit(records=records.withColumn("access_count", F.lit(2)))
    told = lambda df: df.select("cluster_id").distinct().select("cluster_id", F.lit("both").alias("summary"), F.lit(0.4).alias("confidence"), F.array(F.lit("f")).alias("preserved_facts"), F.array(F.lit("u")).alias("uncertainties"))
    memory.consolidate(told, now)
    waits = memory.pending().collect()
    assert len(waits) == len({w.pending_id for w in waits}) > 0 and memory.store.read("edges").count() == 0
    assert memory.approve_pending(waits[0].pending_id, now) and not memory.approve_pending(waits[0].pending_id, now)
    assert memory.store.read("records").where("tier = 'semantic'").count() == 1 and memory.store.read("edges").count() == len(waits[0].source_ids)
    # A change rewrites only the parts that hold its rows; a claimed version refuses a second writer.
    parts = memory.store._pointer()[1]["records"]
    memory.update(9, '{"x": 1}')
    assert len(parts) == 3 and memory.store._pointer()[1]["records"][:2] == parts[:2]
    assert memory.store._create("", "versions", f"claim-{memory.store.version}")
    with pytest.raises(ConcurrentCommit):
        memory.clear_processed()


def test_consolidation_cycle(spark, tmp_path):
    """Retry, hourly budget, pruning and files in one leased run; stale pending ones go first."""
    now = datetime(2024, 1, 2)
    apart = lambda df: df.withColumn("embedding", F.when(F.col("data") == "same", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    memory = Memory(spark, str(tmp_path / "m"), apart, "toy")
    schema = "data string, tier string, importance double, session_id string, category string, metadata string"
    memory.insert(spark.createDataFrame([(d, "episodic", 0.5, "s1", None, None) for d in ["same"] * 4 + ["other one"] * 3 + ["x"]], schema), now)
    records = memory.store.read("records")
    weak = records.withColumn("access_count", F.when(F.col("data") == "x", 0).otherwise(2)).withColumn("stability", F.when(F.col("data") == "x", 0.01).otherwise(F.col("stability")))
    file = tmp_path / "done.ctx"
    file.write_text("t")
    old = spark.createDataFrame([("stale", "s", 0.1, [1], [], [], datetime(2023, 12, 1))], S.PENDING)
    memory.store.commit(records=weak, pending=old, insights=spark.createDataFrame([("1", "s", f"file:{file}", [], now, True, True)], S.INSIGHTS))
    asked = []

    def told(df):
        """Says nothing the first time, and then one sure and one unsure summary."""
        names = sorted(r.data for r in df.select("data").distinct().collect())
        asked.append(names)
        sure = F.when(F.col("data") == "same", 0.9).otherwise(0.2)
        once = df.groupBy("cluster_id").agg(F.min("data").alias("data"))
        return once.select("cluster_id", F.when(F.lit(len(asked) > 1), "sum").alias("summary"), sure.alias("confidence"), F.array(F.lit("f")).alias("preserved_facts"), F.array(F.lit("u")).alias("uncertainties"))

    later = datetime(2024, 1, 3)
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert memory.store.acquire("consolidation", 60, later) and memory.consolidate(told, later) == {} and not asked
    memory.store.release("consolidation")
    got = memory.cycle(None, told, later, "consolidation")["consolidation"]
    assert got == {"clusters": 1, "pending": 1, "pruned": 1, "files": 1, "calls": 4} and asked == [["other one", "same"]] * 2
    assert not file.exists() and [r.pending_id == "stale" for r in memory.pending().collect()] == [False]
    events = {r.name: json.loads(r.payload) for r in memory.store.read("events").collect()}
    assert events["consolidation:end"] == got and events["consolidation:false-memory-risk"]["confidence"] == 0.2
    assert memory.store.read("budgets").where("process = 'consolidation'").first().used == 4
    assert set(shared.iterdir()) == before  # no intermediate table is left
    memory.store.commit(budgets=spark.createDataFrame([("consolidation", later, 200)], S.BUDGETS))
    assert memory.consolidate(told, datetime(2024, 1, 3, 0, 59)) == {} and memory.consolidate(told, datetime(2024, 1, 3, 1)) != {}
    with pytest.raises(ValueError):
        memory.cycle(None, told, later, "nothing")


def test_context_of_a_cycle(spark, tmp_path):
    """Excerpts and the agent's state reach the scorer, low-cost mode quotes no file; contexts end with the session's newest files; imports go item by item."""
    now = datetime(2024, 1, 2)
    memory = Memory(spark, str(tmp_path / "m"), lambda df: embed(df).withColumn("embedding", F.when(~F.col("data").startswith("bad"), F.col("embedding"))), "toy", "coder", "writes code")
    folder = tmp_path / "ctx" / "s1"
    folder.mkdir(parents=True)
    (folder / "a.ctx").write_text("quoted " + "y" * 300)
    rows = [("1", "a one", f"{folder}/a.ctx", [], datetime(2024, 1, 1), False, None), ("2", "a two", f"{folder}/gone.ctx", [], datetime(2024, 1, 1), False, None), ("3", "a three", None, [], datetime(2024, 1, 1), False, None)]
    memory.log_insights(spark.createDataFrame(rows, S.INSIGHTS))
    seen = {}

    def score(df):
        seen.update({r.id: (r.prompt, r.system) for r in df.collect()})
        return df.select(F.col("id").alias("insight_id"), F.lit(None).cast("string").alias("raw"), F.lit(3).alias("attempts"))

    memory.set_agent_state("focused")
    memory.run_salience(score, now)
    assert "quoted " + "y" * 193 in seen["1"][0] and "y" * 194 not in seen["1"][0] and "quoted" not in seen["2"][0] + seen["3"][0]
    assert all("focused" in s and "coder" in s for _, s in seen.values())
    memory.store.commit(budgets=spark.createDataFrame([("salience", now, 170)], S.BUDGETS))
    memory.run_salience(score, now)
    assert "quoted" not in seen["1"][0]
    texts = spark.createDataFrame([(1, "one;bad two;three; ;bad"), (2, " ")], "id long, text string")
    assert memory.import_text(texts, lambda t: F.split(t, ";"), "s1", now) == {"inserted": 2, "skipped": 2}
    assert memory.import_text(texts.limit(0), lambda t: F.split(t, ";"), "s1", now) == {"inserted": 0, "skipped": 0}
    assert {r.data for r in memory.store.read("records").collect()} == {"one", "three"}
    query = memory.store.read("records").where("data = 'one'").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    for k in range(4):
        (folder / f"f{k}.ctx").write_text(f"file {k}")
        __import__("os").utime(folder / f"f{k}.ctx", (2e9 + k, 2e9 + k))
    told = memory.context(query, "s1", None, now, str(tmp_path / "ctx")).first().context
    assert told.endswith("\n\n===\n\nfile 3\n\n---\n\nfile 2\n\n---\n\nfile 1") and told.startswith("### episodic record")
    other = Memory(spark, str(tmp_path / "m"), embed, "another")
    assert other.recall_session(query, "s1", now).isEmpty() and not memory.recall_session(query, "s1", now).isEmpty()
    got = memory.recall(query, now)
    assert [f.simpleString() for f in other.recall_session(query, "s1", now).schema] == [f.simpleString() for f in got.schema]
    link = spark.createDataFrame([(1, 5, got.first().id, now), (2, 4, got.first().id, now)], S.LINKS)
    known = spark.createDataFrame([(4, "ann", "person", [1.0, 0.0], now), (5, "bob", "person", [0.0, 1.0], now)], S.ENTITIES)
    memory.store.commit(links=link, entities=known)
    rich = memory.enrich(got, query, spark.createDataFrame([(4, 1)], "from_id long, seed_order int")).collect()
    assert len(rich) == got.count() and [e.name for e in rich[0].entities] == ["bob", "ann"] and sum(r.entities is None for r in rich) == len(rich) - 1


def test_prompts(spark):
    from tidemark.functions import prompts

    related = F.array(F.struct(F.lit(7).cast("long").alias("id"), F.lit("old").alias("data")))
    episode = F.array(F.struct(F.lit(now := datetime(2024, 1, 2)).alias("created_at"), F.lit(2.5).alias("stability"), F.lit("c").alias("data")))
    pair = F.array(F.struct(F.lit("Ann").alias("name"), F.lit("person").alias("type"), F.lit("anne").alias("candidate"), F.lit(3).alias("candidate_id")))
    known = F.array(F.struct(F.lit("Ann").alias("name"), F.lit("person").alias("type")))
    r = spark.range(1).select(prompts.scoring(F.lit("s"), related, F.lit("x" * 300)), prompts.scoring(F.lit("s"), F.array().cast("array<struct<id:bigint,data:string>>")), prompts.cluster(episode), prompts.same_entity(pair), prompts.extraction(F.lit("d"), known)).first()
    assert "- [id:7] old" in r[0] and "x" * 200 in r[0] and "x" * 201 not in r[0] and "[id:" not in r[1]
    assert "Episode 1" in r[2] and f"{now:%Y-%m-%d}T00:00:00.000Z" in r[2] and '[0] Extracted: "Ann" (person) | Existing: "anne" (id: 3)' in r[3] and "- Ann (person)" in r[4]
    assert "x" * 200 in prompts.system("coder", "x" * 300, "idle") and "Agent state: odd." in prompts.system(state="odd")


def test_retries_and_files(spark, tmp_path):
    from tidemark.operators import salience

    calls = []

    def flaky(df):
        calls.append(df.count())
        good = F.when(F.col("id") == "a", "x").when((F.col("id") == "b") & F.lit(len(calls) > 1), "y")
        return df.select(F.col("id").alias("insight_id"), good.alias("raw"))

    got = salience.retried(flaky)(spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "id string, prompt string")).collect()
    assert calls == [3, 2, 1] and {(r.insight_id, r.raw, r.attempts) for r in got} == {("a", "x", 1), ("b", "y", 2), ("c", None, 3)}
    folder = tmp_path / "ctx" / "s1"
    folder.mkdir(parents=True)
    for name in ("old", "named", "free"):
        (folder / f"{name}.ctx").write_text("t")
    memory = Memory(spark, str(tmp_path / "m"), embed, "toy")
    rows = [("1", "s", f"file:{folder}/named.ctx", [], datetime(2024, 1, 1), False, None), ("2", "s", f"file:{folder}/free.ctx", [], datetime(2024, 1, 1), True, True)]
    memory.log_insights(spark.createDataFrame(rows, S.INSIGHTS))
    assert memory.clean_context() == 1 and memory.prune_context(str(tmp_path / "ctx"), 1, datetime(2099, 1, 1)) == 1
    assert [p.name for p in folder.iterdir() if p.suffix == ".ctx"] == ["named.ctx"]


def test_schedule(spark, tmp_path):
    from tidemark.streaming import salience_stream as stream

    runs = []
    assert stream.schedule(spark, 0, lambda: runs.append(1), str(tmp_path / "c")) is None
    q = stream.schedule(spark, 1, lambda: runs.append(1), str(tmp_path / "c"))
    q.awaitTermination(8)
    q.stop()
    assert runs
