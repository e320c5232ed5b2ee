import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.streaming import salience_stream as stream
from tidemark.streaming import state


def stream_of(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_budget(spark, tmp_path):
    start = datetime(2024, 1, 1)
    calls = [("p", f"{i:04}", start + timedelta(seconds=10 * i)) for i in range(450)]
    got = drained(stream.budgeted(stream_of(spark, spark.createDataFrame(calls, "process string, id string, ts timestamp"), str(tmp_path / "c"))), "budget")
    modes = {r.id: r.mode for r in got.collect()}
    assert [modes[f"{i:04}"] for i in (0, 149, 150, 199, 200, 359, 360)] == ["normal", "normal", "low_cost", "low_cost", "limited", "limited", "normal"]


def test_compression(spark, tmp_path):
    phases = spark.createDataFrame([(1, i, 30, 10, 100) for i in range(4)] + [(2, 0, 80, 5, 100)], "conv_id long, seq long, tokens long, short long, max_tokens long")
    got = drained(stream.compressed(stream_of(spark, phases, str(tmp_path / "p"))), "phases").orderBy("conv_id", "seq").collect()
    assert [(r.held, r.compressed) for r in got] == [(30, False), (60, False), (70, True), (80, True), (5, True)]


def test_salience(spark, tmp_path):
    insights = spark.createDataFrame([("1", "s", None, ["a", "llm_rate_limited"], datetime(2024, 1, 1), False, None), ("2", "s", None, [], datetime(2024, 1, 1), True, None)], S.INSIGHTS)
    seen = []
    score = lambda df: df.select(F.col("id").alias("insight_id"), F.lit('{"action": "insert", "importanceScore": 0.8}').alias("raw"))
    q = stream.run_salience(stream_of(spark, insights, str(tmp_path / "i")), score, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.id, r.action, r.tier, r.tags) for r in seen] == [("1", "insert", "semantic", ["a"])]


def until(spark, name, wanted, seconds=90):
    """Rows of a memory sink as soon as ``wanted`` holds for them, or at the end of the time."""
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.table(name).collect()
        if wanted(rows):
            return rows
        time.sleep(0.5)
    return spark.table(name).collect()


def test_count_trigger(spark, tmp_path):
    """Nine open insights are not due, ten are, repeated rows count once, and processed ones count no more."""
    schema, folder = "scope string, id string, processed boolean", str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([("nine", str(i), False) for i in range(9)] + [("ten", str(i), False) for i in range(10)] + [("nine", "0", False)])
    q = state.due(spark.readStream.schema(schema).parquet(folder), check_ms=500).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert {tuple(r) for r in until(spark, "due", bool)} == {("ten", 10)}
        put([("ten", "3", True), ("ten", "99", True), ("nine", "9", False), ("nine", "10", False)])
        assert {tuple(r) for r in until(spark, "due", lambda rows: any(r.scope == "nine" for r in rows))} == {("ten", 10), ("nine", 11)}
        seen = sum(r.scope == "ten" for r in spark.table("due").collect())
        until(spark, "due", lambda rows: len(rows) > seen + 6)
        assert sum(r.scope == "ten" for r in spark.table("due").collect()) == seen  # nine of them are open now
    finally:
        q.stop()
    ran = []
    q = state.run_when_due(state.due(spark.readStream.schema(schema).parquet(folder), least=9, check_ms=200), ran.append, str(tmp_path / "cp2"))
    end = time.time() + 60
    while not ran and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert ran and set(ran[0]) <= {"nine", "ten"}


def test_pending_with_time_to_live(spark, tmp_path):
    schema, folder = f"pending_id string, seq long, action string, {state.Waiting.FIELDS}", str(tmp_path / "in")
    whole = lambda i, n: (i, n, "add", f"s{i}", 0.4, [1, 2], ["f"], ["u"])
    ask = lambda i, n, action: (i, n, action, None, None, None, None, None)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([whole("a", 1), whole("b", 2), whole("c", 3), ask("b", 4, "discard"), ask("x", 5, "approve"), whole("d", 6), ask("d", 7, "approve")])
    source = spark.readStream.schema(schema).parquet(folder)
    q = state.approved(source, 4 / 3600).writeStream.format("memory").queryName("approved").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        assert [r.pending_id for r in until(spark, "approved", bool)] == ["d"]
        time.sleep(5)
        put([ask("a", 8, "approve"), ask("b", 9, "approve"), whole("e", 10), ask("e", 11, "approve")])
        rows = until(spark, "approved", lambda rows: len(rows) > 1)
        assert [(r.pending_id, r.summary, r.source_ids) for r in rows] == [("d", "sd", [1, 2]), ("e", "se", [1, 2])]
    finally:
        q.stop()


def test_requests_are_answered(spark, tmp_path):
    """All nine types in one batch, bad ones beside good ones; a second batch sees what the first wrote."""
    import json

    from tests.test_memory import embed
    from tidemark.plans.memory import Memory
    from tidemark.streaming.requests import Router, serve

    memory = Memory(spark, str(tmp_path / "m"), embed, "toy")
    told = lambda df: df.select("cluster_id").distinct().select("cluster_id", F.lit("s").alias("summary"), F.lit(0.9).alias("confidence"), F.array(F.lit("f")).alias("preserved_facts"), F.array(F.lit("u")).alias("uncertainties"))
    score = lambda df: df.select(F.col("id").alias("insight_id"), F.lit('{"action": "skip", "importanceScore": 0.1}').alias("raw"), F.lit(1).alias("attempts"))
    router = Router(memory, lambda: datetime(2024, 1, 2), lambda t: F.split(t, ";"), score, told)
    asked = [
        ("1", "logInsight", {"summary": "seen", "tags": ["t"]}), ("2", "logInsight", {"tags": []}), ("3", "insertMemory", {"data": "first", "options": {"tier": "semantic", "importance": 0.5}}), ("4", "insertMemory", {}),
        ("5", "importText", {"text": "second;third"}), ("6", "recall", {"query": "first", "options": {"limit": 2, "threshold": 0.1}}), ("7", "recall", {"query": "third"}), ("8", "recall", {}), ("9", "getContext", {"query": "first"}),
        ("10", "getContext", {}), ("11", "getStats", {}), ("12", "getRecent", {"limit": 2}), ("13", "consolidate", {"target": "amygdala"}), ("14", "fork", {"outputPath": str(tmp_path / "fork")}), ("15", "unknown", {}),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps({"id": i, "type": t, "payload": p}) for i, t, p in asked] + ["broken"]))
    serve(spark.readStream.text(str(tmp_path / "in")), router, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    got = {r.id: r for r in spark.read.schema("id string, ok boolean, result string, error string").json(str(tmp_path / "out" / "0")).collect()}
    assert set(got) == {str(k) for k in range(1, 15)} and {i for i, r in got.items() if not r.ok} == {"2", "4", "8", "10"}, got
    assert json.loads(got["5"].result) == {"inserted": 2, "skipped": 0} and json.loads(got["11"].result)["total"] == 3
    first = json.loads(got["6"].result)
    assert len(first) == 2 and first[0]["data"] == "first" and json.loads(got["7"].result)[0]["data"] == "third"
    assert "KeyError" in got["10"].error and len(json.loads(got["12"].result)) == 2 and json.loads(got["13"].result)["salience"]["processed"] == 1
    assert Memory(spark, str(tmp_path / "fork"), embed, "toy").store.read("records").count() == 3 and "semantic record" in got["9"].result
