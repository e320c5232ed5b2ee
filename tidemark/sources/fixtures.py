"""Memory tables derived from the star-schema test data, in Spark SQL and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
SESSION, CATEGORY = "session-1", "world_fact"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COMMON_RECORD = """
  CASE WHEN e.vec_id % 37 = 0 THEN NULL ELSE coalesce(d.text, '') END AS data,
  concat('{"tags": ["', v.event_type, '", "lang:', coalesce(d.lang, 'none'), '"], "entities": [{"name": "label', CAST(e.label AS @STR), '", "type": "concept"}]',
         CASE WHEN e.vec_id % 5 = 0 THEN ', "confidence": 0.8' ELSE '' END, '}') AS metadata,
  CASE WHEN e.vec_id % 37 = 0 THEN NULL ELSE e.embedding END AS embedding,
  'synthetic-64' AS embedding_model_id, 64 AS embedding_dimensions,
  CASE WHEN e.vec_id % 5 = 0 THEN 'semantic' ELSE 'episodic' END AS tier,
  CAST((e.vec_id % 11) AS DOUBLE) / 10 AS importance,
  1 + 9 * (CAST((e.vec_id % 11) AS DOUBLE) / 10) AS stability,
  @BACK(HOUR, (e.vec_id * 13) % 240) AS last_accessed_at,
  CAST(e.vec_id % 7 AS INT) AS access_count,
  CAST(v.ts AS TIMESTAMP) AS created_at,
  e.vec_id % 37 = 0 AS tombstoned,
  CASE WHEN e.vec_id % 37 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS tombstoned_at,
  concat('session-', CAST(e.vec_id % 4 AS @STR)) AS session_id,
  CASE e.vec_id % 5 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'world_fact' WHEN 2 THEN 'task_context' WHEN 3 THEN 'agent_belief' END AS category,
  CAST(NULL AS @STR) AS episode_summary"""

VIEWS = {
    "records": "SELECT e.vec_id AS id, " + _COMMON_RECORD + " FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id JOIN events v ON v.event_id = e.vec_id",
    "edges": """
SELECT vec_id AS id, vec_id AS from_id, (vec_id * 7 + 3) % n AS to_id,
  CASE vec_id % 4 WHEN 0 THEN 'supersedes' WHEN 1 THEN 'elaborates' WHEN 2 THEN 'contradicts' ELSE 'consolidates' END AS type,
  CAST(1 + vec_id % 10 AS DOUBLE) AS stability, @BACK(DAY, (vec_id * 5) % 20) AS last_accessed_at, TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM embeddings, (SELECT count(*) AS n FROM embeddings) c""",
    "queries": "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0",
    "entities": """
SELECT id, lower(name) AS name, type, embedding, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM (
  SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), n_name, 'nation' FROM nation
  UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), s_name, 'supplier' FROM supplier
  UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), c_name, 'customer' FROM customer) x
CROSS JOIN (SELECT count(*) AS n FROM embeddings) c JOIN embeddings e ON e.vec_id = x.id % c.n""",
    "entity_edges": """
SELECT CAST(1000 + s_suppkey AS BIGINT) AS id, CAST(1000 + s_suppkey AS BIGINT) AS from_id, CAST(100 + s_nationkey AS BIGINT) AS to_id, 'located_in' AS type, CAST(1.0 AS DOUBLE) AS weight FROM supplier
UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), CAST(1000000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), 'lives_in', CAST(1.0 AS DOUBLE) FROM customer
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 'part_of', CAST(0.5 AS DOUBLE) FROM nation
UNION ALL SELECT CAST(10000000 + s_suppkey AS BIGINT), CAST(1000 + s_suppkey AS BIGINT), CAST(1000 + (s_suppkey * 7 + 3) % n + m AS BIGINT), 'trades_with', CAST(2.0 AS DOUBLE)
  FROM supplier, (SELECT count(*) AS n, min(s_suppkey) AS m FROM supplier) c""",
    "links": """
SELECT e.vec_id AS id, x.id AS entity_id, e.vec_id AS record_id, TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM embeddings e, (SELECT count(*) AS n, min(s_suppkey) AS m FROM supplier) c JOIN entities x ON x.type = 'supplier' AND x.id = 1000 + m + e.vec_id % n
WHERE e.vec_id % 3 <> 0""",
    "supplier_pairs": """
SELECT DISTINCT CAST(1000 + a.l_suppkey AS BIGINT) AS from_id, CAST(1000 + b.l_suppkey AS BIGINT) AS to_id
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""",
    "insights": """
SELECT CAST(event_id AS @STR) AS id, concat(event_type, ' by user ', CAST(user_id AS @STR)) AS summary, concat('/ctx/', CAST(event_id AS @STR), '.txt') AS context_file,
  @ARRAY(event_type, concat('user:', CAST(user_id AS @STR)), CASE event_id % 50 WHEN 0 THEN 'permanently_skipped' WHEN 1 THEN 'llm_rate_limited' ELSE 'observation' END) AS tags,
  CAST(ts AS TIMESTAMP) AS ts, event_id % 3 = 0 AS processed, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS safe_to_delete FROM events""",
    "llm_scores": """
SELECT CAST(event_id AS @STR) AS insight_id, concat('{"action": "', CASE event_id % 5 WHEN 0 THEN 'insert' WHEN 1 THEN 'relate' WHEN 2 THEN 'skip' WHEN 3 THEN 'insert' ELSE 'ponder' END, '"',
  ', "importanceScore": ', CAST(CAST(user_id % 140 AS DOUBLE) / 100 AS @STR), CASE WHEN event_id % 2 = 0 THEN concat(', "goalRelevance": ', CAST(CAST(event_id % 120 AS DOUBLE) / 100 AS @STR)) ELSE '' END,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(', "targetId": "', CAST(event_id % 400 AS @STR), '"') END,
  ', "edgeType": "', CASE event_id % 3 WHEN 0 THEN 'elaborates' WHEN 1 THEN 'contradicts' ELSE 'likes' END, '"',
  ', "entities": [{"name": "User', CAST(user_id AS @STR), '", "type": " Person "}, {"name": "', event_type, '", "type": ""}]}') AS raw FROM events""",
    "phases": """
SELECT conv_id, turn AS seq, concat('call ', CAST(turn AS @STR)) AS tool_call, text AS tool_result, role AS agent_reaction FROM conversations""",
}


def spark_sql(name: str) -> str:
    text = VIEWS[name].replace("@STR", "STRING").replace("@ARRAY", "array")
    return _back(text, lambda unit, n: f"timestampadd({unit}, CAST(-({n}) AS INT), TIMESTAMP '{AS_OF}')")


def duckdb_sql(name: str) -> str:
    text = VIEWS[name].replace("@STR", "VARCHAR").replace("@ARRAY", "list_value")
    return _back(text, lambda unit, n: f"(TIMESTAMP '{AS_OF}' - to_{unit.lower()}s(CAST({n} AS INTEGER)))")


def _back(text: str, render) -> str:
    while "@BACK(" in text:
        start = text.index("@BACK(")
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
            if not depth:
                break
        unit, n = text[start + 6 : end - 1].split(", ", 1)
        text = text[:start] + render(unit, n) + text[end:]
    return text


NEEDS = {"links": ("entities",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One memory table over the data in ``sf_dir``."""
    base = ("embeddings", "documents", "events", "region", "nation", "supplier", "customer", "conversations", "lineitem")
    text = spark_sql(name)
    frames = {t: read(spark, sf_dir, t) for t in base if f" {t}" in text} | {n: view(spark, sf_dir, n) for n in NEEDS.get(name, ())}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in frames:
        for before in ("FROM", "JOIN"):
            text = text.replace(f"{before} {t}", f"{before} {{{t}}}")
    return spark.sql(text, **frames)


def prelude(*names: str) -> str:
    """WITH clause of the DuckDB twins of these views."""
    wanted = [n for n in VIEWS if n in names or any(n in NEEDS.get(m, ()) for m in names)]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({duckdb_sql(n)})" for n in wanted)
