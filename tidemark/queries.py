"""Registered queries over the fixture views, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X
from tidemark.operators import consolidate, entities, graph, recall, salience, serialize
from tidemark.operators.filters import RecallOptions, candidates, live, lookup
from tidemark.sources import fixtures, store, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RECALL = RecallOptions(threshold=0.05, min_results=6, limit=60, tags=[], tier=None)
FILTERED = RecallOptions(
    tier="episodic", min_importance=0.2, after=datetime(2024, 1, 2), before=datetime(2024, 1, 30), min_stability=2.0, min_access_count=1,
    session_id=fixtures.SESSION, category=fixtures.CATEGORY,
)


def query(sql: str | None = None, views: tuple[str, ...] = (), name: str | None = None):
    """Register a function of the named views; ``sql`` is its twin over the same views."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(*(fixtures.view(spark, sf_dir, v) for v in views))
        if sql is not None:
            ORACLE[key] = f"{fixtures.prelude(*views)}{SQL_PARTS.get(key, '')} {sql}"
        return f

    return register


SQL_PARTS: dict[str, str] = {}
AS_OF = f"TIMESTAMP '{fixtures.AS_OF}'"


def sql_retention(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return f"exp(-((epoch_us({AS_OF}) - epoch_us({a}last_accessed_at)) / 86400000000.0::DOUBLE) / {a}stability)"


def sql_cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


SCORED = f", live AS (SELECT * FROM records WHERE NOT tombstoned), scored AS (SELECT query_id, id, {sql_cosine('vector', 'embedding')} AS sim, {sql_retention()} AS ret FROM live, queries)"
RANKED = SCORED + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS semantic_rank, row_number() OVER (PARTITION BY query_id ORDER BY sim * ret DESC, id) AS temporal_rank FROM scored)"
REACHED = RANKED + f""", reached AS (
  SELECT query_id, to_id AS id, greatest(0, coalesce(max(CASE WHEN e.type <> 'contradicts' THEN r.sim * {sql_retention('e')} * 0.7::DOUBLE END), 0)) AS assoc_score,
         row_number() OVER (PARTITION BY query_id ORDER BY min(row(semantic_rank, e.id))) AS assoc_rank
  FROM ranked r JOIN edges e ON e.from_id = r.id WHERE semantic_rank <= 10 AND to_id IN (SELECT id FROM live) GROUP BY query_id, to_id)"""
SUPERSEDERS = f", superseders AS (SELECT to_id AS id, list(from_id ORDER BY id) AS by_ids FROM edges WHERE type = 'supersedes' AND {sql_retention()} > 0.3 GROUP BY to_id)"
FUSED = REACHED + SUPERSEDERS + """, fused AS (
  SELECT query_id, id, coalesce(r.sim, a.assoc_score) AS sim, s.ret, coalesce(r.sim, a.assoc_score) * s.ret AS eff, semantic_rank, temporal_rank, assoc_rank,
         coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + temporal_rank), 0) + coalesce(1 / (60 + assoc_rank), 0) AS rrf, by_ids
  FROM ranked r FULL JOIN reached a USING (query_id, id) JOIN scored s USING (query_id, id) LEFT JOIN superseders USING (id))"""


def sql_results(threshold: float, min_results: int, limit: int, key: str = "eff") -> str:
    """CTEs up to ``results`` of a recall without filters, in the order of ``key``."""

    def brought(name: str, rows: str, shown: str, order: str) -> str:
        return f""", {name}_named AS (SELECT query_id, {order} AS o, unnest(by_ids) AS id, unnest(range(len(by_ids))) AS p FROM {rows} WHERE len(by_ids) > 0),
{name} AS (SELECT query_id, n.id, s.sim * s.ret AS eff, row_number() OVER (PARTITION BY query_id ORDER BY min(row(o, p))) AS injected FROM {name}_named n JOIN scored s USING (query_id, id)
  WHERE (query_id, n.id) NOT IN (SELECT (query_id, id) FROM {shown}) GROUP BY query_id, n.id, s.sim, s.ret)"""

    stable = "row(coalesce(semantic_rank, 2147483647), coalesce(assoc_rank, 2147483647))"
    return (
        FUSED + f", passing AS (SELECT * FROM fused WHERE eff >= {threshold})" + brought("companions", "passing", "passing", stable)
        + f""", shown AS (SELECT query_id, id, eff, rrf, by_ids, semantic_rank, assoc_rank, 0 AS injected, 0 AS section, 0 AS place FROM passing
  UNION ALL SELECT query_id, id, eff, 0, NULL, NULL, NULL, injected, 0, 0 FROM companions),
have AS (SELECT query_id, count(shown.id) AS n FROM queries LEFT JOIN shown USING (query_id) GROUP BY query_id),
more AS (SELECT * FROM (SELECT f.*, n, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, semantic_rank NULLS LAST, assoc_rank) AS place FROM fused f JOIN have USING (query_id)
  WHERE n < {min_results} AND eff < {threshold} AND sim > 0.05) WHERE place <= {min_results} - n),
all_shown AS (SELECT query_id, id FROM shown UNION ALL SELECT query_id, id FROM more)"""
        + brought("late", "more", "all_shown", "place")
        + f""", every AS (SELECT * FROM shown UNION ALL SELECT query_id, id, eff, rrf, by_ids, semantic_rank, assoc_rank, 0, 1, place FROM more
  UNION ALL SELECT query_id, id, eff, 0, NULL, NULL, NULL, injected, 2, injected FROM late),
results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section, place, CASE WHEN section = 0 THEN {key} END DESC, semantic_rank NULLS LAST, assoc_rank NULLS LAST, injected) AS position FROM every JOIN (SELECT id, importance, stability, last_accessed_at FROM records) USING (id)) WHERE position <= {limit})"""
    )


RESULTS = sql_results(0.05, 6, 60)
TOP_UP = sql_results(0.45, 12, 60)
SQL_PARTS |= {k: SCORED for k in ("cosine_topk", "effective_score")}
SQL_PARTS |= {k: RANKED for k in ("rank_semantic", "rank_temporal", "rank_entity")}
SQL_PARTS |= {"rank_associative": REACHED, "rrf_fusion": FUSED, "decay_events": FUSED, "edge_strengthen_updates": FUSED, "superseded_lookup": SUPERSEDERS}
SQL_PARTS |= {k: RESULTS for k in ("recall_full", "recall_entities", "strengthen_updates", "relevance_serialize", "context_merge", "context_boost", "companion_injection", "recall_enrichment")}
SQL_PARTS["related_lookup"] = sql_results(0.05, 0, 3)
SORTED = {"importance": "importance", "recency": "last_accessed_at", "stability": "stability"}
SQL_PARTS |= {f"recall_by_{k}": sql_results(0.05, 6, 60, key) for k, key in SORTED.items()} | {"recall_strategies": sql_results(0.05, 6, 60)}
SQL_PARTS |= {"recall_topup": TOP_UP}



def _r(x):
    """Six digits, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)



# Scans, filters and writes


@query("SELECT id, tier, importance, stability, session_id, category FROM records WHERE NOT tombstoned", ("records",))
def live_scan(records):
    return live(records).select("id", "tier", "importance", "stability", "session_id", "category")


@query("SELECT id, tombstoned, CASE WHEN NOT tombstoned THEN data END AS data, tombstoned_at FROM records WHERE id IN (37, 38)", ("records",))
def point_lookup(records):
    return lookup(records, [37, 38]).select("id", "tombstoned", "data", "tombstoned_at")


@query("SELECT id, created_at, tier FROM records WHERE NOT tombstoned ORDER BY created_at DESC, id LIMIT 20", ("records",))
def recent_topk(records):
    return live(records).select("id", "created_at", "tier").orderBy(F.desc("created_at"), "id").limit(20)


@query(
    f"""SELECT id FROM records WHERE NOT tombstoned AND tier = 'episodic' AND importance >= 0.2 AND created_at > TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-30'
  AND stability >= 2 AND access_count >= 1 AND session_id = '{fixtures.SESSION}' AND category = '{fixtures.CATEGORY}'""",
    ("records",),
)
def filter_all_options(records):
    return candidates(records, FILTERED).select("id")


@query("SELECT id FROM records WHERE NOT tombstoned AND list_has_all(from_json(json_extract(metadata, '$.tags'), '[\"VARCHAR\"]'), ['click', 'lang:en'])", ("records",))
def filter_tags_all(records):
    return candidates(records, RecallOptions(tags=["click", "lang:en"])).select("id")


@query("SELECT id FROM records WHERE NOT tombstoned AND contains(lower(json_extract_string(metadata, '$.entities[0].name')), 'label1') AND json_extract_string(metadata, '$.entities[0].type') = 'concept'", ("records",))
def filter_entity_exists(records):
    return live(records).where(X.has_entity(X.entities_of(F.col("metadata")), "LABEL1", " Concept ")).select("id")


@query("SELECT id, regexp_matches(session_id, '^[0-9A-Za-z][0-9A-Za-z_-]{0,127}$') AS valid, regexp_matches('-' || session_id, '^[0-9A-Za-z][0-9A-Za-z_-]{0,127}$') AS prefixed, regexp_matches(session_id || chr(10), '^[0-9A-Za-z][0-9A-Za-z_-]{0,127}$') AS broken FROM records", ("records",))
def session_id_valid(records):
    return records.select("id", X.valid_session_id(F.col("session_id")).alias("valid"), X.valid_session_id(F.concat(F.lit("-"), "session_id")).alias("prefixed"), X.valid_session_id(F.concat("session_id", F.lit("\n"))).alias("broken"))


def _insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = fixtures.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 13 / F.lit(10.0)).alias("importance"))
    numbered = store.number_rows(new, "event_id", 1000).withColumn("tier", F.when(F.col("id") % 5 == 0, "semantic").otherwise("episodic"))
    return numbered.select("id", "tier", "importance", X.initial_stability(F.col("importance")).alias("stability"))


ORACLE["insert_rows"] = """SELECT id, CASE WHEN id % 5 = 0 THEN 'semantic' ELSE 'episodic' END AS tier, importance, 1 + 9 * importance AS stability
FROM (SELECT 1000 + row_number() OVER (ORDER BY event_id) AS id, (event_id % 13)::DOUBLE / 10 AS importance FROM events)"""
QUERIES["insert_rows"] = _insert_rows


@query(
    """SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE data END AS data, tombstoned OR id % 3 = 0 AS tombstoned FROM records""",
    ("records",),
)
def tombstone_rows(records):
    return store.tombstone(records, records.where("id % 3 = 0").select("id"), fixtures.as_of()).select("id", "data", "tombstoned")


@query("SELECT 'records' AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM records WHERE id % 4 <> 1 UNION ALL SELECT 'edges', count(*), sum(id)::BIGINT FROM edges WHERE from_id % 4 <> 1 AND to_id % 4 <> 1", ("records", "edges"))
def delete_cascade(records, edges):
    kept, linked = store.delete(records, edges, records.where("id % 4 = 1").select("id"))
    total = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    return total(kept, "records").unionByName(total(linked, "edges"))


@query(
    """SELECT id, k AS key, json_extract(m, '$."' || k || '"')::VARCHAR AS value FROM (
  SELECT id, m, unnest(json_keys(m)) AS k FROM (SELECT id, json_merge_patch(metadata, '{"confidence": 0.25, "source": "patched"}') AS m FROM records WHERE NOT tombstoned))""",
    ("records",),
)
def metadata_patch(records):
    merged = live(records).select("id", F.explode(F.from_json(X.merge_metadata(F.col("metadata"), F.lit('{"confidence": 0.25, "source": "patched"}')), "map<string,variant>")))
    return merged.select("id", "key", F.to_json("value").alias("value"))


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 99.5 ELSE stability END AS stability, CASE WHEN id % 6 = 0 THEN access_count + 1 ELSE access_count END AS access_count FROM records", ("records",))
def stability_update(records):
    updates = records.where("id % 6 = 0").select("id", F.lit(99.5).alias("stability"), (F.col("access_count") + 1).alias("access_count"))
    return store.apply_updates(records, updates).select("id", "stability", "access_count")


@query("SELECT e.id, from_id, to_id, type FROM edges e WHERE from_id = 3 OR to_id = 3", ("edges",))
def edge_lookup(edges):
    return graph.touching(edges, [3]).select("id", "from_id", "to_id", "type")


@query("SELECT x.id AS from_id, x.id * 2 AS to_id, 1 + 9 * r.importance AS stability FROM records x JOIN records r ON r.id = x.id WHERE x.id * 2 IN (SELECT id FROM records)", ("records",))
def relate_edges(records):
    wanted = records.select(F.col("id").alias("from_id"), (F.col("id") * 2).alias("to_id"), F.lit("elaborates").alias("type"))
    return store.relate(records, wanted).select("from_id", "to_id", "stability")


@query("SELECT sum(id)::BIGINT AS ids, count(*) AS n, count(*) FILTER (tombstoned) AS tombstoned FROM records", ("records",))
def snapshot_fork(records):
    base = graph.scratch_path(records.sparkSession)
    whole = store.Store(records.sparkSession, f"{base}/a")
    whole.commit(records=records)
    fork = whole.fork(f"{base}/b")
    whole.commit(records=records.limit(0))
    return fork.read("records").agg(F.sum("id").alias("ids"), F.count("*").alias("n"), F.count_if("tombstoned").alias("tombstoned"))


# Scores and ranked lists


@query("SELECT query_id, id, round(sim, 6) + 0 AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS n FROM scored) WHERE n <= 10", ("records", "queries"))
def cosine_topk(records, queries):
    scored = recall.score(live(records), queries, fixtures.as_of())
    return recall.positions(scored, "query_id", "sim", "id", "n").where("n <= 10").select("query_id", "id", _r("sim").alias("sim"))


@query(f"SELECT id, round({sql_retention()}, 6) AS retention, round(1 + 2 * (1 - {sql_retention()}), 6) AS growth FROM records", ("records",))
def retention_decay(records):
    kept = X.retention(F.col("last_accessed_at"), F.col("stability"), fixtures.as_of())
    return records.select("id", F.round(kept, 6).alias("retention"), F.round(X.growth(kept), 6).alias("growth"))


@query("SELECT query_id, id, round(sim * ret, 6) + 0 AS effective_score FROM scored WHERE sim * ret >= 0.05", ("records", "queries"))
def effective_score(records, queries):
    scored = recall.score(live(records), queries, fixtures.as_of()).withColumn("e", F.col("sim") * F.col("ret"))
    return scored.where("e >= 0.05").select("query_id", "id", _r("e").alias("effective_score"))


def _lists(records, edges, queries, options=RECALL):
    return recall.recall(records, edges, queries, options, fixtures.as_of())


RECALL_VIEWS = ("records", "edges", "queries")


@query("SELECT query_id, id, semantic_rank AS rank FROM ranked", ("records", "edges", "queries"))
def rank_semantic(records, edges, queries):
    return _lists(records, edges, queries).lists.where("list = 'semantic'").select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT query_id, id, temporal_rank AS rank FROM ranked", RECALL_VIEWS)
def rank_temporal(records, edges, queries):
    return _lists(records, edges, queries).lists.where("list = 'temporal'").select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT query_id, id, assoc_rank AS rank, round(assoc_score, 6) AS assoc_score FROM reached", RECALL_VIEWS)
def rank_associative(records, edges, queries):
    scored = recall.score(live(records), queries, fixtures.as_of())
    reached = recall.spread(recall.positions(scored, "query_id", "sim", "id", "semantic_rank"), edges, records, fixtures.as_of())
    return reached.select("query_id", "id", F.col("assoc_rank").cast("long").alias("rank"), F.round("assoc_score", 6).alias("assoc_score"))


@query(
    """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM ranked JOIN records USING (id)
WHERE contains(lower(json_extract_string(metadata, '$.entities[0].name')), 'label2')""",
    RECALL_VIEWS,
)
def rank_entity(records, edges, queries):
    return _lists(records, edges, queries, RecallOptions(threshold=0.05, entity_name="label2")).lists.where("list = 'entity'").select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT query_id, id, round(rrf, 9) AS rrf_score, round(eff, 6) + 0 AS effective_score FROM fused", RECALL_VIEWS)
def rrf_fusion(records, edges, queries):
    return _lists(records, edges, queries).fused.select("query_id", "id", F.round("rrf_score", 9).alias("rrf_score"), _r("effective_score").alias("effective_score"))


_RESULT_SQL = """SELECT query_id, position, id, round(eff, 6) + 0 AS effective_score, round(rrf, 9) AS rrf_score, coalesce(len(by_ids), 0) > 0 AS is_superseded,
  coalesce(array_to_string(by_ids, ','), '') AS superseding_ids, section FROM results"""


def _results(r):
    return r.results.select(
        "query_id", F.col("position").cast("long").alias("position"), "id", _r("effective_score").alias("effective_score"), F.round("rrf_score", 9).alias("rrf_score"), "is_superseded",
        F.array_join(F.col("superseding_ids").cast("array<string>"), ",").alias("superseding_ids"), "section",
    )


@query(_RESULT_SQL, RECALL_VIEWS)
def recall_full(records, edges, queries):
    return _results(_lists(records, edges, queries))


@query(_RESULT_SQL, RECALL_VIEWS)
def recall_topup(records, edges, queries):
    return _results(_lists(records, edges, queries, RecallOptions(threshold=0.45, min_results=12, limit=60)))


for _sort in SORTED:
    query(_RESULT_SQL, RECALL_VIEWS, f"recall_by_{_sort}")(lambda records, edges, queries, sort=_sort: _results(_lists(records, edges, queries, RecallOptions(threshold=0.05, min_results=6, limit=60, sort=sort))))


@query(
    """SELECT query_id, position, id, CASE WHEN injected > 0 THEN 'companion' ELSE concat_ws(',', CASE WHEN semantic_rank IS NOT NULL THEN 'semantic,temporal' END, CASE WHEN assoc_rank IS NOT NULL THEN 'associative' END) END AS strategies FROM results""",
    RECALL_VIEWS,
)
def recall_strategies(records, edges, queries):
    return _lists(records, edges, queries).results.select("query_id", F.col("position").cast("long").alias("position"), "id", F.array_join("strategies", ",").alias("strategies"))


@query("SELECT id, array_to_string(by_ids, ',') AS superseding_ids FROM superseders", ("edges",))
def superseded_lookup(edges):
    return recall.superseders(edges, fixtures.as_of()).select("id", F.array_join(F.col("superseding_ids").cast("array<string>"), ",").alias("superseding_ids"))


@query("SELECT query_id, id, round(eff, 6) + 0 AS effective_score, injected FROM companions", RECALL_VIEWS)
def companion_injection(records, edges, queries):
    r = _lists(records, edges, queries, RecallOptions(threshold=0.05))
    passing = r.fused.where("effective_score >= 0.05")
    order = [F.coalesce("semantic_rank", F.lit(2**31 - 1)).alias("a"), F.coalesce("assoc_rank", F.lit(2**31 - 1)).alias("b")]
    everyone = recall.score(live(records), queries, fixtures.as_of())
    brought = recall.companions(passing, passing, lambda pairs: everyone.join(pairs, ["query_id", "id"], "left_semi"), order)
    return brought.select("query_id", "id", _r(F.col("sim") * F.col("ret")).alias("effective_score"), F.col("injected").cast("long").alias("injected"))


@query(
    f"""SELECT query_id, id, round(least(365, greatest(0.5, r.stability * (1 + 2 * (1 - {sql_retention('r')})) * CASE WHEN top > 0 THEN rrf / top ELSE 1 END * CASE WHEN reached.id IS NOT NULL THEN 0.5 ELSE 1 END)), 6) AS stability, access_count + 1 AS access_count
FROM (SELECT *, first_value(rrf) OVER (PARTITION BY query_id ORDER BY position) AS top FROM results WHERE section = 0) x JOIN records r USING (id) LEFT JOIN reached USING (query_id, id)""",
    RECALL_VIEWS,
)
def strengthen_updates(records, edges, queries):
    return _lists(records, edges, queries).record_updates.select("query_id", "id", F.round("stability", 6).alias("stability"), "access_count")


@query(f"SELECT query_id, e.id, round(least(365, e.stability * (1 + 2 * (1 - {sql_retention('e')}))), 6) AS stability FROM edges e JOIN fused f ON f.id = e.to_id WHERE type = 'supersedes' AND eff >= 0.05", RECALL_VIEWS)
def edge_strengthen_updates(records, edges, queries):
    return _lists(records, edges, queries).edge_updates.select("query_id", "id", F.round("stability", 6).alias("stability"))


@query("SELECT query_id, id, round(ret, 6) AS retention FROM fused WHERE ret < 0.2", RECALL_VIEWS)
def decay_events(records, edges, queries):
    return _lists(records, edges, queries).decayed.select("query_id", "id", F.round("retention", 6).alias("retention"))


@query(
    """SELECT query_id, part, position, kind, id, replaced_id FROM (
  SELECT query_id, 0 AS part, position, CASE WHEN c IS NULL THEN 'superseded' ELSE 'changed' END AS kind, coalesce(c, id) AS id, CASE WHEN c IS NOT NULL THEN id END AS replaced_id
  FROM (SELECT r.*, list_filter(by_ids, lambda x: EXISTS (SELECT 1)) AS unused, (SELECT arg_min(n.i, n.p) FROM (SELECT unnest(r.by_ids) AS i, unnest(range(len(r.by_ids))) AS p) n JOIN results k ON k.id = n.i AND k.query_id = r.query_id AND k.injected > 0) AS c
        FROM results r WHERE injected = 0 AND len(by_ids) > 0)
  UNION ALL SELECT query_id, 1, position, 'memory', id, NULL FROM results WHERE injected = 0 AND coalesce(len(by_ids), 0) = 0
  UNION ALL SELECT query_id, 2, position, 'memory', id, NULL FROM results k WHERE injected > 0 AND NOT EXISTS (
    SELECT 1 FROM (SELECT r.query_id, (SELECT arg_min(n.i, n.p) FROM (SELECT unnest(r.by_ids) AS i, unnest(range(len(r.by_ids))) AS p) n JOIN results q ON q.id = n.i AND q.query_id = r.query_id AND q.injected > 0) AS c
      FROM results r WHERE injected = 0 AND len(by_ids) > 0) u WHERE u.query_id = k.query_id AND u.c = k.id))""".replace("list_filter(by_ids, lambda x: EXISTS (SELECT 1)) AS unused, ", ""),
    RECALL_VIEWS,
)
def relevance_serialize(records, edges, queries):
    return serialize.serialize(_lists(records, edges, queries).results).withColumn("position", F.col("position").cast("long"))


_MERGED = """SELECT id, n AS context_position, eff, r.session_id, r.category FROM (
  SELECT *, row_number() OVER (ORDER BY eff DESC, query_id, position) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_id, position) AS seen FROM results) WHERE seen = 1) x JOIN records r USING (id) WHERE n <= 5"""


def _merged(records, edges, queries):
    rows = _lists(records, edges, queries).results.withColumnRenamed("query_id", "list_no")
    return serialize.merge_context(rows, fixtures.SESSION, fixtures.CATEGORY)


@query(f"SELECT id, context_position FROM ({_MERGED})", RECALL_VIEWS)
def context_merge(records, edges, queries):
    return _merged(records, edges, queries).select("id", "context_position")


@query(
    f"""SELECT id, round(CASE WHEN gain > 0 THEN least(1, eff + gain) ELSE eff END, 6) AS effective_score FROM (
  SELECT *, CASE WHEN session_id = '{fixtures.SESSION}' THEN 0.15 ELSE 0 END + CASE WHEN category = '{fixtures.CATEGORY}' THEN 0.10 ELSE 0 END AS gain FROM ({_MERGED}))""",
    RECALL_VIEWS,
)
def context_boost(records, edges, queries):
    return _merged(records, edges, queries).select("id", _r("effective_score").alias("effective_score"))


# Statistics, clusters, maintenance


@query(f"SELECT count(*) FILTER (NOT tombstoned) AS total, count(*) FILTER (NOT tombstoned AND tier = 'episodic') AS episodic, count(*) FILTER (NOT tombstoned AND tier = 'semantic') AS semantic, count(*) FILTER (tombstoned) AS tombstoned, round(avg(stability) FILTER (NOT tombstoned), 6) AS avg_stability, round(avg({sql_retention()}) FILTER (NOT tombstoned), 6) AS avg_retention FROM records", ("records",))
def ltm_stats(records):
    s = consolidate.stats(records, fixtures.as_of())
    return s.select("total", "episodic", "semantic", "tombstoned", F.round("avg_stability", 6).alias("avg_stability"), F.round("avg_retention", 6).alias("avg_retention"))


@query(f"SELECT count(*) AS pending, round(avg((epoch_us({AS_OF}) - epoch_us(ts)) / 1000.0::DOUBLE), 3) AS avg_age_ms, max((epoch_us({AS_OF}) - epoch_us(ts)) / 1000.0::DOUBLE) AS max_age_ms FROM insights WHERE NOT processed", ("insights",))
def stm_stats(insights):
    return salience.stm_stats(insights, fixtures.as_of()).select("pending", F.round("avg_age_ms", 3).alias("avg_age_ms"), "max_age_ms")


PAIRS = f"SELECT a.id AS a, b.id AS b FROM cands a JOIN cands b ON a.id < b.id AND {sql_cosine('a.embedding', 'b.embedding')} >= 0.3"
CANDS = ", cands AS (SELECT id, embedding, created_at FROM records WHERE NOT tombstoned AND tier = 'episodic' AND access_count >= 2)"
SQL_PARTS |= {k: CANDS for k in ("similarity_pairs", "consolidation_candidates", "greedy_clusters")}


@query("SELECT id FROM cands", ("records",))
def consolidation_candidates(records):
    return consolidate.consolidation_candidates(records).select("id")


@query(PAIRS, ("records",))
def similarity_pairs(records):
    return consolidate.similar_pairs(consolidate.consolidation_candidates(records), 0.3)


@query(
    f""", pairs AS ({PAIRS}), p AS (SELECT list(a * 10000000 + b) AS near, list_sort(list_distinct(list_concat(list(a), list(b)))) AS ids FROM pairs),
scan AS (SELECT []::BIGINT[] AS members, ids AS rest FROM p UNION ALL
  SELECT members, list_filter(rest[2:], lambda x: NOT list_contains(members, x)) FROM (
    SELECT rest, list_reduce(list_transform(list_filter(rest[2:], lambda x: list_contains(near, rest[1] * 10000000 + x)), lambda x: [x]),
      lambda m, y: CASE WHEN len(list_filter(m, lambda z: NOT list_contains(near, z * 10000000 + y[1]))) = 0 THEN list_concat(m, y) ELSE m END, [rest[1]]) AS members
    FROM scan, p WHERE len(rest) > 0))
SELECT members[1] AS cluster_id, unnest(members) AS id FROM scan WHERE len(members) > 1""",
    ("records",),
)
def greedy_clusters(records):
    return consolidate.greedy_clusters(consolidate.similar_pairs(consolidate.consolidation_candidates(records), 0.3))


#: A clustering that SQL can name, for what follows clustering: 40 records of consecutive ids.
GROUPED = "SELECT id // 40 AS cluster_id, id, created_at, importance, stability FROM records WHERE NOT tombstoned AND tier = 'episodic'"


def _grouped(records):
    return live(records).where("tier = 'episodic'").select(F.floor(F.col("id") / 40).alias("cluster_id"), "id", "created_at")


@query(
    f"""SELECT cluster_id, CASE WHEN wide AND n >= cut THEN 1 ELSE 0 END AS part, id FROM (
  SELECT *, max(created_at) OVER c - min(created_at) OVER c > INTERVAL 10 DAYS AS wide, first_value(n) OVER (PARTITION BY cluster_id ORDER BY gap DESC NULLS LAST, n) AS cut FROM (
    SELECT cluster_id, id, created_at, row_number() OVER t AS n, epoch_us(created_at) - lag(epoch_us(created_at)) OVER t AS gap FROM ({GROUPED}) WINDOW t AS (PARTITION BY cluster_id ORDER BY created_at, id)) WINDOW c AS (PARTITION BY cluster_id))""",
    ("records",),
)
def temporal_split(records):
    return consolidate.temporal_split(_grouped(records), 10)


@query(
    f"""SELECT cluster_id, part, id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id, part) AS members FROM (SELECT cluster_id, CASE WHEN wide AND n >= cut THEN 1 ELSE 0 END AS part, id FROM (
  SELECT *, max(created_at) OVER c - min(created_at) OVER c > INTERVAL 10 DAYS AS wide, first_value(n) OVER (PARTITION BY cluster_id ORDER BY gap DESC NULLS LAST, n) AS cut FROM (
    SELECT cluster_id, id, created_at, row_number() OVER t AS n, epoch_us(created_at) - lag(epoch_us(created_at)) OVER t AS gap FROM ({GROUPED}) WINDOW t AS (PARTITION BY cluster_id ORDER BY created_at, id)) WINDOW c AS (PARTITION BY cluster_id)))) WHERE members >= 12""",
    ("records",),
)
def large_clusters(records):
    return consolidate.large_parts(consolidate.temporal_split(_grouped(records), 10), 12)


def _consolidated(records):
    members = _grouped(records).select("cluster_id", "id")
    summaries = members.select("cluster_id").distinct().select(
        "cluster_id", F.concat(F.lit("summary "), F.col("cluster_id").cast("string")).alias("summary"), (F.col("cluster_id") % 10 / F.lit(10.0)).alias("confidence"),
        F.array(F.lit("fact")).alias("preserved_facts"), F.array(F.lit("doubt")).alias("uncertainties"),
    )
    return consolidate.consolidate(records, consolidate.gate(summaries)[0], members, fixtures.as_of(), 1_000_000)


@query(f"SELECT 999999 + row_number() OVER (ORDER BY cluster_id) AS id, 'summary ' || cluster_id AS data, max(importance) AS importance, round(max(stability) * (1 + 0.5 * (cluster_id % 10) / 10), 6) AS stability FROM ({GROUPED}) WHERE cluster_id % 10 >= 5 GROUP BY cluster_id", ("records",))
def consolidate_rows(records):
    return _consolidated(records)[0].select("id", "data", "importance", F.round("stability", 6).alias("stability"))


@query(f"SELECT from_id, id AS to_id, 'consolidates' AS type, round(1 + 9 * top, 6) AS stability FROM (SELECT *, 999999 + dense_rank() OVER (ORDER BY cluster_id) AS from_id, max(importance) OVER (PARTITION BY cluster_id) AS top FROM ({GROUPED}) WHERE cluster_id % 10 >= 5)", ("records",))
def consolidate_edges(records):
    return _consolidated(records)[1].select("from_id", "to_id", "type", F.round("stability", 6).alias("stability"))


@query(f"SELECT id, stability / 2 AS stability FROM ({GROUPED}) WHERE cluster_id % 10 >= 5", ("records",))
def consolidate_deflate(records):
    return _consolidated(records)[2]


@query(
    f""", weak AS (SELECT id FROM records WHERE NOT tombstoned AND {sql_retention()} < 0.1), into_weak AS (SELECT from_id, to_id FROM edges WHERE type = 'consolidates' AND to_id IN (SELECT id FROM weak)),
kept AS (SELECT to_id AS id FROM into_weak WHERE NOT (from_id < to_id AND from_id IN (SELECT id FROM weak)) UNION SELECT to_id FROM into_weak JOIN kept ON kept.id = from_id)
SELECT id, CASE WHEN id IN (SELECT id FROM kept) THEN 'tombstone' ELSE 'delete' END AS action FROM weak""",
    ("records", "edges"),
)
def prune_partition(records, edges):
    return consolidate.prune(records, edges, fixtures.as_of())


@query(f"SELECT id FROM insights WHERE epoch_us({AS_OF}) - epoch_us(ts) <= 7 * 24 * 3600000000", ("insights",))
def pending_ttl(insights):
    return salience.purge_pending(insights.withColumnRenamed("ts", "created_at"), fixtures.as_of(), 7 * 24).select("id")


# Entity graph and resolution


@query(
    """, walk AS (SELECT id AS start_id, id, 0 AS hops FROM entities WHERE type = 'supplier' UNION SELECT start_id, to_id, hops + 1 FROM walk JOIN entity_edges ON from_id = walk.id WHERE hops < 3)
SELECT start_id, id, min(hops) AS hops FROM walk WHERE id <> start_id AND id IN (SELECT id FROM entities) GROUP BY start_id, id""",
    ("entities", "entity_edges"),
)
def entity_neighbors(ents, edges):
    return graph.neighbors(edges, ents, ents.where("type = 'supplier'").select(F.col("id").alias("start_id")), 3)


@query(
    """, walk AS (SELECT DISTINCT from_id AS start_id, from_id AS id, 0 AS hops FROM supplier_pairs UNION SELECT start_id, to_id, hops + 1 FROM walk JOIN entity_edges ON from_id = walk.id WHERE hops < 10),
least AS (SELECT start_id AS from_id, id AS to_id, min(hops) AS hops FROM walk GROUP BY ALL)
SELECT from_id, to_id, hops, CASE WHEN hops <= 5 THEN 'ok' ELSE 'degraded' END AS reliability FROM supplier_pairs JOIN least USING (from_id, to_id)""",
    ("supplier_pairs", "entity_edges"),
)
def entity_path_length(pairs, edges):
    """From the supplier of each order's first line to that of its second."""
    found = graph.path_lengths(edges, pairs)
    return found.select("from_id", "to_id", "hops", graph.reliability(F.col("hops")).alias("reliability"))


@query(
    """, walk AS (SELECT DISTINCT from_id AS start_id, from_id AS id, 0 AS hops, []::BIGINT[] AS taken, [from_id] AS nodes FROM supplier_pairs UNION ALL
  SELECT start_id, e.to_id, hops + 1, list_append(taken, e.id), list_append(nodes, e.to_id) FROM walk JOIN entity_edges e ON e.from_id = walk.id WHERE hops < 10 AND NOT list_contains(nodes, e.to_id))
SELECT p.from_id, p.to_id, min(hops)::BIGINT AS hops, arg_min(array_to_string(nodes, ','), row(hops, taken)) AS path
FROM supplier_pairs p JOIN walk ON start_id = p.from_id AND walk.id = p.to_id GROUP BY p.from_id, p.to_id""",
    ("supplier_pairs", "entity_edges"),
)
def entity_paths(pairs, edges):
    """The shortest path itself, of several the one with the smallest edge ids in order."""
    found = graph.shortest_paths(edges, pairs)
    return found.select("from_id", "to_id", F.col("hops").cast("long").alias("hops"), F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("SELECT id + 50000000 AS id, from_id, to_id, 'near' AS type FROM entity_edges WHERE id % 2 = 0", ("entity_edges",))
def edge_insert(edges):
    """Every edge again and, for even ids, a second time as another type, all of it twice."""
    again = edges.withColumn("type", F.when(F.col("id") % 2 == 0, "near").otherwise(F.col("type")))
    new = again.withColumn("id", F.col("id") + 50_000_000).unionByName(again.withColumn("id", F.col("id") + 60_000_000))
    return graph.new_edges(edges, new).select("id", "from_id", "to_id", "type")


@query("SELECT record_id, entity_id, name, type FROM links JOIN entities e ON e.id = entity_id", ("links", "entities"))
def entities_for_record(links, ents):
    return entities.entities_for_records(links, ents)


@query("SELECT id FROM records WHERE NOT tombstoned AND id NOT IN (SELECT record_id FROM links)", ("records", "links"))
def unlinked_records(records, links):
    return entities.processable(records, links).select("id")


@query(f"SELECT query_id AS probe_id, e.id AS entity_id, round({sql_cosine('vector', 'embedding')}, 6) AS sim FROM entities e, queries WHERE {sql_cosine('vector', 'embedding')} >= 0.2", ("entities", "queries"))
def entity_by_embedding(ents, queries):
    near = entities.near_entities(queries.withColumnRenamed("query_id", "probe_id"), ents, 0.2)
    return near.select("probe_id", "entity_id", _r("sim").alias("sim"))


#: Extracted entities: copies of suppliers, some renamed, some with a vector turned away.
EXTRACTED = """, extracted AS (SELECT id AS probe_id, CASE WHEN id % 3 = 0 THEN upper(name) ELSE name || ' ltd' END AS name,
  list_transform(embedding, lambda x, i: x + CASE WHEN i <= 32 AND id % 4 > 1 THEN (id % 4) * 0.06::FLOAT ELSE 0 END) AS vector FROM entities WHERE type = 'supplier')"""
RESOLVED = EXTRACTED + f""", near AS (SELECT x.probe_id, e.id AS entity_id, lower(e.name) = lower(x.name) AS same, {sql_cosine('x.vector', 'e.embedding')} AS sim FROM extracted x, entities e WHERE {sql_cosine('x.vector', 'e.embedding')} >= 0.7),
placed AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, entity_id) AS p FROM near),
resolved AS (SELECT probe_id, CASE WHEN bool_or(same) THEN 'exact' WHEN max(sim) >= 0.85 THEN 'merge' WHEN count(sim) > 0 THEN 'llm-needed' ELSE 'distinct' END AS decision,
  coalesce(arg_min(entity_id, p) FILTER (same), arg_min(entity_id, p)) AS entity_id FROM extracted LEFT JOIN placed USING (probe_id) GROUP BY probe_id)"""
SQL_PARTS |= {k: RESOLVED for k in ("entity_resolution", "entity_persist", "extraction_totals")}


def _extracted(ents):
    turned = F.transform("embedding", lambda x, i: x + F.when((i < 32) & (F.col("id") % 4 > 1), ((F.col("id") % 4) * F.lit(0.06).cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float")))
    return ents.where("type = 'supplier'").select(F.col("id").alias("probe_id"), F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.concat("name", F.lit(" ltd"))).alias("name"), turned.alias("vector"))


def _settled(ents):
    """Even probes' open cases are the same entity."""
    resolved = entities.resolve(_extracted(ents), ents)
    return entities.settle(resolved, ents.select(F.col("id").alias("probe_id"), (F.col("id") % 2 == 0).alias("same")))


@query("SELECT * FROM resolved", ("entities",))
def entity_resolution(ents):
    return entities.resolve(_extracted(ents), ents)


@query(
    """SELECT 9999999 + row_number() OVER (ORDER BY probe_id) AS id, lower(name) AS name FROM resolved JOIN extracted USING (probe_id) WHERE decision = 'distinct' OR decision = 'llm-needed' AND probe_id % 2 = 1""",
    ("entities",),
)
def entity_persist(ents):
    named = _extracted(ents).withColumns({"record_id": F.col("probe_id"), "type": F.lit("supplier")})
    none = named.select("record_id", F.col("name").alias("from_name"), F.col("name").alias("to_name"), "type").limit(0)
    return entities.persist(_settled(ents), named, none, 10_000_000)[0].select("id", "name")


@query(
    """SELECT count(*) AS records_processed, count(*) FILTER (decision = 'distinct' OR decision = 'llm-needed' AND probe_id % 2 = 1) AS entities_inserted,
  count(*) FILTER (decision IN ('exact', 'merge') OR decision = 'llm-needed' AND probe_id % 2 = 0) AS entities_reused FROM resolved""",
    ("entities",),
)
def extraction_totals(ents):
    return entities.totals(_extracted(ents), _settled(ents))


@query(
    """SELECT session_id AS group_id, string_agg(name, ',' ORDER BY first) AS names FROM (
  SELECT session_id, json_extract_string(metadata, '$.entities[0].name') AS name, min(id) AS first FROM records GROUP BY ALL) GROUP BY session_id""",
    ("records",),
)
def entity_union_dedup(records):
    lists = records.select(F.col("session_id").alias("group_id"), F.col("id").alias("list_no"), X.entities_of(F.col("metadata")).alias("entities"))
    return entities.union_entities(lists).select("group_id", F.array_join(F.col("entities.name"), ",").alias("names"))


@query(
    f"""SELECT id AS from_id, row_number() OVER (ORDER BY min(row(query_id, p))) AS seed_order FROM (
  SELECT query_id, e.id, row_number() OVER (PARTITION BY query_id ORDER BY {sql_cosine('vector', 'embedding')} DESC, e.id) AS p FROM entities e, queries WHERE {sql_cosine('vector', 'embedding')} >= 0.75) GROUP BY id""",
    ("queries", "entities"),
)
def hint_seeds(queries, ents):
    return entities.hint_seeds(queries.withColumnRenamed("query_id", "probe_id"), ents)


@query(
    f""", top AS (SELECT query_id, id FROM results WHERE position <= 3),
linked AS (SELECT t.query_id, t.id, l.id AS link_id, entity_id, {sql_cosine('q.vector', 'e.embedding')} AS near FROM top t JOIN queries q USING (query_id) JOIN links l ON l.record_id = t.id JOIN entities e ON e.id = l.entity_id),
chosen AS (SELECT query_id, id, arg_min(entity_id, row(-near, link_id)) AS selected_id FROM linked GROUP BY query_id, id),
seeds AS (SELECT id AS from_id, row_number() OVER (ORDER BY id) AS seed_order FROM entities WHERE type = 'supplier' QUALIFY seed_order <= 3),
walk AS (SELECT from_id AS start_id, from_id AS id, 0 AS hops FROM seeds UNION SELECT start_id, to_id, hops + 1 FROM walk JOIN entity_edges ON from_id = walk.id WHERE hops < 10),
best AS (SELECT w.id AS to_id, arg_min(start_id, row(hops, seed_order)) AS origin_id, min(hops) AS hops FROM walk w JOIN seeds ON from_id = start_id GROUP BY w.id)
SELECT query_id, c.id, selected_id, origin_id, hops, CASE WHEN coalesce(hops, 0) <= 5 THEN 'ok' ELSE 'degraded' END AS reliability FROM chosen c LEFT JOIN best ON to_id = selected_id""",
    ("records", "edges", "queries", "links", "entities", "entity_edges"),
)
def recall_enrichment(records, edges, queries, links, ents, entity_edges):
    first = ents.where("type = 'supplier'").select("id").orderBy("id").limit(3)
    seeds = first.select(F.col("id").alias("from_id"), F.row_number().over(recall.Window.orderBy("id")).alias("seed_order"))
    enriched = entities.enrich(_lists(records, edges, queries).results, queries, links, ents, entity_edges, seeds)
    return enriched.select("query_id", "id", "selected_id", "origin_id", "hops", "reliability")


@query(
    """SELECT query_id, r.id, CASE WHEN position <= 3 THEN names END AS names FROM results r LEFT JOIN (
  SELECT record_id, string_agg(name, ',' ORDER BY l.id) AS names FROM links l JOIN entities e ON e.id = entity_id GROUP BY record_id) ON record_id = r.id""",
    ("records", "edges", "queries", "links", "entities"),
)
def recall_entities(records, edges, queries, links, ents):
    """Every result, the first three with the entities that they link to."""
    results = _lists(records, edges, queries).results
    top = results.where(F.col("position") <= S.ENRICHED_ROWS).select("query_id", "id").join(links.select(F.col("record_id").alias("id")).distinct(), "id")
    named = entities.with_entities(results.select("query_id", "id"), top, links, ents)
    return named.select("query_id", "id", F.array_join("entities.name", ",").alias("names"))


# Short-term insights


@query(
    """SELECT insight_id, CASE WHEN known THEN action ELSE 'skip' END AS action, CASE WHEN known THEN round(greatest(least(1, greatest(0, imp)), coalesce(least(1, greatest(0, goal)), 0)), 6) ELSE 0 END AS importance,
  CASE WHEN known AND edge IN ('supersedes', 'elaborates', 'contradicts', 'consolidates') THEN edge END AS edge_type, CASE WHEN known THEN target END AS target_id, CASE WHEN known THEN entity || '/person' ELSE '' END AS entities FROM (
  SELECT insight_id, json_extract_string(raw, '$.action') AS action, json_extract_string(raw, '$.action') IN ('insert', 'relate', 'skip') AS known, json_extract_string(raw, '$.importanceScore')::DOUBLE AS imp,
    json_extract_string(raw, '$.goalRelevance')::DOUBLE AS goal, json_extract_string(raw, '$.edgeType') AS edge, json_extract_string(raw, '$.targetId') AS target, lower(json_extract_string(raw, '$.entities[0].name')) AS entity FROM llm_scores)""",
    ("llm_scores",),
)
def score_parse(scores):
    parsed = scores.select("insight_id", X.parse_score(F.col("raw")).alias("s"))
    names = F.array_join(F.transform("s.entities", lambda e: F.concat(e["name"], F.lit("/"), e["type"])), ",")
    return parsed.select("insight_id", "s.action", F.round("s.importance", 6).alias("importance"), "s.edge_type", "s.target_id", names.alias("entities"))


@query("SELECT id, ts FROM insights WHERE NOT processed AND NOT list_contains(tags, 'permanently_skipped') ORDER BY ts, id LIMIT 10", ("insights",))
def salience_batch(insights):
    return salience.select_batch(insights).select("id", "ts")


@query(
    """, parsed AS (SELECT insight_id AS id, json_extract_string(raw, '$.action') AS a, greatest(least(1, json_extract_string(raw, '$.importanceScore')::DOUBLE), least(1, coalesce(json_extract_string(raw, '$.goalRelevance')::DOUBLE, 0))) AS imp,
  json_extract_string(raw, '$.targetId') AS target, json_extract_string(raw, '$.edgeType') AS edge FROM llm_scores),
acted AS (SELECT *, CASE WHEN a = 'ponder' THEN 'skip' WHEN a = 'relate' AND target IS NULL THEN 'insert' ELSE a END AS action, CASE WHEN a = 'ponder' THEN 0 ELSE imp END AS importance FROM parsed)
SELECT id, action, CASE WHEN action = 'insert' AND importance >= 0.7 AND id::BIGINT % 4 <> 0 THEN 'semantic' ELSE 'episodic' END AS tier, round(importance, 6) AS importance,
  CASE WHEN action = 'relate' THEN target::BIGINT END AS target_id, CASE WHEN action = 'relate' THEN CASE WHEN edge = 'likes' THEN 'elaborates' ELSE edge END END AS edge_type,
  array_to_string(list_filter(tags, lambda t: t NOT IN ('permanently_skipped', 'llm_rate_limited')), ',') AS tags FROM acted JOIN insights USING (id)""",
    ("insights", "llm_scores"),
)
def salience_actions(insights, scores):
    related = insights.where("cast(id as bigint) % 4 = 0").select("id", F.lit(2).alias("n"))
    acted = salience.actions(insights, scores, related)
    return acted.select("id", "action", "tier", F.round("importance", 6).alias("importance"), "target_id", "edge_type", F.array_join("tags", ",").alias("tags"))


@query("SELECT query_id AS id, string_agg(id::VARCHAR, ',' ORDER BY position) AS related FROM results WHERE query_id % 100 = 0 OR position = 1 GROUP BY query_id", RECALL_VIEWS)
def related_lookup(records, edges, queries):
    """Every second query is asked in low-cost mode."""
    asked = queries.select("query_id", F.col("query_id").alias("id"), F.when(F.col("query_id") % 100 == 0, "normal").otherwise("low_cost").alias("mode"))
    found = salience.related(_lists(records, edges, queries, RecallOptions(threshold=0.05, limit=S.RELATED_ROWS)).results, asked)
    return found.select("id", F.array_join(F.col("related.id").cast("array<string>"), ",").alias("related"))


PARSED = """, parsed AS (SELECT insight_id AS id, json_extract_string(raw, '$.action') AS a, greatest(least(1, json_extract_string(raw, '$.importanceScore')::DOUBLE), least(1, coalesce(json_extract_string(raw, '$.goalRelevance')::DOUBLE, 0))) AS imp,
  json_extract_string(raw, '$.targetId')::BIGINT AS target, json_extract_string(raw, '$.edgeType') AS edge FROM llm_scores),
promoted AS (SELECT 999999 + row_number() OVER (ORDER BY id) AS record_id, id, summary, imp, a = 'relate' AND target IS NOT NULL AS relates, target, CASE WHEN edge = 'likes' THEN 'elaborates' ELSE edge END AS edge
  FROM parsed JOIN insights USING (id) WHERE a IN ('insert', 'relate'))"""
SQL_PARTS |= {k: PARSED for k in ("salience_records", "salience_edges")}


def _promoted(insights, scores):
    acted = salience.actions(insights, scores, insights.select("id", F.lit(0).alias("n")).limit(0))
    return salience.promoted(acted, insights, fixtures.as_of(), 1_000_000)


@query("SELECT record_id AS id, summary AS data, 'salience' AS source, id AS insight_id, CASE WHEN NOT relates AND imp >= 0.7 THEN 'semantic' ELSE 'episodic' END AS tier, round(1 + 9 * imp, 6) AS stability FROM promoted", ("insights", "llm_scores"))
def salience_records(insights, scores):
    part = lambda p: F.get_json_object("metadata", f"$.{p}")
    return _promoted(insights, scores)[0].select("id", "data", part("source").alias("source"), part("insightId").alias("insight_id"), "tier", F.round("stability", 6).alias("stability"))


@query("SELECT record_id AS from_id, target AS to_id, edge AS type FROM promoted WHERE relates", ("insights", "llm_scores"))
def salience_edges(insights, scores):
    return _promoted(insights, scores)[1].select("from_id", "to_id", "type")


@query(
    """, calls AS (SELECT id, TIMESTAMP '2024-01-01' + to_seconds((id::BIGINT * 9 + id::BIGINT // 3000 * 1500) % 86400) AS ts FROM insights),
hours AS (SELECT 0 AS hour, min(ts) AS start FROM calls UNION ALL
  SELECT * FROM (SELECT hour + 1, (SELECT min(ts) FROM calls WHERE ts >= hours.start + INTERVAL 1 HOUR) AS start FROM hours) WHERE start IS NOT NULL)
SELECT id, 'salience' AS process, hour, call, CASE WHEN call > 200 THEN 'limited' WHEN call > 150 THEN 'low_cost' ELSE 'normal' END AS mode FROM (
  SELECT id, hour, row_number() OVER (PARTITION BY hour ORDER BY ts, id) AS call FROM (SELECT id, ts, max(hour) AS hour FROM calls JOIN hours ON start <= ts GROUP BY ALL))""",
    ("insights",),
)
def rate_budget(insights):
    at = F.timestamp_add("SECOND", ((F.col("id").cast("bigint") * 9 + F.floor(F.col("id").cast("bigint") / 3000) * 1500) % 86400).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return salience.budget(insights.select("id", F.lit("salience").alias("process"), at.alias("ts")))


@query("SELECT id, (id::BIGINT % 5) AS failures, CASE WHEN id::BIGINT % 5 >= 3 THEN 'importance_scoring_failed,permanently_skipped' WHEN id::BIGINT % 5 >= 1 THEN 'importance_scoring_failed' ELSE '' END AS tags FROM insights", ("insights",))
def failure_bookkeeping(insights):
    attempts = insights.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select("id", (F.col("k") <= F.col("id").cast("bigint") % 5).alias("failed"))
    return salience.failure_tags(attempts).select("id", "failures", F.array_join("tags", ",").alias("tags"))


@query("SELECT count(*) AS cycles, sum(id::BIGINT % 10)::BIGINT AS processed, sum(id::BIGINT % 3)::BIGINT AS failures, sum(id::BIGINT % 10)::BIGINT AS llm_calls, (sum(id::BIGINT % 10) * 500)::BIGINT AS estimated_tokens FROM insights", ("insights",))
def cycle_counters(insights):
    n = F.col("id").cast("bigint")
    return salience.cycle_counters(insights.select((n % 10).alias("processed"), (n % 3).alias("failures"), (n % 10).alias("llm_calls")))


@query("SELECT id, processed OR id::BIGINT % 5 = 0 AS processed FROM insights", ("insights",))
def mark_processed(insights):
    return salience.mark_processed(insights, insights.where("cast(id as bigint) % 5 = 0").select("id")).select("id", "processed")


@query(
    """, sized AS (SELECT conv_id::BIGINT AS conv_id, seq::BIGINT AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n, ceil(length(concat_ws(chr(10), tool_call, tool_result, agent_reaction)) / 4.0::DOUBLE)::BIGINT AS tokens,
  ceil(length(left(tool_result, 40)) / 4.0::DOUBLE)::BIGINT AS short FROM phases),
run AS (SELECT DISTINCT conv_id, 0::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS tokens, 0::BIGINT AS held, 0::BIGINT AS given, false AS compressed FROM sized UNION ALL
  SELECT s.conv_id, s.seq, s.n, s.tokens, CASE WHEN (held + s.tokens) / 500.0::DOUBLE >= 0.7 THEN held + s.tokens - o.tokens + o.short ELSE held + s.tokens END,
    CASE WHEN (held + s.tokens) / 500.0::DOUBLE >= 0.7 THEN given + 1 ELSE given END, (held + s.tokens) / 500.0::DOUBLE >= 0.7
  FROM run JOIN sized s ON s.conv_id = run.conv_id AND s.n = run.n + 1 JOIN sized o ON o.conv_id = run.conv_id AND o.n = run.given + 1)
SELECT conv_id, seq, tokens, held, compressed FROM run WHERE n > 0""",
    ("phases",),
)
def phase_tokens(phases):
    return salience.phase_tokens(phases, F.substring("tool_result", 1, 40), 500)


@query("SELECT id, 'agent:a1,run:r-' || id || ',observation' AS tags FROM insights", ("insights",))
def afferent_tags(insights):
    return insights.select("id", F.array_join(text.observation_tags(F.lit("a1"), F.concat(F.lit("r-"), "id")), ",").alias("tags"))


@query("SELECT id, CASE WHEN importance >= 0.7 THEN 'high' WHEN importance >= 0.5 THEN 'medium' ELSE 'low' END AS relevance, strftime(created_at, '%Y-%m-%d') AS recorded_on, array_to_string(from_json(json_extract(metadata, '$.tags'), '[\"VARCHAR\"]'), ',') AS tags FROM records", ("records",))
def memory_entry(records):
    tags = X.visible_tags(F.array_append(X.tags_of(F.col("metadata")), F.sha2(F.col("id").cast("string"), 256)))
    return records.select("id", X.relevance(F.col("importance")).alias("relevance"), X.day(F.col("created_at")).alias("recorded_on"), F.array_join(tags, ",").alias("tags"))


@query("SELECT id, name || ' (' || type || ')' AS text FROM entities", ("entities",))
def entity_embed_text(ents):
    return ents.select("id", X.entity_text(F.col("name"), F.col("type")).alias("text"))


@query("SELECT conv_id, seq, left(tool_result, 200) AS excerpt FROM phases", ("phases",))
def context_excerpt(phases):
    return phases.select("conv_id", "seq", X.excerpt(F.col("tool_result")).alias("excerpt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
