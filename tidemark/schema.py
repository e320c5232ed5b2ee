"""Table schemas and constants of the memory model."""

from __future__ import annotations

RECORDS = (
    "id BIGINT, data STRING, metadata STRING, embedding ARRAY<FLOAT>, embedding_model_id STRING, embedding_dimensions INT, tier STRING, "
    "importance DOUBLE, stability DOUBLE, last_accessed_at TIMESTAMP, access_count INT, created_at TIMESTAMP, tombstoned BOOLEAN, "
    "tombstoned_at TIMESTAMP, session_id STRING, category STRING, episode_summary STRING"
)
EDGES = "id BIGINT, from_id BIGINT, to_id BIGINT, type STRING, stability DOUBLE, last_accessed_at TIMESTAMP, created_at TIMESTAMP"
ENTITIES = "id BIGINT, name STRING, type STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP"
ENTITY_EDGES = "id BIGINT, from_id BIGINT, to_id BIGINT, type STRING, weight DOUBLE, created_at TIMESTAMP"
LINKS = "id BIGINT, entity_id BIGINT, record_id BIGINT, created_at TIMESTAMP"
INSIGHTS = "id STRING, summary STRING, context_file STRING, tags ARRAY<STRING>, ts TIMESTAMP, processed BOOLEAN, safe_to_delete BOOLEAN"
PENDING = "pending_id STRING, summary STRING, confidence DOUBLE, source_ids ARRAY<BIGINT>, preserved_facts ARRAY<STRING>, uncertainties ARRAY<STRING>, created_at TIMESTAMP"
EVENTS = "name STRING, at TIMESTAMP, payload STRING"
BUDGETS = "process STRING, start TIMESTAMP, used BIGINT"
ENTITY_LIST = "ARRAY<STRUCT<name: STRING, type: STRING>>"

# Fixed values of the memory model.
EDGE_TYPES = ("supersedes", "elaborates", "contradicts", "consolidates")
SPREADING_TYPES = ("elaborates", "supersedes", "consolidates")
ACTIONS = ("insert", "relate", "skip")
RECALL_THRESHOLD = 0.5
ASSOCIATIVE_SCORE = 0.7
ASSOCIATIVE_STRENGTHEN = 0.5
SUPERSEDES_RETENTION = 0.3
DECAY_RETENTION = 0.2
SEMANTIC_SEEDS = 10
RRF_K = 60
TOP_UP_COSINE = 0.05
MIN_STABILITY, MAX_STABILITY = 0.5, 365.0
STABILITY_SLOPE = 9.0
CONSOLIDATION_GAIN = 0.5
CLUSTER_SIMILARITY, CLUSTER_ACCESS = 0.75, 2
PROCESS_SIMILARITY, PROCESS_CLUSTER_SIZE = 0.85, 3
PRUNE_RETENTION = 0.1
SPREAD_DAYS = 30
FALSE_MEMORY_CONFIDENCE = 0.5
HOURLY_CALLS, LOW_COST_CALLS = 200, 150
BATCH_SIZE, PENDING_TRIGGER, MAX_FAILURES = 10, 10, 3
RELATED_ROWS, RELATED_LOW_COST = 3, 1
SCORE_ATTEMPTS, SUMMARY_ATTEMPTS = 3, 2
EXTRACTION_LEASE_S, SALIENCE_CADENCE_S, CONSOLIDATION_CADENCE_S = 60, 300, 3600
TOKENS_PER_CALL = 500
PROMOTION_IMPORTANCE = 0.7
ENTITY_MERGE, ENTITY_AMBIGUOUS = 0.85, 0.70
HINT_SIMILARITY, RELIABLE_HOPS, ENRICHED_ROWS = 0.75, 5, 3
NEIGHBOUR_DEPTH, PATH_HOPS, MOST_PATH_HOPS = 5, 10, 20
CONTEXT_ROWS, CONTEXT_SECONDARY_ROWS, CONTEXT_FILES = 5, 2, 3
SESSION_BOOST, CATEGORY_BOOST, MOST_SCORE = 0.15, 0.10, 1.0
HIGH_RELEVANCE, MEDIUM_RELEVANCE = 0.7, 0.5
COMPRESSION_RATIO, CHARS_PER_TOKEN = 0.7, 4
PENDING_HOURS = 24
EXCERPT_CHARS, PURPOSE_CHARS = 200, 200
INTERNAL_TAGS = ("permanently_skipped", "llm_rate_limited")
FAILED_TAG = "importance_scoring_failed"
