"""What a client gets from a recall: entries with superseded pairs, and merged context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X


def entry() -> list[Column]:
    return [
        F.col("data").alias("memory"), "tier", X.relevance(F.col("effective_score")).alias("relevance"), X.visible_tags(X.tags_of(F.col("metadata"))).alias("tags"),
        F.coalesce(X.entities_of(F.col("metadata")), F.array().cast(S.ENTITY_LIST)).alias("entities"), X.day(F.col("created_at")).alias("recorded_on"),
    ]


def serialize(results: DataFrame) -> DataFrame:
    """Rows (query_id, part, position, kind, id, replaced_id): superseded records first, paired with the first companion among what supersedes
    them (kind changed), then plain ones, then companions that no pair used."""
    companion = F.array_contains("strategies", "companion")
    old = results.where(~companion & F.col("is_superseded"))
    new = results.where(companion).select("query_id", F.col("id").alias("companion_id"), F.col("position").alias("companion_position"))
    named = old.select("query_id", "id", F.posexplode("superseding_ids").alias("_p", "companion_id")).join(new, ["query_id", "companion_id"])
    pairs = named.groupBy("query_id", "id").agg(F.min_by("companion_id", "_p").alias("companion_id"))
    both = old.select("query_id", "id", "position").join(pairs, ["query_id", "id"], "left")
    paired = both.select(
        "query_id", F.lit(0).alias("part"), "position", F.when(F.col("companion_id").isNotNull(), "changed").otherwise("superseded").alias("kind"),
        F.coalesce("companion_id", "id").alias("id"), F.when(F.col("companion_id").isNotNull(), F.col("id")).alias("replaced_id"),
    )
    none = F.lit(None).cast("long").alias("replaced_id")
    plain = results.where(~companion & ~F.col("is_superseded")).select("query_id", F.lit(1).alias("part"), "position", F.lit("memory").alias("kind"), "id", none)
    unused = new.join(pairs, ["query_id", "companion_id"], "left_anti")
    rest = unused.select("query_id", F.lit(2).alias("part"), F.col("companion_position").alias("position"), F.lit("memory").alias("kind"), F.col("companion_id").alias("id"), none)
    return paired.unionByName(plain).unionByName(rest)


def merge_context(recalls: DataFrame, session_id: str, category: str | None, limit: int = S.CONTEXT_ROWS) -> DataFrame:
    """Merge ranked rows (list_no, position, id, effective_score, session_id, category, ...): first mention of each id, best ``limit`` by score, then boosts without a new order."""
    first = Window.partitionBy("id").orderBy("list_no", "position")
    unique = recalls.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    best = unique.orderBy(F.desc("effective_score"), "list_no", "position").limit(limit)
    ranked = best.withColumn("context_position", F.row_number().over(Window.orderBy(F.desc("effective_score"), "list_no", "position")))
    return ranked.withColumn("effective_score", X.boosted(F.col("effective_score"), F.col("session_id"), F.col("category"), session_id, category))


def context_text(merged: DataFrame) -> DataFrame:
    """One row with the text of a merged context."""
    tags = X.tags_of(F.col("metadata"))
    line = F.concat(
        F.lit("### "), "tier", F.lit(" record (score: "), F.format_string("%.3f", "effective_score"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" ["), F.array_join(tags, ", "), F.lit("]")), F.lit("")), F.lit("\n\n"), F.coalesce("data", F.lit("")),
    )
    listed = merged.select("context_position", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("context_position", "line"))).alias("_l"))
    return listed.select(F.array_join(F.col("_l.line"), "\n\n---\n\n").alias("context"))
