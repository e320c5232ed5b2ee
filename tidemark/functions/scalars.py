"""Scoring, decay, text and parsing functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for unequal lengths or a zero norm, null for a null vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), 0.0).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def retention(last_accessed_at: Column, stability: Column, as_of: Column) -> Column:
    """exp(-age in days / stability); above 1 for a time in the future."""
    return F.exp(-age_days(last_accessed_at, as_of) / stability)


def initial_stability(importance: Column) -> Column:
    return 1 + S.STABILITY_SLOPE * importance


def growth(retained: Column) -> Column:
    return 1 + 2 * (1 - retained)


def strengthened(stability: Column, retained: Column, share: Column) -> Column:
    return F.least(F.lit(S.MAX_STABILITY), F.greatest(F.lit(S.MIN_STABILITY), stability * growth(retained) * share))


def rrf(rank: Column) -> Column:
    """Reciprocal rank, the term of one list in a fused score."""
    return 1 / (S.RRF_K + rank)


def relevance(score: Column) -> Column:
    return F.when(score >= S.HIGH_RELEVANCE, "high").when(score >= S.MEDIUM_RELEVANCE, "medium").otherwise("low")


def visible_tags(tags: Column) -> Column:
    """Without tags that are 64 hex digits."""
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~t.rlike("^[0-9a-fA-F]{64}$"))


def external_tags(tags: Column) -> Column:
    """Without the tags that processes set for themselves; repeated tags stay."""
    return F.filter(tags, lambda t: ~t.isin(*S.INTERNAL_TAGS))


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def boosted(score: Column, session: Column, category: Column, of_session: str, of_category: str | None) -> Column:
    """Score plus the boosts of a matching session and category, at most 1; unchanged without a match."""
    gain = F.when(session == of_session, S.SESSION_BOOST).otherwise(0.0)
    if of_category is not None:
        gain = gain + F.when(category == of_category, S.CATEGORY_BOOST).otherwise(0.0)
    return F.when(gain > 0, F.least(F.lit(S.MOST_SCORE), score + gain)).otherwise(score)


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(float(S.CHARS_PER_TOKEN)))


def render_phase(call: Column, result: Column, reaction: Column) -> Column:
    return F.concat_ws("\n", call, result, reaction)


def entity_text(name: Column, kind: Column) -> Column:
    return F.format_string("%s (%s)", name, kind)


def valid_session_id(session: Column) -> Column:
    return session.rlike(r"^[0-9A-Za-z][0-9A-Za-z_-]{0,127}\z")


def excerpt(text: Column) -> Column:
    return F.substring(text, 1, S.EXCERPT_CHARS)


def tags_of(metadata: Column) -> Column:
    """metadata.tags as an array; null where it is missing or no array."""
    return F.from_json(F.get_json_object(metadata, "$.tags"), "array<string>")


def entities_of(metadata: Column) -> Column:
    return F.from_json(F.get_json_object(metadata, "$.entities"), S.ENTITY_LIST)


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    """Whether every wanted tag is there; no wanted tag holds for all rows, no tags for none."""
    if not wanted:
        return F.lit(True)
    return tags.isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0)


def has_entity(entities: Column, name: str | None, kind: str | None) -> Column:
    """Whether one entity contains ``name`` (any case) and has type ``kind`` (trimmed, lower case)."""

    def fits(e: Column) -> Column:
        parts = [F.lit(True)]
        if name is not None:
            parts.append(F.contains(F.lower(e["name"]), F.lit(name.lower())))
        if kind is not None:
            parts.append(e["type"] == kind.lower().strip())
        return reduce(Column.__and__, parts)

    return entities.isNotNull() & F.exists(entities, fits)


def merge_metadata(old: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects as JSON, the patch winning; values keep their types."""
    raw = "map<string,variant>"
    kept = F.map_filter(F.from_json(old, raw), lambda k, v: ~F.map_contains_key(F.from_json(patch, raw), k))
    return F.to_json(F.map_concat(kept, F.from_json(patch, raw)))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def parse_number(raw: Column, path: str) -> Column:
    """A JSON number, or a string that reads as one; null where it does not."""
    return F.get_json_object(raw, path).try_cast("double")


def parse_score(raw: Column) -> Column:
    """A scorer's answer as struct (action, importance, goal_relevance, target_id, edge_type, entities).

    An unknown action gives skip, 0 and no entities. Importance is clamped to 0..1, unreadable counts as 0, and goal relevance lifts it.
    """
    action = F.get_json_object(raw, "$.action")
    known = F.coalesce(action.isin(*S.ACTIONS), F.lit(False))
    goal = clamp(parse_number(raw, "$.goalRelevance"))
    importance = clamp(F.coalesce(parse_number(raw, "$.importanceScore"), F.lit(0.0)))
    edge = F.get_json_object(raw, "$.edgeType")
    return F.struct(
        F.when(known, action).otherwise("skip").alias("action"),
        F.when(known, F.greatest(importance, F.coalesce(goal, F.lit(0.0)))).otherwise(0.0).alias("importance"),
        F.when(known, goal).alias("goal_relevance"),
        F.when(known, F.get_json_object(raw, "$.targetId")).alias("target_id"),
        F.when(known & edge.isin(*S.EDGE_TYPES), edge).alias("edge_type"),
        F.when(known, parse_entities(F.get_json_object(raw, "$.entities"))).otherwise(F.array().cast(S.ENTITY_LIST)).alias("entities"),
    )


def parse_entities(raw: Column) -> Column:
    """A JSON list of entities: those with a name and a type that is not empty, in lower case, types trimmed; anything else gives none."""
    listed = F.coalesce(F.from_json(raw, S.ENTITY_LIST), F.array().cast(S.ENTITY_LIST))
    whole = F.filter(listed, lambda e: e["name"].isNotNull() & (F.coalesce(e["type"], F.lit("")) != ""))
    return F.transform(whole, lambda e: F.struct(F.lower(e["name"]).alias("name"), F.trim(F.lower(e["type"])).alias("type")))


def parse_consolidation(raw: Column) -> Column:
    """A summary answer as struct (summary, confidence, preserved_facts, uncertainties); empty if any field is missing or of a wrong type."""
    parsed = F.from_json(raw, "summary string, confidence double, preservedFacts array<string>, uncertainties array<string>")
    good = parsed["summary"].isNotNull() & parsed["confidence"].isNotNull() & parsed["preservedFacts"].isNotNull() & parsed["uncertainties"].isNotNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(good, parsed["summary"]).otherwise("").alias("summary"),
        F.when(good, parsed["confidence"]).otherwise(0.0).alias("confidence"),
        F.when(good, parsed["preservedFacts"]).otherwise(none).alias("preserved_facts"),
        F.when(good, parsed["uncertainties"]).otherwise(none).alias("uncertainties"),
    )
