"""Texts that go to a language model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X

STATES = {
    "focused": "The agent is focused: rate what serves its task higher.", "idle": "The agent is idle: rate as usual.", "stressed": "The agent is under stress: let more important items pass.",
    "learning": "The agent is learning: rate what is new or unexpected higher.",
}


def _lines(*parts: Column) -> Column:
    """The parts that are not null, a line each."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def scoring(summary: Column, related: Column, excerpt: Column | None = None) -> Column:
    """Prompt that asks for an action on an observation; ``related`` is an array of structs (id, data), ``excerpt`` a context or null."""
    known = F.transform(related, lambda r: F.concat(F.lit("- [id:"), r["id"].cast("string"), F.lit("] "), F.coalesce(r["data"], F.lit(""))))
    return _lines(
        F.concat(F.lit("Observation: "), summary), F.lit(None).cast("string") if excerpt is None else F.concat(F.lit("\nContext excerpt:\n"), X.excerpt(excerpt)),
        F.when(F.size(related) > 0, F.concat(F.lit("\nMemories that may be related:\n"), F.array_join(known, "\n"))),
        F.lit("\nSay how this observation should be stored: insert, relate to one of the memories, or skip."),
    )


def system(kind: str | None = None, purpose: str | None = None, state: str | None = None) -> str:
    """System prompt of the scorer, with the agent's profile and state where they are known."""
    parts = []
    if kind is not None or purpose is not None:
        parts += ["Agent profile:", *([f"- Type: {kind}"] if kind is not None else []), *([f"- Purpose: {purpose[: S.PURPOSE_CHARS]}"] if purpose is not None else []), "Rate what serves the purpose at 0.5 or more, and give its goalRelevance from 0 to 1.", ""]
    parts.append("You rate observations of an agent for its long-term memory. Answer in JSON with action, importanceScore, goalRelevance, targetId, edgeType and entities.")
    if state is not None:
        parts += ["", STATES.get(state, f"Agent state: {state}.")]
    return "\n".join(parts)


def cluster(episodes: Column) -> Column:
    """Prompt that asks for one memory in place of ``episodes``, an ordered array of structs (created_at, stability, data)."""
    one = lambda e, i: F.concat(
        F.lit("--- Episode "), (i + 1).cast("string"), F.lit(" ---\nRecorded: "), F.date_format(e["created_at"], "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("\nStability: "), e["stability"].cast("string"),
        F.lit("\nContent: "), F.coalesce(e["data"], F.lit("")),
    )
    head = F.concat(F.lit("Cluster of "), F.size(episodes).cast("string"), F.lit(" episodes:"))
    return _lines(head, F.array_join(F.transform(episodes, one), "\n"), F.lit("Write one lasting memory that stands for all of them."))


def extraction(data: Column, entities: Column) -> Column:
    """Prompt that asks for entities and directed relations of a record with known ``entities`` (name, type)."""
    known = F.transform(entities, lambda e: F.concat(F.lit("- "), X.entity_text(e["name"], e["type"])))
    return _lines(F.lit("Name the entities of this record, and directed relations between them."), F.concat(F.lit("\nRecord: "), F.coalesce(data, F.lit(""))), F.concat(F.lit("\nKnown entities:\n"), F.array_join(known, "\n")))


def same_entity(pairs: Column) -> Column:
    """Prompt that asks which of the numbered ``pairs`` (name, type, candidate, candidate_id) are one entity."""
    one = lambda p, i: F.concat(
        F.lit("["), i.cast("string"), F.lit('] Extracted: "'), p["name"], F.lit('" ('), p["type"], F.lit(') | Existing: "'), p["candidate"], F.lit('" (id: '), p["candidate_id"].cast("string"), F.lit(")"),
    )
    return _lines(F.lit('Answer "merge" for each pair that is one entity, whatever its type, else "distinct".'), F.array_join(F.transform(pairs, one), "\n"))
