"""Recall filters: conjunctive predicates that Catalyst pushes to the scan where it can."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import scalars as X

SORTS = ("confidence", "recency", "stability", "importance")


@dataclass(frozen=True)
class RecallOptions:
    """Filters, threshold, order and size of a recall. ``None`` switches a filter off; entity options rank and do not filter."""

    tier: str | None = None
    min_importance: float | None = None
    after: datetime | None = None
    before: datetime | None = None
    min_stability: float | None = None
    min_access_count: int | None = None
    session_id: str | None = None
    category: str | None = None
    tags: list[str] = field(default_factory=list)
    entity_name: str | None = None
    entity_type: str | None = None
    threshold: float = S.RECALL_THRESHOLD
    sort: str = "confidence"
    limit: int | None = None
    min_results: int = 0
    strengthen: bool = True

    def __post_init__(self) -> None:
        def within(name: str, low: float, high: float) -> None:
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} must be in {low}..{high}, not {value}")

        within("threshold", 0, 1)
        within("min_importance", 0, 1)
        within("min_stability", 0, S.MAX_STABILITY)
        within("min_access_count", 0, float("inf"))
        within("min_results", 0, float("inf"))
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be positive")
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        if self.tier not in (None, "episodic", "semantic"):
            raise ValueError("tier must be episodic or semantic")


def live(records: DataFrame) -> DataFrame:
    return records.where(~F.col("tombstoned"))


def lookup(records: DataFrame, ids: list[int]) -> DataFrame:
    """The records with these ids; of a tombstone only its id, that it is one, and since when."""
    some = records.where(F.col("id").isin(*ids))
    return some.select(*(c if c in ("id", "tombstoned", "tombstoned_at") else F.when(~F.col("tombstoned"), F.col(c)).alias(c) for c in records.columns))


def predicate(o: RecallOptions) -> Column:
    parts = [F.lit(True)]
    if o.tier:
        parts.append(F.col("tier") == o.tier)
    if o.min_importance is not None:
        parts.append(F.col("importance") >= o.min_importance)
    if o.after is not None:
        parts.append(F.col("created_at") > F.lit(o.after))
    if o.before is not None:
        parts.append(F.col("created_at") < F.lit(o.before))
    if o.min_stability is not None:
        parts.append(F.col("stability") >= o.min_stability)
    if o.min_access_count is not None:
        parts.append(F.col("access_count") >= o.min_access_count)
    if o.session_id is not None:
        parts.append(F.col("session_id") == o.session_id)
    if o.category is not None:
        parts.append(F.col("category") == o.category)
    if o.tags:
        parts.append(X.has_all_tags(X.tags_of(F.col("metadata")), o.tags))
    found = parts[0]
    for p in parts[1:]:
        found = found & p
    return found


def candidates(records: DataFrame, o: RecallOptions) -> DataFrame:
    """Live records that pass every filter."""
    return live(records).where(predicate(o))
