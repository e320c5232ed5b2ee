"""Exact positions in very long ranked lists, without one task per list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that scores from -1 to 1 fall into; scores outside share the first or last.
BUCKETS = 4096


def positions(scored: DataFrame, by: str, score: str, tie: str, name: str) -> DataFrame:
    """Add ``name``, the position from 1 of each row in its list ``by``, largest ``score`` first, then smallest ``tie``.

    Counts per score bucket give each bucket's offset, and a window ranks within a bucket only, so a list of any length spreads over all
    tasks. The counts are combined before they are shuffled. Rows with a null score come last.
    """
    level = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor((1 - F.coalesce(F.col(score), F.lit(-2.0))) * (BUCKETS / 2)))).cast("int")
    dealt = scored.withColumn("_bucket", level)
    sizes = dealt.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(by).alias("_by"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_bucket").orderBy(F.col(score).desc_nulls_last(), tie)
    ranked = dealt.withColumn("_position", F.row_number().over(within))
    joined = ranked.join(offsets, (F.col(by) == F.col("_by")) & (F.col("_bucket") == F.col("_of")))
    return joined.select(*scored.columns, (F.col("_position") + F.col("_before")).cast("long").alias(name))
