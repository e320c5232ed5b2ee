"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stash, words

#: Rows that a bucket of a prefix sum holds on average.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row (source, rank, source_size, target) per source of ``sizes`` (source, size).

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all sizes; a target stops at ``most`` times its
    source's size, and the excess goes to the others by weight until none is above. Sorted by what a unit of weight may take, the stopped
    sources are the first ones, so running sums find them without iteration.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights))
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    per = per.withColumn("cap", most * F.col("source_size"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    final = F.min_by(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level")), F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), "rank")))
    per = per.withColumn("level", final.over(whole))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return per.select("source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text", tell: tuple[str, ...] = ()
) -> DataFrame:
    """One row (doc_id, source, size, source_size, target, copies, taken) per row of ``docs``: how often the mix takes the document.

    Columns named in ``tell`` come along and settle the order of rows with one id.

    Size is the number of words; null is 0. Every source is shuffled by MD5 of seed and doc_id and queued ``most`` times over; an entry's
    virtual finish time is its source's running size divided by the source's target. All entries are ordered by finish time, then source,
    and the mix ends before the first entry that would pass the total budget. Running sums come in two steps, over buckets of the shuffle
    or of the finish time and within each bucket, so no source and no order is ever in one task. A document of size 0 is never
    taken. Rows with the same id queue one by one; null ids shuffle as an empty string; an empty table gives an empty one.
    """
    sized = stash(
        docs.select(
            *tell, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("place"),
        )
    )
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = stash(source_targets(sized, weights, share, most)).withColumnRenamed("source", "_source")
    digits = 1
    while 16**digits * BUCKET_ROWS < n:
        digits += 1
    in_bucket = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", *tell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("bucket", F.substring("place", 1, digits))
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum("size").alias("in_all"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col("source").alias("_of"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("in_all").over(before), F.lit(0)).alias("offset"))
    queued = placed.withColumn("running", F.sum("size").over(in_bucket))
    queued = queued.join(offsets, F.col("source").eqNullSafe(F.col("_of")) & (F.col("bucket") == F.col("_bucket")))
    queued = queued.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    queued = stash(queued.select(*tell, "doc_id", "source", "size", "source_size", "target", "rank", (F.col("running") + F.col("offset")).alias("running")))

    def finish(k: int):
        return F.try_divide(F.col("running") + k * F.col("source_size"), F.col("target"))

    slots = max(1, most * n // BUCKET_ROWS)
    entries = queued.where("size > 0").select("rank", "size", F.explode(F.array(*(finish(k) for k in range(most)))).alias("finish"))
    entries = entries.withColumn("slot", F.floor(F.col("finish") * slots))
    per_slot = entries.groupBy("slot").agg(F.sum("size").alias("in_all"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = share * total
    crossing = per_slot.withColumn("upto", F.sum("in_all").over(upto)).where(F.col("upto") > budget).orderBy("slot").first()
    if crossing is not None:
        left = budget - (crossing["upto"] - crossing["in_all"])
        order = Window.partitionBy("slot").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = entries.where(F.col("slot") == crossing["slot"]).withColumn("upto", F.sum("size").over(order)).where(F.col("upto") > left)
        end = last.orderBy("finish", "rank").first()
        taken = lambda f: (f < end["finish"]) | ((f == end["finish"]) & (F.col("rank") < end["rank"]))
    else:
        taken = lambda f: F.lit(True)
    copies = sum((F.when(taken(finish(k)), 1).otherwise(0) for k in range(most)), F.lit(0))
    out = queued.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select(*tell, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
