"""Benchmark decontamination: documents' word windows against a broadcast hash set of the windows of test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, identity, lower_ascii, stash

#: Words of a window; an item of fewer words is one window of all its words.
WIDTH = 10
#: Characters of distinct test windows that are broadcast, at most. Beyond it, windows meet in a shuffled join.
BROADCAST_CHARS = 64 << 20

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WITHIN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def tokens(text: Column) -> Column:
    """Words of a text: runs of letters, digits and what is not ASCII, with A-Z in lower case; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN + "+"), "")


def window_hash(words: Column, at: Column, width: int) -> Column:
    """The hash of the ``width`` words from ``at`` (0 is the first); null if fewer are left."""
    return F.when(at + width <= F.size(words), F.xxhash64(*(F.get(words, at + k) for k in range(width))))


def test_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct rows (item, n, gram) of the windows of each item, gram an array of n words; an item without words has none."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), tokens(F.col(text)).alias("words"))
    items = items.withColumn("n", F.least(F.size("words"), F.lit(width))).where("n > 0")
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))
    return items.select("item", "n", F.explode(grams).alias("gram")).distinct()


def scan_words(docs: DataFrame, own: DataFrame, text: str, keep: dict[str, str], broadcast_chars: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (kept columns, _h1, _h2, n_words) of ``docs``, hits (_h1, _h2, start, end, gram) and whether the windows ``own`` were broadcast.

    A broadcast set is looked up while the texts are scanned, once: every document leaves a row at its first word, and one for each window that
    hits, all written to one table. Words are compared where hashes meet.
    """
    sizes = own.groupBy("n").agg(F.sum(F.length(F.array_join("gram", " "))).alias("chars")).orderBy("n").collect()
    small = sum(r.chars for r in sizes) <= broadcast_chars
    widths = [r.n for r in sizes] or [1]
    grams = own.select("gram", F.col("n").alias("width")).distinct().withColumn("g", F.xxhash64("gram"))
    words = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in keep.items()), F.col(text).alias("_text"))
    words = words.select(*keep.values(), *identity("_text"), tokens(F.col("_text")).alias("words"))
    # The outer form keeps the optimiser from filtering on the array below, which would split all texts twice.
    each = words.select("*", F.posexplode_outer("words").alias("at", "word"))
    if len(widths) == 1:
        each = each.select("*", F.lit(widths[0]).alias("n"), window_hash(F.col("words"), F.col("at"), widths[0]).alias("h"))
    else:
        hashes = [F.struct(F.lit(n).alias("n"), window_hash(F.col("words"), F.col("at"), n).alias("h")) for n in widths]
        each = each.select("*", F.explode_outer(F.array(*hashes)).alias("w")).select("*", "w.n", "w.h")
    said = F.slice("words", F.col("at") + 1, F.col("n"))
    if small:
        met = each.join(F.broadcast(grams), (F.col("h") == F.col("g")) & (F.col("n") == F.col("width")) & (said == F.col("gram")), "left")
        first = (F.coalesce("at", F.lit(0)) == 0) & (F.col("n") == widths[0])
        seen = met.select(*keep.values(), "_h1", "_h2", F.size("words").cast("long").alias("n_words"), first.alias("first"), F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"), "gram")
        seen = stash(seen.where("first or gram is not null"))
        rows, hits = seen.where("first").select(*keep.values(), "_h1", "_h2", "n_words"), seen.where("gram is not null")
    else:
        rows = words.select(*keep.values(), "_h1", "_h2", F.size("words").cast("long").alias("n_words"))
        carried = each.where("h is not null").select("_h1", "_h2", "h", "n", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"), said.alias("said"))
        hits = carried.join(grams, (F.col("h") == F.col("g")) & (F.col("n") == F.col("width")) & (F.col("said") == F.col("gram")))
    return rows, hits.select("_h1", "_h2", "start", "end", "gram").distinct(), small


def by_text(hits: DataFrame, own: DataFrame, small: bool) -> DataFrame:
    """One row (_h1, _h2, n_hit, spans, items) per different text with ``hits``: the runs of words that they cover, and the sorted ids of their items."""
    before = Window.partitionBy("_h1", "_h2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_h1", "_h2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = hits.select("_h1", "_h2", "start", "end").distinct().withColumn("opens", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    runs = opens.withColumn("run", F.sum("opens").over(upto)).groupBy("_h1", "_h2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("_h1", "_h2").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    owners = own.select("gram", "item")
    named = hits.select("_h1", "_h2", "gram").distinct().join(F.broadcast(owners) if small else owners, "gram").select("_h1", "_h2", "item").distinct()
    return spans.join(named.groupBy("_h1", "_h2").agg(F.array_sort(F.collect_list("item")).alias("items")), ["_h1", "_h2"])


OWN = ("n_words", "n_hit", "spans", "items", "contaminated")


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, keep: list[str] | None = None, broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """Add n_words, n_hit, spans, items and contaminated to every row of ``docs``; of its columns ``keep`` stay (all, if it is None), those names are replaced in any case.

    ``spans`` are the hit runs of words, structs (start, end) from 0, end excluded, in order; ``items`` the ids, as sorted strings, of the items
    whose windows occur. Only hits and rows without text are shuffled, hits of equal texts combined before. The test windows are broadcast only if
    their words have at most ``broadcast_chars`` characters; a larger set is joined by a shuffle of all windows.

    A null, empty or wordless text has no words and no hits, and such an item no windows. An item without an id hits words but is in no list
    of items; items with one id count as one. Repeated rows and ids are judged each by their own text; an empty table of documents or of
    items gives no rows or no hits.
    """
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OWN]
    renamed = {c: free_name([*docs.columns, "words", "word", "gram", "first", *OWN], f"_k{k}") for k, c in enumerate(stay)}
    own = stash(test_windows(benchmark, item_id, item_text, width))
    rows, hits, small = scan_words(docs, own, text, renamed, broadcast_chars)
    found = by_text(stash(hits), own, small)
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return rows.join(found, ["_h1", "_h2"], "left").select(
        *(F.col(new).alias(c) for c, new in renamed.items()), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), none("spans"), none("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands before each of them, back to the word before."""
    pieces = F.regexp_extract_all(text, F.lit(f"{BETWEEN}*{WITHIN}+"), F.lit(0))
    hit = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), hit), lambda i: F.get(pieces, i))
    rest = F.substring(text, F.length(F.array_join(pieces, "")) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **how) -> DataFrame:
    """``docs`` with its own columns, without what ``scan`` finds: the hit words (``remove="spans"``) or every document with one (``"documents"``).

    Clean rows, null and empty texts included, stay as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is {remove!r}")
    new = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # so that no name of the user's meets one that scan adds
    found = scan(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in new.items())), benchmark, new[text], **how)
    if remove == "documents":
        return found.where("not contaminated").select(*(F.col(n).alias(c) for c, n in new.items()))
    return found.select(*((remove_spans(F.col(n), F.col("spans")) if c == text else F.col(n)).alias(c) for c, n in new.items()))
