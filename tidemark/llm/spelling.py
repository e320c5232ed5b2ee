"""Spelling variants: words one edit apart, found by Aho-Corasick automata over halves of words, and the commonest form of each."""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lower_ascii, stash

#: Words that may share the segments around one region before the region is halved again, words that scan for one such pattern in one task, and
#: rows of a shard.
CROWD, SCANS, SHARD_ROWS = 64, 8_192, 65_536


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3, slip_every: int | None = None) -> DataFrame:
    """Rows (word, n) of the distinct runs of Latin letters, A-Z in lower case, with at least ``min_length`` code points and ``min_count`` occurrences.

    With ``slip_every``, a run loses a code point before it is counted if the CRC-32 of ``<doc_id>:<run>`` is a multiple of it: the one at that
    number modulo the length. A null id is written as nothing.
    """
    each = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode_outer(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), "[^a-zÀ-ÿ]+")).alias("run"))
    word = F.col("run")
    if slip_every:
        each = each.where("run <> ''").select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % slip_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = each.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def around(word: Column, size: Column, lo: Column, hi: Column) -> Column:
    """Hash of what a word of ``size`` letters has outside of ``lo`` to ``hi``; ``word`` itself may be longer or shorter by what the region is."""
    return F.xxhash64(size, lo, hi, F.substring(word, F.lit(1), lo), F.substring(word, F.length(word) - (size - hi) + 1, size - hi))


def halved(rows: DataFrame) -> DataFrame:
    """``rows`` once for each half of their region, with its key; halves that are left without a place in the word are dropped."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("hi").alias("b")))
    split = rows.withColumn("_half", F.explode(halves)).withColumns({"lo": F.col("_half.a"), "hi": F.col("_half.b")}).drop("_half")
    split = split.where(F.length("word") >= F.col("lo") + F.col("size") - F.col("hi"))
    return split.withColumn("key", around(F.col("word"), F.col("size"), F.col("lo"), F.col("hi")))


def one_edit(w: str, v: str, lo: int, hi: int) -> bool:
    """Whether one edit turns ``w`` into ``v`` at a place from ``lo`` to ``hi``, ``hi`` left out but at the end of ``w``.

    The place is the first letter that differs, so of several regions of ``w`` one holds it.
    """
    if w[:lo] != v[:lo]:
        return False
    p, a, b = lo, len(w), len(v)
    most = min(a, b)
    while p < most and w[p] == v[p]:
        p += 1
    if a == b:
        return p < hi and w[p + 1 :] == v[p + 1 :]
    if a == b + 1:
        return p < hi and w[p + 1 :] == v[p:]
    return b == a + 1 and (p < hi or p == a == hi) and w[p:] == v[p + 1 :]


def scan_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: an automaton of its patterns' segments scans its words; rows (word, n_near, best_n, best) of words with near ones.

    A pattern is a word with the region that an edit is looked for in; its longer segment outside of it goes into the automaton. A match counts
    if the segment stands at its end of the scanned word and that word was dealt to the pattern; then the distance is verified.
    """
    automaton, held, dealt = ahocorasick.Automaton(), {}, defaultdict(set)
    for key, word, n, lo, hi in zip(*(rows[c].tolist() for c in ("key", "word", "n", "lo", "hi")), strict=True):
        if n < 0:
            dealt[word].add(key)
        elif lo >= len(word) - hi:
            held.setdefault(word[:lo], ([], []))[0].append((key, word, n, lo, hi))
        else:
            held.setdefault(word[hi:], ([], []))[1].append((key, word, n, lo, hi))
    found: dict[str, list] = {}
    for segment, patterns in held.items():
        automaton.add_word(segment, (len(segment) - 1, *patterns))
    if held:
        automaton.make_automaton()
    for v, keys in dealt.items() if held else ():
        count, best = 0, None
        last = len(v) - 1
        for end, (own_end, first, second) in automaton.iter(v):
            for key, w, n, lo, hi in (first if end == own_end else []) + (second if end == last else []):
                if key in keys and one_edit(w, v, lo, hi):
                    count += 1
                    best = min(best, (-n, w)) if best else (-n, w)
        if count:
            found[v] = [v, count, -best[0], best[1]]
    return pd.DataFrame(list(found.values()), columns=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, min_length: int = 5) -> DataFrame:
    """Rows (word, n_near, best_n, best) of each of ``words`` (word, n, distinct, of at least ``min_length`` letters) that others are one edit from.

    best is the near word of the largest n, of ties the first in code-point order. An edit leaves one half of a word as it is: every word is a
    pattern for each of its halves, and is dealt, as a word to scan, to the patterns of words as long, or longer or shorter by one, whose
    intact half it has. Where more than ``CROWD`` words share a half, their other half is halved again, until at last a single letter is free,
    and then words in a crowd are as few as letters. Where more than ``SCANS`` words scan for one pattern they are split over several tasks,
    and the patterns copied to each. Patterns are dealt to shards of about ``SHARD_ROWS`` rows by their key.
    """
    if min_length < 2:
        raise ValueError("a word of one letter has no halves")
    sized = words.select("word", F.col("n").cast("long").alias("n"), F.length("word").alias("size"))
    zero = F.lit(0)
    patterns = halved(sized.select("word", "n", "size", zero.alias("lo"), F.col("size").alias("hi")))
    lengths = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    scans = sized.select("word", F.lit(-1).cast("long").alias("n"), lengths.alias("size")).where(F.col("size") >= min_length)
    scans = halved(scans.withColumns({"lo": zero, "hi": F.col("size")}))
    cold = None
    while patterns is not None:
        crowds = stash(patterns.groupBy("key").agg(F.count("*").alias("crowd"), F.max(F.col("hi") - F.col("lo")).alias("free")))
        full = F.lit(CROWD) < F.col("crowd")
        split = full & (F.col("free") > 1)
        both = stash(patterns.unionByName(scans).join(crowds.select("key", split.alias("split")), "key"))
        kept = both.where("not split").drop("split")
        cold = kept if cold is None else cold.unionByName(kept)
        if crowds.where(split).isEmpty():
            break
        again = halved(both.where("split").drop("split", "key"))
        patterns, scans = again.where("n >= 0"), again.where("n < 0")
    parts = cold.where("n < 0").groupBy("key").agg(F.ceil(F.count("*") / SCANS).cast("int").alias("parts")).where("parts > 1")
    dealt = cold.join(stash(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.when(F.col("n") < 0, F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = stash(dealt.withColumn("part", F.explode(mine)).select(F.xxhash64("key", "part").alias("key"), "word", "n", "lo", "hi"))
    shards = max(1, -(-dealt.count() // SHARD_ROWS))
    found = dealt.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(lambda rows: scan_shard(rows), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    per = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return per.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) for each row of ``forms`` (word, form): the last form that following forms leads to.

    Each round doubles how far a word's pointer reaches; forms must not lead in a circle. An empty table gives an empty one.
    """
    at = stash(forms.select("word", F.col("form").alias("root")))
    for _ in range(64):
        ahead = at.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        at = stash(at.join(ahead, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
    raise RuntimeError("forms lead in a circle")


def group_spellings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3, ratio: int = 2, slip_every: int | None = None) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for each word of ``vocabulary``.

    form is the near word (``near_words``) of the largest n, of ties the first in code-point order, if that n is at least ``ratio`` times the
    word's own; else null, like form_n. root is where forms lead in the end, the word itself if it has none. Null and empty texts have no words;
    repeated rows count each; columns other than id and text play no part; an empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms can lead in a circle")
    words = stash(vocabulary(docs, doc_id, text, min_length, min_count, slip_every))
    near = words.join(near_words(words, min_length), "word", "left")
    holds = F.col("best_n") >= ratio * F.col("n")
    judged = stash(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n")))
    led = judged.join(roots(judged.where("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
