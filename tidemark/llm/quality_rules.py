"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import BLANKS, stash, words

#: Rule name -> (bad if, good if), SQL over the measures; a rule that is neither abstains. Integer arithmetic, so every engine agrees.
RULES = {
    "symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    "shouting": ("100 * n_marks > 10 * n_words", "100 * n_marks <= 2 * n_words"),
    "capitals": ("100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 15 * word_chars"),
    "lines": ("100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", "2 * word_chars >= 7 * n_words AND word_chars <= 9 * n_words"),
}
ROUNDS = 20
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")
#: Where expectation-maximisation starts: the share of good texts, and how often a good or bad text gets a bad or good vote of any rule.
START = {"good": 0.8, "bad_if_good": 0.02, "bad_if_bad": 0.4, "good_if_good": 0.9, "good_if_bad": 0.5}


def repeat_words(array_of_words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more, the first time included."""

    same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])

    def covered(marked: Column) -> Column:
        places = F.filter(
            marked,
            lambda e, i: ((i > 0) & same(F.get(marked, i - 1), e)) | F.coalesce(same(F.get(marked, i + 1), e), F.lit(False)),
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
        return F.aggregate(F.sort_array(F.transform(places, lambda e: e["i"])), start, step, lambda a: a["total"])

    def of_words(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)

        def of_hashes(h: Column) -> Column:
            # Hashes show whether any window may occur twice; then windows are told apart by their words.
            window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), window(i).alias("g"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(marked, covered))

        return bind(F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), of_hashes)

    return F.when(F.size(array_of_words) < 3, 0).otherwise(bind(array_of_words, of_words)).cast("long")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though lambdas inside read it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (row, a struct of the columns of ``docs`` but its text, and ``MEASURES``). A null text has no words."""
    rest = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in rest), *([] if rest else [F.lit(True).alias("none")]))  # an empty struct cannot be written
    split = docs.select(row.alias("row"), t.alias("t"), words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")).alias("l"))
    return split.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def evidence(params: dict) -> Column:
    """Log odds that a text with votes v_<rule> is good."""
    odds = F.lit(math.log(params["good"] / (1 - params["good"])))
    for name in RULES:
        p = params[name]
        ratio = {v: math.log(p["good", v] / p["bad", v]) for v in (-1, 0, 1)}
        odds = odds + F.when(F.col(f"v_{name}") == -1, ratio[-1]).when(F.col(f"v_{name}") == 1, ratio[1]).otherwise(ratio[0])
    return odds


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over ``patterns`` (v_<rule>..., n), the counts of distinct votes: at most 3 ** 6 rows however many texts.

    These sufficient statistics come to the driver, where each round takes the expected votes of either class; add-one smoothing keeps
    every share above zero. No pattern leaves the start values.
    """
    s = START
    first = {(c, v): x for c in ("good", "bad") for v, x in ((-1, s[f"bad_if_{c}"]), (1, s[f"good_if_{c}"]), (0, 1 - s[f"bad_if_{c}"] - s[f"good_if_{c}"]))}
    params: dict = {"good": s["good"], **{name: first for name in RULES}}
    counts = [(r["n"], {name: r[f"v_{name}"] for name in RULES}) for r in patterns.collect()]
    for _ in range(rounds if counts else 0):
        good, seen = [], sum(n for n, _ in counts)
        for n, votes in counts:
            odds = math.log(params["good"] / (1 - params["good"])) + sum(math.log(params[r]["good", v] / params[r]["bad", v]) for r, v in votes.items())
            good.append(n / (1 + math.exp(-odds)))
        share = {"good": good, "bad": [n - g for g, (n, _) in zip(good, counts, strict=True)]}
        params = {"good": (sum(good) + 1) / (seen + 2)}
        for r in RULES:
            params[r] = {
                (c, v): (sum(x for x, (_, votes) in zip(share[c], counts, strict=True) if votes[r] == v) + 1) / (sum(share[c]) + 3)
                for c in ("good", "bad") for v in (-1, 0, 1)
            }
    return params


def judge_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``MEASURES``, votes v_<rule>, posterior, base_failed and kept (columns of those names, in any case, are replaced).

    base_failed: under 50 words, or over half of the words in repeated windows. kept: not base_failed and a posterior of 0.5 or more. The
    posterior is that of the two-class model which ``estimate`` fits to the votes of all texts. A null text counts as empty; repeated rows
    are judged each; an empty table gives an empty one.
    """
    own = [*MEASURES, *(f"v_{r}" for r in RULES), "posterior", "base_failed", "kept"]
    voted = stash(measure(docs.drop(*own), text).select("*", *(vote(*RULES[r]).alias(f"v_{r}") for r in RULES)))
    patterns = stash(voted.groupBy(*(f"v_{r}" for r in RULES)).agg(F.count("*").alias("n")))
    params = estimate(patterns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.select("*", (1 / (1 + F.exp(-evidence(params)))).alias("posterior"), failed.alias("base_failed"))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own and c != text), *own)
