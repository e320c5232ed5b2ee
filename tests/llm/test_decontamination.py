"""Decontamination against brute force, and on null, empty, repeated and clashing input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, width):
    """(n_words, hit word numbers, item ids) of each text."""
    grams = {}
    for item, t in items:
        w = words(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    named |= grams[tuple(w[i : i + n])]
        out.append((len(w), hit, sorted(str(x) for x in named if x is not None)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma,", "ÉTÉ", "délta-x", "x1", "(y)", "日本", "\U0001F600z"]) for _ in range(n))
    items = [(i, prose(rng.randint(8, 40))) for i in range(30)] + [(30, "Short one!"), (31, ""), (32, None), (None, "nameless item here"), (3, "second text of three which is a longer sentence than ten words"), (33, "..."), (34, "Short one!")]
    docs = [prose(60) for _ in range(30)] + [f"{prose(20)}; {items[i][1].upper() if i % 2 else items[i][1]} {prose(5)}" for i in range(30)]
    docs += [docs[40]] * 3 + [None, "", " .,; ", "short", "SHORT, one", "a nameless item here.", prose(3000) + " " + items[7][1] + " " + items[8][1], "x" * 500, "second text of three which is a longer sentence than ten words"]
    return docs, items


@pytest.mark.parametrize("width, chars", [(10, D.BROADCAST_CHARS), (10, 0), (3, D.BROADCAST_CHARS), (1, 0)])
def test_against_brute_force(spark, case, width, chars):
    docs, items = case
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(docs)], "doc_id long, text string, gram string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.scan(rows, tests, width=width, broadcast_chars=chars).collect()}
    want = brute(docs, items, width)
    assert len(got) == len(docs) and sum(len(h) for _, h, _ in want) > 0
    for i, (n, hit, named) in enumerate(want):
        r = got[i]
        assert (r.n_words, r.n_hit, r.contaminated, list(r["items"]), r.gram, r.text) == (n, len(hit), bool(hit), named, "mine", docs[i])
        assert {k for s in r.spans for k in range(s.start, s.end)} == hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_odd_tables(spark, case):
    docs, items = case
    rows = spark.createDataFrame([(1, docs[40], 7, "k"), (1, docs[40], 7, "k"), (None, docs[40], 8, "k"), (2, None, 9, "k")], "doc_id long, text string, N_Hit int, `first` string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(rows, tests)
    assert got.columns == ["doc_id", "text", "first", "n_words", "n_hit", "spans", "items", "contaminated"]
    assert sorted(((r.doc_id or 0, r.n_hit > 0, r.first) for r in got.collect())) == [(0, True, "k"), (1, True, "k"), (1, True, "k"), (2, False, "k")]
    assert D.scan(rows.limit(0), tests).count() == 0
    assert {r.n_hit for r in D.scan(rows, tests.limit(0)).collect()} == {0}
    for remove in ("spans", "documents"):
        assert D.decontaminate(rows, tests, remove).columns == rows.columns
    with pytest.raises(ValueError):
        D.decontaminate(rows, tests, "all")


def test_removal(spark, case):
    docs, items = case
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 10)
    kept = {r.doc_id: r.text for r in D.decontaminate(rows, tests, "documents").collect()}
    assert kept == {i: t for i, t in enumerate(docs) if not want[i][1]}
    cut = {r.doc_id: r.text for r in D.decontaminate(rows, tests).collect()}
    for i, t in enumerate(docs):
        assert words(cut[i]) == [w for k, w in enumerate(words(t)) if k not in want[i][1]]
        if not want[i][1]:
            assert cut[i] == t
    seen = spark.createDataFrame([("Keep this, Short  one! and (that)",)], "text string")
    assert D.decontaminate(seen, tests.where(F.col("item_id") == 30)).first().text == "Keep this! and (that)"
