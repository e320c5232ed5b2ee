"""Spelling variants against brute force, with crowds and many shards, and on null, empty and repeated input."""

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from tidemark.llm import spelling as S


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, slip=97, least=5, times=3):
    c = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= times}


def brute_forms(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_apart(w, v))
        good = near and -near[0][0] >= 2 * n
        out[w] = (near[0][1] if good else None, n, len(near), -near[0][0] if good else None)
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (*out[w], root)
    return out


def prose(rng, n, letters="abcÉé"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    return " ".join(rng.choice(base) + rng.choice(["", ",", "2", "×", "A"]) for _ in range(n))


@pytest.mark.parametrize("crowd, scans, shard", [(64, 8192, 65_536), (1, 2, 50), (3, 1, 10**6)])
def test_against_brute_force(spark, monkeypatch, crowd, scans, shard):
    monkeypatch.setattr(S, "CROWD", crowd), monkeypatch.setattr(S, "SCANS", scans), monkeypatch.setattr(S, "SHARD_ROWS", shard)
    rng = random.Random(7)
    docs = [(i, prose(random.Random(i % 9), 300)) for i in range(40)] + [(None, prose(rng, 200)), (None, None), (99, ""), (98, "12 ..\n"), (97, "x" * 3000 + " " + "x" * 2999), (1, "aaaaa aaaaaa aaaaaaa " * 5), (1, "aaaaa aaaaaa aaaaaaa " * 5)]
    docs += [(200 + k, ("xy" * 1500 + " ") * 2) for k in range(2)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, word string").repartition(4)
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in S.group_spellings(df, slip_every=97).collect()}
    want = brute_forms(brute_words(docs))
    assert got == want and sum(f[0] is not None for f in want.values()) > 5 and any(f[4] not in (f[0], w) for w, f in want.items())


def test_hot_half(spark, monkeypatch):
    """Thousands of words with one half in common are split by the letters of the other, and scans over several tasks."""
    monkeypatch.setattr(S, "CROWD", 8), monkeypatch.setattr(S, "SCANS", 64)
    rng = random.Random(2)
    words = {"prefix" + "".join(rng.choice("abcd") for _ in range(rng.randint(5, 6))): rng.randint(3, 50) for _ in range(3000)}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in S.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    less = {}
    for w in words:
        for i in range(len(w)):
            less.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    want = {}
    for w in words:
        near = set().union(*(less[i, w[:i] + w[i + 1 :]] for i in range(len(w)))) | {w[:i] + w[i + 1 :] for i in range(len(w))} & set(words)
        near |= set().union(*(less.get((i, w), set()) for i in range(len(w) + 1)))
        near.discard(w)
        if near:
            best = min((-words[v], v) for v in near)
            want[w] = (len(near), -best[0], best[1])
    assert got == want


def test_each_pair_counts_in_one_region():
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(150)}
    for w in words:
        for v in words:
            for bounds in ([0, len(w) // 2, len(w)], [0, 1, 3, 4, len(w)]):
                hits = [S.one_edit(w, v, a, b) for a, b in zip(bounds, bounds[1:], strict=False) if v.startswith(w[:a]) and v.endswith(w[b:]) and len(v) >= a + len(w) - b]
                assert sum(hits) == one_apart(w, v)


def test_shard_without_patterns():
    assert S.scan_shard(pd.DataFrame([(1, "words", -1, 0, 2)], columns=["key", "word", "n", "lo", "hi"])).empty


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.group_spellings(none, slip_every=97).count() == 0
    assert S.group_spellings(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 0
    alone = S.group_spellings(spark.createDataFrame([(1, "single single SINGLE word")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone] == [("single", None, "single", 3, 0, None)]
    with pytest.raises(ValueError):
        S.group_spellings(none, ratio=1)
