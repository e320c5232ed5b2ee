"""The operators against brute force, and on null, empty, repeated and clashing input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, labelled, mixing, quality_classifier, quality_rules, shared, simhash, suffix_dedup, toxicity, url_filter, warc
from tidemark.llm.queries import URL_RULES


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def split_words(t):
    return (t or "").encode().split()


# 1


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.example.com/en/x?q#f", "http://www.example.com/en/", "ftp://x.net/es/", "http://x.net/de/", "http://example.com", "http://com/x", "a://b://c/d", "http://notexample.com/en/", "http://x.org?y=/"]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)] + [(5, urls[5], "clash", 1)], "page_id long, url string, host string, verdict int")
    got = url_filter.filter_urls(pages, URL_RULES).orderBy("page_id").collect()
    assert len(got) == len(urls) + 1
    first = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert first[0] == first[1] == first[2] == ("", "", None, "allow")
    assert first[4] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert first[5][2:] == ("www.example.com/en/", "allow") and first[6][2:] == ("net/es/", "block") and first[8][2] is None and first[9][2] == "com/"
    assert first[10][:2] == ("b:", "//c/d") and first[11][2] == "com/" and first[12][:2] == ("x.org", "")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_mined_rules(spark):
    pages = [(i, f"http://h{i}.bad.org/p/{i}") for i in range(30)] + [(100 + i, f"http://g{i}.good.org/q/{i}") for i in range(30)]
    rules = [("block", f"h{i}.bad.org", "/") for i in range(20)] + [("allow", f"g{i}.good.org", "/") for i in range(20)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).where("rule is null").collect()
    clash = spark.createDataFrame([(*p, "mine", "mine", "mine") for p in pages], "page_id long, url string, _tokens string, row string, a0 string")
    assert {(r._tokens, r.row, r.a0) for r in url_filter.filter_urls(clash, rules).collect()} == {("mine",) * 3}
    assert len(got) == 20 and all(r.verdict == ("block" if r.page_id < 100 else "allow") and r.mined_confidence == 1.0 for r in got)


def test_rules_keep_their_confidence(spark):
    """A token in all URLs cannot become a rule because busier URLs have more tokens; pairs that only repeat a token are no rules."""
    pages = [(i, f"http://b{i}.x.org/") for i in range(20)] + [(100 + i, f"http://a{i}.y.org/" + "/".join(f"s{k}" for k in range(12)) + "?u=1&v=2&w=3") for i in range(20)] + [(200, "http://new.z.org/q"), (201, "http://new.z.org/s9"), (202, "http://new.x.org/")]
    df = spark.createDataFrame([(i, u, "mine") for i, u in pages], "page_id long, url string, Host string")
    rules = [("block", f"b{i}.x.org", "/") for i in range(20)] + [("allow", f"a{i}.y.org", "/") for i in range(20)]
    got = url_filter.filter_urls(df, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence"]
    got = {r.page_id: r for r in got.collect()}
    assert got[200].mined_rule is None and got[200].verdict == "allow"
    assert (got[201].verdict, got[201].mined_rule, got[201].mined_confidence) == ("allow", "path=s9", 1.0)
    assert got[202].verdict == "block"
    labelled = spark.createDataFrame([(["a", "b", "c"], "allow")] * 6 + [(["a", "c"], "block")] * 5 + [(["b", "d"], "block")] * 4 + [(["a", "b"], "allow")] * 2, "items array<string>, verdict string")
    mined = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in url_filter.mine_rules(labelled, 0.1, 0.7, 3).collect()}
    assert mined == {(("a", "b"), "allow"): (1.0, 8 / 17), (("d",), "block"): (1.0, 4 / 17), (("b", "c"), "allow"): (1.0, 6 / 17)}


def test_rules_of_any_length(spark):
    """Only all four tokens tell these verdicts apart; a rule that a shorter one covers is not mined."""
    rows = [([t for t in "abcd" if t != gone], "allow") for gone in "abcd"] * 10 + [(list("dcba"), "block")] * 10 + [(["q"], "x" * 200), (["q", "z"], "x" * 200)] * 10
    labelled = spark.createDataFrame(rows, "items array<string>, verdict string")
    mined = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in url_filter.mine_rules(labelled, 0.1, 0.9).collect()}
    assert mined == {(("a", "b", "c", "d"), "block"): (1.0, 10 / 70), (("q",), "x" * 200): (1.0, 20 / 70), (("z",), "x" * 200): (1.0, 10 / 70)}
    pages = [(i, f"http://h{i}.org/" + "/".join(r[0])) for i, r in enumerate(rows[:50])] + [(100, "http://new.org/a/b/c/d"), (101, "http://new.org/a/b/c")]
    rules = [(r[1], f"h{i}.org", "/") for i, r in enumerate(rows[:50])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined_rule) for r in url_filter.filter_urls(df, rules, "url", 0.1, 0.9).where("rule is null").collect()}
    assert got == {100: ("block", "path=a&path=b&path=c&path=d"), 101: ("allow", None)}
    assert url_filter.mine_rules(labelled.limit(0)).count() == 0


def test_names_in_any_case_and_texts_alone(spark):
    """Columns that differ from an operator's own in case only are replaced, and a table may have nothing but texts."""
    df = spark.createDataFrame([(1, "word " * 60, "mine", "mine"), (2, None, "mine", "mine")], "doc_id long, text string, Kept string, N_bytes string")
    judged = quality_rules.judge_quality(df)
    assert [c for c in judged.columns if c.lower() in ("kept", "n_bytes")] == ["N_bytes", "kept"] and {r.kept for r in judged.collect()} == {False}
    cut = suffix_dedup.remove_repeats(df, digest=True)
    assert "N_bytes" not in cut.columns and {r.n_bytes for r in cut.collect()} == {300, 0}
    alone = df.select("text")
    assert quality_rules.judge_quality(alone).count() == 2


# 2 and 8


@pytest.mark.parametrize("classify", [quality_classifier.classify, toxicity.classify])
def test_classifiers_on_odd_input(spark, docs, labels, no_docs, classify, texts):
    got = classify(docs, labels).collect()
    assert len(got) == len(texts) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    modulus, remainder = (3, 1) if classify is quality_classifier.classify else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in got)
    assert classify(no_docs, labels).count() == 0
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_leaves_out_held_out(docs, labels):
    got = labelled.labelled_sample(docs, labels, "quality", 3, 1, per_class=10).collect()
    assert got and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in got) and max(Counter(r.label for r in got).values()) <= 10


def test_quality_query_against_brute_force(spark, docs, labels, texts):
    """Terms, idf, singular vectors, cosines and votes of the whole query from scratch; the sample is small enough that no direction is cut off."""
    q = quality_classifier
    long = "word " * 3 + "Ünïcode! 12\n" + "x" * (q.CHUNK - 5) + " crosses, the chunk. " * 40
    every = dict(enumerate(texts)) | {900: long, 901: "plain words here"}
    got = by_id(q.classify(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, long), (901, "plain words here")], "doc_id long, text string")), labels, dims=80))
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality in (0, 1) and r.doc_id in every and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.quality)

    def words(t):
        c = Counter()
        for w, n in Counter((t or "").encode().lower().split()).items():
            c[xxhash.xxh64_intdigest(w) % q.WORDS] += n
        return c

    fitted = sorted(known)
    df = Counter(w for i in fitted for w in words(every[i]))

    def vector(t):
        data, out = (t or "").encode(), np.zeros(q.N_TERMS)
        runs = [k for k, _ in itertools.groupby(q.CLASS_OF[np.frombuffer(data, np.uint8)].tolist())]
        triples = Counter(zip(runs, runs[1:], runs[2:], strict=False))
        for (a, b, c), n in triples.items():
            out[(a * q.N_CLASSES + b) * q.N_CLASSES + c] = math.sqrt(n / sum(triples.values()))
        out[q.SHAPES : q.SHAPES + q.EXTRAS] = q.shape(data)[q.SHAPES :]
        w = {k: (1 + math.log(n)) * (math.log((1 + len(fitted)) / (1 + df[k])) + 1) for k, n in words(t).items()}
        for k, x in w.items():
            out[q.SHAPES + q.EXTRAS + k] = q.WORD_SHARE * x / math.sqrt(sum(y * y for y in w.values()))
        return out

    a = np.array([vector(every[i]) for i in fitted])
    mean = a.mean(0)
    basis = np.linalg.svd(a - mean, full_matrices=False)[2][: len(fitted) - 1].T
    low = lambda x: (x - mean) @ basis / np.linalg.norm((x - mean) @ basis, axis=-1, keepdims=True)
    y = np.array([known[i] for i in fitted])
    for i, t in every.items():
        sims = low(a) @ low(vector(t))
        near = np.argsort(-sims)[:15]
        if abs(sims[near[-1]] - np.sort(sims)[-16]) < 1e-5:
            continue  # a tie at the edge
        w = np.maximum(sims[near], 1e-6) ** 4
        assert got[i].score == pytest.approx((w * y[near]).sum() / w.sum(), abs=1e-4)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    n, terms = 1000, [f"t{i}".encode() for i in range(30)]
    w = rng.random((n, 30)) * (rng.random((n, 30)) < 0.1)
    norm = np.sqrt((w * w).sum(1))
    w[norm > 0] /= norm[norm > 0, None]
    index = toxicity.BlockMaxIndex({t: i for i, t in enumerate(terms)}, rng.random(30) + 1, np.ascontiguousarray(w.T), np.arange(n), (rng.random(n) > 0.5).astype(float), 15)
    for _ in range(50):
        text = b" ".join(rng.choice(terms, rng.integers(1, 12))).decode()
        query = index.vector(text)
        q = np.zeros(30)
        for t, c in query:
            q[t] = (1 + math.log(c)) * index.idf[t]
        sims = w @ (q / np.sqrt((q * q).sum()))
        want = sorted(np.flatnonzero(sims > 1e-15), key=lambda i: (-round(sims[i], 12), i))[:15]
        numbers, cosines = index.nearest(query)
        assert numbers.tolist() == want and np.allclose(cosines, sims[want])


def test_groups_of_queries_find_what_each_finds():
    """Common and rare terms, copies of examples, more queries than a group holds; the group a query is in changes no bit of its cosines."""
    rng = np.random.default_rng(2)
    n, terms = 700, [f"t{i}" for i in range(400)]
    w = rng.random((n, 400)) * (rng.random((n, 400)) < np.where(np.arange(400) < 20, 0.5, 0.03))
    w[n // 2 :] = w[: n - n // 2]
    w /= np.sqrt((w * w).sum(1))[:, None]
    index = toxicity.BlockMaxIndex({t.encode(): i for i, t in enumerate(terms)}, rng.random(400) + 1, np.ascontiguousarray(w.T), np.arange(n), (rng.random(n) > 0.5).astype(float), 15)
    texts = [" ".join(rng.choice(terms, rng.integers(1, 60))) for _ in range(toxicity.GROUP + 20)]
    queries = index.vectors(texts)
    for query, (numbers, cosines) in zip(queries, index.nearest_all(queries), strict=True):
        q = np.zeros(400)
        q[query[:, 0]] = (1 + np.log(query[:, 1])) * index.idf[query[:, 0]]
        sims = w.astype(np.float32).astype(float) @ (q / np.sqrt((q * q).sum()))
        assert numbers.tolist() == sorted(np.flatnonzero(sims > 1e-15), key=lambda i: (-round(sims[i], 12), i))[:15] and np.allclose(cosines, sims[numbers])
        alone = index.nearest(query)
        assert (alone[0] == numbers).all() and (alone[1] == cosines).all()
    judged = list(index.judge_all([None, *texts, "", "unknown"]))
    assert judged[0] == judged[-1] == judged[-2] == (index.prior, [], []) and len(judged) == len(texts) + 3


def test_toxic_words_are_found(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[3:3] = rng.sample(["nasty", "vile", "foul", "mean"], 3)
        rows.append((i, " ".join(words).title(), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.classify(docs.drop("toxic"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got) and all(r.neighbours for r in got if r.toxic)
    assert toxicity.reject(docs, docs).count() == 300


def test_toxicity_query_against_brute_force(spark, docs, labels, texts):
    """Terms, weights, cosines and votes of the whole query from scratch."""
    every = dict(enumerate(texts)) | {900: "alpha " * 20000 + "omega", 901: "unseen words only"}
    more = spark.createDataFrame([(i, every[i]) for i in (900, 901)], "doc_id long, text string")
    got = by_id(toxicity.classify(docs.select("doc_id", "text").unionByName(more), labels))
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.toxic)
    prior = (sum(known.values()) + 1) / (len(known) + 2)
    fitted = sorted(set(known) & set(every))

    def terms(t):
        return Counter(bytes(c if c > 127 or chr(c).isalnum() else 32 for c in (t or "").encode()).lower().split())

    counts, n = {i: terms(every[i]) for i in fitted}, len(fitted)
    n1 = sum(known[i] for i in fitted)
    idf = {}
    for w in {w for c in counts.values() for w in c}:
        both, a = sum(w in c for c in counts.values()), sum(w in counts[i] and known[i] for i in fitted)
        b, spread = both - a, both * (n - both) * n1 * (n - n1)
        chi = n * (a * (n - n1 - b) - b * (n1 - a)) ** 2 / spread if spread else 0.0
        idf[w] = (math.log((1 + n) / (1 + both)) + 1) * math.sqrt(1 + chi)

    def vector(c):
        v = {w: (1 + math.log(k)) * idf[w] for w, k in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: vector(c) for i, c in counts.items()}
    for i, t in every.items():
        q = vector(terms(t))
        sims = {e: sum(x * v.get(w, 0.0) for w, x in q.items()) for e, v in examples.items()}
        near = sorted((e for e in sims if sims[e] > 1e-9), key=lambda e: (-round(sims[e], 6), e))[:15]
        want = prior if not q else (sum(sims[e] * known[e] for e in near) + toxicity.DOUBT * prior) / (sum(sims[e] for e in near) + toxicity.DOUBT)
        assert got[i].score == pytest.approx(want, abs=1e-3) and len(got[i].neighbours) == len(near)


def test_every_term_counts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(20)), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    near = [(1000 + i, t + " unseen", None) for i, t, _ in rows]
    got = by_id(toxicity.classify(docs.unionByName(spark.createDataFrame(near, docs.schema)), docs))
    fitted = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert all(got[1000 + i].neighbours[0] == i and got[1000 + i].cosines[0] > 0.99 for i in fitted)


def test_one_toxic_word_is_enough(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1000):
        words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["nasty", "vile", "foul", "mean"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lone = spark.createDataFrame([(5000, "vile", 1), (5001, "Foul!", 1), (5002, "abcd", 0), (5003, "", 0)], docs.schema)
    got = by_id(toxicity.classify(docs.unionByName(lone), docs))
    assert all(got[i].predicted == toxic for i, _, toxic in rows + [tuple(r) for r in lone.collect()])


# 3


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, ids, radius=2):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, points, strict=True):
        for j, b in zip(ids, points, strict=True):
            if i < j and bin(a ^ b).count("1") <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, docs, texts, no_docs):
    got = by_id(simhash.near_duplicates(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))))
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(list(prints.values()), list(prints))
    assert got.pop(None).component_id is None
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_linking_large_sets(spark):
    rng = np.random.default_rng(3)
    flip = lambda x, n: np.bitwise_xor.reduce([x] + [np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64) for _ in range(n)])
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    crowd = flip(np.full(6000, base[0]), 4)
    points = np.unique(np.concatenate((base, flip(base, 1), flip(base, 2), crowd)))
    rng.shuffle(points)
    forest = simhash.Forest(len(points))
    for k in range(0, len(points), 256):
        i, j = np.nonzero(np.bitwise_count(points[k : k + 256, None] ^ points[None]) <= 2)
        forest.join(i + k, j)
    assert (simhash.link(points, 2) == forest.root).all()
    routed = simhash.Forest(len(points))
    for _, at in simhash.route(simhash.top_tree(np.sort(points)[::5], 16, 2), points, np.arange(len(points)), 2):
        routed.join(at, at[simhash.link(points[at], 2)])
    assert (routed.root == forest.root).all()


def test_crowd_is_split(spark, monkeypatch):
    """300,000 fingerprints within five bits of each other: linked by shared neighbours, as a tree links them."""
    rng = np.random.default_rng(13)
    center = rng.integers(0, 2**63, dtype=np.uint64)
    crowd = np.unique(np.bitwise_xor.reduce([np.full(400_000, center)] + [np.where(rng.random(400_000) < 0.8, np.uint64(1) << rng.integers(0, 64, 400_000).astype(np.uint64), np.uint64(0)) for _ in range(5)]))[:300_000]
    tree = simhash.top_tree(np.sort(crowd[::5]), len(crowd), 2)
    shards = {shard: len(at) for shard, at in simhash.route(tree, crowd, np.arange(len(crowd)), 2) if len(at)}
    assert all(n < 2 * simhash.CROWD_ROWS for shard, n in shards.items() if shard > 0) and any(shard < 0 for shard in shards)
    some = crowd[rng.permutation(len(crowd))[:3000]]
    for radius in (0, 1, 2):
        rows = spark.createDataFrame([(int(p), i) for i, p in enumerate(some.view(np.int64))], "fp long, rep long")
        forest = simhash.Forest(len(some))
        links = simhash.neighbour_links(rows, radius).collect()
        forest.join(np.array([r.a for r in links], np.int64), np.array([r.b for r in links], np.int64))
        assert (forest.root == simhash.link(some, radius)).all()


def test_link_in_large_nodes():
    """Nodes that no ball splits, with pairs denied: against all pairs."""
    rng = np.random.default_rng(14)
    points = rng.integers(0, 4, 6000, dtype=np.uint64)
    odd = rng.random(6000) < 0.4
    close = lambda a, b: (odd[a] == odd[b]) & ((a + b) % 3 > 0)
    forest = simhash.Forest(6000)
    for k in range(0, 6000, 500):
        i, j = np.nonzero(np.bitwise_count(points[k : k + 500, None] ^ points[None]) <= 1)
        fits = close(i + k, j)
        forest.join((i + k)[fits], j[fits])
    assert (simhash.link(points, 1, close) == forest.root).all()


def test_near_copies(spark):
    rng = random.Random(15)
    base = [prose_of(rng, 300) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        w = t.split()
        w[rng.randrange(300)] = "edited"
        w[rng.randrange(300)] = "again"
        rows.append((100 + i, " ".join(w).upper()))  # similarity about 0.94
        rows.append((200 + i, " ".join(w[:150]) + " " + prose_of(rng, 150)))  # about 0.33
    rows += [(None, base[0]), (None, prose_of(rng, 80)), (3, prose_of(rng, 90)), (300, None), (301, ""), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    judged = simhash.near_copies(df)
    named = df.select("doc_id", "text", *shared.identity("doc_id", "text")).distinct().join(judged, ["_h1", "_h2"])
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in named.where("keep").collect())
    assert kept == sorted([(False, i) for i in range(12)] + [(False, 200 + i) for i in range(12)] + [(False, 3), (False, 300), (True, 0)])
    assert named.where("doc_id = 0").first().times == 2 and simhash.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("offers, leaf", [(2, 1024), (1, 8)])
def test_near_copies_are_exact(spark, monkeypatch, offers, leaf):
    """Similarities all around 0.8, and a crowd around one text: no link below it, and nearly all above; with one offer and small leaves it takes rounds."""
    monkeypatch.setattr(simhash, "OFFERS", offers), monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    rng = random.Random(16)
    rows = []
    for i in range(60):
        w = prose_of(rng, 250).split()
        rows.append((10 * i, " ".join(w)))
        edited = list(w)
        for k in rng.sample(range(250), 2 + i % 7):  # similarity about 0.92 to 0.7
            edited[k] = "edited"
        rows.append((10 * i + 1, " ".join(edited)))
    w = prose_of(rng, 250).split()
    for i in range(120):
        edited = list(w)
        for k in rng.sample(range(250), 1 + i % 4):
            edited[k] = f"e{i}"
        rows.append((2000 + i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in df.select("doc_id", *shared.identity("doc_id", "text")).join(simhash.near_copies(df).where("keep"), ["_h1", "_h2"]).collect()}
    sets = [(i, set(simhash.shingle_set(t, 5).tolist())) for i, t in rows]
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if len(x & y) >= 0.8 * len(x | y)]
    near = defaultdict(set)
    for i, j in links:
        near[i].add(j), near[j].add(i)
    dropped = {i for i, _ in rows} - kept
    assert all(near[i] for i in dropped)
    want = sum(1 for i, _ in rows[:120] if i % 10 and near[i])
    assert sum(i < 1000 for i in dropped) >= 0.9 * want > 20
    assert len([i for i in kept if i >= 2000]) == 1


def test_meetings():
    """Candidates by halves of a piece against brute force, one by one and where so many meet that pivots go first."""
    rng = np.random.default_rng(17)
    value = np.concatenate([rng.integers(0, 1 << 24, 40), rng.integers(0, 1 << 24, 3).repeat(60)])
    value[40:] ^= np.where(rng.random(180) < 0.7, 1 << rng.integers(0, 24, 180), 0)
    check = rng.integers(0, 1 << 63, (4, 2), dtype=np.uint64)[rng.integers(0, 4, len(value))]
    brute = simhash.Forest(len(value))
    a, b = np.nonzero((np.bitwise_count(value[:, None] ^ value) <= 1) & (np.bitwise_count(check[:, None] ^ check).sum(2) <= 30))
    brute.join(a, b)
    for most in (1 << 20, 50, 1):
        forest = simhash.Forest(len(value))
        for half, turned in enumerate((value, (value & 4095) << 12 | value >> 12)):
            order = np.argsort(code := (half << 24) + turned)
            root = simhash.meetings(code[order], check[order], 30, most)
            forest.join(order, order[root])
        assert (forest.root == brute.root).all()


@pytest.mark.parametrize("block, offers", [(128, 16), (16, 2), (8, 0)])
def test_near_copies_of_a_crowd(spark, monkeypatch, block, offers):
    """A crowd around one text, of which about half links: no table has more rows than a few for each document, and blocks lose no link."""
    monkeypatch.setattr(simhash, "BLOCK_DOCS", block), monkeypatch.setattr(simhash, "OFFERS", offers)
    rows_of, stash = [], simhash.stash

    def counted(df):
        rows_of.append((out := stash(df)).count())
        return out

    monkeypatch.setattr(simhash, "stash", counted)
    rng = random.Random(18)
    w, rows = prose_of(rng, 150).split(), []
    for i in range(150):
        edited = list(w)
        for k in rng.sample(range(150), 1 + i % 6):
            edited[k] = f"e{i}"
        rows.append((i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = df.select("doc_id", *shared.identity("doc_id", "text"))
    kept = {r.doc_id for r in keys.join(simhash.near_copies(df).where("keep"), ["_h1", "_h2"]).collect()}
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in rows]
    forest = simhash.Forest(len(rows))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)]
    forest.join(*np.array(links).T)
    assert kept == set(forest.root.tolist()) and 10 < len(kept) < 140
    if offers:  # or each pair of blocks has links of its own
        assert max(rows_of) <= 2 * len(rows)


def prose_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in shared.smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert shared.smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def test_quality_measures(spark, docs, texts, no_docs):
    got = by_id(quality_rules.judge_quality(docs))
    for i, t in enumerate(texts):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.judge_quality(no_docs).count() == 0
    clash = quality_rules.judge_quality(docs.withColumns({c: F.lit("mine") for c in ("t", "w", "l", "row", "_t", "_w")})).first()
    assert {clash[c] for c in ("t", "w", "l", "row", "_t", "_w")} == {"mine"}


def test_deep_tokens_make_rules(spark):
    """Tokens behind the first path segment, inner host labels and query keys count."""
    pages = [(i, f"http://a.{'ads' if i % 2 else 'docs'}.x{i % 7}.org/p{i % 5}/{'promo' if i % 2 else 'guide'}/{i}?{'aff' if i % 2 else 'page'}={i}") for i in range(80)]
    rules = [("block" if i % 2 else "allow", f"a.{'ads' if i % 2 else 'docs'}.x{i % 7}.org", "/") for i in range(8)]
    more = [(100, "http://new.org/z/promo/1"), (101, "http://b.docs.new.net/"), (102, "http://new.net/?aff=1"), (103, "http://new.net/")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(pages + more, "page_id long, url string"), rules).collect()}
    assert [got[i].verdict for i in range(100, 104)] == ["block", "allow", "block", "allow"] and got[103].mined_rule is None


# 5


def test_nearest(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [float("inf")] + [1.0] * 15), (1200, [1.0]), (1250, [None] * 16), (None, [1.0] * 16), (1300, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        sims = unit @ unit[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(sims[i], 12), i))[:5]
        hits += len({i for i, _ in found} & set(want))
        assert len(found) == 5 and all(s == pytest.approx(sims[i], abs=1e-12) for i, s in found)
    assert [i for i, _ in got[0]] == [50, 51, 52, 53, 54] and hits >= 0.9 * 5 * len(got)
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_every_row_asks_and_answers(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (3, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), k=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 6)))
    half = round(math.sqrt(0.5), 6)
    first = [(1, 3, 1.0), (2, 7, half), (3, 50, 0.0), (4, 50, 0.0)]
    second = [(1, 50, 1.0), (2, 7, half), (3, 3, 0.0), (4, 50, 0.0)]
    assert sorted(got[50]) == sorted(first + second + second) and got[100] == [(1, 4, round(11 / math.sqrt(14 * 9), 6))]


def test_multi_index_finds_whole_radius():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    flips = (1 << rng.integers(0, 16, (39, 4))).astype(np.uint16) * (rng.random((39, 4)) < 0.3)
    codes[1:40] = codes[0] ^ flips.astype(np.uint16)
    index = ann.MultiIndex(codes)
    real = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2)
    for radius in (0, 3, 8, 9, 20, 63):
        seen = index.probe(codes, np.full(500, radius))
        assert (seen | (real > radius)).all() and (radius > 8 or seen.mean() < 0.2)
    assert (np.diff(ann.radii(np.linspace(1, -0.9, 50), 4, 0.9)) >= 0).all()


# 6


def test_mix(spark, docs, texts, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) + 2
    size = Counter()
    rows = [(i, t) for i, t in enumerate(texts)] + list(enumerate(texts))[:2]
    for i, t in rows:
        size[f"s{i % 3}" if i % 7 else None] += len(split_words(t))
    total = sum(size.values())
    left, target, budget = dict(zip(sorted(filter(None, size)) + [None], (5, 2, 1, 5), strict=True)), {}, 1.5 * total
    while True:
        level = {s: budget * w / sum(left.values()) for s, w in left.items()}
        full = [s for s in left if level[s] >= 2 * size[s]]
        if not full:
            target |= level
            break
        for s in full:
            target[s], budget = 2.0 * size[s], budget - 2 * size[s]
            del left[s]
    taken, largest = Counter(), max(r.size for r in got)
    for r in got:
        assert r.size == len(split_words(texts[r.doc_id])) and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= largest for s in size)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect()) and mixing.mix(no_docs).count() == 0


# 7


def brute_repeats(docs, threshold=100):
    seen, out = set(), {}
    for i, data in sorted(docs):
        covered = bytearray(len(data))
        for p in range(len(data) - threshold + 1):
            w = data[p : p + threshold]
            if w in seen:
                covered[p : p + threshold] = b"\1" * threshold
            seen.add(w)
        runs = sum(1 for k in range(len(data)) if covered[k] and not (k and covered[k - 1]))
        out[i] = (len(data), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(data, covered, strict=True) if not c)).hexdigest())
    return out


def repeat_docs(texts):
    rng = random.Random(8)
    passage = "".join(rng.choice("abc defg hijk") for _ in range(170))
    edges = lambda n: "".join(rng.choice("qwerty uiop") for _ in range(n))
    shared_ = [(1000 + k, edges(rng.randint(0, 90)) + passage[rng.randint(0, 25) : rng.randint(120, 170)] + edges(rng.randint(0, 90))) for k in range(120)]
    return [*((i, t or "") for i, t in enumerate(texts)), *shared_, (2000, "ab" * 300 + "c" * 200), (2001, "c" * 150), (2002, "é" * 200), (2003, "x" * 99)]


def test_repeats_with_odd_ids(spark, texts):
    """Null and repeated ids, texts whose 22-bit hashes collide, and a text longer than a stretch."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    tails = ["".join(rng.choice("qwertyuiop") for _ in range(75)) for _ in range(300)]
    rows = [(None, passage[:128] + t) for t in tails] + [(5, passage[50:] + t) for t in tails[:20]] + [(5, "short"), (None, None), (9, passage)]
    rows += [(11, "".join(rng.choice("zxcvbnm ") for _ in range(suffix_dedup.CHUNK + 400)))]
    rows += [(12, rows[-1][1][suffix_dedup.CHUNK - 90 : suffix_dedup.CHUNK + 120])] + rows[:2]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "doc_id long, text string, _doc string, _of string, _packed string").repartition(3)
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute_repeats([(k, (t or "").encode()) for k, (_, t) in enumerate(order)])
    want = {(i, len((t or "").encode()), want[k][3]): want[k] for k, (i, t) in enumerate(order)}
    got = suffix_dedup.remove_repeats(df, digest=True).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, r.n_bytes, r.kept_sha256] for r in got)
    assert {(r._doc, r._of, r._packed) for r in got} == {("clash",) * 3}


def test_second_pass_in_pieces(monkeypatch):
    """``match_contexts`` gives the same whether rows come at once or a few at a time."""
    import pandas as pd

    rng = np.random.default_rng(12)
    n = 3000
    df = pd.DataFrame({"kind": rng.choice([suffix_dedup.COVER, suffix_dedup.ANCHOR, suffix_dedup.ANCHOR, suffix_dedup.HOT], n).astype(np.int32), "g": rng.integers(0, 12, n), "c": rng.integers(0, 60, n), "doc": rng.integers(0, 40, n), "place": rng.integers(0, 900, n)})
    df = pd.concat([df, pd.DataFrame({"kind": np.int32(suffix_dedup.MARK), "g": [3, 7], "c": [3, 7], "doc": 0, "place": 0})])
    df = df.sort_values(["g", "kind", "c", "doc", "place"], ascending=[True, False, True, True, True], ignore_index=True)

    def run(step, rows):
        monkeypatch.setattr(suffix_dedup, "FLUSH_ROWS", step)
        monkeypatch.setattr(suffix_dedup, "OUT_ROWS", rows)
        out = pd.concat(list(suffix_dedup.match_contexts(iter([df.iloc[at : at + step] for at in range(0, n + 2, step)]))))
        spans = defaultdict(set)
        for k, d, start, length in out.loc[out["kind"] == suffix_dedup.COVER, ["kind", "doc", "place", "c"]].itertuples(index=False):
            spans[d].update(range(start, start + length))
        rest = out[out["kind"] != suffix_dedup.COVER]
        return spans, sorted(map(tuple, rest[["kind", "g", "c", "doc", "place"]].to_numpy().tolist()))

    whole = run(10**6, 10**6)
    assert all(run(step, rows) == whole for step, rows in ((7, 10**6), (50, 5), (400, 20)))


@pytest.mark.parametrize("hot", [64, 2])
def test_repeats(spark, texts, no_docs, hot, monkeypatch):
    rows = repeat_docs(texts)
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(3)
    if hot == 2:  # the way of very common passages, run in this process
        monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 2)
        found = hot_way(rows)
        assert found == {i: w[1] for i, w in brute_repeats([(i, t.encode()) for i, t in rows]).items() if w[1]}
        return
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, digest=True).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in rows])
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    whole = suffix_dedup.remove_repeats(df.withColumn("n_spans", F.lit("clash")).withColumn("more", F.lit(1)))
    assert whole.columns == ["doc_id", "more", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "span_starts", "span_ends"]


def hot_way(rows):
    """The passes of ``repeated_spans`` one after the other, without Spark."""
    import pandas as pd
    import zstandard

    def chain(passes, df):
        return pd.concat(list(passes(iter([df]))), ignore_index=True)

    texts = pd.DataFrame([(i, t.encode()) for i, t in rows if len(t.encode()) >= 100], columns=["doc", "text"])
    order = dict(by=["g", "kind", "c", "doc", "place"], ascending=[True, False, True, True, True], ignore_index=True)
    found = chain(suffix_dedup.match_contexts, chain(suffix_dedup.find_anchors, texts).sort_values(**order))
    assert (found["kind"] == suffix_dedup.HOT).any()
    open_ = found[found["kind"] != suffix_dedup.COVER]
    wanted = {d: [g[c].to_numpy() for c in ("g", "place", "kind")] for d, g in open_.groupby("doc")}
    packed = pd.DataFrame([(i, zstandard.compress(t.encode()), *wanted[i]) for i, t in rows if i in wanted], columns=["doc", "packed", "g", "place", "kind"])
    contexts = chain(suffix_dedup.cut_contexts, packed).sort_values("g", ignore_index=True)
    spans = chain(suffix_dedup.match_windows, contexts)
    whole = found[found["kind"] == suffix_dedup.COVER].rename(columns={"place": "start", "c": "length"})
    both = pd.concat([whole[["doc", "start", "length"]], spans])
    return {int(d): sum(b - a for a, b in suffix_dedup.unite(g["start"].to_numpy(), g["length"].to_numpy())) for d, g in both.groupby("doc")}


def test_workers_give_memory_back(spark):
    """What a task frees between small pieces that it keeps goes back to the system; the C library by itself would hold all 160 MB."""
    shared.bound_batches(spark)

    def each(batches):
        resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
        for _ in batches:
            first = np.ones(1 << 20)
            del first
            before, large, small = resident(), [], []
            for _ in range(20):
                large.append(np.ones(1 << 20))
                small.append(bytes(100_000))
            large.clear()
            yield pd.DataFrame({"mb": [resident() - before]})

    assert spark.range(1).coalesce(1).mapInPandas(each, "mb long").first().mb < 40


# 9


def test_bpe_like_the_library(spark, docs, texts, no_docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(9)
    library = Tokenizer.from_file(path)
    alphabet = "abcdefghe tion  ing the ' s 't \n\t éüß日本語 123 <|endoftext|> \x00 🙂 ABC ..,,!!###"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) + "<|endoftext|>" * (k % 9 == 0) for k in range(400)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 5000)), "doc_id long, text string"))
    every = dict(enumerate(texts)) | dict(enumerate(more, 5000))
    got = by_id(bpe.encode(df, path, public_tokenizers.PATTERN))
    digests = by_id(bpe.encode(df, path, public_tokenizers.PATTERN, digests=True))
    for i, t in every.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == (t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(digests[i])[1:] == want
    assert bpe.encode(no_docs, path, public_tokenizers.PATTERN).count() == 0
    plain = bpe.encode(df, path, public_tokenizers.PATTERN, decode=False)
    assert plain.columns == ["doc_id", "ids"] and {i: r.ids for i, r in by_id(plain).items()} == {i: r.ids for i, r in got.items()}


def test_plain_pattern_splits_like_regex():
    import regex

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    plain, whole, rng = bpe.plain_pattern(pattern), regex.compile(pattern), random.Random(4)
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    mixed = ["".join(rng.choice([rng.choice(every), rng.choice(every[:400]), " ", "\n", "\x1c", "\x85", "\u3000", "a", "7", "'s"]) for _ in range(50)) for _ in range(2_000)]
    for text in [every, " ".join(every), *mixed]:
        assert plain.findall(text) == whole.findall(text)
    for other in (r"\w+", r"[\S]", r"\p{Lu}+", r"a++", r"(?i:a)", r"[a--b]"):
        assert bpe.plain_pattern(other) is None


def test_few_lookups_a_token():
    """Only lengths that some entry with the same last bytes has are tried."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder, asked = bpe.TrieEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), []

    class Counted(dict):
        def get(self, key, *other):
            asked.append(key)
            return super().get(key, *other)

    encoder.ends = Counted(encoder.ends)
    rng = random.Random(8)
    words = {b" " + "".join(rng.choice(["th", "ing", "er", "ea", "keit", "ción", "ble"]) for _ in range(rng.randint(3, 6))).encode() for _ in range(500)}
    tokens = sum(len(ids) for _, ids in encoder.encode_words(words))
    assert len(asked) < 3.5 * tokens


# 10


def test_archives(spark, tmp_path):
    body = lambda k: f"<html>{'é' * 60}{k}</html>"
    rows = [(5, "http://a/\r\nX: y", body(1)), (3, None, body(1)), (9, "http://b", body(1)), (9, "http://b", body(1)), (4, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (2, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" + body(2)), (None, "u", body(1))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    got = sorted(warc.archive(pages, str(tmp_path / "w")).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(rows)
    for r in got:
        data = [(h or "").encode() for i, _, h in rows if i == r.page_id][0]
        again = data == body(1).encode() and r.page_id not in (3, None)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
    every = warc.read_archives(spark, str(tmp_path / "w"), payload=True).collect()
    assert len({r.record_id for r in every}) == len(rows)
    stored = [r for r in every if r.record_type == "revisit"]
    assert {r.block_bytes for r in stored} == {0} and {r.url for r in stored if r.page_id == 5} == {"http://a/%0D%0AX: y"}
    assert warc.archive(pages.limit(0), str(tmp_path / "none")).count() == 0
