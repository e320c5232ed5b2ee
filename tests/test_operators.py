"""Graph, clustering and store against plain Python models."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import consolidate, graph, recall
from tidemark.operators.ranking import positions
from tidemark.sources import store, text


def test_positions(spark):
    rng = random.Random(1)
    rows = [(q, i, rng.choice([-1.0, -0.5, 0.1, 0.11, 0.9, 1.0, None, 1.5])) for q in (1, 2) for i in range(200)]
    got = {(r.q, r.id): r.p for r in positions(spark.createDataFrame(rows, "q int, id long, s double"), "q", "s", "id", "p").collect()}
    for q in (1, 2):
        mine = sorted((r for r in rows if r[0] == q and r[2] is not None and r[2] <= 1), key=lambda r: (-r[2], r[1]))
        ranks = [got[q, r[1]] for r in mine]
        assert ranks == sorted(ranks)
        assert sorted(v for k, v in got.items() if k[0] == q) == list(range(1, 201))


def model_paths(edges, start, hops):
    out, seen, queue = {}, {start}, [(start, [start])]
    for _ in range(hops):
        new = []
        for node, path in queue:
            for _, a, b in sorted(edges):
                if a == node and b not in seen:
                    seen.add(b)
                    out[b] = path + [b]
                    new.append((b, path + [b]))
        queue = new
    return out


def test_shortest_paths(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(25), rng.randrange(25)) for i in range(60)]
    df = spark.createDataFrame(edges, "id long, from_id long, to_id long")
    pairs = [(s, t) for s in (0, 3, 7) for t in range(25)]
    got = {(r.from_id, r.to_id): r.path for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "from_id long, to_id long"), 10).collect()}
    for s in (0, 3, 7):
        want = model_paths(edges, s, 10) | {s: [s]}
        assert {t: p for (f, t), p in got.items() if f == s} == want


def test_both_ends_search(spark):
    """Lengths and paths of all pairs, parallel edges, loops and hubs included, and that a start stops once its pairs are found."""
    rng = random.Random(9)
    edges = [(i, rng.randrange(30), rng.randrange(30)) for i in range(45)] + [(100 + i, i % 30, 31) for i in range(30)] + [(200 + i, 31, 40 + i) for i in range(20)] + [(300, 40, 90), (301, 90, 91), (302, 91, 92)]
    df = spark.createDataFrame(edges, "id long, from_id long, to_id long")
    nodes = [*range(30), 31, 40, 59, 90, 92]
    pairs = [(s, t) for s in nodes for t in nodes] + [(0, 999), (999, 0), (None, 1)]
    ask = spark.createDataFrame(pairs, "from_id long, to_id long")
    for hops in (10, 3):
        want = {(s, t): p for s in nodes for t, p in (model_paths(edges, s, hops) | {s: [s]}).items() if t in nodes}
        assert {(r.from_id, r.to_id): r.hops for r in graph.path_lengths(df, ask, hops).collect()} == {k: len(p) - 1 for k, p in want.items()}
        assert {(r.from_id, r.to_id): r.path for r in graph.shortest_paths(df, ask, hops).collect()} == want
    near = graph.meet_in_the_middle(df, spark.createDataFrame([(0, 31), (1, 92)], "from_id long, to_id long"), 10)
    assert all(level.where("from_id = 0").isEmpty() for level in near.ahead[2:]) and len(near.ahead) + len(near.back) - 2 == 5
    seeds = spark.createDataFrame([(3, 2), (0, 1), (7, 3)], "from_id long, seed_order int")
    got = {r.to_id: (r.origin_id, r.path) for r in graph.from_nearest_seed(df, seeds, spark.createDataFrame([(t,) for t in nodes], "to_id long")).collect()}
    best = {}
    for order, s in enumerate((0, 3, 7)):
        for t, p in (model_paths(edges, s, 10) | {s: [s]}).items():
            if t in nodes and (t not in best or (len(p), order) < best[t][0]):
                best[t] = ((len(p), order), (s, p))
    assert got == {t: b[1] for t, b in best.items()}


def test_counted_ranks(spark, monkeypatch):
    """Results with a limit have the fused scores of the full lists, with ties, null and zero vectors, filters and an entity list."""
    from tidemark.operators import vectors
    from tidemark.operators.filters import RecallOptions

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rng = random.Random(6)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
    rows = [record(i, embedding=None if i % 19 == 0 else vector(), stability=rng.choice([1.0, 40.0, 300.0]), tier=rng.choice(["episodic", "semantic"]), metadata='{"entities": [{"name": "ann", "type": "person"}]}' if i % 3 else "{}") for i in range(1, 91)]
    records = spark.createDataFrame(rows, S.RECORDS)
    edges = spark.createDataFrame([(i, rng.randrange(1, 91), rng.randrange(1, 91), rng.choice(S.EDGE_TYPES), 50.0, datetime(2024, 1, 20), None) for i in range(60)], S.EDGES)
    queries = spark.createDataFrame([(q, vector()) for q in range(5)], "query_id long, vector array<float>")
    for more in ({}, {"tier": "episodic"}, {"entity_name": "ann"}):
        options = lambda limit: RecallOptions(threshold=0.3, min_results=8, limit=limit, **more)  # noqa: B023, E731
        cols = ["query_id", "position", "id", "effective_score", "rrf_score", "strategies", "superseding_ids", "section"]
        free = recall.recall(records, edges, queries, options(None), F.lit(datetime(2024, 2, 1)))
        want = [tuple(map(str, r)) for r in free.results.orderBy("query_id", "position").select(cols).collect()]
        got = recall.recall(records, edges, queries, options(1000), F.lit(datetime(2024, 2, 1))).results.orderBy("query_id", "position").select(cols).collect()
        assert [tuple(map(str, r)) for r in got] == want and len(want) > 40
        fused = {(r.query_id, r.id): r.rrf_score for r in free.fused.collect()}
        assert all(r.rrf_score == pytest.approx(fused[r.query_id, r.id]) for r in got if "companion" not in r.strategies)
        few = recall.recall(records, edges, queries, options(3), F.lit(datetime(2024, 2, 1))).results.orderBy("query_id", "position").select(cols).collect()
        assert [tuple(map(str, r)) for r in few] == [w for w in want if int(w[1]) <= 3]


def test_all_blocks_meet(spark, monkeypatch):
    """Every pair comes out and ranks are right when both sides have several blocks and the shuffle keeps its partitions."""
    from tidemark.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(4)
        one, two = (spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(4)]) for i in range(n)], f"{k} long, v array<float>") for k, n in (("a", 50), ("b", 120)))
        assert {(r.a, r.b) for r in vectors.cosines(one, two).collect()} == {(a, b) for a in range(50) for b in range(120)}
        asked, pool = one.toDF("query_id", "vector"), two.toDF("id", "embedding").withColumns({"ret": F.lit(1.0), "named": F.lit(False)})
        found = recall.survivors(pool, asked, 0.5, 0)
        ranks = recall.count_ranks(pool, asked, found)
        want = vectors.cosines(one, two).collect()
        order = {a: [b for _, b in sorted((-r.sim, r.b) for r in want if r.a == a)] for a in range(50)}
        got = {(r.query_id, r.id): r.semantic_rank for r in ranks.collect()}
        assert {(r.a, r.b) for r in want if r.sim >= 0.5} <= set(got)
        assert all(order[a].index(b) + 1 == n for (a, b), n in got.items())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_decayed_without_scores(spark, monkeypatch):
    """Nearly decayed candidates come out for each query without a table of all scores, those that edges reach past a filter included."""
    from tidemark.operators.filters import RecallOptions

    rows = [record(i, stability=0.5 if i % 3 else 300.0, tier="episodic" if i < 15 else "semantic", embedding=[1.0, i / 10]) for i in range(1, 21)]
    edges = spark.createDataFrame([(1, 1, 16, "elaborates", 50.0, datetime(2024, 1, 20), None), (2, 1, 18, "elaborates", 50.0, datetime(2024, 1, 20), None)], S.EDGES)
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in (1, 2)], "query_id long, vector array<float>")
    found = recall.recall(spark.createDataFrame(rows, S.RECORDS), edges, queries, RecallOptions(threshold=0.3, tier="episodic", limit=5), F.lit(datetime(2024, 2, 1)))
    whole = {(r.query_id, r.id, round(r.ret, 12)) for r in found.fused.where("ret < 0.2").collect()}
    monkeypatch.setattr(recall, "rank_all", None)
    again = recall.recall(spark.createDataFrame(rows, S.RECORDS), edges, queries, RecallOptions(threshold=0.3, tier="episodic", limit=5), F.lit(datetime(2024, 2, 1)))
    got = [(r.query_id, r.id, round(r.retention, 12)) for r in again.decayed.collect()]
    assert sorted(got) == sorted(whole) and {(q, i) for q, i, _ in got} == {(q, i) for q in (1, 2) for i in [x for x in range(1, 15) if x % 3] + [16]}


def test_budget_by_doubling(spark):
    """Bursts, gaps of hours and days, equal times and several processes against a scan."""
    from tidemark.operators import salience

    rng = random.Random(8)
    base = datetime(2024, 1, 1)
    rows = []
    for p in ("a", "b", "c"):
        t = 0
        for k in range(700 if p == "a" else 60):
            t += rng.choice([0, 0, 1, 7_000, 40_000, 3_599_999, 3_600_000]) if p != "c" else rng.choice([5_000_000, 90_000_000, 1_800_000])
            rows.append((p, f"{k:04}", base + timedelta(milliseconds=t)))
    rows += [("d", f"{k:04}", base + timedelta(milliseconds=k % 3)) for k in range(230)]
    want = {}
    for p in "abcd":
        state = (None, 0, 0)
        for _, i, ts in sorted((r for r in rows if r[0] == p), key=lambda r: (r[2], r[1])):
            state, mode = salience.spend(state, round((ts - base).total_seconds() * 1000))
            want[p, i] = (state[2], state[1], mode)
    calls = spark.createDataFrame([*rows, ("e", "0", None)], "process string, id string, ts timestamp")
    got = {(r.process, r.id): (r.hour, r.call, r["mode"]) for r in salience.budget(calls).collect()}
    assert got == want | {("e", "0"): (None, None, None)}
    assert salience.budget(calls.limit(0)).count() == 0


def test_greedy_clusters(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)})
    near = set(pairs)
    want, taken = set(), set()
    for seed in range(40):
        if seed in taken:
            continue
        members = [seed]
        for x in range(seed + 1, 40):
            if x not in taken and all((m, x) in near for m in members):
                members.append(x)
        if len(members) > 1:
            taken.update(members)
            want |= {(seed, m) for m in members}
    for most in (1 << 20, 60, 0):
        got = {(r.cluster_id, r.id) for r in consolidate.greedy_clusters(spark.createDataFrame(pairs, "a long, b long"), most).collect()}
        assert got == want


def test_clusters_in_ranges(spark, monkeypatch):
    """Ids in few or many ranges give the clusters of a scan; long chains take as many written tables as the ranges need, not one for each link."""
    rng = random.Random(12)
    written = []
    cut = consolidate.cut
    monkeypatch.setattr(consolidate, "cut", lambda df: written.append(1) or cut(df))
    crowd = [(a, b) for a in range(900, 930) for b in range(a + 1, 930)]
    many = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(900)} | set(crowd))
    chain = [(i, i + 1) for i in range(400)]
    for pairs, most in ((many, 1 << 20), (many, 60), (chain, 40)):
        near, want, taken = set(pairs), set(), set()
        ids = sorted({x for p in pairs for x in p})
        for seed in ids:
            if seed in taken:
                continue
            members = [seed]
            for x in ids:
                if x > seed and x not in taken and all((m, x) in near for m in members):
                    members.append(x)
            if len(members) > 1:
                taken.update(members)
                want |= {(seed, m) for m in members}
        written.clear()
        shuffled = rng.sample([*pairs, *((b, a) for a, b in pairs[:50])], len(pairs) + 50)
        got = sorted((r.cluster_id, r.id) for r in consolidate.greedy_clusters(spark.createDataFrame(shuffled, "a long, b long"), most).collect())
        assert got == sorted(want) and len(written) < 12
    assert consolidate.greedy_clusters(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_without_copies(spark, monkeypatch):
    """Evenly spread vectors, which no cells part, are written once and not once for each cell; the pairs are those of all products."""
    import numpy as np

    from tidemark.operators import vectors

    for name, value in (("BLOCK_ROWS", 64), ("PACK_ROWS", 100), ("PART_ROWS", 300)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    written = []
    cut = vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda df: written.append(cut(df)) or written[-1])
    rng = np.random.default_rng(3)
    every = rng.standard_normal((700, 32)).astype(np.float32)
    every[5], every[6] = every[4], every[4] * 2
    rows = [*enumerate(every.tolist()), (1000, None), (1001, [0.0] * 32), (1002, [1.0, 2.0]), (1003, [2.0, 4.0]), (1004, []), (1005, [1.0, float("nan")]), (1006, [None, 1.0])]
    unit = every.astype(float) / np.sqrt((every.astype(float) ** 2).sum(1))[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.3), strict=True)} | {(a, b) for a in (1002, 1003) for b in (1002, 1003)}
    for kind in ("float", "double"):
        one, two = spark.createDataFrame(rows, f"a long, v array<{kind}>"), spark.createDataFrame(rows, "b long, v array<float>")
        written.clear()
        assert sorted((r.a, r.b) for r in vectors.cosines(one, two, 0.3).collect()) == sorted(want)
        assert sum(w.count() for w in written) <= 1400
    records = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = sorted(tuple(r) for r in consolidate.similar_pairs(records, 0.3).collect())
    assert got == sorted((a, b) for a, b in want if a < b)


def test_prune_long_chains(spark):
    # Two chains of 40: one hangs on a record that stays, the other on one that goes.
    records = spark.createDataFrame([record(i, stability=0.1) for i in range(1, 81)] + [record(100, stability=365.0)], S.RECORDS)
    links = [(i, i + 1) for i in range(1, 40)] + [(i, i + 1) for i in range(41, 80)] + [(100, 1), (3, 45)]
    edges = spark.createDataFrame([(k, a, b, "consolidates", 1.0, None, None) for k, (a, b) in enumerate(links)], S.EDGES)
    got = {r.id: r.action for r in consolidate.prune(records, edges, F.lit(datetime(2024, 2, 1))).collect()}
    assert got == {i: "tombstone" if i < 41 or i > 44 else "delete" for i in range(1, 81)}


def test_block_cosines(spark, monkeypatch):
    from tidemark.operators import vectors

    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0])]
    one, two = (spark.createDataFrame(rows, f"{k} long, v array<double>") for k in "ab")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    want = {}
    for i, x in rows:
        for j, y in rows:
            known = x is not None and y is not None
            want[i, j] = None if not known else 0.0 if len(x) != len(y) or not dot(x, x) * dot(y, y) else dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5
    for rows_at_once in (2048, 7):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", rows_at_once)
        got = {(r.a, r.b): r.sim for r in vectors.cosines(one, two.withColumn("more", F.lit("m"))).collect()}
        assert got.keys() == want.keys() and all(v is None and got[k] is None or got[k] == pytest.approx(v) for k, v in want.items())
        near = {(r.a, r.b) for r in vectors.cosines(one, two, 0.5).collect()}
        assert near == {k for k, v in want.items() if v is not None and v >= 0.5}


def test_pruned_cosines(spark, monkeypatch):
    """Clusters on the sphere, crowds of equal vectors, other lengths: the same pairs as without cells, from a small share of all pairs."""
    import numpy as np

    from tidemark.operators import vectors

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    near = (centres[rng.integers(0, 30, 900)] + 0.25 * rng.standard_normal((900, 24))).tolist()
    rows = list(enumerate(near + [near[0]] * 150)) + [(2000, None), (2001, [0.0] * 24), (2002, [1.0, 2.0]), (2003, [2.0, 4.0]), (2004, [])]
    one, two = (spark.createDataFrame(rows, f"{k} long, v array<double>") for k in "ab")
    every = np.array([v for _, v in rows[:1050]])
    unit = every / np.sqrt((every * every).sum(1))[:, None]
    for size, share in ((64, 0.25), (100_000, 1.0)):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", size)
        for least in (0.6, 0.85):
            want = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit @ unit.T >= least), strict=True)} | {(a, b) for a in (2002, 2003) for b in (2002, 2003)}
            assert {(r.a, r.b) for r in vectors.cosines(one, two, least).collect()} == want
        assert vectors.share_met(one, two, 0.85) <= share
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 64)
    assert vectors.cosines(one.limit(0), two, 0.85).count() == vectors.cosines(one, two.limit(0), 0.85).count() == 0
    again = two.unionByName(two.withColumn("b", F.col("b") + 10_000))
    copies = lambda right: vectors.dealt(one, right, 0.85)[0].select("a", "cell").distinct().count() / 1050
    assert copies(again) < 2 * copies(two)  # a vector meets what is near it, however many cells there are


def test_entities_of_equal_vectors(spark, monkeypatch):
    """Entities with equal vectors are compared once, and each probe still finds every one of them."""
    import numpy as np

    from tidemark.operators import entities

    compared = []
    cosines = entities.cosines
    monkeypatch.setattr(entities, "cosines", lambda left, right, least: compared.append(right.count()) or cosines(left, right, least))
    rng = np.random.default_rng(8)
    every = rng.standard_normal((12, 5)).round(2)
    known = [(i, f"N{i}", every[i % 12].tolist()) for i in range(120)] + [(500, "n", None)]
    probes = [(i, f"n{i}" if i % 3 else f"p{i}", (every[i % 12] + (0.3 * i / 40) * rng.standard_normal(5)).round(2).tolist()) for i in range(40)]
    ents = spark.createDataFrame(known, "id long, name string, embedding array<float>")
    asked = spark.createDataFrame(probes, "probe_id long, name string, vector array<float>")
    want = {}
    for p, name, v in probes:
        v = np.float32(v).astype(float)
        near = []
        for e, other, u in known[:-1]:
            u = np.float32(u).astype(float)
            sim = (v * u).sum() / np.sqrt((v * v).sum() * (u * u).sum())
            near += [(-round(sim, 12), e, other.lower() == name)] if sim >= 0.7 else []
        near.sort()
        same = [e for _, e, s in near if s]
        want[p] = ("exact", same[0]) if same else ("distinct", None) if not near else ("merge" if near[0][0] <= -0.85 else "llm-needed", near[0][1])
    got = {r.probe_id: (r.decision, r.entity_id) for r in entities.resolve(asked, ents).collect()}
    assert got == want and {"exact", "merge"} <= {d for d, _ in got.values()}
    assert compared == [12]


def record(i, **more):
    base = dict(
        id=i, data="d", metadata="{}", embedding=[1.0, 0.0], embedding_model_id="m", embedding_dimensions=2, tier="episodic", importance=0.5, stability=5.0, last_accessed_at=datetime(2024, 1, 1),
        access_count=2, created_at=datetime(2024, 1, 1), tombstoned=False, tombstoned_at=None, session_id="s", category=None, episode_summary=None,
    )
    return tuple((base | more).values())


def test_store(spark, tmp_path):
    at = store.Store(spark, str(tmp_path / "memory"))
    assert at.version == 0 and at.read("records").count() == 0 and at.next_id("records") == 1
    records = spark.createDataFrame([record(i) for i in range(1, 5)], S.RECORDS)
    edges = spark.createDataFrame([(1, 1, 2, "supersedes", 5.0, None, None), (2, 3, 4, "elaborates", 5.0, None, None)], S.EDGES)
    assert at.commit(records=records, edges=edges) == 1
    fork = at.fork(str(tmp_path / "fork"))
    kept, linked = store.delete(at.read("records"), at.read("edges"), spark.createDataFrame([(2,)], "id long"))
    at.commit(records=store.tombstone(kept, spark.createDataFrame([(3,)], "id long"), F.lit(datetime(2024, 2, 1))), edges=linked)
    assert [(r.id, r.tombstoned, r.data) for r in at.read("records").orderBy("id").collect()] == [(1, False, "d"), (3, True, None), (4, False, "d")]
    assert at.read("edges").count() == 1 and fork.read("records").count() == 4 and at.next_id("records") == 5


def test_model_check(spark):
    records = spark.createDataFrame([record(1)], S.RECORDS)
    recall.check_model(records, "m")
    recall.check_model(records.where("id > 9"), "other")
    with pytest.raises(recall.ModelMismatch):
        recall.check_model(records, "other")


def test_prune_order(spark):
    # 1 -> 2 -> 3 by consolidates edges: 1 goes first and takes its edge along, so 2 goes, and so on; 5 keeps 4, as it comes later.
    records = spark.createDataFrame([record(i, stability=0.1) for i in range(1, 6)], S.RECORDS)
    edges = spark.createDataFrame([(1, 1, 2, "consolidates", 1.0, None, None), (2, 2, 3, "consolidates", 1.0, None, None), (3, 5, 4, "consolidates", 1.0, None, None)], S.EDGES)
    got = {r.id: r.action for r in consolidate.prune(records, edges, F.lit(datetime(2024, 2, 1))).collect()}
    assert got == {1: "delete", 2: "delete", 3: "delete", 4: "tombstone", 5: "delete"}


def test_markdown(spark):
    md = "---\ntier: semantic\nimportance: 0.7\ntags: [a, b]\n---\nfirst body\n---\ncategory: world_fact\n---\nsecond\n"
    got = text.parse_markdown(spark.createDataFrame([("x.md", md), ("y.md", "no dashes")], "path string, text string")).orderBy("n").collect()
    assert [(r.data, r.tier, r.category, r.importance, r.tags) for r in got] == [("first body", "semantic", None, 0.7, ["a", "b"]), ("second", "episodic", "world_fact", 0.0, [])]


def test_requests(spark):
    lines = ['{"id": "1", "type": "recall", "payload": {"query": "q"}}', "broken", '{"id": "2", "type": "no"}']
    assert [r.id for r in text.parse_requests(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == ["1"]
