"""Whitening against exact arithmetic, and on null, odd, repeated and clashing input."""

import math
import os
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import queries as llm
from tidemark.llm import whitening as W


def exact(vectors):
    """Grid values, sums and the covariance as fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    far = [[n * r[k] - s[k] for k in range(d)] for r in x]
    return n, far, [[Fraction(sum(f[i] * f[j] for f in far), n**3) for j in range(d)] for i in range(d)]


def check(got, rows):
    n, far, cov = exact([v for _, v in rows])
    values, q = np.linalg.eigh(np.array(cov, float))
    values, q = values[::-1], q[:, ::-1]
    count, trace = min(8, len(values)), float(sum(cov[k][k] for k in range(len(cov))))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k + 1) for i, _ in rows for k in range(count))
    of = {i: f for (i, _), f in zip(rows, far, strict=True)}
    for r in got:
        k, f = r.component - 1, np.array(of[r.vec_id], float)
        want = f @ q[:, k] / n / math.sqrt(values[k])
        sign = np.sign(q[np.abs(q[:, k]).argmax(), k])
        assert r.n == n and int(r.deviation) == sum(v * v for v in of[r.vec_id])
        assert r.whitened == pytest.approx(sign * want, abs=1e-6)
        assert r.explained == pytest.approx(values[k] / trace, rel=1e-9) and r.identity_error < 1e-9


def test_against_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(11) * np.arange(1, 12) / 7).astype(np.float32).tolist()) for i in range(300)]
    odd = [(900, None), (901, []), (902, [None] + [0.5] * 10), (903, [float("nan")] * 11), (904, [float("-inf")] + [0.0] * 10), (905, [1.0, 2.0]), (906, [3e38] * 11)]
    df = spark.createDataFrame([(i, v, "mine", 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, component string, Whitened double").repartition(7)
    check(W.whiten(df).collect(), rows)


def test_merging_over_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.random((200, 3)))]
    monkeypatch.setattr(W, "FAN_IN", 2)
    check(W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)).collect(), rows)


def test_compensated_sums_are_exact_where_doubles_are_not():
    a = np.array([[1e8 + 1, 1.0], [1e8 + 3, -1.0], [3.0, 7.0]] * 1001)
    high, low = W.outer_sum(a)
    assert Fraction(float(high[0])) + Fraction(float(low[0])) == sum(Fraction(v) ** 2 for v in a[:, 0])
    big = np.array([1e30, 1.0, -1e30, 1e-3])
    assert sum(W.total(big[:, None], np.zeros((4, 1)))).item() == 1.001


def test_large_deviations_stay_exact():
    x = np.array([[1 << 41, 5], [7, -(1 << 40)]], np.int64)
    assert W.centred(x, 1 << 30, [3, 1 << 50]).tolist() == [[(1 << 30) * int(v) - s for v, s in zip(r, [3, 1 << 50], strict=True)] for r in x]


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0 and W.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    same = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 3 for r in same)
    line = W.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)).collect()
    assert all((r.whitened is not None) == (r.component == 1) for r in line) and max(r.explained for r in line) == pytest.approx(1)


def test_query_on_the_table(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = llm.queries()["op12_embedding_whitening"](spark, data)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), rows)
