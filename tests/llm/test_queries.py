"""The registered queries with SQL twins against DuckDB, held-out accuracy of the classifiers, and the pipeline against brute force."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_repeats
from tidemark.llm import queries as llm

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_twin(spark, duck, name):
    got = llm.queries()[name](spark, DATA)
    cursor = duck.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name, label, least", [("op2_quality_classifier", "quality", 0.9), ("op8_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    right = llm.queries()[name](spark, data).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert right >= least


def test_pipeline(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids = [r.doc_id for r in docs.collect()]
        assert set(ids) <= set(before)
        seen[name] = (before, ids, docs)
    before, ids, out = seen["suffix_array_dedup"]
    want = brute_repeats([(i, t.encode()) for i, t in before.items()])
    assert {r.doc_id: len(r.text.encode()) for r in out.collect() if want[r.doc_id][1] == 0} == {i: w[0] for i, w in want.items() if not w[1] and i in set(ids)}
    assert sum(w[1] for w in want.values()) > 0
    assert len(seen["source_mixing"][1]) > len(set(seen["source_mixing"][1]))
    assert sorted(seen["bpe"][1]) == sorted(seen["source_mixing"][1])


def test_stages_keep_rows_apart(spark):
    """Null and repeated ids, equal rows, extra columns and empty tables in every stage but the last."""
    long = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{i}" for i in range(120))
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (2, other, "en", "s", 2), (None, other + " x", "en", "s", 3), (None, "a b c d e f", "en", None, 4), (None, "g h i j k l", "en", None, 4), (7, None, None, None, None), (7, None, None, None, None), (8, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"_h1": F.lit("clash"), "keep": F.lit("clash")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, DATA).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs, DATA).count() == len(rows)
    near = sorted(map(repr, (tuple(r)[:2] for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect())))
    assert near == sorted(map(repr, [(1, long), (2, other), (None, "a b c d e f"), (None, "g h i j k l"), (7, None)]))
    passages = corpus_pipeline.drop_repeated_passages(spark, docs, DATA).collect()
    assert len(passages) == len(rows) - 1 and sum(r.text is None for r in passages) == 2 and sum(r.text == other for r in passages) == 1 and sum(r.text == long for r in passages) == 1
    from tidemark.llm import mixing

    taken = mixing.mix(docs.select(*corpus_pipeline.COLUMNS)).agg(F.sum("copies")).first()[0]
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA).collect()
    assert len(mixed) == taken and all(r.text for r in mixed)


def test_toxicity_stage_is_the_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).collect()}
    assert kept == {r.doc_id for r in llm.queries()["op8_toxicity"](spark, DATA).where("predicted = 0").collect()}
