import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators.filters import RecallOptions


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(columns))).first()


def vec(*xs):
    return F.array(*(F.lit(float(x)).cast("float") for x in xs))


def test_cosine(spark):
    r = one(spark, X.cosine(vec(1, 0), vec(1, 0)), X.cosine(vec(1, 0), vec(0, 2)), X.cosine(vec(0, 0), vec(1, 1)), X.cosine(vec(1), vec(1, 2)), X.cosine(vec(1, 1), F.lit(None).cast("array<float>")))
    assert tuple(r) == (1.0, 0.0, 0.0, 0.0, None)


def test_decay(spark):
    now, day = F.lit(datetime(2024, 1, 11)), F.lit(datetime(2024, 1, 1))
    r = one(spark, X.retention(day, F.lit(10.0), now), X.growth(F.lit(1.0)), X.growth(F.lit(0.0)), X.initial_stability(F.lit(1.0)), X.strengthened(F.lit(300.0), F.lit(0.0), F.lit(1.0)), X.strengthened(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    assert r[0] == pytest.approx(math.exp(-1))
    assert tuple(r)[1:] == (1.0, 3.0, 10.0, 365.0, 0.5)


@pytest.mark.parametrize(
    "raw, action, importance",
    [
        ({"action": "insert", "importanceScore": 0.4, "goalRelevance": 1.7}, "insert", 1.0), ({"action": "ponder", "importanceScore": 0.9}, "skip", 0.0),
        ({"action": "relate", "importanceScore": "x"}, "relate", 0.0), ({"action": "insert", "importanceScore": -3}, "insert", 0.0),
    ],
)
def test_parse_score(spark, raw, action, importance):
    s = one(spark, X.parse_score(F.lit(json.dumps(raw))))[0]
    assert (s["action"], s["importance"], s["entities"]) == (action, importance, [])


def test_entities_and_tags(spark):
    raw = json.dumps([{"name": "Ann", "type": " Person "}, {"name": "x", "type": ""}, {"type": "y"}])
    r = one(spark, X.parse_entities(F.lit(raw)), X.parse_entities(F.lit('"no"')), X.external_tags(F.array(F.lit("a"), F.lit("llm_rate_limited"), F.lit("a"))), X.visible_tags(F.array(F.lit("f" * 64), F.lit("b"))))
    assert [tuple(e) for e in r[0]] == [("ann", "person")] and r[1] == [] and r[2] == ["a", "a"] and r[3] == ["b"]


def test_consolidation_answer(spark):
    good = json.dumps({"summary": "s", "confidence": 0.4, "preservedFacts": ["f"], "uncertainties": []})
    r = one(spark, X.parse_consolidation(F.lit(good)), X.parse_consolidation(F.lit('{"summary": "s"}')))
    assert (r[0]["summary"], r[0]["confidence"]) == ("s", 0.4) and tuple(r[1]) == ("", 0.0, [], [])


def test_options():
    for bad in ({"threshold": 2}, {"limit": 0}, {"sort": "x"}, {"tier": "x"}, {"min_stability": 400}):
        with pytest.raises(ValueError):
            RecallOptions(**bad)
