"""The index of coarse cells against a full scan."""

import numpy as np
import pytest
from graphloom.operators.nearest import Index


def full(x, y, k):
    x, y = (np.array(a, float) for a in (x, y))
    s = x @ y / (np.linalg.norm(x, axis=1) * np.linalg.norm(y))
    return np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:k].tolist()


@pytest.mark.parametrize(("piece", "block"), [(8192, 1024), (50, 7)])
def test_search_equals_a_full_scan(spark, piece, block):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(12, 8))
    x = (middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.1).tolist()
    x += [x[0]] * 30 + [[v * 1e200 for v in x[1]]]
    rows = [(i, v) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0] * 3)]
    index = Index(spark.createDataFrame(rows, "id long, vector array<double>"), cells=20)
    asked = [(f"q{i}", x[i]) for i in range(0, len(x), 20)] + [("far", (-np.array(x[3])).tolist()), ("none", [0.0] * 8)]
    questions = spark.createDataFrame(asked, "question string, vector array<double>")
    got = {}
    for r in index.search(questions, 7, piece=piece, block=block).orderBy("question", "place").collect():
        got.setdefault(r["question"], []).append(r["id"])
    sane = [[v / 1e200 for v in a] if max(map(abs, a)) > 1e100 else a for a in x]
    assert got == {q: full(sane, v if max(map(abs, v)) < 1e100 else x[1], 7) for q, v in asked if q != "none"}
    # most cells cannot hold a near vector
    pairs = index.needed(questions.where("question <> 'none' and question <> 'far'").selectExpr("question", "vector AS v"), 7).count()
    assert pairs < 0.5 * 20 * (len(asked) - 2)


def test_few_rows_and_none(spark):
    few = Index(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>"))
    q = spark.createDataFrame([(0, [1.0, 1.0])], "question long, vector array<float>")
    assert [(r["id"], round(r["score"], 6), r["place"]) for r in few.search(q, 5).collect()] == [(1, 0.707107, 1), (2, 0.707107, 2)]
    none = Index(spark.createDataFrame([(1, None)], "id long, vector array<double>"))
    assert none.search(q, 5).count() == 0
