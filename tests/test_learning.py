"""Learners on frames against plain optimisers and held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholion.operators import learning as L
from scholion.plans import QUERIES
from scholion.plans import rankings as P

SF = "/root/testdata/sf0.001"


def simplex(v):
    """The nearest point of the probability simplex, by sorting."""
    u = np.sort(v)[::-1]
    shift = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - shift[np.flatnonzero(u > shift)[-1]], 0)


def plain_strengths(pairs, beta, steps=20_000):
    """pairs: {(fa, fb): (w, n)}."""
    names = sorted({x for p in pairs for x in p})
    fa, fb = (np.array([names.index(p[k]) for p in pairs]) for k in (0, 1))
    w, n = (np.array([v[k] for v in pairs.values()], float) for k in (0, 1))
    degree = np.bincount(fa, n, len(names)) + np.bincount(fb, n, len(names))
    s = np.full(len(names), 1 / len(names))
    for _ in range(steps):
        g = beta * (w - n / (1 + np.exp(-beta * (s[fb] - s[fa]))))
        s = simplex(s + 2 / (beta * beta * degree.max()) * (np.bincount(fb, g, len(names)) - np.bincount(fa, g, len(names))))
    return dict(zip(names, s, strict=True))


@pytest.mark.parametrize("start", [None, -5.0, 0.2, 50.0])
def test_projection_equals_sorting(spark, start):
    y = np.random.default_rng(3).normal(0, 1, 40)
    over, change, _ = L.onto_simplex(spark.createDataFrame([(float(v), 0.025, 0.025) for v in y], "y double, s double, ahead double"), start)
    assert np.allclose(np.maximum(y - over, 0), simplex(y)) and change == pytest.approx(np.abs(simplex(y) - 0.025).sum())


@pytest.mark.parametrize("beta", [0.1, 6.0])
def test_strengths_equal_plain_optimiser(spark, beta):
    rng = np.random.default_rng(8)
    home = {a: a % 5 if a % 3 else 0 for a in range(40)}  # institution 0 has a third of the authors and more
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2)) if a != b})
    rows = [(a, b, float(0.3 + 0.4 * ((7 * a + b) % 5) / 4)) for a, b in edges]
    pairs = {}
    for a, b, w in rows:
        if home[a] != home[b]:
            v = pairs.setdefault((home[a], home[b]), [0.0, 0])
            v[0] += w
            v[1] += 1
    got = L.pairwise_strengths(spark.createDataFrame(rows, "a int, b int, weight double"), spark.createDataFrame(list(home.items()), "author_id int, affil_id int"), beta, 1e-7, 60)
    scores = {r["affil_id"]: r["score"] for r in got.collect()}
    want = plain_strengths(pairs, beta)
    assert sum(scores.values()) == pytest.approx(1) and scores.keys() == want.keys()
    assert all(scores[k] == pytest.approx(want[k], abs=1e-3) for k in want)


def test_strengths_without_pairs(spark):
    none = spark.createDataFrame([], "a int, b int, weight double")
    assert L.pairwise_strengths(none, spark.createDataFrame([(1, 1)], "author_id int, affil_id int")).count() == 0


def test_keywords_of_held_out_texts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(700):
        tags = [t for t, p in (("graph", 0.4), ("text", 0.3), ("rare", 0.1)) if rng.random() < p]
        words = [f"{t}{rng.integers(4)}" for t in tags for _ in range(3)] + [f"w{rng.integers(60)}" for _ in range(8)]
        rows.append((k, words, tags if k % 10 else None))
    rows += [(900, None, ["graph"]), (901, [], None)]
    df = spark.createDataFrame(rows, "id int, words array<string>, keywords array<string>")
    m = L.KeywordClassifier(df, "id", ["graph", "text", "rare", "never"], features=256)
    out = m.predict(df).cache()
    held = out.where("keywords IS NOT NULL").where(m.fold == 0)
    assert out.count() == len(rows) and L.micro_f1(held) > 0.9
    assert out.where(F.array_contains("found", "never")).count() == 0 and held.where(F.size("found") > 1).count() > 5


def test_keywords_of_documents(spark):
    out = P.keyword_classifier(spark, SF)
    held = out.where("keywords IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert L.micro_f1(held) > 0.8


def test_search_runs_the_ranking(spark):
    row = QUERIES["ML14_bayesian_search"](spark, SF).first()
    assert 0.001 <= row["age"] <= 2 and -1 <= row["value"] <= 1
