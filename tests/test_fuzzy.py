"""Fuzzy matches against all pairs compared one by one."""

import random

import numpy as np
import pytest

from scholion.functions import text as T
from scholion.operators import fuzzy as Z

DRAW = random.Random(11)


def names(n, odd=True):
    def one():
        w = "".join(DRAW.choice("abcdeéß") for _ in range(DRAW.choice((1, 2, 3, 6, 9, 14))))
        return DRAW.choice(("", "Institute ", "Inst ", "Universität ")) + w

    return [one() for _ in range(n)] + (["", "\U0001d11e\U0001d11e", "x" * 300, "ab", "ba"] if odd else [])


def test_kernel_equals_plain_loop():
    a, b = names(400), names(400)
    pairs = [(x, y) for x, y in zip(a, b, strict=True)] + [(x, x[1:] + x[:1]) for x in a] + [(x, x) for x in a]
    got = T.jaro_winkler_pairs([x for x, _ in pairs], [y for _, y in pairs])
    assert np.allclose(got, [T.jaro_winkler_similarity(x, y) for x, y in pairs], atol=1e-12)


@pytest.mark.parametrize("least", [0.6, 0.8, 0.9])
def test_best_matches_equal_all_pairs(spark, least):
    left = [(k % 3, x) for k, x in enumerate(names(150))] + [(0, "twice"), (0, "twice"), (None, "a"), (1, None)]
    right = [(k % 2, x) for k, x in enumerate(names(150))] + [(0, "twicf"), (0, "twicg"), (0, "twicf"), (None, "a"), (1, None)]
    compared = []
    got = Z.best_matches(spark.createDataFrame(left, "b int, name string"), spark.createDataFrame(right, "b int, name string"), "b", "name", least, compared)
    want = {}
    tried = 0
    for block, x in set(left):
        found = [(round(T.jaro_winkler_similarity(x, y), 6), y) for b, y in set(right) if b == block and None not in (b, x, y)]
        tried += len(found)
        found = [f for f in found if f[0] >= least]
        if found:
            s = max(found)[0]
            want[(block, x)] = (min(y for v, y in found if v == s), s)
    rows = got.collect()
    assert {(r["b"], r["name"]): (r["match"], r["similarity"]) for r in rows} == want and len(rows) == len(want)
    assert sum(compared) < tried * (0.5 if least < 0.7 else 0.1), (compared, tried)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "b int, name string")
    one = spark.createDataFrame([(1, "a")], "b int, name string")
    assert Z.best_matches(none, one, "b", "name", 0.9).count() == 0 and Z.best_matches(one, none, "b", "name", 0.9).count() == 0


def test_blocks_are_dealt_to_cells_and_ties_are_not_compared(spark, monkeypatch):
    for name, value in {"CELL_NAMES": 60, "BOUNDS": 300, "PAIRS": 50, "TOKENS": 7}.items():
        monkeypatch.setattr(Z, name, value)
    left = [(k % 2, f"Customer#{k * 37:06d}x") for k in range(300)] + [(1, "")]
    right = [(k % 2, f"Supplier#{k * 11:06d}") for k in range(200)] + [(1, ""), (0, "")]
    compared = []
    got = Z.best_matches(spark.createDataFrame(left, "b int, name string"), spark.createDataFrame(right, "b int, name string"), "b", "name", 0.6, compared)
    want, tried = set(), 0
    for block, x in left:
        found = [(-round(T.jaro_winkler_similarity(x, y), 6), y) for b, y in right if b == block]
        tried += len(found)
        if min(found)[0] <= -0.6:
            want.add((block, x, min(found)[1], -min(found)[0]))
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert sum(compared) < tried / 3, (compared, tried)
