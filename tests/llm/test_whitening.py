import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import MEDIUM
from tallyloom.llm import whitening

KIND = "vec_id long, embedding array<float>, x int, n int, whitened string, at int"


def frame(spark, vectors, kind="double"):
    rows = [(i, v, 1, 2, "c", 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KIND.replace("float", kind))


def plain(vectors, most=4):
    """Exact sums over the different whole vectors, in Python's integers; the covariance decomposed in doubles."""
    whole = [[max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in v] for v in vectors]
    d = max(map(len, whole))
    whole = [v + [0] * (d - len(v)) for v in whole]
    fit = sorted({tuple(v) for v in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit]
    covariance = np.array([[sum(o[i] * o[j] for o in off) / n**3 for j in range(d)] for i in range(d)])
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1][:most], components[:, ::-1][:, :most]
    found = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in whole]
    white = np.array(found, dtype=float) / n @ components / np.sqrt(values)
    return n, [sum(c * c for c in o) for o in found], white, values / np.trace(covariance)


def held(df, vectors, components):
    n, deviations, white, explained = plain(vectors)
    rows = df.collect()
    assert len(rows) == components * len(vectors)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    for c in range(components):
        own = sorted((r for r in rows if r.component == c + 1), key=lambda r: r.vec_id)
        assert [int(r.deviation_exact) for r in own] == deviations
        assert [r.deviation for r in own] == [v if v < 2**63 else None for v in deviations]
        got = np.array([r.whitened for r in own])
        assert np.allclose(got, white[:, c], rtol=1e-6, atol=1e-9) or np.allclose(got, -white[:, c], rtol=1e-6, atol=1e-9)
        assert own[0].explained == pytest.approx(explained[c], rel=1e-9)


def test_against_plain_integers(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 9)) * np.arange(1, 10) + rng.normal(size=9)).tolist()
    vectors += vectors[:40] * 3  # copies count once
    held(whitening.whiten(frame(spark, vectors).repartition(5)), vectors, 4)


def test_offsets_far_larger_than_the_spread(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.integers(-50, 50, (200, 5)) * np.arange(1, 6) + 2.0**44).tolist()  # squares in doubles would leave nothing of this
    held(whitening.whiten(frame(spark, vectors)), vectors, 4)


def test_numbers_beyond_a_long(spark):
    vectors = [[1e300, 3.0], [-1e300, 4.0], [2.0, 5.0], [2.0**55, 1.0]]
    rows = whitening.whiten(frame(spark, vectors), most=1).collect()
    want = plain(vectors, 1)[1]
    assert [int(r.deviation_exact) for r in sorted(rows, key=lambda r: r.vec_id)] == want and {r.deviation for r in rows} == {None}


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=3, max_size=3), min_size=1, max_size=20), st.lists(st.integers(-(2**63), 2**63 - 1), min_size=3, max_size=3))
def test_scatter_is_exact(vectors, shift):
    sums, products = whitening.scatter(whitening.shifted(np.array(vectors, np.int64), shift))
    y = [[a - b for a, b in zip(v, shift, strict=True)] for v in vectors]
    assert [int(v) for v in sums] == [sum(c) for c in zip(*y, strict=True)]
    assert [[int(v) for v in r] for r in products] == [[sum(v[i] * v[j] for v in y) for j in range(3)] for i in range(3)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [1.0, None], [nan, 1.0], [inf, 2.0], [1.0, -inf], [], [1.0], [1.0, 0.0], [3.0, 1.0], [3.0, 1.0], [0.0, 5.0]]
    got = whitening.whiten(frame(spark, vectors, "float"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    rows = got.collect()
    assert {r.vec_id for r in rows} == {5, 6, 7, 8, 9, 10} and {r.n for r in rows} == {4} and len(rows) == 12
    by = {(r.vec_id, r.component): r.whitened for r in rows}
    assert by[6, 1] == by[7, 1] and by[8, 2] == by[9, 2]
    line = whitening.whiten(frame(spark, [[float(i), 2.0 * i] for i in range(9)])).collect()  # one component only
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    for few in ([], [None], [[]], [[1.0, 2.0]] * 3):
        assert whitening.whiten(frame(spark, few)).collect() == []
    ids = spark.createDataFrame([(None, [1.0, 2.0]), ("b", [2.0, 1.0])], "vec_id string, embedding array<float>")
    assert {r.vec_id for r in whitening.whiten(ids).collect()} == {None, "b"}


def test_whole_table(spark):
    table = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    held(whitening.op13_whitening(spark, MEDIUM), [r.embedding for r in rows], 4)
