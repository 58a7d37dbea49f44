from collections import defaultdict
from itertools import product

from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import MEDIUM
from tallyloom.llm import mixing


def test_contract(spark):
    rows = mixing.op5_mixing(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, sizes, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        target[r.source] = r.target
    assert all(sizes[r.source] == r.source_size for r in rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-3


def test_reruns_agree(spark):
    once = sorted(map(tuple, mixing.op5_mixing(spark, MEDIUM).collect()))
    assert once == sorted(map(tuple, mixing.op5_mixing(spark, MEDIUM).collect()))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.floats(0, 3))
def test_water_fill(sizes, share):
    total = share * sum(sizes)
    got = mixing.water_fill(sizes, [float((3, 1, 2)[i % 3]) for i in range(len(sizes))], total)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
    assert abs(sum(got) - min(total, 2 * sum(sizes))) < 1e-6


def _best(capacity, members, quota):
    """(most words, least cost) by trying all ways."""
    ways = [[w for w in product(range(2 * c + 1), repeat=len(m)) if sum(w) <= 2 * c] for c, m in zip(capacity, members, strict=True)]
    best = (0, 0)
    for sent in product(*ways):
        into = [0] * len(quota)
        for w, m in zip(sent, members, strict=True):
            for x, s in zip(w, m, strict=True):
                into[s] += x
        if all(i <= q for i, q in zip(into, quota, strict=True)):
            cost = sum(max(0, sum(w) - c) for w, c in zip(sent, capacity, strict=True))
            best = max(best, (sum(into), -cost))
    return best


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([[0], [1], [0, 1], [1, 2], [0, 2]])), min_size=1, max_size=3), st.lists(st.integers(0, 4), min_size=3, max_size=3))
def test_route_is_a_least_cost_maximum_flow(patterns, quota):
    capacity, members = [c for c, _ in patterns], [m for _, m in patterns]
    sent = mixing.route(capacity, members, quota)
    into = [sum(w[m.index(s)] for w, m in zip(sent, members, strict=True) if s in m) for s in range(3)]
    assert all(i <= q for i, q in zip(into, quota, strict=True)) and all(x >= 0 for w in sent for x in w)
    cost = sum(max(0, sum(w) - c) for w, c in zip(sent, capacity, strict=True))
    assert (sum(into), -cost) == _best(capacity, members, quota)


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["x"] if i % 3 else ["x", "y"]) for i in range(60)], "doc_id long, text string, of array<string>")
    got = mixing.mix(docs, F.col("of"), weights=(1, 1), share=1.0).collect()
    assert abs(sum(r.taken for r in got) - 600) <= 2


def test_awkward_rows(spark):
    got = mixing.mix(awkward(spark), F.array("source"))
    assert got.count() == 9 and len(set(got.columns)) == len(got.columns)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].size == by[4].size == by[5].size == 0 and by[3].taken == 0
    assert by[6].size == 60_000
    assert mixing.mix(empty(spark), F.array("source")).collect() == []
