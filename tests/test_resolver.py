"""Contests settled by components against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import components, pools


def both(ready):
    """A driver takes all its resources if two are open."""
    two = ready.groupBy("driver").agg(F.collect_list("resource").alias("all")).where("size(all) = 2")
    return two.select("driver", F.explode("all").alias("resource"))


def rules():
    """both() and the first open resource for one driver; functions of a function, as workers don't import tests."""
    claim = lambda rows: [{"driver": r["driver"], "resource": r["resource"]} for r in rows]
    return lambda rows: claim(rows) if len(rows) == 2 else [], lambda rows: claim(sorted(rows, key=lambda r: r["resource"])[:1])


def plain(edges):
    of, gone, want = {}, set(), set()
    for d, r in edges:
        of.setdefault(d, []).append(r)
    for d in sorted(of):
        open_ = [r for r in of[d] if r not in gone]
        if len(open_) == 2:
            gone |= {*open_}
            want |= {(d, r) for r in open_}
    return want


def frame(spark, edges):
    return spark.createDataFrame([(d, d, r) for d, r in edges], "driver string, ord string, resource string")


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_a_chain_takes_few_jobs(spark):
    """Every second driver takes what the next one needs, so each waits for the one before it."""
    def chain(n):
        edges = sorted({(f"D{i:06d}", f"R{i + j:06d}") for i in range(n) for j in (0, 1)})
        run = lambda: {tuple(r) for r in pools.resolve(frame(spark, edges), both, rule=rules()[0]).select("driver", "resource").collect()}
        got, jobs = jobs_of(spark, f"chain {n}", run)
        assert got == plain(edges) and len(got) == n + n % 2
        return jobs

    few, many = chain(50), chain(2000)
    assert many <= few + 4, (few, many)


@pytest.mark.parametrize("most", [10**6, 12, 0])
@pytest.mark.parametrize("greedy", [False, True])
def test_small_and_large_components(spark, most, greedy):
    """most: 12 leaves some components to rounds, 0 all of them."""
    rng = random.Random(most)
    edges = sorted({(f"D{d:03d}", f"R{20 * (d // 20) + rng.randint(0, 14):03d}") for d in range(120) for _ in range(rng.randint(1, 3))})
    gone, want = set(), set()
    for d in sorted({d for d, _ in edges}):
        open_ = [r for x, r in edges if x == d and r not in gone]
        if greedy and open_:
            want.add((d, min(open_)))
            gone.add(min(open_))
        elif len(open_) == 2:
            want |= {(d, r) for r in open_}
            gone |= {*open_}
    least = lambda ready: ready.groupBy("driver").agg(F.min("resource").alias("resource"))
    both_rule, first = rules()
    got = pools.resolve(frame(spark, edges), least if greedy else both, greedy=greedy, rule=first if greedy else both_rule, most=most)
    assert {tuple(r) for r in got.select("driver", "resource").collect()} == want


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 700)] + [(5, 5), (800, None), (None, None), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    df = spark.createDataFrame(edges, "a int, b int").repartition(6)
    for links in (df, components.contracted(df)):
        got = components.connected_components(links).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.connected_components(components.contracted(df.where("a > 999"))).collect() == []
