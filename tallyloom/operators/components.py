"""Connected components of graphs whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, materialize


def _lower_to_min(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v): every u learns the smallest of itself and its neighbours, m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _fingerprint(edges: DataFrame) -> tuple:
    """Rows and two order-free sums over them: equal before and after only if a round changed nothing."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum((h % 1000000007).cast("decimal(38,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected graph.

    edges: two columns of one orderable type, the ends of each edge. Edges with a null end and
    self-loops link nothing and are left out; repeated edges are harmless.
    Returns (node, component): one row per node that has an edge, component being the smallest
    node that it reaches. An empty input gives an empty result.

    Each round points every larger neighbour at the local minimum (large star), then every node
    at the minimum of its smaller neighbours (small star), until the edges form stars. Both steps
    are a partial aggregate and an equi-join whose hot keys AQE may split; the number of rounds
    grows with the logarithm of the longest path. Each round is written to the shared folder, so
    no lineage builds up and a lost executor costs only the round at work.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b)))
    now = materialize(now.where(~F.col(now.columns[2])).select("u", "v").distinct(), "edges")
    seen, before = _fingerprint(now), None
    while seen[0] and seen != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lower_to_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _lower_to_min(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "edges")
        drop(now)
        now, before, seen = after, seen, _fingerprint(after)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that link the same nodes by shorter paths: inside each range of u every node points at the
    smallest one that it reaches there. Long chains of neighbours in order shrink to a link or two a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        kind = pa.null()

        def find(x):  # noqa: ANN001, ANN202
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for b in batches:
            kind = b.schema.field(0).type
            for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                root.setdefault(u, u)
                root.setdefault(v, v)
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
        nodes = [x for x in root if find(x) != x]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["u", "v"])

    a, b = edges.columns
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    of = known.schema["u"].dataType.simpleString()
    return known.repartitionByRange("u").mapInArrow(run, f"u {of}, v {of}")
