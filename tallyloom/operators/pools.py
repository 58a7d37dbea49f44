"""Open pools, claims, and the resolver for order-dependent claiming."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import drop, materialize
from .components import connected_components, contracted

checkpointed = materialize
#: Drivers that wait for each other are replayed in one task if they have so many edges at most.
REPLAYED = 100_000


def open_rows(records: DataFrame, claims: DataFrame) -> DataFrame:
    """Records (record_id) that no claim (record_id) has taken."""
    return records.join(claims.select("record_id").distinct(), "record_id", "left_anti")


def unique_within(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are alone with their keys."""
    alone = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(alone, list(keys), "left_semi")


def _early(edges: DataFrame, drivers: DataFrame) -> DataFrame:
    """Of drivers those that are first, among the drivers of edges, on every resource they have."""
    first = edges.groupBy("resource").agg(F.min("ord").alias("first"))
    own = edges.join(drivers, "driver", "left_semi")
    waiting = own.join(first, "resource").where("ord > first").select("driver").distinct()
    return drivers.join(waiting, "driver", "left_anti")


def idle_before(edges: DataFrame, claimers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(idle, first): drivers that claim nothing, whatever comes of the others, and for each resource the first of the rest.

    claimers: drivers that tentatively claim something. The others are idle for good if before them, on any of their
    resources, come only drivers that are so too; they shrink by those that come after another until none does, each pass
    being one join.
    """
    idle = materialize(edges.join(claimers, "driver", "left_anti").select("driver").distinct())
    while True:
        first = materialize(edges.join(idle, "driver", "left_anti").groupBy("resource").agg(F.min("ord").alias("first")))
        after = edges.join(first, "resource").where("ord > first").select("driver").distinct()
        kept = materialize(idle.join(after, "driver", "left_anti"))
        same = kept.count() == idle.count()
        drop(idle)
        idle = kept
        if same:
            return idle, first
        drop(first)


def _settled(edges: DataFrame, claimers: DataFrame) -> DataFrame:
    """Drivers whose tentative decision is final: the idle ones, and claimers that come after none but idle ones."""
    idle, first = idle_before(edges, claimers)
    after = edges.join(first, "resource").where("ord > first").select("driver").distinct()
    return idle.unionByName(claimers.join(after, "driver", "left_anti"))


def conflicts(edges: DataFrame) -> DataFrame:
    """(driver, component) of the drivers that share a resource with another: the smallest driver that they reach by shared ones."""
    first = edges.groupBy("resource").agg(F.min("driver").alias("first"))
    links = edges.join(first, "resource").where("driver <> first").select("driver", "first").distinct()
    return connected_components(contracted(links)).withColumnRenamed("node", "driver")


def replayed(edges: DataFrame, rule: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """Claims of each component's drivers, taken one by one in order: rule(edges of a driver to open resources) gives the rows
    that it claims. edges: with component. A component is one task's at a time, so its size must be bounded."""
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        of, taken, out = defaultdict(list), set(), []
        for row in table.to_pylist():
            of[row["ord"], row["driver"]].append(row)
        for key in sorted(of):
            claims = rule([r for r in of[key] if r["resource"] not in taken])
            taken.update(c["resource"] for c in claims)
            out += claims
        return pa.Table.from_pylist(out, arrow)

    return edges.groupBy("component").applyInArrow(run, schema)


def resolve(
    edges: DataFrame, decide: Callable[[DataFrame], DataFrame], greedy: bool = False, alive: Callable[[DataFrame], DataFrame] | None = None,
    rule: Callable[[list[dict]], list[dict]] | None = None, most: int = REPLAYED,
) -> DataFrame:
    """Claims as if drivers were taken one by one in order, decided many at a time.

    edges: driver, ord, resource and whatever decide() reads; every resource that can sway a driver
    must have an edge. decide(edges of some drivers, open resources only) gives rows with columns
    driver and resource: what each of them claims, as in the sequential rule; a null resource claims nothing.

    A driver is ready when it is the first undecided one on all its resources, so ready drivers share
    none and no earlier driver can take anything from them; they are decided at once, and drop out
    with what they claimed. Where that settles few, all are decided tentatively: a driver before which only
    drivers come that claim nothing is final too, so contests without claims take one round.
    greedy: what a driver claims are the best of its open resources whatever the others are, so it needs to be first
    on those alone, and one that claims nothing never will.
    alive(edges left) drops edges of drivers that can claim nothing any more.
    rule: decide() for the edges of one driver, as rows. With it, what the first round leaves is dealt out by connected
    components of drivers that share resources; those of `most` edges at most are replayed in order, each in one task, however
    long their chains are. Only larger components go on by rounds, which follow the longest chain of drivers that wait for each
    other's claims.
    """
    keep = alive or (lambda df: df)
    left, out, slow = materialize(keep(edges)), None, greedy
    drivers = left.select("driver").distinct().count()
    while drivers:
        if slow:
            told = materialize(decide(left))
            named = told.where("resource is not null").select("driver", "resource")
            if greedy:
                first = left.groupBy("resource").agg(F.min("ord").alias("first"))
                own = left.join(named, ["driver", "resource"], "left_semi").join(first, "resource")
                beaten = own.where("ord > first").select("driver").distinct()
                final = named.select("driver").distinct().join(beaten, "driver", "left_anti")
                waiting = materialize(beaten)
            else:
                final, waiting = _settled(left, named.select("driver").distinct()), None
            final = materialize(final)
            claims = materialize(told.join(final, "driver", "left_semi"))
            drop(told)
        else:
            final, waiting = materialize(_early(left, left.select("driver").distinct())), None
            claims = materialize(decide(left.join(final, "driver", "left_semi")))
        out = claims if out is None else out.unionByName(claims)
        rest = left.join(waiting, "driver", "left_semi") if waiting is not None else left.join(final, "driver", "left_anti")
        taken = claims.where("resource is not null").select("resource").distinct()
        after = materialize(keep(rest.join(taken, "resource", "left_anti")))
        drop(left)
        drop(final)
        left, before = after, drivers
        drivers = left.select("driver").distinct().count()
        if rule and drivers:
            claims, left = _replay_small(left, rule, claims.schema, most)
            out, rule = out.unionByName(claims), None
            drivers = left.select("driver").distinct().count()
        slow = greedy or drivers > 0.5 * before
    return out if out is not None else decide(left)


def _replay_small(left: DataFrame, rule: Callable[[list[dict]], list[dict]], schema: StructType, most: int) -> tuple[DataFrame, DataFrame]:
    """(claims, edges left): the components of `most` edges at most replayed, and the edges of the others."""
    own = F.coalesce("component", "driver").alias("component")  # a driver that shares nothing is a component
    rows = left.join(conflicts(left), "driver", "left").select(*(left[c] for c in left.columns), own)
    rows = materialize(rows, "components")
    large = materialize(rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component"), "large")
    claims = materialize(replayed(rows.join(large, "component", "left_anti"), rule, schema), "replayed")
    return claims, materialize(rows.join(large, "component", "left_semi").drop("component"), "left")


def numbered(df: DataFrame, *order: str, column: str = "position") -> DataFrame:
    """df with 1, 2, 3, ... in the given total order, without gathering the rows in one task.

    Rows are ranged over partitions by the order; each numbers its own, and adds how many rows the
    partitions before it hold.
    """
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = before.select("_p", F.expr("sum(_n) over (order by _p rows unbounded preceding) - _n").alias("_before"))
    within = F.expr(f"row_number() over (partition by _p order by {', '.join(order)})")
    out = ranged.withColumn("_i", within).join(F.broadcast(before), "_p").withColumn(column, F.col("_before") + F.col("_i"))
    return out.drop("_p", "_i", "_before")
