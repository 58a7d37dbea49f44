"""The bank statement as one account: running balance and its continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def _ranged(lines: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """lines ranged over partitions by a total order, and one row for each partition with what it moves."""
    moved = F.when(F.col("direction") == "debit", -F.col("amount_paise")).otherwise(F.col("amount_paise"))
    ranged = materialize(lines.withColumn("_moved", moved).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    return ranged, ranged.groupBy("_p").agg(F.sum("_moved").alias("_sum"))


def running_balance(lines: DataFrame, opening_paise: int, *order: str) -> DataFrame:
    """lines (direction, amount_paise) with balance_paise after each, in a total order.

    Rows are ranged over partitions; each sums its own, and adds what the partitions before it moved.
    """
    ranged, sums = _ranged(lines, order)
    before = sums.select("_p", F.expr("sum(_sum) over (order by _p rows unbounded preceding) - _sum").alias("_before"))  # a row for each partition
    within = F.expr(f"sum(_moved) over (partition by _p order by {', '.join(order)} rows unbounded preceding)")
    out = ranged.withColumn("_within", within).join(F.broadcast(before), "_p")
    return out.withColumn("balance_paise", F.col("_before") + F.col("_within") + opening_paise).drop("_p", "_moved", "_within", "_before")


def breaks(lines: DataFrame, opening_paise: int, *order: str, stated: str = "stated_paise") -> DataFrame:
    """Lines whose stated balance is not the stated balance before them plus what they move, with expected_paise; lines
    without a stated balance say nothing, and the next is held against the last that has one."""
    run = running_balance(lines, opening_paise, *order).where(F.col(stated).isNotNull())
    # both balances move alike as long as nothing is lost, so only their difference is carried from line to line
    off = run.withColumn("_off", F.col(stated) - F.col("balance_paise"))
    ranged = materialize(off.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    last = ranged.groupBy("_p").agg(F.max_by("_off", F.struct(*order)).alias("_last"))
    last = last.select("_p", F.expr("lag(_last) over (order by _p)").alias("_last"))  # a row for each partition that has lines
    within = F.expr(f"lag(_off) over (partition by _p order by {', '.join(order)})")
    before = F.coalesce("_own", "_last", F.lit(0))
    out = ranged.withColumn("_own", within).join(F.broadcast(last), "_p").withColumn("expected_paise", F.col("balance_paise") + before)
    return out.where(F.col("_off") != before).drop("_p", "_off", "_own", "_last", "balance_paise")
