"""Queries against their SQL where tables are larger, or more alike, than the given ones."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tallyloom.operators import blocking
from tallyloom.plans import catalogue


@pytest.fixture
def changed(tmp_path):
    """A copy of the small tables in which one is made by a select."""

    def make(table, select):
        con = oracle.connect(SMALL)
        for name in os.listdir(SMALL):
            if name != f"{table}.parquet":
                (tmp_path / name).symlink_to(f"{SMALL}/{name}")
        con.execute(f"copy ({select}) to '{tmp_path}/{table}.parquet' (format parquet)")
        return str(tmp_path)

    return make


def test_positional_ids_of_a_million_events(spark, changed):
    """From a million rows on the SQL shortens the number to six digits."""
    d = changed("events", "select range as event_id, timestamp '2020-01-01' + to_seconds(range) as ts from range(1000003)")
    got = catalogue.queries()["positional_ids"](spark, d).where("event_id >= 999990")
    assert oracle.compare(got, oracle.connect(d), f"select * from ({catalogue.oracle_sql()['positional_ids']}) where event_id >= 999990") is None


@pytest.mark.parametrize("prefix", ["LED", "GTW", "BNK"])
def test_six_digits_of_the_sql(spark, prefix):
    ids = spark.createDataFrame([(f"{prefix}-{n:06d}",) for n in (7, 999_999, 1_000_000, 12_345_678)], "record_id string").select(catalogue._six_digits(prefix))
    assert [r.record_id[4:] for r in ids.collect()] == ["000007", "999999", "100000", "123456"]


def test_batch_match_where_credits_compete(spark, changed):
    """A single payment is repriced and moved so that its credit fits a batch that another credit names."""
    con = oracle.connect(SMALL)
    total, day = con.execute(catalogue.oracle("select total_paise, settled_on from batches where n >= 5 order by settlement_id limit 1", catalogue._BATCHES)).fetchone()
    k = con.execute("select min(o_orderkey) from orders where o_orderkey % 100 = 30 and o_orderkey >= 300").fetchone()[0]
    price = total / (1 - 0.002 * 1.18) / 100
    moved = f"(select * from orders where o_orderkey <> {k}) union all select * replace (round({price}, 2) as o_totalprice, timestamp '{day}' - interval 3 day as o_orderdate, '4-NOT SPECIFIED' as o_orderpriority) from orders where o_orderkey = {k}"
    d = changed("orders", moved)
    con, sql = oracle.connect(d), catalogue.oracle_sql()["batch_match"]
    assert con.execute(f"select max(n) from (select count(*) as n from ({sql}) where gateway_ids <> '' group by gateway_ids)").fetchone()[0] == 2
    assert oracle.compare(catalogue.queries()["batch_match"](spark, d), con, sql) is None


def test_numbers_of_the_same_digits_meet_by_swaps_alone(spark):
    """Numbers whose digits are those of many others meet the ones with two of them swapped, and no more."""
    n = 20_000
    refs = spark.range(n).select(F.col("id"), F.format_string("INV2025%06d", "id").alias("x"))
    got = blocking.reference_join(refs.toDF("key_id", "full"), refs.toDF("want_id", "target"), swapped=True).where("key_id <> want_id").cache()
    swapped = got.where(F.col("full") == "INV2025012345").select("want_id").collect()
    assert {r.want_id for r in swapped} == {k for k in range(n) if sorted(f"{k:06d}") == sorted("012345") and sum(a != b for a, b in zip(f"{k:06d}", "012345", strict=True)) == 2}
    assert got.count() <= 10 * n
