"""Joins on cells of amount and day, and what becomes of them where one price is everywhere."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_sequential import keys as plain_keys
from test_sequential import rank

from tallyloom.functions import refs
from tallyloom.operators import blocking, stages

DAY = dt.date(2025, 1, 1)
LEFT = "l string, net long, paid date, no string, setl string"
RIGHT = "b string, amount long, value date, narration string"


def sides(spark, lefts, rights):
    r = spark.createDataFrame(rights, RIGHT).withColumn("keys", refs.ref_keys(refs.extract_references(F.coalesce("narration", F.lit("")))))
    return spark.createDataFrame(lefts, LEFT), r


def mixed(seed, n=160):
    """Few amounts and days; references whole, inside longer words, by tail, swapped, of others, and none."""
    rng = random.Random(seed)
    lefts, rights = [], []
    for i in range(n):
        no = f"INV-2025-{rng.randrange(40):06d}" if rng.random() < 0.9 else rng.choice(["7A", "", None, "AB12", "AB123"])
        setl = rng.choice([None, f"setl_{rng.randrange(30):014d}"])
        lefts.append((f"L{i}", rng.choice([None, 100, 100, 100, 101, 5000]), rng.choice([None, *[DAY + dt.timedelta(rng.randrange(9))] * 9]), no, setl))
        k = rng.randrange(40)
        swapped = f"{k:06d}"[:4] + f"{k:06d}"[5] + f"{k:06d}"[4]
        text = rng.choice([f"INV-2025-{k:06d}", f"RTGS INV2025{k:06d} IN", f"order_AB12{k:06d}xx", f"INV-2025-{swapped}", f"setl_{k:014d} CR", f"INV-1999-{k:06d}", "NEFT CR", None, f"INV-2025-{k:06d} setl_{k:014d}"])
        rights.append((f"B{i}", rng.choice([None, 100, 100, 101, 102, 4999]), rng.choice([None, *[DAY + dt.timedelta(rng.randrange(9))] * 9]), text))
    return lefts, rights


@pytest.mark.parametrize(("tolerance", "within", "kinds", "crowd"), [(0, 3, 2, 0), (0, 3, 4, 0), (1, None, 4, 0), (2, 2, 2, 1), (1, 4, 4, 10**9), (0, None, 3, 0)])
def test_named_join_loses_no_pair(spark, tolerance, within, kinds, crowd):
    """Whether cells are joined as they are or all by reference, pairs are those of the nested loop."""
    lefts, rights = mixed(tolerance * 7 + kinds)
    l, r = sides(spark, lefts, rights)
    days = None if within is None else ("paid", "value")
    got = blocking.named_join(l, r, (["l"], ["b"]), ("net", "amount"), tolerance, ["no", "setl"], "keys", kinds, days, within or 0, crowd)
    want = set()
    for a in lefts:
        for b in rights:
            if a[1] is None or b[1] is None or abs(a[1] - b[1]) > tolerance or within is not None and (a[2] is None or b[2] is None or abs((a[2] - b[2]).days) > within):
                continue
            k = rank(plain_keys(b[3] or ""), [a[3], a[4]])
            if k <= kinds:
                want.add((a[0], b[0], k))
    assert sorted(map(tuple, got.select("l", "b", "kind").collect())) == sorted(want) and len(want) > 20
    assert set(got.columns) == {*l.columns, *r.columns, "kind"}


def test_grid_join(spark):
    lefts, rights = mixed(5)
    l, r = sides(spark, lefts, rights)
    got = blocking.grid_join(l, r, ("net", "amount"), 1, ("paid", "value"), 2).select("l", "b").collect()
    want = [(a[0], b[0]) for a in lefts for b in rights if None not in (a[1], b[1], a[2], b[2]) and abs(a[1] - b[1]) <= 1 and abs((a[2] - b[2]).days) <= 2]
    assert sorted(map(tuple, got)) == sorted(want)


def one_price(spark, n, days=30):
    """n payments and credits of one price in a month, each credit naming its own payment."""
    i = F.col("id")
    day = F.date_add(F.lit(DAY), (i % days).cast("int"))
    no, setl = F.format_string("INV-2025-%06d", i), F.concat(F.lit("setl_"), F.substring(F.md5(i.cast("string")), 1, 14))
    ids = spark.range(n)
    l = ids.select(F.format_string("L%06d", i).alias("l"), F.lit(99_900).cast("bigint").alias("net"), day.alias("paid"), no.alias("no"), setl.alias("setl"))
    text = F.when(i % 2 == 0, F.concat(F.lit("NEFT/"), setl, F.lit("/CR"))).otherwise(F.concat(F.lit("RTGS "), no, F.lit(" IN")))
    r = ids.select(F.format_string("B%06d", i).alias("b"), F.lit(99_900).cast("bigint").alias("amount"), F.date_add(day, 1).alias("value"), text.alias("narration"))
    return l, r.withColumn("keys", refs.ref_keys(refs.extract_references(F.col("narration"))))


def test_fifty_thousand_of_one_price_meet_in_proportion(spark):
    for n in (12_500, 50_000):
        l, r = one_price(spark, n)
        a, b, _ = blocking._cells(l, r, ("net", "amount"), 0, ("paid", "value"), 3)
        busy = a.select("_a", "_d").distinct()
        met = {k: blocking.crowded_pairs(a, b, busy, (["l"], ["b"]), ["no", "setl"], "keys", k).count() / n for k in (2, 4)}
        assert met[2] <= 1.5 and met[4] <= 4, met
        got = blocking.named_join(l, r, (["l"], ["b"]), ("net", "amount"), 0, ["no", "setl"], "keys", 2, ("paid", "value"), 3)
        assert got.where("substr(l, 2) = substr(b, 2)").count() == n and got.count() <= 1.01 * n


def test_exact_pass_on_one_price(spark):
    n = 4_000
    l, r = one_price(spark, n)
    ledger = l.select(F.col("l").alias("record_id"), F.col("no").alias("invoice_no"), F.lit(100_000).cast("bigint").alias("gross_paise"), F.col("paid").alias("issue_date"), F.lit("A").alias("customer_name"))
    gateway = l.select(
        F.concat(F.lit("G"), "l").alias("record_id"), F.concat(F.lit("order_"), F.substring(F.md5("l"), 1, 14)).alias("order_id"), F.col("no").alias("receipt"), F.col("paid").alias("captured"), F.col("paid").alias("settled"),
        F.lit(100_000).cast("bigint").alias("amount_paise"), F.lit(100).cast("bigint").alias("fee_paise"), F.col("net").alias("net_paise"), F.lit("card").alias("method"), F.lit("captured").alias("status"),
        F.lit(0).cast("bigint").alias("refund_paise"), F.col("setl").alias("settlement_id"),
    )
    bank = r.select(F.col("b").alias("record_id"), F.col("value").alias("value_date"), F.lit("credit").alias("direction"), F.col("amount").alias("amount_paise"), "narration")
    pools = stages.prepared(ledger, gateway, bank)
    for matched in (stages.exact(*pools, stages.Conf()), stages.tolerant(*pools, stages.Conf())):
        assert matched.where("substr(driver, 2) = substr(bank_ids[0], 2)").count() == matched.count() == n


@pytest.mark.parametrize("shared", ["stem", "ending", "both"])
def test_anchors_of_texts_with_a_shared_part(spark, shared):
    """20,000 references alike but for a number meet in proportion to what is found."""
    n = 20_000
    before, after = ("INVOICE2025" if shared != "ending" else ""), ("SETTLEMENT" if shared != "stem" else "")
    number = F.lpad(F.conv((F.col("id") * 7919 + 10**7).cast("string"), 10, 36), 8, "Q")
    ids = spark.range(n).select(F.concat(F.lit(before), number, F.lit(after)).alias("needle"))
    hays = ids.select(F.concat(F.lit("NEFT"), "needle", F.lit("CR")).alias("hay")).unionByName(spark.range(n).select(F.concat(F.lit(before), F.lit("0"), F.lpad(F.col("id").cast("string"), 8, "Z"), F.lit(after)).alias("hay")))
    met = blocking.anchored(blocking.grams(ids, "needle"), blocking.grams(hays, "hay"), "needle", "hay")
    found = blocking.inside(ids, hays, "needle", "hay")
    assert found.count() == n and met.count() <= 3 * n
    assert found.where(F.col("hay") == F.concat(F.lit("NEFT"), "needle", F.lit("CR"))).count() == n
