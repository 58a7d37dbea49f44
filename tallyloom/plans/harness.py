"""Ledger, gateway and bank views over the order tables, in one SQL text for Spark and DuckDB.

With k an order's key, k mod 100 decides what happened to it (SCENARIOS), and k div 100 names the
settlement batch of those that are settled together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..scratch import compiled

#: (first, last residue, name)
SCENARIOS = (
    (0, 61, "clean"), (62, 69, "timing_lag"), (70, 76, "merged"), (77, 80, "split"), (81, 84, "fee_variance"), (85, 88, "refund_offset"),
    (89, 92, "narration_noise"), (93, 94, "missing_in_bank"), (95, 96, "missing_in_gateway"), (97, 97, "duplicate_gateway"), (98, 98, "duplicate_bank"), (99, 99, "chargeback"),
)
TRUTH = {
    "clean": None, "timing_lag": "TIMING_LAG", "merged": "MERGED_PAYMENT", "split": "SPLIT_PAYMENT", "fee_variance": "FEE_DISCREPANCY", "refund_offset": "REFUND_OFFSET",
    "narration_noise": "NARRATION_UNPARSEABLE", "missing_in_bank": "MISSING_IN_BANK", "missing_in_gateway": "MISSING_IN_GATEWAY", "duplicate_gateway": "DUPLICATE_RECORD", "duplicate_bank": "DUPLICATE_RECORD", "chargeback": "CHARGEBACK_DEBIT",
}


class Dialect:
    """The few spellings in which the two engines differ."""

    def __init__(self, duck: bool):
        self.duck = duck

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if self.duck else f"(({a}) div ({b}))"

    def days(self, day: str, n: str) -> str:
        return f"({day} + cast({n} as integer))" if self.duck else f"date_add({day}, cast({n} as int))"

    def pad(self, x: str, n: int = 6) -> str:
        return f"lpad(cast({x} as varchar), cast(greatest({n}, length(cast({x} as varchar))) as integer), '0')" if self.duck else f"format_string('%0{n}d', {x})"

    @property
    def text(self) -> str:
        return "varchar" if self.duck else "string"

    @property
    def parts(self) -> str:
        return "(values (0), (1)) p(part)"


def views(duck: bool) -> str:
    """Common table expressions ledger, gateway, bank over customer and orders."""
    d = Dialect(duck)
    name = "case " + " ".join(f"when s between {a} and {b} then '{n}'" for a, b, n in SCENARIOS) + " end"
    method = "case substr(o_orderpriority, 1, 1) when '1' then 'card' when '2' then 'netbanking' when '3' then 'wallet' when '4' then 'upi' else 'emi' end"
    bps = "case method when 'card' then 200 when 'netbanking' then 180 when 'wallet' then 220 when 'upi' then 20 else 250 end + case when scenario = 'fee_variance' then 150 else 0 end"
    batch = "scenario in ('merged', 'refund_offset')"
    fee, tax = d.div("amount_paise * bps + 5000", "10000"), d.div("fee_paise * 1800 + 5000", "10000")
    short = "upper(substr(settlement_id, 6, 8))"
    note = f"""case when scenario = 'narration_noise' then 'NEFT CR' when k % 6 = 0 then 'NEFT/' || settlement_id || '/CR' when k % 6 = 1 then 'IMPS ' || {short}
      when k % 6 = 2 then 'RTGS ' || invoice_no || ' IN' when k % 6 = 3 then 'ACH CR ' || {short} || ' PAYOUT' when k % 6 = 4 then 'UPI ' || order_id else invoice_no || ' CREDIT' end"""
    lag = "case when scenario = 'timing_lag' then 1 + k % 5 else 0 end"
    return f"""
o as (select o_orderkey as k, {d.div("o_orderkey", "100")} as h, o_orderkey % 100 as s, cast(o_orderdate as date) as issue_date, o_orderpriority,
  cast(round(o_totalprice * 100) as bigint) as gross_paise, c_name as customer_name, o_custkey,
  'INV-' || cast(year(o_orderdate) as {d.text}) || '-' || {d.pad("o_orderkey")} as invoice_no
  from orders left join customer on o_custkey = c_custkey),
named as (select *, {name} as scenario from o),
ledger as (select 'LED-' || {d.pad("k")} as record_id, k, scenario, invoice_no, 'CUST-' || {d.pad("o_custkey")} as customer_id, coalesce(customer_name, '') as customer_name, issue_date,
  gross_paise, {d.div("gross_paise * 36 + 118", "236")} as tax_paise, 'INR' as currency, 'issued' as status from named),
paid as (select named.*, {method} as method, part, case when scenario <> 'split' then gross_paise when part = 0 then {d.div("gross_paise", "3")} else gross_paise - {d.div("gross_paise", "3")} end as amount_paise,
  {d.days("issue_date", "k % 3")} as captured from named cross join {d.parts}
  where scenario <> 'missing_in_gateway' and (part = 0 or scenario in ('split', 'duplicate_gateway'))),
priced as (select *, {bps} as bps, case when s = 85 then {d.div("amount_paise", "4")} else 0 end as refund_paise,
  case when scenario = 'duplicate_gateway' then 0 else part end as piece from paid),
charged as (select *, {fee} as fee_paise from priced),
netted as (select *, {tax} as tax_on_fee_paise, amount_paise - fee_paise - {tax} - refund_paise as net_paise,
  case when {batch} then {d.days("max(captured) over (partition by h, scenario)", "1")} else {d.days("captured", "1 + k % 2")} end as settled,
  'setl_' || substr(md5(case when {batch} then 'batch ' || cast(h as {d.text}) || ' ' || scenario else 'single ' || cast(k as {d.text}) || ' ' || cast(piece as {d.text}) end), 1, 14) as settlement_id,
  'pay_' || substr(md5('pay ' || cast(k as {d.text}) || ' ' || cast(piece as {d.text})), 1, 14) as payment_id, 'order_' || substr(md5('order ' || cast(k as {d.text})), 1, 14) as order_id from charged),
gateway as (select 'GTW-' || {d.pad("k * 10 + part", 8)} as record_id, k, h, part, scenario, payment_id, order_id, invoice_no as receipt, captured, amount_paise, fee_paise, tax_on_fee_paise,
  net_paise, method, 'captured' as status, refund_paise, settlement_id, settled, invoice_no from netted),
credits as (select k, 0 as tie, part, scenario, {d.days("settled", lag)} as value_date, 'credit' as direction, net_paise as amount_paise, {note} as narration from gateway
    where not ({batch}) and scenario not in ('missing_in_bank', 'duplicate_gateway')
  union all select k, 0, 0, scenario, settled, 'credit', net_paise, {note} from gateway where scenario = 'duplicate_gateway' and part = 0
  union all select min(k), 1, 0, scenario, min(settled), 'credit', sum(net_paise), 'NEFT/' || settlement_id || '/BATCH' from gateway where {batch} group by h, scenario, settlement_id
  union all select k, 2, 0, scenario, {d.days("issue_date", "2")}, 'credit', gross_paise, 'DIRECT ' || invoice_no from named where scenario = 'missing_in_gateway'
  union all select k, 3, 0, scenario, settled, 'credit', net_paise, {note} from gateway where scenario = 'duplicate_bank'
  union all select k, 4, 0, scenario, {d.days("settled", "5")}, 'debit', net_paise, 'CHARGEBACK/' || invoice_no || '/REV' from gateway where scenario = 'chargeback'),
bank as (select 'BNK-' || {d.pad("k * 100 + tie * 10 + part", 9)} as record_id, k, tie, scenario, value_date, direction, cast(amount_paise as bigint) as amount_paise, narration from credits)"""


def truth(duck: bool) -> str:
    """Common table expressions that end in truth: one row a true group, with sorted arrays of its record ids."""
    what = "case " + " ".join(f"when scenario = '{n}' then '{x}'" for n, x in TRUTH.items() if x) + " end"
    gather = "list({0} order by {0}) filter ({0} is not null)" if duck else "array_sort(collect_list({0}))"
    ids = lambda source: gather.format(f"case when source = '{source}' then record_id end")
    grouped = "case when scenario in ('merged', 'refund_offset') then {0} * 1000 + case scenario when 'merged' then 970 else 985 end else k * 1000 end"
    h = Dialect(duck).div("k", "100")
    return f"""
members as (select record_id, 'ledger' as source, scenario, {grouped.format(h)} as truth_no, gross_paise as amount_paise from ledger
  union all select record_id, 'gateway', scenario, {grouped.format(h)}, amount_paise from gateway
  union all select record_id, 'bank', scenario, {grouped.format(h)}, amount_paise from bank),
truth as (select truth_no, scenario, {what} as exception_type, scenario <> 'narration_noise' as is_resolvable, {ids("ledger")} as ledger_ids, {ids("gateway")} as gateway_ids, {ids("bank")} as bank_ids,
  cast(sum(case when source = 'ledger' then amount_paise else 0 end) as bigint) as amount_paise from members group by truth_no, scenario)"""


TABLES = ("orders", "customer")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ledger, gateway, bank, truth as a DataFrame (no temporary views are left behind); its session runs compiled() from now on."""
    compiled(spark)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    also = f",{truth(False)}" if name == "truth" else ""
    sql = f"with {views(False)}{also} select * from {name}".replace("from orders left join customer", "from {orders} left join {customer}")
    return spark.sql(sql, **frames)


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, sf_dir, x) for x in ("ledger", "gateway", "bank"))


def oracle(select: str, *ctes: str) -> str:
    """DuckDB SQL over the views: more common table expressions, then the select."""
    of = views(True)
    for name in ("ledger", "gateway", "bank"):  # else each use of a view is computed anew
        of = of.replace(f"\n{name} as (", f"\n{name} as materialized (")
    more = [re.sub(r"^(tokens|keys|pairs|wants|ranked) as \(", r"\1 as materialized (", c) for c in ctes]
    return "with " + ",\n".join([of, *more]) + "\n" + select
