"""The passes against plain models that take records one by one, over rows that compete for each other."""

import datetime as dt
import random
import re
from itertools import combinations

import models
import pytest
from pyspark.sql import functions as F

from tallyloom.conf import Conf
from tallyloom.functions.refs import PATTERNS
from tallyloom.operators import candidates, pools, residual, stages

LEDGER = "record_id string, invoice_no string, customer_name string, issue_date date, gross_paise long"
GATEWAY = (
    "record_id string, payment_id string, order_id string, receipt string, captured date, settled date, amount_paise long, fee_paise long, net_paise long, "
    "method string, status string, refund_paise long, settlement_id string"
)
BANK = "record_id string, value_date date, direction string, amount_paise long, narration string"
DAY = dt.date(2026, 1, 5)
CONF = Conf()


def contested(seed, invoices=14):
    """Few numbers, amounts and days, so that receipts, credits, settlements and debits are wanted by several."""
    rng = random.Random(seed)
    day = lambda n=6: DAY + dt.timedelta(rng.randint(0, n))
    ledger, gateway, bank = [], [], []
    numbers = [f"INV-2026-{10000 + i * 37}" for i in range(invoices * 2 // 3)]
    for i in range(invoices):
        ledger.append((f"LED-{i:03}", rng.choice(numbers), "A", DAY, rng.choice([10000, 20000])))
    for i in range(invoices + 6):
        bill = rng.choice(ledger)
        amount, captured = rng.choice([bill[4], bill[4], 20000]), day(2)
        batch = rng.choice([*(f"setl_{j:014}" for j in range(invoices // 2)), f"setl_9{i:013}", f"setl_9{i:013}", None])
        receipt = rng.choice([bill[1], bill[1], bill[1], None])
        gateway.append((f"GTW-{i:03}", f"pay_{i:014}", f"order_{i:014}", receipt, captured, rng.choice([None, captured]), amount, 200, amount - 200, "card", "captured", 0, batch))
    for i in range(2 * invoices):
        g = rng.choice(gateway)
        said = rng.choice([g[12] or "", g[3] or "", "NEFT CR", f"{g[3] or ''} {g[12] or ''}"])
        total = sum(x[8] for x in gateway if x[12] and x[12] == g[12])
        paid = rng.choice([g[8], g[8], total or g[8], g[8] + 50])
        bank.append((f"BNK-{i:03}", g[4] + dt.timedelta(rng.randint(0, 3)), "debit" if rng.random() < 0.1 else "credit", paid, f"X {said} Y"))
    return ledger, gateway, bank


def norm(x):
    return re.sub("[^A-Z0-9]", "", x.upper())


def keys(narration):
    found = []
    for p in PATTERNS:
        found += [m[0] for m in re.finditer(p, narration) if m[0] not in found]
    return [norm(t) for t in found]


def rank(own, expected):
    best = 5
    for want in filter(lambda w: len(w) >= 4, (norm(e) for e in expected if e)):
        for k in own:
            swap = len(k) == len(want) >= 6 and sorted(k) == sorted(want) and sum(a != b for a, b in zip(k, want, strict=True)) == 2
            kind = 1 if k == want else 2 if len(k) >= 6 and (k in want or want in k) else 3 if len(k) >= 6 and k[-6:] == want[-6:] else 4 if swap else 5
            best = min(best, kind)
    return best


class Plain:
    """All records open, taken in file order."""

    def __init__(self, ledger, gateway, bank):
        named = lambda rows, schema: [dict(zip((c.split()[0] for c in schema.split(", ")), r, strict=True)) for r in rows]
        self.l, self.g, self.b = named(ledger, LEDGER), named(gateway, GATEWAY), named(bank, BANK)
        for b in self.b:
            b["keys"] = keys(b["narration"])
        for g in self.g:
            g["on"] = g["settled"] or g["captured"]
        self.open = {x["record_id"] for x in [*self.l, *self.g, *self.b]}

    def free(self, rows):
        return [x for x in rows if x["record_id"] in self.open]

    def take(self, *groups):
        ids = [i for group in groups for i in group]
        self.open -= set(ids)
        return tuple(tuple(sorted(g)) for g in groups)

    def exact(self):
        out = []
        for l in self.l:
            gs = [g for g in self.free(self.g) if norm(g["receipt"] or "") == norm(l["invoice_no"])]
            if len(gs) != 1 or l["record_id"] not in self.open:
                continue
            g, want = gs[0], [gs[0]["settlement_id"], gs[0]["order_id"], l["invoice_no"]]
            if g["amount_paise"] != l["gross_paise"] or g["refund_paise"] or g["status"] != "captured" or not g["settlement_id"]:
                continue
            fits = [b for b in self.free(self.b) if b["direction"] == "credit" and b["amount_paise"] == g["net_paise"] and l["issue_date"] <= g["captured"] <= g["on"] <= b["value_date"] and (b["value_date"] - g["on"]).days <= 3 and rank(b["keys"], want) <= 2]
            if len(fits) == 1 and not any(d["direction"] == "debit" and d["amount_paise"] == fits[0]["amount_paise"] and rank(d["keys"], want) <= 4 for d in self.free(self.b)):
                out.append(self.take([l["record_id"]], [g["record_id"]], [fits[0]["record_id"]]))
        return out

    def batches(self):
        out = []
        of = {}
        for g in self.free(self.g):
            if g["settlement_id"]:
                of.setdefault(g["settlement_id"], []).append(g)
        of = {s: gs for s, gs in of.items() if len(gs) > 1}
        for b in self.b:
            if b["direction"] != "credit" or b["record_id"] not in self.open:
                continue
            fits = [(s, gs) for s, gs in of.items() if all(g["record_id"] in self.open for g in gs) and abs(sum(g["net_paise"] for g in gs) - b["amount_paise"]) <= 100 and abs((gs[0]["on"] - b["value_date"]).days) <= 5]
            hinted = [x for x in fits if rank(b["keys"], [x[0]]) <= 4]
            chosen = hinted if len(hinted) == 1 else fits
            if len(chosen) > 1:
                out.append(self.take([], [], [b["record_id"]]))
            elif len(chosen) == 1 and len(chosen[0][1]) <= CONF.batch_limit:
                gs, bills = chosen[0][1], []
                for g in gs:
                    bill = next((l["record_id"] for l in self.free(self.l) if l["invoice_no"] == g["receipt"]), None)
                    bills += [bill] if bill else []
                out.append(self.take(bills, [g["record_id"] for g in gs], [b["record_id"]]))
        return out

    def splits(self):
        out = []
        for l in self.l:
            gs = [g for g in self.free(self.g) if g["receipt"] == l["invoice_no"]]
            if len(gs) < 2 or l["record_id"] not in self.open:
                continue
            near = [b for b in self.free(self.b) if b["direction"] == "credit" and any(abs((g["on"] - b["value_date"]).days) <= 6 for g in gs)]
            took = []
            for g in gs:
                hit = next((b["record_id"] for b in near if b["record_id"] not in took and b["amount_paise"] == g["net_paise"] and rank(b["keys"], [l["invoice_no"], g["settlement_id"], g["order_id"]]) <= 4), None)
                took += [hit] if hit else []
            if len(took) < len(gs):
                sets = models.find_subsets([(b["record_id"], b["amount_paise"]) for b in near], sum(g["net_paise"] for g in gs), 100 * len(gs), max(len(gs), 3))
                took = sets[0][0] if sets else []
            if took:
                out.append(self.take([l["record_id"]], [g["record_id"] for g in gs], took))
        return out

    def two_way(self):
        out = []
        for l in self.free(self.l):
            gs = [g for g in self.free(self.g) if norm(g["receipt"] or "") == norm(l["invoice_no"])]
            if len(gs) == 1:
                out.append(self.take([l["record_id"]], [gs[0]["record_id"]], []))
        return out


def frames(spark, rows):
    return stages.prepared(*(spark.createDataFrame(r, s) for r, s in zip(rows, (LEDGER, GATEWAY, BANK), strict=True)))


def shown(df):
    return sorted(tuple(tuple(sorted(r[c])) for c in ("ledger_ids", "gateway_ids", "bank_ids")) for r in df.collect())


@pytest.mark.parametrize("name", ["exact", "batches", "splits", "two_way"])
def test_pass_is_the_sequential_rule(spark, name):
    taken = 0
    for seed in range(2):
        rows = contested(seed, invoices=18)
        want = sorted(getattr(Plain(*rows), name)())
        l, g, b = frames(spark, rows)
        got = residual.two_way(l, g, b, l, CONF, 1.0) if name == "two_way" else getattr(stages, name)(l, g, b, CONF)
        assert shown(got) == want
        taken += len(want)
    assert taken


def test_tolerant_takes_the_best_open_credit_in_turn(spark):
    for seed in range(1):
        rows = contested(seed + 10, invoices=40)
        l, g, b = frames(spark, rows)
        scored = sorted((r.l_record_id, r.g_record_id, -r.milli, r.credit_paise, r.b_record_id) for r in stages.tolerant_scored(l, g, b, CONF).where("milli >= 900").collect())
        gone, want = set(), []
        for driver in sorted({r[0] for r in scored}):
            free = [r for r in scored if r[0] == driver and not {r[1], r[4]} & gone]
            if free:
                best = min(free, key=lambda r: r[2:])
                gone |= {best[1], best[4]}
                want.append(((driver,), (best[1],), (best[4],)))
        assert shown(stages.tolerant(l, g, b, CONF)) == sorted(want) and want


def test_an_invoice_is_in_one_batch(spark):
    """INV-2026-00001 is paid in two settlements: the first credit takes it, the second goes without."""
    ledger = [(f"LED-{i}", f"INV-2026-0000{i}", "A", DAY, 100) for i in (1, 2, 3)]
    pay = lambda i, receipt, s: (f"GTW-{i}", f"pay_{i}", None, receipt, DAY, DAY, 100, 0, 100, "upi", "captured", 0, s)
    gateway = [pay(1, "INV-2026-00001", "setl_a"), pay(2, "INV-2026-00002", "setl_a"), pay(3, "INV-2026-00001", "setl_b"), pay(4, "INV-2026-00003", "setl_b")]
    bank = [("BNK-1", DAY, "credit", 200, "setl_aaaaaaaaaaaa"), ("BNK-2", DAY + dt.timedelta(5), "credit", 200, "x")]
    gateway = [(*g[:8], g[8] + (5000 if g[12] == "setl_b" else 0), *g[9:]) for g in gateway]
    bank[1] = ("BNK-2", DAY, "credit", 10200, "x")
    got = {r.driver: sorted(r.ledger_ids) for r in stages.batches(*frames(spark, (ledger, gateway, bank)), CONF).collect()}
    assert got == {"BNK-1": ["LED-1", "LED-2"], "BNK-2": ["LED-3"]}


def test_an_open_choice_lists_its_batches(spark):
    pay = lambda i, s: (f"GTW-{i}", f"pay_{i}", None, None, DAY, DAY, 100, 0, 100, "upi", "captured", 0, s)
    rows = ([], [pay(1, "setl_a"), pay(2, "setl_a"), pay(3, "setl_b"), pay(4, "setl_b")], [("BNK-1", DAY, "credit", 200, "x")])
    r = stages.batches(*frames(spark, rows), CONF).first()
    assert [c.gateway_ids for c in r.candidates] == [["GTW-1", "GTW-2"], ["GTW-3", "GTW-4"]] and r.forced and r.exception_type == "MERGED_PAYMENT"


def test_a_reversal_goes_by_the_debits_tokens_then_by_pass(spark):
    """The debit names the invoice first, then a settlement: the group of the invoice gets it, though its id sorts later."""
    schema = "driver string, ord string, rank int, ledger_ids array<string>, gateway_ids array<string>, bank_ids array<string>"
    groups = spark.createDataFrame([("LED-1", "LED-1", 0, ["LED-1"], [], ["BNK-1"]), ("BNK-2", "BNK-2", 2, [], ["GTW-2"], ["BNK-2"])], schema)
    ledger = [("LED-1", "INV-2026-00001", "A", DAY, 100)]
    gateway = [("GTW-2", "pay_x", None, None, DAY, DAY, 100, 0, 100, "upi", "captured", 0, "setl_bbbbbbbbbbbb")]
    bank = [("BNK-1", DAY, "credit", 100, "x"), ("BNK-2", DAY, "credit", 100, "x"), ("BNK-3", DAY, "debit", 100, "INV-2026-00001 setl_bbbbbbbbbbbb"), ("BNK-4", DAY, "debit", 100, "setl_bbbbbbbbbbbb")]
    l, g, b = frames(spark, (ledger, gateway, bank))
    got = {r.record_id: r.driver for r in residual.reversals(groups, l, g, b, b.where("direction = 'debit'")).collect()}
    assert got == {"BNK-3": "LED-1", "BNK-4": "BNK-2"}


def test_contests_without_claims_take_few_rounds(spark, monkeypatch):
    """Thousands of drivers on two resources that none may take, and one at the end that may."""
    edges = spark.range(5000).select(F.col("id").alias("driver"), F.col("id").alias("ord"), F.explode(F.array(F.lit(1), F.lit(2))).alias("resource"))
    edges = edges.where("driver < 4999 or resource = 2")
    rounds = []

    def decide(ready):
        rounds.append(1)
        alone = ready.groupBy("driver").agg(F.count(F.lit(1)).alias("n"), F.min("resource").alias("resource")).where("n = 1")
        return alone.select("driver", "resource")

    got = pools.resolve(edges, decide).collect()
    assert [(r.driver, r.resource) for r in got] == [(4999, 2)] and len(rounds) < 20


def test_resolver_with_choices_that_depend_on_all_open_resources(spark):
    """A driver claims only if exactly one of its resources is left."""
    rng = random.Random(5)
    for _ in range(3):
        edges = sorted({(d, rng.randint(0, 30)) for d in range(40) for _ in range(rng.randint(1, 3))})
        gone, want = set(), {}
        for d in range(40):
            open_ = [r for x, r in edges if x == d and r not in gone]
            if len(open_) == 1:
                want[d] = open_[0]
                gone.add(open_[0])
        df = spark.createDataFrame([(d, d, r) for d, r in edges], "driver int, ord int, resource int")
        alone = lambda ready: ready.groupBy("driver").agg(F.count(F.lit(1)).alias("n"), F.min("resource").alias("resource")).where("n = 1")
        assert {r.driver: r.resource for r in pools.resolve(df, alone).collect()} == want


def test_candidates_are_the_first_of_the_window(spark):
    """The lists by day against every pair of a credit and a record in its window."""
    ledger, gateway, bank = contested(3, invoices=90)
    l, g, b = frames(spark, (ledger, gateway, bank))
    got = {(r.b, r.g, r.l) for r in candidates.pool(l, g, b, CONF).collect()}
    want = set()
    first = {}
    for x in ledger:
        first.setdefault(x[1], x[0])
    for c in bank:
        if c[2] == "credit":
            near = [x for x in gateway if abs(((x[5] or x[4]) - c[1]).days) <= 9][:60]
            want |= {(c[0], x[0], first.get(x[3])) for x in near} | {(c[0], None, x[0]) for x in [x for x in ledger if abs((x[3] - c[1]).days) <= 45][:40]}
    assert got == want
    best = candidates.ranked(candidates.pool(l, g, b, CONF), CONF).collect()
    assert sorted(map(str, best)) == sorted(map(str, candidates.ranked(candidates.pool(l, g, b, CONF, CONF.max_candidates), CONF).collect()))
    assert all(x.milli >= y.milli for x, y in combinations(sorted(best, key=lambda r: (r.b, r.place)), 2) if x.b == y.b)
