"""The matching passes: exact, tolerant, batch and split.

Each takes open pools (ledger, gateway, bank with normalized columns, see prepared()) and gives
groups: driver, ord, ledger_ids, gateway_ids, bank_ids, amount_paise, variance_paise, milli
(confidence in thousandths), exception_type, tier, forced (goes to review whatever its confidence),
rationale, evidence, and candidates where a choice is left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import Conf
from ..functions import canonical, money, refs
from ..scratch import drop
from .blocking import band_join, date_band_join, grid_join, named_join
from .pools import checkpointed, resolve, unique_within
from .sums import first_sums

EVIDENCE = "array<struct<label:string,detail:string,weight:double,record_ids:array<string>>>"
CANDIDATE = (
    "array<struct<candidate_id:string,ledger_ids:array<string>,gateway_ids:array<string>,bank_ids:array<string>,amount_paise:bigint,"
    "variance_paise:bigint,gap_days:int,milli:int,reference:double,customer:double,note:string,exception_type:string>>"
)
GROUP = (
    "driver string, ord string, ledger_ids array<string>, gateway_ids array<string>, bank_ids array<string>, amount_paise bigint, "
    f"variance_paise bigint, milli int, exception_type string, tier string, forced boolean, rationale string, evidence {EVIDENCE}, candidates {CANDIDATE}"
)


def prepared(ledger: DataFrame, gateway: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Comparison forms that all passes share: keys of receipts and invoices, reference keys of narrations."""
    return (
        ledger.withColumn("invoice_key", refs.normalize_ref(F.col("invoice_no"))),
        gateway.withColumn("receipt_key", refs.normalize_ref(F.coalesce("receipt", F.lit("")))).withColumn("paid_on", F.coalesce("settled", "captured")),
        bank.withColumn("tokens", refs.extract_references(F.coalesce("narration", F.lit("")))).withColumn("keys", refs.ref_keys(F.col("tokens"))),
    )


def group(
    driver: str, ledger: Column, gateway: Column, bank: Column, amount: Column, variance: Column, milli: Column, exception: Column, tier: str,
    forced: bool = False, rationale: Column | str = "", evidence: Column | None = None, candidates: Column | None = None,
) -> list[Column]:
    """The columns of GROUP."""
    why = F.lit(rationale) if isinstance(rationale, str) else rationale
    return [
        F.col(driver).alias("driver"), F.col(driver).alias("ord"), ledger.alias("ledger_ids"), gateway.alias("gateway_ids"),
        bank.alias("bank_ids"), amount.cast("bigint").alias("amount_paise"), variance.cast("bigint").alias("variance_paise"),
        milli.cast("int").alias("milli"), exception.cast("string").alias("exception_type"), F.lit(tier).alias("tier"),
        F.lit(forced).alias("forced"), canonical.clip(why).alias("rationale"),
        (F.array() if evidence is None else evidence).cast(EVIDENCE).alias("evidence"),
        (F.array() if candidates is None else candidates).cast(CANDIDATE).alias("candidates"),
    ]


def proof(label: Column | str, detail: Column, weight: Column | float, record_ids: Column) -> Column:
    """One piece of evidence."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(label).alias("label"), detail.alias("detail"), lit(weight).cast("double").alias("weight"), record_ids.alias("record_ids"))


def amount_proof(expected: Column, seen: Column, tolerance: int, record_ids: Column) -> Column:
    """How far an amount is from the expected one."""
    off = expected - seen
    within = F.abs(off) <= tolerance
    label = F.when(off == 0, "Amounts equal").when(within, "Amount within tolerance").otherwise("Amounts differ")
    detail = F.when(off == 0, F.concat(F.lit("Both sides are "), money.format_inr(seen), F.lit("."))).otherwise(
        F.concat(F.lit("Expected "), money.format_inr(expected), F.lit(", found "), money.format_inr(seen), F.lit(": "), money.format_variance(off), F.lit("."))
    )
    return proof(label, detail, F.when(off == 0, 1.0).when(within, 0.8).otherwise(0.2), record_ids)


def date_proof(gap: Column, window: int, record_ids: Column) -> Column:
    """How many days lie between payment and credit."""
    detail = F.concat(gap.cast("string"), F.when(gap == 1, " day").otherwise(" days"), F.lit(f" apart; the window is {window} days."))
    return proof(F.when(gap == 0, "Same day").otherwise("Days apart"), detail, F.when(gap <= window, 0.7).otherwise(0.2), record_ids)


def reference_proof(rank: Column, wanted: Column, record_ids: Column) -> Column:
    """How the bank line names what is expected, by the rank of refs.match_kind()."""
    told = ("in full", "inside a longer word", "by its last six characters", "with two characters swapped")
    how = F.lit("not at all")
    for i, text in enumerate(told, 1):
        how = F.when(rank == i, F.lit(text)).otherwise(how)
    weight = F.when(rank == 1, 1.0).when(rank == 2, 0.9).when(rank == 3, 0.6).when(rank == 4, 0.45).otherwise(0.05)
    label = F.when(rank <= 2, "Reference").when(rank <= 4, "Partial reference").otherwise("No reference")
    return proof(label, F.concat(F.lit("The bank line names "), wanted, F.lit(" "), how, F.lit(".")), weight, record_ids)


def fee_proof(fee: Column, amount: Column, method: Column, ok: Column, record_ids: Column) -> Column:
    """Whether the fee is what the method costs."""
    share = F.format_number(F.coalesce(money.fee_bps(fee, amount), F.lit(0)) / 100, 2)
    detail = F.concat(F.lit("The fee is "), share, F.lit("% for "), F.coalesce(method, F.lit("no method")), F.lit("."))
    return proof(F.when(ok, "Fee as expected").otherwise("Unusual fee"), detail, F.when(ok, 0.6).otherwise(0.15), record_ids)


def ids(*columns: str) -> Column:
    return F.array(*columns).cast("array<string>")


def no_ids() -> Column:
    return F.array().cast("array<string>")


EXPECTED = ("settlement_id", "order_id", "invoice_no")


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def exact_pairs(ledger: DataFrame, gateway: DataFrame, bank: DataFrame, conf: Conf) -> DataFrame:
    """Ledger, gateway and credit that agree in receipt, amount, net, reference and order of dates; `reversed`
    says that an open debit of the same amount names them too."""
    l, g, b = _named(ledger, "l"), _named(gateway, "g"), _named(bank, "b")
    good = (F.col("g_amount_paise") == F.col("l_gross_paise")) & (F.col("g_refund_paise") == 0) & (F.col("g_status") == "captured") & F.col("g_settlement_id").isNotNull()
    paid = checkpointed(l.join(g, F.col("l_invoice_key") == F.col("g_receipt_key")).where(good))
    wanted = ["g_settlement_id", "g_order_id", "l_invoice_no"]
    both = (["l_record_id", "g_record_id"], ["b_record_id"])
    days = ("g_paid_on", "b_value_date")
    hits = named_join(paid, b.where("b_direction = 'credit'"), both, ("g_net_paise", "b_amount_paise"), 0, wanted, "b_keys", 2, days, conf.date_window_days)
    hits = checkpointed(hits.where(refs.dates_in_order(F.col("l_issue_date"), F.col("g_captured"), F.col("g_settled"), F.col("b_value_date"))))
    debits = b.where("b_direction = 'debit'").select(F.col("b_record_id").alias("d_record_id"), F.col("b_amount_paise").alias("d_amount"), F.col("b_keys").alias("d_keys"))
    three = ["l_record_id", "g_record_id", "b_record_id"]
    reversed_ = named_join(hits.select(*three, "b_amount_paise", *wanted), debits, (three, ["d_record_id"]), ("b_amount_paise", "d_amount"), 0, wanted, "d_keys", 4)
    flag = reversed_.select("l_record_id", "b_record_id").distinct().withColumn("reversed", F.lit(True))
    return hits.join(flag, ["l_record_id", "b_record_id"], "left").withColumn("reversed", F.coalesce("reversed", F.lit(False)))


def _single(edges: DataFrame) -> DataFrame:
    """Drivers with one open gateway in all and one credit that fits it: what each claims."""
    kinds = edges.groupBy("driver").agg(F.count_if(F.col("kind") == "g").alias("gs"), F.count_if(F.col("kind") == "b").alias("bs"), F.max("reversed").alias("reversed"))
    good = kinds.where("gs = 1 and bs = 1 and not reversed").select("driver")
    return edges.join(good, "driver", "left_semi").select("driver", "resource", "kind")


def _single_rule(rows: list[dict]) -> list[dict]:
    """_single() for one driver."""
    good = sorted(r["kind"] for r in rows) == ["b", "g"] and not any(r["reversed"] for r in rows)
    return [{c: r[c] for c in ("driver", "resource", "kind")} for r in rows] if good else []


def exact(ledger: DataFrame, gateway: DataFrame, bank: DataFrame, conf: Conf) -> DataFrame:
    """Invoices with exactly one open payment by receipt, exact in all respects, and exactly one credit.

    A receipt with two open payments never comes down to one, as only invoices of that receipt could take one of them.
    """
    payments = unique_within(gateway, "receipt_key")
    pairs = exact_pairs(ledger, payments, bank, conf)
    pairs = checkpointed(pairs.select("l_record_id", "g_record_id", "b_record_id", "l_gross_paise", "l_invoice_no", "g_settlement_id", "g_paid_on", "b_value_date", "kind", "reversed"))
    driver = [F.col("l_record_id").alias("driver"), F.col("l_record_id").alias("ord")]
    edges = pairs.select(*driver, F.col("g_record_id").alias("resource"), F.lit("g").alias("kind"), F.lit(False).alias("reversed")).distinct()
    edges = edges.unionByName(pairs.select(*driver, F.col("b_record_id").alias("resource"), F.lit("b").alias("kind"), "reversed").distinct())

    def alive(left: DataFrame) -> DataFrame:
        both = left.groupBy("driver").agg(F.count_distinct("kind").alias("n")).where("n = 2")
        return left.join(both, "driver", "left_semi")

    won = resolve(edges, _single, alive=alive, rule=_single_rule).groupBy("driver").agg(
        F.max(F.when(F.col("kind") == "g", F.col("resource"))).alias("g"), F.max(F.when(F.col("kind") == "b", F.col("resource"))).alias("b")
    )
    out = won.join(pairs.withColumnsRenamed({"l_record_id": "driver", "g_record_id": "g", "b_record_id": "b"}).drop("reversed"), ["driver", "g", "b"])
    why = F.concat(F.lit("Invoice "), F.col("l_invoice_no"), F.lit(", its payment and its credit agree in reference, amount and dates."))
    evidence = F.array(
        proof("Receipt", F.concat(F.lit("The payment's receipt is "), F.col("l_invoice_no"), F.lit(".")), 1.0, ids("driver", "g")),
        reference_proof(F.col("kind"), F.coalesce("g_settlement_id", "l_invoice_no"), ids("b")), amount_proof(F.col("l_gross_paise"), F.col("l_gross_paise"), conf.amount_tolerance_paise, ids("driver", "g")),
        date_proof(refs.days_apart(F.col("g_paid_on"), F.col("b_value_date")), conf.date_window_days, ids("g", "b")),
    )
    return out.select(*group("driver", ids("driver"), ids("g"), ids("b"), F.col("l_gross_paise"), F.lit(0), F.lit(1000), F.lit(None), "exact", rationale=why, evidence=evidence))


def payment_of(ledger: DataFrame, gateway: DataFrame) -> DataFrame:
    """(l_record_id, g_record_id): the one open payment of an invoice by receipt, or, where no receipt
    is equal, the one whose receipt ends in the same six characters."""
    l, g = ledger.select(F.col("record_id").alias("l_record_id"), "invoice_key"), gateway.select(F.col("record_id").alias("g_record_id"), F.col("receipt_key").alias("invoice_key"), "receipt")
    direct = l.join(g.drop("receipt"), "invoice_key")
    rest = l.join(direct.select("l_record_id").distinct(), "l_record_id", "left_anti").withColumn("tail", refs.last6(F.col("invoice_key")))
    tails = g.where("receipt is not null and receipt <> ''").select("g_record_id", refs.last6(F.col("invoice_key")).alias("tail"))
    both = unique_within(direct.select("l_record_id", "g_record_id"), "l_record_id")
    return both.unionByName(unique_within(rest.join(tails, "tail").select("l_record_id", "g_record_id"), "l_record_id"))


#: Confidence, in thousandths, before anything speaks against a credit, and what no reference at all takes from it.
SURE, UNNAMED = 980, 250


def tolerant_scored(ledger: DataFrame, gateway: DataFrame, bank: DataFrame, conf: Conf, floor: int = 0) -> DataFrame:
    """Every invoice, its payment, and each credit within tolerance of the net that may reach `floor` thousandths: these, and
    the exception. Where the floor is too high for credits that name nothing, records of one amount meet by reference."""
    l, g, b = _named(ledger, "l"), _named(gateway, "g"), _named(bank, "b")
    paid = payment_of(ledger, gateway).join(l, "l_record_id").join(g, "g_record_id")
    credits, amounts, wanted = b.where("b_direction = 'credit'"), ("g_net_paise", "b_amount_paise"), ["g_settlement_id", "g_order_id", "l_invoice_no"]
    kinds = [i for i, (_, _, less) in enumerate(refs.KINDS, 1) if SURE - less >= floor]
    if SURE - UNNAMED >= floor:
        near = band_join(paid, credits, *amounts, conf.amount_tolerance_paise)
        near = near.withColumn("rank", refs.match_kind(F.col("b_keys"), F.array(*wanted)))
    else:
        near = named_join(checkpointed(paid), credits, (["l_record_id"], ["b_record_id"]), amounts, conf.amount_tolerance_paise, wanted, "b_keys", max(kinds, default=0))
        near = near.withColumnRenamed("kind", "rank")
    near = near.withColumn("variance", F.col("g_net_paise") - F.col("b_amount_paise")).withColumn("gap", refs.days_apart(F.col("g_paid_on"), F.col("b_value_date")))
    near = near.withColumn("fee_ok", money.fee_in_band(F.col("g_fee_paise"), F.col("g_amount_paise"), F.col("g_method"))).withColumn("name", refs.name_similarity(F.col("l_customer_name"), F.col("b_narration")))
    less = (
        refs.kind_value(F.col("rank"), 2) + F.when(F.col("rank") == 5, UNNAMED).otherwise(0) + F.when(F.col("variance") != 0, 50).otherwise(0) + F.when(F.col("gap") > 0, 50).otherwise(0)
        + F.when(F.col("fee_ok"), 0).otherwise(50) + F.when((F.col("name") >= 0.4) & (F.col("name") < 0.85), 100).otherwise(0)
    )
    why = (
        F.when(F.col("rank") == 5, "NARRATION_UNPARSEABLE").when(F.col("gap") > conf.date_window_days, "TIMING_LAG")
        .when(~F.col("fee_ok"), "FEE_DISCREPANCY").when(F.col("g_refund_paise") > 0, "REFUND_OFFSET")
    )
    kept = ["l_record_id", "g_record_id", "b_record_id", "l_gross_paise", "l_invoice_no", "l_customer_name", "variance", "gap", "rank", "fee_ok", "name"]
    kept += ["g_fee_paise", "g_amount_paise", "g_method", F.coalesce("g_settlement_id", "l_invoice_no").alias("wanted")]
    return near.select(*kept, F.col("b_amount_paise").alias("credit_paise"), (F.lit(SURE) - less).alias("milli"), why.alias("exception"))


def _best_rule(rows: list[dict]) -> list[dict]:
    """What one invoice takes of its open credits and payment: the best credit, if its payment is open."""
    fits = [((-r["milli"], r["credit_paise"], r["resource"]), r["resource"]) for r in rows if r["milli"] is not None]
    payments = [r["resource"] for r in rows if r["milli"] is None]
    if not fits or not payments:
        return []
    b, g = min(fits)[1], max(payments)
    return [{"driver": rows[0]["driver"], "resource": x, "b": b, "g": g} for x in (b, g)]


def tolerant(ledger: DataFrame, gateway: DataFrame, bank: DataFrame, conf: Conf, contests: bool = True) -> DataFrame:
    """The best-scored credit of each invoice, if it reaches the threshold. Payments are told as the pass begins.

    Of equal scores the smaller amount and then the earlier record wins. Credits that score too low
    to be taken are still looked at, as a better one may be gone. contests: a record goes to the first that takes it; without,
    each invoice is told what it would take if there were no others.
    """
    floor = int(conf.auto_clear_threshold * 1000 + 0.5)
    scored = checkpointed(tolerant_scored(ledger, gateway, bank, conf, floor).where(F.col("milli") >= floor))
    keep = [F.col("l_record_id").alias("driver"), F.col("l_record_id").alias("ord")]
    edges = scored.select(*keep, F.col("b_record_id").alias("resource"), "g_record_id", "milli", "credit_paise")
    edges = edges.unionByName(scored.select(*keep, F.col("g_record_id").alias("resource"), "g_record_id", F.lit(None).cast("int").alias("milli"), F.lit(None).cast("bigint").alias("credit_paise")).distinct())

    def decide(ready: DataFrame) -> DataFrame:
        best = ready.groupBy("driver").agg(
            F.min(F.when(F.col("milli").isNotNull(), F.struct((-F.col("milli")).alias("m"), "credit_paise", "resource"))).alias("x"),
            F.max(F.when(F.col("milli").isNull(), F.col("resource"))).alias("g"),
        )
        best = best.where("x is not null and g is not null")
        return best.select("driver", F.explode(F.array(F.col("x.resource"), F.col("g"))).alias("resource"), F.col("x.resource").alias("b"), "g")

    won = resolve(edges, decide, greedy=True, rule=_best_rule) if contests else decide(edges)
    won = won.select("driver", "b", "g").distinct()
    out = won.join(scored.withColumnsRenamed({"l_record_id": "driver", "g_record_id": "g", "b_record_id": "b"}), ["driver", "g", "b"])
    near = F.filter(
        F.array(
            F.when(F.col("rank") < 5, F.lit("a reference")), F.when(F.col("variance") == 0, F.lit("the amount")), F.when(F.col("gap") == 0, F.lit("the day"))
        ),
        lambda x: x.isNotNull(),
    )
    said = F.when(F.size(near) > 0, F.array_join(near, ", ")).otherwise(F.lit("size and time"))
    why = F.concat(F.lit("Best credit for invoice "), F.col("l_invoice_no"), F.lit(": it agrees in "), said, F.lit("."))
    name = proof("Customer", F.concat(F.lit("The bank line shares words with "), F.col("l_customer_name"), F.lit(".")), F.col("name"), ids("driver"))
    evidence = F.array(
        reference_proof(F.col("rank"), F.col("wanted"), ids("b")), amount_proof(F.col("credit_paise") + F.col("variance"), F.col("credit_paise"), conf.amount_tolerance_paise, ids("g", "b")),
        date_proof(F.col("gap"), conf.date_window_days, ids("g", "b")), fee_proof(F.col("g_fee_paise"), F.col("g_amount_paise"), F.col("g_method"), F.col("fee_ok"), ids("g")),
    )
    evidence = F.when(F.col("name") >= 0.4, F.concat(evidence, F.array(name))).otherwise(evidence)
    return out.select(*group("driver", ids("driver"), ids("g"), ids("b"), F.col("l_gross_paise"), F.col("variance"), F.col("milli"), F.col("exception"), "tolerant", rationale=why, evidence=evidence))


def settlement_batches(gateway: DataFrame) -> DataFrame:
    """Settlements of two payments or more: members in order, total net and gross, day of the first, any refund."""
    out = gateway.where("settlement_id is not null").groupBy("settlement_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_paise").alias("total_paise"), F.sum("amount_paise").alias("gross_paise"), F.array_sort(F.collect_list("record_id")).alias("members"),
        F.min(F.struct("record_id", "paid_on")).alias("first"), F.max(F.col("refund_paise") > 0).alias("refunded"),
    )
    return out.where("n >= 2").withColumn("settled_on", F.col("first.paid_on")).drop("first")


def batch_fits(gateway: DataFrame, bank: DataFrame, conf: Conf) -> DataFrame:
    """Credits and the whole batches that sum to them within tolerance, a few days apart at most."""
    credits, amounts, days = bank.where("direction = 'credit'"), ("amount_paise", "total_paise"), ("value_date", "settled_on")
    fits = grid_join(credits, settlement_batches(gateway), amounts, conf.amount_tolerance_paise, days, conf.date_window_days + 2)
    return fits.withColumn("hinted", refs.match_kind(F.col("keys"), F.array("settlement_id")) <= 4)


def _batch_rule(rows: list[dict], limit: int) -> list[dict]:
    """What one credit takes of the open settlements that fit it and the open invoices of their receipts."""
    fits = [r for r in rows if r["l"] is None]
    hinted = [r for r in fits if r["hinted"]]
    chosen = hinted if len(hinted) == 1 else fits
    out = lambda r, resource, number: {c: r[c] for c in ("driver", "settlement_id", "l", "receipt")} | {"resource": resource, "chosen": number}
    if len(chosen) != 1:
        return [out(r, None, len(chosen)) for r in chosen]
    if chosen[0]["n"] > limit:  # too large to take
        return []
    bills: dict[str, dict] = {}
    for r in sorted((r for r in rows if r["l"] is not None and r["settlement_id"] == chosen[0]["settlement_id"]), key=lambda r: r["l"]):
        bills.setdefault(r["receipt"], r)
    return [out(chosen[0], chosen[0]["resource"], 1), *(out(r, f"l {r['l']}", 0) for r in bills.values())]


def batches(ledger: DataFrame, gateway: DataFrame, bank: DataFrame, conf: Conf, contests: bool = True) -> DataFrame:
    """Credits that carry one whole settlement, with the first open invoice of each of its payments' receipts; a credit that
    several settlements could make up stays open to choice, with each of them as a candidate. contests: as in tolerant()."""
    fits = batch_fits(gateway, bank, conf)
    fits = checkpointed(fits.select(F.col("record_id").alias("driver"), "settlement_id", F.col("amount_paise").alias("credit"), "total_paise", "gross_paise", "members", "n", "refunded", "hinted"))
    # settlements and invoices are claimed alike; an invoice may be wanted by two settlements
    named = fits.select("driver", "settlement_id", F.explode("members").alias("g")).join(gateway.select(F.col("record_id").alias("g"), "receipt"), "g")
    wanted = named.where("receipt is not null").select("driver", "settlement_id", "receipt").distinct()
    wanted = wanted.join(ledger.select(F.col("invoice_no").alias("receipt"), F.col("record_id").alias("l")), "receipt")
    none = F.lit(None).cast("string")
    driver = [F.col("driver"), F.col("driver").alias("ord")]
    edges = fits.select(*driver, F.concat(F.lit("s "), "settlement_id").alias("resource"), "settlement_id", none.alias("receipt"), none.alias("l"), "hinted", "n")
    edges = edges.unionByName(
        wanted.select(*driver, F.concat(F.lit("l "), "l").alias("resource"), "settlement_id", "receipt", "l", F.lit(False).alias("hinted"), F.lit(0).cast("bigint").alias("n"))
    )

    def decide(ready: DataFrame) -> DataFrame:
        fit = ready.where("l is null")
        tally = fit.groupBy("driver").agg(F.count_if("hinted").alias("hints"), F.count(F.lit(1)).alias("fits"))
        chosen = fit.join(tally, "driver").where((F.col("hints") != 1) | F.col("hinted"))
        chosen = chosen.withColumn("chosen", F.when(F.col("hints") == 1, F.lit(1)).otherwise(F.col("fits")))
        # a batch too large to take, and one that is not the only choice, stays in the pool
        taken = (F.col("chosen") == 1) & (F.col("n") <= conf.batch_limit)
        kept = chosen.where(taken | (F.col("chosen") > 1)).select("driver", F.when(taken, F.col("resource")).alias("resource"), "settlement_id", none.alias("l"), none.alias("receipt"), "chosen")
        first = ready.where("l is not null").groupBy("driver", "settlement_id", "receipt").agg(F.min("l").alias("l"))
        bills = first.join(kept.where("chosen = 1").select("driver", "settlement_id"), ["driver", "settlement_id"])
        return kept.unionByName(bills.select("driver", F.concat(F.lit("l "), "l").alias("resource"), "settlement_id", "l", "receipt", F.lit(0).cast("bigint").alias("chosen")))

    def alive(left: DataFrame) -> DataFrame:
        return left.join(left.where("l is null").select("driver").distinct(), "driver", "left_semi")

    won = resolve(edges, decide, alive=alive, rule=lambda rows: _batch_rule(rows, conf.batch_limit)) if contests else decide(edges)
    won = checkpointed(won)
    of = named.join(won.where("l is not null").select("driver", "settlement_id", "receipt", "l"), ["driver", "settlement_id", "receipt"])
    bills = of.groupBy("driver").agg(F.array_sort(F.collect_list("l")).alias("ledger"))  # an invoice paid twice in a batch shows twice
    single = won.where("chosen = 1").select("driver", "settlement_id").join(fits, ["driver", "settlement_id"]).join(bills, "driver", "left")
    variance = F.col("credit") - F.col("total_paise")
    why = F.concat(F.lit("Settlement "), F.col("settlement_id"), F.lit(" of "), F.col("n").cast("string"), F.lit(" payments sums to this credit."))
    evidence = F.array(
        proof("Whole settlement", F.concat(F.col("n").cast("string"), F.lit(" payments, "), money.format_inr(F.col("total_paise")), F.lit(" in all.")), 0.85, F.col("members")),
        amount_proof(F.col("total_paise"), F.col("credit"), conf.amount_tolerance_paise, ids("driver")),
    )
    named_it = proof("Reference", F.concat(F.lit("The bank line names "), F.col("settlement_id"), F.lit(".")), 1.0, ids("driver"))
    evidence = F.when(F.col("hinted"), F.concat(evidence, F.array(named_it))).otherwise(evidence)
    out = single.select(
        *group(
            "driver", F.coalesce("ledger", no_ids()), F.col("members"), ids("driver"), F.col("gross_paise"), variance, F.when(F.col("hinted"), 950).otherwise(780),
            F.when(F.col("refunded"), "REFUND_OFFSET").otherwise("MERGED_PAYMENT"), "combinatorial", rationale=why, evidence=evidence,
        )
    )
    open_ = won.where("chosen > 1").select("driver", "settlement_id").join(fits, ["driver", "settlement_id"])
    choice = F.struct(
        F.concat(F.lit("CND-"), "driver", F.lit("-"), "settlement_id").alias("candidate_id"), no_ids().alias("ledger_ids"), F.col("members").alias("gateway_ids"), ids("driver").alias("bank_ids"),
        F.col("total_paise").alias("amount_paise"), variance.alias("variance_paise"), F.lit(0).alias("gap_days"), F.lit(500).alias("milli"), F.when(F.col("hinted"), 0.8).otherwise(0.2).alias("reference"),
        F.lit(0.0).alias("customer"), F.lit("its payments sum to the credit, and so do others").alias("note"), F.lit("MERGED_PAYMENT").alias("exception_type"),
    )
    open_ = open_.groupBy("driver").agg(F.first("credit").alias("credit"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("settlement_id", choice.alias("c")))).alias("all"))
    many = F.concat(F.col("n").cast("string"), F.lit(" settlements sum to "), money.format_inr(F.col("credit")), F.lit("."))
    rows = group(
        "driver", no_ids(), no_ids(), ids("driver"), F.col("credit"), F.lit(0), F.lit(450), F.lit("MERGED_PAYMENT"), "unmatched", True,
        rationale="Several settlements sum to this credit; none is chosen.", evidence=F.array(proof("Several settlements", many, 0.3, ids("driver"))), candidates=F.col("all.c"),
    )
    return out.unionByName(open_.select(*rows))


def split_payments(ledger: DataFrame, gateway: DataFrame) -> DataFrame:
    """Invoices with two open payments or more under their very number: the payments, and sums over them."""
    payments = gateway.select(F.col("receipt").alias("invoice_no"), F.col("record_id").alias("g"), "net_paise", "paid_on", "settlement_id", "order_id")
    paid = ledger.select(F.col("record_id").alias("driver"), "invoice_no", "gross_paise").join(payments, "invoice_no")
    many = paid.groupBy("driver").agg(F.count(F.lit(1)).alias("n"), F.sum("net_paise").alias("target"), F.collect_set("paid_on").alias("days"))
    many = many.where("n >= 2")
    return paid.join(many, "driver")


def split_pools(parts: DataFrame, credits: DataFrame, conf: Conf) -> DataFrame:
    """(driver, b, credit): credits a few days from any part of an invoice, and no larger than all its parts together."""
    window, tolerance = conf.date_window_days + 3, conf.amount_tolerance_paise
    days = parts.select("driver", "target", "n", "paid_on")
    near = date_band_join(days, credits.select("b", "value_date", "credit"), "paid_on", "value_date", window)
    return near.where(F.col("credit") <= F.col("target") + tolerance * F.col("n")).select("driver", "b", "credit").distinct()


def split_sums(wide: DataFrame, pools: DataFrame, conf: Conf) -> DataFrame:
    """first_sums() of invoices (driver, target, n) over their pools: sets of n credits, 3 at least, at most."""
    asks = wide.select("driver", "target", (conf.amount_tolerance_paise * F.col("n")).alias("tolerance"), F.greatest("n", F.lit(3)).alias("most"))
    return first_sums(asks, pools.select("driver", F.col("b").alias("item"), F.col("credit").alias("amount")))


def _direct(named: DataFrame) -> DataFrame:
    """(driver, chosen): what each part takes in turn, the first credit that fits it and no part before it took."""
    parts = named.groupBy("driver", "g").agg(F.array_sort(F.collect_list("b")).alias("fits"))
    each = parts.groupBy("driver").agg(F.array_sort(F.collect_list(F.struct("g", "fits"))).alias("parts"))
    take = lambda done, part: F.concat(done, F.slice(F.array_except(part["fits"], done), 1, 1))
    return each.select("driver", F.aggregate("parts", no_ids(), take).alias("chosen"))


def splits(ledger: DataFrame, gateway: DataFrame, bank: DataFrame, conf: Conf) -> DataFrame:
    """Invoices paid in parts: by a credit for each part that names it, else by a set of credits of the right sum.

    In the order of invoices: each part takes, in order, the first open credit of its net amount, near its day, that names
    it; if one part finds none, sets of the open credits near any part are searched. The parts of an invoice number are
    taken by its first invoice that succeeds.

    All open invoices are told at once, round by round. One whose parts all find a credit hangs only on what it takes. The
    others meet the credits of their window that are no larger than what is to be found; their first two sets come by
    first_sums(), and anew only if a credit of these was taken since. A finding stands unless an invoice before it takes
    one of the credits it hangs on, or may yet.
    """
    window, tolerance = conf.date_window_days + 3, conf.amount_tolerance_paise
    parts = checkpointed(split_payments(ledger, gateway))
    credits = checkpointed(bank.where("direction = 'credit'").select(F.col("record_id").alias("b"), "value_date", F.col("amount_paise").alias("credit"), "keys"))
    near = F.exists("days", lambda d: refs.days_apart(d, F.col("value_date")) <= window)  # near any part
    named = parts.join(credits, F.col("credit") == F.col("net_paise")).where(near)
    named = named.where(refs.match_kind(F.col("keys"), F.array("invoice_no", "settlement_id", "order_id")) <= 4)
    named = checkpointed(named.select("driver", "invoice_no", "g", "b", "credit"))
    jobs = checkpointed(parts.groupBy("driver", "invoice_no", "gross_paise", "target", "n").agg(F.array_sort(F.collect_list("g")).alias("parts")))
    left, met, out, tried = jobs, None, None, None

    while left.take(1):
        told = _direct(named).join(left.select("driver", "n"), "driver").where(F.size("chosen") == F.col("n")).select("driver", "chosen")
        told = checkpointed(told)
        wide = left.join(told, "driver", "left_anti").select("driver", "target", "n")
        fresh = wide if met is None else wide.join(met.select("driver").distinct(), "driver", "left_anti")
        if fresh.take(1):
            near = split_pools(parts.join(fresh.select("driver"), "driver", "left_semi"), credits, conf)
            if out is not None:
                near = near.join(out.select(F.explode("bank_ids").alias("b")), "b", "left_anti")
            # an invoice with no credit to meet is known by an edge of its own
            near = near.unionByName(fresh.select("driver", F.concat(F.lit(" "), "driver").alias("b"), F.lit(None).cast("bigint").alias("credit")))
            met = checkpointed(near if met is None else near.unionByName(met))
        if met is not None:  # search the sets of those that were not yet, or lost a credit since
            ask = wide if tried is None else wide.join(tried, "driver", "left_anti")
            new = split_sums(ask, met.where("credit is not null"), conf)
            new = new.select(
                "driver", F.get("found", F.lit(0))["items"].alias("bank_ids"), F.get("found", F.lit(0))["total"].alias("total"), F.size("found").alias("ways"), F.array_distinct(F.flatten("found.items")).alias("hangs"),
            )
            tried = checkpointed(new if tried is None else new.unionByName(tried))
        sums = told.select("driver", F.explode("chosen").alias("b")).join(credits.select("b", "credit"), "b").groupBy("driver").agg(F.array_sort(F.collect_list("b")).alias("bank_ids"), F.sum("credit").alias("total"))
        may = sums.select("driver", "bank_ids", "total", F.lit(1).alias("ways"), F.col("bank_ids").alias("hangs"))
        if tried is not None:
            may = may.unionByName(tried.where("ways > 0"))
        may = checkpointed(may)
        same = left.select("driver", F.concat(F.lit("no "), "invoice_no").alias("resource"))
        edges = named.select("driver", F.col("b").alias("resource")).unionByName(same)
        if met is not None:
            edges = edges.unionByName(met.join(told, "driver", "left_anti").select("driver", F.col("b").alias("resource")))
        edges = checkpointed(edges.join(left.select("driver"), "driver", "left_semi").distinct())
        number = lambda own: same.join(own, "driver", "left_semi")
        # what a finding hangs on: the sets found, as they stay the first ones while their credits are open; nothing if there is
        # no set, as losses make none
        hangs = checkpointed(may.select("driver", F.explode("hangs").alias("resource")).unionByName(number(may)).distinct())
        claims = may.select("driver", F.explode("bank_ids").alias("resource")).unionByName(number(may))
        first = claims.groupBy("resource").agg(F.min("driver").alias("first"))
        # findings that an earlier one takes from are unsure, and so are those that such a one may still take from
        unsure = checkpointed(hangs.join(first, "resource").where("driver > first").select("driver").distinct())
        while True:
            first = edges.join(unsure, "driver", "left_semi").groupBy("resource").agg(F.min("driver").alias("first"))
            more = hangs.join(first, "resource").where("driver > first").select("driver").distinct().join(unsure, "driver", "left_anti")
            more = checkpointed(more)
            if not more.take(1):
                break
            unsure = checkpointed(unsure.unionByName(more))
        good = checkpointed(may.join(unsure, "driver", "left_anti"))
        idle = left.select("driver").join(may, "driver", "left_anti").join(unsure, "driver", "left_anti")
        out = good if out is None else out.unionByName(good)
        # invoices that took, can take nothing, or lost their parts to one of the same number are done
        numbers = left.join(good, "driver", "left_semi").select("invoice_no").distinct()
        done = good.select("driver").unionByName(idle)
        after = checkpointed(left.join(done, "driver", "left_anti").join(numbers, "invoice_no", "left_anti"))
        gone = good.select(F.explode("bank_ids").alias("b")).distinct()
        rest = checkpointed(named.join(gone, "b", "left_anti"))
        if met is not None:
            hit = tried.select("driver", F.explode("hangs").alias("b")).join(gone, "b", "left_semi").select("driver").distinct()
            tried = checkpointed(tried.join(hit, "driver", "left_anti").join(after.select("driver"), "driver", "left_semi"))
            met = checkpointed(met.join(gone, "b", "left_anti").join(after.select("driver"), "driver", "left_semi"))
        for old in (told, edges, named, may, hangs):
            drop(old)
        left, named = after, rest
    if out is None:
        return ledger.sparkSession.createDataFrame([], GROUP)
    full = out.join(jobs, "driver")
    why = F.concat(F.lit("Invoice "), F.col("invoice_no"), F.lit(" was paid in "), F.col("n").cast("string"), F.lit(" parts by "), F.size("bank_ids").cast("string"), F.lit(" credits."))
    detail = F.concat(F.lit("Credits of "), money.format_inr(F.col("total")), F.lit(" for payments of "), money.format_inr(F.col("target")), F.lit(" net."))
    evidence = F.array(proof("Parts add up", detail, 0.8, F.concat("parts", "bank_ids")))
    return full.select(
        *group(
            "driver", ids("driver"), F.col("parts"), F.col("bank_ids"), F.col("gross_paise"), F.col("target") - F.col("total"), F.when(F.col("ways") > 1, 450).otherwise(950),
            F.lit("SPLIT_PAYMENT"), "combinatorial", rationale=why, evidence=evidence,
        )
    )
