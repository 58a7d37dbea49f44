"""CSV exports to typed tables, with a quarantine of what could not be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, refs
from ..operators.pools import numbered
from ..operators.residual import narration_key

WARNING = ("source", "row_number", "field", "raw_value", "reason")
COLUMNS = {
    "ledger": ("invoice_no", "customer_id", "customer_name", "issue_date", "due_date", "gross_amount", "tax_amount", "currency", "status", "reference"),
    "gateway": ("payment_id", "order_id", "receipt", "captured_at", "amount", "fee", "tax_on_fee", "net", "method", "status", "refund", "settlement_id", "settled_at"),
    "bank": ("value_date", "posted_at", "narration", "reference_no", "type", "amount", "balance"),
}


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """All-string rows with trimmed headers; blank lines are skipped; quotes are doubled inside quotes.

    With multiline a file is one task, as line breaks may be quoted; without it files are split.
    """
    df = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def positioned(raw: DataFrame, source: str) -> DataFrame:
    """raw with every expected column, row_number of the file (2 is the first row), and the row itself."""
    kept = [c for c in raw.columns if c != "row_number"]
    if "row_number" not in raw.columns:
        raw = numbered(raw.withColumn("_at", F.monotonically_increasing_id()), "_at", column="row_number").withColumn("row_number", F.col("row_number") + 1).drop("_at")
    row = F.map_from_arrays(F.array(*(F.lit(c) for c in kept)), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept)))
    return raw.select("row_number", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in kept else F.lit("").alias(c) for c in COLUMNS[source]), row.alias("raw_row"))


def blank_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


@dataclass
class Typed:
    rows: DataFrame
    warnings: DataFrame


def _typed(raw: DataFrame, source: str, prefix: str, keys: list[str], soft: list[str]) -> tuple[DataFrame, DataFrame]:
    """Amounts as <name>_paise: rows with a bad key amount are dropped with a warning (the first bad one in order),
    bad soft amounts that are not blank are warned of and become 0. Ids count the kept rows."""
    df = positioned(raw, source)
    for c in (*keys, *soft):
        df = df.withColumn(f"{c}_paise", money.parse_paise(F.col(c)))
    bad = F.coalesce(*(F.when(F.col(f"{c}_paise").isNull(), F.lit(c)) for c in keys), F.lit(None).cast("string"))
    df = df.withColumn("_bad", bad)
    note = lambda d, c, why: d.select(F.lit(source).alias("source"), "row_number", F.lit(c).alias("field"), F.col(c).alias("raw_value"), F.lit(why).alias("reason"))
    kept = df.where("_bad is null")
    warnings = [note(df.where(F.col("_bad") == c), c, "unparseable amount, row dropped") for c in keys]
    warnings += [note(kept.where(F.col(f"{c}_paise").isNull() & (F.trim(c) != "")), c, "unparseable amount, taken as 0") for c in soft if c != "refund"]
    out = warnings[0]
    for w in warnings[1:]:
        out = out.unionByName(w)
    for c in soft:
        kept = kept.withColumn(f"{c}_paise", F.coalesce(f"{c}_paise", F.lit(0).cast("bigint")))
    kept = numbered(kept.drop("_bad"), "row_number", column="_n").withColumn("record_id", refs.padded_id(prefix, F.col("_n"))).drop("_n")
    return kept, out


def ledger(raw: DataFrame) -> Typed:
    kept, warnings = _typed(raw, "ledger", "LED", ["gross_amount"], ["tax_amount"])
    status = F.col("status") if "status" in raw.columns else F.lit("open")
    rows = kept.select(
        "record_id", "invoice_no", "customer_id", "customer_name", refs.date_only(F.col("issue_date")).alias("issue_date"), refs.date_only(F.col("due_date")).alias("due_date"), F.col("gross_amount_paise").alias("gross_paise"),
        F.col("tax_amount_paise").alias("tax_paise"), F.lit("INR").alias("currency"), status.alias("status"), blank_null(F.col("reference")).alias("expected_reference"), "raw_row",
    )
    return Typed(rows, warnings)


def gateway(raw: DataFrame) -> Typed:
    kept, warnings = _typed(raw, "gateway", "GTW", ["amount", "net"], ["fee", "tax_on_fee", "refund"])
    rows = kept.select(
        "record_id", "payment_id", blank_null(F.col("order_id")).alias("order_id"), blank_null(F.col("receipt")).alias("receipt"), "captured_at", refs.date_only(F.col("captured_at")).alias("captured"), "amount_paise", "fee_paise",
        "tax_on_fee_paise", "net_paise", "method", "status", "refund_paise", blank_null(F.col("settlement_id")).alias("settlement_id"), blank_null(F.col("settled_at")).alias("settled_at"), refs.date_only(blank_null(F.col("settled_at"))).alias("settled"), "raw_row",
    )
    return Typed(rows, warnings)


def bank(raw: DataFrame) -> Typed:
    """DR is a debit, all else a credit; an explicit reference comes first among a line's references."""
    kept, warnings = _typed(raw, "bank", "BNK", ["amount"], ["balance"])
    found = refs.extract_references(F.col("narration"))
    tokens = F.when(F.col("reference_no_").isNotNull() & ~F.array_contains(found, F.col("reference_no_")), F.concat(F.array("reference_no_"), found)).otherwise(found)
    rows = kept.withColumn("reference_no_", blank_null(F.col("reference_no"))).select(
        "record_id", refs.date_only(F.col("value_date")).alias("value_date"), "posted_at", "narration", F.col("reference_no_").alias("reference_no"),
        F.when(F.upper(F.trim("type")) == "DR", "debit").otherwise("credit").alias("direction"), F.abs("amount_paise").alias("amount_paise"), "balance_paise", tokens.alias("tokens"), "raw_row",
    )
    return Typed(rows.withColumn("keys", refs.ref_keys(F.col("tokens"))), warnings)


def duplicates(df: DataFrame, source: str, *key: str) -> DataFrame:
    """(source, ids): rows that share a key, not removed. The ids of one key are few: copies of one row."""
    out = df.groupBy(*key).agg(F.array_sort(F.collect_list("record_id")).alias("ids")).where("size(ids) > 1")
    return out.select(F.lit(source).alias("source"), "ids")


def duplicate_report(ledger_: DataFrame, gateway_: DataFrame, bank_: DataFrame) -> DataFrame:
    a = duplicates(ledger_, "ledger", "invoice_no", "gross_paise")
    b = duplicates(gateway_, "gateway", "payment_id", "amount_paise", "captured_at")
    c = duplicates(bank_.withColumn("narration_key", narration_key(F.col("narration"))), "bank", "posted_at", "amount_paise", "narration_key")
    return a.unionByName(b).unionByName(c)


def duplicate_warnings(report: DataFrame) -> DataFrame:
    """The report as warnings of row 0."""
    return report.select("source", F.lit(0).cast("bigint").alias("row_number"), F.lit("record_id").alias("field"), F.array_join("ids", ", ").alias("raw_value"), F.lit("duplicate rows").alias("reason"))


@dataclass
class Dataset:
    ledger: DataFrame
    gateway: DataFrame
    bank: DataFrame
    warnings: DataFrame
    truth: DataFrame | None


def read_dataset(spark: SparkSession, folder: str) -> Dataset:
    """The three exports of a folder, their warnings and duplicates, and ground_truth.json."""
    parts = [f(read_csv(spark, f"{folder}/{n}.csv")) for n, f in (("ledger", ledger), ("gateway", gateway), ("bank", bank))]
    warnings = duplicate_warnings(duplicate_report(*(p.rows for p in parts)))
    for p in parts:
        warnings = warnings.unionByName(p.warnings)
    return Dataset(*(p.rows for p in parts), warnings, read_truth(spark, f"{folder}/ground_truth.json"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    kind = "entries array<struct<truth_id:string, ledger_ids:array<string>, gateway_ids:array<string>, bank_ids:array<string>, exception_type:string, scenario:string, is_resolvable:boolean, amount_paise:bigint>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("entries").alias("truth_no", "e"))
    return rows.select(F.col("truth_no").cast("bigint").alias("truth_no"), "e.*")


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: fields are quoted where they hold a quote, comma or line break, and quotes are doubled."""
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
