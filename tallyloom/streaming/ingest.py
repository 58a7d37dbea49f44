"""Exports that keep arriving in a folder, typed by Structured Streaming batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingest

KINDS = {"ledger": ingest.ledger, "gateway": ingest.gateway, "bank": ingest.bank}
#: Rows of an export that agree in these are copies.
KEYS = {"ledger": ("invoice_no", "gross_paise"), "gateway": ("payment_id", "amount_paise", "captured_at"), "bank": ("posted_at", "amount_paise", "narration_key")}


def ingest_stream(spark: SparkSession, folder: str, source: str, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Type every file that appears in folder and append it to the tables out/<source> and out/warnings-<source>.

    Each batch is one partition (batch_id) of both tables and is overwritten as a whole, so a batch
    that runs again after a failure leaves nothing twice. Record ids count within a batch and are
    made whole by the batch's number; row numbers count within the batch. progress() tells how far it is.
    """
    arriving = spark.readStream.schema(", ".join(f"`{c}` string" for c in ingest.COLUMNS[source])).option("header", True).option("multiLine", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(folder)

    def put(df: DataFrame, path: str, batch: int) -> None:
        df.withColumn("batch_id", F.lit(batch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/{path}")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            typed = KINDS[source](batch)
            put(typed.rows.withColumn("record_id", F.concat("record_id", F.lit(f"-{batch_id}"))), source, batch_id)
            put(typed.warnings, f"warnings-{source}", batch_id)
            counts = batch.agg(F.count(F.lit(1)).alias("rows_read"), F.current_timestamp().alias("at")).withColumn("source", F.lit(source))
            put(counts, f"progress-{source}", batch_id)
        finally:
            batch.unpersist()

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, out: str, source: str) -> DataFrame:
    """(source, batch_id, rows_read, at) of every finished batch."""
    return spark.read.parquet(f"{out}/progress-{source}").select("source", "batch_id", "rows_read", "at").orderBy("batch_id")


def duplicate_stream(spark: SparkSession, out: str, source: str, checkpoint: str) -> StreamingQuery:
    """Follow out/<source>, as ingest_stream() writes it, and keep what rows are copies of each other over all batches so far.

    The ids of each key are the query's state, in its checkpoint, so each start reads new files only. Ids are a set, so a batch
    that was written again counts once. Keys that gained a copy go to out/duplicates-<source>; see arrived_duplicates().
    """
    path = f"{out}/{source}"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    if source == "bank":
        rows = rows.withColumn("narration_key", ingest.narration_key(F.col("narration")))
    known = rows.groupBy(*KEYS[source]).agg(F.array_sort(F.collect_set("record_id")).alias("ids"))

    def put(df: DataFrame, batch_id: int) -> None:
        found = df.where("size(ids) > 1").withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/duplicates-{source}")

    return known.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived_duplicates(spark: SparkSession, out: str, source: str) -> DataFrame:
    """(source, ids) of all that arrived: what ingest.duplicates() says of the whole table."""
    key = ", ".join(f"{c} {spark.read.parquet(f'{out}/{source}').schema[c].dataType.simpleString()}" for c in KEYS[source] if c != "narration_key")
    key += ", narration_key string" if "narration_key" in KEYS[source] else ""
    found = spark.read.schema(f"{key}, ids array<string>, batch_id bigint").parquet(f"{out}/duplicates-{source}")
    last = found.groupBy(*KEYS[source]).agg(F.max_by("ids", "batch_id").alias("ids"))
    return last.select(F.lit(source).alias("source"), "ids")
