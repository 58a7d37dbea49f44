"""Helpers that the training-data operators share: tables, scratch space, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialize, new_path

__all__ = ["WORD", "about", "crc_mod", "drop", "free_name", "long_rows", "materialize", "new_path", "table", "unit_hash", "word_count"]

#: A word is a run of characters outside this class (a fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_rows(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """df; from now on its session sends Python at most about so many bytes at once, as one row may be a whole book.

    A smaller limit of the session's own stays.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most_bytes:
        spark.conf.set(key, str(most_bytes))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not use, whatever the case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def word_count(text: Column) -> Column:
    """Words of the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def about(df: DataFrame, most: int, *key: Column | str, seed: int = 0, total: int | None = None) -> DataFrame:
    """df thinned to about `most` rows by a hash of the key; all rows if there are no more.

    Unlike a sorted limit, no task and not the driver gathers `most` rows from every partition.
    """
    total = df.count() if total is None else total
    return df if total <= most else df.where(unit_hash(*key, seed=seed) < most / total)


def unit_hash(*key: Column | str, seed: int = 0) -> Column:
    """A hash of the key as a number from 0 to 1."""
    return F.xxhash64(F.lit(seed), *key).bitwiseAND((1 << 62) - 1) / F.lit(2.0**62)
