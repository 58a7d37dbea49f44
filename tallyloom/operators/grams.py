"""Substring search over many records by an inverted table of the three-character pieces of their texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def grams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case; none if it is null or shorter."""
    chars = F.split(F.lower(text), "")
    runs = F.transform(F.sequence(F.lit(1), F.size(chars) - 2), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1), F.element_at(chars, i + 2)))
    return F.when(F.size(chars) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """(gram, id) in `buckets` folders by a hash of the gram, sorted by gram; what is searched is `shown` of each record."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def write(self, records: DataFrame, id_column: str, shown: Column) -> Index:
        """A row for each record and each of its grams. Frequent grams are dealt over tasks by the record's id as well."""
        rows = records.select(F.col(id_column).alias("id"), F.explode(grams(shown)).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        spread = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        spread.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(self.path)
        return self

    def postings(self, wanted: list[str]) -> DataFrame:
        """The rows of some grams; only their buckets are read."""
        of = [r.b for r in self.spark.createDataFrame([(x,) for x in wanted], "g string").select(_bucket(F.col("g"), self.buckets).alias("b")).distinct().collect()]
        return self.spark.read.schema("id string, gram string, bucket int").parquet(self.path).where(F.col("bucket").isin(of) & F.col("gram").isin(wanted))

    def candidates(self, text: str, least: int = 3) -> DataFrame | None:
        """(id) of records that hold the `least` rarest grams of the text; None if it is too short to have grams.

        Few grams are enough, since records are looked at in the end; the rarest leave the fewest.
        """
        wanted = self.spark.range(1).select(grams(F.lit(text)).alias("g")).first().g  # pieces of what was asked
        if not wanted:
            return None
        counts = {r.gram: r.n for r in self.postings(wanted).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a piece
        rarest = sorted(wanted, key=lambda x: (counts.get(x, 0), x))[:least]
        held = self.postings(rarest).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return held.where(F.col("n") == len(rarest)).select("id")

    def search(self, records: DataFrame, id_column: str, shown: Column, text: str) -> DataFrame:
        """Rows whose `shown` holds the text, whatever the case: those of a scan. Ids are looked up, then texts compared; a
        text under three characters is scanned for."""
        found = self.candidates(text)
        rows = records if found is None else records.join(found.withColumnRenamed("id", "_id"), F.col(id_column).cast("string") == F.col("_id"), "left_semi")
        return rows.where(F.contains(F.lower(shown), F.lower(F.lit(text))))
