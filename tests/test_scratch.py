"""Intermediate tables leave nothing behind but themselves."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from tallyloom import scratch


def shuffled(spark):
    return {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}


def test_materialize_leaves_no_shuffle_files(spark):
    """What a table was shuffled by goes once it is written; the session's own setting stays."""
    before, setting = shuffled(spark), spark.conf.get(scratch._CLEANUP)
    df = spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.collect_list("id").alias("ids"))
    kept = scratch.materialize(df.join(df.select("k", F.size("ids").alias("n")), "k").orderBy("n"))
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert kept.count() == 997 and spark.conf.get(scratch._CLEANUP) == setting


def test_set_links_keeps_only_links_and_facts(spark):
    """Whole sets, their prefixes and pairs are deleted as soon as nothing reads them."""
    from tallyloom.llm import jaccard
    from tallyloom.llm.simhash import simhash

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("doc_id") % 40 * 100 + i).cast("string"))), " ")
    docs = spark.range(400).select(F.col("id").alias("doc_id")).select("doc_id", F.concat(words, F.lit(" "), F.col("doc_id").cast("string")).alias("text"))
    own = scratch.materialize(jaccard.prefixes(docs, 5, 0.8, jaccard.often_seen(docs, 5, 400, 100), simhash), "prefixes")
    before = set(scratch._written)
    links = jaccard.set_links(docs, own, spark.createDataFrame([], "u long, v long"), 5, 0.8, crowd=2)
    assert links.count() >= 360
    left = {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in set(scratch._written) - before}
    assert not left & {"sets", "met", "met-facts", "met-groups", "met-rarely", "set-elements", "set-pairs"}, left


def test_containment_keeps_no_grams(spark):
    """The six-character places of all texts are deleted once both directions have been joined."""
    from tallyloom.operators import blocking

    refs = spark.range(500).select("id", F.format_string("REF%08d", "id").alias("x"))
    known = refs.select(F.concat(F.lit("AB"), "x").alias("target"))
    before = set(scratch._written)
    found = blocking.contained(refs.select(F.col("x").alias("full")), known)
    assert found.count() == 500 and len(set(scratch._written) - before) == 2
    before = set(scratch._written)
    pairs = blocking.reference_join(refs.toDF("key_id", "full"), refs.toDF("want_id", "target"))
    assert pairs.where("key_id = want_id").count() == 500 and len(set(scratch._written) - before) == 1
