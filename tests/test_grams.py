"""The inverted table finds what a scan finds, and reads what it must."""

from pyspark.sql import functions as F

from tallyloom.operators import grams, views

ROWS = [(f"R{i}", text) for i, text in enumerate(["NEFT/CR/00123 Acme", "neft cr", "", None, "ab", "Zoë Ünal", "aaaa", "a b c", "x" * 3000 + "needle", "NEFT/CR/00123 Acme", "100% _of_ it"])]
ASKED = ["/cr", "NEFT", "a", "ab", "", "zoë ü", "aaa", "aaaaa", "needle", "b c", "00123 ACME", "0% _", "nothing here", "R1"]


def test_search_is_that_of_a_scan(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "record_id string, narration string")
    shown = F.concat_ws(" ", "record_id", "narration")
    index = grams.Index(spark, f"file://{tmp_path}/g", buckets=4).write(rows, "record_id", shown)
    for text in ASKED:
        got = sorted(r.record_id for r in index.search(rows, "record_id", shown, text).collect())
        assert got == sorted(r.record_id for r in views.search(rows, text, "record_id", "narration").collect()), text
        assert got == sorted(i for i, t in ROWS if text.lower() in f"{i} {t}".lower().removesuffix(" none" if t is None else "\0")), text


def test_candidates_hold_every_hit_and_few_others(spark, tmp_path):
    rows = spark.range(3000).select(F.format_string("BNK-%06d", "id").alias("record_id"), F.format_string("NEFT CR %05d", F.col("id") * 7).alias("narration"))
    shown = F.concat_ws(" ", "record_id", "narration")
    index = grams.Index(spark, f"file://{tmp_path}/g").write(rows, "record_id", shown)
    found = index.search(rows, "record_id", shown, "CR 00700")
    assert [r.record_id for r in found.collect()] == ["BNK-000100"] and index.candidates("CR 00700").count() <= 30
    read = {r.f for r in index.postings(["070"]).select(F.input_file_name().alias("f")).collect()}
    assert len(read) <= 8 and len({x.split("bucket=")[1].split("/")[0] for x in read}) == 1  # one bucket of 64
    assert index.write(rows.limit(0), "record_id", shown) is index


def test_explorer_goes_on_after_what_is_shown(spark):
    rows = spark.range(350).select(F.format_string("R%04d", "id").alias("record_id"))
    pages = [views.explorer(rows, *step).collect() for step in ((0, 100), (100, 200), (300, 200))]
    assert [len(p) for p in pages] == [100, 200, 50] and [r.record_id for p in pages for r in p] == [f"R{i:04}" for i in range(350)]
