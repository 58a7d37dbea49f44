from tallyloom.streaming import ingest

HEAD = "value_date,posted_at,narration,reference_no,type,amount,balance\n"


def test_files_are_typed_once_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = [f"file://{tmp_path}/{x}" for x in ("in", "out", "check")]

    def run():
        ingest.ingest_stream(spark, at[0], "bank", at[1], at[2]).awaitTermination()
        return sorted((r.narration, r.amount_paise, r.direction) for r in spark.read.parquet(f"{at[1]}/bank").collect())

    (tmp_path / "in/a.csv").write_text(HEAD + "2026-01-02,2026-01-02,NEFT one,,CR,10.00,1\n2026-01-02,2026-01-02,NEFT bad,,CR,N/A,1\n")
    assert run() == [("NEFT one", 1000, "credit")]
    (tmp_path / "in/b.csv").write_text(HEAD + "2026-01-03,2026-01-03,NEFT two,,DR,-5.50,oops\n")
    assert run() == [("NEFT one", 1000, "credit"), ("NEFT two", 550, "debit")]
    assert run() == [("NEFT one", 1000, "credit"), ("NEFT two", 550, "debit")]
    assert {(r.field, r.batch_id) for r in spark.read.parquet(f"{at[1]}/warnings-bank").collect()} == {("amount", 0), ("balance", 1)}
    assert [r.rows_read for r in ingest.progress(spark, at[1], "bank").collect()] == [2, 1]


def test_copies_across_files_are_found_as_in_one_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyloom.sources import ingest as whole

    (tmp_path / "in").mkdir()
    at = [f"file://{tmp_path}/{x}" for x in ("in", "out", "check", "check2")]
    line = "2026-01-0{d},2026-01-0{d},NEFT {n},,CR,{a}.00,1\n"
    files = [[(1, "one", 5), (1, "two", 5)], [(1, "ONE", 5), (2, "one", 5), (3, "x", 1), (3, "x", 1)], [(1, "one", 5), (3, "x", 1), (4, "last", 2)]]

    def report(df):
        return sorted(tuple(r.ids) for r in df.collect())

    def states():
        return report(ingest.arrived_duplicates(spark, at[1], "bank"))

    for n, rows in enumerate(files):
        (tmp_path / f"in/{n}.csv").write_text(HEAD + "".join(line.format(d=d, n=name, a=a) for d, name, a in rows))
        ingest.ingest_stream(spark, at[0], "bank", at[1], at[2]).awaitTermination()
        for _ in range(2 if n == 1 else 1):  # a start with nothing new changes nothing
            ingest.duplicate_stream(spark, at[1], "bank", at[3]).awaitTermination()
        table = spark.read.parquet(f"{at[1]}/bank").withColumn("narration_key", whole.narration_key(F.col("narration")))
        if n:
            assert states() == report(whole.duplicates(table, "bank", *ingest.KEYS["bank"]))
    assert [len(x) for x in states()] == [3, 3]
