import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import ingest, store

GROUPS = "match_id string, status string, exception_type string, confidence double, amount_paise long, variance_paise long"


def test_runs_are_replaced_and_paged(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.runs().collect() == []
    df = spark.createDataFrame([(f"MCH-{i:06}", "needs_review", None, 0.5, i, -i) for i in range(25)], GROUPS)
    s.save("R1", {"matches": df}, {"mode": "rules_only"})
    s.save("R2", {"matches": df.limit(3)}, {})
    s.save("R1", {"matches": df}, {"mode": "rules_only"})
    assert [r.run_id for r in s.runs().collect()] == ["R1", "R2"]
    rows, cursor = s.matches("R1", "amount", 0, 10)
    assert [r.amount_paise for r in rows.collect()] == list(range(24, 14, -1)) and cursor == 10
    assert s.matches("R1", "amount", 20, 10)[1] is None
    assert s.verify("R1", df) and not s.verify("R2", df)
    with pytest.raises(store.UnknownRun):
        s.table("matches", "R3")


def test_decisions_are_appended(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.save("R1", {"matches": spark.createDataFrame([("M1", "needs_review", None, 0.5, 1, 1)], GROUPS)}, {})
    s.decide("R1", "M1", "approve", note="fine")
    s.decide("R1", "M1", "reassign", "CND-1")
    assert {r.action for r in s.decisions("R1").collect()} == {"approve", "reassign"}
    from tallyloom.operators import views

    last = views.decided(s.table("matches", "R1"), s.decisions("R1")).first()
    assert (last.action, last.candidate_id) == ("reassign", "CND-1")
    for bad in (("R1", "M1", "reassign"), ("R1", "M1", "delete")):
        with pytest.raises(ValueError):
            s.decide(*bad)


def test_csv_round_trip_and_quarantine(spark, tmp_path):
    head = "invoice_no,customer_id,customer_name, issue_date ,due_date,gross_amount,tax_amount,currency,status,reference"
    rows = ['INV-2026-00001,C1,"A, ""B""\nC",2026-01-02,2026-01-09,"1,000.00",10.00,INR,open, ', "INV-2026-00002,C1,X,2026-01-02,2026-01-09,N/A,1,INR,open,R", "INV-2026-00003,C1,X,2026-01-02,2026-01-09,5.00,#REF!,INR,open,R"]
    (tmp_path / "ledger.csv").write_text("\n".join([head, *rows, ""]))
    typed = ingest.ledger(ingest.read_csv(spark, f"file://{tmp_path}/ledger.csv"))
    got = sorted(typed.rows.select("record_id", "invoice_no", "customer_name", "gross_paise", "tax_paise", "expected_reference").collect())
    assert [tuple(r) for r in got] == [("LED-000001", "INV-2026-00001", 'A, "B"\nC', 100000, 1000, None), ("LED-000002", "INV-2026-00003", "X", 500, 0, "R")]
    assert {(r.row_number, r.field) for r in typed.warnings.collect()} == {(3, "gross_amount"), (4, "tax_amount")}
    ingest.write_csv(spark.createDataFrame([('a "q", b\nc', "x")], "m string, n string"), f"file://{tmp_path}/out")
    assert ingest.read_csv(spark, f"file://{tmp_path}/out").first().m == 'a "q", b\nc'


def test_truth(spark, tmp_path):
    entry = {"truth_id": "T1", "ledger_ids": ["L1"], "gateway_ids": [], "bank_ids": ["B1"], "exception_type": None, "scenario": "clean", "is_resolvable": True, "amount_paise": 5}
    (tmp_path / "t.json").write_text(json.dumps({"dataset": "d", "seed": 1, "entries": [entry, entry]}, indent=1))
    assert ingest.read_truth(spark, f"file://{tmp_path}/t.json").count() == 2


def test_counterpart_is_read_from_the_index(spark, tmp_path):
    from tallyloom.operators import views

    s = store.Store(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("M1", "needs_review", None, 0.5, 1, 1)], GROUPS)
    for i, (dataset, mode, seed) in enumerate([("standard", "rules_only", 42), ("hard", "hybrid", 42), ("hard", "rules_only", 7), ("hard", "rules_only", 42)]):
        s.save(f"R{i}", {"matches": df}, {"dataset": dataset, "mode": mode, "seed": seed})
    assert [r.run_id for r in views.counterpart(s.runs(), "R0").collect()] == ["R3"]


def test_a_reader_sees_one_whole_version(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s")
    old, new = (spark.createDataFrame([("M1", "needs_review", None, 0.5, x, x)], GROUPS) for x in (1, 2))
    s.save("R1", {"matches": old, "calls": old}, {"n": 1})
    seen, publish = [], s._publish
    amounts = lambda: [s.table(t, "R1").first().amount_paise for t in ("matches", "calls")] + [json.loads(s.runs().first().config)["n"]]
    held = s.table("matches", "R1")

    def late(*row):  # all tables are written, the log has no row yet
        seen.append(amounts())
        publish(*row)

    monkeypatch.setattr(s, "_publish", late)
    s.save("R1", {"matches": new, "calls": new}, {"n": 2})
    assert seen == [[1, 1, 1]] and amounts() == [2, 2, 2] and held.first().amount_paise == 1

    def lost(*row):
        raise OSError("the writer dies")

    monkeypatch.setattr(s, "_publish", lost)
    with pytest.raises(OSError):
        s.save("R1", {"matches": old, "calls": old}, {"n": 3})
    assert amounts() == [2, 2, 2]
    assert s.vacuum() == 2 and amounts() == [2, 2, 2] and s.vacuum() == 0


def test_cache_keeps_the_latest_answer_of_a_hash(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    answers = lambda *rows: spark.createDataFrame(list(rows), "prompt_hash string, response string, input_tokens bigint, output_tokens bigint")
    assert s.cache().collect() == []
    s.remember(answers(("h", "first", 1, 1), ("g", "other", 1, 1)), "m")
    s.remember(answers(("h", "second", 2, 2), ("n", None, 0, 0)), "m")
    want = {("h", "second"), ("g", "other")}
    assert {(r.prompt_hash, r.response) for r in s.cache().collect()} == want and s.cache().count() == 2
    live = s._live("cache")
    s.compact()
    assert len(live) == 2 and len(s._live("cache")) == 1 and {(r.prompt_hash, r.response) for r in s.cache().collect()} == want
    s.vacuum()
    assert s.cache().count() == 2


def test_pages_by_cursor_are_those_by_offset(spark, tmp_path):
    from tallyloom.operators import paging, views

    rows = [(f"MCH-{i:06}", "needs_review" if i % 3 else "auto_cleared", None, None if i % 50 == 7 else (i % 10) / 10, None if i % 40 == 3 else i % 7, -(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, GROUPS)
    for sort in ("amount", "confidence", "variance"):
        pages = paging.Sorted(spark, f"file://{tmp_path}/{sort}", sort).write(df, rows_per_part=40)
        for filters in ({}, {"status": "auto_cleared"}):
            want = [r.match_id for r in views.filtered(df, **filters).orderBy(*views._order(sort)).collect()]
            got, cursor, first = [], None, True
            while first or cursor:
                page, cursor = pages.page(cursor, 90, **filters)
                got.append([r.match_id for r in page.collect()])
                first = False
            assert sum(got, []) == want and all(len(x) == 90 for x in got[:-1])
    assert pages.page('{"n0":true,"k0":9,"n1":true,"k1":"z"}')[0].collect() == []
    empty = paging.Sorted(spark, f"file://{tmp_path}/none", "amount").write(df.limit(0))
    assert empty.page()[0].collect() == [] and empty.page()[1] is None


def test_a_page_reads_as_many_files_wherever_it_is(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.save("R1", {"matches": spark.createDataFrame([(f"M{i:06}", "needs_review", None, 0.5, i, i) for i in range(2000)], GROUPS)}, {}, page_by=("amount",))
    pages = s.pages("R1").write(s.table("matches", "R1"), rows_per_part=100)
    cursor, read = None, []
    for n in range(10):
        rows, cursor = pages.page(cursor, 100)
        assert [r.amount_paise for r in rows.collect()] == list(range(1999 - 100 * n, 1899 - 100 * n, -1))
        rows.count()
        read.append(len({r.f for r in rows.select(F.input_file_name().alias("f")).collect()}))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "_part" in plan
    assert max(read) <= 5
