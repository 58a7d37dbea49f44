from tallyloom.llm import url_filter as u

PAGES = "page_id bigint, url string, html string, host string, verdict string"


def _judged(spark, rows, redirects=None):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    moved = spark.createDataFrame(redirects, "from_url string, to_url string") if redirects else None
    return {r.page_id: r for r in u.judge(pages, moved).collect()}


def test_rules_hosts_and_paths(spark):
    got = _judged(spark, [(1, "http://A.Example.NET/en/x?q", None), (2, "http://example.net/fr/", None), (3, "http://notexample.com/de/", None), (4, "http://x.example.com/de/a#b", None), (5, "ftp://w.org/fr/", None), (6, "http://net", None)])
    assert [(got[i].host, got[i].rule, got[i].verdict) for i in range(1, 7)] == [
        ("a.example.net", "example.net/en/", "allow"), ("example.net", "net/", "block"), ("notexample.com", None, "allow"), ("x.example.com", "example.com/de/", "block"), ("w.org", "org/fr/", "allow"), ("net", None, "allow"),
    ]


def test_aliases_carry_decisions(spark):
    link = '<link rel="canonical" href="http://bad.net/x">'
    rows = [(1, "http://plain.com/a", link), (2, "http://other.com/b", '<meta http-equiv="refresh" content="0; url=http://plain.com/a">'), (3, "http://c.org/fr/", link), (4, "http://alone.com/", None)]
    got = _judged(spark, rows[:2])
    assert got[1].verdict == got[2].verdict == "block" and got[1].rule is None
    got = _judged(spark, rows)
    assert {got[i].verdict for i in (1, 2, 3, 4)} == {"allow"}, "an allowed alias goes before a blocked one"
    got = _judged(spark, rows[3:], [("http://alone.com/", "http://bad.net/y"), (None, "http://x.com/"), ("nowhere", "http://x.com/")])
    assert got[4].verdict == "block"


def test_awkward_rows(spark):
    got = _judged(spark, [(1, None, None), (2, "", ""), (3, "no scheme", "<link rel=canonical>"), (None, "http://a.net/", "x" * 500_000)])
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert got[None].verdict == "block"
    assert u.judge(spark.createDataFrame([], PAGES)).collect() == []


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", None, "", "")], PAGES)
    plan = u.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
