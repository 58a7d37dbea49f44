"""Scalar functions on fixed examples and random values."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import canonical, money, refs

PARSED = {"1000.00": 100000, "1000.5": 100050, "0.29": 29, "1234567.35": 123456735, "1,00,000.00": 10000000, "100,000.00": 10000000, "Rs. 1000.00": 100000, "INR 1000.00": 100000, "₹5": 500, "-500.00": -50000, "(500.00)": -50000, "(-5)": 500, "1.": 100, ".5": 50, " \t7\xa0": 700, "+3": 300, "Rs.-2.50": -250, "90071992547409.91": 2**53 - 1}
REFUSED = ["", "   ", "-", "N/A", "abc", "10.00.00", "1000.555", "1,00,000.0000", "null", "8.165", ".", "(5", "-₹5", "()", "90071992547409.92", "1" * 40, None, "1,0O0.00", "INR ??", "#REF!"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_parse(spark):
    rows = list(PARSED.items()) + [(x, None) for x in REFUSED]
    got = spark.createDataFrame(rows, "raw string, want long").withColumn("got", money.parse_paise(F.col("raw"))).where("not got <=> want").collect()
    assert got == []


def test_parse_reads_back_what_is_written(spark):
    p = spark.range(-5000, 5000).select((F.col("id") * 997).alias("p"))
    assert p.where(~money.parse_paise(money.rupee_string(F.col("p"))).eqNullSafe(F.col("p"))).count() == 0
    assert p.where(~money.parse_paise(money.format_paise(F.col("p"))).eqNullSafe(F.col("p"))).count() == 0


@pytest.mark.parametrize(("paise", "text"), [(10000000, "1,00,000.00"), (4732000, "47,320.00"), (1000000000, "1,00,00,000.00"), (5, "0.05"), (99999, "999.99")])
def test_format(spark, paise, text):
    assert one(spark, money.format_paise(F.lit(paise))) == text


def test_signs_and_rates(spark):
    assert one(spark, money.format_inr(F.lit(-100000))) == "-₹1,000.00"
    assert one(spark, money.format_variance(F.lit(-500))) == "−₹5.00"
    assert one(spark, money.rate_bps(F.lit(100000), 200)) == 2000 and one(spark, money.rate_bps(F.lit(100000), 20)) == 200


@pytest.mark.parametrize(("a", "b", "want"), [("INV20260447", "INV20260474", True), ("INV202604471", "INV202604472", False), ("INV202604471", "INV202604481", False), ("ABC", "ACB", False)])
def test_transposition(spark, a, b, want):
    assert one(spark, refs.is_transposition(F.lit(a), F.lit(b))) is want


def test_references(spark):
    text = "NEFT/inv-2026-04001/pay_abcdefghij1234/pay_abcdefghij1234/UTR123456789"
    got = one(spark, refs.extract_references(F.lit(text)))
    assert got[0] == "inv-2026-04001" and "pay_abcdefghij1234" in got and len(got) == len(set(got))
    assert one(spark, refs.normalize_ref(F.lit("inv-2026/04001"))) == "INV202604001"


def test_similarity(spark):
    sim = lambda a, b: one(spark, refs.reference_similarity(F.lit(a), F.lit(b)))
    assert sim("ABC123", "abc-123") == 1 and sim("", "X") == 0 and sim("XXABC123", "ABC123") == 0.85 and sim("ABCDEFG", "ABCDEFH") == pytest.approx(0.65)
    assert one(spark, refs.name_similarity(F.lit("Acme Traders Pvt Ltd"), F.lit("ACME TRADERS"))) == 1


def test_hashes_ignore_key_order():
    assert canonical.hash_object({"a": 1, "b": [1, 2]}) == canonical.hash_object({"b": [1.0, 2], "a": 1})
    assert canonical.hash_object([1, 2]) != canonical.hash_object([2, 1]) and canonical.hash_object(-0.0) == canonical.hash_object(0)
    assert canonical.canonical_json({"x": float("nan")}) == '{"x":null}'


def test_prompt_hash_on_columns(spark):
    want = canonical.prompt_hash_value('say "x"\n', "é", "m", 0)
    assert one(spark, canonical.prompt_hash(F.lit('say "x"\n'), F.lit("é"), "m")) == want


@pytest.mark.parametrize(("text", "want"), [('x {"a": "}"} y', '{"a": "}"}'), ("{ {} ", None), ("none", None), (None, None), (r'{"a": "\"}"}', r'{"a": "\"}"}')])
def test_first_object(text, want):
    assert canonical.first_object(text) == want
