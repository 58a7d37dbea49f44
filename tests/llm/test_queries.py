"""Queries with SQL against DuckDB; all queries on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from conftest import MEDIUM, SMALL
from tallyloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert oracle.compare(queries.queries()[name](spark, MEDIUM), oracle.connect(MEDIUM), queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows_of_the_whole_table(spark, name):
    rows = queries.queries()[name](spark, SMALL).count()
    if name != "op7_decontaminate":
        of = {"op4_html": "pages", "op8_url_filter": "pages", "op9_warc": "pages", "op12_conversation_repair": "conversations", "op13_whitening": "embeddings"}.get(name, "documents")
        df = spark.read.parquet(f"{SMALL}/{of}.parquet")
        want = {"op12_conversation_repair": df.select(df.columns[0]).distinct().count(), "op13_whitening": 4 * df.count()}
        assert rows == want.get(name, df.count())


def test_all_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
