from helpers import LONG, awkward, empty
from hypothesis import given
from hypothesis import strategies as st

from conftest import SMALL
from tallyloom.llm import decontaminate as d
from tallyloom.llm.common import table


def plain_distance(item, text):
    """Least edits from item to any stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
    return min(row)


@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", max_size=60))
def test_myers_is_the_edit_distance(item, text):
    assert d.Pattern(item).distance(text) == plain_distance(item, text)


@given(st.text("ab", min_size=4, max_size=24), st.text("ab", max_size=60))
def test_no_occurrence_is_missed(item, text):
    k = len(item) // 8
    got = d.Matcher([(0, item)], 8).find(text)
    least = plain_distance(item, text)
    assert got == ([(0, least)] if text and least <= k else [])


def test_documents_match_brute_force(spark):
    docs, items = table(spark, SMALL, "documents").collect(), table(spark, SMALL, "benchmark").limit(6).collect()
    few = [r for r in docs if r.text and len(r.text) < 1500][:60]
    norm = lambda x: d.normalize(x and x.encode())
    want = {(a.doc_id, b.item_id, n) for a in few for b in items if (n := plain_distance(norm(b.text), norm(a.text))) <= len(norm(b.text)) // 16}
    got = d.contaminated(table(spark, SMALL, "documents").where(f"doc_id in ({','.join(str(r.doc_id) for r in few)})"), table(spark, SMALL, "benchmark").where(f"item_id in ({','.join(str(r.item_id) for r in items)})"))
    assert {tuple(r) for r in got.collect()} == want


def test_planted_and_clean(spark):
    item = "Which of the following rivers flows through Ångström valley and ends in the sea?"
    worn = item.replace("following", "folowing").upper() + " trailing"
    docs = spark.createDataFrame([(1, f"{LONG} {item}"), (2, f"x {worn} y"), (3, LONG), (4, item[:40])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item, "extra")], "item_id long, text string, lang string")
    got = {(r.doc_id, r.n_edits) for r in d.contaminated(docs, bench, block_chars=10).collect()}
    assert got == {(1, 0), (2, 1)}
    assert {r.doc_id for r in d.drop_contaminated(docs, bench).collect()} == {3, 4}


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (None, LONG), (4, "short text")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(awkward(spark), bench).collect()}
    assert got == {(1, None), (2, None), (6, 4)}
    kept = d.drop_contaminated(awkward(spark), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, None, 7} and kept.columns == awkward(spark).columns
    assert d.contaminated(empty(spark), bench).collect() == [] and d.contaminated(awkward(spark), bench.limit(0)).collect() == []
