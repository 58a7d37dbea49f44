import re
from collections import Counter

from helpers import LONG, awkward, collected, empty
from hypothesis import given
from hypothesis import strategies as st

from tallyloom.llm import host_rules


@given(st.text(alphabet="ab# \n\té|", max_size=60))
def test_counts_are_the_contract(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
    lines, seen, dups = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in seen
            seen.add(x)
    want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered))
    assert host_rules.text_counts(text.encode()) == (want if words else (0, 0, 0, 0, 0))


def test_bad_host_is_blocked_and_small_one_shrunk(spark):
    rows = [(i, "bad words only", "bad") for i in range(60)] + [(100 + i, LONG, f"good{i % 5}") for i in range(300)] + [(900, "bad words only", "tiny"), (901, LONG, "bad")]
    got = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[901].host_blocked and not got[901].kept and not got[901].base_failed
    assert not got[100].host_blocked and got[100].kept


def test_awkward_rows(spark):
    got = host_rules.judge(awkward(spark))
    assert got.count() == 9
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed
    assert by[6].n_words == 60_000 and by[6].n_repeat_words == 60_000
    assert host_rules.judge(empty(spark)).collect() == []
    kept = host_rules.keep_good(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert collected(kept, "doc_id") == collected(got.where("kept"), "doc_id")
    assert host_rules.keep_good(empty(spark)).collect() == []
