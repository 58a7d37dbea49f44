from itertools import product

import numpy as np
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import MEDIUM
from tallyloom.llm import toxicity as t
from tallyloom.llm.common import table


@settings(deadline=None)
@given(st.lists(st.sampled_from([(), (0,), (1,), (0, 1)]), min_size=1, max_size=9))
def test_marginals_sum_over_all_paths(found):
    chain = t.Chain(["=x", "=y"], np.array([2.0, 1.5]), 0.4, -0.3, -1.0, np.array([[0.3, -0.2], [-0.4, 0.6]]))
    n = len(found)
    score = [sum(chain.weight[f] for f in fs) + chain.bias + (chain.before if i and found[i - 1] else 0) + (chain.after if i + 1 < n and found[i + 1] else 0) for i, fs in enumerate(found)]
    whole, on = 0.0, np.zeros(n)
    for path in product((0, 1), repeat=n):
        w = np.exp(sum(score[i] for i in range(n) if path[i]) + sum(chain.move[a, b] for a, b in zip(path, path[1:], strict=False)))
        whole += w
        on += w * np.array(path)
    hits = [(i, f) for i, f in enumerate(found) if f]
    got = chain.marginals(hits, n, chain.powers()) if hits else []
    assert np.allclose([p for _, p in got], [on[i] / whole for i, _ in hits])


def test_held_out_and_spans(spark):
    rows = t.op10_toxicity(spark, MEDIUM).join(table(spark, MEDIUM, "labels"), "doc_id").join(table(spark, MEDIUM, "documents").select("doc_id", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.score for r in held if r.toxic) / max(1, len(held) - len(clean)) > 2 * sum(r.score for r in clean) / len(clean)
    for r in rows:
        assert r.predicted == int(r.score >= 0.7) and all(r.text[s.begin : s.end].strip() for s in r.spans)


def _taught(spark):
    words = "river stone cloud bread candle window garden".split()

    def text(i):
        own = [words[(i * k) % 7] for k in range(1, 15)]
        if i % 4 == 0:
            own[i // 4 % 14] = "vilex"
        return " ".join(own)

    docs = spark.createDataFrame([(i, text(i)) for i in range(800)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_planted_word_is_caught_and_located(spark):
    chain = t.train(*_taught(spark))
    text = "a clean garden then Vilex, again"
    got = {r.doc_id: r for r in t.tag(spark.createDataFrame([(1, text), (2, "a clean garden")], "doc_id long, text string"), chain).collect()}
    assert [text[s.begin : s.end] for s in got[1].spans] == ["Vilex"]
    assert got[1].score > got[2].score and got[2].predicted == 0


def test_awkward_rows(spark):
    chain = t.train(*_taught(spark))
    got = t.tag(awkward(spark), chain).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.spans == [] for r in got)
    assert t.tag(empty(spark), chain).collect() == []
    assert t.train(awkward(spark), spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in t.tag(awkward(spark), None).collect()} == {0.0}
