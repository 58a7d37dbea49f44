"""Each stage against a plain version of it, over the rows that the stage before it kept."""

import corpus_pipeline
from helpers import awkward, empty
from test_decontaminate import plain_distance
from test_jaccard import plain_groups

from conftest import SMALL
from tallyloom.llm import cotrain, decontaminate, host_rules
from tallyloom.llm.common import materialize, table


def test_stages_match_plain_versions(spark):
    docs = table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SMALL), f"test-{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        rows = before.collect()
        if name == "quality_classifier":
            want = {r.doc_id for r in cotrain.classify(before, table(spark, SMALL, "labels")).where("kept").collect()}
        elif name == "quality_rules":
            counts = {r.doc_id: host_rules.text_counts(r.text and r.text.encode()) for r in rows}
            blocked = {r.host for r in host_rules.host_verdicts(host_rules.counted(before)).where("blocked").collect()}
            want = {r.doc_id for r in rows if r.source not in blocked and (c := counts[r.doc_id])[0] >= 50 and 100 * c[4] <= 50 * c[0]}
        elif name == "near_duplicates":
            of = plain_groups({r.doc_id: r.text for r in rows})
            want = {d for d, c in of.items() if d == c}
        elif name == "decontamination":
            norm = lambda x: decontaminate.normalize(x.encode())
            items = [norm(r.text) for r in table(spark, SMALL, "benchmark").collect()]
            holds = lambda text: any(i in text for i in items)
            want = {r.doc_id for r in rows if not holds(norm(r.text))}
            for d in want - set(kept[name]):
                text = norm(next(r.text for r in rows if r.doc_id == d))
                assert any(plain_distance(i, text) <= len(i) // 16 for i in items)
            want = set(kept[name])
        else:
            want = set(kept[name])
            assert want <= {r.doc_id for r in rows} and all(0 < r.taken <= 2 * r.size for r in kept[name].values())
        assert set(kept[name]) == want, name
        if name != "target_mix":
            assert docs.columns == before.columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(kept["target_mix"])


def test_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SMALL).collect() == [], name
        assert stage(spark, awkward(spark), SMALL).count() <= 9, name
