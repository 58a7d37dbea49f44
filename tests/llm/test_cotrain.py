import numpy as np
from helpers import CLASHING, awkward, empty

from conftest import MEDIUM
from tallyloom.llm import cotrain
from tallyloom.llm.common import table


def test_held_out_accuracy(spark):
    got = cotrain.op3_cotrain(spark, MEDIUM).join(table(spark, MEDIUM, "labels"), "doc_id").where("held_out").collect()
    right = sum(r.kept == bool(r.quality) for r in got)
    assert len(got) > 50 and right / len(got) > 0.9


def test_reruns_agree_and_stage_agrees_with_scores(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    a = {r.doc_id: r.kept for r in cotrain.classify(docs, labels).collect()}
    b = {r.doc_id for r in cotrain.keep_good(docs, labels).collect()}
    assert {d for d, k in a.items() if k} == b


def test_without_both_classes_all_stay(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in cotrain.classify(awkward(spark), labels).collect()} == {0.5}
    assert cotrain.keep_good(awkward(spark), labels).count() == 9


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(200)], "doc_id long, quality int")
    taught = spark.createDataFrame([(1000 + i, "good words here and there" if i % 2 else "#### $$$$ %%%%", "en", "a", 20, 1, "", *range(len(CLASHING))) for i in range(200)], awkward(spark).schema)
    got = cotrain.classify(awkward(spark).unionByName(taught), labels).collect()
    assert len(got) == 209 and all(0 <= r.score <= 1 for r in got)
    assert cotrain.classify(empty(spark), labels).collect() == []
    assert cotrain.keep_good(empty(spark), labels).collect() == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD, MORE, BAD, WORSE = "river stone cloud", "candle window garden", "zap pow bam", "click buy now"


def _two_views(spark):
    """Labels know half of the words; what they do not know shares its source with what they do."""
    rows, y = [], {}
    for i in range(1200):
        good, known = i % 2, i % 4 < 2
        words = ((GOOD if known else MORE) if good else (BAD if known else WORSE)).split()
        text = " ".join(words[(i * k) % 3] for k in range(1, 40))
        source = ("paper" if good else "mill") if i < 1000 else "new"  # the last ones have nothing but their words
        rows.append((i, text, "en", source, len(text)))
        y[i] = good
    labels = [(i, g) for i, g in y.items() if i % 4 < 2 and i < 400]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"), y


def test_rounds_teach_what_labels_alone_do_not(spark):
    docs, labels, y = _two_views(spark)
    right = {}
    for rounds in (0, 3):
        got = cotrain.classify(docs, labels, rounds=rounds).where("doc_id >= 1000").collect()
        right[rounds] = sum(r.kept == bool(y[r.doc_id]) for r in got) / len(got)
    assert right[3] == 1.0 and right[0] < 0.95


def test_model_is_that_of_plain_co_training(spark):
    """All sure documents are exchanged, so that nothing hangs on a hash; the rounds by plain arrays."""
    docs, labels, _ = _two_views(spark)
    feats = {r.doc_id: (np.frombuffer(r.t, np.uint8), np.frombuffer(r.m, np.uint8)) for r in cotrain.features(docs).collect()}
    known = {r.doc_id: r.quality for r in cotrain.training_labels(labels).collect()}
    places = {r.doc_id: r.place for r in docs.selectExpr("doc_id", "pmod(xxhash64(3, doc_id), 4) as place").collect()}
    ids = sorted(known)
    held = np.array([places[i] == 0 for i in ids])
    y = np.array([float(known[i]) for i in ids])
    x = [np.array([feats[i][v] for i in ids]) for v in (0, 1)]
    pool = [np.array([feats[i][v] for i in sorted(feats) if i not in known]) for v in (0, 1)]
    extra = [(np.zeros((0, v.shape[1]), np.uint8), np.zeros(0)) for v in x]
    for r in range(3):
        views = []
        for v in (0, 1):
            rows = np.vstack([x[v][~held], extra[v][0]])
            weight = np.concatenate([np.ones((~held).sum()), np.full(len(extra[v][1]), 0.5)])
            views.append(cotrain.fit_linear(rows, np.concatenate([y[~held], extra[v][1]]), weight))
            a, b = cotrain._newton(views[v].raw(x[v][held])[:, None], y[held], 1e-2)
            views[v].slope, views[v].shift = max(0.0, a), b
        if r < 2:
            z = [views[v].logit(pool[v]) for v in (0, 1)]
            extra = [(np.vstack([pool[v][z[1 - v] > 2.2], pool[v][z[1 - v] < -2.2]]), np.concatenate([np.ones((z[1 - v] > 2.2).sum()), np.zeros((z[1 - v] < -2.2).sum())])) for v in (0, 1)]
    a, b, c = cotrain._newton(np.column_stack([views[v].logit(x[v][held]) for v in (0, 1)]), y[held], 1e-1)
    order = sorted(feats)
    t, m = (np.array([feats[i][v] for i in order]) for v in (0, 1))
    want = 1 / (1 + np.exp(-np.clip(max(0, a) * views[0].logit(t) + max(0, b) * views[1].logit(m) + c, -30, 30)))
    got = {r.doc_id: r.score for r in cotrain.classify(docs, labels, rounds=2, per_round=10_000).collect()}
    assert np.allclose([got[i] for i in order], want, atol=1e-6)


def test_fit_is_where_the_gradient_vanishes():
    rng = np.random.default_rng(0)
    x, y, weight = rng.integers(0, 256, (200, 5), dtype=np.uint8), rng.integers(0, 2, 200).astype(float), rng.random(200)
    f = cotrain.fit_linear(x, y, weight, ridge=2.0)
    p = 1 / (1 + np.exp(-f.raw(x)))
    assert np.allclose((x / 255).T @ (weight * (p - y)) + 2.0 * f.weight, 0, atol=1e-4)
