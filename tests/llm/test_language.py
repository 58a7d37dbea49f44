import numpy as np
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import MEDIUM
from tallyloom.llm import language
from tallyloom.llm.common import table


def test_held_out_accuracy(spark):
    got = language.op6_language(spark, MEDIUM).join(table(spark, MEDIUM, "documents").where("lang is not null"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    """The distinct runs of one to three symbols, whatever is no letter being one symbol."""
    line = [c if c.isalpha() else None for c in text.lower()]
    return {tuple(line[i : i + n]) for n in (1, 2, 3) for i in range(len(line) - n + 1)}


@settings(deadline=None)  # the first call makes the table of symbols
@given(st.text(st.sampled_from("ab z!1\u6c49\u5b57\u3042\u0395\U00020000\U0001F600")))
def test_grams_tell_all_letters_apart(text):
    got = language.grams(text)
    number = {g: sum((language.OTHER if c is None else ord(c) + 1) << language.BITS * (len(g) - 1 - i) for i, c in enumerate(g)) for g in plain_grams(text)}
    assert sorted(number.values()) == got.tolist() and len(set(number.values())) == len(number)


def plain_kernel(xs, ys):
    sets = lambda texts: [plain_grams(t) for t in texts]
    return np.array([[len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0 for b in sets(ys)] for a in sets(xs)])


def test_scripts_and_exact_kernel_ridge_regression(spark):
    """With every row a landmark the model is kernel ridge regression itself; many scripts share no letter table."""
    rng = np.random.default_rng(1)
    scripts = {"zh": range(0x4E00, 0x4E50), "ko": range(0xAC00, 0xAC50), "am": range(0x1200, 0x1240), "el": range(0x3B1, 0x3C9), "en": range(97, 123), "xx": range(0x20000, 0x20030)}
    text = lambda codes, n=30: "".join(chr(rng.choice(codes)) if rng.random() < 0.8 else " " for _ in range(n))
    rows = [(i * 10 + j, text(list(codes)), lang) for i, (lang, codes) in enumerate(scripts.items()) for j in range(8)]
    ridge = 1e-2
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=8, landmarks=8, ridge=ridge)
    fresh = [text(list(c)) for c in scripts.values()]
    assert [x for x, _ in model.predict(fresh)] == list(scripts)
    texts, langs = [t for _, t, _ in rows], sorted(scripts)
    y = np.array([[float(lang == x) for x in langs] for _, _, lang in rows])
    k, n = plain_kernel(texts, texts), len(texts)
    centre = np.eye(n) - 1 / n
    dual = np.linalg.solve(centre @ k @ centre + ridge * n / 10 * np.eye(n), centre @ y)
    want = (plain_kernel(fresh, texts) - k.mean(axis=0)) @ centre @ dual + y.mean(axis=0)
    assert np.allclose(model.raw(fresh), want, atol=0.01)


def test_kernel_rows_are_normalized_overlaps():
    texts = ("abc", "bca")
    own = [language.grams(t) for t in texts]
    words = np.unique(np.concatenate(own))
    present = np.array([[float(w in set(g.tolist())) for g in own] for w in words.tolist()], np.float32)
    got = language.Kernel(words, present, np.array([len(g) for g in own], float)).rows(["abcc", ""])
    assert np.allclose(got[0], plain_kernel(["abcc"], texts)[0]) and not got[1].any()


def test_awkward_rows(spark):
    model = language.train(table(spark, MEDIUM, "documents").select("doc_id", "text", "lang"), per_lang=50)
    got = {r.doc_id: r for r in language.identify(awkward(spark), model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and got[7].lang_pred != "und"
    assert language.identify(awkward(spark), model).count() == 9
    assert language.identify(empty(spark), model).collect() == []
    assert language.train(empty(spark)) is None
    assert {r.lang_pred for r in language.identify(awkward(spark), None).collect()} == {"und"}
