import hashlib
from collections import Counter

import numpy as np
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import MEDIUM, SMALL
from tallyloom.llm import weighted_sampling as ws


def weighted(rng, n, terms):
    own = np.sort(rng.choice(terms, n, replace=False))
    return own, rng.integers(1, 9, n) * rng.choice([1.0, 0.25, 3.7], n)


def jaccard(a, b):
    """Of two (terms, weights): the sum of the smaller weights over the sum of the larger ones."""
    a, b = (dict(zip(map(int, t), map(float, w), strict=True)) for t, w in (a, b))
    low = sum(min(w, b.get(t, 0)) for t, w in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low)


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(1)
    terms = rng.integers(0, 2**64, 400, dtype=np.uint64)
    errors = []
    for n in (3, 20, 100, 300):
        for _ in range(25):
            a, b = weighted(rng, n, terms), weighted(rng, n, terms)
            b = b if rng.random() < 0.3 else (a[0], a[1] * rng.choice([1, 1, 0.4, 2.5], n))
            want = jaccard(a, b)
            got = ws.likeness(ws.sample(*a, samples=1024), ws.sample(*b, samples=1024))
            errors.append((got - want) / max(0.005, np.sqrt(want * (1 - want) / 1024)))
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.4 and np.sqrt((errors**2).mean()) < 1.4 and abs(errors).max() < 5


def test_gamma_draws():
    r, b, log_c = ws.draws(64, 5)
    for x in (r, np.exp(log_c.astype(float))):
        assert abs(x.mean() - 2) < 0.01 and abs(x.var() - 2) < 0.05
    assert 0 <= b.min() and b.max() <= 1 and abs(b.mean() - 0.5) < 0.005


@settings(deadline=None)
@given(st.text(max_size=50), st.integers(1, 9))
def test_words_are_told_as_bytes_split(text, piece):
    raw = text.encode()
    words = raw.lower().split()
    kept, ws.PIECE = ws.PIECE, piece
    try:
        got, ends = ws.word_hashes(raw)
    finally:
        ws.PIECE = kept
    assert [len(raw[:e].split()) for e in ends] == list(range(1, len(words) + 1))
    assert len(got) == len(words) and len({*zip(words, got.tolist(), strict=True)}) == len({*words}) == len({*got.tolist()})


@settings(deadline=None)
@given(st.text(alphabet="ab AB\n\té", max_size=60))
def test_terms_are_words_with_four_before(text):
    words = text.encode().lower().split()
    runs = [tuple(words[max(0, i - 4) : i + 1]) for i in range(len(words))]
    _, weights = ws.weighted_terms(text.encode())
    assert sorted(weights) == sorted(Counter(runs).values())


@settings(deadline=None)
@given(st.text(alphabet="ab \né😀", max_size=40), st.text(alphabet="ab \né😀", max_size=40))
def test_edited_text_is_told_as_a_whole(text, following):
    own, facts = ws.Page(text.encode()).beside(ws.Page(following.encode()))
    m = len(text) // 3
    after = (text[: len(text) - m] + following[:m]).encode()
    assert facts[:2] == (len(text), hashlib.sha256(after).digest())
    assert own.tolist() == ws.fingerprint(text.encode()).tolist() and facts[3] == ws._packed(ws.fingerprint(after))


def plain(rows):
    """The contract, over the documents in one list."""
    rows = sorted(rows, key=lambda r: -r[0])
    texts = [r[1] or "" for r in rows]
    out = {}
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(rows)]
        m = len(text) // 3
        new = text[: len(text) - m] + after[:m]
        prints = [ws.fingerprint(x.encode()) for x in (text, new, after)]
        near = [float(np.mean(prints[0] == p)) for p in prints[1:]]
        out[doc_id] = (len(text), hashlib.sha256(new.encode()).hexdigest(), *("".join(f"{v:04x}" for v in p) for p in prints[:2]), *near)
    return out


def test_whole_table_against_the_plain_form(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    got = ws.op11_weighted_sampling(spark, MEDIUM).collect()
    want = plain([tuple(r) for r in docs])
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(docs)
    near, next_ = (np.array([w[i] for w in want.values()]) for i in (4, 5))
    assert 0.4 < near.mean() < 0.6 and next_.mean() < 0.1 and (near > next_).mean() > 0.98


def test_estimates_follow_exact_similarity(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in ws.op11_weighted_sampling(spark, SMALL).collect()}
    errors = []
    for a, b in zip(ids, ids[1:], strict=False):
        m = len(rows[a]) // 3
        want = jaccard(ws.weighted_terms(rows[a].encode()), ws.weighted_terms((rows[a][: len(rows[a]) - m] + rows[b][:m]).encode()))
        errors.append(got[a].near_edited - want)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.055


def test_awkward_rows(spark):
    rows = ws.beside_next(awkward(spark).repartition(5)).collect()
    assert len(rows) == 9 and sorted(r.n_chars for r in rows)[:2] == [0, 0]
    by = {r.doc_id: r for r in rows}
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == bytes(256) and by[3].near_edited == 1
    assert by[1].fingerprint == by[2].fingerprint and by[None].n_chars == 7 and by[6].n_chars == 330_000
    assert by[None].edited_sha256 == hashlib.sha256(b"one t" + "é😀".encode()).digest()  # after the last comes the first
    assert ws.beside_next(empty(spark)).collect() == [] and ws.fingerprints(empty(spark)).collect() == []
    one = ws.beside_next(spark.createDataFrame([("a", "x y z")], "doc_id string, text string")).collect()
    assert (one[0].near_next, one[0].n_chars) == (1.0, 5)
    own = {r.doc_id: bytes(r.fingerprint) for r in ws.fingerprints(awkward(spark)).collect()}
    assert all(own[k] == by[k].fingerprint for k in by)
