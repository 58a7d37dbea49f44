import random

import numpy as np
import pytest
import xxhash
from helpers import awkward, collected, empty
from hypothesis import given
from hypothesis import strategies as st

from tallyloom.llm import simhash
from tallyloom.llm.common import table

from conftest import SMALL


def plain_fingerprint(text, k=4):
    """The contract word by word, one bit at a time."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, d=4):
    """{row: smallest linked row} by comparing all pairs."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= d:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@given(st.text(alphabet="aAbB \t\n\x0b\x1c\x85\xa0éÉ", max_size=80))
def test_fingerprint_is_the_contract(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_documents_match_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    components = plain_components(want)
    got = simhash.op1_simhash(spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{want[r.doc_id]:016x}", components[r.doc_id])


@pytest.mark.parametrize("bucket_limit", [4096, 3])
def test_links_match_brute_force(spark, bucket_limit):
    """Chains of near fingerprints at distances 1 to 5, by buckets and by balls."""
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 4)):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.fingerprint_links(df, bucket_limit=bucket_limit)
    labels = {r.node & (2**64 - 1): r.component for r in simhash.connected_components(links).collect()}
    want = plain_components(dict(enumerate(fps)))
    same = lambda f: {frozenset(i for i in range(len(fps)) if f(i) == f(j)) for j in range(len(fps))}
    assert same(lambda i: labels.get(fps[i], fps[i])) == same(want.get)


def test_frequent_fingerprints_take_the_broadcast(spark):
    docs = spark.createDataFrame([(i, "same words in every one of these" if i % 3 else f"text number {i} of many others {i * i}") for i in range(600)], "doc_id long, text string")
    a = collected(simhash.near_duplicates(docs, most_hot=4), "doc_id", "component_id")
    assert a == collected(simhash.near_duplicates(docs, most_hot=10**9), "doc_id", "component_id")
    assert {c for i, c in a if i % 3} == {1}


def test_pivot_distances_bound_the_distance():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**64, 50, dtype=np.uint64)
    coords = simhash.distance_table(fps, simhash.pivots(16))
    gap = np.abs(coords[:, :, None].astype(int) - coords[:, None, :]).max(axis=0)
    assert (gap <= np.bitwise_count(fps[:, None] ^ fps[None, :])).all()


def test_awkward_rows(spark):
    got = collected(simhash.near_duplicates(awkward(spark)), "doc_id", "fingerprint", "component_id")
    assert len(got) == 9
    by = {r[0]: r for r in got}
    assert by[3][1:] == by[4][1:] == by[5][1:] == ("0" * 16, 3)
    assert by[2][2] == 1
    assert simhash.near_duplicates(empty(spark)).collect() == []
    kept = simhash.keep_first(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, None, 6, 7}
