import random

import corpus_pipeline
import numpy as np
import pytest
from helpers import awkward, collected, empty
from pyspark.sql import functions as F

from conftest import SMALL
from tallyloom.llm import jaccard, simhash
from tallyloom.llm.common import table


def plain_groups(texts, k=5, similarity=0.8):
    """{row: smallest linked row} by the Jaccard similarity of all pairs."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= similarity * len(x | y) > 0:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def many():
    """Texts of one to 200 words with chains of edited copies, on both sides of the threshold."""
    rng, texts = random.Random(8), []
    for _ in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 4, 5, 9, 60, 200]))]
        texts.append(words)
        for _ in range(rng.randint(0, 4)):
            words = edited(rng, words, rng.randint(0, max(1, len(words) // 30)))
            texts.append(words)
    rng.shuffle(texts)
    return {i: " ".join(x) for i, x in enumerate(texts)}


def test_stage_finds_the_near_copies_that_four_bits_miss(spark):
    texts = many()
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = plain_groups(texts)
    assert 10 < sum(i != c and texts[i] != texts[c] for i, c in want.items())
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()}
    assert got == {i for i, c in want.items() if i == c}


def test_documents_match_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    want = plain_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def test_any_order_finds_all(spark):
    """What the sample calls frequent changes no result."""
    texts = many()
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    want = sorted(plain_groups(texts).items())
    assert collected(simhash.similar_documents(docs, most_often=1), "doc_id", "component_id") == sorted(want, key=repr)
    assert collected(simhash.similar_documents(docs, sample=10), "doc_id", "component_id") == sorted(want, key=repr)


def family(n, edits, seed=3, words=154):
    """One text with so many words replaced, here and there, in each of n copies, which are a little longer or shorter too."""
    rng, base = random.Random(seed), [f"b{i}" for i in range(words)]
    return {i: " ".join(edited(rng, base[: words - rng.randint(0, 2)], rng.choice(edits))) for i in range(n)}


@pytest.mark.parametrize("crowd", [1, 3, 8])
def test_crowded_sets_match_brute_force(spark, crowd):
    """Copies on both sides of the threshold, some linked by others only, among texts that share a passage."""
    rng, passage = random.Random(crowd), [f"p{i}" for i in range(40)]
    texts = family(90, [0, 1, 2, 3, 3, 4, 5], crowd)
    for i in range(90, 130):
        texts[i] = " ".join(edited(rng, texts[rng.randrange(90)].split(), 1))
    texts |= {i: " ".join(passage + [f"q{rng.randrange(400)}" for _ in range(rng.choice([0, 2, 5, 9, 60]))]) for i in range(130, 170)}
    want = plain_groups(texts)
    assert 20 < len({*want.values()}) < 150
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert dict(collected(simhash.similar_documents(docs, crowd=crowd), "doc_id", "component_id")) == want


@pytest.mark.parametrize("crowd", [8, 10**9])
def test_strangers_of_a_large_family_meet_in_proportion(spark, crowd):
    """Copies too far from their origin, and so from each other, are not held against all others; nor are known copies."""
    rng, met = random.Random(3), {}
    for n in (100, 400):
        texts = family(2 * n, [1, 2], 4)
        for i in range(n):  # five words far from each other: 25 shingles of some 150, where 16 may differ
            words = [f"b{j}" for j in range(154 - rng.randint(0, 2))]
            for j in range(5):
                words[5 + 28 * j + rng.randrange(20)] = f"new{rng.random()}"
            texts[i] = " ".join(words)
        docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
        sets = jaccard.whole_sets(docs, 5).select("id", F.col("hashes").alias("s"))
        ids = {jaccard.set_id(jaccard.shingles(x.text.encode())).to_bytes(8) for x in docs.where(f"doc_id >= {n}").collect()}
        near = spark.createDataFrame([(int.from_bytes(x, signed=True),) for x in ids], "id long").withColumns({"c": F.lit(-1).cast("long"), "g": F.lit(len(ids)).cast("long")})
        sizes = sets.select("id", F.size("s").alias("n"))
        keys = jaccard.in_groups(jaccard.rarest_first(sets, 0.8).join(sizes, "id"), near).withColumn("order", F.lit(1))
        met[n] = jaccard.meetings(keys, 0.8, crowd).count()
    assert met[400] <= 2 * 400, met


def test_prefix_is_long_enough():
    assert [len(jaccard.prefix(np.arange(n, dtype=np.uint64), np.empty(0, np.uint64), 0.8)) for n in (0, 1, 4, 5, 10)] == [0, 1, 1, 2, 3]


def test_awkward_rows(spark):
    got = dict(collected(simhash.similar_documents(awkward(spark)).where("doc_id is not null"), "doc_id", "component_id"))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert simhash.similar_documents(awkward(spark)).count() == 9
    assert simhash.similar_documents(empty(spark)).collect() == []
