"""Sets of word shingles: which of them are alike by Jaccard similarity, found exactly.

Two sets as similar as asked share an element among the first few of each, in any one order of all
elements (prefix filter). Elements that a sample finds in many texts come last in that order, so
few texts meet by them; the sample decides how many pairs are looked at, never which are found.
Sets that still meet many others by one element are compared in a second order, by exact counts
among them. In any order, what stands behind the first shared element bounds the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import about, drop, long_rows, materialize
from .components import connected_components

SEED = 42


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Hashes of the runs of k words, repeats included; of the whole text if it is shorter; none without words."""
    words = text.lower().split() if text else []  # for bytes: A-Z only, and exactly the white space of the contract
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_intdigest
    found = [digest(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)] or [digest(line, SEED)]
    return np.array(found, np.uint64)


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The different shingle_hashes(), sorted."""
    return np.unique(shingle_hashes(text, k))


def set_id(hashes: np.ndarray) -> int:
    """One number for a set; 0 for the empty set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if hashes.size else 0


def is_in(often: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    if not len(often):
        return np.zeros(len(hashes), bool)
    return often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes


def prefix(hashes: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The elements of which a set so similar to this one has at least one among its own; often is sorted."""
    n = len(hashes)
    if not n:
        return hashes
    late = is_in(often, hashes)
    return np.concatenate([hashes[~late], hashes[late]])[: n - ceil(similarity * n - 1e-9) + 1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate([np.empty(0, np.uint64), *found])))


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the number of a text's set and all its elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), k) for x in b.column(0)]
            ids = np.fromiter(map(set_id, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([_signed(ids), _lists(sets)], ["id", "hashes"])

    return long_rows(docs.select(F.col("text").cast("binary").alias("text"))).mapInArrow(run, "id long, hashes array<long>")


def often_seen(docs: DataFrame, k: int, sample: int, most: int) -> np.ndarray:
    """The shingles in most texts of a sample, `most` of them at most, sorted."""
    seen = whole_sets(about(docs, sample, "doc_id"), k).select(F.explode("hashes").alias("h")).groupBy("h").count().where("count > 2")
    rows = seen.orderBy(F.desc("count"), "h").limit(most).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def prefixes(docs: DataFrame, k: int, similarity: float, often: np.ndarray, fingerprint) -> DataFrame:
    """(doc_id, id, fp, n, hashes): a text's set by number, its fingerprint (of all shingles, repeats included), its size and its prefix in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [shingle_hashes(x.as_py(), k) for x in b.column(1)]
            sets = [np.unique(x) for x in bags]
            ids = np.fromiter(map(set_id, sets), np.uint64, len(sets))
            fps = np.fromiter(map(fingerprint, bags), np.uint64, len(bags))
            numbers = pa.array([len(x) for x in sets], pa.int32())
            firsts = _lists([prefix(x, often, similarity) for x in sets])
            yield pa.RecordBatch.from_arrays([b.column(0), _signed(ids), _signed(fps), numbers, firsts], ["doc_id", "id", "fp", "n", "hashes"])

    few = long_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, f"doc_id {kind}, id long, fp long, n int, hashes array<long>")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Sizes that allow so much similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def elements(docs: DataFrame, own: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(id, s): all elements of the sets asked for by id, and maybe of a few more. One text is read for each."""
    one = own.join(asked, "id").groupBy("id").agg(F.min(F.struct("doc_id")).alias("x")).select(F.col("x.doc_id").alias("one")).distinct()
    texts = whole_sets(docs.join(one, docs["doc_id"].eqNullSafe(one["one"]), "left_semi"), k)
    return materialize(texts.groupBy("id").agg(F.first("hashes").alias("s")), "set-elements")  # rows that repeat a doc_id


def verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """Those of pairs (u, v) of set numbers that are so similar. Only the texts of such sets are read, one for each."""
    pairs = materialize(pairs, "set-pairs")
    texts = elements(docs, own, pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), k)
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    out = materialize(both.where(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v"), "similar-sets")
    drop(pairs, texts)
    return out


def rarest_first(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, h, at): the prefixes of sets (id, s) in the order of how many of them hold an element, and where in its set each
    element stands. Elements of one set alone come first and are left out, as none is met by them."""
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("of")).where("of > 1"), "h")
    w = Window.partitionBy("id")
    at = F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("of", "h")) - 1
    return shared.withColumn("at", at.cast("int")).where(F.col("n") - F.col("at") >= similarity * F.col("n") - 1e-9).select("id", "h", "at")


def meetings(keys: DataFrame, similarity: float, crowd: int, step: float = 1.05) -> DataFrame:
    """Pairs (u, v) of sets of different groups, all that are so similar among them; a pair may come by several elements.

    keys: (order, h, id, at, n, c, g): a set of size n and group c (of g sets) has h at place `at` of an order of elements. If h is the
    first that two sets share, their overlap is at most what each has from there on, so with h at that place a set reaches
    the similarity with sets up to a certain size only. More than `crowd` sets at one h are dealt out by size, the smaller
    of a pair by its own, the larger by those that it may meet, and the members of one group there do not meet each other.
    """
    at_h = keys.groupBy("order", "h").agg(F.count(F.lit(1)).alias("met"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.struct("g", "c")).alias("x"))
    at_h = at_h.where("c0 <> c1").select("order", "h", (F.col("met") > crowd).alias("busy"), F.col("x.c").alias("lead"))
    n, busy, lead = F.col("n"), F.col("busy"), F.col("c") == F.col("lead")
    share = similarity / (1 + similarity)
    rows = keys.join(at_h, ["order", "h"]).withColumn("most", (n - F.col("at")) / F.lit(share) - n + 1e-6)  # the largest set that it may still be like
    band = lambda x: F.floor(F.log(x) / F.log(F.lit(step))).cast("int")
    low = band(similarity * n - 1e-6)
    bands = F.when(busy, F.sequence(low, F.greatest(low, band(F.least(n + 1e-6, F.col("most")))))).otherwise(F.array(F.lit(-1)))
    sides = F.when(busy & ~lead, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))  # 1: meets the leading group, 0: the others
    named = lambda x: [F.col(y).alias(y + x) for y in ("id", "c", "n", "most")]
    small = rows.where(F.col("most") >= n).select("order", "h", F.when(busy, band(n + 1e-6)).otherwise(-1).alias("band"), F.explode(sides).alias("side"), *named("a"))
    large = rows.select("order", "h", F.explode(bands).alias("band"), F.when(busy & lead, 1).otherwise(0).alias("side"), *named("b"))
    ordered = F.struct("na", "ida") < F.struct("nb", "idb")
    fits = (F.col("nb") <= F.col("mosta")) & (F.col("na") <= F.col("mostb")) & _alike(F.col("na"), F.col("nb"), similarity)
    return small.join(large, ["order", "h", "band", "side"]).where(ordered & (F.col("ca") != F.col("cb")) & fits).select(F.col("ida").alias("u"), F.col("idb").alias("v"))


def groups_of(links: DataFrame) -> DataFrame:
    """(id, c, g): the group that links (u, v) put a set in, and how many sets that has."""
    group = materialize(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("c")), "alike")
    return group.join(group.groupBy("c").agg(F.count(F.lit(1)).alias("g")), "c").select("id", "c", "g")


def in_groups(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """keys with c and g; a set without links is a group of its own."""
    return keys.join(groups, "id", "left").withColumns({"c": F.coalesce("c", "id"), "g": F.coalesce("g", F.lit(1).cast("bigint"))})


def set_links(docs: DataFrame, own: DataFrame, guesses: DataFrame, k: int, similarity: float, share: float = 0.1, rounds: int = 2, crowd: int = 256) -> DataFrame:
    """Links (u, v) of set numbers that connect all pairs so similar.

    own: as prefixes() gives it; guesses (u, v): pairs that may well be alike. These are verified first, with the pairs of
    each set and the most typical one that it meets by an element (of the largest group found so far, and of those the one
    most of whose prefix is met), if they share so large a share of its prefix. The groups so found, in `rounds` rounds, need
    no more comparing inside, and only then all other pairs that may be so similar by meetings() are verified.

    Where a set meets more than `crowd` of other groups by an element, as a mean, both of a pair are among the sets that do so
    anywhere, and these meet by the elements that are rare among them instead: first, once more, with the set that has fewest
    of those. Copies of a set meet once.
    """
    sets = materialize(own.where("n > 0").groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "hashes"))), "sets")
    keys = sets.select("id", F.posexplode("hashes").alias("at", "h"))
    met = keys.groupBy("h").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    shared = materialize(keys.join(met.select("h"), "h"), "met")
    facts = sets.select("id", "n", F.size("hashes").alias("p")).join(shared.groupBy("id").agg(F.count(F.lit(1)).alias("w")), "id")
    facts = materialize(facts, "set-facts")
    drop(sets)
    keys = materialize(shared.join(facts, "id"), "met-facts")
    drop(shared)
    known = keys.withColumns({"c": F.col("id"), "g": F.lit(1).cast("bigint")})
    sizes = facts.select("id", "n")
    guessed = guesses.join(sizes.withColumnsRenamed({"id": "u", "n": "nu"}), "u").join(sizes.withColumnsRenamed({"id": "v", "n": "nv"}), "v")
    near = None
    for r in range(rounds):
        best = known.groupBy("h").agg(F.max(F.struct("g", F.col("w") / F.col("p"), "id", "c", "n")).alias("x"))
        pairs = known.join(best, "h").where((F.col("c") != F.col("x.c")) & _alike(F.col("n"), F.col("x.n"), similarity))
        pairs = pairs.groupBy(F.col("id").alias("u"), F.col("x.id").alias("v")).agg(F.count(F.lit(1)).alias("both"), F.first("p").alias("p"))
        pairs = pairs.where(F.col("both") >= F.lit(share) * F.col("p")).select("u", "v")
        if not r:
            pairs = pairs.unionByName(guessed.where(_alike(F.col("nu"), F.col("nv"), similarity)).select("u", "v")).distinct()
        found = verified(docs, own, pairs, k, similarity)
        near = found if near is None else near.unionByName(found)
        groups = groups_of(near)
        drop(known)
        known = materialize(in_groups(keys, groups), "met-groups") if r < rounds - 1 else None
    each = in_groups(keys, groups).groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
    crowded = materialize(each.where(F.col("all") * F.col("all") - F.col("same") > crowd * F.col("all")).select("h"), "crowded")
    asked = materialize(keys.join(crowded, "h", "left_semi").select("id").distinct(), "crowded-sets")
    whole = elements(docs, own, asked, k)
    busy = materialize(rarest_first(whole.join(asked, "id", "left_semi"), similarity).join(sizes, "id"), "met-rarely")
    drop(whole)
    known = in_groups(busy, groups)
    best = known.groupBy("h").agg(F.max(F.struct("g", -F.col("at") / F.col("n"), "id", "c", "n")).alias("x"))
    pairs = known.join(best, "h").where((F.col("c") != F.col("x.c")) & _alike(F.col("n"), F.col("x.n"), similarity))
    near = near.unionByName(verified(docs, own, pairs.select(F.col("id").alias("u"), F.col("x.id").alias("v")).distinct(), k, similarity))
    every = keys.join(crowded, "h", "left_anti").select("id", "h", "at", "n", F.lit(0).alias("order")).unionByName(busy.select("id", "h", "at", "n", F.lit(1).alias("order")))
    every = materialize(in_groups(every, groups_of(near)), "met-again")
    drop(keys, busy)
    return near.unionByName(verified(docs, own, meetings(every, similarity, crowd).distinct(), k, similarity))
