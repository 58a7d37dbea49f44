"""Near-duplicates: SimHash fingerprints linked by pivot distance tables.

Pivot distance tables: the Hamming distances of every fingerprint to a set of reference
fingerprints. By the triangle inequality two fingerprints whose tables differ by more than d in
any coordinate are further apart than d, so such pairs are discarded unseen; the survivors are
verified by their own distance.

Tables alone would be tested for all pairs. Fingerprints within d bits agree in at least
``blocks - d`` of ``blocks`` runs of bits, so they are first dealt out by every choice of that many
runs, and the tables work inside those buckets. Both steps are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_rows, materialize, table
from .components import connected_components
from .jaccard import often_seen, prefixes, set_links, shingle_hashes

BITS = 64


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of one text over its shingles' hashes; 0 without words."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    few = long_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n: int, seed: int = 7) -> np.ndarray:
    """n reference fingerprints from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per reference."""
    return np.bitwise_count(refs[:, None] ^ fps[None, :]).astype(np.int8)


def link_bucket_runs(fps: np.ndarray, sizes: np.ndarray, refs: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of several buckets, one after the other: a spanning forest of the links within each.

    Compares every fingerprint with the one s places on, for all s: first by whether they are
    linked already, then by the pivot tables coordinate by coordinate, and last by their distance.
    """
    n = len(fps)
    bucket, label = np.repeat(np.arange(len(sizes)), sizes), np.arange(n)
    coords = distance_table(fps, refs)
    for s in range(1, int(sizes.max(initial=0))):
        at = np.nonzero(bucket[:-s] == bucket[s:])[0]
        at = at[label[at] != label[at + s]]
        for row in coords:
            if not at.size:
                break
            at = at[np.abs(row[at] - row[at + s]) <= d]
        at = at[np.bitwise_count(fps[at] ^ fps[at + s]) <= d]
        while at.size:
            low = np.minimum(label[at], label[at + s])
            np.minimum.at(label, label[at], low)
            np.minimum.at(label, label[at + s], low)
            while not np.array_equal(label, up := label[label]):
                label = up
            at = at[label[at] != label[at + s]]
    linked = np.nonzero(label != np.arange(n))[0]
    return fps[linked], fps[label[linked]]


def _link_buckets(d: int, n_pivots: int, at_once: int = 1 << 15):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(n_pivots)
        for b in batches:
            lists = b.column(0)
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            begins = np.cumsum(sizes) - sizes
            order = np.argsort(sizes, kind="stable")  # buckets of like size are compared together
            groups = np.cumsum(sizes[order]) // at_once
            for g in np.unique(groups):
                own = order[groups == g]
                n = sizes[own]
                take = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                u, v = link_bucket_runs(flat[take], n, refs, d)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def _masks(d: int, blocks: int) -> list[int]:
    """As signed numbers: for each choice of blocks - d of the blocks, the bits in them."""
    cut = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    full = [sum(c) for c in combinations(one, blocks - d)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def _blocks_for(rows: int, d: int) -> int:
    """The least number of blocks at which chance puts no more than some 64 fingerprints in a bucket."""
    blocks = d + 2
    while blocks < d + 5 and rows / 2 ** (BITS * (blocks - d) / blocks) > 64:
        blocks += 1
    return blocks


def _ball_links(hot: DataFrame, d: int) -> DataFrame:
    """Links among the fingerprints of buckets too large to compare inside one task.

    Fingerprints within d bits are those with a common point within d // 2 bits of one and d - d // 2
    of the other. Every fingerprint names the points of its ball, and each point links those that
    name it to the smallest of them: rows grow with the number of fingerprints, not with its square.
    """
    inner, outer = d // 2, d - d // 2
    flips = [(r, sum(1 << i for i in c)) for r in range(outer + 1) for c in combinations(range(BITS), r)]
    arr = "array(" + ",".join(f"struct({r}Y as r, {m - (1 << 64) if m >> 63 else m}L as m)" for r, m in flips) + ")"
    points = hot.select("fp", F.explode(F.expr(arr)).alias("flip")).select("fp", F.expr("fp ^ flip.m").alias("point"), "flip.r")
    least = points.groupBy("point").agg(F.min(F.when(F.col("r") <= inner, F.col("fp"))).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1 and v is not null")
    return points.join(least.select("point", "v"), "point").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def fingerprint_links(fps: DataFrame, max_distance: int = 4, n_pivots: int = 16, bucket_limit: int = 4096, task_rows: int = 1_000_000) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all pairs within max_distance bits.

    Not every pair is returned, but a set of links with the same connected components.
    """
    spark, d = fps.sparkSession, max_distance
    rows = fps.count()
    masks = _masks(d, _blocks_for(rows, d))
    keys = "array(" + ",".join(f"struct({t} as t, fp & {m}L as key)" if m != -(1 << 63) else f"struct({t} as t, shiftleft(shiftright(fp, 63), 63) as key)" for t, m in enumerate(masks)) + ")"
    spread = fps.repartition(max(spark.sparkContext.defaultParallelism, rows * len(masks) // task_rows), "fp")
    dealt = spread.select("fp", F.explode(F.expr(keys)).alias("k")).select("fp", "k.t", "k.key")
    hot = materialize(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit).select("t", "key"), "hot")
    any_hot = bool(hot.take(1))
    cold = dealt.join(hot, ["t", "key"], "left_anti") if any_hot else dealt
    buckets = cold.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # bucket_limit at most
    links = buckets.select("fps").mapInArrow(_link_buckets(d, n_pivots), "u long, v long")
    if any_hot:
        links = links.unionByName(_ball_links(dealt.join(hot, ["t", "key"], "left_semi").select("fp").distinct(), d))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, n_pivots: int = 16, bucket_limit: int = 4096, most_hot: int = 100_000) -> DataFrame:
    """Group documents whose fingerprints are linked, directly or through others.

    docs: doc_id, text; more columns are ignored. Returns one row per input row: doc_id, fingerprint
    (16 lowercase hex digits), component_id (smallest doc_id reachable).
    Null, empty and blank texts all have fingerprint zero and are linked like any other. Rows with a
    null doc_id are returned, and name no component unless they are alone (then null). Repeated rows
    each return one row. Equal fingerprints meet once, so copies never become pairs. Buckets of more
    than bucket_limit different fingerprints take another exact way. The most frequent fingerprints,
    most_hot of them at most, are told their class by a broadcast, so no task gathers their copies.
    """
    own = materialize(fingerprints(docs, shingle), "fingerprints")
    told = grouped(own, fingerprint_links(own.select("fp").distinct(), max_distance, n_pivots, bucket_limit), most_hot)
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(own: DataFrame, links: DataFrame, most_hot: int) -> DataFrame:
    """(doc_id, fp, component_id) for each row of own (doc_id, fp), by links between fps."""
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    labels = connected_components(links)
    linked = first.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    classes = linked.join(least, "component").select("fp", "least_id")
    all_of = first.join(classes, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), "n")
    all_of = materialize(all_of, "classes")
    # more than rows / most_hot copies: at most most_hot such fingerprints, whose classes go to the copies
    often = F.col("n") > max(100, own.count() // most_hot)
    hot = F.broadcast(all_of.where(often).select("fp", "component_id"))
    told = own.join(hot, "fp").unionByName(own.join(hot.select("fp"), "fp", "left_anti").join(all_of.where(~often).select("fp", "component_id"), "fp"))
    return told.select("doc_id", "fp", "component_id")


def similar_documents(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_distance: int = 4, n_pivots: int = 16, bucket_limit: int = 4096,
    sample: int = 20_000, most_often: int = 100_000, most_hot: int = 100_000, crowd: int = 256,
) -> DataFrame:
    """(doc_id, component_id), one row per input row: texts whose sets of shingles have at least this Jaccard similarity are
    linked, directly or through others.

    Fingerprints within max_distance bits, linked by the pivot tables, name pairs to verify on whole sets. Similar texts may
    differ in many more bits than pivots can tell from chance, so set_links() then finds all other pairs, exactly (up to
    64-bit hashes). Texts without words are copies of each other. Null and repeated doc_ids as in near_duplicates().
    """
    often = often_seen(docs, shingle, sample, most_often)
    own = materialize(prefixes(docs, shingle, similarity, often, simhash), "prefixes")
    one = own.where("n > 0").groupBy("fp").agg(F.min("id").alias("v"))  # a set for each fingerprint
    links = fingerprint_links(one.select("fp"), max_distance, n_pivots, bucket_limit)
    links = links.groupBy("u").agg(F.min("v").alias("v"))  # a pair for each fingerprint, however many buckets link it
    ends = one.select(F.col("fp").alias("a"), F.col("v").alias("x")), one.select(F.col("fp").alias("b"), F.col("v").alias("y"))
    far = links.join(ends[0], F.col("u") == F.col("a")).join(ends[1], links["v"] == F.col("b")).select(F.col("x").alias("u"), F.col("y").alias("v"))
    same = own.where("n > 0").select("fp", F.col("id").alias("u")).distinct().join(one, "fp").where("u <> v").select("u", "v")
    pairs = set_links(docs, own, far.unionByName(same), shingle, similarity, crowd=crowd)
    return grouped(own.select("doc_id", F.col("id").alias("fp")), pairs, most_hot).select("doc_id", "component_id")


def _firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the documents whose group (doc_id, component_id) has a smaller doc_id; all columns stay.

    Rows that repeat one doc_id stand or fall together; rows with a null doc_id stay.
    """
    out = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near_duplicates(), the one with the smallest doc_id."""
    return _firsts(docs, near_duplicates(docs, **options))


def keep_first_similar(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of similar_documents(), the one with the smallest doc_id."""
    return _firsts(docs, similar_documents(docs, **options))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
