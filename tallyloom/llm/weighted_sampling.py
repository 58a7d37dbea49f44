"""Document fingerprints: consistent weighted sampling.

Every sample of a document draws, for each of its terms, r and c from Gamma(2, 1) and b from [0, 1), all told by the term and the
number of the sample alone. A term of weight w stands at step t = floor(ln w / r + b) and scores
ln c - r * (t - b) - r; the least score wins, and the sample is its (term, t). Two documents agree in a sample with
the probability of their generalised Jaccard similarity: the sum of the smaller weights over the sum of the larger ones.

Draws come from tables of 16,384 rows, one for (r, b) and one for c, whose rows a term's hash picks. Scores are compared in steps
of 1/512, ties going to the smaller hash, so that a term of a small whole weight costs two look-ups and an addition for all
samples at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_rows, materialize, table

#: Samples of a fingerprint, words of a term.
SAMPLES, RUN = 128, 5
#: Rows of a table of draws, terms that are scored at once, whole weights whose scores are tables too, steps of a score.
ROWS, AT_ONCE, SMALL, STEPS = 1 << 14, 2048, 8, 512
SEED = 42
#: Bytes of text whose words are told at once.
PIECE = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(n: int, seed: int) -> np.ndarray:
    """n numbers from 0 to 1, the same everywhere."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed(at ^ mixed(np.full(1, seed, np.uint64))) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


@lru_cache(2)
def draws(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, b, ln c): tables of draws, a row for each term's place and a column for each sample."""
    u = uniform(5 * ROWS * samples, seed).reshape(5, ROWS, samples)
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])  # a sum of two exponentials is Gamma(2, 1)
    return r.astype(np.float32), u[4].astype(np.float32), np.log(c).astype(np.float32)


def steps_of(weights: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """t: the step at which a weight stands."""
    return np.floor(np.log(weights).astype(np.float32) / r + b)


def own_part(weights: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A score without its ln c, in whole steps."""
    return np.rint(STEPS * r * (b - 1 - steps_of(weights, r, b)))


@lru_cache(2)
def score_tables(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """ln c in whole steps; and own_part() for the weights 1, 2, 3, ..., one table below the other."""
    r, b, log_c = draws(samples, seed)
    return np.rint(STEPS * log_c).astype(np.int16), np.concatenate([own_part(np.full((1, 1), w), r, b) for w in range(1, SMALL + 1)]).astype(np.int16)


class Least:
    """For each sample the least-scored term of a weighted set: score, hash and weight."""

    def __init__(self, samples: int, seed: int, found: tuple | None = None) -> None:
        self.samples, self.seed, self.found = samples, seed, found

    def with_(self, terms: np.ndarray, weights: np.ndarray) -> Least:
        """This set and more terms: different ones in rising order, with weights above 0."""
        found, column = self.found, np.arange(self.samples)
        log_c, parts = score_tables(self.samples, self.seed)
        few = (weights <= SMALL) & (weights % 1 == 0)
        kinds = [(terms, weights, True)] if few.all() else [(terms[few], weights[few], True), (terms[~few], weights[~few], False)]
        for own, heavy, known in kinds:
            for at in range(0, len(own), AT_ONCE):
                part, w = own[at : at + AT_ONCE], heavy[at : at + AT_ONCE]
                rb, c = part.view(np.int64) & (ROWS - 1), part.view(np.int64) >> 14 & (ROWS - 1)
                if known:
                    score = parts.take((w.astype(np.int64) - 1) * ROWS + rb, 0)
                else:
                    r, b, _ = draws(self.samples, self.seed)
                    score = own_part(w[:, None], r[rb], b[rb]).astype(np.int32)
                score += log_c.take(c, 0)
                first = score.argmin(0)
                new = score[first, column], part[first], w[first]
                if found is None:
                    found = new
                else:
                    better = (new[0] < found[0]) | (new[0] == found[0]) & (new[1] < found[1])
                    found = tuple(np.where(better, x, y) for x, y in zip(new, found, strict=True))
        return Least(self.samples, self.seed, found)

    def told(self) -> np.ndarray:
        """16 bits for each sample's term and step; zeros for an empty set."""
        if self.found is None:
            return np.zeros(self.samples, np.uint16)
        _, won, weight = self.found
        step, at = np.zeros(self.samples, np.int64), np.nonzero(weight != 1)[0]  # weight 1 is at step 0
        if len(at):
            r, b, _ = draws(self.samples, self.seed)
            place = won[at].view(np.int64) & (ROWS - 1)
            step[at] = steps_of(weight[at], r[place, at], b[place, at])
        told = mixed(won + step.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        return np.maximum(told, np.uint64(1)).astype(np.uint16)


def sample(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """The samples of a weighted set, 16 bits each: of different terms, 64-bit hashes in rising order, and their weights above 0."""
    return Least(samples, seed).with_(terms, weights).told()


def sample_both(a: tuple, b: tuple, samples: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The samples of two weighted sets; what they share is scored once."""
    (terms, weights), (others, heavy) = a, b
    at = np.minimum(np.searchsorted(others, terms), max(len(others) - 1, 0))
    same = (others[at] == terms) & (heavy[at] == weights) if len(others) else np.zeros(len(terms), bool)
    shared = np.zeros(len(others), bool)
    shared[at[same]] = True
    common = Least(samples, seed).with_(terms[same], weights[same])
    return common.with_(terms[~same], weights[~same]).told(), common.with_(others[~shared], heavy[~shared]).told()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it is white space, and a number of its own, the same for A-Z as for a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space, values


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): a hash of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the place after its last byte.

    The hash is a polynomial of the word's bytes, modulo 2 ** 64.
    """
    found, stops, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    space, values = _letters()
    while at < len(text):
        begin, end = at, at + PIECE
        while end < len(text) and not space[text[end]]:  # a piece ends where a word does
            end += 1
        raw = np.frombuffer(text[at:end], np.uint8)
        at = end
        solid = np.concatenate([[False], ~space[raw], [False]])
        edges = np.nonzero(solid[1:] != solid[:-1])[0]
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts
        if not len(sizes):
            continue
        letters = raw[solid[1:-1]]
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(letters)) - np.repeat(firsts, sizes)
        found.append(mixed(np.add.reduceat(values[letters] * _powers(1 << int(sizes.max() - 1).bit_length())[place], firsts) + sizes.astype(np.uint64)))
        stops.append(ends + begin)
    return np.concatenate(found), np.concatenate(stops)


def runs(words: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of hashed words: each word with the run - 1 before it, or as many as there are, and how often this comes."""
    joined = np.zeros(len(words), np.uint64)
    for i in range(min(run, len(words))):
        joined[i:] += words[: len(words) - i] * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
    joined = np.sort(mixed(joined))
    first = np.nonzero(np.append(True, joined[1:] != joined[:-1])[: len(joined)])[0]
    return joined[first], np.diff(first, append=len(joined))


def weighted_terms(text: bytes, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of a whole text."""
    return runs(word_hashes(text)[0], run)


def fingerprint(text: bytes, samples: int = SAMPLES, run: int = RUN, seed: int = SEED) -> np.ndarray:
    """The samples of a text's weighted terms."""
    return sample(*weighted_terms(text, run), samples, seed)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint): 16 bits a sample, big end first, of every whole text.

    A null, empty or blank text has no terms and zeros only; null ids and repeated rows stay; equal texts have equal
    fingerprints; a very long text is scored 2,048 terms at a time. Other columns are not read.
    """
    few = long_rows(docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_packed(fingerprint(x.as_py(), samples, run, seed)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    return few.mapInArrow(told, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def _packed(samples: np.ndarray) -> bytes:
    return samples.astype(">u2").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, ">u2")


class Page:
    """A text with its words' hashes."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.text = raw, raw.decode("utf-8", "replace")
        self.words, self.ends = word_hashes(raw)

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        return runs(self.words)

    def beside(self, following: Page) -> tuple[np.ndarray, tuple]:
        """(own samples, facts): this text held against the one whose last third of code points is replaced by the first
        as many, or all, of the following text. facts: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited.

        Words that end before the cut are not hashed again.
        """
        third = len(self.text) // 3
        kept, added = self.text[: len(self.text) - third].encode("utf-8", "replace"), following.text[:third].encode("utf-8", "replace")
        whole = int(np.searchsorted(self.ends, len(kept)))  # words that end before the last kept byte
        begin = int(self.ends[whole - 1]) if whole else 0
        words = np.concatenate([self.words[:whole], word_hashes(kept[begin:] + added)[0]])
        own, again = sample_both(self.terms(), runs(words))
        return own, (len(self.text), hashlib.sha256(kept + added).digest(), _packed(own), _packed(again), likeness(own, again))


FACTS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double"


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every text held against
    its edited form and against the next document's, in the order of falling doc_id, the first after the last.

    Texts are ranged by doc_id, so that a task sees each of its documents followed by the next; only the first text of each
    partition is handed to the one before. Null ids come last, equal ids go by a hash of their texts; null texts are
    empty; a single document is its own next; an empty table gives an empty result. Other columns are not read. Bytes that are no
    UTF-8 count as replacement characters in n_chars and the edited text.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    few = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    ranged = few.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    kind = few.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in FACTS.split(", ")), "near_next"]
    arrow = [pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64()]

    def batch(found: list[tuple], kinds: list, columns: list[str]) -> pa.RecordBatch:
        cells = zip(*found, strict=True) if found else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], columns)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = held = part = ids = None  # the row before, and the one before it, which waits for that one's samples
        none = (None,) * 5
        rows = lambda out: batch(out, [pa.int32(), pa.string(), pa.binary(), ids, *arrow], ["part", "kind", "text", *names])

        def told(own: np.ndarray) -> tuple:
            """What the samples of `before` complete: the row that waits for them, or the first of the partition."""
            if held is None:
                return part, "first", before[1].raw, None, None, None, _packed(own), None, None, None
            return part, "done", None, held[0], *held[2], likeness(held[1], own)

        for b in batches:
            ids, out = b.schema.field(0).type, []
            for doc_id, raw, part in zip(*b.columns, strict=True):
                page, part = Page(raw.as_py()), part.as_py()
                if before is not None:
                    own, facts = before[1].beside(page)
                    out.append(told(own))
                    held = before[0], own, facts
                before = doc_id.as_py(), page
            yield rows(out)
        if before is not None:
            own = sample(*before[1].terms())
            yield rows([told(own), (part, "last", before[1].raw, before[0], *none, None)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.schema.field(0).type, []
            for doc_id, text, following, next_own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, facts = Page(text).beside(Page(following))
                out.append((doc_id, *facts, likeness(own, _unpacked(next_own))))
            yield batch(out, [ids, *arrow], names)

    few = long_rows(ranged.select("doc_id", "text", "part"))
    told = materialize(few.mapInArrow(follow, f"part int, kind string, text binary, doc_id {kind}, {FACTS}, near_next double"), "followed")
    first, last = (told.where(F.col("kind") == k) for k in ("first", "last"))
    first = first.select("part", F.col("text").alias("following"), F.col("fingerprint").alias("next_own"))
    # one row for each partition: which of those with rows comes next, after the last the first
    parts = first.select("part").withColumn("then", F.expr("coalesce(lead(part) over (order by part), min(part) over ())"))
    ends = last.join(parts, "part").select("doc_id", "text", F.col("then").alias("part")).join(first, "part")
    ends = ends.select("doc_id", "text", "following", "next_own").mapInArrow(finish, f"doc_id {kind}, {FACTS}, near_next double")
    return told.where("kind = 'done'").select(*names).unionByName(ends)


def op11_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and the next document; fingerprints as 4 hex digits for each of 128 samples, hashes as 64."""
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    found = beside_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", digits("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"), "near_edited", "near_next")
