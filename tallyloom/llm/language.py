"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel is the blended spectrum of n-gram presence: texts are alike as far as they share distinct n-grams of one to three
characters. All letters of all scripts are told apart; whatever is no letter counts as one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, long_rows, materialize, table, unit_hash

BATCH = 128
#: Stands for any character that is no letter; letters are code points plus one, under 2 to the 21.
OTHER, BITS = 1, 21


@cache
def symbols() -> np.ndarray:
    """Code point -> symbol."""
    return np.array([c + 1 if chr(c).isalpha() else OTHER for c in range(0x110000)], np.int64)


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of n = 1, 2, 3 of a text, sorted, as numbers that tell all of them apart."""
    one = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    two = one[:-1] << BITS | one[1:]
    three = two[:-1] << BITS | one[2:]
    return np.unique(np.concatenate([one, two, three]))


@dataclass
class Kernel:
    """Landmarks: presence vectors over the n-grams that any of them has."""

    vocabulary: np.ndarray  # sorted
    landmarks: np.ndarray  # columns x landmarks, 0 or 1
    norm: np.ndarray  # distinct n-grams of each landmark

    def rows(self, texts: list[str]) -> np.ndarray:
        """k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|) of each text with each landmark, by one matrix product."""
        present, size = np.zeros((len(texts), len(self.landmarks)), np.float32), np.ones(len(texts))
        for i, text in enumerate(texts):
            if text:
                own = grams(text)
                size[i] = len(own)
                at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
                present[i, at[self.vocabulary[at] == own]] = 1
        return (present @ self.landmarks) / np.sqrt(size[:, None] * self.norm[None, :])


@dataclass
class Model:
    kernel: Kernel
    langs: list[str]
    weight: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """What the regression of each language gives, one row a text."""
        return self.kernel.rows([t or "" for t in texts]) @ self.weight + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; of equal scores the first language in code-point order."""
        out = self.raw(texts)
        p = np.clip(out, 1e-6, 1.0)
        best, share = p.argmax(axis=1), p.max(axis=1) / p.sum(axis=1)
        letters = [t is not None and any(map(str.isalpha, t)) for t in texts]  # ends at the first letter
        return [(self.langs[b], float(s)) if ok else ("und", 0.0) for b, s, ok in zip(best, share, letters, strict=True)]


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield part, part.column(column).to_pylist()


def train(docs: DataFrame, per_lang: int = 600, landmarks: int = 32, ridge: float = 1e-2, max_langs: int = 200) -> Model | None:
    """Fit on docs (doc_id, text, lang): about per_lang rows of each language, chosen by a hash of
    doc_id; the first `landmarks` of each, in the order of that hash, are the Nyström landmarks.

    Rows without a language or text teach nothing. None if no language is left; over max_langs languages
    are refused with a ValueError, as each adds landmarks to every product. Whole texts are read in the
    tasks; the driver gets n-gram numbers of landmarks and kernel values only.
    """
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null and text <> ''")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(max_langs + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(counts)
    rates = F.broadcast(spark.createDataFrame([(x, per_lang / counts[x]) for x in langs], "lang string, rate double"))  # max_langs rows
    sample = known.select("text", "lang", unit_hash("doc_id", seed=11).alias("place")).join(rates, "lang").where("place < rate")
    sample = materialize(sample.select("text", "lang", (F.col("place") / F.col("rate")).alias("place")), "language-sample")

    def sets(batches):
        for _, texts in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([grams(t) for t in texts], pa.list_(pa.int64()))], ["grams"])

    order = F.expr("row_number() over (partition by lang order by place, xxhash64(text))")  # about per_lang rows of each
    chosen = sample.withColumn("nth", order).where(F.col("nth") <= landmarks).orderBy("lang", "nth").select("text")
    got = [np.array(r.grams, np.int64) for r in chosen.mapInArrow(sets, "grams array<long>").collect()]
    vocabulary = np.unique(np.concatenate(got))
    present = np.zeros((len(vocabulary), len(got)), np.float32)
    for i, own in enumerate(got):
        present[np.searchsorted(vocabulary, own), i] = 1
    kernel = Kernel(vocabulary, present, np.array([len(g) for g in got], np.float64))

    def rows(batches):
        for part, texts in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(kernel.rows(texts)), pa.list_(pa.float64()))], ["lang", "k"])

    data = sample.select("text", "lang").mapInArrow(rows, "lang string, k array<double>").collect()
    k = np.array([r.k for r in data])
    y = np.array([[float(r.lang == x) for x in langs] for r in data])
    among = (present.T @ present) / np.sqrt(kernel.norm[:, None] * kernel.norm[None, :])
    value, vector = np.linalg.eigh(among.astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-3))  # Nyström features z = k root
    z = k @ root
    middle = z.mean(axis=0)
    held = ridge * len(z) / 10 * np.eye(z.shape[1])
    w = np.linalg.solve((z - middle).T @ (z - middle) + held, (z - middle).T @ (y - y.mean(axis=0)))
    return Model(kernel, langs, root @ w, y.mean(axis=0) - middle @ w)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs (doc_id, text); other columns are never read.

    The whole text counts. `und` with score 0 if it is null or has no letter, or if nothing was
    learned. Repeated rows each give a row.
    """
    few = long_rows(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 1):
            got = model.predict(texts) if model else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out; see train() and identify()."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
