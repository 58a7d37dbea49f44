"""Quality classifier by co-training: a text view and a page-metadata view teach each other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import about, crc_mod, long_rows, materialize, table, unit_hash

HASHED, SHAPE, META = 96, 16, 48
TEXT = HASHED + SHAPE
_SYMBOLS = b"#*$%&|<>!@^~=+{}[]\\_"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


def _share(part: int, whole: int) -> int:
    return min(255, int(255 * part / whole + 0.5)) if whole else 0


def text_view(text: bytes | None) -> np.ndarray:
    """What a text is made of, as TEXT bytes: hashed word shares, then shares of symbols, case, repeats."""
    out = np.zeros(TEXT, np.uint8)
    words = text.split() if text else []
    if not words:
        return out
    n, seen = len(words), Counter(words)
    sums = [0] * HASHED
    for w, c in seen.items():
        sums[crc32(w) % HASHED] += c
    out[:HASHED] = np.minimum(255, 255 * np.sqrt(np.array(sums) / n))
    size = len(text)
    count = lambda chars: size - len(text.translate(None, chars))
    upper, letters = count(_UPPER), count(_UPPER + bytes(range(97, 123)))
    long_ = sum(map(len, words)) / n
    shape = (
        _share(count(_SYMBOLS), size), min(255, 10 * count(_SYMBOLS) * 25 // max(1, n)), _share(upper, letters), _share(count(_DIGIT), size),
        _share(len(seen), n), _share(max(seen.values()), n), min(255, int(12 * long_)), _share(count(b".,;:?"), n), _share(letters, size),
        _share(sum(c for c in seen.values() if c > 1), n), min(255, int(20 * log1p(n))), 255 if n < 20 else 0, _share(count(b"!"), n),
    )
    out[HASHED : HASHED + len(shape)] = shape
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None, lines: int) -> np.ndarray:
    """What is known of a page beside its words, as META bytes: language, source, length, layout."""
    out = np.zeros(META, np.uint8)
    out[crc32(f"lang {lang}".encode()) % 16] = 255
    out[16 + crc32(f"source {source}".encode()) % 24] = 255
    n = max(0, n_chars or 0)
    out[40:44] = min(255, int(20 * log1p(n))), min(255, int(40 * log1p(lines))), min(255, int(25 * log1p(n / (lines + 1)))), 255 if n < 100 else 0
    return out


@dataclass
class Linear:
    """Logistic regression on bytes scaled to 0..1, with a Platt scale on top."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) / 255 @ self.weight + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) * self.slope + self.shift


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, weight: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression; the last coefficient is the bias and is hardly held back."""
    x = np.hstack([x, np.ones((len(x), 1))])
    hold = np.full(x.shape[1], ridge)
    hold[-1] = 1e-3
    w, rows = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (rows * (p - y)) + hold * w
        h = (x * (rows * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2.0) -> Linear:
    w = _newton(x.astype(np.float64) / 255, y, ridge, weight)
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Model:
    """Both views and the weights that combine their calibrated logits."""

    text: Linear
    meta: Linear
    combine: tuple[float, float, float]

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        a, b, c = self.combine
        return 1 / (1 + np.exp(-np.clip(a * self.text.logit(t) + b * self.meta.logit(m) + c, -30, 30)))


def _platt(view: Linear, x: np.ndarray, y: np.ndarray) -> None:
    a, b = _newton(view.raw(x)[:, None], y, 1e-2)
    view.slope, view.shift = max(0.0, float(a)), float(b)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m): both views of every document as bytes."""
    few = long_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text"), "lang", "source", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_views(*(x.as_py() for x in row)) for row in zip(*b.columns[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t, _ in rows], pa.binary()), pa.array([m.tobytes() for _, m in rows], pa.binary())], ["doc_id", "t", "m"])

    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, t binary, m binary")


def _views(text: bytes | None, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    return text_view(text), meta_view(lang, source, n_chars, text.count(b"\n") if text else 0)


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.uint8).reshape(-1, width)


def _rows(df: DataFrame, *more: str) -> tuple[np.ndarray, ...]:
    got = df.select("t", "m", *more).collect()  # bounded by the caller
    return _matrix([r.t for r in got], TEXT), _matrix([r.m for r in got], META), *(np.array([r[c] for r in got], np.float64) for c in more)


def _scored(view: str, model: Linear, width: int) -> Column:
    @F.pandas_udf("double")
    def logit(x: pd.Series) -> pd.Series:
        return pd.Series(model.logit(_matrix(x, width)))

    return logit(view)


def co_train(feats: DataFrame, labels: DataFrame, rounds: int = 3, max_labelled: int = 8_000, per_round: int = 400) -> Model | None:
    """Fit both views.

    feats: as features() gives them. labels: doc_id, quality (0, 1; others and nulls are left out; of
    several labels of one document the larger counts). About max_labelled labelled rows are used,
    chosen by a hash of doc_id; a quarter of them calibrates and never trains. In each round each
    view scores all unlabelled documents and gives the other about its per_round surest of either class as
    pseudo-labels of half weight. None if the labels are of fewer than two classes.
    """
    named = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = feats.join(named, "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)))
    t, m, y, part = _rows(about(known, max_labelled, "doc_id"), "y", "part")
    held = part == 0
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        return None
    pool = feats.join(named, "doc_id", "left_anti")
    own = np.ones(int((~held).sum()))
    fit = lambda x, k, px, py: fit_linear(np.vstack([x[~held], px]), np.concatenate([y[~held], py]), np.concatenate([own, np.full(len(py), 0.5)]))
    extra = {"t": (np.zeros((0, TEXT), np.uint8), np.zeros(0)), "m": (np.zeros((0, META), np.uint8), np.zeros(0))}
    for r in range(rounds + 1):
        views = {"t": fit(t, 0, *extra["t"]), "m": fit(m, 0, *extra["m"])}
        _platt(views["t"], t[held], y[held])
        _platt(views["m"], m[held], y[held])
        if r == rounds:
            break
        scored = materialize(pool.select("doc_id", "t", "m", _scored("t", views["t"], TEXT).alias("zt"), _scored("m", views["m"], META).alias("zm")), "pool")
        told = {}
        for teacher, pupil in (("zt", "m"), ("zm", "t")):
            got = [(_rows(_surest(scored, teacher, sign, per_round)), label) for sign, label in ((1, 1.0), (-1, 0.0))]
            told[pupil] = (np.vstack([x[pupil == "m"] for x, _ in got]), np.concatenate([np.full(len(x[0]), label) for x, label in got]))
        extra = told
    z = np.column_stack([views["t"].logit(t[held]), views["m"].logit(m[held])])
    a, b, c = _newton(z, y[held], 1e-1)
    return Model(views["t"], views["m"], (max(0.0, float(a)), max(0.0, float(b)), float(c)))


def _surest(scored: DataFrame, teacher: str, sign: int, k: int, least: float = 2.2) -> DataFrame:
    """About k rows with the largest logits of the sign, none less sure than 9 in 10 (a logit of 2.2).

    Counts by steps of a tenth tell where the k-th row lies; of its step a share is taken by hash.
    """
    z = F.col(teacher) * sign
    step = F.floor(F.least(z, F.lit(30.0)) * 10).cast("int")
    steps = {r.step: r["count"] for r in scored.where(z > least).groupBy(step.alias("step")).count().collect()}  # 300 at most
    above = 0
    for s in sorted(steps, reverse=True):
        if above + steps[s] >= k:
            return scored.where((z > least) & ((step > s) | (step == s) & (unit_hash("doc_id", seed=9) < (k - above) / steps[s])))
        above += steps[s]
    return scored.where(z > least)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned: those of documents whose crc32(doc_id) mod 5 is not 0."""
    return labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", "quality")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Score every document: doc_id, held_out (its label, if any, is not learned), p_text, p_meta, score, kept.

    docs: doc_id, text, lang, source, n_chars; any may be null; other columns are ignored. A null or
    empty text is scored like any other. Repeated rows each give a row. Without labels of both
    classes nothing can be learned: probabilities are 0.5 and all documents are kept.
    """
    feats = materialize(features(docs), "features")
    model = co_train(feats, training_labels(labels), **options)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    if model is None:
        half = F.lit(0.5)
        return feats.select("doc_id", held, half.alias("p_text"), half.alias("p_meta"), half.alias("score"), F.lit(True).alias("kept"))

    @F.pandas_udf("p_text double, p_meta double, score double")
    def score(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        t, m = _matrix(t, TEXT), _matrix(m, META)
        sure = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pd.DataFrame({"p_text": sure(model.text.logit(t)), "p_meta": sure(model.meta.logit(m)), "score": model.score(t, m)})

    return feats.select("doc_id", held, score("t", "m").alias("s")).select("doc_id", "held_out", "s.*", (F.col("s.score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs that score threshold or more; all columns stay and texts are not shuffled."""
    feats = materialize(features(docs), "features")
    model = co_train(feats, training_labels(labels), **options)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def good(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        null = lambda x: None if x is None or x != x else x
        rows = [_views(x.encode() if isinstance(x, str) else None, null(a), null(b), int(null(n) or 0)) for x, a, b, n in zip(text, lang, source, n_chars, strict=True)]
        if not rows:
            return pd.Series([], dtype=bool)
        return pd.Series(model.score(np.vstack([t for t, _ in rows]), np.vstack([m for _, m in rows])) >= threshold)

    return docs.where(good("text", "lang", "source", "n_chars"))


def op3_cotrain(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labels that may be; see classify()."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
