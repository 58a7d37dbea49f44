"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens carry evidence features (their lower-case form and its prefixes) that go with toxic documents
in the labelled sample. A token of a toxic document with evidence is labelled toxic, any other token
clean. The chain has the states clean and toxic; a token's score for toxic is the sum of the weights
of its features, of whether its neighbours have evidence, and of a bias. Runs of tokens without
evidence nearby all score the bias, so forward and backward passes cross such a run by a matrix
power: the passes are exact over whole texts and cost time only where there is evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, crc_mod, long_rows, materialize, table

TOKEN = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7, 8)
REACH, SLOTS = 7, 1 + len(PREFIXES)
WIDTH = 2 * REACH + 1


def evidence(token: str) -> list[str]:
    """Features of a token: =form, and its prefixes as ^prefix."""
    low = token.lower()
    return ["=" + low, *("^" + low[:n] for n in PREFIXES if len(low) > n)]


class Lexicon(dict):
    """Token -> numbers of its features, remembered for the tokens of one task."""

    def __init__(self, features: list[str]):
        super().__init__()
        self.number = {f: i for i, f in enumerate(features)}

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        found = tuple(self.number[f] for f in evidence(token) if f in self.number)
        self[token] = found
        return found


@dataclass
class Chain:
    """Weights of the field: features, a neighbour with evidence before or after, bias, transitions (from, to)."""

    features: list[str]
    weight: np.ndarray
    before: float = 0.0
    after: float = 0.0
    bias: float = -4.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # document score: bias, any, count, share

    def powers(self) -> list[np.ndarray]:
        """Transfer matrices of 1, 2, 4, ... tokens without evidence, each scaled to sum to one."""
        m = np.exp(self.move + np.array([0.0, self.bias])[None, :])
        out = []
        for _ in range(40):
            out.append(m / m.sum())
            m = out[-1] @ out[-1]
        return out

    def marginals(self, hits: list[tuple[int, tuple[int, ...]]], n: int, powers: list[np.ndarray]) -> list[tuple[int, float]]:
        """(token, probability of toxic) of the tokens with evidence, out of n tokens in all."""
        at = {i: sum(self.weight[f] for f in fs) + self.bias for i, fs in hits}
        score = dict(at)
        for i in at:
            if i + 1 < n:
                score[i + 1] = score.get(i + 1, self.bias) + self.before
            if i:
                score[i - 1] = score.get(i - 1, self.bias) + self.after
        active = sorted(score)
        go = np.exp(self.move)

        def cross(v: np.ndarray, gap: int, back: bool) -> np.ndarray:
            for p in powers:
                if not gap:
                    break
                if gap & 1:
                    v = p @ v if back else v @ p
                    v = v / v.sum()
                gap >>= 1
            return v

        start = np.array([1.0, np.exp(min(30.0, self.bias))])  # the first token has no transition before it
        forward, v, last = [], None, -1
        for i in active:
            e = np.array([1.0, np.exp(max(-30.0, min(30.0, score[i])))])
            if v is None:
                v = e if i == 0 else (cross(start / start.sum(), i - 1, False) @ go) * e
            else:
                v = (cross(v, i - last - 1, False) @ go) * e
            v = v / v.sum()
            forward.append(v)
            last = i
        out, b, following = [], np.ones(2), n
        for i, f in zip(reversed(active), reversed(forward), strict=True):
            b = cross(b, following - i - 1, True)
            both = f * b
            if i in at:
                out.append((i, float(both[1] / both.sum())))
            e = np.array([1.0, np.exp(max(-30.0, min(30.0, score[i])))])
            b = go @ (e * b)
            b = b / b.sum()
            following = i
        return out[::-1]

    def document(self, marginals: list[tuple[int, float]], n: int) -> float:
        """Chance of a toxic document: a logistic of P(any toxic token), their expected number and share."""
        bias, a, b, c = self.scale
        z = bias + sum(x * y for x, y in zip((a, b, c), aggregate(marginals, n), strict=True))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def aggregate(marginals: list[tuple[int, float]], n: int) -> tuple[float, float, float]:
    clean, count = 1.0, 0.0
    for _, p in marginals:
        clean *= 1 - p
        count += p
    return 1 - clean, float(np.log1p(count)), float(np.sqrt(count / n)) if n else 0.0


def fit_chain(chain: Chain, slots: np.ndarray, labels: np.ndarray, ridge: float = 0.02, steps: int = 300) -> None:
    """Maximum likelihood by forward-backward on windows of WIDTH tokens, all at once (Adam steps).

    slots: windows x WIDTH x SLOTS feature numbers, -1 for none, -2 where the text has ended. Equal windows count once, by
    their number.
    """
    k, total, flat = len(chain.features), len(slots), np.hstack([slots.reshape(len(slots), -1), labels])
    flat, times = np.unique(flat, axis=0, return_counts=True)
    slots, labels, times, w = flat[:, : WIDTH * SLOTS].reshape(-1, WIDTH, SLOTS), flat[:, WIDTH * SLOTS :], times[:, None], len(flat)
    inside, has = slots[:, :, 0] > -2, (slots >= 0).any(axis=2)
    before = np.pad(has[:, :-1], ((0, 0), (1, 0)))
    after = np.pad(has[:, 1:], ((0, 0), (0, 1)))
    theta, mean, square = np.concatenate([np.zeros(k + 2), [-4.0], np.zeros(4)]), np.zeros(k + 7), np.zeros(k + 7)
    index = np.where(slots >= 0, slots, k)
    y, both = labels.astype(int), inside[:, 1:] & inside[:, :-1]
    for step in range(1, steps + 1):
        u = np.append(theta[:k], 0.0)
        s = u[index].sum(axis=2) + theta[k] * before + theta[k + 1] * after + theta[k + 2]
        e, go = np.stack([np.zeros_like(s), s], axis=2), theta[k + 3 :].reshape(2, 2)
        e[~inside] = 0
        alpha, beta = np.zeros((w, WIDTH, 2)), np.zeros((w, WIDTH, 2))
        alpha[:, 0] = e[:, 0]
        for i in range(1, WIDTH):
            step_ = np.where(both[:, i - 1, None, None], go[None], 0.0)
            alpha[:, i] = np.logaddexp(alpha[:, i - 1, 0, None] + step_[:, 0], alpha[:, i - 1, 1, None] + step_[:, 1]) + e[:, i]
        for i in range(WIDTH - 2, -1, -1):
            step_ = np.where(both[:, i, None, None], go[None], 0.0)
            x = e[:, i + 1] + beta[:, i + 1]
            beta[:, i] = np.logaddexp(step_[:, :, 0] + x[:, None, 0], step_[:, :, 1] + x[:, None, 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        off = np.where(inside, p - y, 0.0) * times
        g = np.zeros(k + 7)
        g[:k] = np.bincount(index.ravel(), np.broadcast_to(off[:, :, None], index.shape).ravel(), k + 1)[:k]
        g[k], g[k + 1], g[k + 2] = (off * before).sum(), (off * after).sum(), off.sum()
        for a in (0, 1):
            for c in (0, 1):
                pair = np.exp(alpha[:, :-1, a] + go[a, c] + e[:, 1:, c] + beta[:, 1:, c] - z[:, None])
                g[k + 3 + 2 * a + c] = (times * both * (pair - ((y[:, :-1] == a) & (y[:, 1:] == c)))).sum()
        g = g / total + ridge * theta / total * 10
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    chain.weight, chain.before, chain.after, chain.bias, chain.move = theta[:k], theta[k], theta[k + 1], theta[k + 2], theta[k + 3 :].reshape(2, 2)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, toxic = Counter(), Counter()
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = {f for t in set(TOKEN.findall(text)) for f in evidence(t)}
            docs.update(found)
            if y:
                toxic.update(found)
        if len(docs) > 500_000:
            yield _counts(docs, toxic)
            docs, toxic = Counter(), Counter()
    yield _counts(docs, toxic)


def _counts(docs: Counter, toxic: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"f": pa.array(docs.keys(), pa.string()), "n": pa.array(docs.values(), pa.int64()), "y": pa.array([toxic[f] for f in docs], pa.int64())})


def _windows(features: list[str]):
    """Windows around every token with evidence, and around the middle of texts without."""
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(features)
        for b in batches:
            rows: list[tuple] = []
            for text, y, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = TOKEN.findall(text)
                found = [lexicon[t] for t in tokens]
                hits = [i for i, f in enumerate(found) if f]
                for c in hits or ([len(tokens) // 2] if tokens else []):
                    row, mark = [], []
                    for i in range(c - REACH, c + REACH + 1):
                        own = found[i] if 0 <= i < len(found) else None
                        row += [-2] * SLOTS if own is None else [*own, *[-1] * (SLOTS - len(own))]
                        mark.append(int(bool(own and y)))
                    rows.append((row, mark, place))
                    if len(rows) == 4096:
                        yield named(rows)
            yield named(rows)

    def named(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, ["slots", "labels", "place"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_windows: int = 12_000, surprise: float = 6.5) -> Chain | None:
    """Fit on about max_labelled labelled rows, chosen by a hash of doc_id.

    docs: doc_id, text; labels: doc_id, toxic (0, 1; others and nulls are left out; of several labels
    of one document the larger counts). A feature is kept if three in five documents that have it are
    toxic, and their number is `surprise` standard deviations over chance. Four fifths of the rows train
    the chain, on about max_windows windows of all those around evidence, chosen by a hash; the rest fit
    the document score. None if there are not both classes.
    """
    long_rows(docs)
    place = F.xxhash64(F.lit(5), "doc_id")
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(about(chosen, max_labelled, "doc_id", seed=5))  # about max_labelled rows
    told = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id")
    sample = materialize(told.select("text", F.col("toxic").cast("int").alias("y"), place.alias("place")), "toxicity-sample")
    shares = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(shares) < 2:
        return None
    fit = F.pmod("place", F.lit(5)) > 0
    tally = sample.where(fit).select("text", "y").mapInArrow(_tally, "f string, n long, y long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    rate = shares[1] / sum(shares.values())
    over = (F.col("y") - rate * F.col("n")) / F.sqrt(F.lit(rate * (1 - rate)) * F.col("n"))
    kept = tally.where((over >= surprise) & (F.col("y") >= 0.6 * F.col("n"))).select("f").collect()  # bounded by the labelled rows
    chain = Chain(sorted(r.f for r in kept), np.zeros(len(kept)))
    if chain.features:
        cut = sample.where(fit).select("text", "y", "place").mapInArrow(_windows(chain.features), "slots array<int>, labels array<int>, place long")
        windows = materialize(cut, "toxicity-windows")
        got = sorted(about(windows, max_windows, "place", "slots").collect(), key=lambda r: (r.place, r.slots))  # about max_windows rows
        fit_chain(chain, np.array([r.slots for r in got], np.int32).reshape(-1, WIDTH, SLOTS), np.array([r.labels for r in got]))

    rest = sample.where(~fit).select("text", "y").mapInArrow(_aggregates(chain), "any double, count double, share double, y int").collect()
    x = np.array([(1.0, r["any"], r["count"], r["share"]) for r in rest]).reshape(-1, 4)
    y = np.array([r.y for r in rest], float)
    if len({*y}) == 2:
        chain.scale = tuple(_logistic(x, y))
    else:
        rate = (shares[1] + 0.5) / (sum(shares.values()) + 1)
        chain.scale = (float(np.log(rate / (1 - rate))) - 1, 4.0, 0.0, 0.0)
    return chain


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps; slopes are kept from turning negative so that more evidence never lowers a score."""
    live = list(range(x.shape[1]))
    while True:
        w = np.zeros(len(live))
        own = x[:, live]
        hold = np.array([1e-3 if i == 0 else ridge for i in live])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            w -= np.linalg.solve((own * (p * (1 - p) + 1e-9)[:, None]).T @ own + np.diag(hold), own.T @ (p - y) + hold * w)
        wrong = [i for i, v in zip(live, w, strict=True) if i and v < 0]
        if not wrong:
            out = np.zeros(x.shape[1])
            out[live] = w
            return out
        live = [i for i in live if i not in wrong]


def _tagged(chain: Chain):
    """Text -> (marginals of tokens with evidence, number of tokens)."""
    lexicon, powers = Lexicon(chain.features), chain.powers()

    def run(text: str | None) -> tuple[list[tuple[int, float]], int]:
        tokens = TOKEN.findall(text) if text else []
        hits = [(i, f) for i, f in enumerate(map(lexicon.__getitem__, tokens)) if f]
        return (chain.marginals(hits, len(tokens), powers) if hits else []), len(tokens)

    return run


def _aggregates(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = _tagged(chain)
        for b in batches:
            rows = [aggregate(*tag(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.float64()) for i in range(3)), b.column(1)], ["any", "count", "share", "y"])

    return run


SPAN = "array<struct<begin:int,end:int,p:double>>"


def tag(docs: DataFrame, chain: Chain | None, threshold: float = 0.7, least: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, spans) of every row of docs (doc_id, text); other columns are never read.

    spans: the offending stretches, as begin and end in code points of the text and the probability;
    runs of tokens that are toxic with probability `least` or more join to one span. Null and
    empty texts have no tokens and get the score of a text without evidence. Without a chain (no
    labels of both classes) every score is 0. Repeated rows each give a row.
    """
    few = long_rows(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagged = _tagged(chain) if chain else None
        for b in batches:
            scores, spans = [], []
            for text in b.column(1):
                text = text.as_py()
                marginals, n = tagged(text) if chain else ([], 0)
                scores.append(chain.document(marginals, n) if chain else 0.0)
                bad, own = {i: p for i, p in marginals if p >= least}, []
                if bad:
                    last = -2
                    for i, m in enumerate(TOKEN.finditer(text)):
                        if i in bad:
                            if last == i - 1:
                                own[-1] = {"begin": own[-1]["begin"], "end": m.end(), "p": max(own[-1]["p"], bad[i])}
                            else:
                                own.append({"begin": m.start(), "end": m.end(), "p": bad[i]})
                            last = i
                spans.append(own)
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    return few.mapInArrow(run, f"doc_id {few.schema['doc_id'].dataType.simpleString()}, score double, predicted int, spans {SPAN}")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores and spans of all documents, learned from labels not held out; see train() and tag()."""
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return tag(docs, chain).select("doc_id", held, "score", "predicted", "spans")
