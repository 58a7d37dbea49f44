"""Embedding whitening: exact integer scatter.

Vectors are rounded to integers, a shift is subtracted, and sums and cross-products are added up without any rounding:
each task splits its integers into limbs of 20 bits, whose products over 8,192 rows are whole numbers that doubles hold
exactly, and adds those up as Python's integers, which have no largest value. Only n * X'X - S S', formed exactly, is turned
into doubles and decomposed by eigh. Neither a large common offset nor the order of the rows can change a digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_rows, materialize, table

LIMB = 20
#: Rows of a block: 2 ** (2 * LIMB) * BLOCK is 2 ** 53, up to which doubles hold every whole number.
BLOCK = 8192
#: Integers below this are added and subtracted as 64-bit numbers, larger ones as Python's.
SAFE = 1 << 62
MOMENTS = "n long, sums array<string>, products array<string>"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers, 64-bit or Python's, as doubles: x = l[0] + l[1] * 2 ** 20 + l[2] * 2 ** 40 ..., none over 2 ** 20."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x less the shift, in Python's integers if 64 bits might not do."""
    if x.size and max(int(x.max()), -int(x.min()), *map(abs, shift)) >= SAFE:
        return x.astype(object) - np.array(shift, object)
    return x - np.array(shift, np.int64)


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of a block of at most 8,192 whole vectors, as Python's integers."""
    parts = limbs(y)
    whole = lambda f: f.astype(np.int64).astype(object)
    sums = sum(whole(p.sum(0)) << (LIMB * i) for i, p in enumerate(parts))
    products = sum(whole(p.T @ q) << (LIMB * (i + j)) for i, p in enumerate(parts) for j, q in enumerate(parts))
    return sums, products


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as rows of d numbers; shorter ones end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(vectors), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def whole_vectors(embeddings: DataFrame, vector: str = "embedding", scale: float = 256.0) -> tuple[Column, Column]:
    """(keep, x): whether a vector is there with none but finite entries, and its entries as floor(scale * c).

    Numbers beyond a long become the nearest long.
    """
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(vector).isNotNull() & finite, F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("bigint"))


class Whitening:
    """Shift, exact moments and components of a list of whole vectors.

    n vectors with sums `sums` and cross-products `products` after the shift is subtracted; `values` are the eigenvalues, falling,
    and `components` the unit eigenvectors, as columns, of their covariance. Components that the vectors do not span are left out:
    those with an eigenvalue of d * 2 ** -52 times the largest or less.
    """

    def __init__(self, shift: list[int], n: int, sums: np.ndarray, products: np.ndarray, most: int) -> None:
        self.d, self.shift, self.n, self.sums = len(shift), shift, n, sums
        self.scatter = n * products - np.outer(sums, sums)  # exact
        covariance = np.array([[int(v) / (n * n) for v in row] for row in self.scatter]).reshape(self.d, self.d)
        values, vectors = np.linalg.eigh(covariance)
        good = values > max(values, default=0.0) * self.d * np.finfo(float).eps
        self.values, self.components = values[good][::-1][:most], vectors[:, good][:, ::-1][:, :most]
        self.explained = self.values / (sum(int(self.scatter[i][i]) for i in range(self.d)) / (n * n)) if self.d else self.values

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened coordinates of whole vectors, and the sums of squares of n * x - S, exact."""
        y = shifted(x, self.shift)
        largest = self.n * max((int(y.max()), -int(y.min())), default=0) if y.size else 0
        most = largest + max((abs(int(s)) for s in self.sums), default=0)
        if most >= SAFE:
            off = self.n * y.astype(object) - self.sums
        else:
            off = self.n * y - self.sums.astype(np.int64)
        small = self.d * most * most < SAFE
        squares = (off * off if small else off.astype(object) ** 2).sum(1)
        return (off.astype(float) / self.n) @ (self.components / np.sqrt(self.values)), [int(v) for v in squares]


def moments(vectors: DataFrame, shift: list[int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross-products) of a DataFrame of one column of whole vectors, after the shift is subtracted.

    A row of d * d numbers a task; the root of so many tasks add these up, and the driver adds theirs.
    """
    d = len(shift)
    empty = lambda: [0, np.zeros(d, object), np.zeros((d, d), object)]

    def row(total: list) -> pa.RecordBatch:
        n, sums, products = total
        texts = lambda a: pa.array([[str(v) for v in a.ravel()]], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), texts(sums), texts(products)], ["n", "sums", "products"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty()
        for b in batches:
            x = matrix(b.column(0), d)
            for at in range(0, len(x), BLOCK):
                sums, products = scatter(shifted(x[at : at + BLOCK], shift))
                total[1], total[2] = total[1] + sums, total[2] + products
            total[0] += len(x)
        yield row(total)

    def add(total: list, n: int, sums: list[str], products: list[str]) -> None:
        total[0] += n
        total[1] = total[1] + np.array([int(v) for v in sums], object)
        total[2] = total[2] + np.array([int(v) for v in products], object).reshape(d, d)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty()
        for b in batches:
            for r in b.to_pylist():
                add(total, r["n"], r["sums"], r["products"])
        yield row(total)

    tasks = max(1, vectors.rdd.getNumPartitions())
    total = empty()
    for r in vectors.mapInArrow(part, MOMENTS).repartition(ceil(sqrt(tasks))).mapInArrow(merge, MOMENTS).collect():
        add(total, r.n, r.sums, r.products)
    return total[0], total[1], total[2]


def fit(vectors: DataFrame, d: int, most: int = 4) -> Whitening | None:
    """The whitening of a DataFrame of one column of whole vectors, of d entries at most; None without vectors."""
    first = vectors.first()
    if first is None:
        return None
    shift = [int(v) for v in first[0]] + [0] * (d - len(first[0]))
    return Whitening(shift, *moments(vectors, shift), most)


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows (keys..., x) with (deviation, deviation_exact, whitened) for x."""
    *keys, _ = rows.columns
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            white, squares = model.project(matrix(b.column(len(keys)), model.d))
            flat = pa.array(white.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * white.shape[1], pa.int32()), flat)
            longs = pa.array([v if v < 1 << 63 else None for v in squares], pa.int64())
            columns = [*b.columns[: len(keys)], longs, pa.array(map(str, squares), pa.string()), lists]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "deviation", "deviation_exact", "whitened"])

    return long_rows(rows).mapInArrow(run, f"{kinds}{', ' if kinds else ''}deviation long, deviation_exact string, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors, less the identity."""
    k = len(model.values)
    white = projected(vectors, model).select(*(F.col("whitened")[i].alias(f"w{i}") for i in range(k)))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in cells)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, cells, strict=True))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, most: int = 4) -> DataFrame:
    """Whitened coordinates of all vectors on the leading components of the different ones.

    Returns (key, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each row that has a vector
    with none but finite entries and each component, `most` at most, numbered from 1 by falling eigenvalue. n counts the
    different vectors, each of which counts once for sums and covariance.

    Null vectors, and those with a null, infinite or NaN entry, give no row; null keys and repeated rows stay. Shorter vectors
    end in zeros up to the longest, empty ones are zeros. Entries beyond a long after scaling become the nearest long. deviation is
    null where it exceeds a long, deviation_exact has its digits always. A component that the vectors do not span has no rows, so
    a table with one different vector at most, or without entries, gives an empty result. Other columns are not read.
    The matrix of d * d numbers is decomposed by the driver: its size depends on the vectors' length alone.
    """
    keep, x = whole_vectors(embeddings, vector, scale)
    rows = embeddings.where(keep).select(F.col(key).alias("vec_id"), x.alias("x"))
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size("x")))
    different = materialize(rows.select(padded.alias("x")).distinct(), "whole-vectors")
    model = fit(different, d, most) if d else None
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], out.format(rows.schema["vec_id"].dataType.simpleString())).withColumnRenamed("vec_id", key)
    error = identity_error(different, model)
    shares = F.array(*map(F.lit, model.explained.tolist()))
    found = projected(rows, model).select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        F.col("vec_id").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
