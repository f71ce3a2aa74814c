"""PCA whitening of embeddings from an exact scatter matrix.

An entry c becomes the integer x = floor(64 c) + 1000000. The scatter (the sum over rows of x times its
transpose) is exact: every task multiplies its rows modulo several primes, in blocks small enough that a
product of doubles loses nothing; the residues are summed over tasks, and the matrix is put together from
them by the Chinese remainder theorem. Sums are exact, too, so the covariance is one division away from an
exact fraction. Its eigenvectors are found on the driver in double precision (``eigh``), whose input is
dimension x dimension whatever the number of rows; with several primes that is what limits the dimension
(1024: some 40 MB). Projections are centred in integers before they are multiplied.

Three passes over the table: count, sums and largest entry; residues; results. Between them the covariance of
what is returned is taken, centred on each task's mean, and merged from the tasks' parts.

Cases: rows whose vector is null, or holds null or non-finite entries, are dropped; equal vectors and repeated
rows count each. Empty vectors have no dimension: they give no rows and aren't counted. All others must have one
length, and entries for which x is no long of 61 bits are an error, too. A component without variance (more
dimensions than rows, constant ones) has whitened null, explained 0 and isn't part of identity_error; if no
component has any, explained and identity_error are null. An empty table gives an empty result. The deviation is a
decimal of 38 digits; more is an error. Columns other than key and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import materialise

SCALE, SHIFT = 64, 1_000_000
#: Bits of a prime, and rows of a block: a block's sum of products stays below 2 ** 53.
PRIME_BITS, BLOCK = 20, 4096
LARGEST = 1 << 61
#: An eigenvalue of at most this share of the largest, for each dimension, is none.
NOISE = np.finfo(float).eps
COMPONENTS = 32


def primes(product: int) -> list[int]:
    """The largest primes below 2 ** PRIME_BITS, as many as their product takes to exceed a number."""
    out, p, reached = [], 1 << PRIME_BITS, 1
    while reached <= product:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            reached *= p
    return out


def chinese(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The numbers (as Python's) between minus and plus half the product of moduli that leave these residues, a row a modulus."""
    product = 1
    for p in moduli:
        product *= p
    total = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total += (r % p).astype(object) * (rest * pow(rest, -1, p))
    total %= product
    return np.where(total > product // 2, total - product, total)


def integers(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries.astype(np.float64) * SCALE).astype(np.int64) + SHIFT


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, x) in blocks of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vectors = part.column(1)
            yield part.column(0), integers(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def usable(df: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(key, vector) of the rows that remain and have entries."""
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.select(F.col(key).alias("key"), F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull()).where(finite & (F.size("vector") > 0))


@dataclass
class Fit:
    """What the rows' integers amount to: n, their sums, and the eigenvectors and eigenvalues of their covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > NOISE * len(self.sums) * max(self.values.max(initial=0.0), 0.0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n as doubles, and of each row the sum of (n x - S) squared. Integers until the last division."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [s - self.n * c for s, c in zip(self.sums, near, strict=True)]
        y = x - np.array(near, np.int64)
        bound = (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, len(self.sums))
        if bound < 1 << 62:
            deviation = ((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        else:
            deviation = ((self.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
        return y - np.array([r / self.n for r in rest]), deviation

    def whitened(self, centred: np.ndarray, components: int) -> np.ndarray:
        live = self.live[:components]
        out = np.full((len(centred), min(components, len(self.sums))), np.nan)
        out[:, live] = centred @ self.vectors[:, :components][:, live] / np.sqrt(self.values[:components][live])
        return out


def scatter(rows: DataFrame, moduli: list[int], dimension: int) -> np.ndarray:
    """Residues (modulus, i, j) of the sum over rows of x x^T. A task gives a row for each modulus and i."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(moduli), dimension, dimension), np.int64), False
        for _, x in _matrices(batches):
            seen = True
            for k, p in enumerate(moduli):
                r = (x % p).astype(np.float64)
                total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        for k in range(len(moduli) if seen else 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dimension, k, np.int32)), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(list(total[k]), pa.list_(pa.int64()))], ["k", "i", "r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one (k, i) follow each other; a running sum of each is all that is held."""
        at, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["k", "i", "r"])
        for batch in batches:
            found = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for here, r in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), found, strict=True):
                if here != at:
                    if at:
                        yield row()
                    at, total = here, np.zeros(dimension, np.int64)
                total = (total + r) % moduli[here[0]]
        if at:
            yield row()

    kind = "k int, i int, r array<long>"
    merged = rows.mapInArrow(part, kind).repartition("k", "i").sortWithinPartitions("k", "i").mapInArrow(merge, kind)
    out = np.zeros((len(moduli), dimension, dimension), np.int64)
    for k, i, r in merged.collect():
        out[k, i] = r
    return out


def fit(rows: DataFrame) -> Fit | None:
    """From usable rows (key, vector); None without any."""
    shape = rows.select(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.max(F.array_max(F.transform("vector", lambda e: F.abs(F.floor(e.cast("double") * SCALE).cast("double") + SHIFT)))).alias("most")).first()
    if not shape.n:
        return None
    if shape.low != shape.high:
        raise ValueError(f"vectors of {shape.low} to {shape.high} entries")
    if shape.most >= LARGEST:
        raise ValueError("an entry is too large to become a long")
    d = shape.high
    largest = int(shape.most) + 1
    # A row of ones beside x: its products with x are the sums, of the same exact kind.
    moduli = primes(2 * shape.n * max(largest, 1) ** 2)
    lined = rows.select("key", F.concat(F.transform("vector", lambda e: e.cast("double")), F.array(F.lit((1.0 - SHIFT) / SCALE))).alias("vector"))
    full = chinese(scatter(lined, moduli, d + 1), moduli)
    sums, n = [int(s) for s in full[d, :d]], int(full[d, d])
    of = np.array(sums, object)
    exact = n * full[:d, :d] - np.outer(of, of)
    covariance = np.array([[v / (n * n) for v in line] for line in exact.tolist()], np.float64)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
    return Fit(n, sums, vectors[:, ::-1], values[::-1], trace)


def identity_error(rows: DataFrame, model: Fit, components: int) -> float | None:
    """The largest absolute entry of (covariance of the whitened rows minus the identity), over components with variance."""
    live = np.flatnonzero(model.live[:components])
    m = len(live)
    if not m:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's count, mean and centred scatter, merged block by block."""
        n, mean, total = 0, np.zeros(m), np.zeros((m, m))
        for _, x in _matrices(batches):
            w = model.whitened(model.centred(x)[0], components)[:, live]
            own = w.mean(axis=0)
            apart, both = own - mean, n + len(w)
            total += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * len(w) / both)
            mean, n = mean + apart * (len(w) / both), both
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean], pa.list_(pa.float64())), pa.array([total.ravel()], pa.list_(pa.float64()))], ["n", "mean", "total"])

    parts = materialise(rows.mapInArrow(part, "n long, mean array<double>, total array<double>"), "parts")
    means = dict(parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(F.sum(F.col("n") * F.col("m"))).collect())
    centre = F.array(*(F.lit(means[i] / model.n) for i in range(m)))
    apart = parts.select("n", "total", F.zip_with("mean", centre, lambda a, b: a - b).alias("e"))
    entry = F.element_at("total", F.col("at") + 1) + F.col("n") * F.element_at("e", F.expr(f"at div {m} + 1").cast("int")) * F.element_at("e", F.col("at") % m + 1)
    entries = apart.select("*", F.explode(F.sequence(F.lit(0), F.lit(m * m - 1))).alias("at")).select("at", entry.alias("v")).groupBy("at").agg(F.sum("v").alias("v"))
    identity = F.when(F.expr(f"at div {m} = at % {m}"), 1.0).otherwise(0.0)
    return entries.agg(F.max(F.abs(F.col("v") / model.n - identity))).first()[0]


def whiten(df: DataFrame, key: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of df and component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(df, key, vector_col)
    model = fit(rows)
    if model is None:
        return rows.where("false").select("key", F.explode("vector").alias("e")).select("key", *(F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", ")[1:]))).withColumnRenamed("key", key)
    error = identity_error(rows, model, components)
    m = min(components, len(model.sums))
    explained = [None if not model.trace else float(v / model.trace) if alive else 0.0 for v, alive in zip(model.values[:m], model.live[:m], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _matrices(batches):
            centred, deviation = model.centred(x)
            w = model.whitened(centred, components)
            rows_of = np.repeat(np.arange(len(x)), m)
            every = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(len(rows_of), np.int64)))
            columns = [keys.take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), every(model.n, pa.int64())]
            columns += [pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(rows_of)), pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(explained * len(x), pa.float64()), every(error, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
