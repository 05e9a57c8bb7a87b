"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, so counts, sums and deviations are exact. The rows, less
their means, are the matrix X. From a random right vector v, products u = Xv and z = Xᵀu
alternate; both sides are made orthogonal to all vectors before them, and what remains is
a small upper bidiagonal matrix whose singular vectors give X's.

X is never moved: rows are staged as packed blocks, and one pass over them makes a whole
step. A left vector has an entry for each row, so it is kept as the weights w of X's columns
that make it, u = Xw. A pass works out p = Xy, its products with all left vectors, and
Xᵀp; as products with the left vectors are known from their own passes, p's correction is
made afterwards without another one. What a task gives back are a few numbers for each
dimension.

Steps go on until the wanted components stand still to double precision, or all
dimensions are used. One start vector finds one vector of each repeated singular
value, and none that it is orthogonal to. So the matrix without what was found is gone
through again from a new start, until it holds nothing larger than what is kept.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
dropped, and so are those of another length than most have (of equal numbers, the larger
length); repeated rows and ids count and come back as often as they stand there; null ids come back;
components without variance (below `LEAST_PART` of the trace) are left out, so a table of one
row or of equal rows gives no rows, like an empty one; entries are held
within `LIMIT` after scaling, and a deviation beyond a long is null. Ties of eigenvalues come back in
any basis of their space. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from wharfline.llm.common import discard, stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries are held within this after scaling, so that sums of a block fit a long.
LIMIT = float(1 << 50)
#: Rows of a packed block.
BLOCK = 4096
#: A triplet stands still when its residual is below this part of the largest singular value.
STILL = 1e-14
#: Partial sums of more tasks than this are added up by tasks before they come to the driver.
PARTIALS = 256
#: Components with less of the trace are left out.
LEAST_PART = 1e-12


class Fit(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray  # a row each
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int


def whole_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """rows with `_x`, the whole numbers of their vector, without rows that have none or another length than most."""
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + SHIFT
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == math.inf)
    found = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad)).withColumn("_x", F.transform(vector_col, entry))
    sizes = found.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("_x") == (sizes["d"] if sizes else 0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(0)
        d = len(x[0]) if len(x) else 0
        values = x.flatten().to_numpy().astype("<i8")
        parts = [values[k : k + BLOCK * d] for k in range(0, len(values), BLOCK * d)] if d else []
        sums = [p.reshape(-1, d).sum(axis=0).tolist() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([len(p) // d for p in parts], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["block", "n", "sums"])


def _pass(batches: Iterator[pa.RecordBatch], mean: np.ndarray, right: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the rows x of (x right)ᵀ(x left) and (x right)ᵀx, where right and left are columns of weights."""
    total = np.zeros((right.shape[1], left.shape[1] + len(mean)))
    for batch in batches:
        for block in batch.column(0):
            x = np.frombuffer(block.as_py(), "<i8").reshape(-1, len(mean)) - mean
            p = x @ right
            total += np.hstack([p.T @ (x @ left), p.T @ x])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])


def _squares(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = sum(float(np.square(np.frombuffer(block.as_py(), "<i8").reshape(-1, len(mean)) - mean).sum()) for batch in batches for block in batch.column(0))
    yield pa.RecordBatch.from_arrays([pa.array([np.float64(total).tobytes()])], ["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.frombuffer(x.as_py()) for batch in batches for x in batch.column(0)]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()])], ["sums"])


class Matrix:
    """The centred rows, by products that sum over all of them."""

    def __init__(self, blocks: DataFrame, mean: np.ndarray) -> None:
        self.blocks, self.mean, self.passes = blocks, mean, 0
        self.tasks = blocks.rdd.getNumPartitions()

    def _total(self, each) -> np.ndarray:  # noqa: ANN001
        self.passes += 1
        out = self.blocks.select("block").mapInArrow(each, "sums binary")
        if self.tasks > PARTIALS:
            out = out.repartition(PARTIALS // 16).mapInArrow(_added, "sums binary")
        return np.sum([np.frombuffer(r.sums) for r in out.collect()], axis=0)

    def sums(self, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(X right)ᵀ(X left) and (X right)ᵀX."""
        total = self._total(partial(_pass, mean=self.mean, right=right, left=left)).reshape(right.shape[1], -1)
        return total[:, : left.shape[1]], total[:, left.shape[1] :]

    def squares(self) -> float:
        return float(self._total(partial(_squares, mean=self.mean))[0])


def _orthogonal(z: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):  # twice is enough
        for basis in bases:
            z = z - basis @ (basis.T @ z)
    return z


def bidiagonalise(x: Matrix, wanted: int, known: np.ndarray, seed: int, above: float = 0.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Up to `wanted` singular values of X on what is orthogonal to the columns of `known`, falling, their right vectors as columns, and whether all
    dimensions are used. Stops when they stand still, or when the largest is sure to stay a millionth below `above`."""
    d = len(x.mean)
    v = _orthogonal(np.random.default_rng(seed).standard_normal(d), known)
    v /= np.linalg.norm(v)
    vs, ws, zs = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # right vectors, weights of left vectors u, Xᵀu
    alphas, betas, y = [], [], v
    while True:
        products, (z,) = x.sums(y[:, None], np.hstack([ws, y[:, None]]))
        c = products[0, :-1]  # p is made orthogonal to the left vectors by taking their part Uc away
        alpha = math.sqrt(max(products[0, -1] - c @ c, 0.0))
        vs = np.hstack([vs, v[:, None]])
        if alpha <= 1e-13 * max([alpha, *alphas]):
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = (y - ws @ c) / alpha, (z - zs @ c) / alpha
        ws, zs = np.hstack([ws, w[:, None]]), np.hstack([zs, z[:, None]])
        alphas.append(alpha)
        rest = _orthogonal(z, vs, known)
        beta = float(np.linalg.norm(rest))
        left, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        k = min(wanted, len(values))
        residuals = beta * np.abs(left[-1, :k])
        every = vs.shape[1] + known.shape[1] >= d
        still = len(values) >= wanted and (residuals <= STILL * values[0]).all()
        low = above and residuals[0] <= 1e-3 * above and values[0] + residuals[0] < above * (1 - 1e-6)
        if every or still or low or beta <= 1e-13 * values[0]:
            return values[:k], vs @ right[:k].T, every
        v = rest / beta
        betas.append(beta)
        y = v - beta * w


def _largest(x: Matrix, basis: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of X within the space of some orthonormal columns."""
    within = x.sums(basis, basis)[0]
    squares, turned = np.linalg.eigh((within + within.T) / 2)
    order = np.argsort(-squares)[:wanted]
    return np.sqrt(np.maximum(squares[order], 0)), basis @ turned[:, order]


def singular(x: Matrix, wanted: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest singular values of X and their right vectors; trace: the sum of all squares."""
    values, vectors, every = bidiagonalise(x, wanted, np.zeros((len(x.mean), 0)), 0)
    seed = 0
    while not every and vectors.shape[1] < len(x.mean):
        full = len(values) >= wanted
        if full and trace - values @ values <= values[-1] ** 2 * (1 - 1e-6):
            break  # what is left in all is less than the least one kept
        seed += 1
        more, found, _ = bidiagonalise(x, 1 if full else wanted, vectors, seed, float(values[-1]) if full else 0.0)
        if more[0] <= (values[-1] * (1 + 1e-9) if full else 1e-13 * values[0]):
            break
        values, vectors = _largest(x, np.linalg.qr(np.hstack([vectors, found]))[0], wanted)
    return values, vectors


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit over staged blocks; None without rows."""
    dims = blocks.select("n", F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("k").collect()
    if not dims:  # else a row for each dimension
        return None
    n, sums = dims[0]["n"], [int(r["s"]) for r in dims]
    x = Matrix(blocks, np.array([s / n for s in sums]))
    trace = x.squares()
    values, vectors = singular(x, min(components, len(sums)), trace) if trace else (np.zeros(0), np.zeros((len(sums), 0)))
    keep = values**2 > LEAST_PART * trace
    values, vectors = values[keep], vectors[:, keep]
    white = vectors / values * math.sqrt(n)
    error = float(np.abs(x.sums(white, white)[0] / n - np.eye(len(values))).max()) if len(values) else 0.0
    return Fit(n, sums, vectors.T, values**2 / n, trace / n, error, x.passes)


def _whitened(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, found: Fit) -> Iterator[pa.RecordBatch]:
    mean, sums = np.array([s / found.n for s in found.sums]), np.array([s & (1 << 64) - 1 for s in found.sums], np.uint64).view(np.int64)
    turned, k = found.components.T / np.sqrt(found.eigenvalues), len(found.eigenvalues)
    for batch in batches:
        if not len(batch) or not k:
            continue
        x = batch.column("_x").flatten().to_numpy().reshape(len(batch), -1)
        about = np.square((x - mean) * found.n).sum(axis=1)
        exact = np.square(found.n * x - sums).sum(axis=1).tolist()  # wraps only where it is beyond a long
        for row in np.flatnonzero(about > 1e18).tolist():
            exact[row] = sum((found.n * a - s) ** 2 for a, s in zip(x[row].tolist(), found.sums, strict=True))
        deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64()).take(pa.array(np.repeat(np.arange(len(batch)), k)))
        tiled = [np.tile(v, len(batch)) for v in (np.arange(1, k + 1, dtype=np.int32), found.eigenvalues / found.trace)]
        ids = batch.column("_id").cast(id_type).take(pa.array(np.repeat(np.arange(len(batch)), k)))
        constant = [pa.array(np.full(k * len(batch), v)) for v in (found.n, found.identity_error)]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(tiled[0]), constant[0], deviation, pa.array(((x - mean) @ turned).ravel()), pa.array(tiled[1]), constant[1]],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: id, component from 1, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema[id_col].dataType
    whole = stage(whole_vectors(rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), "_v").select("_id", "_x"), "whole-vectors")
    blocks = stage(whole.select("_x").mapInArrow(_packed, "block binary, n long, sums array<long>"), "vector-blocks")
    found = fit(blocks, components)
    discard(blocks)
    numbers = [StructField(c, LongType()) for c in ("n", "deviation")] + [StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]
    schema = StructType([StructField("id", kind), StructField("component", IntegerType()), *numbers])
    if found is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return whole.mapInArrow(partial(_whitened, id_type=to_arrow_type(kind), found=found), schema).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
