"""Whitening of embeddings by distributed block matrices.

Centred rows are numbered and dealt into blocks (``BlockMatrix``); the transpose times the blocks is the scatter
matrix, which is split into eigenvectors where the driver runs (d x d numbers, whatever the number of rows); the blocks
times the whitening matrix are the projected rows. Only the scatter matrix and one number for each partition reach the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage, unstage

#: Bytes of a block of rows, as long as there are no more than ``BLOCKS`` of them: then blocks grow, as their places are listed on the driver.
BLOCK_BYTES, BLOCKS = 2 << 20, 100_000
#: Columns of a block.
BLOCK_COLUMNS = 1024
#: A component whose share of the variance is no larger has none.
NO_SHARE = 1e-13
#: Whole numbers are kept within this, either way, so that sums stay exact.
MOST = 1 << 52


def whole(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of each entry, as longs; null if the vector is null, or holds a null or a number that isn't finite."""
    v = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    entry = lambda c: F.greatest(F.least(F.floor(c * scale).cast("double"), F.lit(float(MOST))), F.lit(float(-MOST))).cast("long") + F.lit(shift)
    return F.when(finite, F.transform(v, entry))


def blocks_of(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """``rows(index, v)``, ``n`` of them with ``d`` doubles each, as blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("index"), array_to_vector("v").alias("vector")), "vector")
    per_block = max(1, BLOCK_BYTES // (8 * d), -(-n // BLOCKS))
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(per_block, min(d, BLOCK_COLUMNS))


def scatter(blocks: BlockMatrix, n: int) -> np.ndarray:
    """The sum of the outer products of the rows. Row blocks are multiplied in as many tasks as there are partitions and their products added up before and after the shuffle."""
    left = blocks.transpose()
    tasks = max(1, min(-(-n // blocks.rowsPerBlock), blocks.blocks.getNumPartitions()))
    # The middle dimension, that of the rows, is split: without it one task would get all blocks.
    product = left._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, tasks)
    total = BlockMatrix(product, left.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()
    return (total + total.T) / 2


def _unblocked(per_block: int):
    def run(batches):
        for batch in batches:
            for block, height, values in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.frombuffer(values).reshape(-1, height).T  # columns first
                index = block * per_block + np.arange(height)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(height + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), flat], ["index", "w"])

    return run


def rows_of(blocks: BlockMatrix) -> DataFrame:
    """``(index, w)`` of a matrix that is one block wide. (Spark's own way back counts rows in 32 bits.)"""
    cut = blocks.blocks.map(lambda b: (b[0][0], b[1].numRows, bytearray(np.ascontiguousarray(b[1].toArray().T).tobytes())))
    return cut.toDF("block long, height int, values binary").mapInArrow(_unblocked(blocks.rowsPerBlock), "index long, w array<double>")


def _sums(table: DataFrame, column: str, d: int, kind: str) -> list:
    """Sum of each of ``d`` dimensions."""
    found = table.select(F.posexplode(column).alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast(kind)).alias("s")).collect()  # d rows
    out = [0] * d
    for r in found:
        out[r.k] = r.s
    return out


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)`` that has components: ``vec_id, n, deviation, whitened, explained, identity_error``.

    Entries become whole numbers first (``whole``). The fit list holds each distinct vector once: ``n`` of them, with sums S by dimension.
    ``deviation``, decimal(38,0): sum over dimensions of (n * x - S)^2, exact (null if it doesn't fit). ``whitened``, an array: (x - S / n) on the
    leading unit eigenvectors of the fit list's covariance (divisor n), over the root of the eigenvalue; ``explained``, an array: eigenvalues over their sum;
    ``identity_error``: largest entry, without sign, of the covariance of the fit list's ``whitened`` minus the identity.

    - Rows whose vector is null, empty, or holds a null or a number that isn't finite are dropped. Entries beyond +-2^52 count as that.
    - Vectors of each length are a table of their own, with a fit list of their own.
    - Components without variance (a single distinct vector, fewer vectors than dimensions) are null in ``whitened`` and 0 in ``explained``; ``identity_error``
      is of the others, 0 if there are none. Equal eigenvalues leave the choice of their eigenvectors open, as is the sign of any.
    - Null and repeated vec_ids and repeated rows stay, each with its row; other columns are ignored. Empty in, empty out.
    """
    rows = vectors.select("vec_id", whole(F.col("embedding"), scale, shift).alias("x")).where("size(x) > 0")
    rows = stage(rows, "whitening-rows")
    lengths = [r.d for r in rows.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()]
    parts = [_whiten(rows.where(F.size("x") == d), d, min(components, d)) for d in lengths]
    empty = "vec_id {}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], empty.format(rows.schema["vec_id"].dataType.simpleString()))


def _whiten(rows: DataFrame, d: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    fit, n = numbered(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "whitening-fit")
    total = F.lit([str(s) for s in _sums(fit, "x", d, "decimal(19,0)")]).cast("array<decimal(38,0)>")
    # n * x - S is whole, and may need more than 63 bits; one division gives the centred entry.
    wide = F.zip_with("x", total, lambda x, s: x.cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)") - s)
    squares = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda s, c: F.try_add(s, F.try_multiply(c, c).cast("decimal(38,0)")).cast("decimal(38,0)"))
    centred = stage(fit.select("index", "x", squares.alias("deviation"), F.transform(wide, lambda c: c.cast("double") / F.lit(float(n))).alias("v")), "whitening-centred")
    unstage(fit)
    blocks = blocks_of(centred, n, d)
    values, axes = np.linalg.eigh(scatter(blocks, n) / n)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    share = values[:k] / values.sum() if values.sum() > 0 else np.zeros(k)
    real = share > NO_SHARE
    by = np.where(real, axes[:, :k] / np.sqrt(np.where(real, values[:k], 1)), 0)
    tall = min(d, BLOCK_COLUMNS)
    cut = [((i // tall, 0), Matrices.dense(len(by[i : i + tall]), k, by[i : i + tall].T.ravel().tolist())) for i in range(0, d, tall)]
    whitener = BlockMatrix(spark.sparkContext.parallelize(cut, len(cut)), tall, k, d, k)
    projected = stage(rows_of(blocks.multiply(whitener)), "whitening-projected")

    means = np.array(_sums(projected, "w", k, "double")) / n
    level = projected.select("index", F.zip_with("w", F.lit(means.tolist()), lambda w, m: w - m).alias("v"))
    spread = scatter(blocks_of(level, n, k), n) / n
    error = float(np.abs(spread - np.eye(k))[np.ix_(real, real)].max(initial=0.0))
    shown = F.zip_with("w", F.lit(real.tolist()), lambda w, ok: F.when(ok, w))
    found = centred.join(projected, "index").select("x", "deviation", shown.alias("whitened"))
    # Rows of one vector that is very common are one key on the left: Spark splits such a partition, the right holds a row for each key.
    out = rows.join(found, "x")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit([float(s) if r else 0.0 for s, r in zip(share, real)]).alias("explained"), F.lit(error).alias("identity_error"))
