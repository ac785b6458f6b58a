"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, rows are packed into blocks of the narrowest integer type, and every step is one pass of
matrix-vector products over the blocks: X v for the centred rows, and X^T of the result, summed over all tasks.
A left vector has an entry per row, but as it lies in the span of X it is held as the d numbers w with u = X w; its
products with earlier left vectors follow from X^T u, so both sides are orthogonalised in full on vectors of d
numbers. The singular value decomposition of the small bidiagonal matrix gives components and deviations.
"""
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from headwise.llm.common import fields, write_and_read

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096
#: Entries beyond this are taken as this, so that sums stay exact.
LARGEST = 2.0 ** 52
#: Left and right vectors shorter than this part of the whole are taken as zero.
BREAKDOWN = 1e-10
#: Components of a smaller part of the largest deviation are rounding errors.
LEAST_DEVIATION = 1e-8

_LOW = np.int64((1 << 26) - 1)


def usable(embeddings, vector):
    """vec_id and vector (doubles) of the rows whose vector is whole: not null, and without null or non-finite entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fields(embeddings, "vec_id", vector).select("vec_id", F.col(vector).cast("array<double>").alias(vector)).filter(
        F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select("vec_id", F.col(vector).alias("vector"))


def _narrow(values):
    for kind in (np.int8, np.int16, np.int32):
        info = np.iinfo(kind)
        if values.size and values.min() >= info.min and values.max() <= info.max:
            return values.astype(kind)
    return values


def integer_blocks(rows, width):
    """Blocks of rows: vec_ids, base and body (int64 middle of each dimension and what is left, as bytes) and exact sums.

    A shorter vector counts as followed by zeros. The sums of a dimension come as those of its high and its low part.
    """
    kind = rows.schema["vec_id"].dataType.simpleString()

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = part.column("vector")
                lengths = np.diff(vectors.offsets.to_numpy())
                entries = vectors.flatten().to_numpy(zero_copy_only=False)
                x = np.full((part.num_rows, width), SHIFT, np.int64)
                filled = np.arange(width) < lengths[:, None]
                x[filled] = np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST).astype(np.int64) + SHIFT
                base = x.min(axis=0) // 2 + x.max(axis=0) // 2
                body = _narrow(x - base)
                yield pa.RecordBatch.from_pydict({
                    "vec_ids": pa.array([part.column("vec_id").to_pylist()], pa.list_(part.column("vec_id").type)),
                    "n": pa.array([part.num_rows], pa.int64()),
                    "base": pa.array([base.tobytes()], pa.binary()),
                    "type": pa.array([body.dtype.char], pa.string()),
                    "body": pa.array([body.tobytes()], pa.binary()),
                    "high": pa.array([(x >> 26).sum(axis=0)], pa.list_(pa.int64())),
                    "low": pa.array([(x & _LOW).sum(axis=0)], pa.list_(pa.int64())),
                })

    return rows.mapInArrow(
        blocks, f"vec_ids array<{kind}>, n long, base binary, type string, body binary, high array<long>, low array<long>")


def _summed(frame, column):
    """Sums over all rows of an array column, place by place: as many rows as places reach the driver."""
    sums = frame.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total")).collect()
    return [r.total for r in sorted(sums, key=lambda r: r.at)]


class _Blocks:
    """Products with the centred rows of all blocks."""

    def __init__(self, frame, n, sums):
        self.frame, self.n, self.sums, self.width = frame, n, sums, len(sums)

    @staticmethod
    def open(batch, n, sums):
        """Per block: index in the batch, its integers, and what the exact mean leaves of its base."""
        width = len(sums)
        for i in range(batch.num_rows):
            base = np.frombuffer(batch.column("base")[i].as_py(), np.int64)
            body = np.frombuffer(batch.column("body")[i].as_py(), np.dtype(batch.column("type")[i].as_py()))
            left = [n * int(b) - s for b, s in zip(base, sums)]
            yield i, body.reshape(-1, width), left

    def _pass(self, per_block, size):
        n, sums = self.n, self.sums

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for _, body, left in _Blocks.open(batch, n, sums):
                    per_block(body.astype(float) + np.array([float(Fraction(x, n)) for x in left]), total)
            yield pa.RecordBatch.from_pydict({"values": pa.array([total], pa.list_(pa.float64()))})

        return np.array(_summed(self.frame.select("base", "type", "body").mapInArrow(run, "values array<double>"), "values"))

    def squares(self):
        """The sum of all squared centred entries."""
        def add(rows, total):
            total[0] += np.vdot(rows, rows)

        return float(self._pass(add, 1)[0])

    def product(self, w):
        """X^T (X w), and the squared length of X w."""
        def add(rows, total):
            u = rows @ w
            total[:-1] += rows.T @ u
            total[-1] += u @ u

        sums = self._pass(add, self.width + 1)
        return sums[:-1], float(sums[-1])

    def covariance(self, projection):
        """Covariance (divisor n) of the projected rows."""
        k = projection.shape[1]

        def add(rows, total):
            y = rows @ projection
            total[:k] += y.sum(axis=0)
            total[k:] += (y.T @ y).ravel()

        sums = self._pass(add, k + k * k) / self.n
        return sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])


def bidiagonalise(product, width, norm, seed=0):
    """Right vectors V (columns) and upper bidiagonal B with X V = U B, for an orthonormal U that is not formed.

    ``product(w)`` gives X^T X w and the squared length of X w; ``norm`` is the Frobenius norm of X. Where the
    sequence breaks off in an invariant subspace it goes on with a new vector orthogonal to all earlier ones, so
    repeated and zero singular values are found, too.
    """
    random = np.random.default_rng(seed)
    rights, coefficients, images = np.zeros((width, width)), np.zeros((width, width)), np.zeros((width, width))
    alphas, betas = np.zeros(width), np.zeros(width)

    def orthogonal(v, k):
        for _ in range(2):
            v = v - rights[:, :k] @ (rights[:, :k].T @ v)
        return v

    v = random.standard_normal(width)
    for j in range(width):
        rights[:, j] = v / np.linalg.norm(v)
        # Less the part of X v that lies along earlier left vectors: u_i . X v = (X^T u_i) . v.
        w = rights[:, j] - coefficients[:, :j] @ (images[:, :j].T @ rights[:, j])
        image, square = product(w)
        alphas[j] = math.sqrt(max(square, 0.0))
        if alphas[j] > BREAKDOWN * norm:
            coefficients[:, j], images[:, j] = w / alphas[j], image / alphas[j]
            v = orthogonal(images[:, j] - alphas[j] * rights[:, j], j + 1)
            betas[j] = np.linalg.norm(v)
        else:
            alphas[j] = betas[j] = 0.0
        if betas[j] <= BREAKDOWN * norm:
            betas[j] = 0.0
            v = orthogonal(random.standard_normal(width), j + 1)
    return rights, np.diag(alphas) + np.diag(betas[:-1], 1)


def _deviations(body, left, n):
    """Sum over dimensions of (n * x - S) squared, exactly; null where it does not fit a long."""
    largest = n * int(np.abs(body.astype(np.int64)).max(initial=0)) + max(map(abs, left))
    if largest * largest * len(left) < 1 << 63:
        scaled = n * body.astype(np.int64) + np.array(left, np.int64)
        return (scaled * scaled).sum(axis=1).tolist()
    scaled = n * body.astype(object) + np.array(left, object)
    return [s if s < 1 << 63 else None for s in (scaled * scaled).sum(axis=1).tolist()]


def whiten(embeddings, vector="embedding", components=COMPONENTS):
    """A row per usable row of ``embeddings`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out; all others, repeated ones
    included, are fitted and whitened. A vector shorter than the longest counts as followed by zeros, entries whose
    64-fold is beyond 2**52 as that bound. There are at most ``components`` components, fewer where the rows vary in
    fewer directions, and none, so no rows, where all are equal or the table is empty. A deviation beyond the range
    of long is null. Other columns are left out, whatever their names. ``vec_id`` may have any type.
    """
    rows = usable(embeddings, vector)
    if rows.schema["vec_id"].dataType.simpleString() == "void":
        rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = rows.agg(F.max(F.size("vector")).alias("width")).first().width
    nothing = rows.sparkSession.createDataFrame([], schema)
    if not width:
        return nothing
    table = write_and_read(integer_blocks(rows, width), "vector-blocks")
    n = table.agg(F.sum("n").alias("n")).first().n
    sums = [(h << 26) + low for h, low in zip(_summed(table, "high"), _summed(table, "low"))]
    # Copies are held on the executors while there is room; lost ones are read from the table again.
    held = table.select("base", "type", "body").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks = _Blocks(held, n, sums)
        square = blocks.squares()
        if not square > 0:
            return nothing
        rights, small = bidiagonalise(blocks.product, width, math.sqrt(square))
        _, singular, turned = np.linalg.svd(small)
        k = min(components, int((singular > LEAST_DEVIATION * singular[0]).sum()))
        axes, singular = (rights @ turned.T)[:, :k], singular[:k]
        projection = axes * (math.sqrt(n) / singular)
        error = float(np.abs(blocks.covariance(projection) - np.eye(k)).max())
    finally:
        held.unpersist()
    explained = singular ** 2 / square

    def project(batches):
        for batch in batches:
            for i, body, left in _Blocks.open(batch, n, sums):
                shift = np.array([float(Fraction(x, n)) for x in left])
                count = len(body)
                vec_ids = batch.column("vec_ids")[i].values
                yield pa.RecordBatch.from_pydict({
                    "vec_id": vec_ids.take(pa.array(np.repeat(np.arange(count), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                    "n": pa.array(np.full(count * k, n, np.int64)),
                    "deviation": pa.array(_deviations(body, left, n), pa.int64()).take(pa.array(np.repeat(np.arange(count), k))),
                    "whitened": pa.array(((body + shift) @ projection).ravel()),
                    "explained": pa.array(np.tile(explained, count)),
                    "identity_error": pa.array(np.full(count * k, error)),
                })

    return table.select("vec_ids", "base", "type", "body").mapInArrow(project, schema)
