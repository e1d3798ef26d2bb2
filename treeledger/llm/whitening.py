"""Whitened embeddings by block Lanczos.

The covariance is never built: each round one distributed pass multiplies it with a block of vectors, centring the rows before
they are multiplied. The basis is kept orthogonal in full, twice a round. Where a block loses rank (breakdown)
random directions take the place of what is lost, so parts of the space that a block can't reach are still searched; a full
basis is contracted to its best vectors. It ends when every wanted pair's residual is at rounding level, or the
basis spans the space. The trace, of which the eigenvalues are shares, is the sum of the rows' exact deviations.

Defined results: rows whose vector is null or holds a null or a number that is not finite (or whose multiple is no long) are
left out, and so are vectors of another length than the commonest. Rows are whitened one by one, so vec_ids may repeat or be
null. A component without variance (fewer different rows than components) has explained 0 and whitened null, and stays out of
identity_error, which is null if no component has variance. A deviation that is no long is null. An empty table, or vectors
of length 0, give no rows. Other columns are not read. Up to some hundred bytes for each component are held for each row of
an Arrow batch; what the driver holds follows the length of the vectors only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.lattice import bounds, double_sums, exact_sums, halves, matrix, on_grid
from treeledger.llm.staging import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: A residual is at rounding level, and an eigenvalue is one at all, from these shares of the largest eigenvalue on.
TOLERANCE, VARIANCE = 2e-13, 1e-12
#: Columns of a basis beyond which it is contracted.
BASIS = 512


def _orthogonal(block: np.ndarray, basis: np.ndarray, wanted: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Up to `wanted` columns that are orthogonal to the basis and to each other: what block adds to it and, where that is
    too little, random directions."""
    out = np.zeros((len(basis), 0))
    while out.shape[1] < wanted:
        held = np.hstack((basis, out))
        for _ in range(2):
            block = block - held @ (held.T @ block)
        left, value, _ = np.linalg.svd(block, full_matrices=False)
        new = left[:, value > 1e-11 * scale][:, : wanted - out.shape[1]]
        for _ in range(2):
            new = np.linalg.qr(new - held @ (held.T @ new))[0]
        out = np.hstack((out, new))
        block, scale = rng.standard_normal((len(basis), wanted - out.shape[1])), 1.0
    return out


def leading(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, limit: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of the symmetric map `times`, falling, and their unit vectors as columns.

    A block is as wide as what is wanted, so no multiple eigenvalue is met too seldom.
    """
    rng = np.random.default_rng(size)
    block = _orthogonal(rng.standard_normal((size, wanted)), np.zeros((size, 0)), wanted, 1.0, rng)
    basis = image = np.zeros((size, 0))
    while True:
        last = times(block)
        basis, image = np.hstack((basis, block)), np.hstack((image, last))
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        found = basis @ vector[:, :wanted]
        rest = np.linalg.norm(image @ vector[:, :wanted] - found * value[:wanted], axis=0)
        scale = max(np.abs(value).max(), np.finfo(float).tiny)
        if basis.shape[1] == size or rest.max() <= TOLERANCE * scale:
            return value[:wanted], found * np.where(np.take_along_axis(found, np.abs(found).argmax(axis=0)[None], 0) < 0, -1, 1)
        block = _orthogonal(last, basis, min(wanted, size - basis.shape[1]), scale, rng)
        if basis.shape[1] + block.shape[1] > max(limit, 3 * wanted):
            basis, image = basis @ vector[:, : 2 * wanted], image @ vector[:, : 2 * wanted]


class Centre:
    """n times a row less the sums, as whole numbers; small and the same in every task."""

    def __init__(self, n: int, sums: list[int], spread: int) -> None:
        self.n, self.sums = n, sums
        self.fits = n * spread < 1 << 62  # then products that wrap still differ by the right number
        self.squares = len(sums) * (n * spread) ** 2 < 1 << 63

    def whole(self, x: np.ndarray) -> np.ndarray:
        if self.fits:
            return x * np.int64(self.n) - np.array([s % (1 << 64) for s in self.sums], np.uint64).view(np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def row(self, x: np.ndarray) -> np.ndarray:
        """x less its mean, as doubles."""
        return (self.whole(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.whole(x)
        y = y if self.squares else y.astype(object)
        return (y * y).sum(axis=1).tolist()


def whitened(vectors: DataFrame, components: int = COMPONENTS, limit: int = BASIS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of vectors (vec_id, embedding)
    and component."""
    rows, size = on_grid(vectors, SCALE, SHIFT)
    kind = dict(rows.dtypes)["vec_id"]
    wanted = min(components, size)
    if not wanted:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, low, high = bounds(rows)
    sums = exact_sums(rows.select("x"), lambda b: tuple(h.sum(axis=0) for h in halves(matrix(b.column(0), size))), size)
    centre = Centre(n, sums, high - low)

    def times(block: np.ndarray) -> np.ndarray:
        def told(batch: pa.RecordBatch) -> np.ndarray:
            x = centre.row(matrix(batch.column(0), size))
            return x.T @ (x @ block)

        return double_sums(rows.select("x"), told, block.shape) / n

    value, vector = leading(times, size, wanted, limit)
    live = int((value > VARIANCE * max(value[0], 0)).sum()) if value[0] > 0 else 0
    turn = vector[:, :live] / np.sqrt(value[:live])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), size)
            exact = centre.deviations(x)
            told = [d if d < 1 << 63 else None for d in exact]
            w = centre.row(x) @ turn
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.int64()), pa.array(np.array(exact, float)), pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * live, w.reshape(-1))], names=["vec_id", "deviation", "spread", "w"])

    out = stage(rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, spread double, w array<double>"), "whitened")
    trace = out.agg(F.sum(F.col("spread") / F.lit(float(n) ** 3))).first()[0]
    explained = [float(v) / trace if i < live else 0.0 for i, v in enumerate(value)]
    error = None
    if live:
        mean = double_sums(out.select("w"), lambda b: matrix(b.column(0), live).sum(axis=0), (live,)) / n

        def products(batch: pa.RecordBatch) -> np.ndarray:
            w = matrix(batch.column(0), live) - mean
            return w.T @ w

        error = float(np.abs(double_sums(out.select("w"), products, (live, live)) / n - np.eye(live)).max())
    told = out.select("vec_id", "deviation", "w", F.posexplode(F.array(*map(F.lit, explained))).alias("place", "explained"))
    return told.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("w", F.col("place")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))
