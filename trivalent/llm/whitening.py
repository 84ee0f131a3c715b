"""Whitening of embeddings by a tiled covariance.

Entries become integers, floor(scale * c), so equal vectors are equal bytes: distinct ones are a group-by of packed
integers, and sums are exact. (An offset on all entries cancels in everything that is returned, so none is added.) The covariance is never made in one place: rows come in row-blocks, each row-block
is cut into column blocks of `tile` dimensions, and pairs of column blocks are the tile keys. Column blocks are
shuffled by row-block; a task that holds a row-block's pieces centres them, multiplies each tile pair and adds the
product to its sum for that tile; sums of tiles meet in one aggregation by tile key. Only finished tiles, a matrix of
dimensions squared, reach the driver, are assembled and eigendecomposed. A task's tile sums are passed on whenever they
exceed `HELD` numbers, so its memory is bounded for any dimension; the driver's matrix bounds the dimension in practice
(4,000 dimensions are 128 MB).

Hot vectors collapse in the partial aggregation before the shuffle. Row-blocks are numbered by partition and place in a
stored table, so a task that runs again numbers them alike.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those whose length
isn't the most frequent one (of several, the greatest); entries count as at most 2^46 in amount; components of eigenvalue
zero (to rounding) have no whitened coordinate and no row, so equal vectors throughout give none; equal eigenvalues come in
any order; each component's largest entry is positive; a deviation that no long can hold is null; repeated rows and null ids
each return; an empty table has no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import release, stored

SCALE = 64
COMPONENTS = 16
#: Dimensions of a column block, numbers in a row-block, and numbers of tile sums that a task holds.
TILE = 32
BLOCK = 1 << 19
HELD = 1 << 22
_LIMIT = float(1 << 46)
_KINDS = (np.int16, np.int32, np.int64)


def pack(x: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds them; the first byte says which."""
    most = int(np.abs(x).max())
    kind = next(i for i, t in enumerate(_KINDS) if most <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _KINDS[data[0]], offset=1).astype(np.int64)


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, number of dimensions, and the packed integers (without the offset) of each vector that is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.values.slice(0, at[-1])
            bad = ~np.isfinite(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False))
            wrong = np.concatenate([[0], np.cumsum(bad)])
            n = np.diff(at)
            good = np.flatnonzero((n > 0) & (wrong[at[1:]] == wrong[at[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False))
            numbers = np.floor(np.clip(scale * np.where(bad, 0, pc.fill_null(values, 0).to_numpy(zero_copy_only=False)), -_LIMIT, _LIMIT)).astype(np.int64)
            rows = [pack(numbers[at[i] : at[i + 1]]) for i in good.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(n[good].astype(np.int32)), pa.array(rows, pa.binary())], names=["vec_id", "d", "x"])
            release()

    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, "vec_id long, d int, x binary")


def _rows(column: pa.Array) -> np.ndarray:
    """The packed vectors of a column as a matrix."""
    return np.stack([unpack(x) for x in column.to_pylist()]) if len(column) else np.zeros((0, 0), np.int64)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, in halves of 32 bits so that nothing overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            if len(batch):
                x = _rows(batch.column(0))
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(np.full(d, n))], names=["dim", "low", "high", "n"])

    found = fit.mapInArrow(run, "dim int, low long, high long, n long").groupBy("dim").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("n")).collect()  # a row for each dimension
    sums = {r.dim: (r.high << 32) + r.low for r in found}
    return (found[0].n if found else 0), [sums[i] for i in range(d)] if found else []


@dataclass(frozen=True)
class Centre:
    """n vectors with exact sums, as whole means and what is left of them."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])


def column_blocks(fit: DataFrame, centre: Centre, tile: int = TILE, numbers: int = BLOCK) -> DataFrame:
    """Pieces of row-blocks: (row_block, column block, rows, packed integers above the whole means)."""
    whole, d = centre.whole, len(centre.sums)
    height = max(1, numbers // d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, len(batch), height):
                x = _rows(batch.column(0).slice(i, height)) - whole
                cut = list(range(0, d, tile))
                pieces = [pack(np.ascontiguousarray(x[:, c : c + tile])) for c in cut]
                columns = [[name] * len(cut), range(len(cut)), [len(x)] * len(cut), pieces]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["row_block", "col", "n", "x"])
                name += 1

    return fit.mapInArrow(run, "row_block long, col int, n int, x binary")


def tile_sums(blocks: DataFrame, centre: Centre, tile: int = TILE) -> DataFrame:
    """Sums of products of each pair of column blocks, i <= j, over all row-blocks: (i, j, products in row order)."""
    rest = centre.rest
    parts = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def out(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = sorted(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["i", "j", "products"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        held, name, pieces = 0, None, []
        for batch in batches:
            for row_block, col, n, x in zip(*(batch.column(i) for i in range(4)), strict=True):
                if row_block.as_py() != name:
                    name, pieces = row_block.as_py(), []
                own = unpack(x.as_py()).reshape(n.as_py(), -1) - rest[col.as_py() * tile : (col.as_py() + 1) * tile]
                pieces.append(own)  # in order of columns, so all pairs i <= j end here
                for i, other in enumerate(pieces):
                    key, product = (i, col.as_py()), other.T @ own
                    if key in sums:
                        sums[key] += product
                    else:
                        sums[key], held = product, held + product.size
            if held > HELD:
                yield out(sums)
                sums, held = {}, 0
        if sums:
            yield out(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, j, products in zip(*(batch.column(c) for c in range(3)), strict=True):
                if (i.as_py(), j.as_py()) != key:
                    if key:
                        yield out({key: total})
                    key, total = (i.as_py(), j.as_py()), 0
                total = total + products.values.to_numpy(zero_copy_only=False)
        if key:
            yield out({key: total})

    kind = "i int, j int, products array<double>"
    met = blocks.repartition(parts, "row_block").sortWithinPartitions("row_block", "col").mapInArrow(multiply, kind)
    return met.repartition(parts, "i", "j").sortWithinPartitions("i", "j").mapInArrow(add, kind)


def covariance(fit: DataFrame, centre: Centre, tile: int = TILE, numbers: int = BLOCK) -> np.ndarray:
    """The covariance, divisor n, assembled from its tiles."""
    d = len(centre.sums)
    v = np.zeros((d, d))
    for r in tile_sums(column_blocks(fit, centre, tile, numbers), centre, tile).collect():  # d squared halves of numbers
        i, j = r.i * tile, r.j * tile
        own = np.array(r.products).reshape(min(tile, d - i), -1) / centre.n
        v[i : i + own.shape[0], j : j + own.shape[1]] = own
        v[j : j + own.shape[1], i : i + own.shape[0]] = own.T
    return v


@dataclass(frozen=True)
class Whitening:
    """axes: a column for each component, over the root of its eigenvalue; explained: shares of the trace."""

    centre: Centre
    axes: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre.whole) - self.centre.rest) @ self.axes


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS, tile: int = TILE, numbers: int = BLOCK) -> Whitening | None:
    n, sums = exact_sums(fit, d)
    if not n:
        return None
    centre = Centre(n, sums)
    v = covariance(fit, centre, tile, numbers)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values[-1], 0) * d * 2.0**-50]
    axes = vectors[:, order]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1, 1) if len(order) else axes
    return Whitening(centre, axes / np.sqrt(values[order]), values[order] / np.trace(v) if len(order) else values[order])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry, in amount, of the whitened fit vectors' covariance less the identity."""
    k = model.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if len(batch):
                y = model.project(_rows(batch.column(0)))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], names=["at", "sum"])

    found = fit.mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()  # a row for each pair of components
    c = np.zeros(k * k)
    for r in found:
        c[r.at] = r.sum / model.centre.n
    return float(np.abs(c.reshape(k, k) - np.eye(k)).max())


def deviations(x: np.ndarray, centre: Centre) -> list[int | None]:
    """Sums of squares of n * x - S, exact; None where no long holds it."""
    rough = float(centre.n) ** 2 * (((x - centre.whole) - centre.rest) ** 2).sum(1)
    if not len(rough) or rough.max() < 2.0**61:
        whole = np.array([s % centre.n for s in centre.sums], np.int64)
        return (((x - centre.whole) * np.int64(centre.n) - whole) ** 2).sum(1).tolist() if len(rough) else []
    each = [sum((centre.n * a - s) ** 2 for a, s in zip(row, centre.sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in each]


FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE, numbers: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each whole vector and component: its whitened coordinate, the component's share, and how well the fit is."""
    spark = vectors.sparkSession
    rows = stored(packed(vectors, id_col, vector_col), "vectors")
    usual = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], FIELDS)
    d = usual.d
    rows = rows.where(F.col("d") == d)
    fit = stored(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, d, components, tile, numbers)
    k = model.axes.shape[1]
    if not k:
        return spark.createDataFrame([], FIELDS)
    error = identity_error(fit, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                x = _rows(part.column(1))
                m = len(x)
                each = np.repeat(np.arange(m), k)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)),
                    pa.array(deviations(x, model.centre), pa.int64()).take(pa.array(each)), pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
            release()

    return rows.select("vec_id", "x").mapInArrow(run, FIELDS)
