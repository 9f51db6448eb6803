"""What the vector operators share: which vectors count, and blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the vectors of a block, and the most rows of one.
BLOCK_BYTES, BLOCK = 8 << 20, 1 << 15
#: Vector lengths that a task collects blocks of at a time.
OPEN = 8


def usable(vector: Column) -> Column:
    """True for a vector that is not null or empty and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def block_rows(dim: int, most: int = BLOCK) -> int:
    """Rows of a block of vectors of ``dim`` doubles."""
    return max(1, min(most, BLOCK_BYTES // (8 * dim)))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows of one vector length: their numbers and their vectors as a matrix."""
    vectors = batch.column("vector")
    offsets = vectors.offsets.to_numpy()
    flat, dims = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    cuts = np.concatenate([[0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)]])
    for start, end in zip(cuts[:-1], cuts[1:]):
        if start < end:
            yield np.arange(start, end), flat[offsets[start] : offsets[end]].reshape(end - start, dims[start])


def dealt(number: Column, places: int) -> Column:
    """A place from 0 on for a block, by its number (task << 33 | place in the task): evenly where tasks make about as many."""
    return F.pmod(F.shiftright(number, 33) * 31 + number.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(places)).cast("int")


def blocks(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows (id, vector array<double>) as blocks (dim, block, n, ids, rows) of one vector length each, where they are: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            size = block_rows(dim, most)
            ids, made = (np.concatenate(x) for x in zip(*held[dim]))
            for at in range(0, len(ids), size):
                if not whole and len(ids) - at < size:
                    held[dim] = [(ids[at:], made[at:])]
                    return
                part = ids[at : at + size]
                columns = [pa.array([dim], pa.int32()), pa.array([number]), pa.array([len(part)]), *(pa.array([x.tobytes()], pa.binary()) for x in (part, made[at : at + size]))]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "block", "n", "ids", "rows"])
                number += 1
            del held[dim]

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at, made in matrices(batch):
                dim = made.shape[1]
                held.setdefault(dim, []).append((ids[at], made.copy()))
                if sum(len(x) for x, _ in held[dim]) >= block_rows(dim, most):
                    yield from out(dim, False)
                while len(held) > OPEN:
                    yield from out(next(iter(held)), True)
        for dim in list(held):
            yield from out(dim, True)

    return rows.select("id", "vector").mapInArrow(run, "dim int, block long, n long, ids binary, rows binary")


def matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, dim)
