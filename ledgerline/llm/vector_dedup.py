"""Embedding near-duplicates: exact cosine links within a label, compared tile by tile in PCA order.

Equal vectors of a label are one class with a count, found by a grouped aggregation, so a vector that
a third of all rows share is compared once.  Unit vectors are turned into PCA axes, and the classes of a
label are sorted along the first of them, as angles to it; runs of neighbours are tiles, so a hot label is
many tiles.  The angle between two vectors is at least the difference of these angles: tiles further apart
than the threshold's angle are never brought together.  A pair of the rest meets in the task of one of the
two, which holds its own tile and lets the others pass, so a tile travels once for each partner.

There, blocks of neighbours are compared: the products of the leading axes are summed first, and with the
norms of what is left of both vectors as bound for the rest, pairs that cannot reach the threshold stop.
Those left go on over the next axes, and pairs within rounding of the threshold are settled by the plain
double-precision cosine.

A pair of tiles returns a row per vector with links: the number of vectors it links to there and the
smallest linked id reachable within the two tiles.  Linked pairs themselves are never emitted.

The axes come from a bounded sample (AXES_SAMPLE rows); they change the speed, never the links.

Defined results: a row whose id, label or vector is null, or whose vector is empty, zero or holds null or
non-finite components, links with nothing and is its own component; labels are compared as they are, of
any type; vectors of different length do not link; n_links counts rows, equal vectors included; rows that
repeat an id are one node: they share a component, and the links of all of them; an empty table gives an
empty result; columns besides id, vector and label are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, shuffle_partitions, table
from ledgerline.llm.components import components
from ledgerline.llm.vectors import BLOCK, BLOCK_BYTES, block_rows, dealt, matrices, matrix, usable

THRESHOLD = 0.93
AXES_SAMPLE = 10_000
#: Leading axes that are summed before each look at the bound, as shares of all axes.
LOOKS = (0.25, 0.5)
#: Rows of a tile that are compared at once.
AT_ONCE = 1024
ROUNDING, ANGLE_ROUNDING = 1e-9, 1e-6


def axes(sample: list[list[float]]) -> dict[int, np.ndarray]:
    """By vector length: an orthogonal matrix whose columns are the PCA axes of unit vectors, largest first."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    return {dim: np.linalg.eigh((m := unit(np.array(rows, np.float64))).T @ m)[1][:, ::-1].copy() for dim, rows in by.items()}


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1)[:, None]
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def angles(rows: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    """The angle of each row to the first axis (the first dimension, where no axes are known)."""
    u = unit(rows)
    return np.arccos(np.clip(u[:, 0] if turn is None else u @ turn[:, 0], -1, 1))


class Tile:
    """Neighbours along the first axis."""

    def __init__(self, row: dict, turn: np.ndarray | None) -> None:
        self.ids, self.weights, self.angles = (np.frombuffer(row[c], kind) for c, kind in (("ids", np.int64), ("weights", np.int64), ("angles", np.float64)))
        self.plain = matrix(row["rows"], row["dim"])
        self.unit = unit(self.plain) if turn is None else unit(self.plain) @ turn
        self.looks = [max(1, math.ceil(share * row["dim"])) for share in LOOKS]
        self.rest = [np.sqrt(np.einsum("ij,ij->i", self.unit[:, c:], self.unit[:, c:])) for c in self.looks]


def links(a: Tile, b: Tile, x: slice, y: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of linked pairs of rows ``x`` of one tile and ``y`` of another; within one tile, i < j only."""
    first, second = a.looks
    total = a.unit[x, :first] @ b.unit[y, :first].T
    may = total + np.outer(a.rest[0][x], b.rest[0][y]) >= threshold - ROUNDING
    if a is b and x == y:
        may = np.triu(may, 1)
    i, j = np.nonzero(may)
    total = total[i, j]
    i, j = i + x.start, j + y.start
    for start, end, rest in ((first, second, 1), (second, a.unit.shape[1], None)):
        for at in range(0, len(i), 1 << 16):  # in stretches, for the memory of the gathered rows
            s = slice(at, at + (1 << 16))
            total[s] += np.einsum("ij,ij->i", a.unit[i[s], start:end], b.unit[j[s], start:end])
        bound = total if rest is None else total + a.rest[rest][i] * b.rest[rest][j]
        keep = bound >= threshold - ROUNDING
        i, j, total = i[keep], j[keep], total[keep]
    near = np.abs(total - threshold) <= ROUNDING
    good = ~near
    for k in np.nonzero(near)[0]:
        p, q = a.plain[i[k]], b.plain[j[k]]
        good[k] = float(p @ q) / (math.sqrt(float(p @ p)) * math.sqrt(float(q @ q))) >= threshold
    return i[good], j[good]


def smallest(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest id reachable over the pairs (i, j)."""
    label = ids.copy()
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == old).all():
            return label


def compared(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows with links between two tiles (or within one): id, number of rows linked, smallest id reachable."""
    same, shift = a is b, 0 if a is b else len(a.ids)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    n, label, merged = np.zeros(len(ids), np.int64), ids.copy(), []
    wide = math.acos(max(-1.0, threshold)) + ANGLE_ROUNDING
    parts = lambda t: [slice(k, min(k + AT_ONCE, len(t.ids))) for k in range(0, len(t.ids), AT_ONCE)]
    for x in parts(a):
        for y in parts(b):
            if same and y.start < x.start or max(b.angles[y.start] - a.angles[x.stop - 1], a.angles[x.start] - b.angles[y.stop - 1]) > wide:
                continue
            i, j = links(a, b, x, y, threshold)
            if not len(i):
                continue
            np.add.at(n, i, b.weights[j])
            np.add.at(n, j + shift, a.weights[i])
            rows, at = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
            new = smallest(len(rows), at[: len(i)], at[len(i) :], label[rows])
            if (changed := new != label[rows]).any():
                merged.append(np.unique(np.stack([label[rows][changed], new[changed]]), axis=1))
                label[rows] = new
    if merged:
        # Labels that met in some block are one from there on, wherever else they stand.
        old, new = np.concatenate(merged, axis=1)
        nodes, at = np.unique(np.concatenate([old, new]), return_inverse=True)
        root = smallest(len(nodes), at[: len(old)], at[len(old) :], nodes)
        known = np.minimum(np.searchsorted(nodes, label), len(nodes) - 1)
        label = np.where(nodes[known] == label, root[known], label)
    hit = np.nonzero(n)[0]
    return ids[hit], n[hit], label[hit]


def _tiles(classes: DataFrame, turn: dict[int, np.ndarray], partitions: int, most: int) -> DataFrame:
    """Classes (key, dim, id, weight, vector) as tiles: runs of rows of one label and length, by their angle."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.empty(batch.num_rows)
            for at, rows in matrices(batch):
                angle[at] = angles(rows, turn.get(rows.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle)], names=[*batch.schema.names, "angle"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, at, held = TaskContext.get().partitionId() << 33, None, []

        def out() -> pa.RecordBatch:
            ids, weights, angle, rows = (np.concatenate(x) for x in zip(*held))
            made = [pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([number]), pa.array([angle[0]]), pa.array([angle[-1]]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, weights, angle, rows))]
            return pa.RecordBatch.from_arrays(made, names=["key", "dim", "tile", "low", "high", "ids", "weights", "angles", "rows"])

        for batch in batches:
            key = np.array(batch.column("key").to_pylist(), object)
            ids, weights, angle = (batch.column(c).to_numpy() for c in ("id", "weight", "angle"))
            for spot, rows in matrices(batch):
                cuts = np.flatnonzero(key[spot[1:]] != key[spot[:-1]]) + 1
                for here, part in zip(np.split(spot, cuts), np.split(rows, cuts)):
                    own, size = (key[here[0]], part.shape[1]), block_rows(part.shape[1], most)
                    for start in range(0, len(here), size):
                        some = here[start : start + size]
                        if held and (own != at or sum(len(h[0]) for h in held) + len(some) > size):
                            yield out()
                            number, held = number + 1, []
                        at = own
                        held.append((ids[some], weights[some], angle[some], part[start : start + size].copy()))
        if held:
            yield out()

    placed = classes.select("key", "dim", "id", "weight", "vector").mapInArrow(place, "key string, dim int, id long, weight long, vector array<double>, angle double")
    ranged = placed.repartitionByRange(partitions, "key", "dim", "angle", "id").sortWithinPartitions("key", "dim", "angle", "id")
    return ranged.mapInArrow(run, "key string, dim int, tile long, low double, high double, ids binary, weights binary, angles binary, rows binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, most: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.  ``most``: rows of a tile at most."""
    spark = vectors.sparkSession
    partitions = shuffle_partitions(spark)
    some = F.exists(F.col(vector_col), lambda x: x != 0)
    good = usable(F.col(vector_col)) & F.coalesce(some, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(good, F.transform(F.col(vector_col), lambda x: x.cast("double"))).alias("vector"))
    usual = rows.where("vector is not null")
    classes = usual.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    classes = cut(classes.select("*", F.col("label").cast("string").alias("key"), F.size("vector").alias("dim")), "vector-classes")
    turn = axes([r[0] for r in classes.select("vector").orderBy(F.xxhash64("id")).limit(AXES_SAMPLE).collect()])
    # So many ranges that each holds about a tile.
    size = classes.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    tiles = cut(_tiles(classes, turn, max(1, min(partitions, math.ceil(size / BLOCK_BYTES))), most), "vector-tiles")
    near = F.greatest(F.col("b.low") - F.col("a.high"), F.col("a.low") - F.col("b.high")) <= math.acos(max(-1.0, threshold)) + ANGLE_ROUNDING
    spots = tiles.select("key", "dim", "tile", "low", "high")
    pairs = spots.alias("a").join(spots.alias("b"), ["key", "dim"]).where(near & (F.col("a.tile") < F.col("b.tile")))
    # The owner is either of the two, so that all tiles have about as many partners.
    swap = F.pmod(F.xxhash64("a.tile", "b.tile"), F.lit(2)) == 0
    guests = pairs.select(F.when(swap, F.col("a.tile")).otherwise(F.col("b.tile")).alias("owner"), F.when(swap, F.col("b.tile")).otherwise(F.col("a.tile")).alias("tile"))
    data = tiles.drop("key", "low", "high")
    cells = data.withColumn("owner", F.col("tile")).unionByName(data.join(guests, "tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = None, None
        for batch in batches:
            for nth in range(batch.num_rows):
                row = {c: batch.column(c)[nth].as_py() for c in batch.schema.names}
                here = Tile(row, turn.get(row["dim"]))
                if row["owner"] != number:
                    own, number = here, row["owner"]
                made = compared(own, here, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["id", "n", "root"])

    # A tile comes before its guests.
    met = cells.repartitionById(partitions, dealt(F.col("owner"), partitions)).sortWithinPartitions("owner", F.col("tile") != F.col("owner"), "tile").mapInArrow(run, "id long, n long, root long")
    found = cut(met, "vector-links")
    component = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = usual.join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = joined.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN comp ON comp.x = vec_id LEFT JOIN n ON n.x = vec_id"""
