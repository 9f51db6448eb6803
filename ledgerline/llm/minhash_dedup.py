"""Near-duplicate texts by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes) and a MinHash signature of
   TREES * MIN_DEPTH values.  Texts with equal sets are one class; its smallest id stands for it, so a
   group of exact copies costs one signature whatever its size (grouped with map-side aggregation).
2. The forest: every tree sorts all signatures by its own order of values.  Neighbours in a tree's
   order have its longest common prefixes; neighbours that share MIN_DEPTH values or more are
   candidates.  The order looks deeper where many signatures share a prefix, so the depth adapts to the
   region.  Sorting is by range over the whole key: a hot prefix is spread over many tasks, and the ends
   of neighbouring tasks are joined afterwards.
3. Candidates whose signatures agree too little for the threshold (SLACK standard deviations) are
   dropped.  The full sets of the rest are fetched once and pairs confirmed on them: first each class
   with its likeliest partner, then, between components that are still apart, all other candidates.
4. Components that stay apart but meet under a prefix of some tree are settled exactly.  Classes of
   different components whose signatures agree enough form families; a family's classes meet tile by
   tile with their full sets, and each pair of tiles returns only the links that unite components.

With MIN_DEPTH 3 and 24 trees, a pair at the threshold of 0.75 shares no prefix in any tree with
probability (1 - 0.75**3)**24 = 2e-6.

Defined results: a text without words (or null) has an empty set and links with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat an id are one node, with the links of all their
texts; a row without an id links with nothing and is kept; ties go to the smaller id; an empty table gives an
empty result; columns besides id and text are ignored, or pass through ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Bloom, cached, cut, shuffle_partitions, slices, table
from ledgerline.llm.components import components
from ledgerline.llm.vector_dedup import smallest

WORDS, PERCENT = 5, 75
TREES, MIN_DEPTH, DEPTH = 24, 3, 6
SLACK = 5.5
#: Classes of a tile where classes of different components meet, and bytes of their sets.
TILE, TILE_BYTES = 512, 16 << 20
SEED = 20_240_229
MEMO = 100_000


class WordHashes(dict):
    """Word (bytes, lower case) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in UTF-8."""
    memo = cached("minhash words", WordHashes)
    # bytes.split and bytes.lower know ASCII white space and letters only: exactly the words wanted.
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    # Shorter texts are another kind of set: their length goes in.
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i : i + len(total)] * _PLACES[i]
    return np.unique(_mix(total))


#: Odd multipliers of the words of a shingle, by place.
_PLACES = np.random.default_rng(SEED + 1).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return (r.integers(0, 2**31, TREES * MIN_DEPTH, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], r.integers(0, 2**32, TREES * MIN_DEPTH, np.uint32)[:, None]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the TREES * MIN_DEPTH permutations of 32-bit hashes."""
    a, b = cached("minhash multipliers", _multipliers)
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        part = short[at : at + 512] * a
        part ^= part >> np.uint32(15)
        part += b
        np.minimum(out, part.min(axis=1), out=out)
    return out


def least_agreement(percent: int = PERCENT) -> int:
    """Signature values that a linked pair shares at least, but for SLACK standard deviations."""
    n, p = TREES * MIN_DEPTH, percent / 100
    return math.floor(n * p - SLACK * math.sqrt(n * p * (1 - p)))


def _twin(text_col: str) -> Column:
    """A hash that tells the texts of rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, twin, n, sum and xor of hashes, signature (values as big-endian bytes) and marks (a byte of each value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sums = [int(s.sum(dtype=np.uint64)) - 2**63 if len(s) else 0 for s in sets]
            xors = [int(np.bitwise_xor.reduce(s * _PLACES[9])) - 2**63 if len(s) else 0 for s in sets]
            sigs = [signature(s) if len(s) else None for s in sets]
            # One byte of each value is enough to compare signatures by; the keys of the trees hold more.
            made = [pa.array([None if s is None else f(s) for s in sigs], pa.binary()) for f in (lambda s: s.astype(">u4").tobytes(), lambda s: s.astype(np.uint8).tobytes())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), *made], names=["id", "twin", "n", "sum", "xor", "sig", "marks"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _twin(text_col).alias("twin"))
    return rows.mapInArrow(run, "id long, twin long, n long, sum long, xor long, sig binary, marks binary")


def _trees(classes: DataFrame, depth: int, *others: str) -> DataFrame:
    """One row per class and tree: the tree's number and its first ``depth`` values as a key that sorts by them."""
    rows = classes.select("id", *others, "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    # A tree's own MIN_DEPTH values, then those of the trees after it.
    key = F.substr(F.concat("sig", "sig"), F.col("tree") * (4 * MIN_DEPTH) + 1, F.lit(4 * depth))
    return rows.select("id", *others, "tree", key.alias("key"))


def _neighbours(classes: DataFrame, partitions: int, least: int) -> DataFrame:
    """Candidate pairs (a, b, agree) from all trees: sorted neighbours with a common prefix of MIN_DEPTH values."""
    prefix = 4 * MIN_DEPTH

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        first = last = None
        for batch in batches:
            out = []
            for row in zip(batch.column("id").to_pylist(), batch.column("tree").to_pylist(), batch.column("key").to_pylist()):
                if last is None:
                    first = row
                elif row[1] == last[1] and row[2][:prefix] == last[2][:prefix]:
                    out.append((last[0], row[0], None, None, None))
                last = row
            yield _pairs(out)
        if first is not None:
            yield _pairs([(first[0], None, 2 * task, first[1], first[2][:prefix]), (last[0], None, 2 * task + 1, last[1], last[2][:prefix])])

    rows = _trees(classes, DEPTH)
    found = cut(rows.repartitionByRange(partitions, "tree", "key", "id").sortWithinPartitions("tree", "key", "id").mapInArrow(scan, "a long, b long, place long, tree int, prefix binary"), "forest-pairs")
    # Two rows a task: the ends, joined with the next task that had rows.
    ends = found.where("place is not null")
    nearby = Window.orderBy("place")
    ahead = ends.select("a", "place", "tree", "prefix", *(F.lead(c).over(nearby).alias(f"next_{c}") for c in ("a", "tree", "prefix")))
    joined = ahead.where("place % 2 = 1 and tree = next_tree and prefix = next_prefix").select("a", F.col("next_a").alias("b"))
    both = found.where("place is null").select("a", "b").unionByName(joined).where("a != b")
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda side: classes.select(F.col("id").alias(side), F.col("marks").alias(f"marks_{side}"))
    marked = pairs.join(of("a"), "a").join(of("b"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) for x, y in zip(batch.column("marks_a").to_pylist(), batch.column("marks_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int32())], names=["a", "b", "agree"])

    return marked.mapInArrow(agree, "a long, b long, agree int").where(f"agree >= {least}")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("a", pa.int64()), ("b", pa.int64()), ("place", pa.int64()), ("tree", pa.int32()), ("prefix", pa.binary()))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full shingle sets (id, set) of the documents in ``ids``; all different ones of rows that repeat an id.

    A bounded filter drops most other texts where they are read; the join is exact.
    """
    bloom = Bloom(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            some = batch.filter(pa.array(bloom.passed(batch.column("spots"))))
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array([shingles(t).tobytes() for t in some.column("text").cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "set"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = rows.withColumn("spots", bloom.spots()).mapInArrow(run, "id long, set binary")
    return wanted.join(ids, "id", "left_semi").dropDuplicates(["id", "set"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough; sizes too far apart say no at once."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                good.append(_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda side: sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _renamed(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs between different components, with the components in ca, cb."""
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")).where("ca != cb")


class Side:
    """The classes of a tile, ordered by component."""

    def __init__(self, rows: list[tuple]) -> None:
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.ids, self.comps = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.marks = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
        self.sets = [np.frombuffer(r[3], np.uint64) for r in rows] if len(rows[0]) > 3 else None
        begins = np.flatnonzero(np.append(True, self.comps[1:] != self.comps[:-1]))
        # Stretches of at most 32 rows of one component.
        self.stretches = [(k, min(k + 32, end)) for start, end in zip(begins, np.append(begins[1:], len(rows))) for k in range(start, end, 32)]


def _near_pairs(a: Side, b: Side, same: bool, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of different components whose marks agree enough; each pair of a tile with itself once."""
    for start, end in a.stretches:
        # Both sides are ordered by component, so the other components are what lies before and after.
        low, high = np.searchsorted(b.comps, a.comps[start], "left"), np.searchsorted(b.comps, a.comps[start], "right")
        for at, to in ((high, len(b.ids)),) if same else ((0, low), (high, len(b.ids))):
            if at < to:
                i, j = np.nonzero((a.marks[start:end, None, :] == b.marks[None, at:to, :]).sum(axis=2, dtype=np.uint8) >= least)
                if len(i):
                    yield i + start, j + at


def _tiled(rows: DataFrame, group: str, others: tuple[str, ...], partitions: int, solve, schema: str) -> DataFrame:
    """Each pair of tiles of a group in one task: ``solve(Side, Side, same)`` makes arrays of two id columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            sides = [[r[1:] for r in held if r[0] == side] for side in at[1:]]
            made = (np.empty(0, np.int64),) * 2
            if all(sides):
                a = Side(sides[0])
                made = solve(a, a if at[1] == at[2] else Side(sides[1]), at[1] == at[2])
            return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=[c.split()[0] for c in schema.split(", ")])

        for batch in slices(batches, 256):
            for row in zip(*(batch.column(c).to_pylist() for c in (group, "low", "high", "tile", "id", "comp", *others))):
                if row[:3] != at:
                    if held:
                        yield out()
                    at, held = row[:3], []
                held.append(row[3:])
        if held:
            yield out()

    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    cells = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    dealt = cells.select(group, "low", "high", "tile", "id", "comp", *others).repartition(partitions, group, "low", "high").sortWithinPartitions(group, "low", "high")
    return dealt.mapInArrow(run, schema)


def _families(classes: DataFrame, component: DataFrame, partitions: int, least: int) -> DataFrame:
    """(id, comp, family) of classes that meet a class of another component under a tree's prefix and may link to it.

    Prefixes met by one component only - nearly all - go in a grouped aggregation.  The rest are compared
    in tiles, so a prefix shared by very many is spread over its pairs of tiles; a pair of tiles returns a
    row per class at most.
    """

    def solve(a: Side, b: Side, same: bool) -> tuple[np.ndarray, np.ndarray]:
        shift = 0 if same else len(a.ids)
        ids = a.ids if same else np.concatenate([a.ids, b.ids])
        found = [(i, j + shift) for i, j in _near_pairs(a, b, same, least)]
        if not found:
            return (np.empty(0, np.int64),) * 2
        i, j = (np.concatenate(x) for x in zip(*found))
        hit = np.unique(np.concatenate([i, j]))
        return ids[hit], smallest(len(ids), i, j, ids)[hit]

    of = classes.join(component, classes["id"] == component["node"], "left").select("id", F.coalesce("component", "id").alias("comp"), "sig")
    rows = _trees(of, MIN_DEPTH, "comp").select("id", "comp", F.xxhash64("tree", "key").alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("n")).where("first != last")
    met = rows.join(mixed.select("bucket", F.ceil(F.col("n") / TILE).alias("tiles")), "bucket").join(classes.select("id", "marks"), "id")
    near = cut(_tiled(met, "bucket", ("marks",), partitions, solve, "id long, root long"), "families")
    family = components(near.select(F.col("id").alias("u"), F.col("root").alias("v")))
    return family.join(of.select("id", "comp"), F.col("node") == F.col("id")).select("id", "comp", F.col("component").alias("family"))


def _settled(families: DataFrame, classes: DataFrame, sets: DataFrame, partitions: int, least: int, percent: int) -> DataFrame:
    """Links (a, b) that unite components of a family, from full sets of all its classes."""

    def solve(a: Side, b: Side, same: bool) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for i, j in _near_pairs(a, b, same, least):
            for k, n in zip(i.tolist(), j.tolist()):
                x, y = root(int(a.comps[k])), root(int(b.comps[n]))
                if x != y and _linked(a.sets[k], b.sets[n], percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((a.ids[k], b.ids[n]))
        x = np.array(found, np.int64).reshape(-1, 2)
        return x[:, 0], x[:, 1]

    sized = families.join(classes.select("id", "marks", "n"), "id")
    tiles = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.col("n") * 8) / TILE_BYTES)).alias("tiles"))
    rows = sized.drop("n").join(tiles, "family").join(sets, "id")
    return _tiled(rows, "family", ("marks", "set"), partitions, solve, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """One row per row of ``docs``: id, twin (hash of the text), n, sum and xor of its set, component."""
    partitions = shuffle_partitions(docs.sparkSession)
    signed = cut(_signed(docs, id_col, text_col), "signatures")
    same = ["n", "sum", "xor"]
    known_ids = signed.where("n > 0 and id is not null")
    classes = known_ids.groupBy(*same).agg(F.min(F.struct("id", "sig", "marks")).alias("first")).select(*same, "first.id", "first.sig", "first.marks")
    classes = cut(classes, "classes")
    pairs = cut(_neighbours(classes, partitions, least_agreement(percent)), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(_sets(docs, ids, id_col, text_col), "shingle-sets")
    # Each class with its likeliest partner: most links come from these.
    partner = F.max(F.struct("agree", (-F.col("other")).alias("other")))
    sides = pairs.select("agree", F.explode(F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("other")), F.struct(F.col("b").alias("one"), F.col("a").alias("other")))).alias("s")).select("agree", "s.*")
    likely = sides.groupBy("one").agg(partner.alias("p")).select("one", (-F.col("p.other")).alias("other"))
    likely = likely.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()
    links = cut(_confirmed(likely, sets, percent), "links-likely")
    component = components(links.toDF("u", "v"))
    rest = _renamed(pairs.join(likely, ["a", "b"], "left_anti"), component)
    links = links.unionByName(cut(_confirmed(rest, sets, percent), "links-rest"))
    component = components(links.toDF("u", "v"))
    # Components that meet under a prefix without a link so far.
    families = cut(_families(classes, component, partitions, least_agreement(percent)), "family-members")
    if not families.isEmpty():
        missing = families.select("id").join(ids, "id", "left_anti")
        sets = sets.unionByName(cut(_sets(docs, missing, id_col, text_col), "shingle-sets"))
        links = links.unionByName(cut(_settled(families, classes, sets, partitions, least_agreement(percent), percent), "links-settled"))
        component = components(links.toDF("u", "v"))
    # Every row follows its class, every class its component.
    known = classes.join(component.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    rows = known_ids.join(known, same).select("id", "twin", *same, "component")
    return rows.unionByName(signed.where("n = 0 or id is null").select("id", "twin", *same, F.col("id").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    every = _grouped(docs, id_col, text_col, percent)
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the row of the smallest id.

    Where rows repeat that id, one of each different shingle set stays: a text that is not a copy is not lost.
    """
    kept = _grouped(docs, id_col, text_col, percent).where("id = component").groupBy("id", "n", "sum", "xor").agg(F.min("twin").alias("twin")).select("id", "twin")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), _twin(text_col).alias("twin"))
    chosen = rows.where("id is not null").join(kept, ["id", "twin"], "left_semi").dropDuplicates(["id", "twin"])
    every = chosen.unionByName(rows.where("id is null"))
    return every.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d JOIN comp ON comp.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
