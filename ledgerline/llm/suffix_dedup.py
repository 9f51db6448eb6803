"""Removal of repeated byte strings with longest-previous-factor arrays, over a whole corpus.

Every byte that lies in a ``length``-byte string which also starts earlier (smaller id, or same
document and earlier start) goes; the first copy stays.  A suffix array over all texts does not fit
anywhere, so suffixes are first brought together that can match at all:

1. Every window of ``length`` bytes has an anchor: the GRAM-byte string in it with the smallest hash
   (leftmost on ties).  Equal windows have equal anchors at equal offsets.  Windows in a row with one
   anchor position form a stretch; a stretch is one row (anchor hash, content hash, id, start), about
   one for 35 bytes of text.
2. Rows are sorted by anchor hash, content hash, id and start.  An anchor met once cannot repeat.  Of
   stretches with equal content the first stays and all others are repeats, however many there are;
   this pass only remembers the row before.
3. Where one anchor has several contents, the first stretch of each content is cut from its text,
   split into windows that reach further left or right of the anchor, and keyed by the 66 bytes that
   such windows share, so a common short phrase does not gather everything around it.  Stretches of one
   key meet in one task, where a suffix order of all their windows is built by doubling; the previous
   and next smaller positions in that order give each window's longest previous factor, capped at
   ``length``: windows that reach it are repeats.
4. An anchor with more than HOT contents - a common header before ever different bodies - could still make
   a group of any size.  Its windows are rows of their own instead: the first of equal ones is found by an
   aggregation that combines before the shuffle.
5. The repeats of each text are united and cut out.

Content is compared by 64-bit hashes within equal 64-bit anchor hashes in step 2, by 128-bit hashes in
step 4, and byte for byte in step 3.

Defined results: a null text counts as empty; a row without an id is kept whole and matches nothing;
texts shorter than ``length`` are kept; rows that repeat an id are one document to the order of starts, so
equal strings at the same id and start keep each other; an empty table gives an empty result; columns besides
id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import Bloom, cut, shuffle_partitions, slices, table

LENGTH = 100
GRAM = 32
#: Contents of an anchor beyond which its windows are compared one by one.
HOT = 1 << 14
#: Hot anchors that are broadcast (8 bytes each); more of them are joined by a shuffle.
FEW = 1 << 17
#: Bytes of text that are hashed at once, and of stretches that are sorted at once.
AT_ONCE, SORTED_AT_ONCE = 1 << 20, 1 << 21
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    h = (h ^ (h >> np.uint64(29))) * _C[4]
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h = _mix(np.arange(256, dtype=np.uint64) + _C[0])[data]
    step = 1
    for c in _C:
        h = h[:-step] * c + h[step:]
        step *= 2
    return _mix(h)


def window_minimum(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document number, start in ``data``, windows, anchor, anchor hash, content hash) of all stretches.

    ``data`` holds texts one after the other; ``ends`` where each ends.
    """
    if len(data) < length:
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint64), np.empty(0, np.uint64))
    h = gram_hashes(data)
    low = np.uint64(0xFFFFFFFF)
    anchor = (window_minimum((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
    new = np.empty(len(anchor), bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    begins = np.concatenate([[0], ends[:-1]])
    new[begins[begins < len(anchor)]] = True
    start = np.flatnonzero(new)
    # Windows that would run over a text's end are none; they are the last of each text.
    doc = np.searchsorted(ends, start, side="right")
    stop = np.minimum(np.append(start[1:], len(anchor)), ends[doc] - length + 1)
    good = stop > start
    start, stop, doc = start[good], stop[good], doc[good]
    last, a = stop - 1, anchor[start]
    content = (stop - start).astype(np.uint64)
    for at in (start, start + GRAM, start + 2 * GRAM, last + length - 3 * GRAM, last + length - 2 * GRAM, last + length - GRAM):
        content = _mix(content * _C[1] + h[at])
    return doc, start, stop - start, a, h[a], content


def _batches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups of about AT_ONCE bytes: number of the first, the bytes, the ends."""
    at = 0
    while at < len(texts):
        n, size = at, 0
        while n < len(texts) and (n == at or size + len(texts[n]) <= AT_ONCE):
            size += len(texts[n])
            n += 1
        yield at, np.frombuffer(b"".join(texts[at:n]), np.uint8), np.cumsum([len(t) for t in texts[at:n]])
        at = n


def suffix_repeats(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window start in ``data``: whether its longest previous factor reaches ``length``.

    ``place`` orders the starts; equal places precede nothing of each other.
    """
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    n = len(data) + length
    key = np.zeros(n, np.uint64)
    have = 8
    for i in range(have):
        key = (key << np.uint64(8)) | padded[i : i + n]
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        if 2 * have > length:
            break
        key = (rank << np.uint64(32)) | np.append(rank[have:], np.zeros(have, np.uint64))
        have *= 2
    ahead = length - have
    key = (rank[starts] << np.uint64(32)) | rank[starts + ahead]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], place[order]
    # Suffixes next to each other with equal keys have a common prefix of ``length`` or more.
    runs = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    repeated = np.zeros(len(starts), bool)
    for direction in (1, -1):
        p, r = pos[::direction], runs[::direction]
        repeated[order[::direction][_smaller_before(p, r)]] = True
    return repeated


def _smaller_before(pos: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Indices whose previous smaller position lies in their run of common prefixes."""
    before = np.arange(-1, len(pos) - 1)
    before[np.append(True, runs[1:] != runs[:-1])[: len(pos)]] = -1
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        # All positions between an index and its pointer are no smaller: following pointers skips none.
        open_ = open_[pos[before[open_]] >= pos[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return np.flatnonzero(before >= 0)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("twin"), text.alias("text"))


def _anchored(rows: DataFrame, length: int) -> DataFrame:
    """One row per stretch: anchor, content, id, twin, spot = start * 256 + windows, known.

    Stretches equal to an earlier one of the same batch are known repeats before any shuffle: they get a
    key of their own in place of their anchor, so a string that is everywhere is no hot key.
    """

    def combined(anchor: np.ndarray, content: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """True for rows whose anchor and content an earlier start (id, start) of the batch has too."""
        key = anchor ^ (content * _C[2])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        some = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        some = some[np.lexsort((start[some], ids[some], content[some], anchor[some]))]
        known = np.zeros(len(key), bool)
        if len(some):
            new = np.append(True, (anchor[some[1:]] != anchor[some[:-1]]) | (content[some[1:]] != content[some[:-1]]))
            lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
            known[some] = (ids[some] != ids[lead]) | (start[some] != start[lead])
        return known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, twins = batch.column("id").to_numpy(), batch.column("twin").to_numpy()
            found = []
            for first, data, ends in _batches(texts):
                doc, start, n, _, anchor, content = stretches(data, ends, length)
                begin = np.concatenate([[0], ends[:-1]])[doc]
                found.append((anchor, content, ids[doc + first], twins[doc + first], (start - begin) * 256 + n))
            if found:
                anchor, content, own, twin, spot = (np.concatenate(c) for c in zip(*found))
                known = combined(anchor, content, own, spot >> 8)
                anchor = np.where(known, _mix(own.view(np.uint64) * _C[0] + spot.view(np.uint64)), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(own), pa.array(twin), pa.array(spot), pa.array(known)], names=["anchor", "content", "id", "twin", "spot", "known"])

    return rows.mapInArrow(run, "anchor long, content long, id long, twin int, spot long, known boolean")


def _sifted(anchored: DataFrame, partitions: int) -> DataFrame:
    """Of the sorted stretches: repeats of an equal one (whole), and firsts of contents that share an anchor.

    An anchor with more than HOT contents has a row with neither (``whole`` null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the first row of the anchor at hand, while it has one content
        anchor = content = first = None
        seen = 0  # contents of the anchor at hand
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            c = [batch.column(n).to_numpy() for n in ("anchor", "content", "id", "twin", "spot")]
            if known.any():
                yield _sift_rows([x[known] for x in c], True)
                c = [x[~known] for x in c]
            n = len(c[0])
            if not n:
                continue
            prior_a = np.append(anchor if anchor is not None else ~c[0][0], c[0][:-1])
            prior_c = np.append(content if content is not None else ~c[1][0], c[1][:-1])
            new_a = c[0] != prior_a
            new_c = new_a | (c[1] != prior_c)
            # id and start of the first stretch with this content, for every row
            start = c[4] >> 8
            leader = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            lead_id = np.where(leader >= 0, c[2][leader], first[0] if first else 0)
            lead_start = np.where(leader >= 0, start[leader], first[1] if first else 0)
            repeat = ~new_c & ((c[2] != lead_id) | (start != lead_start))
            # Firsts of contents: all but those of an anchor with one content only.
            firsts = np.flatnonzero(new_c)
            more = ~new_a[firsts]  # a further content of its anchor
            if len(firsts):
                place = np.arange(len(firsts))
                opened = np.maximum.accumulate(np.where(more, -1, place))
                nth = np.where(opened >= 0, place - opened + 1, seen + place + 1)
                seen = int(nth[-1])
                if (hot := firsts[nth == HOT + 1]).size:
                    yield _sift_rows([x[hot] for x in c], None)
            opens = np.zeros(len(firsts), bool)
            opens[:-1] = new_a[firsts[:-1]] & more[1:]
            keep = firsts[more | opens]
            out = [np.flatnonzero(repeat), keep]
            if held is not None and len(firsts) and more[0]:
                yield _sift_rows([x[None] for x in held], False)
                held = None
            elif len(firsts):
                held = None
            if len(firsts) and new_a[firsts[-1]]:
                held = [x[firsts[-1]] for x in c]
            for at, whole in zip(out, (True, False)):
                if len(at):
                    yield _sift_rows([x[at] for x in c], whole)
            anchor, content = c[0][-1], c[1][-1]
            first = (int(lead_id[-1]), int(lead_start[-1]))

    dealt = anchored.repartition(partitions, "anchor").sortWithinPartitions("anchor", "content", "id", "spot", "twin")
    return dealt.mapInArrow(run, "anchor long, id long, twin int, spot long, whole boolean")


def _sift_rows(c: list[np.ndarray], whole: bool | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64()), pa.array([whole] * len(c[0]), pa.bool_())], names=["anchor", "id", "twin", "spot", "whole"])


def _halves(rows: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """The stretches in ``mixed`` cut from their texts, by what lies left or right of the anchor."""
    reach = (length - GRAM + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 256):
            out: list[tuple] = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for key, twin, text, spots in zip(batch.column("id").to_pylist(), batch.column("twin").to_pylist(), texts, batch.column("spots").to_pylist()):
                _, starts, n, anchors, _, _ = stretches(np.frombuffer(text, np.uint8), np.array([len(text)]), length)
                at = np.searchsorted(starts, np.array(sorted(spots)) >> 8)
                for start, windows, anchor in zip(starts[at].tolist(), n[at].tolist(), anchors[at].tolist()):
                    # A window from ``w`` on holds anchor - w bytes before the anchor.
                    turn = anchor - reach  # from here on more lies after the anchor
                    for low, high, shared in ((start, min(start + windows, turn), (anchor - reach, anchor + GRAM)), (max(start, turn), start + windows, (anchor, anchor + GRAM + length - GRAM - reach))):
                        if low < high:
                            out.append((xxhash.xxh3_64_intdigest(text[shared[0] : shared[1]]) - 2**63, key, twin, low, text[low : high + length - 1]))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "id", "twin", "start", "bytes"])

    spots = mixed.groupBy("id", "twin").agg(F.collect_list("spot").alias("spots"))
    joined = rows.join(spots, ["id", "twin"])
    return joined.select("id", "twin", "text", "spots").mapInArrow(run, "key long, id long, twin int, start long, bytes binary")


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with an id in ``ids``, and few others: dropped where they are read, so their texts are not shuffled."""
    bloom = Bloom(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.passed(batch.column("spots")))).select(["id", "twin", "text"])

    return rows.withColumn("spots", bloom.spots()).mapInArrow(run, "id long, twin int, text string")


def _one_by_one(rows: DataFrame, stretched: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the stretches in ``stretched``, as spots (id, twin, spot): all but the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 64):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for key, twin, text, spots in zip(batch.column("id").to_pylist(), batch.column("twin").to_pylist(), texts, batch.column("spots").to_pylist()):
                at = np.unique(np.concatenate([np.arange(s >> 8, (s >> 8) + (s & 255)) for s in spots]))
                same = b"".join(xxhash.xxh3_128_digest(text[k : k + length]) for k in at.tolist())
                high, low = np.frombuffer(same, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (high, low, np.full(len(at), key), np.full(len(at), twin, np.int32), at)], names=["high", "low", "id", "twin", "start"])

    spots = stretched.groupBy("id", "twin").agg(F.collect_list("spot").alias("spots"))
    windows = _likely(rows, stretched).join(spots, ["id", "twin"]).select("id", "twin", "text", "spots").mapInArrow(run, "high long, low long, id long, twin int, start long")
    windows = cut(windows, "windows")
    # Written, so that the join is one of two shuffles, whose hot keys AQE splits.
    firsts = cut(windows.groupBy("high", "low").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"), "window-firsts")
    later = F.struct("id", "start") > F.col("first")
    return windows.join(firsts, ["high", "low"]).where(later).select("id", "twin", (F.col("start") * 256 + 1).alias("spot"))


def _factored(halves: DataFrame, partitions: int, length: int) -> DataFrame:
    """Repeated windows among stretches that share a key, as spots (id, twin, spot)."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        sizes = np.array([len(r[4]) for r in rows])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        windows = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        ids, starts = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        order = np.lexsort((starts[row] + within, ids[row]))
        place = np.empty(len(row), np.int64)
        a, b = ids[row][order], (starts[row] + within)[order]
        place[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        hit = suffix_repeats(data, base[row] + within, place, length)
        # Repeated windows in a row of one stretch are one spot.
        at = np.flatnonzero(hit)
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64())], names=["id", "twin", "spot"])
        new = np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))
        first = at[new]
        n = np.diff(np.append(np.flatnonzero(new), len(at)))
        r = row[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(np.array([x[2] for x in rows], np.int32)[r]), pa.array((starts[r] + within[first]) * 256 + n)], names=["id", "twin", "spot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "twin", "start", "bytes"))):
                if group and row[0] != group[-1][0]:
                    held += group if len(group) > 1 else []
                    size += sum(len(r[4]) for r in group) if len(group) > 1 else 0
                    group = []
                    if size >= SORTED_AT_ONCE:
                        yield solve(held)
                        held, size = [], 0
                group.append(row)
        held += group if len(group) > 1 else []
        if held:
            yield solve(held)

    return halves.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, "id long, twin int, spot long")


def spans(spots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Disjoint (start, end) of the bytes that the spots cover, in order; spans that touch are one."""
    start = np.sort(spots)
    start, end = start >> 8, (start >> 8) + (start & 255) - 1 + length
    end = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > end[:-1])
    return np.stack([start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], axis=1)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, twin, spots): repeated windows of each text that has any; twin tells texts of one id apart."""
    partitions = shuffle_partitions(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col).where("id is not null")
    sifted = cut(_sifted(_anchored(rows.where(F.octet_length("text") >= length), length), partitions), "stretches")
    firsts, hot = sifted.where("not whole"), sifted.where("whole is null").select("anchor")
    found = sifted.where("whole").select("id", "twin", "spot")
    if n := hot.count():
        hot = F.broadcast(hot) if n <= FEW else hot
        found = found.unionByName(_one_by_one(rows, firsts.join(hot, "anchor", "left_semi"), length))
        firsts = firsts.join(hot, "anchor", "left_anti")
    found = found.unionByName(_factored(_halves(rows, firsts.select("id", "twin", "spot"), length), partitions, length))
    return found.groupBy("id", "twin").agg(F.collect_list("spot").alias("spots"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and ``kept``: the bytes left (``digest``: their sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, spots in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spots").to_pylist()):
                gone = spans(np.array(spots, np.int64), length).tolist() if spots else []
                kept, at = [], 0
                for start, end in gone:
                    kept.append(text[at:start])
                    at = end
                kept = b"".join([*kept, text[at:]]) if gone else text
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*out)) if out else [()] * 4
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(repeats(docs, id_col, text_col, length), ["id", "twin"], "left").select("id", "text", "spots")
    result = joined.mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return result.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256" if digest else "kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


ORACLE = f"""WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5(t[s:s + {LENGTH - 1}]) AS h FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - {LENGTH - 2})) AS s FROM d WHERE octet_length(t) >= {LENGTH})),
f AS (SELECT h, min((doc_id, s)) AS first FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, s FROM w JOIN f USING (h) WHERE (doc_id, s) > first),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + {LENGTH} AS b FROM k GROUP BY doc_id, k),
cuts AS (SELECT doc_id, list(a ORDER BY k) AS a, list(b ORDER BY k) AS b FROM spans GROUP BY doc_id),
j AS (SELECT d.doc_id, hex(t) AS x, a, b FROM d LEFT JOIN cuts ON cuts.doc_id = d.doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(b) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda i: substr(x, 2 * (CASE WHEN i = 1 THEN 1 ELSE b[i - 1] END) - 1,
    2 * ((CASE WHEN i > len(a) THEN length(x) // 2 + 1 ELSE a[i] END) - (CASE WHEN i = 1 THEN 1 ELSE b[i - 1] END)))), '') END)) AS kept_sha256 FROM j"""
