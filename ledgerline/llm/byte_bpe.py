"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks of ``chunk`` code points that overlap by ``overlap``, each pre-tokenised from its
own first character and then stitched.  A text of one chunk is encoded where it is read; the chunks of
longer ones are dealt out over the cluster first.  Both go through the same steps.  A chunk may begin inside a pre-token, so its first
boundaries can be wrong; but the pattern looks back at nothing, so from the first boundary that it
shares with the chunk before, both agree for good.  Each chunk encodes all its pre-tokens and keeps
the boundaries inside its overlaps; a pass over the chunks of a document in order joins them at the
first shared boundary, and only needs the chunk at hand.  Where the overlap has no shared boundary
(one pre-token longer than the overlap), the pass pre-tokenises from the last good boundary until it
meets the later chunk: exact in every case.

Decoding concatenates the raw bytes of the ids.

Defined results: a null or empty text has no ids; special strings are ordinary text; repeated rows
each get their own result, as do rows without an id; an empty table gives an empty result; columns besides
id and text are ignored, whatever their names.  The
operator returns ids as a binary of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cached, shuffle_partitions, slices, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Distinct pre-tokens that a worker remembers before it starts afresh; bounds memory, not results.
MEMO = 100_000


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec(dict):
    """Pre-token -> its ids as bytes; the merges are the library's."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        pattern = pattern or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        # Classes of characters as the library's own pattern engine has them; this module's engine knows
        # a newer Unicode version.  One byte-level vocabulary is enough to see whether a pattern matches.
        single = {bytes([i]): i for i in range(256)}
        self.classes = [(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=single, special_tokens={}), stand) for p, stand in ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", " "))]
        self.later = regex.compile("[԰-\U0010ffff]")
        self.stands: dict[int, str] = {}
        super().__init__()

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        ids = self.library._encode_single_piece(piece)
        out = self[piece] = b"".join(i.to_bytes(4, "little") for i in ids)
        return out

    def _stand(self, c: str) -> str:
        return next((stand for codec, stand in self.classes if codec.encode_ordinary(c)), "¡")

    def plain(self, text: str) -> str:
        """``text`` with the characters of later scripts replaced by one of the class the library gives them."""
        if not self.later.search(text):
            return text
        for c in set(self.later.findall(text)):
            if ord(c) not in self.stands:
                self.stands[ord(c)] = self._stand(c)
        return text.translate(self.stands)

    def split(self, text: str, start: int = 0) -> list[str]:
        plain = self.plain(text)
        if plain is text and not start:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain, start)]

    def decode(self, ids: bytes) -> bytes:
        return self.library.decode_bytes(memoryview(ids).cast("I").tolist())


def _codec(path: str) -> Codec:
    return cached(f"byte codec {path}", lambda: Codec(path))


class Chunk:
    """A stretch of a text with its pre-tokens: where each ends, and how many ids stand before that end."""

    def __init__(self, base: int, text: str, ends: np.ndarray, counts: np.ndarray, ids: bytes) -> None:
        self.base, self.text, self.ends, self.counts, self.ids, self.first = base, text, ends, counts, ids, 0

    @classmethod
    def of(cls, codec: Codec, base: int, text: str) -> Chunk:
        pieces = codec.split(text)
        ids = list(map(codec.__getitem__, pieces))
        return cls(base, text, base + np.cumsum(list(map(len, pieces)), dtype=np.int64), np.cumsum(list(map(len, ids)), dtype=np.int64) // 4, b"".join(ids))

    def slice(self, end: int) -> bytes:
        """The ids of the pre-tokens from ``first`` to before ``end``."""
        before = lambda k: 4 * int(self.counts[k - 1]) if k else 0
        return self.ids[before(self.first) : before(end)]


class Stitch:
    """Joins the chunks of one document, given in order; hands out ids as soon as they are certain."""

    def __init__(self, codec: Codec) -> None:
        self.codec: Codec = codec
        self.held: Chunk | None = None

    def feed(self, chunk: Chunk, last: bool) -> bytes:
        out = b""
        if self.held is not None:
            out, chunk = self._join(self.held, chunk)
        if last:
            self.held = None
            return out + chunk.slice(len(chunk.ends))
        self.held = chunk
        return out

    def _join(self, was: Chunk, new: Chunk) -> tuple[bytes, Chunk]:
        # All but the last two pre-tokens are certain: what ended them is in the chunk.
        known = was.ends[was.first : -2]
        shared = known[(known >= new.base) & np.isin(known, np.append(new.ends, new.base))]
        if len(shared):
            new.first = int(np.searchsorted(new.ends, shared[0], side="right"))
            return was.slice(int(np.searchsorted(was.ends, shared[0])) + 1), new
        # No shared boundary: go on from the last certain one over both chunks.
        k = max(len(was.ends) - 2, was.first)
        start = int(was.ends[k - 1]) if k else was.base
        return was.slice(k), Chunk.of(self.codec, start, was.text[start - was.base : max(start, new.base) - was.base] + new.text[max(start - new.base, 0) :])


def encode_text(codec: Codec, text: str, chunk: int, overlap: int) -> bytes:
    """All ids of ``text`` by chunks."""
    stitch, starts = Stitch(codec), range(0, max(len(text), 1), chunk)
    return b"".join(stitch.feed(Chunk.of(codec, s, text[s : s + chunk + overlap]), s == starts[-1]) for s in starts)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """Per row: id, n_tokens, and ``ids`` with the text decoded from them (``digest``: hashes of both instead)."""
    path = path or ranks_path()
    result = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "id long, n_tokens long, ids binary, decoded binary"

    class Out:
        """What is known of one document's ids so far."""

        def __init__(self) -> None:
            self.n, self.ids, self.raw = 0, hashlib.sha256() if digest else [], hashlib.sha256() if digest else []
            self.put: tuple[Callable, Callable] = (self.ids.update, self.raw.update) if digest else (self.ids.append, self.raw.append)

        def add(self, ids: bytes, codec: Codec) -> None:
            self.n += len(ids) // 4
            self.put[0](ids)
            self.put[1](codec.decode(ids))

        def row(self) -> tuple:
            return (self.n, self.ids.hexdigest(), self.raw.hexdigest()) if digest else (self.n, b"".join(self.ids), b"".join(self.raw))

    kind = pa.string() if digest else pa.binary()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["id", "n_tokens", "ids", "decoded"]

    def packed(ids: pa.Array | list, rows: list[tuple]) -> pa.RecordBatch:
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, kind), pa.array(b, kind)], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                (out := Out()).add(encode_text(codec, text, chunk, overlap), codec)
                rows.append(out.row())
            yield packed(batch.column(0), rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in slices(batches, 64):
            found = [Chunk.of(codec, base, text) for base, text in zip(batch.column("base").to_pylist(), batch.column("piece").to_pylist())]
            made = [pa.array([f(c) for c in found], pa.binary()) for f in (lambda c: c.ends.tobytes(), lambda c: c.counts.tobytes(), lambda c: c.ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "ends", "counts", "ids"])

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        stitch, out = Stitch(codec), Out()
        for batch in slices(batches, 64):
            ids, rows = [], []
            for r in batch.to_pylist():
                chunk = Chunk(r["base"], r["piece"], np.frombuffer(r["ends"], np.int64), np.frombuffer(r["counts"], np.int64), r["ids"])
                out.add(stitch.feed(chunk, r["last"]), codec)
                if r["last"]:
                    ids.append(r["id"])
                    rows.append(out.row())
                    stitch, out = Stitch(codec), Out()
            yield packed(ids, rows)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, result)
    n = shuffle_partitions(docs.sparkSession)
    chunks = (
        rows.where(F.length("text") > chunk)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("base", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))))
        .select("id", "row", "base", F.substr("text", F.col("base") + 1, F.lit(chunk + overlap)).alias("piece"), (F.col("base") + chunk >= F.length("text")).alias("last"))
    )
    # First by chunk, so that one long text keeps many tasks busy; then each document's chunks in order.
    made = chunks.repartition(n, "row", "base").mapInArrow(pieces, f"{_ddl(chunks)}, ends binary, counts binary, ids binary")
    long = made.repartition(n, "row").sortWithinPartitions("row", "base").mapInArrow(stitched, result)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
