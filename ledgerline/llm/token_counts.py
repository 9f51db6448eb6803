"""Token counts under a sentencepiece BPE vocabulary, with a whole-token shortcut.

A pre-token is a run of spaces with the characters up to the next space.  No vocabulary string holds
a space after another character (checked when the vocabulary is loaded), so no merge crosses the
border of two pre-tokens and a text's count is the sum over its pre-tokens.  Offline - once per
worker, over the whole vocabulary - the strings that encode alone as a single token are found;
pre-tokens among them count 1 without any merge.  Only the rest goes through the merges of the
library, each distinct string once while it stays in a bounded memo.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows, and rows without an id, each
get their count; an empty table gives an empty result;
columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cached, slices, table

MODEL = "piece_bpe_32k.model"
#: Distinct pre-tokens that a worker remembers before it starts afresh; bounds memory, not results.
MEMO = 150_000
#: The vocabulary writes a space as this sign, and reads the sign in a text as a space.
SIGN = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter(dict):
    """Pre-token -> number of tokens; misses are merged by the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        if any(SIGN in p.lstrip(SIGN) for p in pieces):
            raise ValueError("a vocabulary string crosses pre-tokens; the counts would not add up")
        self.whole = self.prove(pieces)
        super().__init__(self.whole)

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """The vocabulary strings, written as pre-tokens, that encode alone as one token."""
        words = [" " + p[1:] for p in pieces if p.startswith(SIGN) and len(p) > 1 and SIGN not in p[1:]]
        whole = {w: 1 for w, ids in zip(words, self.processor.encode([w[1:] for w in words], num_threads=1)) if len(ids) == 1}
        # A last space is the sign alone; the library adds it to no empty text, so count it in a longer one.
        alone = len(self.processor.encode("a ")) - len(self.processor.encode("a"))
        return whole | {" ": alone, SIGN: alone}

    def __missing__(self, pre_token: str) -> int:
        if len(self) > MEMO:
            self.clear()
            self.update(self.whole)
        # The library puts one space before what it encodes: the first of the pre-token's own.
        n = self[pre_token] = len(self.processor.encode(pre_token[1:]))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        # A pre-token never takes in a line feed's other side: split by spaces (and the sign) alone.
        return sum(map(self.__getitem__, re.findall(f"[ {SIGN}]+[^ {SIGN}]*", " " + text)))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens and whether the text has more than ``limit`` tokens."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = cached(f"token counter {path}", lambda: Counter(path))
        for batch in slices(batches):
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
