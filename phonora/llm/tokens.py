"""Token counts by a two-tier lookup of pre-token lengths, map-side only.

A byte-level BPE encodes each pre-token on its own, so a text's token count is the sum of its
pre-tokens' lengths.  The first tier is a broadcast table of frequent pre-tokens, the second a
bounded cache in each Python worker, filled by the tokenizer library.  No pre-token is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonora.llm.common import map_arrow

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Rows, and characters of each, from which frequent pre-tokens are learned; entries of the table;
#: entries of a worker's cache, and the longest of them.  They decide how fast a pre-token is found, never
#: its length.
SAMPLE_ROWS, SAMPLE_CHARS, TABLE, CACHE, SHORT = 400, 20_000, 1 << 16, 1 << 18, 64

#: The library's byte-level split (a fixed value).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LATE = re.compile("[͸-\U0010ffff]")
#: Characters that the two libraries' Unicode versions may class differently.
_UNASSIGNED = regex.compile(r"\p{Cn}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary file lies; it is read in place and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Lengths(dict):
    """Token counts of pre-tokens; what is missing is encoded once and kept while there is room."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        super().__init__(table)
        self.table, self.room, self.encoder = table, len(table) + CACHE, tokenizer(path)
        special = [x.content for x in self.encoder.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def __missing__(self, token: str) -> int:
        n = len(self.encoder.encode(token, add_special_tokens=False).ids)
        if len(self) >= self.room:
            self.clear()
            self.update(self.table)
        if len(token) <= SHORT:
            self[token] = n
        return n

    def count(self, text: str) -> int:
        whole = self.special is not None and self.special.search(text)
        if whole or not text.isascii() and _LATE.search(text) and _UNASSIGNED.search(text):
            return len(self.encoder.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, _SPLIT.findall(text)))


@cache
def _lengths(path: str, keys: bytes, counts: bytes) -> Lengths:
    """One table for each worker process."""
    names = keys.decode().split("\0") if counts else []
    return Lengths(path, dict(zip(names, np.frombuffer(counts, np.uint8).tolist(), strict=True)))


def frequent(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, size: int = TABLE) -> tuple[bytes, bytes]:
    """The most frequent pre-tokens of a bounded sample, zero-separated, and their lengths of up to 255."""
    total = docs.count()
    share = min(1.0, 2 * rows / max(total, 1))
    pick = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 32)) < int(share * (1 << 32))
    texts = docs.filter(pick & F.col("text").isNotNull()).select(F.substring(F.col("text").cast("string"), 1, SAMPLE_CHARS).alias("text"), F.xxhash64("doc_id", "text").alias("h")).orderBy("h").limit(rows)
    seen: Counter[str] = Counter()
    for row in texts.toLocalIterator():
        seen.update(_SPLIT.findall(row["text"]))
    lengths = Lengths(path, {})
    found = [(t, n) for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size] if "\0" not in t and (n := lengths[t]) < 256]
    return "\0".join(t for t, _ in found).encode(), bytes(n for _, n in found)


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    n_tokens is what the tokenizers library gives for the whole text without begin, end or added
    special tokens, special strings inside texts handled as by default.  Null texts read as empty: 0
    bytes, 0 tokens.  Repeated rows are counted each, texts of any length whole; an empty table gives an
    empty one.  Only doc_id and text are read, so other columns cannot clash.
    """
    spark: SparkSession = docs.sparkSession
    path = path or vocabulary_path()
    shared = spark.sparkContext.broadcast(frequent(docs, path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = _lengths(path, *shared.value)
        n = pa.array([lengths.count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return map_arrow(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
