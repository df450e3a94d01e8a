"""Benchmark decontamination: test n-grams found in training texts.

The normalised word windows of the benchmark are hashed into a sorted array that is broadcast.  A scan
hashes every window of every document with vectorised prefix hashes, looks it up, and verifies each hit
byte by byte; nothing is shuffled.  A benchmark too large for that is broadcast as a filter of bounded
size instead; the few windows that pass it meet the benchmark's windows in a join that compares their
bytes.  Either way documents are scanned once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import durable, fresh, map_arrow, text_buffers

WINDOW = 13
#: Bytes of benchmark text that are broadcast with an index, which takes about five times that.
BLOCK_BYTES = 8 << 20
#: Of a larger benchmark: bits of the filter for each window, its size at most (as a power of two), and the
#: bits that a window must find set.
FILTER_SHARE, FILTER_BITS, PROBES = 16, 31, 4
#: Bytes of document text that one vectorised pass holds, unless one text is longer.
PASS_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: 0-9, a-z and everything outside ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)])
        _INVERSE = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, inverse, np.uint64), dtype=np.uint64)])
    return _POWERS, _INVERSE


class Words:
    """The words of many texts: normalised bytes, where words start and end, and which text they belong to."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        low = _LOWER[raw]
        word = _WORD[low]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        self.raw_start, self.raw_end = edge[::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.offset = np.concatenate([[0], bounds[:-1]])
        self.of = np.searchsorted(bounds, self.raw_start, "right")
        self.first = np.searchsorted(self.raw_start, np.concatenate([[0], bounds]))
        after = np.zeros(len(low), bool)
        if len(edge):
            after[self.raw_end] = True
        low = np.where(word, low, np.uint8(32))
        self.text = low[word | after]
        lengths = self.raw_end - self.raw_start + 1
        self.end = np.cumsum(lengths) - 1
        self.start = self.end - lengths + 1
        power, self.inverse = _powers(len(self.text) + 1)
        self.prefix = np.zeros(len(self.text) + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + 1) * power[: len(self.text)], out=self.prefix[1:])
        self.bytes = self.text.tobytes()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each window of ``n`` words inside one text."""
        count = len(self.start) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.of[:count] == self.of[n - 1 :])
        s, e = self.start[at], self.end[at + n - 1]
        h = (self.prefix[e] - self.prefix[s]) * self.inverse[s]
        return at, h ^ (h >> np.uint64(32))

    def window(self, at: int, n: int) -> bytes:
        return self.bytes[self.start[at] : self.end[at + n - 1]]


class Index:
    """Windows of benchmark items: sorted hashes to find them, and where they lie in the items' text to verify them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        held, at_byte = [], 0
        for low, high in passes([t for _, t in items]):
            words = Words([t for _, t in items[low:high]])
            count = np.diff(words.first)
            for n in {min(window, int(c)) for c in count if c}:
                at, h = words.windows(n)
                of = words.of[at]
                right = count[of] >= window if n == window else count[of] == n
                at, h, of = at[right], h[right], of[right]
                parts[n].append((h, words.start[at] + at_byte, words.end[at + n - 1] + at_byte, of + low))
            held.append(words.bytes)
            at_byte += len(words.bytes)
        self.text = b"".join(held)
        self.hashes, self.places, self.maps = {}, {}, {}
        for n, found in parts.items():
            h, start, end, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            self.hashes[n] = h = h[order]
            self.places[n] = start[order], end[order], item[order].astype(np.int32)
            shift = np.uint64(64 - max(16, min(24, len(h).bit_length() + 6)))
            bitmap = np.zeros(1 << int(64 - shift), bool)
            bitmap[h >> shift] = True
            self.maps[n] = shift, bitmap

    def items(self, n: int, h: np.uint64, window: bytes) -> set[str]:
        """Names of the items that have a window, compared byte by byte."""
        low, high = np.searchsorted(self.hashes[n], h, "left"), np.searchsorted(self.hashes[n], h, "right")
        start, end, item = self.places[n]
        return {self.names[item[k]] for k in range(low, high) if self.text[start[k] : end[k]] == window}

    def scan(self, texts: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray, set[str]]]:
        """For each text: words, first and last word (exclusive) of each occurring window, items that occur."""
        words = Words(texts)
        found: dict[int, list] = defaultdict(list)
        for n, known in self.hashes.items():
            at, h = words.windows(n)
            shift, bitmap = self.maps[n]
            maybe = np.flatnonzero(bitmap[h >> shift])
            if len(maybe):
                place = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                maybe = maybe[known[place] == h[maybe]]
            for i, hash_ in zip(at[maybe].tolist(), h[maybe], strict=True):
                names = self.items(n, hash_, words.window(i, n))
                if names:
                    found[int(words.of[i])].append((i, i + n, names))
        out = []
        for k in range(len(texts)):
            first, last = int(words.first[k]), int(words.first[k + 1])
            hits = found.get(k, [])
            low = np.array([x[0] - first for x in hits], np.int64)
            high = np.array([x[1] - first for x in hits], np.int64)
            out.append((last - first, low, high, set().union(*(x[2] for x in hits)) if hits else set()))
        self.words = words
        return out


def passes(texts: list[bytes], limit: int = PASS_BYTES) -> list[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes each."""
    cuts, held, low = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            cuts.append((low, i))
            low, held = i, 0
        held += len(t)
    return [*cuts, (low, len(texts))] if texts else []


def covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie inside any range."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``benchmark`` as (name, text), and its bytes of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _index(items: DataFrame, window: int):
    rows = [(r["name"], r["text"].encode()) for r in items.toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast(Index(rows, window))


def _scanned(index: Index, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[str]]]:
    for low, high in passes(texts):
        yield from index.scan(texts[low:high])


def _item_windows(texts: list[bytes], window: int) -> Iterator[tuple[int, int, np.ndarray, Words, np.ndarray]]:
    """(number of the first text, words, hashes, words of some texts, first words) of the windows of benchmark texts."""
    for low, high in passes(texts):
        words = Words(texts[low:high])
        count = np.diff(words.first)
        for n in sorted({min(window, int(c)) for c in count if c}):
            at, h = words.windows(n)
            of = words.of[at]
            right = count[of] >= window if n == window else count[of] == n
            yield low, n, _with_length(h[right], n), words, at[right]


def _with_length(h: np.ndarray, n: int) -> np.ndarray:
    return h ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _probe(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th place of each hash in a filter of 2 ** ``bits`` bits."""
    x = (h ^ (h >> np.uint64(29))) * np.uint64((0xBF58476D1CE4E5B9 + 2 * k * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    return x >> np.uint64(64 - bits)


def _passes_filter(h: np.ndarray, bits: int, mask: np.ndarray) -> np.ndarray:
    """Which hashes find all their bits set."""
    at = np.arange(len(h))
    for k in range(PROBES):
        place = _probe(h[at], bits, k)
        at = at[(mask[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _filter(items: DataFrame, window: int) -> tuple[np.ndarray, set[int], int]:
    """(filter of the hashes of all windows, their lengths in words, power of two of its bits).

    Hashes pass through the driver in parts, only the filter stays.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(n, h.tobytes()) for _, n, h, _, _ in _item_windows(text_buffers(batch.column(0)), window)]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), pa.array([h for _, h in found], pa.binary())], ["n", "h"])

    hashed = durable(map_arrow(items.select("text"), run, "n int, h binary"))
    total = hashed.agg(F.sum(F.octet_length("h"))).first()[0] or 0
    bits = max(10, min(FILTER_BITS, (FILTER_SHARE * total // 8).bit_length()))
    mask, lengths = np.zeros(1 << (bits - 3), np.uint8), set()
    for row in hashed.toLocalIterator():
        lengths.add(row["n"])
        for k in range(PROBES):
            place = _probe(np.frombuffer(row["h"], np.uint64), bits, k)
            np.bitwise_or.at(mask, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return mask, lengths, bits


def _hits(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row, n_words) of every row, (_doc, _row, places, items) of the different rows with hits).

    ``row`` is a hash of the text; places are [first word, words] of the occurring windows.
    """
    mask, lengths, bits = _filter(items, window)
    shared = docs.sparkSession.sparkContext.broadcast((mask, lengths, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask, lengths, bits = shared.value
        texts, n_words, found = text_buffers(batch.column(1)), [], []
        for low, high in passes(texts):
            words = Words(texts[low:high])
            first = words.first
            n_words += np.diff(first).tolist()
            own: list[list[dict]] = [[] for _ in range(high - low)]
            for n in lengths:
                at, h = words.windows(n)
                h = _with_length(h, n)
                for i in _passes_filter(h, bits, mask).tolist():
                    k = int(words.of[at[i]])
                    own[k].append({"at": int(at[i] - first[k]), "n": n, "h": int(h[i].astype(np.int64)), "w": words.window(int(at[i]), n)})
            found += own
        inner = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("w", pa.binary())])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(inner))], ["doc_id", "row", "n_words", "found"])

    def itemise(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, rows = batch.column(0).to_pylist(), []
        for low, n, h, words, at in _item_windows(text_buffers(batch.column(1)), window):
            rows += [(n, x, words.window(i, n), names[low + k]) for x, i, k in zip(h.view(np.int64).tolist(), at.tolist(), words.of[at].tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["_n", "_h", "_w", "name"])

    scanned = durable(map_arrow(docs.withColumn("row", F.xxhash64("text")), scan, f"doc_id {kind}, row long, n_words long, found array<struct<at: int, n: int, h: bigint, w: binary>>"))
    known = map_arrow(items, itemise, "_n int, _h long, _w binary, name string").groupBy("_n", "_h", "_w").agg(F.collect_set("name").alias("names"))
    maybe = scanned.filter(F.size("found") > 0).select("doc_id", "row", F.explode("found").alias("f")).select("doc_id", "row", "f.*").dropDuplicates(["doc_id", "row", "at", "n"])
    hits = maybe.join(known, (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")) & (F.col("w") == F.col("_w")))
    hits = hits.groupBy("doc_id", "row").agg(F.flatten(F.collect_set(F.array("at", "n"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("items"))
    return scanned.drop("found"), hits.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "places", "items")


def _ranges(places: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the windows at ``places``."""
    x = np.array(places or [], np.int64).reshape(-1, 2)
    return x[:, 0], x.sum(axis=1)


def _same_row(doc_id: Column, row: Column) -> Column:
    return doc_id.eqNullSafe(F.col("_doc")) & (row == F.col("_row"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window.  A document word inside any occurrence of a window is hit.  Contaminated: a word is hit and
    at least a twentieth of the words are.  Null and empty texts have no words; an empty table gives an
    empty one and an empty benchmark hits nothing; repeated rows get equal results; texts of any length are
    read whole; repeated items count once by item_id, and a null item_id reads as ''.  Only doc_id and text,
    item_id and text are read.  A benchmark above ``block_bytes`` goes through a filter and a join.
    """
    items, size = _items(benchmark)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def result(ids: pa.Array, found) -> pa.RecordBatch:
        n_words, n_hit, n_items, digests = [], [], [], []
        for n, low, high, items in found:
            n_words.append(n)
            n_hit.append(int(covered(low, high, n).sum()) if len(low) else 0)
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        flags = [h > 0 and 20 * h >= n for n, h in zip(n_words, n_hit, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)), pa.array(digests, pa.string()), pa.array(flags, pa.bool_())], names)

    if size <= block_bytes:
        index = _index(items, window)
        return map_arrow(docs, lambda batch: result(batch.column(0), _scanned(index.value, text_buffers(batch.column(1)))), schema)
    rows, hits = _hits(docs, items, window)
    rows = rows.join(hits, _same_row(F.col("doc_id"), F.col("row")), "left").select("doc_id", "n_words", "places", "items")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, n_words, places, items = (c.to_pylist() for c in batch.columns)
        return result(batch.column(0), ((n, *_ranges(p), set(x or ())) for n, p, x in zip(n_words, places, items, strict=True)))

    return map_arrow(rows, finish, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they are; null and empty texts stay."""
    items, size = _items(benchmark)
    if size <= block_bytes:
        index, at = _index(items, window), docs.columns.index("text")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = [(n, int(covered(a, b, n).sum()) if len(a) else 0) for n, a, b, _ in _scanned(index.value, text_buffers(batch.column(at)))]
            return batch.filter(pa.array([h == 0 or 20 * h < n for n, h in hit], pa.bool_()))

        return map_arrow(docs, run, docs.schema)
    own, bad_doc, bad_row = fresh(docs, "_own", "_bad_doc", "_bad_row")
    text = F.col("text").cast("string")
    # A document is named by doc_id and hash of the text together, in one struct that passes through as its id.
    named = docs.select(F.struct(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("row")).alias("doc_id"), text.alias("text"))
    bad = contamination(named, benchmark, window, block_bytes).filter("contaminated").select(F.col("doc_id.doc").alias(bad_doc), F.col("doc_id.row").alias(bad_row)).distinct()
    docs = docs.withColumn(own, F.xxhash64(text))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_doc)) & (F.col(own) == F.col(bad_row)), "left_anti").drop(own)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the words of occurring benchmark windows cut out of the text, the rest untouched, columns as they are.

    Null and empty texts stay as they are, and repeated rows are cut alike, whatever the size of the benchmark.
    """
    items, size = _items(benchmark)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def cut(text: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
        words, keep = Words([text]), np.ones(len(text), bool)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            keep[words.raw_start[a] : words.raw_end[b - 1]] = False
        return np.frombuffer(text, np.uint8)[keep].tobytes()

    def rewritten(batch: pa.RecordBatch, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        new = [cut(t, *r) if t and len(r[0]) else t for t, r in zip(texts, ranges, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(pa.string()))

    if size <= block_bytes:
        index = _index(items, window)
        return map_arrow(docs, lambda batch: rewritten(batch, [(a, b) for _, a, b, _ in _scanned(index.value, text_buffers(batch.column(at)))]), docs.schema)
    own, doc, row, places = fresh(docs, "_own", "_cut_doc", "_cut_row", "_cut_places")
    _, hits = _hits(docs.select("doc_id", "text"), items, window)
    hits = hits.select(F.col("_doc").alias(doc), F.col("_row").alias(row), F.col("places").alias(places))
    joined = docs.withColumn(own, F.xxhash64("text")).join(hits, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(row)), "left").select(*docs.columns, places)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = rewritten(batch, [_ranges(p) for p in batch.column(len(batch.columns) - 1).to_pylist()])
        return pa.RecordBatch.from_arrays(out.columns[:-1], out.schema.names[:-1])

    return map_arrow(joined, run, docs.schema)
