"""SimHash near-duplicate detection with tiled exact comparison.

Fingerprints are compared exactly in numpy: tiles of fingerprints are combined by exclusive-or and
bit counts, and pairs of tiles whose population counts differ by more than the radius are skipped.
Comparing all tiles with all tiles grows with the square of the corpus; so the 64 bits are first cut
into radius + k blocks.  Two fingerprints within the radius agree in at least k of them (pigeonhole),
hence comparing the tiles of each value of each k blocks loses no pair.  k follows from the number of
fingerprints, so that few unlike ones share a value; it changes the work, never the links.  A value
shared by more fingerprints than a task should hold is split into pairs of tiles (``phonora.llm.tiles``).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import durable, fresh, map_arrow, one_row, text_buffers
from phonora.llm.components import components, forest, local_roots
from phonora.llm.tiles import BROADCAST_KEYS, by_group, deal

SEED = 42
#: Rows of a tile inside a task, and fingerprints of one block value that one task may get.
TILE, GROUP = 1024, 32_768
#: Groups up to this size are compared by shifting, many groups at a time.
SMALL = 32
#: Unlike fingerprints that may share a block value on average before more blocks are taken.
SHARED = 64
#: Rows from which the component of a fingerprint is broadcast instead of shuffled to.
HOT = 10_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash over word shingles: bits set in over half of the shingles' XXH64 values.

    Words are runs of bytes other than space and \\x09-\\x0D after lower-casing A-Z.  A text of fewer
    words than a shingle has is one shingle; one without words has fingerprint zero.
    """
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    count, total = n - words + 1, np.zeros(64, np.int64)
    at, to = starts[:count].tolist(), ends[words - 1 :].tolist()
    for low in range(0, count, 65536):
        pairs = zip(at[low : low + 65536], to[low : low + 65536], strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of every text as a signed 64-bit integer; null texts read as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in text_buffers(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(docs.withColumn("text_hash", F.xxhash64("text")), run, f"doc_id {kind}, text_hash long, fp long")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _link(fp: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect all fingerprints of one group lying within the radius."""
    bits = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((bits, tile))
    fp, bits, tile = fp[order], bits[order], tile[order]
    label = np.arange(len(fp))
    cuts: list[tuple[int, int]] = []
    for side in np.unique(tile):
        low, high = np.searchsorted(tile, side, "left"), np.searchsorted(tile, side, "right")
        cuts += [(i, min(i + TILE, high)) for i in range(low, high, TILE)]
    crossing = tile[0] != tile[-1]
    for x, (i, j) in enumerate(cuts):
        for k, m in cuts[x:]:
            if crossing and tile[i] == tile[k]:
                continue
            if bits[k] - bits[j - 1] > radius or bits[i] - bits[m - 1] > radius:
                continue
            near = _near(fp[i:j], fp[k:m], radius)
            while True:
                mine, other = label[i:j], label[k:m]
                open_ = near & (mine[:, None] != other[None, :])
                rows = np.flatnonzero(open_.any(axis=1))
                if not len(rows):
                    break
                lowest = np.where(open_[rows], other[None, :], len(fp)).min(axis=1)
                label = local_roots(mine[rows], lowest, len(fp))[label]
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def _compare(radius: int):
    def run(columns: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, tile = columns[2].view(np.uint64), columns[3]
        sizes = np.diff(starts)
        a, b = [], []
        small = np.flatnonzero((sizes > 1) & (sizes <= SMALL) & (tile[starts[:-1]] == tile[starts[1:] - 1]))
        if len(small):
            n = sizes[small]
            at = np.repeat(starts[small], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            end = np.repeat(starts[small] + n, n)
            for shift in range(1, int(n.max())):
                keep = at + shift < end
                at, end = at[keep], end[keep]
                near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= radius]
                a.append(fp[near])
                b.append(fp[near + shift])
        large = np.setdiff1d(np.flatnonzero(sizes > 1), small)
        for g in large:
            x, y = _link(fp[starts[g] : starts[g + 1]], tile[starts[g] : starts[g + 1]], radius)
            a.append(x)
            b.append(y)
        if a and sum(map(len, a)):
            x, y = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return by_group(2, run)


def agreeing(n: int, radius: int) -> int:
    """How many of radius + k blocks must agree: the least k such that ``n`` random fingerprints rarely share a value."""
    return next((k for k in range(1, 5) if n / 2 ** (64 * k // (radius + k)) <= SHARED), 4)


def links(fps: DataFrame, radius: int = 2, group: int = GROUP, agree: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``radius`` differing bits."""
    k = agree or agreeing(fps.count(), radius)
    n = radius + k
    bounds = [64 * i // n for i in range(n + 1)]
    cut = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in itertools.pairwise(bounds)]
    blocks = [F.xxhash64(F.lit(i), *(cut[j] for j in some)) for i, some in enumerate(itertools.combinations(range(n), k))]
    rows = fps.select(F.explode(F.array(*blocks)).alias("block"), "fp", F.bit_count("fp").cast("int").alias("bits"))
    dealt = deal(rows, "block", "fp", "bits", radius, group).select("block", "pair", "fp", "tile")
    dealt = dealt.repartition("block", "pair").sortWithinPartitions("block", "pair", "tile")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, group: int = GROUP, agree: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint can be reached over links of ``radius`` or
    fewer differing bits.  Null, empty and blank texts have fingerprint zero and link like any other.
    Rows with a null doc_id take part; component_id is null only if no reachable row has a doc_id.
    doc_id may have any type with an order.  Repeated rows share a component, texts of any length are
    read whole, and an empty table gives an empty one.  Only doc_id and text are read, so other columns
    cannot clash.
    """
    own = durable(fingerprints(docs, words))
    fps = durable(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(fps.select("fp"), radius, group, agree))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    member = fps.join(member, F.col("fp") == F.col("node")).select("fp", "root", "least", "n")
    least = member.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    linked = member.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id", "n")
    copies = fps.filter("n > 1").join(linked, F.col("fp") == F.col("_fp"), "left_anti").select(F.col("fp").alias("_fp"), F.col("least").alias("component_id"), "n")
    known = durable(linked.unionByName(copies))
    same = F.col("fp") == F.col("_fp")
    joined = own.join(known, same, "left")
    hot = known.filter(F.col("n") > HOT)  # such as zero, that of all empty texts
    if 0 < hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
        joined = own.join(hot, same, "left_anti").join(known, same, "left").unionByName(own.join(hot, same))
    return joined.select("doc_id", "text_hash", "fp", F.when(F.col("_fp").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, columns as they are.

    Of each component the document named by component_id stays, and of repeated rows (equal doc_id
    and text) the one whose other columns have the smallest hash.  Rows without a doc_id stay unless they
    are near a row that has one.
    """
    doc, text, lost = fresh(docs, "_doc", "_text", "_lost")
    found = near_duplicates(docs, words, radius)
    found = found.groupBy("doc_id", "text_hash").agg(F.min("component_id").alias("_component"), F.count("*").alias("_n"))
    change = found.filter("_n > 1 or not (doc_id <=> _component)")
    change = durable(change.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), (~F.col("doc_id").eqNullSafe(F.col("_component"))).alias(lost)))
    key = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    kept = docs.join(change, key, "left_anti")
    repeated = change.filter(~F.col(lost))
    if repeated.limit(1).count():
        kept = kept.unionByName(one_row(docs.join(repeated, key, "left_semi"), "doc_id", "text"))
    return kept
