"""Fuzzy line deduplication by MinHash.

Character-shingle signatures are banded for high recall; lines that share a band are verified by
exact Jaccard similarity; a distributed union-find joins the verified links, and one line of each
component stays: the first by (doc_id, text, position).  Line texts are shuffled only for lines that
share a band with another, and a line goes once to each distinct set of lines it meets.  A band of very
many lines is contracted first: its lines are compared in tiles, each with the same few others, and
only lines that are not connected by then are compared across tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import durable, fresh, one_row, slices, text_buffers
from phonora.llm.components import components, local_roots
from phonora.llm.tiles import by_group

SHINGLE, SIMILARITY = 8, 0.8
#: Bands and rows of each: a pair of similarity 0.8 shares a band with probability 0.985, one of 0.9 with 0.9998.
BANDS, ROWS = 8, 4
#: Lines of one band that one task compares, and lines of a larger band that are compared with all its tiles.
TILE, CENTRES = 512, 16
#: Characters of lines whose shingles are held at a time; larger sets are compared two lines at a time.
HELD = 1 << 20
#: Characters hashed in one pass; line ids that a task remembers so as not to send copies again.
PASS, REMEMBER = 1 << 18, 1 << 17
_A = np.random.default_rng(1).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(2).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def normal(line: bytes) -> str:
    """The form that is compared: lower case, white space squeezed."""
    return " ".join(line.decode(errors="replace").lower().split())


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys (lines x bands) of MinHash signatures over character shingles."""
    gap = "\0" * SHINGLE
    codes = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(x) for x in lines])
    begin = np.cumsum(size + SHINGLE) - size - SHINGLE
    h, p = codes, np.uint32(0x01000193)
    for step in (1, 2, 4):
        h = h[:-step] * p + h[step:]
        p = np.uint32(int(p) * int(p) & 0xFFFFFFFF)
    count = np.maximum(size - SHINGLE + 1, 1)
    offsets = np.cumsum(count) - count
    h = h[np.repeat(begin - offsets, count) + np.arange(count.sum())]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat(h * _A[k] + _B[k], offsets).astype(np.uint64)
        band = keys[:, k // ROWS]
        band += low + np.uint64(k // ROWS + 1)
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return keys


def _bands(docs: DataFrame) -> DataFrame:
    """(band, line): band keys of the lines of all texts; a line is named by the XXH64 of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids: list[int] = []
        texts: list[str] = []

        def out() -> pa.RecordBatch:
            keys = signatures(texts).view(np.int64)
            names = np.repeat(np.array(ids, np.uint64).view(np.int64), BANDS)
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(names)], ["band", "line"])

        for batch in slices(batches):
            held = 0
            for text in text_buffers(batch.column(0)):
                for line in text.split(b"\n"):
                    if not line.strip(b" "):
                        continue
                    name = xxhash.xxh64_intdigest(line, 42)
                    if name in seen:
                        continue
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(name)
                    ids.append(name)
                    texts.append(normal(line))
                    held += len(texts[-1])
                    if held >= PASS:
                        yield out()
                        ids, texts, held = [], [], 0
            if ids:
                yield out()
                ids, texts = [], []

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "band long, line long")


def _sets(tile: int):
    """(band, line) sorted -> (set, line, tile, hot): lines of bands with several lines.

    Bands with the same lines make the same set.  A band of more than ``tile`` lines is hot: its rows pass
    through in tiles, never all at once; the first lines of its first tile are its centres.
    """

    def batch_of(name: np.ndarray, line: np.ndarray, nth: np.ndarray, hot: bool) -> pa.RecordBatch:
        columns = [pa.array(name), pa.array(line), pa.array(nth // tile, pa.int64()), pa.array(np.full(len(line), hot)), pa.array((nth < CENTRES) & hot)]
        return pa.RecordBatch.from_arrays(columns, ["set", "line", "tile", "hot", "centre"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_b, rest_l, passed, last = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, None
        for batch in chain((x for x in batches if x.num_rows), [None]):
            end = batch is None
            if not end:
                b = np.concatenate([rest_b, batch.column(0).to_numpy(zero_copy_only=False)])
                x = np.concatenate([rest_l, batch.column(1).to_numpy(zero_copy_only=False)])
            else:
                b, x = rest_b, rest_l
            if not len(b):
                continue
            fresh = np.ones(len(b), bool)
            fresh[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1])
            if passed and last == (int(b[0]), int(x[0])):
                fresh[0] = False
            b, x = b[fresh], x[fresh]
            if not len(b):
                rest_b, rest_l = b, x
                continue
            at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            stop = np.append(at[1:], len(b))
            first = 0
            if passed:  # the band that is passing through goes on, or has ended
                if b[0] == last[0]:
                    n = stop[0]
                    yield batch_of(b[:n], x[:n], passed + np.arange(n), True)
                    passed, last, first = passed + n, (int(b[0]), int(x[n - 1])), 1
                if first == 0 or len(at) > 1 or end:
                    passed = 0
            if not end and first < len(at):
                keep = at[-1]  # the last band may go on
                rest_b, rest_l, at, stop = b[keep:], x[keep:], at[first:-1], stop[first:-1]
                if len(rest_b) > tile:
                    yield batch_of(rest_b, rest_l, np.arange(len(rest_b)), True)
                    passed, last = len(rest_b), (int(rest_b[0]), int(rest_l[-1]))
                    rest_b, rest_l = rest_b[:0], rest_l[:0]
            else:
                rest_b, rest_l, at, stop = b[:0], x[:0], at[first:], stop[first:]
            size = stop - at
            for s, e in zip(at[size > tile].tolist(), stop[size > tile].tolist(), strict=True):
                yield batch_of(b[s:e], x[s:e], np.arange(e - s), True)
            some = (size > 1) & (size <= tile)
            if some.any():
                at, size = at[some], size[some]
                pick = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
                line = x[pick]
                mixed = line.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                name = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), np.cumsum(size) - size).view(np.int64)
                yield batch_of(np.repeat(name, size), line, np.zeros(len(line), np.int64), False)

    return run


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(max(len(text) - SHINGLE + 1, 1))}


class Shingled:
    """The different shingles of each of many lines, as numbers that are equal where the shingles are."""

    def __init__(self, texts: list[str]) -> None:
        gap = "\0" * SHINGLE
        codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        size = np.array([len(t) for t in texts], np.int64)
        count = np.maximum(size - SHINGLE + 1, 1)
        begin = np.cumsum(size + SHINGLE) - size - SHINGLE
        offsets = np.cumsum(count) - count
        codes[(begin + size)[:, None] + np.arange(SHINGLE)] = 0x110000  # no character, unlike zero
        at = np.repeat(begin - offsets, count) + np.arange(count.sum())
        used = np.zeros(0x110001, bool)
        used[codes] = True
        letters = int(used.sum())
        letter = (np.cumsum(used) - 1)[codes]
        # eight letters are a number in base ``letters``; where that may overflow, parts are numbered
        high = _numbers(letter, SHINGLE, letters) if letters <= 255 else _parts(letter)
        self.kinds, key = _numbered(high[at])
        pairs = np.sort(np.repeat(np.arange(len(texts)), count) * self.kinds + key)
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        of, self.key = pairs // self.kinds, (pairs % self.kinds).astype(np.int32)
        self.size = np.bincount(of, minlength=len(texts))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self._flag = np.zeros(self.kinds, np.int32)

    def common(self, low: int, high: int, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles line ``i`` shares with ``others``, all of them lines from ``low`` to ``high``."""
        mine = self.key[self.start[i] : self.end[i]]
        self._flag[mine] = 1
        both = np.add.reduceat(self._flag[self.key[self.start[low] : self.end[high - 1]]], self.start[low:high] - self.start[low])
        self._flag[mine] = 0
        return both[others - low]

    def neighbours(self, first: np.ndarray) -> np.ndarray:
        """How many shingles each line of ``first`` shares with the line after it."""
        size = self.size[first] + self.size[first + 1]
        at = np.repeat(self.start[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        code = np.sort(np.repeat(np.arange(len(first)), size) * self.kinds + self.key[at])
        twice = code[1:][code[1:] == code[:-1]]
        return np.bincount(twice // self.kinds, minlength=len(first))


def _numbers(letter: np.ndarray, n: int, base: int) -> np.ndarray:
    """The number, one to one, of each ``n`` letters in a row, n a power of two; base ** n must fit 64 bits."""
    h, step, p = letter.astype(np.uint64), 1, base
    while step < n:
        h, step, p = np.append(h[:-step] * np.uint64(p) + h[step:], h[-step:]), 2 * step, p * p
    return h


def _parts(letter: np.ndarray) -> np.ndarray:
    """The same for any alphabet: twos, fours and eights of letters are numbered anew."""
    h, step = letter, 1
    while step < SHINGLE:
        pair = h[:-step] * (int(h.max()) + 1) + h[step:]
        _, h = _numbered(np.append(pair, np.full(step, -1)))
        step *= 2
    return h


def _numbered(x: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different values there are, and the number of each among them."""
    order = np.argsort(x)
    values = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.append(False, values[1:] != values[:-1]))
    return int(out[order[-1]]) + 1, out


def _similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return both >= similarity * (a + b - both) - 1e-9


def link(n: int, near_of) -> np.ndarray:
    """Smallest index of each line's component, given which of some others a line is similar to.

    A line is compared with all others unless every line not yet compared is in one component with it,
    so every pair is either compared or already connected.
    """
    label, open_ = np.arange(n), np.ones(n, bool)
    while True:
        names, counts = np.unique(label[open_], return_counts=True)
        if len(names) < 2:
            return label
        i = int(np.flatnonzero(open_ & (label == names[counts.argmin()]))[0])
        open_[i] = False
        near = near_of(i, np.flatnonzero(label != label[i]))
        label = local_roots(np.full(len(near), label[i]), label[near], n)[label]


def roots(groups: list[list[str]], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """For each group of lines, the smallest index of each line's component over pairs of that similarity."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(groups)
    size = [sum(map(len, g)) for g in groups]
    low = held = 0
    for k in range(len(groups) + 1):
        if k == len(groups) or size[k] > HELD or held + size[k] > HELD:
            if low < k:
                out[low:k] = _all_at_once(groups[low:k], similarity)
            low, held = k, 0
        if k < len(groups) and size[k] > HELD:
            out[k], low = link(len(groups[k]), _one_by_one(groups[k], similarity)), k + 1
        elif k < len(groups):
            held += size[k]
    return out


def _all_at_once(groups: list[list[str]], similarity: float) -> list[np.ndarray]:
    x = Shingled([t for g in groups for t in g])
    n = np.array([len(g) for g in groups])
    begin = np.cumsum(n) - n
    pair = np.flatnonzero(n == 2)
    out = [np.arange(k) for k in n.tolist()]
    if len(pair):
        a = begin[pair]
        near = _similar(x.neighbours(a), x.size[a], x.size[a + 1], similarity)
        for g in pair[near].tolist():
            out[g] = np.zeros(2, np.int64)
    for g in np.flatnonzero(n > 2).tolist():
        low, high = int(begin[g]), int(begin[g] + n[g])

        def near_of(i: int, others: np.ndarray) -> np.ndarray:
            both = x.common(low, high, low + i, low + others)  # noqa: B023
            return others[_similar(both, x.size[low + others], x.size[low + i], similarity)]  # noqa: B023

        out[g] = link(high - low, near_of)
    return out


def _one_by_one(texts: list[str], similarity: float):
    """Which of ``others`` are similar to line ``i``, with the shingles of two lines at a time."""

    def near_of(i: int, others: np.ndarray) -> np.ndarray:
        mine = shingles(texts[i])
        both = np.array([(len(mine & other), len(other)) for other in (shingles(texts[j]) for j in others.tolist())], np.int64).reshape(-1, 2)
        return others[_similar(both[:, 0], both[:, 1], len(mine), similarity)]

    return near_of


def _verify(similarity: float):
    def run(columns: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, texts = columns[2], columns[3]
        some = [(int(s), int(e)) for s, e in zip(starts[:-1], starts[1:], strict=True) if e - s > 1]
        a, b = [], []
        for (s, e), label in zip(some, roots([[normal(t) for t in texts[s:e]] for s, e in some], similarity), strict=True):
            moved = label != np.arange(e - s)
            a.append(names[s:e][moved])
            b.append(names[s:e][label[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return by_group(2, run)


def _text() -> Column:
    return F.col("text").cast("string")


def _hash() -> Column:
    """Names a text; rows of equal doc_id and equal text are copies of one row."""
    return F.xxhash64(_text())


def _has_lines() -> Column:
    return F.coalesce(F.length(F.btrim(_text(), F.lit(" \n"))) > 0, F.lit(False))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line, name): every line that is not blank."""
    rows = docs.select("doc_id", _hash().alias("text_hash"), F.posexplode(F.split(_text(), "\n")).alias("pos", "line"))
    return rows.filter("length(trim(line)) > 0").withColumn("name", F.xxhash64("line"))


def _where(place: str, name: str) -> Column:
    """Whether a row of a line table is the one at ``place``, a struct of (doc_id is null, doc_id, text_hash, pos)."""
    at = lambda c: F.col(f"{place}.{c}")
    return (F.col("name") == F.col(name)) & F.col("doc_id").eqNullSafe(at("doc_id")) & (F.col("text_hash") == at("text_hash")) & (F.col("pos") == at("pos"))


def _meetings(found: DataFrame) -> DataFrame:
    """(set, pair, line): lines to compare within equal (set, pair).  A hot set's tiles are apart, its centres in each."""
    cold = found.filter("not hot").select("set", F.lit(0).cast("long").alias("pair"), "line")
    hot = found.filter("hot")
    tiles = hot.groupBy("set").agg(F.max("tile").alias("last")).withColumnRenamed("set", "_set")
    centres = hot.filter("centre").join(tiles, F.col("set") == F.col("_set")).select("set", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("pair"), "line")
    return cold.unionByName(hot.select("set", F.col("tile").alias("pair"), "line")).unionByName(centres)


def _across(hot: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """(set, pair, line) for lines of hot sets that are not in one component yet, by the components ``labels``.

    The lines of a large component fill tiles of their own, those of small ones share tiles; two tiles meet
    unless both are of one component.
    """
    rows = hot.select("set", "line").join(labels, F.col("line") == F.col("node"), "left").select("set", "line", F.coalesce("root", "line").alias("label"))
    sizes = rows.groupBy("set", "label").agg(F.count("*").alias("n"))
    sets = sizes.groupBy("set").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("n") <= tile, F.col("n"))).alias("small")).filter("labels > 1")
    sizes = sizes.join(sets, "set").withColumn("own", F.when(F.col("n") > tile, F.col("label")))
    parts = F.when(F.col("own").isNull(), F.ceil(F.col("small") / tile)).otherwise(F.ceil(F.col("n") / tile)).cast("long")
    sizes = durable(sizes.select(F.col("set").alias("_set"), F.col("label").alias("_label"), "own", parts.alias("parts")))
    number = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("label"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("line"), F.col("parts")))
    rows = rows.join(sizes, (F.col("set") == F.col("_set")) & (F.col("label") == F.col("_label"))).select("set", "line", "own", number.alias("number"))
    tiles = sizes.select("_set", "own", "parts").distinct().select(F.col("_set").alias("set"), "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("number"))
    other = tiles.select(F.col("set").alias("_set"), F.col("own").alias("_own"), F.col("number").alias("_number"))
    meet = tiles.join(other, F.col("set") == F.col("_set")).filter("own is null or _own is null or own <> _own")
    ends = [F.struct(F.col(own).isNull().alias("a"), F.coalesce(own, F.lit(0)).alias("b"), F.col(number).alias("c")) for own, number in (("own", "number"), ("_own", "_number"))]
    meet = meet.select("_set", F.col("own").alias("_own"), F.col("number").alias("_number"), F.xxhash64(F.least(*ends), F.greatest(*ends)).alias("pair"))
    same = (F.col("set") == F.col("_set")) & F.col("own").eqNullSafe(F.col("_own")) & (F.col("number") == F.col("_number"))
    return rows.join(meet, same).select("set", "pair", "line")


def found_sets(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(set, line, tile, hot, centre): lines of the bands that several different lines share."""
    rows = _bands(docs).repartition("band").sortWithinPartitions("band", "line").mapInArrow(_sets(tile), "set long, line long, tile long, hot boolean, centre boolean")
    return durable(rows)


def line_roots(found: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(node, root): components over all verified pairs of the sets ``found``, lines by name, without the roots.

    ``texts``: (name, text) of every line of the sets.
    """

    def verified(met: DataFrame) -> DataFrame:
        met = met.repartition("line").dropDuplicates(["line", "set", "pair"])
        groups = met.join(texts, F.col("line") == F.col("name")).select("set", "pair", "line", "text")
        return groups.repartition("set", "pair").sortWithinPartitions("set", "pair").mapInArrow(_verify(similarity), "a long, b long")

    part = components(verified(_meetings(found)))
    hot = found.filter("hot")
    if not hot.limit(1).count():
        return part
    labels = part.unionByName(part.select(F.col("root").alias("node"), "root").distinct())
    more = durable(verified(_across(hot, labels, tile)))
    if not more.limit(1).count():
        return part
    return components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def lost_lines(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, lost): sorted positions of the lines of each different (doc_id, text) that do not stay.

    Of equal lines, and of lines linked over Jaccard similarity ``similarity`` or more, the first by
    (doc_id, text, position) stays, texts in the order of their hashes; rows without a doc_id come last.
    Blank lines stay.  Copies of a row are one here.  Two different lines of one 64-bit name, should there
    be any, are told apart by a second hash and both stay.
    """
    lines = durable(_lines(docs).select("name", F.hash("line").alias("check"), "doc_id", "text_hash", "pos"))
    found = found_sets(docs, tile)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    named = lines.groupBy("name").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high")).filter("low = high")
    met = found.select(F.col("line").alias("met")).distinct()
    named = durable(named.join(met, F.col("name") == F.col("met"), "left").filter("n > 1 or met is not null").select("name", "place", "n", F.col("met").isNotNull().alias("met")))
    wanted = named.filter("met").select(F.col("name").alias("_name"), "place")
    texts = _lines(docs).join(wanted, _where("place", "_name")).select("name", F.col("line").cast("binary").alias("text")).dropDuplicates(["name"])
    if found.filter("hot").limit(1).count():
        texts = durable(texts)  # read twice
    roots_ = line_roots(found, texts, similarity, tile)
    member = roots_.unionByName(roots_.select(F.col("root").alias("node"), "root").distinct())
    first = named.join(member, F.col("name") == F.col("node"), "left").filter("n > 1 or root is not null").select("name", F.coalesce("root", "name").alias("root"), "place")
    first = durable(first)
    stays = first.groupBy("root").agg(F.min("place").alias("place")).withColumnRenamed("root", "_root")
    stays = first.select("name", "root").join(stays, F.col("root") == F.col("_root")).select(F.col("name").alias("_name"), "place")
    lost = lines.join(stays, F.col("name") == F.col("_name")).filter(~_where("place", "name"))
    return lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("lost"))


def _repeated(docs: DataFrame) -> DataFrame | None:
    """(_doc, _text) of the rows with lines that occur more than once, if there are any."""
    rows = docs.filter(_has_lines()).select(F.col("doc_id").alias("_doc"), _hash().alias("_text"))
    rows = durable(rows.groupBy("_doc", "_text").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    return rows if rows.limit(1).count() else None


def _key(doc: str, text: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("_hash") == F.col(text))


def report(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, n_lines, n_lost, lost) for every row of ``docs``: lines that are not blank, and the positions that go.

    Null and empty texts have no lines; an empty table gives an empty one.  doc_id may have any type with an
    order, may be null, and may name different texts.  Of repeated rows (equal doc_id and text) one keeps its
    lines and the others lose all of theirs.  Texts and lines of any length are taken whole.  Only doc_id and
    text are read, so other columns cannot clash.
    """
    lost = lost_lines(docs, similarity, tile).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "lost")
    filled = F.filter(F.transform(F.split(_text(), "\n"), lambda x, i: F.when(F.length(F.trim(x)) > 0, i)), lambda i: i.isNotNull())
    rows = docs.select("doc_id", _hash().alias("_hash"), F.coalesce(filled, F.array().cast("array<int>")).alias("_filled"))
    n, none = F.size("_filled").cast("long").alias("n_lines"), F.array().cast("array<int>")
    out = lambda df: df.select("doc_id", n, F.size("lost").cast("long").alias("n_lost"), "lost")
    single, repeated = rows, _repeated(docs)
    if repeated is not None:
        single = rows.join(repeated, _key("_doc", "_text"), "left_anti")
    single = out(single.join(lost, _key("_doc", "_text"), "left").withColumn("lost", F.coalesce("lost", none)))
    if repeated is None:
        return single
    copies = durable(rows.join(repeated, _key("_doc", "_text"), "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    first = copies.groupBy("doc_id", "_hash").agg(F.min("_row").alias("_first")).join(lost, _key("_doc", "_text"), "left").select("_first", F.coalesce("lost", none).alias("lost"))
    copies = copies.join(first, F.col("_row") == F.col("_first"), "left").withColumn("lost", F.coalesce("lost", "_filled"))
    return single.unionByName(out(copies))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """``docs`` with the lost lines taken out of text; n_chars, where it exists, follows the text.

    A document that loses lines and has no other line than blank ones goes.  So of repeated rows with lines
    one stays, that whose other columns have the smallest hash.
    """
    columns = docs.columns
    doc, text_hash, gone, new, own = fresh(docs, "_lost_doc", "_lost_hash", "_lost_pos", "_new_text", "_own_hash")
    lost = lost_lines(docs, similarity, tile).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("lost").alias(gone))
    repeated, rows = _repeated(docs), docs
    if repeated is not None:
        same = docs["doc_id"].eqNullSafe(repeated["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == repeated["_text"])
        rows = docs.join(repeated, same, "left_anti").unionByName(one_row(docs.join(repeated, same, "left_semi"), "doc_id", "text"))
    rows = rows.withColumn(own, _hash())
    out = rows.join(lost, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text_hash)), "left")
    kept = F.filter(F.split(_text(), "\n"), lambda x, i: ~F.array_contains(gone, i))
    same = F.col(gone).isNull()
    out = out.withColumn(new, F.when(same, _text()).otherwise(F.array_join(kept, "\n")))
    out = out.filter(same | (F.length(F.trim(F.replace(F.col(new), F.lit("\n"), F.lit("")))) > 0)).withColumn("text", F.col(new))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length(new).cast(kind)))
    return out.select(*columns)
