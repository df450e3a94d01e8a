"""Approximate nearest neighbours by collision-counting hashing.

Each single projection of a block of vectors is kept as one sorted array.  Around a query's own
projection a window grows (virtual rehashing: the same arrays serve every radius); a vector that lies
in the windows of at least a threshold of projections is verified with its exact distance.  A query
stops when a vector as near as its k-th best so far would have crossed the threshold with high
probability (Huang et al., "Query-aware locality-sensitive hashing", 2015; Gan et al., "C2LSH", 2012).

Blocks are made of near vectors: every vector belongs to its nearest centre, centres come from a bounded
sample, and the vectors of a centre are cut into blocks.  A query searches the blocks of its nearest
centres first.  The k-th distance found there is a bound that no later result may exceed, so by the
triangle inequality every centre whose ball lies beyond it is left out, without losing a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.llm.common import durable

#: Projections, collisions that lead to verification, and how many standard deviations above the threshold the
#: collisions of a k-th nearest vector must be expected.  The deviation is that of independent projections;
#: those of orthogonal directions deviate about half as much.
PROJECTIONS, COLLISIONS, SURENESS = 128, 102, 1.2
#: Share of a block that the first windows of a query hold, and the part of the width needed by what is known
#: that the next windows get.
FIRST, SHORT = 0.3, 0.9
#: One in so many vectors of a block, those of most collisions, is verified after the first windows.
SEEDS = 32
#: Vectors of one block and queries of one chunk; a task holds one of each.
BLOCK, CHUNK = 8192, 4096
#: Rows from which the centres of each length of vectors are fitted, rounds of fitting, centres at most, and
#: centres that a query visits before it has a bound.
SAMPLE, ROUNDS, CENTRES, PROBES = 20_000, 6, 4096, 2


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - q[j]
        total += d * d
    return np.sqrt(total)


def directions(dim: int) -> np.ndarray:
    """``PROJECTIONS`` directions in the columns: as many random orthogonal bases as it takes, scaled like Gaussian ones."""
    rng = np.random.default_rng(dim)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS] * math.sqrt(dim)


def reach() -> float:
    """Width of a window, in distances, at which a vector at that distance surely enough has enough collisions."""
    x = 0.0
    while True:
        x += 0.001
        p = math.erf(x / math.sqrt(2))
        if PROJECTIONS * p - SURENESS * math.sqrt(PROJECTIONS * p * (1 - p)) >= COLLISIONS:
            return x


_REACH = reach()


class Index:
    """Sorted projections of one block of distinct (id, vector); of equal vectors the ``keep`` smallest ids stay."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x, copies = ids[order], np.ascontiguousarray(x[order]) + 0.0, copies[order]
        _, group = np.unique(x.view(f"V{x.shape[1] * 8}").ravel(), return_inverse=True)
        by = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[by], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        stay = np.sort(by[rank < keep])
        self.ids, self.x, self.copies = ids[stay], x[stay], copies[stay]
        self.a = directions(x.shape[1])
        p = self.x @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, axis=0).T.copy()
        self.rows = list(self.sorted)
        #: Vectors verified so far, over all queries.
        self.verified = 0

    def _places(self, at: np.ndarray, side: str) -> np.ndarray:
        """Where the values belong in the sorted projections."""
        return np.array([row.searchsorted(v, side) for row, v in zip(self.rows, at, strict=True)])

    def _first_width(self, at: np.ndarray, place: np.ndarray) -> float:
        """Median over the projections of the half width that holds a share of the block around the query."""
        n = len(self.ids)
        half = max(1, int(FIRST * n) // 2)
        rows = np.arange(PROJECTIONS)
        low, high = self.sorted[rows, np.clip(place - half, 0, n - 1)], self.sorted[rows, np.clip(place + half, 0, n - 1)]
        return max(float(np.median(np.maximum(at - low, high - at))), 1e-12)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
        """(place of the query, vector id, its copies, distance) of the k nearest of other ids found for each query.

        ``bounds``: distances beyond which a query needs no vector.
        """
        out: list[tuple[int, int, int, float]] = []
        if len(self.ids):
            projected = q @ self.a
            for i in range(len(qids)):
                bound = math.inf if bounds is None else float(bounds[i])
                near, d = self._nearest(int(qids[i]), q[i], projected[i], k, bound)
                out += [(i, int(self.ids[v]), int(self.copies[v]), float(x)) for v, x in zip(near, d, strict=True)]
        return out

    def _nearest(self, qid: int, q: np.ndarray, at: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        count, seen = np.zeros(n, np.int64), self.ids == qid  # own rows take no places
        low = high = self._places(at, "left")
        near, d, width = np.zeros(0, np.int64), np.zeros(0), min(self._first_width(at, low), max(_REACH * bound, 1e-12))
        first = math.isinf(bound)
        while True:
            new_low, new_high = np.minimum(low, self._places(at - width, "left")), np.maximum(high, self._places(at + width, "right"))
            inside = int((new_high - new_low).sum())
            if PROJECTIONS * n - inside < inside - int((high - low).sum()):  # fewer lie outside than are new inside
                parts = [x for j in range(PROJECTIONS) for x in (self.order[j, : new_low[j]], self.order[j, new_high[j] :])]
                count = PROJECTIONS - np.bincount(np.concatenate(parts), minlength=n)
            else:
                parts = [x for j in range(PROJECTIONS) for x in (self.order[j, new_low[j] : low[j]], self.order[j, high[j] : new_high[j]])]
                count = count + np.bincount(np.concatenate(parts), minlength=n)
            low, high = new_low, new_high
            fresh = (count >= COLLISIONS) & ~seen
            if first:  # the vectors of most collisions give a first idea of the k-th distance
                some = min(n, max(2 * k, n // SEEDS))
                most = np.argpartition(np.where(seen, -1, count), n - some)[n - some :]
                fresh[most] = ~seen[most]
            first, fresh = False, np.flatnonzero(fresh)
            if len(fresh):
                seen[fresh] = True
                self.verified += len(fresh)
                near, d = np.concatenate([near, fresh]), np.concatenate([d, distances(self.x[fresh], q)])
                keep = np.lexsort((self.ids[near], d))[:k]
                near, d = near[keep], d[keep]
            goal = max(_REACH * min(bound, float(d[-1]) if len(d) == k else math.inf), 1e-12)
            if width >= goal or (low == 0).all() and (high == n).all():
                return near, d
            # the k-th distance still falls, so the last but one window is a little smaller than it asks for
            width = 2 * width if math.isinf(goal) else SHORT * goal if width < SHORT * SHORT * goal else goal


def centres(sample: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """``n`` centres at most, fitted by rounds of assigning the sample and averaging."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS if len(c) > 1 else 0):
        own, _ = nearest_centre(x, c)
        count = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total[count > 0] / count[count > 0, None]
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its distance."""
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, (1 << 22) // len(c))
    for low in range(0, len(x), step):
        some = x[low : low + step]
        own[low : low + step] = ((c * c).sum(axis=1) - 2 * some @ c.T).argmin(axis=1)
        far[low : low + step] = np.sqrt(((some - c[own[low : low + step]]) ** 2).sum(axis=1))
    return own, far


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _fitted(rows: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Centres for each length of vectors that fills more than a block, from a bounded sample chosen by a hash."""
    out = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") > block).orderBy("dim").toLocalIterator():
        share = min(1.0, 2 * SAMPLE / r["n"])
        some = rows.filter((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 32)) < int(share * (1 << 32))))
        found = some.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
        out[r["dim"]] = centres(_matrix(found.column(0), r["dim"]), min(CENTRES, -(-r["n"] // block)))
    return out


def _assigned(rows: DataFrame, fitted) -> DataFrame:
    """``rows`` (vec_id, embedding, copies, dim) with the nearest centre as cell and its distance as far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cell, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.intersect1d(dims, list(fitted.value)).tolist():
                some = np.flatnonzero(dims == dim)
                cell[some], far[some] = nearest_centre(_matrix(batch.column(1).take(pa.array(some)), dim), fitted.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, copies long, dim int, cell long, far double")


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK, chunk: int = CHUNK, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest vectors found for each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but those of
    the query's own vec_id.  Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows with a null vec_id; vectors of different length are not compared.  Ties go to the
    smaller vec_id.  Repeated rows count as often as they occur: rows are reduced to distinct ones with a
    number of copies before any search, the ``k`` nearest distinct ones are found, and each pair then
    fills as many ranks as a join of all query rows with all rows has pairs.  A task holds one block of
    vectors and one chunk of queries, so its memory does not grow with the table.  An empty table gives an
    empty one.  Only vec_id and embedding are read, so other columns cannot clash.
    """
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double)) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null").filter(finite)
    rows = durable(rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    spark = rows.sparkSession
    fitted = spark.sparkContext.broadcast(_fitted(rows, block))
    rows = durable(_assigned(rows, fitted))
    # At most CENTRES cells for each length that has centres, and one for each other length.
    cells = [(r["dim"], r["cell"], r["n"], r["far"]) for r in rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()]
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = spark.sparkContext.broadcast(cells)
    blocks = F.broadcast(spark.createDataFrame([(d, c, -(-n // block)) for d, c, n, _ in cells], "_dim int, _cell long, blocks long"))
    placed = rows.join(blocks, (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))).withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")))
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", "copies", "dim", F.lit(float("inf")).alias("bound"))

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radius: dict[int, np.ndarray] = {}
            alone = {d for d, _, _, _ in known.value} - fitted.value.keys()
            for d, c in fitted.value.items():
                radius[d] = np.full(len(c), -np.inf)
            for d, c, _, far in known.value:
                if d in radius:
                    radius[d][c] = far
            for batch in batches:
                dims, bound = batch.column(3).to_numpy(), batch.column(4).to_numpy()
                at, cell = [], []
                for dim in np.unique(dims).tolist():
                    some = np.flatnonzero(dims == dim)
                    if dim in alone:
                        at += [some] if first else []
                        cell += [np.zeros(len(some), np.int64)] if first else []
                        continue
                    q, c, r = _matrix(batch.column(1).take(pa.array(some)), dim), fitted.value[dim], radius[dim]
                    for i, v in zip(some.tolist(), q, strict=True):
                        d = np.where(np.isinf(r), np.inf, np.sqrt(((c - v) ** 2).sum(axis=1)))
                        order = np.argsort(d, kind="stable")
                        to = order[:probes] if first else order[probes:][(d - r)[order[probes:]] <= bound[i] * (1 + 1e-9) + 1e-9]
                        to = to[np.isfinite(d[to])]
                        at.append(np.full(len(to), i))
                        cell.append(to)
                pick = pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64))
                columns = [batch.column(j).take(pick) for j in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*cell, np.zeros(0, np.int64)]).astype(np.int64))], [*batch.schema.names, "cell"])

        return run

    def search(v: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        if v.num_rows and q.num_rows:
            dim = v.column("dim")[0].as_py()
            index = Index(v.column("vec_id").to_numpy(), _matrix(v.column("embedding"), dim), v.column("copies").to_numpy(), k + 1)
            qids, times = q.column("vec_id").to_numpy(), q.column("copies").to_numpy()
            got = index.search(qids, _matrix(q.column("embedding"), dim), k, q.column("bound").to_numpy())
            found = [(int(qids[i]), i, b, min(k, int(times[i]) * n), c) for i, b, n, c in got]
        a, i, b, n, c = zip(*found, strict=True) if found else ((), (), (), (), ())
        own = q.column("own").to_numpy() if found else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(a, pa.int64()), "own": pa.array(own[list(i)], pa.int64()), "vec_id": pa.array(b, pa.int64()), "pairs": pa.array(n, pa.int32()), "score": pa.array(c, pa.float64())})

    def visited(routed: DataFrame) -> DataFrame:
        """What the queries find in the cells they are sent to; vectors are sent once for each chunk of queries of their cell."""
        routed = routed.withColumn("own", F.xxhash64("vec_id", "embedding"))
        counts = [(r["dim"], r["cell"], -(-r["n"] // chunk)) for r in routed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()]
        size = {(d, c): -(-n // block) for d, c, n, _ in cells}
        if not counts:
            return spark.createDataFrame([], "query_id long, own long, vec_id long, pairs int, score double")
        split = F.broadcast(spark.createDataFrame([(d, c, n, size[d, c]) for d, c, n in counts], "_d int, _c long, chunks long, n_blocks long"))
        same = (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c"))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        v = placed.join(split, same).select("vec_id", "embedding", "copies", "dim", "cell", "block", upto("chunks").alias("chunk"))
        q = routed.join(split, same).withColumn("chunk", F.pmod(F.col("own"), F.col("chunks"))).withColumn("block", upto("n_blocks"))
        q = q.select("vec_id", "embedding", "copies", "bound", "own", "dim", "cell", "block", "chunk")
        keys = ("dim", "cell", "block", "chunk")
        return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(search, "query_id long, own long, vec_id long, pairs int, score double")

    schema = "vec_id long, embedding array<double>, copies long, dim int, bound double, cell long"
    near = durable(visited(durable(queries.mapInArrow(route(True), schema))))
    # The k-th distance that a query row has found bounds what it still needs.
    nth = F.row_number().over(W.partitionBy("own").orderBy("score", "vec_id"))
    bounds = near.withColumn("nth", nth).filter(F.col("nth") == k).select(F.col("own").alias("_own"), "score")
    later = queries.join(bounds, F.xxhash64("vec_id", "embedding") == F.col("_own"), "left").withColumn("bound", F.coalesce("score", "bound")).select("vec_id", "embedding", "copies", "dim", "bound")
    far = visited(durable(later.mapInArrow(route(False), schema)))
    found = near.unionByName(far)
    # The copies of a pair are equal rows, so which of them a cut at k takes does not matter.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("pairs"))))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
