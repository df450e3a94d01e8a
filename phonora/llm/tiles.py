"""Grouping rows of an equal key for tiled comparison, hot keys split over tasks.

A key whose rows fit one tile set is handled by one task.  A hot key is cut into tiles; each
pair of tiles is a group of its own, so no task ever holds more than two tiles of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys that are broadcast with their tile table; beyond, the join shuffles.
BROADCAST_KEYS = 50_000


def deal(rows: DataFrame, key: str, item: str, weight: str, reach: int, limit: int) -> DataFrame:
    """``rows`` plus (pair, tile): rows of equal (key, pair) are to be compared.

    ``weight`` is an int column such that items may match only if their weights differ by at most
    ``reach``.  A key of up to ``limit`` rows gets pair 0.  A hotter key is cut into tiles by weight
    and hash; a row goes to each pair of tiles whose weights are within reach, and in a pair of
    different tiles only rows of different tiles need comparing (``tile`` says which one).
    """
    counts = rows.groupBy(key, weight).agg(F.count("*").alias("_n"))
    hot = (
        counts.groupBy(key)
        .agg(F.sum("_n").alias("_all"), F.sort_array(F.collect_list(F.struct(F.col(weight).alias("w"), F.ceil(F.col("_n") / limit).cast("int").alias("k")))).alias("_tiles"))
        .filter(F.col("_all") > limit)
        .select(F.col(key).alias("_key"), "_tiles")
    )
    plain = lambda df: df.withColumns({"pair": F.lit(0).cast("long"), "tile": F.lit(0).cast("long")})
    n_hot = hot.limit(BROADCAST_KEYS + 1).count()
    if not n_hot:
        return plain(rows)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    code = "cast(t.w as bigint) * 1048576 + s"
    dealt = (
        rows.join(hot, F.col(key) == F.col("_key"), "left")
        .withColumn("_k", F.expr(f"coalesce(filter(_tiles, t -> t.w = {weight})[0].k, 1)"))
        .withColumn("tile", F.expr(f"if(_tiles is null, 0L, cast({weight} as bigint) * 1048576 + pmod(xxhash64({item}, 7L), _k))"))
        .withColumn(
            "_other",
            F.expr(f"if(_tiles is null, array(0L), flatten(transform(filter(_tiles, t -> abs(t.w - {weight}) <= {reach}), t -> transform(sequence(0, t.k - 1), s -> {code}))))"),
        )
        .withColumn("_other", F.explode("_other"))
        .withColumn("pair", F.expr("if(_tiles is null, 0L, xxhash64(least(tile, _other), greatest(tile, _other)))"))
    )
    return dealt.select(*rows.columns, "pair", "tile")


def by_group(group_columns: int, fn: Callable[[list[np.ndarray], np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function over rows sorted by their first columns.

    ``fn`` gets the columns of many whole groups as numpy arrays, and where each group starts (with
    the end appended).  A group that is not complete waits for the next batch.
    """

    def starts_of(columns: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(columns[0]), bool)
        change[0] = True
        for c in columns[:group_columns]:
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    def joined(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return fn(columns, np.append(starts_of(columns), len(columns[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of one group
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            goes_on = bool(held) and all(h[-1] == c[0] for h, c in zip(held[-1][:group_columns], now[:group_columns], strict=True))
            cut = starts_of(now)[-1]
            if goes_on and not cut:
                held.append(now)
                continue
            parts = held + ([[c[:cut] for c in now]] if cut else [])
            if parts:
                yield from joined(parts)
            held = [[c[cut:] for c in now]]
        if held:
            yield from joined(held)

    return run
