"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a batch that a function works on at a time.  Documents may be long, so the 64 MB that Spark may
#: send would leave Python several times that in words.
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of about ``ARROW_BYTES``, none empty."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, n * ARROW_BYTES // max(batch.nbytes, 1))
        for low in range(0, n, step):
            yield batch.slice(low, step)


def durable(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, its lineage cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that is unset, a local
    master gets a temporary folder; on a cluster no folder of one machine would do, so it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="phonora-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to parts of the Arrow batches of bounded size; ``None`` adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def one_row(docs: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of equal keys (null equals null) the one whose other columns have the smallest hash; columns as they are.

    Rows are reduced before they are shuffled, so a key of very many rows is no burden to one task.
    """
    (row,) = fresh(docs, "_row")
    named = docs.select(*keys, F.struct(*[F.col(c) for c in docs.columns if c not in keys] or [F.lit(0).alias("_none")]).alias(row))
    found = named.groupBy(*keys).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(row))
    return found.select(*[F.col(c) if c in keys else F.col(f"`{row}`.`{c}`").alias(c) for c in docs.columns])


def text_buffers(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have: the given ones, with underscores behind them where taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
