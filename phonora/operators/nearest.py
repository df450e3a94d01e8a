"""Nearest phones by Hamming distance over feature vectors.

The target side is an inventory, mostly of a few thousand phones.  It reaches the source rows as one array
value (a scalar subquery), and each row finds its best target with array functions: there is no join of
all pairs, nothing is shuffled, and a row of output is made per source only.  A larger target side is cut
into such arrays; a source row meets one after another and keeps the best of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.functions import ipa, numeric

#: Rows of an inventory that are broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more rows than that; otherwise Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_base_count(features: Column, phoneme: Column) -> Column:
    """A vector plus the number of base characters as one more component."""
    return F.concat(features, F.array(F.length(ipa.base(phoneme)).cast("string")))


def _targets(target: DataFrame, add_base_count: bool, block: Column | None = None) -> DataFrame:
    """The inventory (phoneme, pos, features) as one array, or one for each block."""
    vector = with_base_count(F.col("features"), F.col("phoneme")) if add_base_count else F.col("features")
    items = F.collect_list(F.struct(F.col("pos").alias("pos"), F.col("phoneme").alias("phoneme"), vector.alias("v"))).alias("_targets")
    return target.agg(items) if block is None else target.groupBy(block.alias("_block")).agg(items)


def _with_distances(source: DataFrame, target: DataFrame, add_base_count: bool, rows: int = 0) -> tuple[DataFrame, bool]:
    """(source, _row, _d): per source row the array of (distance, target_pos, target), or one row for each block.

    Also whether there are several blocks; _row names a source row then.
    """
    own = with_base_count(F.col("features"), F.col("phoneme")) if add_base_count else F.col("features")
    named = source.select(F.col("phoneme").alias("source"), own.alias("_own"))
    n = target.count()
    blocks = -(-n // (rows or BROADCAST_ROWS))
    if blocks <= 1:
        named = named.withColumn("_row", F.lit(0).cast("long")).withColumn("_targets", _targets(target, add_base_count).scalar())
    else:
        named = named.withColumn("_row", F.xxhash64("source", "_own")).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts = _targets(target, add_base_count, F.pmod(F.xxhash64("pos", "phoneme"), F.lit(blocks)).cast("int"))
        named = named.join(parts, F.col("_at") == F.col("_block"))
    one = lambda t: F.struct(numeric.hamming(F.col("_own"), t["v"]).alias("distance"), t["pos"].alias("target_pos"), t["phoneme"].alias("target"))
    return named.select("source", "_row", F.transform("_targets", one).alias("_d")), blocks > 1


def pairs(source: DataFrame, target: DataFrame, add_base_count: bool = False, rows: int = 0) -> DataFrame:
    """(source, target, target_pos, distance) of every source phone with every target phone: the distance matrix itself."""
    found = _with_distances(source, target, add_base_count, rows)[0].select("source", F.explode("_d").alias("_d"))
    return found.select("source", "_d.target", "_d.target_pos", "_d.distance")


def closest(source: DataFrame, target: DataFrame, add_base_count: bool = False, rows: int = 0) -> DataFrame:
    """(source, target, distance) of the nearest target; the first by position wins ties.

    With several blocks of targets, equal rows of ``source`` give one row.
    """
    found, several = _with_distances(source, target, add_base_count, rows)
    found = found.select("source", "_row", F.array_min("_d").alias("_d")).filter("_d is not null")
    if several:
        found = found.groupBy("source", "_row").agg(F.min("_d").alias("_d"))
    return found.select("source", "_d.target", "_d.distance")


def k_nearest(source: DataFrame, target: DataFrame, k: int, rows: int = 0) -> DataFrame:
    """(source, rank, target, distance) of the k nearest targets."""
    found, several = _with_distances(source, target, False, rows)
    found = found.select("source", "_row", F.slice(F.array_sort("_d"), 1, k).alias("_d"))
    if several:
        found = found.groupBy("source", "_row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_d"))), 1, k).alias("_d"))
    found = found.select("source", F.posexplode("_d").alias("_r", "_d"))
    return found.select("source", (F.col("_r") + 1).alias("rank"), "_d.target", "_d.distance")


def nearest_or_same(source: DataFrame, target: DataFrame) -> DataFrame:
    """Each source phone's own target if it is in the inventory, else the nearest."""
    same = source.join(target.select(F.col("phoneme").alias("_t")), F.col("phoneme") == F.col("_t"), "left_semi").select(F.col("phoneme").alias("source"), F.col("phoneme").alias("target"), F.lit(0).alias("distance"))
    rest = source.join(target.select(F.col("phoneme").alias("_t")), F.col("phoneme") == F.col("_t"), "left_anti")
    return same.unionByName(closest(rest, target))


def map_inventories(source: DataFrame, target: DataFrame, features: DataFrame | None = None, split_complex: bool = False, threshold: int | None = None) -> DataFrame:
    """(source, pos, target, distance): exact matches first, then the nearest with base counts.

    With ``split_complex`` a source whose number of base characters differs from its target's is split, and
    each part goes to its own nearest target; ``features`` (phoneme, features) has vectors of the parts, and
    a part without one is an error.  ``pairs`` gives the distances, ``unmapped_targets`` what is left over.
    A distance of ``threshold`` or more leaves the phone, or the part, as it is.
    """
    names = target.select(F.col("phoneme").alias("_t"))
    same = source.join(names, F.col("phoneme") == F.col("_t"), "left_semi").select(F.col("phoneme").alias("source"), F.lit(0).alias("pos"), F.col("phoneme").alias("target"), F.lit(0).alias("distance"))
    rest = source.join(names, F.col("phoneme") == F.col("_t"), "left_anti")
    near = closest(rest, target, add_base_count=True)
    bounded = lambda part: F.col("target") if threshold is None else F.when(F.col("distance") >= threshold, part).otherwise(F.col("target"))
    whole = F.length(ipa.base(F.col("source"))) == F.length(ipa.base(F.col("target")))
    direct = near.filter(whole) if split_complex else near
    out = same.unionByName(direct.select("source", F.lit(0).alias("pos"), bounded(F.col("source")).alias("target"), "distance"))
    if not split_complex:
        return out
    vectors = (features if features is not None else source.unionByName(target.select(*source.columns))).select(F.col("phoneme").alias("part"), "features").dropDuplicates(["part"])
    parts = near.filter(~whole).select("source", F.posexplode(ipa.split_complex(F.col("source"))).alias("pos", "part"))
    error = F.raise_error(F.concat(F.lit("no features for "), F.col("phoneme")))
    known = parts.select(F.col("part").alias("phoneme")).distinct().join(vectors, F.col("phoneme") == F.col("part"), "left")
    found = closest(known.select("phoneme", F.coalesce("features", error.cast(vectors.schema["features"].dataType)).alias("features")), target, True)
    split = parts.join(found.withColumnRenamed("source", "_p"), F.col("part") == F.col("_p"), "left")
    return out.unionByName(split.select("source", "pos", bounded(F.col("part")).alias("target"), "distance"))


def unmapped_targets(mapping: DataFrame, target: DataFrame) -> DataFrame:
    """Targets that no source maps to."""
    return target.join(mapping.select(F.col("target").alias("_t")), F.col("phoneme") == F.col("_t"), "left_anti").select("phoneme")


def two_phase(own: DataFrame, target: DataFrame, cover: bool = True) -> DataFrame:
    """(source, target): every own phone to its nearest target; then each target not covered takes over
    the mapping of its nearest own phone.  Of several such targets the greatest by code point wins.
    """
    first = nearest_or_same(own, target).select("source", "target")
    if not cover:
        return first
    open_ = unmapped_targets(first, target)
    open_ = target.join(open_.select(F.col("phoneme").alias("_o")), F.col("phoneme") == F.col("_o"), "left_semi")
    back = nearest_or_same(open_, own).groupBy(F.col("target").alias("_own")).agg(F.max("source").alias("_new"))
    return first.join(back, F.col("source") == F.col("_own"), "left").select("source", F.coalesce("_new", "target").alias("target"))


def indices(df: DataFrame, column: str, phones: DataFrame, strict: bool = True) -> DataFrame:
    """``df`` plus idx of each phone; an unknown one raises when read, or is -1 if not strict."""
    known = small(phones.select(F.col("phoneme").alias("_k"), F.col("idx").alias("_i")))
    found = df.join(known, F.col(column) == F.col("_k"), "left")
    if strict:
        error = F.raise_error(F.concat(F.lit("unknown phoneme "), F.col(column))).cast("int")
        return found.withColumn("idx", F.coalesce("_i", error)).drop("_k", "_i")
    return found.withColumn("idx", F.coalesce("_i", F.lit(-1))).drop("_k", "_i")


def missing(df: DataFrame, column: str, phones: DataFrame) -> DataFrame:
    """Distinct phones without a row."""
    return df.select(F.col(column).alias("phoneme")).distinct().join(phones.select(F.col("phoneme").alias("_k")), F.col("phoneme") == F.col("_k"), "left_anti")


def repair(unknown: DataFrame, known: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """(phoneme, repaired): canonical composition if that is known, else the first segment of a phone that segments
    cover wholly, else null."""
    composed = unknown.select("phoneme", ipa.nfc(F.col("phoneme")).alias("_nfc"))
    table = small(known.select(F.col("phoneme").alias("_k")).distinct())
    out = composed.join(table, F.col("_nfc") == F.col("_k"), "left")
    if segments is None:
        return out.select("phoneme", F.col("_k").alias("repaired"))
    parts = ipa.segment(F.col("phoneme"), segments)
    covered = F.when((F.size(parts) > 0) & (F.array_join(parts, "") == F.col("phoneme")), F.get(parts, F.lit(0)))
    return out.select("phoneme", F.coalesce("_k", covered).alias("repaired"))


def subset(phones: DataFrame, wanted: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """Rows of the wanted (pos, phoneme) in their order, numbered anew.

    With ``segments`` a phone without features takes those of its first segment, under its own name.
    """
    have = phones.select(F.col("phoneme").alias("_k"), *[c for c in phones.columns if c not in ("phoneme", "pos", "idx")])
    key = F.col("phoneme")
    if segments is not None:
        known = small(phones.select(F.col("phoneme").alias("_own")).distinct())
        wanted = wanted.join(known, F.col("phoneme") == F.col("_own"), "left")
        key = F.coalesce("_own", F.get(ipa.segment(F.col("phoneme"), segments), F.lit(0)))
    out = wanted.withColumn("_key", key).join(have, F.col("_key") == F.col("_k")).drop("_k", "_key", "_own")
    return out.withColumn("idx", F.row_number().over(W.orderBy("pos")) - 1)


def feature_vector(phones: DataFrame, phoneme: str | None = None, idx: int | None = None) -> DataFrame:
    """The row of one phone, by label or by index."""
    return phones.filter(F.col("phoneme") == phoneme if phoneme is not None else F.col("idx") == idx)
