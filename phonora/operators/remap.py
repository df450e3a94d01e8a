"""Rewriting token sequences by mappings, and shaping nested transcriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a mapping that is carried as one map value beside the rows.
MAP_ENTRIES = 50_000


def as_map(mapping: DataFrame, source: str = "source", target: str = "target", pos: str = "pos") -> Column:
    """map<source, array<target>> as a scalar subquery, targets in order of position; an inventory, hence small."""
    one = mapping.groupBy(source).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, target))), lambda s: s[target]).alias("_to"))
    return one.agg(F.map_from_entries(F.collect_list(F.struct(source, "_to")))).scalar()


def mapped(items: Column, mapping: Column, strict: bool = False) -> Column:
    """1 to n by a map<string, array<string>>; a missing key stays, or is an error if strict."""

    def one(p: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit("no mapping for "), p)).cast("array<string>") if strict else F.array(p)
        return F.coalesce(F.try_element_at(mapping, p), missing)

    return F.flatten(F.transform(items, one))


def renamed(items: Column, mapping: Column, strict: bool = False) -> Column:
    """1 to 1 by a map<string, string>; a missing key stays, or is an error if strict."""

    def one(p: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit("no mapping for "), p)).cast("string") if strict else p
        return F.coalesce(F.try_element_at(mapping, p), missing)

    return F.transform(items, one)


def remap(df: DataFrame, column: str, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` with an array column rewritten by (source, pos, target).

    A mapping of an inventory's size is a map value beside the rows; a larger one is joined with the elements
    of the different arrays.  Either way an element without a mapping stays, or is an error if strict.
    """
    if mapping.limit(MAP_ENTRIES + 1).count() <= MAP_ENTRIES:
        return df.withColumn("_map", as_map(mapping)).withColumn(column, mapped(F.col(column), F.col("_map"), strict)).drop("_map")
    key = F.sha2(F.to_json(F.array(column)), 256)
    arrays = df.filter(F.size(column) > 0).select(key.alias("_key"), F.col(column).alias("_items")).dropDuplicates(["_key"])
    items = arrays.select("_key", F.posexplode("_items").alias("_at", "_item"))
    table = mapping.select(F.col("source").alias("_s"), F.col("pos").alias("_p"), F.col("target").alias("_t"))
    found = items.join(table, F.col("_item") == F.col("_s"), "left")
    unknown = F.raise_error(F.concat(F.lit("no mapping for "), "_item")).cast("string") if strict else F.col("_item")
    to = F.when(F.col("_s").isNull(), unknown).otherwise(F.col("_t"))
    order = F.struct("_at", F.coalesce("_p", F.lit(0)).alias("_p"), to.alias("_t"))
    again = found.groupBy(F.col("_key").alias("_done")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["_t"]).alias("_new"))
    return df.withColumn("_key", key).join(again, F.col("_key") == F.col("_done"), "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def remap_main_runs(engines: Column, mapping: Column) -> Column:
    """Runs of the main language (no tag) of every engine rewritten, tagged runs kept."""
    run = lambda r: F.struct(F.when(r["language"].isNull(), mapped(r["transcription"], mapping)).otherwise(r["transcription"]).alias("transcription"), r["language"].alias("language"))
    return F.transform(engines, lambda e: F.transform(e, run))


def only_primary(engines: Column) -> Column:
    """Whether every engine has exactly one run, without a language tag."""
    return F.forall(engines, lambda e: (F.size(e) == 1) & F.coalesce(F.get(e, F.lit(0))["language"].isNull(), F.lit(False)))


def flattened(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: r["transcription"]))


def flattened_primary(runs: Column) -> Column:
    return flattened(F.filter(runs, lambda r: r["language"].isNull()))


def zipped(words: Column, engines: Column) -> Column:
    """Words beside the runs of the engines; the shorter side is filled with nulls."""
    return F.arrays_zip(words.alias("word"), engines.alias("runs"))


def within_inventory(items: Column, inventory: Column) -> Column:
    return F.filter(items, lambda p: F.array_contains(inventory, p))


def filter_by_inventory(df: DataFrame, column: str, language: str, inventories: DataFrame) -> DataFrame:
    """Elements of each row's array that its language's inventory (lang, phonemes) has."""
    table = F.broadcast(inventories.select(F.col("lang").alias("_l"), F.col("phonemes").alias("_inv")))
    return df.join(table, F.col(language) == F.col("_l")).withColumn(column, within_inventory(F.col(column), F.col("_inv"))).drop("_l", "_inv")


def image(inventory: Column, mapping: Column) -> Column:
    """Sorted distinct image of an inventory under a mapping."""
    return F.sort_array(F.array_distinct(mapped(inventory, mapping)))
