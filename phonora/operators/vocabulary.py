"""Vocabularies: dense ids, categories of features, labels of phoneme sequences, allophone edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.functions import text
from phonora.operators.nearest import small


def dense_ids(values: DataFrame, column: str, start: int = 0, within: Sequence[str] = ()) -> DataFrame:
    """Distinct values with ids from ``start`` in sorted order, within each group if given.

    Without groups the number of each value comes from range partitions and their sizes, so that no
    single task has to hold the vocabulary.
    """
    distinct = values.select(*within, column).filter(F.col(column).isNotNull()).distinct()
    if within:
        return distinct.withColumn("id", F.row_number().over(W.partitionBy(*within).orderBy(column)) - 1 + start)
    ranged = distinct.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(column)))
    sizes = ranged.groupBy("_part").agg(F.max("_in").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("_part").alias("_p"), "_before")
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_p")).select(column, (F.col("_in") + F.col("_before") - 1 + start).cast("int").alias("id"))


def recoded(df: DataFrame, key: str, items: str, ids: DataFrame, value: str) -> DataFrame:
    """(key, ids): array elements exchanged by their ids, in order."""
    parts = df.select(key, F.posexplode(items).alias("_at", "_item"))
    table = small(ids.select(F.col(value).alias("_v"), F.col("id").alias("_id")))
    found = parts.join(table, F.col("_item") == F.col("_v"))
    return found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_id"))), lambda s: s["_id"]).alias("ids"))


def unpivoted(table: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(key…, feature, value) of a wide feature table."""
    return table.unpivot(list(key), list(features), "feature", "value")


def categories(long: DataFrame) -> DataFrame:
    """(feature, value, cat): sorted contour values of each feature with ids from 0."""
    values = long.select("feature", F.explode(text.contour(F.col("value"))).alias("value"))
    return dense_ids(values, "value", within=["feature"]).select("feature", "value", F.col("id").alias("cat"))


def binarised(long: DataFrame, key: Sequence[str], vocabulary: DataFrame) -> DataFrame:
    """(key…, feature, cats): contour elements as category ids."""
    table = small(vocabulary.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("value", "cat"))).alias("_m")).withColumnRenamed("feature", "_f"))
    found = long.join(table, F.col("feature") == F.col("_f"))
    return found.select(*key, "feature", F.transform(text.contour(F.col("value")), lambda v: F.try_element_at("_m", v)).alias("cats"))


def category_sizes(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("feature").agg(F.count("*").alias("size"))


def category_offsets(vocabulary: DataFrame, order: Column | str = "feature") -> DataFrame:
    """(feature, size, offset): where the categories of each feature start when laid end to end after a blank."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return category_sizes(vocabulary).withColumn("offset", 1 + F.coalesce(F.sum("size").over(w), F.lit(0)))


def unused_categories(vocabulary: DataFrame, used: DataFrame) -> DataFrame:
    """Categories (feature, cat) that no row has."""
    return vocabulary.join(used.select("feature", "cat"), ["feature", "cat"], "left_anti")


def labels(sequences: DataFrame, key: str, items: str, cats: DataFrame, offset: int = 0) -> DataFrame:
    """(key, feature, labels, length) of phoneme sequences; the contours of a phoneme follow each other.

    ``cats`` is (phoneme, feature, cats), a feature table and hence small.
    """
    parts = sequences.select(F.col(key), F.posexplode(items).alias("_at", "_p"))
    found = parts.join(small(cats), F.col("_p") == F.col("phoneme"))
    one = F.transform(F.sort_array(F.collect_list(F.struct("_at", "cats"))), lambda s: s["cats"])
    out = found.groupBy(key, "feature").agg(F.flatten(one).alias("labels"))
    return out.withColumn("labels", F.transform("labels", lambda x: x + offset)).withColumn("length", F.size("labels"))


def category_values(labelled: DataFrame, vocabulary: DataFrame, column: str = "labels", offset: int = 0) -> DataFrame:
    """Category ids back to their values."""
    table = small(vocabulary.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("cat", "value"))).alias("_m")).withColumnRenamed("feature", "_f"))
    found = labelled.join(table, F.col("feature") == F.col("_f"))
    return found.withColumn(column, F.transform(column, lambda c: F.try_element_at("_m", c - offset))).drop("_m", "_f")


def dense_table(long: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """(key, features): first contour element of each feature, in the given order."""
    first = long.select(key, "feature", text.first_of_contour(F.col("value")).alias("value"))
    table = first.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))
    return table.select(key, F.array(*[F.try_element_at("_m", F.lit(f)) for f in order]).alias("features"))


def composed_embeddings(cats: DataFrame, key: str, vectors: DataFrame, size: int) -> DataFrame:
    """(key, embedding): sum of the vectors (feature, cat, vector) of all categories of a phoneme."""
    used = cats.select(key, "feature", F.explode("cats").alias("cat"))
    found = used.join(small(vectors), ["feature", "cat"])
    sums = [F.sum(F.col("vector")[i].cast("double")) for i in range(size)]
    return found.groupBy(key).agg(F.array(*sums).alias("embedding"))


def allophone_edges(inventory: DataFrame, phones: DataFrame) -> DataFrame:
    """(lang, phoneme_idx, phone_idx) of allophones; of a repeated phoneme of a language the last row counts."""
    last = inventory.withColumn("_r", F.row_number().over(W.partitionBy("ISO6393", "Phoneme").orderBy(F.desc("row_id")))).filter("_r = 1")
    parts = last.select(F.col("ISO6393").alias("lang"), F.col("Phoneme").alias("_ph"), F.explode(text.allophone_list(F.col("Allophones"))).alias("_al")).filter("_al <> ''")
    ids = small(phones.select(F.col("phoneme").alias("_k"), F.col("idx").alias("_i")))
    one = parts.join(ids, F.col("_ph") == F.col("_k")).withColumnRenamed("_i", "phoneme_idx").drop("_k")
    return one.join(ids, F.col("_al") == F.col("_k")).select("lang", "phoneme_idx", F.col("_i").alias("phone_idx"))


def identity_edges(inventories: DataFrame, phones: DataFrame) -> DataFrame:
    """Every phoneme of (lang, phonemes) as its own allophone."""
    ids = small(phones.select(F.col("phoneme").alias("_k"), F.col("idx").alias("phoneme_idx")))
    out = inventories.select("lang", F.explode("phonemes").alias("_ph")).join(ids, F.col("_ph") == F.col("_k"))
    return out.select("lang", "phoneme_idx", F.col("phoneme_idx").alias("phone_idx"))


def with_blank(edges: DataFrame) -> DataFrame:
    """Edges shifted by one, and a blank (0, 0) of weight one for each language: an incidence matrix in long form."""
    shifted = edges.select("lang", (F.col("phoneme_idx") + 1).alias("phoneme_idx"), (F.col("phone_idx") + 1).alias("phone_idx"))
    blank = edges.select("lang").distinct().select("lang", F.lit(0).alias("phoneme_idx"), F.lit(0).alias("phone_idx"))
    return shifted.unionByName(blank).withColumn("weight", F.lit(1.0))


def map_allophones(logits: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key…, phoneme_idx, logit): per phoneme the largest weighted logit of its phones.

    ``logits`` is (key…, lang, phone_idx, logit).
    """
    found = logits.join(small(edges), ["lang", "phone_idx"])
    return found.groupBy(*key, "lang", "phoneme_idx").agg(F.max(F.col("logit") * F.col("weight")).alias("logit"))
