"""Selecting one phoneme inventory per language from a wide feature table.

Every "first" is by an explicit row number of the scan, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.functions import codes, ipa, text
from phonora.schemas import FEATURE_START

KEY = ["Source", "ISO6393", "SpecificDialect"]
ROW = "row_id"

# The dialect that is preferred where a language has several.
DEFAULT_DIALECTS = {
    "eng": "Western and Mid-Western US; Southern California",
    "nld": "Belgian Standard",
    "ell": "Standard Modern Greek (Athenian)",
    "por": "Lisbon",
}


def with_row_id(df: DataFrame) -> DataFrame:
    """What the order of rows goes by; a table that has it keeps it.

    Rows of files go by path, start of the split and place in it, so splits may be read in any order; rows
    of other tables go by partition and place.
    """
    if ROW in df.columns:
        return df
    here = F.monotonically_increasing_id().alias("at")
    try:
        return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), here).alias(ROW))
    except AnalysisException:  # not from files
        return df.withColumn(ROW, F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), here))


def non_marginal(df: DataFrame) -> DataFrame:
    """Rows with allophones that are not marginal; a null Marginal is kept."""
    return df.filter(F.col("Allophones").isNotNull() & ~F.col("Marginal").eqNullSafe("TRUE"))


def of_languages(df: DataFrame, languages: Sequence[str] | None) -> DataFrame:
    return df if languages is None else df.filter(F.col("ISO6393").isin(list(languages)))


def inventory_sizes(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of each inventory; null dialects are groups of their own."""
    return df.groupBy(*key).agg(F.count("*").alias("n"))


def preferred(df: DataFrame, dialects: Mapping[str, str], language: str = "ISO6393", dialect: str = "SpecificDialect") -> DataFrame:
    """Languages with a preferred dialect keep that dialect only."""
    wanted = F.create_map(*[F.lit(x) for kv in dialects.items() for x in kv]) if dialects else F.lit(None)
    return df if not dialects else df.filter(~F.col(language).isin(list(dialects)) | (F.try_element_at(wanted, F.col(language)) == F.col(dialect)))


def largest_per_group(sizes: DataFrame, group: str, size: str, ties: Sequence[str]) -> DataFrame:
    """The row of the largest size in each group; ties go by the given columns, nulls first."""
    order = [F.desc(size), *[F.asc_nulls_first(c) for c in ties]]
    return sizes.withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter("_rank = 1").drop("_rank")


def largest_inventories(df: DataFrame, dialects: Mapping[str, str] | None = None) -> DataFrame:
    return largest_per_group(inventory_sizes(preferred(df, dialects or {})), "ISO6393", "n", ["Source", "SpecificDialect"])


def null_safe(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in key:
        condition &= left[k].eqNullSafe(right[k])
    return condition


def rows_of(df: DataFrame, chosen: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``df`` (marginal ones too) whose key is chosen; null keys match null keys."""
    right = chosen.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    condition = F.lit(True)
    for k in key:
        condition &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(right, condition, "left_semi")


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key the first of the file."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(ROW))).filter("_rank = 1").drop("_rank")


def macro_fallback(df: DataFrame, requested: DataFrame, found: DataFrame) -> DataFrame:
    """(requested, used): a language of the same macro-language for each requested one without an inventory.

    The macro-language itself is preferred; then the first by code.
    """
    missing = requested.select(F.col("ISO6393").alias("requested")).distinct().join(found.select(F.col("ISO6393").alias("requested")), "requested", "left_anti")
    offered = df.select(F.col("ISO6393").alias("used")).distinct().withColumn("macro", codes.macro(F.col("used")))
    pairs = missing.withColumn("macro", codes.macro(F.col("requested"))).join(offered, "macro")
    best = F.min_by("used", F.struct((F.col("used") != F.col("macro")).alias("other"), F.col("used")))
    return missing.join(pairs.groupBy("requested").agg(best.alias("used")), "requested", "left")


def unresolved(mapping: DataFrame) -> DataFrame:
    return mapping.filter("used is null")


def replace_values(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Values of a column exchanged by a small table, others kept."""
    table = F.broadcast(mapping.select(F.col(source).alias("_from"), F.col(target).alias("_to")))
    return df.join(table, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def backfill(filtered: DataFrame, table: DataFrame, expected: DataFrame) -> DataFrame:
    """Inventories cut or filled to what is expected: (ISO6393, Phoneme).

    An expected phoneme that the inventory lacks is taken from the first row of the whole table with
    it, stamped with the metadata of the inventory's first row, its allophones being itself.
    """
    columns = filtered.columns
    stamp = columns[: columns.index("SpecificDialect") + 1]
    want = expected.select(F.col("ISO6393").alias("_lang"), F.col("Phoneme").alias("_phoneme")).distinct()
    kept = filtered.join(want, (F.col("ISO6393") == F.col("_lang")) & (F.col("Phoneme") == F.col("_phoneme")), "left_semi")
    lacking = want.join(kept.select("ISO6393", "Phoneme"), (F.col("_lang") == F.col("ISO6393")) & (F.col("_phoneme") == F.col("Phoneme")), "left_anti")
    donors = first_rows(table, "Phoneme").drop(*[c for c in stamp if c != "Phoneme"])
    head = first_rows(kept, "ISO6393").select(*stamp)
    extra = lacking.join(donors, F.col("_phoneme") == F.col("Phoneme")).join(head, F.col("_lang") == F.col("ISO6393"))
    extra = extra.withColumns({"Allophones": F.col("Phoneme"), "Marginal": F.lit(None).cast("string")})
    return kept.unionByName(extra.select(*columns))


def borrowed_phones(filtered: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of phones that occur as allophones only, allophones without any row).

    Borrowed rows have InventoryID 0 and no metadata of a language.
    """
    phones = filtered.select(F.explode(text.allophone_list(F.col("Allophones"))).alias("phone")).filter("phone <> ''").distinct()
    lacking = phones.join(filtered.select(F.col("Phoneme").alias("phone")), "phone", "left_anti")
    rows = first_rows(table.join(lacking, F.col("Phoneme") == F.col("phone"), "left_semi"), "Phoneme")
    columns = table.columns
    blank = [*columns[columns.index("Glottocode") : columns.index("SpecificDialect") + 1], "Source", "Allophones"]
    rows = rows.withColumns({"InventoryID": F.lit(0).cast(table.schema["InventoryID"].dataType), **{c: F.lit(None).cast("string") for c in blank if c != "Phoneme"}})
    return rows, lacking.join(rows.select(F.col("Phoneme").alias("phone")), "phone", "left_anti")


def checked_empty(df: DataFrame, column: str, message: str) -> None:
    """Raise with a few values if the table has rows."""
    found = [r[0] for r in df.select(column).limit(20).collect()]
    if found:
        raise ValueError(f"{message}: {sorted(map(str, found))}")


def feature_columns(df: DataFrame, start: str = FEATURE_START) -> list[str]:
    """Columns from the first feature on."""
    columns = [c for c in df.columns if c != ROW]
    return columns[columns.index(start) :]


def project(df: DataFrame, attributes: Sequence[str] | None = None) -> DataFrame:
    """Without Marginal, Phoneme renamed, and of the features only ``attributes`` if given."""
    out = df.drop("Marginal").withColumnRenamed("Phoneme", "phoneme")
    if attributes is None:
        return out
    head = out.columns[: out.columns.index("Source") + 1]
    return out.select(*[c for c in head if c != "phoneme" or "phoneme" in attributes], *[a for a in attributes if a not in head], *([ROW] if ROW in out.columns else []))


def singleton_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n) of columns with at most one value; nulls are not counted."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "n")).filter("n <= 1")


def extract(
    table: DataFrame,
    languages: Sequence[str] | None = None,
    attributes: Sequence[str] | None = None,
    expected: DataFrame | None = None,
    prefer_default_dialects: bool = False,
    remove_zero: bool = False,
) -> DataFrame:
    """One inventory per language with the rows of all its allophones; the whole selection as one plan."""
    table = with_row_id(table)
    usable = non_marginal(table)
    dialects = DEFAULT_DIALECTS if prefer_default_dialects else None
    wanted = of_languages(usable, languages)
    chosen = largest_inventories(wanted, dialects)
    mapping = None
    if languages is not None:
        asked = table.sparkSession.createDataFrame([(x,) for x in languages], "ISO6393 string")
        mapping = macro_fallback(usable, asked, chosen)
        checked_empty(unresolved(mapping), "requested", "languages without allophone data")
        more = usable.join(mapping.select(F.col("used").alias("ISO6393")).distinct(), "ISO6393", "left_semi").select(*usable.columns)
        chosen = chosen.unionByName(largest_inventories(more, dialects))
    filtered = rows_of(table, chosen)
    if mapping is not None:
        filtered = replace_values(filtered, "ISO6393", mapping, "used", "requested").select(*table.columns)
    if expected is not None:
        filtered = backfill(filtered, table, expected)
    if remove_zero:
        filtered = filtered.withColumn("Allophones", ipa.drop_zero(F.col("Allophones")))
    extra, lacking = borrowed_phones(filtered, table)
    checked_empty(lacking, "phone", "allophones without features")
    return project(extra.unionByName(filtered), attributes)


def shared_inventory(df: DataFrame, column: str = "phonemes") -> DataFrame:
    """Distinct phonemes over all languages."""
    return df.select(F.explode(column).alias("phoneme")).distinct()


def language_inventory(df: DataFrame, language: str, phoneme: str) -> DataFrame:
    """Sorted phonemes of each language."""
    return df.groupBy(language).agg(F.sort_array(F.collect_set(phoneme)).alias("phonemes"))


def engine_inventories(df: DataFrame, language: str, engines: str) -> DataFrame:
    """(language, engine, phonemes): sorted phonemes of each engine of transcriptions array<array<array<..>>>."""
    words = df.select(language, F.posexplode(engines).alias("engine", "runs"))
    phones = words.select(language, "engine", F.explode(F.flatten(F.transform("runs", lambda r: r["transcription"]))).alias("phone"))
    return phones.groupBy(language, "engine").agg(F.sort_array(F.collect_set("phone")).alias("phonemes"))


def concatenated_inventory(inventories: DataFrame, language: str) -> DataFrame:
    """Sorted concatenation over engines; what several engines share stays repeated."""
    return inventories.groupBy(language).agg(F.sort_array(F.flatten(F.collect_list("phonemes"))).alias("phonemes"))


def first_seen(df: DataFrame, column: str, order: str = ROW) -> DataFrame:
    """Distinct values with where each was seen first."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen"))


def without_duplicates(df: DataFrame, key: str) -> DataFrame:
    return first_rows(df, key)


def with_untied_copies(df: DataFrame, column: str = "ipa") -> DataFrame:
    """Segments with ties once more without them."""
    copies = df.filter(F.contains(F.col(column), F.lit(ipa.TIE))).withColumn(column, ipa.without_ties(F.col(column)))
    return df.unionByName(copies)
