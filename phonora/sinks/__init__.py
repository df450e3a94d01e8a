"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonora.functions import edit


def write_feature_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A processed inventory as CSV with a header; an inventory is small, so in one file."""
    df.drop("row_id").coalesce(1).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_transcriptions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Transcriptions by split and language; an existing folder is an error unless told otherwise."""
    df.write.mode(mode).partitionBy("split", "lang").parquet(path)


def transcriptions_json(df: DataFrame) -> DataFrame:
    """(lang, json): the transcriptions of each language as one document."""
    row = F.struct(*[c for c in df.columns if c not in ("lang", "split")])
    return df.groupBy("lang").agg(F.to_json(F.collect_list(row)).alias("json"))


def write_json_lines(rows: DataFrame, meta: dict, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """One file: the metadata line, then one line per row."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, json.dumps(meta, ensure_ascii=False))], "_o int, value string")
    body = rows.select(F.lit(1).alias("_o"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    out = head.unionByName(body).coalesce(1).sortWithinPartitions("_o").select("value")
    out.write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def edits_row(edits: Column) -> Column:
    """Edits as the file has them: [action, expected, actual]."""
    return F.transform(edits, lambda e: F.array(e["action"].cast("string"), e["expected"], e["actual"]))


def results_document(rated: DataFrame, meta: dict) -> DataFrame:
    """One row with the results as JSON: by language the rates and statistics of each classifier."""
    stats = F.struct(*edit.STATISTICS)
    one = rated.groupBy("language").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("classifier", "error_rate")))).alias("error_rates"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("classifier"), stats.alias("s"))))).alias("error_statistics"),
    )
    body = F.map_from_entries(F.collect_list(F.struct("language", F.struct("error_rates", "error_statistics").alias("r"))))
    head = [F.lit(str(v)).alias(k) for k, v in meta.items()]
    return one.agg(body.alias("results")).select(F.to_json(F.struct(*head, "results")).alias("value"))


def write_results(rated: DataFrame, meta: dict, path: str, mode: str = "errorifexists") -> None:
    results_document(rated, meta).coalesce(1).write.mode(mode).text(path)


def write_lengths(df: DataFrame, path: str, mode: str = "append") -> None:
    """Frame counts, or features with them, by split and language."""
    df.write.mode(mode).partitionBy("split", "lang").option("compression", "zstd").parquet(path)


def missing_log(df: DataFrame, language: str, segment: str) -> DataFrame:
    """Segments that were not found, each once per language."""
    return df.select(language, segment).distinct()


def report(macro: DataFrame) -> DataFrame:
    """Lines of the error-rate report."""
    name = F.coalesce("language", "classifier", F.lit("average"))
    return macro.select(F.when(F.col("is_phone"), "phone").otherwise("attribute").alias("kind"), F.format_string("%s, %.2f", name, F.col("mean_rate") * 100).alias("line"))
