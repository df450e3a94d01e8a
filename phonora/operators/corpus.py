"""Corpora as DataFrames: subsets, splits, limits, statistics, label generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.operators import remap, sequence, sets

SPLITS = ("train", "dev", "test")


def positive_score(up: str = "up_votes", down: str = "down_votes") -> Column:
    """At least two more votes up than down."""
    return F.col(up) - F.col(down) > 1


def allowed_languages(df: DataFrame, languages: Sequence[str] | None, column: str = "lang") -> DataFrame:
    """Rows of the languages; one that the corpus does not have is an error."""
    if languages is None:
        return df
    sets.missing_keys(languages, [r[0] for r in df.select(column).distinct().collect()])
    return df.filter(F.col(column).isin(list(languages)))


def excluding(df: DataFrame, languages: Sequence[str], column: str = "lang") -> DataFrame:
    return df.filter(~F.col(column).isin(list(languages)))


def training_mode(df: DataFrame, trained: Sequence[str], mode: str, column: str = "lang") -> DataFrame:
    """Rows of all languages (include), of those not trained on (exclude), or of the trained ones (only)."""
    modes = {"include": df, "exclude": excluding(df, trained, column), "only": df.filter(F.col(column).isin(list(trained)))}
    return modes[mode]


def primary_only(df: DataFrame, column: str = "phonemes.phonemes") -> DataFrame:
    return df.filter(remap.only_primary(F.col(column)))


def limited(df: DataFrame, limit: int | Mapping[str, int] | None, order: Sequence[str], language: str = "lang") -> DataFrame:
    return sequence.first_n(df, language, order, limit)


def splits(train: DataFrame | None = None, dev: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """One table with a split column of the corpora that are given."""
    parts = [d.withColumn("split", F.lit(n)) for n, d in zip(SPLITS, (train, dev, test), strict=True) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def utterance_counts(df: DataFrame, keys: Sequence[str] = ("lang",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def language_ids(df: DataFrame, language: str = "lang") -> DataFrame:
    """(lang, lang_id) in code order; one row per language."""
    return df.select(language).distinct().withColumn("lang_id", F.row_number().over(W.orderBy(language)) - 1)


def language_ranges(df: DataFrame, language: str = "lang") -> DataFrame:
    """(lang, n, offset): where each language's utterances lie when laid end to end."""
    return sequence.offsets(utterance_counts(df, [language]), language)


def inventories_map(inventories: DataFrame) -> DataFrame:
    """One row with map<lang_id, phonemes>."""
    return inventories.agg(F.map_from_entries(F.collect_list(F.struct("lang_id", "phonemes"))).alias("inventories"))


def phoneme_inventory(inventories: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Distinct phonemes of some languages, in the order of languages and inventories."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(languages) for x in (c, i)])
    flat = inventories.filter(F.col("lang").isin(list(languages))).select(order[F.col("lang")].alias("_l"), F.posexplode("phonemes").alias("_p", "phoneme"))
    return flat.groupBy("phoneme").agg(F.min(F.struct("_l", "_p")).alias("_at")).orderBy("_at").select("phoneme")


def durations(df: DataFrame, keys: Sequence[str], length: str, sample_rate: int | None = None) -> DataFrame:
    """Total and mean length per key, in seconds if a sample rate is given."""
    scale = 1.0 / sample_rate if sample_rate else 1.0
    return df.groupBy(*keys).agg((F.sum(length) * scale).alias("total"), (F.avg(length) * scale).alias("mean"), F.count("*").alias("n"))


def statistics(df: DataFrame, length: str, split: str = "split", language: str = "lang") -> DataFrame:
    """Per split and language: utterances, total and mean length."""
    return df.groupBy(split, language).agg(F.count("*").alias("utterances"), F.sum(length).alias("total"), F.avg(length).alias("mean"))


def statistics_json(stats: DataFrame, split: str = "split", language: str = "lang") -> DataFrame:
    """(split, json): one document per split, languages as keys."""
    one = F.struct(*[c for c in stats.columns if c not in (split, language)])
    return stats.groupBy(split).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(language), one))))).alias("json"))


def labelled(df: DataFrame, column: str) -> DataFrame:
    """Rows whose labels are there; a row without is an error when read."""
    return df.withColumn(column, F.coalesce(column, F.raise_error(F.lit("a row has no labels")).cast(df.schema[column].dataType)))


def restricted_labels(df: DataFrame, column: str, inventories: DataFrame, language: str = "lang") -> DataFrame:
    """Labels of a dev split cut to what each language has in training."""
    return remap.filter_by_inventory(df, column, language, inventories)


def audio_info(infos: Sequence[Mapping[str, int]]) -> Mapping[str, int]:
    """The first audio description that is not all zero."""
    return next((i for i in infos if any(i.values())), infos[-1])


def parse_limits(text: str | None) -> int | dict[str, int] | None:
    """A number, or a JSON object of numbers by language."""
    import json

    if text is None or not text.strip():
        return None
    return json.loads(text) if text.lstrip().startswith("{") else int(text)


def samples(df: DataFrame, mode: str) -> DataFrame:
    """Columns of a batch type: unlabelled, raw labels, or indexed labels."""
    wanted = {"unlabeled": [], "raw": ["phonemes"], "indexed": ["labels", "label_lengths"]}[mode]
    return df.select(*[c for c in ("lang", "utterance_id", "features", "length", *wanted) if c in df.columns])
