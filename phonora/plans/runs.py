"""Whole runs: evaluate predictions, extract inventories, transcribe a corpus, predict, collect statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonora import sinks, sources
from phonora.functions import g2p, numeric, text
from phonora.operators import corpus, evaluate, inventory, nearest, remap, sequence, vocabulary


def feature_values(table: DataFrame, features: Sequence[str], phoneme: str = "Phoneme") -> DataFrame:
    """(phoneme, feature, values): contours of each feature, of the first row of each phoneme."""
    first = inventory.first_rows(inventory.with_row_id(table), phoneme)
    long = vocabulary.unpivoted(first, [phoneme], features)
    return long.select(F.col(phoneme).alias("phoneme"), "feature", text.contour(F.col("value")).alias("values"))


def phones(table: DataFrame, features: Sequence[str], phoneme: str = "Phoneme") -> DataFrame:
    """(pos, idx, phoneme, features): an inventory with one vector of first contour elements per phoneme."""
    first = inventory.first_rows(inventory.with_row_id(table), phoneme)
    vector = F.array(*[text.first_of_contour(F.col(f)) for f in features])
    ids = vocabulary.dense_ids(first, phoneme)
    return first.join(F.broadcast(ids.withColumnRenamed(phoneme, "_p")), F.col(phoneme) == F.col("_p")).select(F.col("id").alias("pos"), F.col("id").alias("idx"), F.col(phoneme).alias("phoneme"), vector.alias("features"))


def source_maps(inventories: DataFrame, target: DataFrame) -> DataFrame:
    """(language, source, target): every phone of ``target`` to itself where a language of (lang, phonemes) has it, else
    to the nearest that it has; the first by position wins ties.

    This is the two-phase scheme: as a language's phones are some of ``target``, the first phase covers all of them.
    One plan for all languages, whose inventories reach the phones as one array.
    """
    own = inventories.select("lang", F.explode("phonemes").alias("_p")).distinct().join(target, F.col("_p") == F.col("phoneme"))
    own = own.groupBy("lang").agg(F.collect_list(F.struct("pos", "phoneme", "features")).alias("phones"))
    every = own.agg(F.collect_list(F.struct("lang", "phones"))).scalar()
    rows = target.select(F.col("phoneme").alias("source"), F.col("features").alias("_own"), F.explode(every).alias("_l"))
    one = lambda t: F.struct((t["phoneme"] != F.col("source")).alias("other"), numeric.hamming(F.col("_own"), t["features"]).alias("distance"), t["pos"].alias("pos"), t["phoneme"].alias("phoneme"))
    best = F.array_min(F.transform("_l.phones", one))
    return rows.select(F.col("_l.lang").alias("language"), "source", best["phoneme"].alias("target"))


def evaluate_file(spark: SparkSession, path: str, table: DataFrame, features: Sequence[str], output: str | None = None, split_complex: bool = False, use_maps: bool = False) -> DataFrame:
    """Results of a prediction file, written as a document if ``output`` is given."""
    meta, predictions = sources.read_predictions(spark, path)
    mapping = None
    if use_maps:
        inventories = meta.select(F.explode("label_inventories").alias("lang", "phonemes"))
        mapping = source_maps(inventories, phones(table, features))
    rated = evaluate.evaluate(predictions, feature_values(table, features), mapping, split_complex)
    if output:
        sinks.write_results(rated, {"package_version": "1", "evaluation_arguments": path}, output)
    return rated


def edits_file(spark: SparkSession, path: str, table: DataFrame, features: Sequence[str], output: str) -> None:
    """Edits of the first candidates as JSON lines."""
    _, predictions = sources.read_predictions(spark, path)
    rows = evaluate.utterance_edits(predictions, feature_values(table, features))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("classifier", c)))
    out = rows.withColumn("_e", sinks.edits_row(F.col("edits"))).groupBy("language", "utterance_id").agg(entry("expected").alias("expected"), entry("_e").alias("edit_operations"))
    sinks.write_json_lines(out, {"prediction_arguments": path, "package_version": "1"}, output)


def extract_features(spark: SparkSession, path: str, output: str, **options) -> DataFrame:
    """One inventory per language of a feature table, written as CSV."""
    out = inventory.extract(sources.read_feature_table(spark, path), **options)
    sinks.write_feature_table(out, output)
    return out


def transcribe(rows: DataFrame, engines: Sequence[Callable[[str], g2p.Engine]], target: DataFrame | None = None, features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transcriptions, inventories).  With a target inventory, main-language runs are mapped to its nearest phones.

    The mapping depends on all rows of the corpus, so transcriptions should be persisted before.
    """
    spoken = g2p.transcribe(rows, engines)
    inventories = inventory.engine_inventories(spoken.withColumn("_e", F.col("phonemes.phonemes")), "lang", "_e")
    if target is None:
        return spoken, inventory.concatenated_inventory(inventories, "lang")
    used = inventory.shared_inventory(inventories)
    vectors = features if features is not None else target.drop("pos", "idx")
    error = F.raise_error(F.concat(F.lit("no features for "), F.col("phoneme"))).cast(vectors.schema["features"].dataType)
    source = used.join(vectors, "phoneme", "left").withColumn("features", F.coalesce("features", error))
    mapping = nearest.map_inventories(source.select("phoneme", "features"), target, features)
    as_map = remap.as_map(mapping)
    fixed = F.struct(F.col("phonemes.words").alias("words"), remap.remap_main_runs(F.col("phonemes.phonemes"), F.col("mapping")).alias("phonemes"))
    mapped = spoken.withColumn("mapping", as_map).withColumn("phonemes", fixed).drop("mapping")
    image = inventory.concatenated_inventory(inventories, "lang").withColumn("mapping", as_map)
    return mapped, image.select("lang", remap.image(F.col("phonemes"), F.col("mapping")).alias("phonemes"))


def predict(features: DataFrame, model: Callable[[list], list], key: Sequence[str] = ("lang", "utterance_id")) -> DataFrame:
    """(key…, emissions) of a model that takes a batch of feature arrays and gives log probabilities per frame."""
    key = list(key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[key].assign(emissions=[[[float(x) for x in f] for f in e] for e in model(part["features"].tolist())])

    schema = features.select(*key).limit(0).selectExpr("*", "cast(null as array<array<double>>) as emissions").schema
    return features.select(*key, "features").mapInPandas(run, schema)


def decode(emissions: DataFrame, tokens: Sequence[str], width: int = 1, n_best: int = 1, blank: int = 0) -> DataFrame:
    """``emissions`` with candidates array<array<string>>; a beam of one is the greedy decoder in the JVM."""
    names = F.array(*map(F.lit, tokens))
    if width == 1:
        best = sequence.ctc_greedy_array(F.col("emissions"), F.size("emissions"), blank)
        return emissions.withColumn("candidates", F.array(F.transform(best["tokens"], lambda t: F.element_at(names, t + 1)))).drop("emissions")
    found = sequence.beam_decoder(tokens, width, n_best, blank)(F.col("emissions"))
    return emissions.withColumn("candidates", F.transform(found, lambda c: c["tokens"])).drop("emissions")


def frame_lengths(rows: DataFrame, sample_rate: int, stride: int | None) -> DataFrame:
    """(split, lang, pos, length) from (…, duration_s, sample_rate) of audio headers."""
    samples = numeric.resampled_length(F.col("duration_s"), F.col("sample_rate"), sample_rate)
    return rows.select("split", "lang", "pos", numeric.frame_count(samples, stride).cast("long").alias("length"))


def statistics(lengths: DataFrame, sample_rate: int) -> DataFrame:
    """(split, json) with utterance counts and durations per language."""
    stats = corpus.statistics(lengths, "length")
    return corpus.statistics_json(stats.withColumns({"total": F.col("total") / sample_rate, "mean": F.col("mean") / sample_rate}))
