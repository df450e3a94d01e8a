"""Edit statistics summed per language and classifier, rates, macro and micro averages, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonora.functions import edit, ipa
from phonora.operators import remap, sets
from phonora.operators.nearest import small

TOTAL = "total"
PHONES = ("phone", "phoneme")


def with_statistics(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """``df`` plus insertions, deletions, substitutions and correct."""
    s = df.withColumn("_s", edit.any_statistics(expected, actual))
    return s.withColumns({n: F.col(f"_s.{n}") for n in edit.STATISTICS}).drop("_s")


def rates(df: DataFrame, kind: str = "double") -> DataFrame:
    """``df`` plus error_rate; null if the reference is empty."""
    s = F.struct(*edit.STATISTICS)
    return df.withColumn("error_rate", edit.word_error_rate(s, kind))


def expected_labels(predictions: DataFrame, cats: DataFrame) -> DataFrame:
    """(language, utterance_id, classifier, expected) from the single reference of each utterance.

    Classifiers named phone or phoneme have the reference itself; others the values of the feature table
    (phoneme, feature, values), contours of a phoneme one after another.  Anything but one reference is
    an error.
    """
    # The optimiser may try this on the metadata line too, which has no utterance and raises nothing.
    error = F.raise_error(F.concat(F.lit("not one reference: "), F.col("utterance_id"))).cast("array<string>")
    one = F.when(F.size("labels") == 1, F.get("labels", F.lit(0))).when(F.col("utterance_id").isNotNull(), error)
    refs = predictions.select("language", "utterance_id", one.alias("reference"))
    phones = refs.select("language", "utterance_id", F.explode(F.array(*map(F.lit, PHONES))).alias("classifier"), F.col("reference").alias("expected"))
    parts = refs.select("language", "utterance_id", F.posexplode("reference").alias("_at", "_p")).join(small(cats), F.col("_p") == F.col("phoneme"))
    values = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "values"))), lambda s: s["values"]))
    features = parts.groupBy("language", "utterance_id", F.col("feature").alias("classifier")).agg(values.alias("expected"))
    return phones.unionByName(features)


def candidates(predictions: DataFrame, split_complex: bool = False, mapping: DataFrame | None = None) -> DataFrame:
    """(language, utterance_id, classifier, rank, actual), phone labels remapped 1 to 1 and split if asked.

    ``mapping`` is (language, source, target).  Of rows repeated for an utterance the one with most
    classifiers counts.
    """
    size = F.struct(F.size("predictions").alias("n"), F.to_json("predictions").alias("j"))
    last = predictions.groupBy("language", "utterance_id").agg(F.max_by(F.map_entries("predictions"), size).alias("_p"))
    flat = last.select("language", "utterance_id", F.explode("_p").alias("_e")).select("language", "utterance_id", F.col("_e.key").alias("classifier"), F.posexplode("_e.value").alias("rank", "actual"))
    is_phone = F.col("classifier").isin(*PHONES)
    if mapping is not None:
        maps = mapping.groupBy(F.col("language").alias("_l")).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("_m"))
        flat = flat.join(small(maps), F.col("language") == F.col("_l"), "left")
        flat = flat.withColumn("actual", F.when(is_phone & F.col("_m").isNotNull(), remap.renamed(F.col("actual"), F.col("_m"), strict=True)).otherwise(F.col("actual"))).drop("_l", "_m")
    if split_complex:
        flat = flat.withColumn("actual", F.when(is_phone, ipa.split_all_complex(F.col("actual"))).otherwise(F.col("actual")))
    return flat


def only_classifiers(predictions: DataFrame, wanted: Sequence[str], available: Sequence[str]) -> DataFrame:
    """Predictions of the wanted classifiers; one that is not available is an error."""
    sets.missing_keys(wanted, available)
    return predictions.withColumn("predictions", F.map_filter("predictions", lambda k, v: k.isin(list(wanted))))


def best_of(scored: DataFrame, key: Sequence[str], rate: str, order: str, values: Sequence[str]) -> DataFrame:
    """Per key the values of the lowest rate, the first in order winning ties; rates that are null, NaN or infinite never win."""
    fine = scored.filter(F.col(rate).isNotNull() & ~F.isnan(rate) & (F.col(rate) < float("inf")))
    return fine.groupBy(*key).agg(F.min_by(F.struct(*values, rate), F.struct(rate, order)).alias("_b")).select(*key, "_b.*")


def sums(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Statistics added up; partial sums are made before the shuffle."""
    return df.groupBy(*key).agg(*[F.sum(n).alias(n) for n in edit.STATISTICS])


def complete(df: DataFrame, languages: DataFrame, classifiers: DataFrame) -> DataFrame:
    """Every pair of language and classifier, with zeros where nothing was added."""
    names = classifiers.agg(F.collect_set("classifier")).scalar()
    grid = languages.select("language").distinct().withColumn("classifier", F.explode(names))
    return grid.join(df, ["language", "classifier"], "left").na.fill(0, list(edit.STATISTICS))


def with_totals(df: DataFrame) -> DataFrame:
    """Sums per language and classifier, and per classifier with language 'total', as grouping sets."""
    added = [F.sum(n).alias(n) for n in edit.STATISTICS]
    sets = df.groupingSets([["language", "classifier"], ["classifier"]], "language", "classifier").agg(F.grouping("language").alias("_all"), *added)
    return sets.withColumn("language", F.when(F.col("_all") == 1, TOTAL).otherwise(F.col("language"))).drop("_all")


def evaluate(predictions: DataFrame, cats: DataFrame, mapping: DataFrame | None = None, split_complex: bool = False, kind: str = "float") -> DataFrame:
    """(language, classifier, insertions, deletions, substitutions, correct, error_rate) with totals.

    Utterances with an empty reference drop out of the sums, as their rate is not a number.
    """
    want = expected_labels(predictions, cats)
    got = candidates(predictions, split_complex, mapping)
    both = want.join(got, ["language", "utterance_id", "classifier"])
    scored = rates(with_statistics(both, "expected", "actual"))
    best = best_of(scored, ["language", "utterance_id", "classifier"], "error_rate", "rank", edit.STATISTICS)
    whole = complete(sums(best, ["language", "classifier"]), predictions, got)
    return rates(with_totals(whole), kind)


def utterance_edits(predictions: DataFrame, cats: DataFrame) -> DataFrame:
    """(language, utterance_id, classifier, expected, edits, edits_cost) of the first candidate."""
    first = candidates(predictions).filter("rank = 0").drop("rank")
    return edit.operations(expected_labels(predictions, cats).join(first, ["language", "utterance_id", "classifier"]), "expected", "actual")


def macro_averages(rated: DataFrame) -> DataFrame:
    """Unweighted means: per attribute over languages, per language over attributes, and over all.

    Phones and phonemes are averaged on their own; the 'total' language takes no part.
    """
    rows = rated.filter(F.col("language") != TOTAL).withColumn("is_phone", F.col("classifier").isin(*PHONES))
    sets = rows.groupingSets([["is_phone", "language"], ["is_phone", "classifier"], ["is_phone"]], "is_phone", "language", "classifier")
    out = sets.agg(F.avg("error_rate").alias("mean_rate"))
    return out.filter("not is_phone or language is null")


def languages_or_error(rated: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Results of the given languages; one without results is an error."""
    have = {r[0] for r in rated.select("language").distinct().collect()}
    missing = sorted(set(languages) - have)
    if missing:
        raise ValueError(f"no results for {missing}")
    return rated.filter(F.col("language").isin(list(languages)))


def described(name: Column) -> Column:
    """A result as text: name, statistics and percentage."""
    return F.format_string("%s: | I: %d D: %d S: %d C: %d | %.2f%%", name, "insertions", "deletions", "substitutions", "correct", F.col("error_rate").cast("double") * 100)


def loss_ratio(df: DataFrame, key: Sequence[str], loss: str, length: str) -> DataFrame:
    """Summed losses over summed lengths per class."""
    return df.groupBy(*key).agg(F.sum(loss).alias("loss"), F.sum(length).alias("length"), F.try_divide(F.sum(loss), F.sum(length)).alias("ratio"))
