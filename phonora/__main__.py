"""Command line: features, evaluate, edits, error-rates, transcribe, lengths, stats, meta, config."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from phonora import sinks, sources
from phonora.functions import g2p, numeric
from phonora.operators import corpus, evaluate
from phonora.plans import runs
from phonora.schemas import FEATURE_START
from phonora.session import build_session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("phonora")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features", help="one inventory per language of a feature table")
    f.add_argument("table")
    f.add_argument("output")
    f.add_argument("--languages", nargs="*")
    f.add_argument("--attributes", nargs="*")
    f.add_argument("--default-dialects", action="store_true")
    f.add_argument("--remove-zero", action="store_true")
    for name in ("evaluate", "edits"):
        e = sub.add_parser(name)
        e.add_argument("predictions")
        e.add_argument("table")
        e.add_argument("output")
        e.add_argument("--split-complex", action="store_true")
        e.add_argument("--map", action="store_true")
    r = sub.add_parser("error-rates", help="averages of a results document")
    r.add_argument("results")
    r.add_argument("--languages", nargs="*")
    s = sub.add_parser("stats", help="utterances and durations of stored lengths")
    s.add_argument("lengths")
    s.add_argument("--sample-rate", type=int, default=16_000)
    t = sub.add_parser("transcribe", help="phones of a corpus of clips by registered engines")
    t.add_argument("corpus")
    t.add_argument("output")
    t.add_argument("--engines", nargs="+", default=["letters"])
    t.add_argument("--languages", nargs="*")
    t.add_argument("--include-other", action="store_true")
    t.add_argument("--validation-limit")
    n = sub.add_parser("lengths", help="frame counts of the WAVE files of a corpus")
    n.add_argument("audio")
    n.add_argument("output")
    n.add_argument("--split", default="test")
    n.add_argument("--sample-rate", type=int, default=16_000)
    n.add_argument("--stride", type=int)
    m = sub.add_parser("meta", help="locales of a release")
    m.add_argument("file")
    c = sub.add_parser("config", help="write the default configuration, or print it")
    c.add_argument("output", nargs="?")
    a = p.parse_args(argv)
    if a.command == "config":
        if a.output:
            with open(a.output, "x", encoding="utf-8") as out:
                out.write(sources.DEFAULT_CONFIG)
        else:
            print(sources.DEFAULT_CONFIG, end="")
        return
    spark = build_session()
    if a.command == "features":
        runs.extract_features(spark, a.table, a.output, languages=a.languages, attributes=a.attributes, prefer_default_dialects=a.default_dialects, remove_zero=a.remove_zero)
    elif a.command in ("evaluate", "edits"):
        table = sources.read_feature_table(spark, a.table)
        features = [c for c in table.columns[table.columns.index(FEATURE_START) :] if c != "row_id"]
        if a.command == "evaluate":
            runs.evaluate_file(spark, a.predictions, table, features, a.output, a.split_complex, a.map)
        else:
            runs.edits_file(spark, a.predictions, table, features, a.output)
    elif a.command == "error-rates":
        rated = sources.read_results(spark, a.results)
        rated = evaluate.languages_or_error(rated, a.languages) if a.languages else rated
        for row in sinks.report(evaluate.macro_averages(rated)).orderBy("kind", "line").collect():
            print(f"{row['kind']}: {row['line']}")
    elif a.command == "transcribe":
        rows = sources.read_splits(spark, a.corpus, a.include_other, corpus.parse_limits(a.validation_limit), a.languages)
        spoken, _ = runs.transcribe(rows, [g2p.ENGINES[e] for e in a.engines])
        sinks.write_transcriptions(spoken, a.output)
    elif a.command == "lengths":
        audio = sources.read_audio_info(spark, a.audio)
        audio = audio.withColumn("num_samples", numeric.resampled_length(F.col("num_samples") / F.col("sample_rate"), F.col("sample_rate"), a.sample_rate).cast("long"))
        lang = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/audio/[^/]+$", 1), F.lit("")), F.lit("und"))
        rows = audio.select(F.lit(a.split).alias("split"), lang.alias("lang"), F.xxhash64("path").alias("pos"), numeric.frame_count(F.col("num_samples"), a.stride).cast("long").alias("length"))
        sinks.write_lengths(rows, a.output)
    elif a.command == "meta":
        sources.locales(sources.read_release_meta(spark, a.file)).select("locale", "clips", "users", "validHrs").orderBy("locale").show(1000, truncate=False)
    else:
        for row in runs.statistics(sources.read_lengths(spark, a.lengths), a.sample_rate).orderBy("split").collect():
            print(row["split"], row["json"])


if __name__ == "__main__":
    main()
