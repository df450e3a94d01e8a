"""Schemas of the data model; nested and nullable as the files are."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> str:
    """Schemas are kept as DDL, which every reader takes and which needs no session."""
    return text


def parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


#: Metadata columns of a feature table, and the first of its feature columns.
FEATURE_METADATA = ["InventoryID", "Glottocode", "ISO6393", "LanguageName", "SpecificDialect", "GlyphID", "Phoneme", "Allophones", "Marginal", "SegmentClass", "Source"]
FEATURE_START = "tone"
SEGMENT_START = "syl"
SEGMENT_CLASSES = ("consonant", "vowel", "tone", "null")

TAGGED_RUN = "struct<transcription: array<string>, language: string>"
PHONEMES = f"struct<words: array<string>, phonemes: array<array<{TAGGED_RUN}>>>"

CLIP = _struct("client_id string, path string, sentence string, up_votes int, down_votes int, age string, gender string, accents string, locale string, segment string")
RAW_TRANSCRIPTION = _struct("raw_sentence string, utterance_id string, client_id string, age string, gender string, accents string")
TRANSCRIPTION = _struct(f"raw_sentence string, utterance_id string, client_id string, age string, gender string, accents string, phonemes {PHONEMES}")
FIELD_RECORDING = _struct("lang string, utterance_id string, raw string, phonemes array<string>")
INVENTORIES = _struct("lang_id int, lang string, phonemes array<string>")
ALLOPHONES = _struct("lang_id int, phoneme_index int, phone_indices array<int>")
MAPPING = _struct("source string, pos int, target string")
DISTANCES = _struct("source string, target string, distance int")
FEATURE_VECTOR = _struct("idx int, phoneme string, features array<string>")
CATEGORIES = _struct("feature string, value string, cat int")

CANDIDATES = "map<string, array<array<string>>>"
PREDICTION_META = _struct(
    "prediction_arguments string, corpus_type string, languages array<string>, feature_set string,"
    " indexer_state struct<phoneme_inventory: array<string>, language_allophones: string, table_file: string>,"
    " classifiers array<string>, label_inventories map<string, array<string>>, package_version string, format_version array<int>"
)
PREDICTION = _struct(f"language string, utterance_id string, predictions {CANDIDATES}, labels array<array<string>>")
#: An edit is [action, expected, actual] in the file; the numbers of the actions are fixed values.
EDITS = _struct("language string, utterance_id string, expected map<string, array<string>>, edit_operations map<string, array<array<string>>>")
ACTIONS = ("insertion", "deletion", "substitution")

STATISTICS = "struct<insertions: bigint, deletions: bigint, substitutions: bigint, correct: bigint>"
RESULTS = _struct(f"evaluation_arguments string, package_version string, results map<string, struct<properties: array<string>, error_rates: map<string, float>, error_statistics: map<string, {STATISTICS}>>>")

CATEGORY_STATISTICS = "struct<accent: map<string, double>, age: map<string, double>, gender: map<string, double>>"
LOCALE_META = (
    "struct<buckets: struct<dev: int, invalidated: int, other: int, reported: int, test: int, train: int, validated: int>, clips: int,"
    f" splits: {CATEGORY_STATISTICS}, users: int, size: bigint, checksum: string, avgDurationSecs: double, validDurationSecs: double,"
    " totalHrs: double, validHrs: double, duration: bigint, reportedSentences: int>"
)
RELEASE_META = _struct(f"bundleURLTemplate string, date date, name string, multilingual boolean, locales map<string, {LOCALE_META}>, totalDuration bigint, totalValidDurationSecs double, totalHrs double, totalValidHrs double, version string")

LENGTHS = _struct("split string, lang string, pos bigint, length bigint")
FEATURES = _struct("split string, lang string, pos bigint, length bigint, features array<float>")
AUDIO_INFO = _struct("sample_rate int, bits_per_sample int, num_channels int")
EDGES = _struct("node string, dep string")
CORPUS_META = _struct("split string, language_codes array<string>, phoneme_sources array<string>, limit_global int, limit_by_lang map<string, int>, resample int, feature_set string")


def camel(name: str) -> str:
    """snake_case to camelCase, as keys of release metadata are written."""
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)
