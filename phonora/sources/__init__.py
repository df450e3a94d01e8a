"""Readers."""

from __future__ import annotations

import io
import json
import re
import struct
import tomllib
import urllib.request
import wave
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonora import schemas
from phonora.functions import text
from phonora.operators import corpus, inventory


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, so that any store that Spark reads can be listed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def directories(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-directories: in a corpus each is a language."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text_file(spark: SparkSession, path: str) -> str:
    """A small file as one string."""
    return spark.read.text(path, wholetext=True).first()[0]


# Feature tables.


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line."""
    return list(pd.read_csv(io.StringIO(spark.read.text(path).first()[0]), dtype=str, nrows=0).columns)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """A feature table with metadata: all strings but InventoryID; a SegmentClass outside its values becomes null."""
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=False)
    return _typed_features(raw)


def feature_table_from_text(spark: SparkSession, content: str) -> DataFrame:
    """The same from CSV text, such as prediction files embed."""
    frame = pd.read_csv(io.StringIO(content), dtype=str, keep_default_na=False, na_values=[""])
    rows = frame.astype(object).where(frame.notna(), None)
    raw = spark.createDataFrame(rows.values.tolist(), T.StructType([T.StructField(c, T.StringType()) for c in frame.columns]))
    return _typed_features(raw)


def _typed_features(raw: DataFrame) -> DataFrame:
    out = inventory.with_row_id(raw)
    if "InventoryID" in raw.columns:
        out = out.withColumn("InventoryID", F.col("InventoryID").cast("int"))
    if "SegmentClass" in raw.columns:
        out = out.withColumn("SegmentClass", F.when(F.col("SegmentClass").isin(*schemas.SEGMENT_CLASSES), F.col("SegmentClass")))
    return out


def read_segment_table(spark: SparkSession, path: str, untie: bool = True) -> DataFrame:
    """A table of segments (ipa, features): first row of each segment, and copies without ties."""
    names = _header(spark, path)
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    out = inventory.without_duplicates(inventory.with_row_id(raw), "ipa")
    return inventory.with_untied_copies(out) if untie else out


def read_phoneme_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("phoneme"))
    return inventory.with_row_id(lines.filter("phoneme <> ''"))


def _numbered(raw: DataFrame) -> DataFrame:
    """``raw`` plus _path and pos, the number of a row in its file, however the file is split.

    Rows are counted by split, and numbered from what the splits before theirs hold.
    """
    rows = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    parts = rows.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).drop("_n")
    out = rows.join(parts, ["_path", "_start"])
    return out.select(*raw.columns, "_path", (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"))


# Clips of a crowd-sourced speech corpus: one directory per language, one TSV per split.


def read_clips(spark: SparkSession, path: str, files: Sequence[str], languages: Sequence[str] | None = None, limit: int | Mapping[str, int] | None = None, filters: Mapping[str, object] | None = None) -> DataFrame:
    """Rows of the TSV files of each language, with lang, file and pos.

    No quoting; columns go by position; a row of the wrong arity is an error; empty optional fields are
    null.  The limit counts raw rows of each file, before the file's filter.
    """
    available = directories(spark, path)
    chosen = available if languages is None else list(languages)
    missing = sorted(set(chosen) - set(available))
    if missing:
        raise KeyError(f"not available: {missing}")
    parts = []
    for name in files:
        paths = [p for lang in chosen if exists(spark, p := f"{path}/{lang}/{name}.tsv")]
        if not paths:
            continue
        # One read for all languages; the order of a file is that of its bytes.
        raw = spark.read.csv(paths, schema=schemas.CLIP, sep="\t", quote="", header=True, enforceSchema=True, mode="FAILFAST")
        rows = _numbered(raw).withColumns({"lang": F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1), "file": F.lit(name)}).drop("_path")
        rows = rows.withColumns({c: text.null_if_empty(F.col(c)) for c in ("age", "gender", "accents", "segment")})
        if limit is not None:
            rows = corpus.limited(rows, limit, ["pos"])
        test = (filters or {}).get(name)
        parts.append(rows if test is None else rows.filter(test))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_split(spark: SparkSession, path: str, split: str, include_other: bool = False, **options) -> DataFrame:
    """Transcriptions of a split; with ``include_other`` also the well-rated rows of 'other'."""
    files = [split, *(["other"] if include_other else [])]
    rows = read_clips(spark, path, files, filters={"other": corpus.positive_score()}, **options)
    return rows.select(
        F.col("sentence").alias("raw_sentence"), text.without_extension(F.col("path")).alias("utterance_id"), "client_id", "age", "gender", "accents", "lang", "file", "pos", F.lit(split).alias("split"),
    )


def read_splits(spark: SparkSession, path: str, include_other: bool = False, validation_limit: int | Mapping[str, int] | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    """Train, dev and test; the limit holds for dev only."""
    train = read_split(spark, path, "train", include_other, languages=languages)
    dev = read_split(spark, path, "dev", languages=languages, limit=validation_limit)
    return train.unionByName(dev).unionByName(read_split(spark, path, "test", languages=languages))


def read_release_meta(spark: SparkSession, path: str, timeout: float = 60) -> DataFrame:
    """Release metadata of a file or a web address; keys that are not in the schema are ignored."""
    if not re.match("https?://", path):
        return spark.read.schema(schemas.RELEASE_META).json(path, multiLine=True)
    with urllib.request.urlopen(path, timeout=timeout) as reply:
        body = spark.createDataFrame([(reply.read().decode(),)], "value string")
    return body.select(F.from_json("value", schemas.RELEASE_META).alias("m")).select("m.*")


def locales(meta: DataFrame) -> DataFrame:
    return meta.select("name", "date", F.explode("locales").alias("locale", "meta")).select("name", "date", "locale", "meta.*")


def read_inventories(spark: SparkSession, path: str) -> DataFrame:
    """(lang, phonemes) of a JSON object by language, phonemes sorted."""
    body = spark.read.text(path, wholetext=True)
    found = body.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("lang", "phonemes"))
    return found.withColumn("phonemes", F.sort_array("phonemes"))


def corpus_path(spark: SparkSession, directory: str) -> str:
    """The directory of the audio: what a .corpus_path file in it names, or itself."""
    redirect = f"{directory}/.corpus_path"
    return read_text_file(spark, redirect).strip() if exists(spark, redirect) else directory


# Field recordings: per language the files inventory, raw and text.


def read_field_recordings(spark: SparkSession, path: str, languages: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(recordings, inventories): lines of raw and text zipped by number; different ids are an error when read."""
    chosen = directories(spark, path) if languages is None else list(languages)

    def lines(name: str) -> DataFrame:
        body = spark.read.text([f"{path}/{lang}/{name}" for lang in chosen], wholetext=True)
        found = body.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("lang"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
        return found.filter("trim(value) <> ''")

    head = lambda c: F.get(F.split(F.trim(c), r"\s+"), F.lit(0))
    rest = lambda c: F.slice(F.split(F.trim(c), r"\s+"), 2, 1 << 20)
    raw = lines("raw").select("lang", "line", head("value").alias("_id"), F.array_join(rest("value"), " ").alias("raw"))
    said = lines("text").select("lang", "line", head("value").alias("utterance_id"), rest("value").alias("phonemes"))
    both = raw.join(said, ["lang", "line"], "full")
    same = F.when(F.col("_id").eqNullSafe(F.col("utterance_id")), F.col("utterance_id")).otherwise(F.raise_error(F.concat(F.lit("ids differ at line "), F.col("line").cast("string"), F.lit(" of "), F.col("lang"))).cast("string"))
    recordings = both.select("lang", same.alias("utterance_id"), "raw", "phonemes", F.col("line").alias("pos"))
    parts = F.split(F.trim("value"), r"\s+")
    two = F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), F.col("value"))).cast("string"))
    return recordings, inventory.language_inventory(lines("inventory").select("lang", two.alias("phoneme")), "lang", "phoneme")


def load_corpus(spark: SparkSession, path: str, kind: str, languages: Sequence[str] | None = None, validation_limit=None, only_primary: bool = False) -> DataFrame:
    """A corpus with a split column: 'clips' directory, 'transcribed' table of one or all splits, or 'field' recordings."""
    if kind == "clips":
        return read_splits(spark, path, validation_limit=validation_limit, languages=languages)
    if kind == "field":
        return read_field_recordings(spark, path, languages)[0].withColumn("split", F.lit("test"))
    m = re.search(r"split=(train|dev|test)/?$", path)
    rows = spark.read.parquet(path)
    rows = rows.withColumn("split", F.lit(m[1])) if m else rows
    rows = corpus.allowed_languages(rows, languages)
    if validation_limit is not None:
        dev = corpus.limited(rows.filter("split = 'dev'"), validation_limit, ["pos"])
        rows = rows.filter("split <> 'dev'").unionByName(dev)
    return corpus.primary_only(rows) if only_primary else rows


def read_lengths(spark: SparkSession, path: str, split_languages: Mapping[str, Sequence[str]] | None = None, with_features: bool = False) -> DataFrame:
    """Stored frame counts, and features if asked, in the order of languages and positions; other columns are not read."""
    rows = spark.read.parquet(path)
    columns = ["split", "lang", "pos", "length", *(["features"] if with_features else [])]
    if split_languages is not None:
        keep = F.lit(False)
        for split, langs in split_languages.items():
            keep |= (F.col("split") == split) & F.col("lang").isin(list(langs))
        rows = rows.filter(keep)
    return rows.select(*columns)


# JSON lines with a metadata line first.


def read_json_lines(spark: SparkSession, path: str, row: str, meta: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, rows) of a file, gzip by suffix: the first line is metadata, the others are rows.

    Rows are told from metadata by a field that only metadata has, so the file stays splittable.
    """
    lines = spark.read.text(path)
    only = [f for f in schemas.parsed(meta).fieldNames() if f not in schemas.parsed(row).fieldNames()][0]
    is_meta = F.get_json_object("value", f"$.{only}").isNotNull()
    head = lines.filter(is_meta).select(F.from_json("value", meta).alias("m")).select("m.*")
    body = lines.filter(~is_meta & (F.trim("value") != "")).select(F.from_json("value", row, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return head, body


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_json_lines(spark, path, schemas.PREDICTION, schemas.PREDICTION_META)


def read_edits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edits with their actions as (action, expected, actual)."""
    head, rows = read_json_lines(spark, path, schemas.EDITS, schemas.PREDICTION_META)
    one = lambda e: F.struct(e[0].cast("int").alias("action"), e[1].alias("expected"), e[2].alias("actual"))
    return head, rows.withColumn("edit_operations", F.transform_values("edit_operations", lambda k, v: F.transform(v, one)))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(language, classifier, insertions, deletions, substitutions, correct, error_rate) of a results document.

    A rate without statistics, or the other way round, is an error when read.
    """
    doc = spark.read.schema(schemas.RESULTS).json(path, multiLine=True)
    one = doc.select(F.explode("results").alias("language", "_r"))
    rows = one.select("language", F.col("_r.error_rates").alias("_rates"), F.explode("_r.error_statistics").alias("classifier", "_s"))
    rate = F.coalesce(F.try_element_at("_rates", F.col("classifier")), F.raise_error(F.concat(F.lit("no rate for "), F.col("classifier"))).cast("float"))
    return rows.select("language", "classifier", "_s.*", rate.alias("error_rate"))


# Audio.


def decode_wave(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and the first channel of a PCM WAVE file, in -1 .. 1."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate, n = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()
        raw = f.readframes(n)
    x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[width]).reshape(-1, channels)[:, 0].astype(np.float32)
    return rate, (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))


def resample(x: np.ndarray, rate: int, target: int, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Band-limited interpolation to a sample rate by a sinc kernel under a Hann window, length rounded up."""
    if rate == target or not len(x):
        return x
    common = np.gcd(rate, target)
    old, new = rate // common, target // common
    base = min(old, new) * rolloff
    half = int(np.ceil(width * old / base))
    taps = np.arange(-half, half + old) / old
    t = np.clip((taps[None, :] - np.arange(new)[:, None] / new) * base, -width, width)
    kernel = np.sinc(t) * np.cos(t * np.pi / width / 2) ** 2 * base / old
    padded = np.pad(x.astype(np.float64), (half, half + old))
    steps = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[::old]
    return (steps @ kernel.T).ravel()[: -(-len(x) * target // rate)].astype(np.float32)


#: Bytes from the start of a file that hold the header of a WAVE file.
HEADER_BYTES = 1 << 16


def wave_header(head: bytes, size: int) -> tuple[int, int, int, int]:
    """(sample rate, channels, bits of a sample, samples) from the first bytes of a WAVE file of ``size`` bytes."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, found = 12, None
    while at + 8 <= len(head):
        kind, n = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            found = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
        elif kind == b"data" and found:
            _, channels, rate, _, block, bits = found
            return rate, channels, bits, min(n, size - at - 8) // block
        at += 8 + n + n % 2
    raise ValueError("no data in the header")


def read_audio_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, num_channels, bits_per_sample, num_samples) of WAVE files; only headers are decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *wave_header(bytes(h), int(n))) for p, h, n in zip(part["path"], part["head"], part["length"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "num_channels", "bits_per_sample", "num_samples"])

    heads = files.select("path", F.substring("content", 1, HEADER_BYTES).alias("head"), "length")
    return heads.mapInPandas(run, "path string, sample_rate int, num_channels int, bits_per_sample int, num_samples long")


def read_audio(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """(path, sample_rate, num_samples, audio) of WAVE files, resampled if asked."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for p, content in zip(part["path"], part["content"], strict=True):
                rate, x = decode_wave(content)
                x = resample(x, rate, target) if target else x
                out.append((p, target or rate, len(x), x))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "num_samples", "audio"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, num_samples long, audio array<float>")


def mel_power(audio: np.ndarray, rate: int, bands: int = 40, frame_ms: int = 25, stride_ms: int = 10) -> np.ndarray:
    """Mel energies (frames x bands) of centred frames."""
    size, stride = int(frame_ms / 1000 * rate), int(stride_ms / 1000 * rate)
    n_fft = 1 << max(size - 1, 1).bit_length()
    padded = np.pad(audio, n_fft // 2, "reflect" if len(audio) > n_fft // 2 else "constant")
    count = 1 + len(audio) // stride
    frames = np.stack([padded[i * stride : i * stride + n_fft] for i in range(count) if i * stride + n_fft <= len(padded)] or [np.zeros(n_fft, np.float32)])
    window = np.zeros(n_fft, np.float32)
    low = (n_fft - size) // 2
    window[low : low + size] = np.hanning(size)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    freqs = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (freqs[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return power @ np.maximum(0, np.minimum(up, down)).T


def log_mel(audio: np.ndarray, rate: int, bands: int = 40, frame_ms: int = 25, stride_ms: int = 10) -> np.ndarray:
    """Logarithmic mel energies (frames x bands)."""
    return np.log(mel_power(audio, rate, bands, frame_ms, stride_ms) + 1e-5)


def pre_emphasised(audio: np.ndarray, coefficient: float = 0.97) -> np.ndarray:
    """Each sample less the coefficient times the one before; before the first comes the second."""
    before = np.concatenate([audio[1:2] if len(audio) > 1 else audio[:1], audio[:-1]])
    return audio - coefficient * before


def normalised(features: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    """Zero mean and unit variance over the frames, feature by feature."""
    return (features - features.mean(axis=0)) / np.sqrt(features.var(axis=0) + epsilon)


def mfcc(audio: np.ndarray, rate: int, coefficients: int = 40, bands: int = 128, frame_ms: int = 25, stride_ms: int = 10) -> np.ndarray:
    """Cepstral coefficients (frames x coefficients): an orthonormal cosine transform of mel energies in decibels.

    Energies more than 80 decibels below the loudest are raised to that.
    """
    power = 10 * np.log10(np.maximum(mel_power(audio, rate, bands, frame_ms, stride_ms), 1e-10))
    power = np.maximum(power, power.max() - 80)
    k, n = np.arange(coefficients)[:, None], np.arange(bands)[None, :]
    basis = np.cos(np.pi / bands * (n + 0.5) * k) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return power @ basis.T


#: Features by name; each takes samples, their rate and the number of features.
FEATURES = {
    "filterbanks": lambda x, rate, n: normalised(log_mel(pre_emphasised(x), rate, n)),
    "mfcc": lambda x, rate, n: normalised(mfcc(pre_emphasised(x), rate, n)),
    "log_mel": log_mel,
}


def features_of(audio: DataFrame, bands: int = 40, kind: str = "log_mel") -> DataFrame:
    """``audio`` plus features array<array<float>> of a kind named in ``FEATURES``."""
    make = FEATURES[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(features=[make(np.asarray(x, np.float32), int(r), bands).astype(np.float32).tolist() for x, r in zip(part["audio"], part["sample_rate"], strict=True)])

    return audio.mapInPandas(run, audio.limit(0).selectExpr("*", "cast(null as array<array<float>>) as features").schema)


# Configuration.

#: What a run is configured with unless a document says otherwise.
DEFAULT_CONFIG = """\
[data]
splits = ["train", "dev", "test"]
include_other = false
# validation_limit = 100, or a table of limits by language

[preprocessing]
sample_rate = 16000
feature_type = "raw"  # or filterbanks, mfcc
num_filters = 40
frame_ms = 25
stride_ms = 10

[batching]
mode = "frames"  # or utterances
budget = 40000
oversampling_factor = 0.5

[decoding]
beam_width = 1
n_best = 1
"""


def load_config(spark: SparkSession, path: str) -> dict:
    """A TOML or JSON document as a dictionary; what it leaves out is as in ``DEFAULT_CONFIG``."""
    body = read_text_file(spark, path)
    return json.loads(body) if path.endswith(".json") else tomllib.loads(body)
