"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams.  Training follows the regularised
leader (FTRL-proximal) with elastic-net penalties on a bounded, stratified sample of labelled rows;
a temperature fitted on a part of that sample calibrates the probabilities.  Its targets are smoothed by
the size of that part, as a part without an error does not prove that there are none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import map_arrow

#: log2 of the number of hashed features.
BITS = 15
#: Training rows of each language and of all at most, and the longest text among them; all bound the driver.
ROWS_PER_LANGUAGE, ROWS, TRAIN_CHARS = 1500, 12_000, 20_000
#: Probability under which the pipeline rejects a document; texts of one or two words may well be below a half.
REJECT_BELOW = 0.3
#: The pipeline also rejects a text if surely less than this share of what is usual of its n-grams is known.
REJECT_KNOWN = 0.8
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case letter of each code point; 32 for what is not a letter."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def ngrams(text: str) -> np.ndarray | None:
    """Hashed n-grams of a text, one entry for each occurrence; None if it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = _letters()[codes] if len(codes) else codes
    if not (c != 32).any():
        return None
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    space = c == 32
    c = c[~(space & np.concatenate([[False], space[:-1]]))]
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1)
    h = np.concatenate([one[c != 32], two, three])
    return ((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)) >> np.uint32(32 - BITS)


def counted(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text and how often each occurs, in few bytes."""
    counts = np.bincount(hashed, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.min_scalar_type((1 << BITS) - 1)), counts[at].astype(np.uint32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Share of the different n-grams that training has seen, of all but one in a hundred texts.
    usual: float = 0.0

    def __post_init__(self) -> None:
        self.seen = self.idf < self.idf.max(initial=0.0)

    def known(self, hashed: np.ndarray) -> float:
        """Share of the different n-grams of a text that training has seen, with three standard errors to the good."""
        there = np.zeros(1 << BITS, bool)
        there[hashed] = True
        n = int(there.sum())
        p = float((there & self.seen).sum()) / n
        return p + 3 * np.sqrt((p * (1 - p) + 0.25 / n) / n)

    def features(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, counts = counted(hashed)
        return at, self.weighted(at, counts)

    def weighted(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts.astype(np.int64))) * self.idf[at]
        return (x / np.sqrt((x * x).sum())).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        hashed = ngrams(text) if text else None
        return self.predict_from(hashed)

    def predict_from(self, hashed: np.ndarray | None) -> tuple[str, float]:
        if hashed is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = self.features(hashed)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())

    def accepts(self, text: str | None, reject_below: float) -> bool:
        hashed = ngrams(text) if text else None
        lang, p = self.predict_from(hashed)
        return lang != UNKNOWN and p >= reject_below and self.known(hashed) >= REJECT_KNOWN * self.usual


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Iterator[tuple[str, str]]:
    """(text, lang) of up to about ``rows`` labelled training rows of each language and ``ROWS`` of all, chosen by a hash of doc_id.

    Sorted in an executor and read row by row, so the driver never holds all texts as Python objects.
    """
    labelled = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter((F.crc32("doc_id") % 3 != 1) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return
    rows = max(1, min(rows, ROWS // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 32, int((1 << 32) * rows / n)))])
    chosen = labelled.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share[F.col("lang")]) & F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    found = chosen.withColumn("_order", F.xxhash64("doc_id", "text", "lang")).orderBy("_order").limit(2 * rows * len(counts))
    for r in found.sortWithinPartitions("doc_id", "lang", "text").toLocalIterator():  # the limit leaves one partition
        yield r["text"], r["lang"]


def train(rows: Iterable[tuple[str, str]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> Model:
    """Fit a model; a fifth of the rows is held back for the temperature."""
    rows = [(*counted(h), lang) for text, lang in rows if (h := ngrams(text)) is not None]
    languages = sorted({lang for *_, lang in rows})
    size, k = 1 << BITS, len(languages)
    model = Model(languages, np.zeros(size), np.zeros((size, k)), np.zeros(k))
    if not rows:
        return model
    seen = np.zeros(size)
    for at, *_ in rows:
        seen[at] += 1
    model.idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    model.seen = seen > 0
    data = []
    for i, (at, counts, lang) in enumerate(rows):
        data.append((at, model.weighted(at, counts), languages.index(lang)))
        rows[i] = None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held = order[: len(data) // 5]
    order = order[len(data) // 5 :]
    z, n = np.zeros((size, k)), np.zeros((size, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(order):
            at, x, y = data[i]
            w, b = solve(z[at], n[at], l1), solve(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    model.weights, model.bias = solve(z, n, l1), solve(zb, nb, 0.0)
    if len(held):
        scores = np.array([data[i][1] @ model.weights[data[i][0]] + model.bias for i in held])
        truth = np.array([data[i][2] for i in held])

        target = np.full(scores.shape, 1 / (len(held) + 2) / max(k - 1, 1))
        target[np.arange(len(held)), truth] = 1 - 1 / (len(held) + 2)

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)).mean())

        model.temperature = float(min(np.exp(np.linspace(np.log(0.002), np.log(10), 172)), key=loss))
        model.usual = float(np.quantile([model.known(data[i][0]) for i in held], 0.01))
    return model


def _broadcast(docs: DataFrame, rows: int):
    return docs.sparkSession.sparkContext.broadcast(train(sample(docs, rows)))


def identify(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) modulo 3 is not 1, at most
    about ``rows`` of each language and ``ROWS`` of all, none longer than ``TRAIN_CHARS``; texts of any
    length are judged whole.  lang_pred is a learned value, or 'und' with score 0 if the text is
    null, empty or has no letter, or nothing could be learned.  Repeated rows get equal results; columns
    other than doc_id, text and lang are not read.  held_out is false for a null doc_id.
    """
    model = _broadcast(docs, rows)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.value.predict(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out")), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose language is one of those learned, columns as they are.

    Rejected are null texts and texts without letters, those whose likeliest language has a probability
    below ``reject_below``, and those that surely hold too few n-grams of any language learned; the shorter
    a text, the less is sure.  An empty table gives an empty one; repeated rows are judged alike.
    """
    model, at = _broadcast(docs, rows), docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.value.accepts(t, reject_below) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
