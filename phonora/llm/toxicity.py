"""Toxicity grades by cumulative-link ordinal regression.

The severity y of a text is one of ordered grades, and P(y <= j) = sigmoid(threshold_j - w.x): all
thresholds share the weights w of sparse text features (words and word beginnings, logarithmic
counts).  Expected severity is the sum of P(y > j).

The labels say only whether a text is toxic.  Grades above 0 are terciles of how often the terms that
mark toxic training texts occur in a toxic training text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import map_arrow

GRADES = 4
#: Labelled training texts of each class at most, and the longest among them; both bound the driver.
ROWS_PER_CLASS, TRAIN_CHARS = 2500, 20_000
#: Texts in which a feature must occur to be learned, and characters of word beginnings.
LEAST, BEGINNINGS = 4, (4, 5, 6)
#: A feature is learned only if its log odds ratio between toxic and other texts exceeds LIFT, and SURE
#: times its standard error.
LIFT, SURE = 2.0, 2.5
_WORD = re.compile(r"[^\W\d_]+")


def counted(text: str) -> Counter:
    """How often each word occurs, lower case."""
    return Counter(_WORD.findall(text.lower()))


def features(words: Counter) -> Counter:
    """Counts of words and, marked by an asterisk, of their beginnings."""
    out = Counter(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def _is_letter(c: str) -> bool:
    """Whether a character can be part of a word, as ``_WORD`` has it."""
    return c.isalnum() and not c.isdecimal()


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "thresholds": self.thresholds}

    def _finder(self) -> ahocorasick.Automaton:
        """All learned features at once: (characters, feature as a word, feature as a beginning) of each text."""
        found = self.__dict__.get("finder")
        if found is None:
            found = self.__dict__["finder"] = ahocorasick.Automaton()
            for name in {f.rstrip("*") for f in self.weights}:
                found.add_word(name, (len(name), name if name in self.weights else None, f"{name}*" if f"{name}*" in self.weights else None))
            found.make_automaton()
        return found

    def raw(self, text: str) -> float:
        """Weighted logarithmic counts of the learned features, found in one pass over the text."""
        if not self.weights:
            return 0.0
        low, counts = text.lower(), {}
        for end, (size, word, beginning) in self._finder().iter(low):
            if end < size or not _is_letter(low[end - size]):
                f = beginning if end + 1 < len(low) and _is_letter(low[end + 1]) else word
                if f is not None:
                    counts[f] = counts.get(f, 0) + 1
        return sum(self.weights[f] * (1 + math.log(n)) for f, n in counts.items())

    def predict(self, text: str | None) -> tuple[float, float, int]:
        """Expected severity, probability of a grade above 0, and the likeliest grade."""
        if not text or not self.thresholds:
            return 0.0, 0.0, 0
        above = [float(_sigmoid(self.raw(text) - t)) for t in self.thresholds]
        each = np.diff([-1.0, *(-a for a in above), 0.0])
        return sum(above), above[0], int(np.argmax(each))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> list[tuple[str, int]]:
    """(text, toxic) of about ``rows`` training rows of each class, chosen by a hash of doc_id.

    Training rows have a label and crc32(doc_id as text) modulo 3 other than 1; a document is toxic if
    any of its labels says so.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("_doc"), F.col("toxic").cast("int").alias("toxic")).filter("_doc is not null and toxic is not null")
    known = known.filter(F.crc32("_doc") % 3 != 1).groupBy("_doc").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 32, int((1 << 32) * rows / n)))])
    ids = known.filter(F.pmod(F.xxhash64("_doc"), F.lit(1 << 32)) < share[F.col("toxic")]).orderBy(F.xxhash64("_doc")).limit(2 * rows * len(counts))
    text = F.col("text").cast("string")
    chosen = docs.select(F.col("doc_id").cast("string").alias("doc"), text.alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    found = chosen.join(F.broadcast(ids), F.col("doc") == F.col("_doc")).select("doc", "text", "toxic").orderBy(F.xxhash64("doc", "text"), "toxic").limit(2 * rows * len(counts)).collect()
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["doc"], r["text"]))]


def _varied(rows: list[tuple[str, int]], parts: int = 3, least: int = 40) -> list[tuple[str, int]]:
    """Training rows without copies and near copies, whose words would look frequent: of rows that share
    the letters of their first, middle or last words, one stays."""
    seen: set[tuple] = set()
    out = []
    for text, y in rows:
        words = _WORD.findall(text.lower())
        n = len(words)
        keys = [(k, *words[low : low + 8]) for k, low in enumerate((0, max(0, n // 2 - 4), max(0, n - 8)))] if n >= least else [(parts, *words)]
        if not any(k in seen for k in keys):
            out.append((text, y))
        seen.update(keys)
    return out


def train(rows: list[tuple[str, int]], epochs: int = 10, rate: float = 0.2, l1: float = 1e-3, seed: int = 3) -> Model:
    rows = _varied(rows)
    toxic = np.array([int(y > 0) for _, y in rows])
    if not len(rows) or toxic.min() == toxic.max():
        return Model()
    index: dict[str, int] = {}
    found = []  # the features of each text by number, and how often they occur
    for text, _ in rows:
        x = features(counted(text))
        found.append((np.array([index.setdefault(k, len(index)) for k in x], np.int32), np.fromiter(x.values(), np.int32, len(x))))
    seen, bad = (np.bincount(np.concatenate([x for (x, _), y in zip(found, toxic, strict=True) if y >= least] or [np.zeros(0, np.int32)]), minlength=len(index)) for least in (0, 1))
    n_bad, n_good = int(toxic.sum()), int((1 - toxic).sum())
    good = seen - bad
    lift = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    spread = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    strong = np.flatnonzero((seen >= LEAST) & (np.abs(lift) > LIFT) & (np.abs(lift) > SURE * spread))
    of = list(index)
    place = {of[i]: i for i in strong.tolist()}
    names = sorted(place)
    number = np.full(len(index), -1)
    number[[place[k] for k in names]] = np.arange(len(names))
    marks = {k for k in names if lift[place[k]] > 0}
    load, sparse = np.zeros(len(rows)), []
    for i, (at, counts) in enumerate(found):
        own = number[at] >= 0
        at, counts = number[at[own]], counts[own]
        sparse.append((at, 1 + np.log(counts)))
        x = {names[k]: n for k, n in zip(at.tolist(), counts.tolist(), strict=True)}
        # a word counts once, by its shortest mark
        load[i] = sum(n for k, n in x.items() if k in marks and not any(k[:j] + "*" in marks for j in BEGINNINGS if j < len(k.rstrip("*"))))
    cut = np.quantile(load[toxic == 1], [i / (GRADES - 1) for i in range(1, GRADES - 1)])
    y = np.where(toxic == 1, 1 + (load[:, None] > cut[None, :]).sum(axis=1), 0)
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    t, t2 = np.arange(1, GRADES, dtype=float), np.full(GRADES - 1, 1e-6)
    balance = np.where(toxic == 1, len(toxic) / (2 * n_bad), len(toxic) / (2 * n_good))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(sparse)):
            at, x = sparse[i]
            s = float(x @ w[at])
            # likelihood of grade y: sigmoid(t_y - s) - sigmoid(t_{y-1} - s), open at both ends
            high = _sigmoid(t[y[i]] - s) if y[i] < GRADES - 1 else 1.0
            low = _sigmoid(t[y[i] - 1] - s) if y[i] > 0 else 0.0
            p = max(high - low, 1e-9)
            d_high, d_low = high * (1 - high), low * (1 - low)
            ds = balance[i] * (d_high - d_low) / p
            g = ds * x + l1 * np.sign(w[at])
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            dt = np.zeros(GRADES - 1)
            if y[i] < GRADES - 1:
                dt[y[i]] = -balance[i] * d_high / p
            if y[i] > 0:
                dt[y[i] - 1] = balance[i] * d_low / p
            t2 += dt * dt
            t = np.maximum.accumulate(t - rate * dt / np.sqrt(t2) + np.arange(GRADES - 1) * 1e-6)
    strong = np.abs(w) > 0.02
    return Model({k: float(v) for k, v, s in zip(names, w, strong, strict=True) if s}, t.tolist())


def grade(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row of ``docs``.

    severity is the expected grade, toxic whether p_toxic = P(grade > 0) is at least 0.5.  Null and empty
    texts have severity 0; so has everything if there are no labels of both classes.  At most about ``rows``
    labelled texts of each class, none longer than ``TRAIN_CHARS``, train the model; texts of any length are
    graded whole.  Repeated rows get equal results, an empty table gives an empty one; of ``docs`` only doc_id
    and text are read, so other columns cannot clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, rows)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, p, g = zip(*(model.value.predict(t) for t in batch.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(s, pa.float64()), pa.array(p, pa.float64()), pa.array(g, pa.int32()), pa.array([x >= 0.5 for x in p], pa.bool_())],
            ["doc_id", "severity", "p_toxic", "grade", "toxic"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")
