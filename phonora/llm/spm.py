"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from an installed vocabulary file; their log scores are those of a unigram model.  For a
file of merge ranks the log score follows Zipf's law, -log(rank + 1) less the normaliser.  Spaces become the marker ▁,
one of which is put before the text; characters outside the vocabulary fall back to their bytes.

No piece has a marker after another character, and none has a line break, so the best path of a text
is made of the best paths of its words.  Each worker keeps the paths of recent short words and decodes
the rest many words at a time in numpy, in passes bounded by their characters.  A very long word is
decoded position by position with one score, one back pointer and one piece id kept for each.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from phonora.llm.common import map_arrow

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words whose paths a worker keeps, and the longest of them; characters decoded in one numpy pass, and of
#: a word from which on it is decoded position by position.
CACHE, SHORT, PASS, LONG = 300_000, 64, 1 << 17, 1 << 15
_WORDS = re.compile(" *[^ \n]+| +|\n")
_UNKNOWN_PENALTY = np.float32(10.0)


class DoubleArray:
    """A double-array trie over byte strings: one step is base[state] + byte, valid if check agrees."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]) -> None:
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values, strict=True):
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][b]
            value[node] = v
        size = 2 * len(children) + 1024
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[:256] = bytes([1]) * 256
        self.value = np.full(size, -1, np.int32)
        place = [0] * len(children)
        start, cursor, stack = 256, 256, [0]
        self.value[0] = value[0]
        while stack:
            node = stack.pop()
            steps = sorted(children[node])
            if not steps:
                continue
            # a lone child fills the first hole; several children go behind the last that were placed
            at = max((used.find(0, start) if len(steps) == 1 else cursor) - steps[0], 0)
            while True:
                while at + 256 >= len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    base, check = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(grow, -1, np.int32)])
                if not any(used[at + b] for b in steps):
                    break
                at += 1
            if len(steps) > 1:
                cursor = max(cursor, at + steps[0])
            base[place[node]] = at
            for b in steps:
                used[at + b] = 1
                check[at + b] = place[node]
                place[children[node][b]] = at + b
                self.value[at + b] = value[children[node][b]]
                stack.append(children[node][b])
            if used[start]:
                start = used.find(0, start)
        self.base, self.check = np.concatenate([base, np.zeros(256, np.int32)]), np.concatenate([check, np.full(256, -1, np.int32)])


class Pieces:
    """A unigram model: piece texts, log scores and kinds ('normal', 'byte', 'unknown', 'control')."""

    def __init__(self, pieces: list[str], scores: Sequence[float], kinds: list[str]) -> None:
        self.pieces, self.kinds = pieces, kinds
        self.scores = np.array(scores, np.float32)
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in (pieces[i] for i in normal)):
            raise ValueError("a piece has a marker inside, or a line break; words are not independent")
        self.trie = DoubleArray([pieces[i].encode() for i in normal], normal)
        self.unknown = kinds.index("unknown")
        self.bytes = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown_score = np.float32(self.scores[normal].min() - _UNKNOWN_PENALTY)
        self.surface = [p.replace(MARK, " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds, strict=True)]
        for b in range(256):
            self.surface[self.bytes[b]] = bytes([b])
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.paths: dict[str, bytes] = {}

    def _edges(self, text: np.ndarray, starts: np.ndarray, stop: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces at the characters that begin at ``starts``, up to ``stop``.

        A character that is no piece gets the unknown one; ``char`` is its length in bytes.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(starts), bool)
        state, nth, at = np.zeros(len(starts), np.int64), np.arange(len(starts)), starts.copy()
        while len(at):
            step = self.trie.base[state] + text[at].astype(np.int64)
            good = self.trie.check[step] == state
            good &= (step != 0) | (state != 0)
            step, nth, at = step[good], nth[good], at[good] + 1
            piece = self.trie.value[step]
            hit = piece >= 0
            found.append((starts[nth[hit]], at[hit], piece[hit]))
            single[nth[hit & (at - starts[nth] == char[nth])]] = True
            more = at < stop[nth]
            state, nth, at = step[more], nth[more], at[more]
        lone = np.flatnonzero(~single)
        found.append((starts[lone], starts[lone] + char[lone], np.full(len(lone), self.unknown, np.int32)))
        a, b, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b, piece

    def _scores(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece == self.unknown, self.unknown_score, self.scores[piece]).astype(np.float64)

    def long_word(self, word: str, chunk: int = 1 << 14) -> bytes:
        """The same as ``viterbi`` for one word of any length, with about 20 bytes for each of its own."""
        text = np.frombuffer(word.replace(" ", MARK).encode(), np.uint8)
        n = len(text)
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        char = np.diff(np.append(starts, n))
        best, back, by = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        for low in range(0, len(starts), chunk):
            some = starts[low : low + chunk]
            a, b, piece = self._edges(text, some, np.full(len(some), n), char[low : low + chunk])
            order = np.lexsort((b, a))
            a, b, piece = a[order], b[order], piece[order]
            for s, t, i, x in zip(a.tolist(), b.tolist(), piece.tolist(), self._scores(piece).tolist(), strict=True):
                x += best[s]
                if x > best[t]:
                    best[t], back[t], by[t] = x, s, i
        path, at, unknown = array("i"), n, self.unknown
        while at:
            if by[at] == unknown:
                path.extend(self.bytes[text[back[at] : at]][::-1].tolist())
            else:
                path.append(by[at])
            at = back[at]
        return np.frombuffer(path, np.int32)[::-1].tobytes()

    def viterbi(self, words: list[str]) -> list[bytes]:
        """The best path of each word (spaces stand for markers) as 32-bit ids."""
        raw = [w.replace(" ", MARK).encode() for w in words]
        text = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw])
        begin = np.cumsum(size) - size
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        word = np.repeat(np.arange(len(raw)), size)
        char = np.diff(np.append(starts, len(text)))
        nth = np.zeros(len(text) + 1, np.int64)
        nth[starts] = char
        a, b, piece = self._edges(text, starts, (begin + size)[word[starts]], char)
        score = self._scores(piece)
        # words lie one after another with a gap, so that the end of one is not the start of the next
        shift = word[a]
        order = np.lexsort((b, a, a - begin[shift]))
        a, b, piece, score, shift = a[order], b[order], piece[order], score[order], shift[order]
        step_of = a - begin[shift]
        a, b = a + shift, b + shift
        best = np.full(len(text) + len(raw), -np.inf)
        back, by = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        best[begin + np.arange(len(raw))] = 0
        cuts = np.searchsorted(step_of, np.arange(int(step_of[-1]) + 2)) if len(a) else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            s, t = a[low:high], b[low:high]
            total = best[s] + score[low:high]
            better = total > best[t]
            t = t[better]
            best[t], back[t], by[t] = total[better], s[better], piece[low:high][better]
        root, here = begin + np.arange(len(raw)), begin + size + np.arange(len(raw))
        owner = np.arange(len(raw))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            prior = back[here]
            got.append((owner, prior, by[here]))
            going = prior > root[owner]
            owner, here = owner[going], prior[going]
        owner, prior, ids = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((prior, owner))
        owner, prior, ids = owner[order], prior[order], ids[order].astype(np.int32)
        counts = np.bincount(owner, minlength=len(raw))
        ends = np.cumsum(counts)
        out = []
        flawed = set(owner[ids == self.unknown].tolist())
        data = ids.tobytes()
        for w, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            if w in flawed:
                path: list[int] = []
                for i, p in zip(ids[e - c : e].tolist(), (prior[e - c : e] - w).tolist(), strict=True):
                    path += self.bytes[text[p : p + nth[p]]].tolist() if i == self.unknown else [i]
                out.append(np.array(path, np.int32).tobytes())
            else:
                out.append(data[4 * (e - c) : 4 * e])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        split = [_WORDS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.paths) > CACHE:
            self.paths.clear()
        known, fresh = self.paths, {}  # of long words, only those of these texts
        new = sorted(set().union(*split) - known.keys(), key=len)
        low = held = 0
        for k, w in enumerate(new):
            held += len(w)
            if len(w) >= LONG:
                fresh[w], low, held = self.long_word(w), k + 1, 0
            elif held >= PASS or k + 1 == len(new) or len(new[k + 1]) >= LONG:
                for x, path in zip(new[low : k + 1], self.viterbi(new[low : k + 1]), strict=True):
                    (known if len(x) <= SHORT else fresh)[x] = path
                low, held = k + 1, 0
        path_of = lambda w: known[w] if len(w) <= SHORT else fresh[w]
        return [np.frombuffer(b"".join(map(path_of if any(len(w) > SHORT for w in words) else known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ``ids``: markers become spaces, the one before the text goes."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))[1:] if len(ids) else b""


@cache
def load(path: str) -> Pieces:
    """Pieces of a SentencePiece file; merge ranks, if that is what it holds, become log scores."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    kinds = ["byte" if p.is_byte(i) else "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "normal" for i in range(n)]
    raw = np.array([p.get_score(i) for i in range(n)])
    normal = np.array([k == "normal" for k in kinds])
    if raw[normal].min() < -1000:  # ranks
        rank = np.zeros(n)
        rank[normal] = np.argsort(np.argsort(-raw[normal], kind="stable"), kind="stable")
        raw = np.where(normal, -np.log(rank + 1) - np.log((1 / (rank[normal] + 1)).sum()), 0.0)
    return Pieces([p.id_to_piece(i) for i in range(n)], raw, kinds)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids, round_trip) for every row of ``docs``.

    ids are those of the best path of the whole text, however long; round_trip says whether decoding them
    gives the text back (it does unless the text has the marker character itself).  Null and empty texts
    have no ids.  An empty table gives an empty one.  Repeated rows get equal results; only doc_id and text
    are read, so names of other columns cannot clash.
    """
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = pieces.encode(texts)
        same = [pieces.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
        n_bytes = [int(pieces.is_byte[x].sum()) for x in ids]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(n_bytes, pa.int64()), lists(ids), pa.array(same, pa.bool_())],
            ["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, no ids an empty one."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(path)
        texts = [None if x is None else pieces.decode(np.array(x, np.int32)).decode(errors="replace") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_arrow(encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run, f"doc_id {kind}, text string")


def transcode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with text decoded from its own ids, plus n_pieces and piece_ids.

    A null text stays null and has no ids.  Names that ``docs`` has already get underscores behind them.
    """
    path, at = path or vocabulary_path(), docs.columns.index("text")
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("n_pieces", "piece_ids"):
        while name in taken:
            name += "_"
        names.append(name)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = load(path)
        given = batch.column(at).to_pylist()
        ids = pieces.encode([t or "" for t in given])
        texts = pa.array([None if t is None else pieces.decode(x).decode(errors="replace") for t, x in zip(given, ids, strict=True)], pa.string())
        batch = batch.set_column(at, batch.schema.field(at), texts)
        columns = [*batch.columns, pa.array([len(x) for x in ids], pa.int64()), lists(ids)]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, StructField(names[0], LongType()), StructField(names[1], ArrayType(IntegerType()))])
    return map_arrow(docs, run, schema)
