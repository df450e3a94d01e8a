"""Secret scans: exact base patterns plus a linear-chain conditional random field.

The base patterns are exact and their spans always stay.  The field tags tokens as outside (O),
begin (B) or inside (I) of a secret, using token shape, neighbouring words and file features, and
is decoded by Viterbi.  Every token of every line is scored for all labels.  Tokens that are outside
on every best path, as a bound over the transitions shows, split a line; only what lies between them
needs the recursion.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonora.llm.common import map_arrow

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Pieces of a text: runs of letters and digits, single marks, and white space, which is not a token.
_PIECE = re.compile(r"[A-Za-z0-9]+|[+/_.=-]|[\x00-\x20]+|[^\x00-\x20A-Za-z0-9+/_.=-]", re.A)
#: Whole runs of letters and digits that hold a digit: places of training windows.
_MAYBE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*", re.A)
LABELS = "OBI"
#: Shortest token that looks like a key in training windows, hashed weights, and training lines at most.
SHORTEST, BITS, LINES = 8, 14, 4000
#: Tokens a worker keeps the scores of, and characters of lines scored at once (a longer line is one block).
KEPT, BLOCK = 200_000, 1 << 18
#: Words that introduce credentials, beyond those of the base patterns; used to make training lines.
WORDS = ["pwd", "pass", "auth", "bearer", "credential", "private_key", "access_key", "client_secret", "key", "authorization"]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_CLASS = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "f"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "9")})
_REPEAT = re.compile(r"(.)\1+", re.S)


def allowed(token: str) -> bool:
    """Whether a token looks like a key: a long run with a digit that is not a plain number."""
    return len(token) >= SHORTEST and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


@lru_cache(1 << 14)
def _index(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") >> (32 - BITS)


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all tokens, their lengths, and where each starts."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32), size, np.cumsum(size) - size


def _contexts(tokens: list[str]) -> np.ndarray:
    """Places of the features of lower-cased tokens before, two before and as a word before another token."""
    codes, size, start = _codes(tokens)
    if not len(codes):
        return np.zeros((len(tokens), 3), np.int64)
    inside = np.arange(len(codes)) - np.repeat(start, size)
    h = (codes.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (2 * inside.astype(np.uint64) + np.uint64(1)))
    h = np.add.reduceat(h ^ (h >> np.uint64(29)), start) + size.astype(np.uint64)
    out = []
    for salt in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(salt)
        out.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    return np.stack(out, axis=1)


def file_features(text: str) -> list[str]:
    """Features of the whole text: size, lines, and how much of it looks like code or settings."""
    n = max(len(text), 1)
    marks = sum(map(text.count, "{}();=<>"))
    return [f"file:size{int(math.log10(n))}", f"file:code{min(4, int(200 * marks / n))}", f"file:lines{min(4, int(math.log10(text.count(chr(10)) + 1)))}"]


def own_features(tokens: list[str]) -> np.ndarray:
    """Places of the features of the tokens' own form: shape, length, digits, entropy, hexadecimal, and one for all."""
    codes, size, start = _codes(tokens)
    shapes = [x if len(x) <= 6 else f"mix{len(set(x))}" for x in _REPEAT.sub(r"\1", "\0".join(tokens).translate(_CLASS)).split("\0")]
    digit = (codes >= 48) & (codes <= 57)
    low = codes | np.uint32(32)
    hexes = np.minimum.reduceat(digit | (low >= 97) & (low <= 102), start)
    order = np.sort((np.repeat(np.arange(len(size)), size).astype(np.uint64) << np.uint64(21)) | codes)
    first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
    count = np.diff(np.append(first, len(order))).astype(float)
    entropy = np.log2(size) - np.bincount((order[first] >> np.uint64(21)).astype(np.int64), count * np.log2(count), len(size)) / size
    named = lambda kind, values: np.array([_index(f"{kind}:{v}") for v in values])
    return np.stack(
        [
            np.full(len(size), _index("1")),
            named("shape", shapes),
            named("len", range(13))[np.minimum(size // 4, 12)],
            named("digits", range(6))[5 * np.add.reduceat(digit, start, dtype=np.int64) // size],
            named("entropy", range(64))[np.clip((2 * entropy + 1e-9).astype(np.int64), 0, 63)],
            named("hex", (False, True))[hexes.astype(np.int64)],
        ],
        axis=1,
    )


def is_word(t: str) -> bool:
    return t.isalpha() and len(t) > 2


def glued_length(tokens: list[str], gaps: list[bool], i: int) -> int:
    """Characters of the run of letters, digits and +/_.=- around a token that no space breaks."""
    low = high = i
    while not gaps[low] and low and in_run(tokens[low]) and in_run(tokens[low - 1]):
        low -= 1
    while high + 1 < len(tokens) and not gaps[high + 1] and in_run(tokens[high]) and in_run(tokens[high + 1]):
        high += 1
    return sum(map(len, tokens[low : high + 1]))


def in_run(t: str) -> bool:
    return t[0] in "+/_.=-" or t.isascii() and t.isalnum()


def features(tokens: list[str], gaps: list[bool], of_file: list[str]) -> list[list[int]]:
    """Places of the features of each token of a line; ``gaps`` tells which tokens follow white space."""
    lows = [t.lower() for t in tokens]
    own, context = own_features(tokens).tolist(), _contexts([*lows, "^"]).tolist()
    out = []
    for i in range(len(tokens)):
        words = [k for k in range(max(0, i - 6), i) if is_word(lows[k])][-2:]
        names = [f"next:{lows[i + 1][:2] if i + 1 < len(lows) else '^'}", f"gap:{int(gaps[i])}", f"run:{min(glued_length(tokens, gaps, i) // 4, 12)}"]
        before = [context[i - 1 if i else -1][0], context[i - 2 if i > 1 else -1][1]]
        out.append([*own[i], *map(_index, [*names, *of_file]), *before, *(context[k][2] for k in words)])
    return out


class Pieces(dict):
    """Numbers of pieces of text and, by number, what the scores of a token add up from."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights
        self.sums = np.zeros((1024, 5, 3))  # as the one before, two before, a word before, behind, the token itself
        self.kind = np.zeros((1024, 5), np.int64)  # length, space, line end, part of a run, word
        self.learn(["^"])

    def learn(self, new: list[str]) -> None:
        """Number pieces that are not known yet."""
        spaces, tokens = [t for t in new if t[0] <= " "], [t for t in new if t[0] > " "]
        low, n = len(self), len(self) + len(new)
        while n > len(self.sums):
            self.sums, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.kind))
        self.update(zip([*spaces, *tokens], range(low, n), strict=True))
        at = low + len(spaces)
        self.kind[low:at] = [(len(t), 1, "\n" in t, 0, 0) for t in spaces] or np.zeros((0, 5), np.int64)
        if tokens:
            lows = "\0".join(tokens).lower().split("\0")
            self.kind[at:n] = [(len(t), 0, 0, in_run(t), is_word(x)) for t, x in zip(tokens, lows, strict=True)]
            self.sums[at:n, :3] = self.weights[_contexts(lows)]
            self.sums[at:n, 3] = self.weights[[_index("next:" + x[:2]) for x in lows]]
            self.sums[at:n, 4] = self.weights[own_features(tokens)].sum(axis=1)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        new = set(pieces) - self.keys()
        if new:
            self.learn(sorted(new))
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


@dataclass
class Model:
    weights: np.ndarray  # features x labels
    steps: np.ndarray  # label x label

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "steps": self.steps}

    def _pieces(self) -> Pieces:
        pieces = self.__dict__.get("pieces")
        if pieces is None or len(pieces) > KEPT:
            pieces = self.__dict__["pieces"] = Pieces(self.weights)
        return pieces

    def scores(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores without file features, starts, ends, place in the line) of the tokens among the pieces of whole lines."""
        known = self._pieces()
        ids = known.numbers(pieces)
        kind = known.kind[ids]
        end = np.cumsum(kind[:, 0])
        at = np.flatnonzero(kind[:, 1] == 0)
        before = np.maximum(at - 1, 0)
        gap = (at == 0) | (kind[before, 1] == 1)
        first = (at == 0) | (kind[before, 2] == 1)
        if len(first):
            first[0] = True
        ids, length, run, word = ids[at], kind[at, 0], kind[at, 3] == 1, kind[at, 4] == 1
        n = len(at)
        here = np.arange(n)
        place = here - np.maximum.accumulate(np.where(first, here, 0))
        last = np.append(first[1:], True)[:n]
        none = known["^"]
        shifted = lambda k: np.where(place >= k, np.concatenate([np.full(min(k, n), none), ids[: max(n - k, 0)]]), none)
        u = known.sums[ids, 4] + known.sums[shifted(1), 0] + known.sums[shifted(2), 1]
        u += known.sums[np.where(last, none, np.append(ids[1:], none)[:n]), 3]
        u += self.weights[[_index("gap:0"), _index("gap:1")]][gap.astype(int)]
        glued = ~gap & run & np.append(False, run[:-1])[:n]
        number = np.cumsum(~glued) - 1
        u += self.weights[[_index(f"run:{k}") for k in range(13)]][np.minimum(np.bincount(number, length).astype(np.int64) // 4, 12)[number]]
        taken = np.zeros(n, np.int8)
        for k in range(1, 7):
            some = np.flatnonzero((place >= k) & (taken < 2))
            some = some[word[some - k]]
            u[some] += known.sums[ids[some - k], 2]
            taken[some] += 1
        return u, end[at] - length, end[at], place

    def of_file(self, names: list[str]) -> np.ndarray:
        """What the file features add to the scores of every token of a text."""
        return self.weights[[_index(x) for x in names]].sum(axis=0)

    def unary(self, tokens: list[str], of_file: list[str]) -> np.ndarray:
        """Scores of the labels of the tokens of one line, spaces between them."""
        return self.scores([x for t in tokens for x in (" ", t)])[0] + self.of_file(of_file)

    def labels(self, u: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The best label of each token of lines that start where ``place`` is 0; an O is never followed by an I.

        A token is surely O if O in place of B or I gains whatever its neighbours are; a following I then
        becomes B, at the difference of that token's scores.
        """
        t, n = self.steps, len(u)
        out = np.zeros(n, np.int8)
        last = np.append(place[1:] == 0, True)[:n]
        then = np.append(u[1:, 1] - u[1:, 2], 0.0)[:n]
        sure = np.ones(n, bool)
        for y in (1, 2):
            won = max(0.0, *(t[a, y] - t[a, 0] for a in range(3) if t[a, y] > -1e8))
            free = won + max(0.0, *(t[y, b] - t[0, b] for b in (0, 1)))
            bound = won + t[y, 2] - t[0, 1] + max(0.0, *(t[2, c] - t[1, c] for c in range(3)))
            less = u[:, 0] - u[:, y]
            sure &= (less > free + 1e-9) & (last | (less + then > bound + 1e-9))
        after = np.append(True, sure[:-1])[:n] & (place > 0)
        alone = np.flatnonzero(~sure & after & ~last & np.append(sure[1:], False)[:n])  # between two sure ones
        out[alone] = t[0, 1] + u[alone, 1] + t[1, 0] > t[0, 0] + u[alone, 0] + t[0, 0]
        sure[alone] = True
        some = np.flatnonzero(~sure)
        if len(some):
            edge = np.flatnonzero((np.diff(some) != 1) | (place[some[1:]] == 0)) + 1
            low, high = some[np.append(0, edge)], some[np.append(edge - 1, len(some) - 1)] + 1
            _best(out, u, t, low, high, place[low] > 0, ~last[high - 1])
        return out

    def decode(self, tokens: list[str], of_file: list[str]) -> str:
        """The best labels of the tokens of one line."""
        return "".join(LABELS[k] for k in self.labels(self.unary(tokens, of_file), np.arange(len(tokens))))


def _best(out: np.ndarray, u: np.ndarray, steps: np.ndarray, low: np.ndarray, high: np.ndarray, after_o: np.ndarray, before_o: np.ndarray) -> None:
    """Viterbi over many stretches of tokens at a time, each with an O on either side or the end of the line."""
    order = np.argsort(low - high, kind="stable")  # the longest first, so that those that go on are a prefix
    low, high, after_o, before_o = low[order], high[order], after_o[order], before_o[order]
    size = high - low
    back = np.zeros((len(u), 3), np.int8)
    best = u[low] + np.where(after_o[:, None], steps[0], [0.0, 0.0, -1e9])
    for k in range(1, int(size[0])):
        n = np.searchsorted(-size, -k)  # stretches of more than k tokens
        come = best[:n, :, None] + steps
        back[low[:n] + k] = come.argmax(axis=1)
        best[:n] = come.max(axis=1) + u[low[:n] + k]
    label = (best + before_o[:, None] * steps[:, 0]).argmax(axis=1).astype(np.int8)
    for k in range(int(size[0]) - 1, -1, -1):
        n = np.searchsorted(-size, -k)
        out[low[:n] + k] = label[:n]
        label[:n] = back[low[:n] + k, label[:n]]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def train(lines: list[tuple[list[str], list[bool], str, list[str]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-4, seed: int = 11, group: int = 8) -> Model:
    """Maximum likelihood by forward-backward and AdaGrad over groups of (tokens, gaps, labels, file features)."""
    model = Model(np.zeros((1 << BITS, 3)), np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]], float))
    free = model.steps > -1e8
    seen_w, seen_s = np.full(model.weights.shape, 1e-8), np.full((3, 3), 1e-8)
    rng = np.random.default_rng(seed)
    made = []
    for tokens, gaps, y, of_file in lines:
        if tokens:
            at = features(tokens, gaps, of_file)
            made.append((np.array([i for i, f in enumerate(at) for _ in f]), np.array([x for f in at for x in f]), np.array([LABELS.index(c) for c in y])))
    for _ in range(epochs):
        order = np.argsort([len(y) + 8 * rng.random() for _, _, y in made])  # lines of like length share a group
        for low in group * rng.permutation(-(-len(order) // group)):
            some = order[low : low + group]
            size = np.array([len(made[k][2]) for k in some])
            m, n = len(some), int(size.max())
            row = np.concatenate([made[k][0] + n * j for j, k in enumerate(some)])
            at = np.concatenate([made[k][1] for k in some])
            real = np.arange(n) < size[:, None]
            u, y = np.zeros((m * n, 3)), np.zeros((m, n), np.int64)
            for c in range(3):
                u[:, c] = np.bincount(row, model.weights[at, c], m * n)
            u = u.reshape(m, n, 3)
            for j, k in enumerate(some):
                y[j, : size[j]] = made[k][2]
            fwd, bwd = np.zeros((m, n, 3)), np.zeros((m, n, 3))
            fwd[:, 0] = u[:, 0] + np.array([0, 0, -1e9])
            for i in range(1, n):
                fwd[:, i] = np.where(real[:, i, None], _log_sum(fwd[:, i - 1, :, None] + model.steps, 1) + u[:, i], fwd[:, i - 1])
            for i in range(n - 2, -1, -1):
                bwd[:, i] = np.where(real[:, i + 1, None], _log_sum(model.steps + (u[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), 0.0)
            total = _log_sum(fwd[:, -1], 1)
            p = np.exp(fwd + bwd - total[:, None, None])
            pair = np.exp(fwd[:, :-1, :, None] + model.steps + (u[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None])
            g = pair[real[:, 1:]].sum(axis=0)
            np.subtract.at(g, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
            g[~free] = 0
            seen_s += g * g
            model.steps[free] -= (rate * g / np.sqrt(seen_s))[free]
            d = p - np.eye(3)[y]
            d[~real] = 0
            d = d.reshape(m * n, 3)
            used, where = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(where, d[row, c], len(used)) for c in range(3)], axis=1) + l2 * model.weights[used]
            seen_w[used] += grad * grad
            model.weights[used] -= rate * grad / np.sqrt(seen_w[used])
    return model


def window(text: str, start: int, end: int, reach: int = 120) -> tuple[int, int]:
    """The part of the line around a span that a training window holds, cut at spaces."""
    low, high = text.rfind("\n", max(0, start - reach), start) + 1, text.find("\n", end, end + reach)
    if not low:
        low = max(0, start - reach)
        low = 0 if not low else (text.find(" ", low, start) + 1 or start)
    if high < 0:
        high = min(len(text), end + reach)
        high = high if high == len(text) else max(end, text.rfind(" ", end, high))
    return low, high


def segments(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Training windows around the places; windows that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(places):
        low, high = window(text, s, e)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def values(text: str) -> list[tuple[int, int]]:
    """Places of the base matches without the words that introduce them."""
    return [_ASSIGN.match(text, s, e).span(2) if k == "assign" else (s, e) for k, s, e in base_spans(text)]


def _tokens(text: str, low: int, high: int) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    """Tokens of a part of a text, whether white space or nothing is before them, and their places."""
    found = [(m[0], m.span()) for m in _PIECE.finditer(text, low, high) if m[0][0] > " "]
    ends = [low - 1, *(e for _, (_, e) in found)]
    return [t for t, _ in found], [s != e for (_, (s, _)), e in zip(found, ends, strict=False)], [s for _, s in found]


def _labels(places: list[tuple[int, int]], gaps: list[bool], spans: list[tuple[int, int]]) -> str:
    out = ""
    for (s, e), gap in zip(places, gaps, strict=True):
        if not any(a <= s and e <= b for a, b in spans):
            out += "O"
        else:
            out += "I" if out and out[-1] != "O" and not gap else "B"
    return out


def _doubtful(tokens: list[str], labels: str) -> bool:
    """Whether a token that looks like a key stands behind a credential word but no base pattern took it."""
    return any(y == "O" and allowed(t) and any(w.lower() in WORDS for w in tokens[max(0, i - 3) : i]) for i, (t, y) in enumerate(zip(tokens, labels, strict=True)))


def training_lines(texts: list[str], limit: int = LINES, seed: int = 5) -> list[tuple[list[str], list[bool], str, list[str]]]:
    """Labelled windows: base matches, runs with a digit and openings of the sample, and lines made by rule.

    Windows whose label is doubtful are left out."""
    lines = []
    for text in texts:
        spans, of_file = values(text), file_features(text)
        for low, high in segments(text, [*spans, *(m.span() for m in _MAYBE.finditer(text)), (0, 0)]):
            tokens, gaps, places = _tokens(text, low, high)
            labels = _labels(places, gaps, spans)
            if len(tokens) <= 400 and len(lines) < limit and not _doubtful(tokens, labels):
                lines.append((tokens, gaps, labels, of_file))
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    make = lambda pool, n: "".join(rng.choice(list(pool), n))
    pick = lambda of: of[int(rng.integers(len(of)))]
    word = lambda: make("etaoinshrdlucm", int(rng.integers(2, 9)))
    plain = lambda: " ".join(word() for _ in range(int(rng.integers(0, 7))))
    dense = ["0123456789abcdef", "0123456789ABCDEF", letters + "0123456789", letters, letters + "0123456789+/"]
    for k in range(1600):
        low, value, cased = plain(), "", lambda w: pick([w, w.upper(), w.capitalize()])
        name = cased(pick(WORDS))
        if k % 4 == 0:  # dense values of any alphabet, also where only a space separates
            value = make(pick(dense), int(rng.integers(16, 48))) + pick(["", "", "="])
            head = name + pick([" = ", ": ", "=", " ", ' = "', ': "', ": Bearer ", ": Basic "])
        elif k % 4 == 1:  # passwords as people choose them: words, numbers, short ones, words with marks
            value = pick([word() + word() + word() + "x", make("0123456789", int(rng.integers(4, 14))), word() + make("0123456789", 2), make(letters + "0123456789", int(rng.integers(5, 12))), f"{word()}-{word()}-{word()}", f"{word()}!{make('0123456789', 3)}", make("abcdefghijklmnopqrstuvwxyz", int(rng.integers(8, 22)))])
            head = name + pick([" = ", ": ", "=", ' = "', ': "', ":"])
        elif k % 4 == 2:  # mail names, versions, dates, numbers with units, numbers and words behind other names
            head = pick([f"{make('abcdefg', 6)}{k}@mail{k % 9}.example.com", f"v{k}beta{k % 7}release", f"item{k:06d}", f"2024T{k:06d}Z", f"section{k % 40}page{k}", f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", make("0123456789", 16), f"{word()}: {word()}{word()}", f"{word()} = {rng.integers(10**9)}", f"https://{word()}.example.com/{word()}/{word()}.html", f"name{k}x@mail{k}.example.com"])
        else:  # credential words in prose
            head = f"{name} {word()} {word()}"
        quote = '"' if value and '"' in head else ""
        line = f"{low} " * bool(low) + head
        spans = [(len(line), len(line) + len(value))] if value else []
        line += f"{value}{quote} {plain()}"
        tokens, gaps, places = _tokens(line, 0, len(line))
        lines.append((tokens, gaps, _labels(places, gaps, spans), file_features(line)))
    return lines


def blocks(text: str) -> list[tuple[int, int]]:
    """Parts of whole lines that cover the text."""
    out, low = [], 0
    while low < len(text):
        high = len(text) if len(text) - low <= BLOCK else text.rfind("\n", low, low + BLOCK) + 1 or text.find("\n", low + BLOCK) + 1 or len(text)
        out.append((low, high))
        low = high
    return out


def extra_spans(texts: list[str], model: Model, base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """For each text, the spans tagged by the field that no base span overlaps.

    Parts of many texts are scored and decoded at a time, with line ends between them.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    files = np.stack([model.of_file(file_features(t)) for t in texts]) if texts else np.zeros((0, 3))
    parts = [(i, low, high) for i, t in enumerate(texts) for low, high in blocks(t)]
    held, first = 0, 0
    for k, (_, low, high) in enumerate(parts):
        held += high - low
        if held < BLOCK and k + 1 < len(parts):
            continue
        some = parts[first : k + 1]
        owner, lows = np.array([i for i, _, _ in some]), np.array([low for _, low, _ in some])
        begin = np.cumsum([0, *(high - low + 1 for _, low, high in some[:-1])])
        u, starts, ends, place = model.scores(_PIECE.findall("\n".join(texts[i][low:high] for i, low, high in some)))
        part = np.searchsorted(begin, starts, "right") - 1
        labels = model.labels(u + files[owner[part]], place)
        found = np.flatnonzero(labels)
        shift = (lows - begin)[part[found]]
        for y, i, s, e in zip(labels[found].tolist(), owner[part[found]].tolist(), (starts[found] + shift).tolist(), (ends[found] + shift).tolist(), strict=True):
            spans = out[i]
            if y == 2 and spans and spans[-1][2] == s:
                spans[-1] = ("crf", spans[-1][1], e)
            else:
                spans.append(("crf", s, e))
        held, first = 0, k + 1
    return [apart(x, b) for x, b in zip(out, base, strict=True)]


def apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of ``base``, which is sorted by start."""
    if not spans or not base:
        return spans
    begin, reach = [a for _, a, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    return [x for x in spans if not (n := bisect.bisect_left(begin, x[2])) or reach[n - 1] <= x[1]]


def _sample(docs: DataFrame, rows: int, chars: int) -> list[str]:
    """Texts of a bounded sample by the order of a hash: half with a base match, half with another run that holds a digit."""
    text = F.col("text").cast("string")
    rows_ = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text")).filter(F.length("text") <= chars)
    share = min(1.0, 20 * rows / max(docs.count(), 1))
    rows_ = rows_.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    match = F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    other = F.col("text").rlike(r"[0-9]")
    rows_ = rows_.withColumn("_kind", F.when(match, 0).when(other, 1)).filter("_kind is not null").withColumn("_order", F.xxhash64("doc_id", "text"))
    found = [r for kind in (0, 1) for r in rows_.filter(F.col("_kind") == kind).orderBy("_order", "doc_id").limit(rows // 2).collect()]
    return [r["text"] for r in found]


def scan(docs: DataFrame, sample_rows: int = 1500, sample_chars: int = 20_000) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) for every row of ``docs``.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans.  The field is trained
    on up to ``sample_rows`` documents of up to ``sample_chars`` characters, labelled by the base patterns
    and chosen by a hash, and on lines made by rule; it tags whole texts of any length.  Repeated rows get
    equal results; only doc_id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(training_lines(_sample(docs, sample_rows, sample_chars))))
    order = (*KINDS, "crf").index

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        bases = [base_spans(t) for t in texts]
        rows = []
        for base, extra in zip(bases, extra_spans(texts, model.value, bases), strict=True):
            n = Counter(k for k, _, _ in base)
            spans = sorted([*base, *extra], key=lambda x: (x[1], order(x[0])))
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(extra)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
