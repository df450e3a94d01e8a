"""Grapheme-to-phoneme engines as an Arrow boundary.

An engine turns a batch of words of one language into runs of phones; engines are registered by name and
applied to a corpus together, words beside engines.
"""

from __future__ import annotations

import re
import shutil
import subprocess
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from phonora import schemas
from phonora.functions import ipa

Run = tuple[list[str], str | None]
Hook = Callable[[list[str]], list[str]]
ENGINES: dict[str, Callable[..., Engine]] = {}


class Engine(ABC):
    """One engine for one language."""

    REQUIRES_TOKENIZER = True

    def __init__(self, language: str) -> None:
        self.language = language

    @classmethod
    def supports(cls, language: str) -> bool:
        return True

    @abstractmethod
    def process(self, words: Sequence[str]) -> list[list[Run]]:
        """Runs (phones, language tag or None) of each word."""


def register(name: str) -> Callable[[type[Engine]], type[Engine]]:
    def add(cls: type[Engine]) -> type[Engine]:
        ENGINES[name] = cls
        return cls

    return add


class Rules(Engine):
    """Longest-match rewriting by a table of grapheme to phones; what no rule knows is dropped."""

    rules: Mapping[str, str] = {}

    def __init__(self, language: str, rules: Mapping[str, str] | None = None) -> None:
        super().__init__(language)
        self.table = dict(rules if rules is not None else self.rules)
        found = sorted(self.table, key=lambda g: (-len(g), g))
        self.pattern = re.compile("|".join(map(re.escape, found)) or "(?!)")

    def process(self, words: Sequence[str]) -> list[list[Run]]:
        return [[([p for m in self.pattern.finditer(w.lower()) for p in self.table[m[0]].split()], None)] for w in words]


@register("letters")
class Letters(Engine):
    """Every letter is its own phone; a baseline that supports every language."""

    def process(self, words: Sequence[str]) -> list[list[Run]]:
        return [[([c for c in w.lower() if c.isalpha()], None)] for w in words]


class Segmented(Engine):
    """An engine whose output is cut into the segments of an inventory, what is no segment being dropped.

    ``before`` rewrites the phones of a run, ``after`` the segments that were found.
    """

    def __init__(self, language: str, segments: Sequence[str], before: Hook | None = None, after: Hook | None = None) -> None:
        super().__init__(language)
        self.before, self.after = before or list, after or list
        self.pattern = re.compile("|".join(map(re.escape, sorted(set(segments), key=lambda s: (-len(s), s)))) or "(?!)")

    def cut(self, phones: Sequence[str]) -> list[str]:
        return self.after([m[0] for p in self.before(list(phones)) for m in self.pattern.finditer(p)])


def clean_phones(phones: list[str], replacements: Mapping[str, str] | None = None) -> list[str]:
    """Noise of a speech synthesiser's phones: a lone ʲ joins what follows, others are replaced, ties go."""
    table, out, rest = ipa.REPLACEMENTS if replacements is None else replacements, [], iter(phones)
    for p in rest:
        if p == "ʲ":
            p += next(rest, "")
        out.append(table.get(p, p).replace(ipa.TIE, ""))
    return out


@register("epitran")
class Epitran(Segmented):
    """Rule-based transcription by the library of that name, where it is installed.

    ``mode`` is its code of language and script; without one, the first that it offers for the language.
    """

    def __init__(self, language: str, segments: Sequence[str], tones: bool = False, mode: str | None = None, **hooks: Hook | None) -> None:
        super().__init__(language, segments, **hooks)
        from epitran import Epitran as Library

        self.library = Library(mode or self.mode_of(language), tones=tones)

    @staticmethod
    def mode_of(language: str) -> str:
        from epitran import meta

        mode = "eng-Latn" if language == "eng" else meta.get_default_mode(language)
        if mode is None:
            raise ValueError(f"no rules for {language}")
        return mode

    @classmethod
    def supports(cls, language: str) -> bool:
        try:
            cls.mode_of(language)
        except (ImportError, ValueError):
            return False
        return True

    def process(self, words: Sequence[str]) -> list[list[Run]]:
        return [[(self.cut(self.library.trans_list(w)), None)] if w else [] for w in words]


#: Tags of voices that the synthesiser spells wrongly, and the default voices of languages (fixed values).
VOICES = {"chr-US-Qaaa-x-west": "chr-Qaaa-US-x-west", "en-us-nyc": "en-us-x-nyc"}
DEFAULT_VOICES = {"fr": "fr-fr", "en": "en-us"}


@register("espeak")
class Espeak(Segmented):
    """Transcription by the eSpeak NG program, where it is installed; words of other languages carry their tag."""

    REQUIRES_TOKENIZER = False
    PROGRAM = "espeak-ng"

    def __init__(self, language: str, segments: Sequence[str], before: Hook | None = clean_phones, after: Hook | None = None) -> None:
        super().__init__(language, segments, before, after)
        self.voice = self.voice_of(language)
        if self.voice is None:
            raise ValueError(f"no voice for {language}")

    @classmethod
    def voices(cls) -> list[str]:
        """Codes of the voices, from the program's own list."""
        if shutil.which(cls.PROGRAM) is None:
            return []
        listed = subprocess.run([cls.PROGRAM, "--voices"], capture_output=True, text=True, check=True).stdout
        return [VOICES.get(x[1], x[1]) for line in listed.splitlines()[1:] if len(x := line.split()) > 1]

    @classmethod
    def voice_of(cls, language: str) -> str | None:
        voices = cls.voices()
        wanted = DEFAULT_VOICES.get(language, language)
        return wanted if wanted in voices else next((v for v in voices if v.split("-")[0] == language), None)

    @classmethod
    def supports(cls, language: str) -> bool:
        return cls.voice_of(language) is not None

    def spoken(self, text: str) -> str:
        """Phones of a text, apart by underscores, with switches of language as (xx)."""
        command = [self.PROGRAM, "-q", "--ipa", "--sep=_", "-v", str(self.voice), "--stdin"]
        return subprocess.run(command, input=text, capture_output=True, text=True, check=True).stdout

    def process(self, words: Sequence[str]) -> list[list[Run]]:
        return [self.runs(self.spoken(w)) if w else [] for w in words]

    def runs(self, spoken: str) -> list[Run]:
        """Runs of phones and their language tags, None for the main language."""
        out: list[Run] = []
        flag = None
        for part in re.split(r"(\([\w-]+\))", spoken):
            if m := re.fullmatch(r"\(([\w-]+)\)", part):
                flag = None if m[1] in (self.voice, str(self.voice).split("-")[0]) else m[1]
            elif phones := self.cut([p for p in re.split(r"[\s_]+", re.sub("[ˈˌ]", "", part)) if p]):
                out.append((phones, flag))
        return out


class ToneBackoff(Engine):
    """An engine whose tone letters are dropped where the inventory has no tones."""

    def __init__(self, language: str, inner: Engine, inventory: Sequence[str]) -> None:
        super().__init__(language)
        self.inner, self.known = inner, set(inventory)

    def process(self, words: Sequence[str]) -> list[list[Run]]:
        tone = re.compile("[˥˦˧˨˩꜀-ꜟ]")
        fix = lambda p: p if p in self.known else tone.sub("", p)
        return [[([q for p in phones if (q := fix(p))], tag) for phones, tag in runs] for runs in self.inner.process(words)]


def words_of(sentence: str) -> list[str]:
    """Tokens of a sentence without those of punctuation alone."""
    return [w for w in re.findall(r"\w[\w'’-]*", sentence)]


def transcribe(df: DataFrame, engines: Sequence[Callable[[str], Engine]], sentence: str = "raw_sentence", language: str = "lang") -> DataFrame:
    """``df`` plus phonemes struct(words, phonemes): per engine the runs of the whole sentence.

    Engines are made once per language in each task; batches stay in Arrow.
    """
    made: dict = {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            column = [None] * len(part)
            for lang, group in part.reset_index(drop=True).groupby(language, dropna=False):
                found = made.setdefault(lang, [e(lang) for e in engines])
                words = [words_of(s or "") for s in group[sentence]]
                flat = [w for ws in words for w in ws]
                results = [e.process(flat) for e in found]
                at = 0
                for i, ws in zip(group.index, words, strict=True):
                    runs = [_joined([r for x in result[at : at + len(ws)] for r in x]) for result in results]
                    column[i] = {"words": ws, "phonemes": [[{"transcription": p, "language": t} for p, t in rs] for rs in runs]}
                    at += len(ws)
            yield part.assign(phonemes=column)

    schema = df.limit(0).selectExpr("*", f"cast(null as {schemas.PHONEMES}) as phonemes").schema
    return df.mapInPandas(run, schema)


def _joined(runs: list[Run]) -> list[Run]:
    """Neighbouring runs of one tag as one."""
    out: list[Run] = []
    for phones, tag in runs:
        if out and out[-1][1] == tag:
            out[-1] = (out[-1][0] + phones, tag)
        else:
            out.append((list(phones), tag))
    return out


def supported(language: str, names: Sequence[str] | None = None) -> list[str]:
    return [n for n, e in ENGINES.items() if (names is None or n in names) and e.supports(language)]
