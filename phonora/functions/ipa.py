"""IPA strings: segmentation, marks, vowels, grapheme clusters, tones."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
MARKS = r"[\p{M}\p{Lm}\p{Sm}\p{Sk}]"
TIE = "͡"
ZERO = "∅"
VOWELS = "aeiouyæøœɐɑɒɔɘəɚɛɜɝɞɤɨɪɯɵɶʉʊʌʏ"
TONES = "".join(map(chr, range(0xA700, 0xA720)))
REPLACEMENTS = {
    "A": "a",
    "S": "ʃ",
    "ε": "ɛ",
    "ᵻ": "ɪ̈",
    "?": "ɐ",
    "??": "ʊɐ",
    "X": "χ",
    "ʌʌ": "ʌː",
    "ɛɛ": "ɛː",
    "aːʰχ": "aʰːχ",
    "ææ": "æː",
}

#: Segments above which an alternation is slower than a trie in Python.
REGEX_SEGMENTS = 1000


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def alternation(segments: Sequence[str]) -> str:
    """A Java pattern that matches the longest of the segments."""
    found = sorted({s for s in segments if s}, key=lambda s: (-len(s), s))
    return "|".join(map(quoted, found)) if found else "(?!)"


def segment(text: Column, segments: Sequence[str], include_missing: bool = False) -> Column:
    """Leftmost-longest segments of a string; what lies between them is dropped, or kept as pieces."""
    if len(segments) > REGEX_SEGMENTS:
        return trie_segment(segments, include_missing)(text)
    one = alternation(segments)
    pattern = f"((?:{one})|(?:(?!{one}).)+)" if include_missing else f"({one})"
    return F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(1))


def trie_segment(segments: Sequence[str], include_missing: bool = False) -> Callable[[Column], Column]:
    """The same by a compiled pattern in Arrow batches, for large inventories."""
    found = sorted({s for s in segments if s}, key=lambda s: (-len(s), s))
    by_first: dict[str, list[str]] = {}
    for s in found:
        by_first.setdefault(s[0], []).append(s)
    pattern = "|".join(f"{re.escape(c)}(?:{'|'.join(re.escape(s[1:]) for s in x)})" for c, x in by_first.items()) or "(?!)"

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        find = re.compile(pattern, re.S)

        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            out, last = [], 0
            for m in find.finditer(text):
                if include_missing and m.start() > last:
                    out.append(text[last : m.start()])
                out.append(m[0])
                last = m.end()
            if include_missing and last < len(text):
                out.append(text[last:])
            return out

        return texts.map(one)

    return run


def segment_checked(text: Column, segments: Sequence[str]) -> Column:
    """Segments of a string that they cover; anything else raises an error that names the gap."""
    found = segment(text, segments)
    gaps = F.array_except(segment(text, segments, True), F.array(*map(F.lit, segments)))
    message = F.concat(F.lit("missing segment "), F.array_join(gaps, ", "), F.lit(" in "), text)
    return F.when(F.array_join(found, "") == text, found).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(message).cast("array<string>"))


def segment_words(words: Column, segments: Sequence[str], include_missing: bool = False) -> Column:
    """Segments of all words of an array, one after another."""
    return F.flatten(F.transform(words, lambda w: segment(w, segments, include_missing)))


def segment_words_checked(words: Column, segments: Sequence[str]) -> Column:
    return F.flatten(F.transform(words, lambda w: segment_checked(w, segments)))


def gaps(text: Column, segments: Sequence[str]) -> Column:
    """The pieces that no segment matches."""
    return F.filter(segment(text, segments, True), lambda p: ~p.rlike(f"^(?:{alternation(segments)})$"))


def is_mark(char: Column) -> Column:
    return char.rlike(f"^{MARKS}$")


def base(text: Column) -> Column:
    """A segment without marks and diacritics."""
    return F.regexp_replace(text, MARKS, "")


def is_vowel_only(text: Column) -> Column:
    """True also of a segment of marks alone."""
    return base(text).rlike(f"^[{VOWELS}]*$")


def complex_with_vowel(base_text: Column) -> Column:
    return (F.length(base_text) > 1) & base_text.rlike(f"[{VOWELS}]")


def is_multi_vowel(base_text: Column) -> Column:
    return base_text.rlike(f"^[{VOWELS}]{{2,}}$")


def clusters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def split_complex(text: Column) -> Column:
    """Grapheme clusters of a segment; a mark on its own joins the one before, or else the next.

    A segment of marks alone stays whole.
    """
    alone = lambda g: (F.length(g) == 1) & is_mark(g)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("prefix"))

    def step(acc: Column, g: Column) -> Column:
        out, prefix = acc["out"], acc["prefix"]
        n = F.size(out)
        last = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(out, F.greatest(n, F.lit(1))), g)))
        return (
            F.when(alone(g) & (n == 0), F.struct(out.alias("out"), F.concat(prefix, g).alias("prefix")))
            .when(alone(g), F.struct(last.alias("out"), prefix.alias("prefix")))
            .otherwise(F.struct(F.concat(out, F.array(F.concat(prefix, g))).alias("out"), F.lit("").alias("prefix")))
        )

    def end(acc: Column) -> Column:
        return F.when(acc["prefix"] != "", F.concat(acc["out"], F.array(acc["prefix"]))).otherwise(acc["out"])

    found = F.aggregate(_guard(clusters(text)), start, step, end)
    return F.when(text.isNotNull(), found)


def _guard(items: Column) -> Column:
    """An empty array for null, so that element_at in a fold is never reached for it."""
    return F.coalesce(items, F.array().cast("array<string>"))


def split_all_complex(items: Column) -> Column:
    return F.flatten(F.transform(items, split_complex))


def split_phoneme_segment(text: Column) -> Column:
    """Parts between bars, each split by clusters."""
    return F.transform(F.split(text, r"\|"), split_complex)


def is_tone(text: Column) -> Column:
    return text.rlike(f"[{TONES}]")


def without_tones(items: Column) -> Column:
    """An inventory without phonemes that hold a tone letter (the evident intent of the filter)."""
    return F.filter(items, lambda p: ~is_tone(p))


def without_ties(text: Column) -> Column:
    return F.replace(text, F.lit(TIE), F.lit(""))


def clean_phonemes(items: Column, replacements: dict[str, str] | None = None) -> Column:
    """Noise of a grapheme-to-phoneme engine: a lone ʲ joins what follows, others are replaced, ties go."""
    table = F.create_map(*[F.lit(x) for kv in (replacements or REPLACEMENTS).items() for x in kv])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, p: Column) -> Column:
        fixed = without_ties(F.coalesce(F.try_element_at(table, p), p))
        return (
            F.when(acc["held"] != "", F.struct(F.concat(acc["out"], F.array(F.concat(acc["held"], p))).alias("out"), F.lit("").alias("held")))
            .when(p == "ʲ", F.struct(acc["out"].alias("out"), p.alias("held")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(fixed)).alias("out"), F.lit("").alias("held")))
        )

    return F.aggregate(items, start, step, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))


def language_runs(text: Column, main: str) -> Column:
    """Runs (transcription, language) of a phone string with switch flags such as (en); the main language is null."""
    parts = F.regexp_extract_all(text, F.lit(r"(\(\w+\)|[^()]+)"), F.lit(1))
    start = F.struct(F.array().cast("array<struct<transcription: array<string>, language: string>>").alias("out"), F.lit(None).cast("string").alias("flag"))

    def step(acc: Column, p: Column) -> Column:
        code = F.regexp_extract(p, r"^\((\w+)\)$", 1)
        phones = F.filter(F.split(F.trim(p), r"\s+"), lambda x: x != "")
        run = F.struct(phones.alias("transcription"), acc["flag"].alias("language"))
        return (
            F.when(code != "", F.struct(acc["out"].alias("out"), F.when(code != main, code).alias("flag")))
            .when(F.size(phones) == 0, acc)
            .otherwise(F.struct(F.concat(acc["out"], F.array(run)).alias("out"), acc["flag"].alias("flag")))
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no expression for it."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def drop_zero(text: Column) -> Column:
    """Zero phonemes go, each with one space beside it."""
    return F.regexp_replace(text, f"( ?{ZERO}|{ZERO} ?)", "")


def only_punctuation(word: Column) -> Column:
    return word.rlike(r"^\p{P}*$")


def spoken_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~only_punctuation(w))
