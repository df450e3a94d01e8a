"""Contours, paths, JSON keys and other string helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def contour(value: Column) -> Column:
    return F.split(value, ",")


def first_of_contour(value: Column) -> Column:
    return F.get(contour(value), F.lit(0))


def encoded(items: Column, vocabulary: Column) -> Column:
    """Positions of the items in a sorted vocabulary array; an item that is not in it is null."""
    return F.transform(items, lambda v: F.nullif(F.array_position(vocabulary, v), F.lit(0)) - 1)


def allophone_list(value: Column) -> Column:
    return F.split(value, " ")


def null_if_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def without_extension(path: Column) -> Column:
    """A path without its last extension; a leading dot is none."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def audio_path(base: str, language: Column, utterance: Column, extension: str = "wav") -> Column:
    return F.concat(F.concat_ws("/", F.lit(base), language, F.lit("audio"), utterance), F.lit(f".{extension}"))


def format_parser(pattern: str) -> tuple[str, list[str]]:
    """The regular expression, and names of the groups, that read back what a format string wrote."""
    names: list[str] = []
    out, last = "", 0
    for m in re.finditer(r"\{(\w+)\}", pattern):
        names.append(m[1])
        out += re.escape(pattern[last : m.start()]) + "(.+)"
        last = m.end()
    return f"^{out}{re.escape(pattern[last:])}$", names


def parsed(value: Column, pattern: str) -> Column:
    """struct of the fields of a format string; null where the value does not fit."""
    expression, names = format_parser(pattern)
    fields = [F.regexp_extract(value, expression, i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(value.rlike(expression), F.struct(*fields))
