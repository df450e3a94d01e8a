"""Language codes: parsing, three-letter forms, macro-languages, and a table that resolves requests."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Macro-languages and their members in ISO 639-3; others can be given as a table.
MACROS = {
    "aka": "fat twi", "ara": "arb arz apc acm ary arq ars ajp aeb acw afb ayl ayn ayp apd acq", "aze": "azj azb", "bal": "bgp bgn bcc", "bik": "bcl bln bto",
    "cre": "crk cwd csw crm crl crj", "din": "dip diw dik", "est": "ekk vro", "fas": "pes prs", "ful": "fub fuc fue fuf fuh fui fuq fuv ffm", "grn": "gug gui gun gnw nhd",
    "hbs": "hrv srp bos cnr", "hmn": "mww hnj", "iku": "ike ikt", "jrb": "yhd aju ajt", "kau": "knc kby krt", "kln": "niq oki pko spy", "kok": "gom knn", "kom": "koi kpv",
    "kon": "kng ldi kwy", "kpe": "gkp xpe", "kur": "ckb kmr sdh", "lah": "pnb skr hno", "lav": "lvs ltg", "luy": "bxk lrm", "mlg": "plt bhr skg tdx", "mon": "khk mvf",
    "msa": "ind zlm zsm min bjn jax", "nep": "npi dty", "nor": "nob nno", "oji": "ciw ojg ojb ojs", "ori": "ory spv", "orm": "gaz gax hae orc", "pus": "pbt pbu pst",
    "que": "quy quz qub quh qul qvi", "rom": "rmc rmf rml rmn rmo rmw rmy", "sqi": "als aae aat aln", "srd": "sro src sdc sdn", "swa": "swh swc", "syr": "aii cld",
    "uzb": "uzn uzs", "yid": "ydd yih", "zha": "zyb zyn", "zho": "cmn yue nan wuu hak hsn gan cdo cjy cpx czh czo mnp lzh", "zza": "diq kiu",
}
MACRO = {member: macro for macro, members in MACROS.items() for member in members.split()}
SCRIPT_SUBTAG = r"^[A-Z][a-z]{3}$"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


@cache
def two_letter() -> dict[str, str]:
    """All two-letter codes of ISO 639 with their three-letter codes, as the Java runtime knows them."""
    locale = SparkSession.active()._jvm.java.util.Locale
    return {str(c): str(locale.forLanguageTag(c).getISO3Language()) for c in locale.getISOLanguages()}


def language(code: Column) -> Column:
    """The language subtag of a code such as ga-IE or zh_TW, lower case."""
    return F.lower(F.get(F.split(code, "[-_]"), F.lit(0)))


def subtags(code: Column) -> Column:
    """struct(language, script, territory, variant) of a code; what is absent is null."""
    parts = F.slice(F.split(code, "[-_]"), 2, 10)
    pick = lambda test: F.get(F.filter(parts, test), F.lit(0))
    return F.struct(
        language(code).alias("language"),
        pick(lambda p: p.rlike(SCRIPT_SUBTAG)).alias("script"),
        pick(lambda p: p.rlike("^([A-Z]{2}|[0-9]{3})$")).alias("territory"),
        pick(lambda p: p.rlike("^[a-z0-9]{5,8}$")).alias("variant"),
    )


def alpha3(code: Column) -> Column:
    """Three-letter code; one of three letters is itself, an unknown one null."""
    lang = language(code)
    return F.coalesce(F.try_element_at(_map(two_letter()), lang), F.when(F.length(lang) == 3, lang))


def macro(code: Column, macros: dict[str, str] | None = None) -> Column:
    """Macro-language of a code, or its own three-letter code.  ``macros``: members with their macro-languages."""
    three = alpha3(code)
    return F.coalesce(F.try_element_at(_map(MACRO if macros is None else macros), three), three)


def standardised(code: Column, use_macro: bool = False) -> Column:
    """A code as language, script, territory and variants with dashes, each in its usual case, two letters where there are.

    With ``use_macro`` the language gives way to its macro-language.
    """
    shorter = {three: two for two, three in two_letter().items()}
    three = macro(code) if use_macro else alpha3(code)
    parts = F.slice(F.split(code, "[-_]"), 2, 10)
    cased = lambda p: F.when(p.rlike("^[A-Za-z]{4}$"), F.initcap(p)).when(p.rlike("^([A-Za-z]{2}|[0-9]{3})$"), F.upper(p)).otherwise(F.lower(p))
    return F.array_join(F.concat(F.array(F.coalesce(F.try_element_at(_map(shorter), three), three)), F.transform(parts, cased)), "-")


def variant(code: Column) -> Column:
    """Territory and variants of a code with dashes between; null if it has none."""
    parts = F.filter(F.slice(F.split(code, "[-_]"), 2, 10), lambda p: p.rlike("^([A-Z]{2}|[0-9]{3}|[a-z0-9]{5,8}|[0-9][a-z0-9]{3})$"))
    return F.nullif(F.array_join(parts, "-"), F.lit(""))


def code_map(spark: SparkSession, codes: Iterable[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """(code, alpha3, macro, preferred) of the codes that a corpus offers; preferred: the default of its language."""
    chosen = set((defaults or {}).values())
    offered = spark.createDataFrame([(c, c in chosen) for c in dict.fromkeys(codes)], "code string, preferred boolean")
    return offered.select("code", alpha3(F.col("code")).alias("alpha3"), macro(F.col("code")).alias("macro"), "preferred")


def resolve(requests: DataFrame, column: str, offered: DataFrame) -> DataFrame:
    """``requests`` plus ``resolved``: the code itself, else the default, else one of the language, else of its macro-language.

    What cannot be resolved is null.
    """
    offered = offered.select(F.col("code").alias("_code"), F.col("alpha3").alias("_three"), F.col("macro").alias("_macro"), "preferred")
    distinct = requests.select(F.col(column).alias("_asked")).distinct()
    asked = F.col("_asked")
    rank = F.when(asked == F.col("_code"), 0).when((alpha3(asked) == F.col("_three")) & F.col("preferred"), 1).when(alpha3(asked) == F.col("_three"), 2).otherwise(3)
    best = distinct.join(F.broadcast(offered), macro(asked) == F.col("_macro")).groupBy("_asked").agg(F.min_by("_code", F.struct(rank, F.col("_code"))).alias("resolved"))
    return requests.join(best, requests[column].eqNullSafe(F.col("_asked")), "left").drop("_asked")
