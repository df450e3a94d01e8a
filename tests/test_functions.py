from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phonora.functions import codes, edit, ipa, numeric, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("x")).first()["x"]


def test_segments(spark):
    words = ["test", "te", "tool"]
    t = F.col("t")
    assert one(spark, ipa.segment(t, words), t="atoolbtestattet") == ["tool", "test", "te"]
    assert one(spark, ipa.segment(t, words, True), t="atoolbtestattet") == ["a", "tool", "b", "test", "at", "te", "t"]
    assert one(spark, ipa.trie_segment(words, True)(t), t="atoolbtestattet") == ["a", "tool", "b", "test", "at", "te", "t"]
    assert one(spark, ipa.segment(t, words), t="") == []
    assert one(spark, ipa.segment(t, words), t="xyz") == []
    assert one(spark, ipa.segment_checked(t, words), t="testtoolte") == ["test", "tool", "te"]
    assert one(spark, ipa.gaps(t, words), t="atoolb") == ["a", "b"]
    with pytest.raises(Exception, match="missing segment"):
        one(spark, ipa.segment_checked(t, words), t="atoolbtestatte")
    assert one(spark, ipa.segment_words(F.array(t, t), words), t="tetool") == ["te", "tool", "te", "tool"]


@pytest.mark.parametrize(("segment", "parts", "base"), [("ai̯", ["a", "i̯"], "ai"), ("t̠ʃ", ["t̠", "ʃ"], "tʃ"), ("aʰ", ["aʰ"], "a"), ("ʰa", ["ʰa"], "a"), ("˥˩", ["˥˩"], ""), ("", [], "")])
def test_complex_segments(spark, segment, parts, base):
    assert one(spark, ipa.split_complex(F.col("t")), t=segment) == parts
    assert one(spark, ipa.base(F.col("t")), t=segment) == base


def test_vowels_tones_and_cleaning(spark):
    t = F.col("t")
    assert one(spark, ipa.is_vowel_only(t), t="aːi̯") is True
    assert one(spark, ipa.is_vowel_only(t), t="ːʰ") is True
    assert one(spark, ipa.is_multi_vowel(t), t="ai") is True
    assert one(spark, ipa.is_multi_vowel(t), t="a") is False
    assert one(spark, ipa.complex_with_vowel(t), t="ta") is True
    assert one(spark, ipa.without_tones(F.array(t, F.lit("ꜛ"))), t="a") == ["a"]
    assert one(spark, ipa.clean_phonemes(F.array(F.lit("ʲ"), t, F.lit("S"), F.lit("t͡s"))), t="a") == ["ʲa", "ʃ", "ts"]
    assert one(spark, ipa.drop_zero(t), t="a ∅ b") == "a b"
    assert one(spark, ipa.drop_zero(t), t="∅") == ""
    assert one(spark, ipa.nfc(t), t="ç") == "ç"
    runs = one(spark, ipa.language_runs(t, "de"), t="(en) h ə (de) h a l o")
    assert [(r["transcription"], r["language"]) for r in runs] == [(["h", "ə"], "en"), (["h", "a", "l", "o"], None)]
    assert one(spark, ipa.spoken_words(F.array(t, F.lit("?!"))), t="so") == ["so"]


VECTORS = [("a b c", "a c", (0, 1, 0, 2)), ("a c", "a b c", (1, 0, 0, 2)), ("a b", "b a", (0, 0, 2, 0)), ("", "a b", (2, 0, 0, 0)), ("a b", "", (0, 2, 0, 0)), ("a b c d", "a b x d", (0, 0, 1, 3)), ("k i t t e n", "s i t t i n g", (1, 0, 2, 4)), ("a b a b", "b a b a", (1, 1, 0, 3))]


def test_edit_statistics(spark):
    rng = random.Random(1)
    rows = [(a.split(), b.split()) for a, b, _ in VECTORS] + [(rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r for r in df.select("i", edit.statistics("a", "b").alias("s"), edit.distance("a", "b").alias("d"), edit.total_cost("a", "b").alias("c")).collect()}
    for i, (_, _, want) in enumerate(VECTORS):
        assert tuple(got[i]["s"]) == want
    for i, (a, b) in enumerate(rows):
        s = got[i]["s"]
        assert tuple(s) == edit.counts(edit.cost_matrix(a, b))
        assert s["substitutions"] + s["deletions"] + s["correct"] == len(a)
        assert s["insertions"] + s["substitutions"] + s["correct"] == len(b)
        assert got[i]["d"] == got[i]["c"]


def test_distance_of_many_tokens_and_of_nulls(spark):
    many = [f"w{i}" for i in range(60_000)]
    rows = [(1, many, [*many[:10], "x", *many[12:]]), (2, ["a", None, "b"], ["a", "b"]), (3, [None], [None]), (4, None, ["a"]), (5, ["\ud7ff", "b"], ["b"])]
    df = spark.createDataFrame(rows[:1] + rows[1:4], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["d"] for r in df.filter("i > 1").select("i", edit.distance("a", "b").alias("d")).collect()}
    assert got == {2: 1, 3: 0, 4: None}
    # 40,000 different tokens, past the surrogates, against a short array
    wide = spark.createDataFrame([(many[:40_000], many[39_990:40_000])], "a array<string>, b array<string>")
    assert wide.select(edit.distance("a", "b")).first()[0] == 39_990


def test_long_statistics_are_those_of_short_ones(spark):
    rng = random.Random(4)
    rows = [(i, rng.choices("abc", k=rng.randint(0, 12)), rng.choices("abc", k=rng.randint(0, 12))) for i in range(80)] + [(90, None, ["a"]), (91, ["a"] * 300, ["b"] + ["a"] * 299)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    short = {r["i"]: r["s"] for r in df.filter("i < 91").select("i", edit.statistics("a", "b").alias("s")).collect()}
    mixed = {r["i"]: r["s"] for r in df.select("i", edit.any_statistics("a", "b", cells=20).alias("s")).collect()}
    assert {k: v for k, v in mixed.items() if k < 91} == short and tuple(mixed[91]) == (0, 0, 1, 299)


def test_edit_operations_apply(spark):
    df = spark.createDataFrame([(a.split(), b.split()) for a, b, _ in VECTORS] + [(None, ["a"])], "a array<string>, b array<string>")
    for row, (_, _, n) in zip(edit.operations(df, "a", "b").collect(), [*VECTORS, (0, 0, None)], strict=True):
        if n is None:
            assert row["edits"] is None
        else:
            assert [sum(e["action"] == k for e in row["edits"]) for k in range(3)] == list(n[:3])
            assert row["edits_cost"] == sum(n[:3])
    assert edit.matrix(df, "a", "b").first()["costs"][-1][-1] == 1.0


def test_weighted_statistics(spark):
    table = {"a": (1, 0), "b": (1, 1), "c": (0, 1)}
    df = spark.createDataFrame([(["a", "b"], ["c", "b"])], "a array<string>, b array<string>")
    row = edit.weighted_statistics(df, "a", "b", table, 1.5, 1.5).first()["edits"]
    assert row["substitutions"] == 1 and row["correct"] == 1


def test_rates(spark):
    df = spark.createDataFrame([(6644, 1562, 21717, 43343), (6, 36, 63, 72), (2, 0, 0, 0)], "insertions long, deletions long, substitutions long, correct long")
    got = [r[0] for r in df.select(edit.word_error_rate(F.struct("*"), "float")).collect()]
    assert got[0] == pytest.approx(0.4491459131240845, abs=1e-9) and got[1] == pytest.approx(0.6140350699424744, abs=1e-9) and got[2] is None
    assert one(spark, edit.action_name(F.col("c")), c=2) == "substitution"
    with pytest.raises(Exception, match="no action"):
        one(spark, edit.action_name(F.col("c")), c=3)


def test_numbers(spark):
    n = F.col("n")
    assert [one(spark, numeric.next_power_of_two(n), n=k) for k in (0, 1, 2, 3, 4, 5, 1024, 1025)] == [1, 1, 2, 4, 4, 8, 1024, 2048]
    assert one(spark, numeric.frame_count(n, 160), n=1600) == 11
    assert one(spark, numeric.ms_to_samples(n, 16000), n=25) == 400
    assert numeric.padding(3) == (1, 1) and numeric.padding(4, 2) == (2, 3) and numeric.padding(2, stft=True) == (1, 0)
    assert one(spark, numeric.reflect_pad(F.array(F.lit(1), F.lit(2), n), 2, 1), n=3) == [3, 2, 1, 2, 3, 2]
    assert one(spark, numeric.length_mask(n, 4), n=2) == [True, True, False, False]
    assert sum(map(lambda x: 2.718281828459045**x, one(spark, numeric.log_softmax(F.array(F.lit(0.5), n.cast("double"))), n=3))) == pytest.approx(1)
    assert one(spark, numeric.hamming(F.array(F.lit(None).cast("int"), n), F.array(F.lit(None).cast("int"), F.lit(1))), n=2) == 1
    with pytest.raises(Exception, match="divisible"):
        one(spark, numeric.split_batch_size(n, 4), n=6)


def test_codes_and_text(spark):
    t = F.col("t")
    assert one(spark, codes.alpha3(t), t="ga-IE") == "gle"
    assert one(spark, codes.macro(t), t="cmn") == "zho"
    assert one(spark, codes.alpha3(t), t="zu") == "zul" and one(spark, codes.alpha3(t), t="qq") is None
    assert one(spark, codes.macro(t, {"abc": "xyz"}), t="abc") == "xyz"
    assert one(spark, codes.standardised(t), t="eng_latn_us") == "en-Latn-US" and one(spark, codes.standardised(t, True), t="cmn-hans") == "zh-Hans"
    assert one(spark, codes.variant(t), t="ca-ES-valencia") == "ES-valencia" and one(spark, codes.variant(t), t="ca") is None
    assert one(spark, text.without_extension(t), t="clips/a.b.mp3") == "clips/a.b"
    assert one(spark, text.null_if_empty(t), t="") is None
    assert one(spark, text.parsed(t, "{split}_transcriptions.bin"), t="dev_transcriptions.bin")["split"] == "dev"
    offered = codes.code_map(spark, ["zh-TW", "en-us", "en-gb"], {"en": "en-us"})
    asked = spark.createDataFrame([("en",), ("cmn",), ("xx",), ("en-gb",)], "c string")
    assert {r["c"]: r["resolved"] for r in codes.resolve(asked, "c", offered).collect()} == {"en": "en-us", "cmn": "zh-TW", "xx": None, "en-gb": "en-gb"}


def test_resampled_lengths_of_whole_samples(spark):
    n = F.col("id")  # hardly any duration is a double, but all signals have whole samples
    for rate, target in ((8000, 16000), (44100, 16000), (22050, 48000), (49, 7)):
        wrong = numeric.resampled_length(n / F.lit(float(rate)), F.lit(rate), target) != F.expr(f"(id * {target} + {rate - 1}) div {rate}")
        assert spark.range(1, 20000).filter(wrong).count() == 0
    assert one(spark, numeric.resampled_length(F.col("s"), F.lit(10), 10), s=0.51) == 6  # of a duration between two samples the rest counts
