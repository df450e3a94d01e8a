from __future__ import annotations

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonora import sinks, sources, streaming
from phonora.functions import g2p
from phonora.operators import corpus
from phonora.plans import runs

HEADER = "client_id\tpath\tsentence\tup_votes\tdown_votes\tage\tgender\taccents\tlocale\tsegment\n"


def clip(name, up, down, sentence="ein \"Satz", tail="\t\t\tde\t"):
    return f"c\t{name}.mp3\t{sentence}\t{up}\t{down}{tail}\n"


@pytest.fixture
def clips(tmp_path):
    for lang in ("de", "eu"):
        d = tmp_path / "cv" / lang
        d.mkdir(parents=True)
        (d / "train.tsv").write_text(HEADER + "".join(clip(f"t{i}", 2, 0) for i in range(3)))
        (d / "dev.tsv").write_text(HEADER + "".join(clip(f"d{i}", 2, 0) for i in range(4)))
        (d / "test.tsv").write_text(HEADER + clip("x", 2, 0))
        (d / "other.tsv").write_text(HEADER + "".join(clip(f"o{n}", n, 0) for n in range(3)))
    return str(tmp_path / "cv")


def test_clips(spark, clips):
    rows = sources.read_splits(spark, clips, include_other=True, validation_limit=2)
    got = sorted((r["lang"], r["split"], r["utterance_id"]) for r in rows.filter("lang = 'de'").collect())
    assert got == [("de", "dev", "d0"), ("de", "dev", "d1"), ("de", "test", "x"), ("de", "train", "o2"), ("de", "train", "t0"), ("de", "train", "t1"), ("de", "train", "t2")]
    row = rows.first()
    assert row["raw_sentence"] == 'ein "Satz' and row["age"] is None
    # the limit counts raw rows, before the filter
    assert sources.read_clips(spark, clips, ["other"], ["de"], limit=2, filters={"other": corpus.positive_score()}).count() == 0
    with pytest.raises(KeyError):
        sources.read_splits(spark, clips, languages=["qq"])


def test_wrong_arity_is_an_error(spark, tmp_path):
    d = tmp_path / "cv" / "de"
    d.mkdir(parents=True)
    (d / "train.tsv").write_text(HEADER + "only\ttwo\n")
    with pytest.raises(Exception):
        sources.read_clips(spark, str(tmp_path / "cv"), ["train"]).collect()


def test_field_recordings(spark, tmp_path):
    d = tmp_path / "f" / "abk"
    d.mkdir(parents=True)
    (d / "inventory").write_text("b 3\na 5\n")
    (d / "raw").write_text("u1 aba\nu2 b\n")
    (d / "text").write_text("u1 a b a\nu2 \n")
    rows, inventories = sources.read_field_recordings(spark, str(tmp_path / "f"))
    got = {r["utterance_id"]: (r["raw"], r["phonemes"]) for r in rows.collect()}
    assert got == {"u1": ("aba", ["a", "b", "a"]), "u2": ("b", [])}
    assert inventories.first()["phonemes"] == ["a", "b"]
    (d / "text").write_text("u9 a b a\nu2 b\n")
    with pytest.raises(Exception, match="ids differ"):
        sources.read_field_recordings(spark, str(tmp_path / "f"))[0].collect()


def test_feature_table_and_evaluation(spark, tmp_path):
    names = "InventoryID,Glottocode,ISO6393,SpecificDialect,Phoneme,Allophones,Marginal,SegmentClass,Source,tone,high"
    path = tmp_path / "t.csv"
    path.write_text(f'{names}\n1,g,aaa,,a,a,FALSE,vowel,S,0,-\n1,g,aaa,,ai,ai,FALSE,odd,S,0,"-,+"\n')
    for table in (sources.read_feature_table(spark, str(path)), sources.feature_table_from_text(spark, path.read_text())):
        row = table.filter("Phoneme = 'ai'").first()
        assert row["InventoryID"] == 1 and row["SegmentClass"] is None and row["high"] == "-,+" and row["SpecificDialect"] is None
    meta = {"prediction_arguments": "x", "classifiers": ["phone"], "languages": ["xx"]}
    rows = spark.createDataFrame([("xx", "u1", {"phone": [["a"]], "high": [["-"]]}, [["ai"]])], "language string, utterance_id string, predictions map<string, array<array<string>>>, labels array<array<string>>")
    for gzip in (False, True):
        out = str(tmp_path / f"p{gzip}")
        sinks.write_json_lines(rows, meta, out, gzip)
        head, body = sources.read_predictions(spark, out)
        assert head.first()["classifiers"] == ["phone"] and body.first()["labels"] == [["ai"]] and body.count() == 1
    rated = runs.evaluate_file(spark, str(tmp_path / "pTrue"), table, ["high"], str(tmp_path / "r"))
    got = {(r["language"], r["classifier"]): r["error_rate"] for r in rated.collect()}
    assert got["xx", "phone"] == 1.0 and got["total", "high"] == 0.5
    again = {(r["language"], r["classifier"]): r["error_rate"] for r in sources.read_results(spark, str(tmp_path / "r")).collect()}
    assert again == got
    runs.edits_file(spark, str(tmp_path / "pFalse"), table, ["high"], str(tmp_path / "e"))
    edits = sources.read_edits(spark, str(tmp_path / "e"))[1].first()["edit_operations"]
    assert [tuple(x) for x in edits["phone"]] == [(2, "ai", "a")]
    runs.extract_features(spark, str(path), str(tmp_path / "f.csv"))
    assert spark.read.csv(str(tmp_path / "f.csv"), header=True).count() == 2


def test_release_meta_and_config(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "v", "date": "2022-01-02", "unknown": 1, "locales": {"de": {"clips": 3, "validHrs": None, "buckets": {"train": 2}}}}))
    row = sources.locales(sources.read_release_meta(spark, str(tmp_path / "m.json"))).first()
    assert row["locale"] == "de" and row["clips"] == 3 and row["buckets"]["train"] == 2 and str(row["date"]) == "2022-01-02"
    (tmp_path / "c.toml").write_text("[data]\nlimit = 3\n")
    assert sources.load_config(spark, str(tmp_path / "c.toml")) == {"data": {"limit": 3}}
    (tmp_path / "i.json").write_text(json.dumps({"de": ["b", "a"]}))
    assert sources.read_inventories(spark, str(tmp_path / "i.json")).first()["phonemes"] == ["a", "b"]
    assert corpus.parse_limits('{"de": 2}') == {"de": 2} and corpus.parse_limits("5") == 5 and corpus.parse_limits("") is None


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        x = (np.sin(np.arange(800) / 5) * 20000).astype(np.int16)
        f.writeframes(np.column_stack([x, x]).tobytes())
    row = sources.features_of(sources.read_audio(spark, str(tmp_path), 16000)).first()
    assert (row["sample_rate"], row["num_samples"]) == (16000, 1600) and len(row["features"][0]) == 40 and len(row["features"]) == 11
    info = sources.read_audio_info(spark, str(tmp_path)).first()
    assert tuple(info)[1:] == (8000, 2, 16, 800)
    for kind in ("filterbanks", "mfcc"):
        made = np.array(sources.features_of(sources.read_audio(spark, str(tmp_path), 16000), 13, kind).first()["features"])
        assert made.shape == (11, 13) and np.allclose(made.mean(axis=0), 0, atol=1e-4)


def test_resampling_keeps_tones_and_drops_what_does_not_fit():
    t = np.arange(16000) / 16000
    low, high = np.sin(2 * np.pi * 500 * t), np.sin(2 * np.pi * 6000 * t)
    down = sources.resample((low + high).astype(np.float32), 16000, 8000)
    want = np.sin(2 * np.pi * 500 * np.arange(8000) / 8000)
    assert len(down) == 8000 and np.abs(down - want)[100:-100].max() < 0.05
    up = sources.resample(want.astype(np.float32), 8000, 11025)
    assert len(up) == 11025 and np.abs(up - np.sin(2 * np.pi * 500 * np.arange(11025) / 11025))[100:-100].max() < 0.05


def test_cosine_transform_is_orthonormal():
    x = np.random.default_rng(1).normal(size=4000).astype(np.float32)
    whole = sources.mfcc(x, 16000, 30, bands=30)
    power = 10 * np.log10(np.maximum(sources.mel_power(x, 16000, 30), 1e-10))
    assert np.allclose((whole**2).sum(axis=1), (np.maximum(power, power.max() - 80) ** 2).sum(axis=1))


def test_rows_are_numbered_as_in_the_file(spark, tmp_path):
    d = tmp_path / "cv" / "de"
    d.mkdir(parents=True)
    (d / "train.tsv").write_text(HEADER + "".join(clip(f"t{i}", 2, 0, tail="\t\t\t\tde\t") for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        rows = sources.read_clips(spark, str(tmp_path / "cv"), ["train"])
        assert rows.rdd.getNumPartitions() > 1
        assert all(r["path"] == f"t{r['pos']}.mp3" for r in rows.select("path", "pos").collect())
        few = sources.read_clips(spark, str(tmp_path / "cv"), ["train"], limit=700)
        assert sorted(r["pos"] for r in few.collect()) == list(range(700))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_default_configuration(spark, tmp_path, capsys):
    from phonora.__main__ import main

    main(["config"])
    assert capsys.readouterr().out == sources.DEFAULT_CONFIG
    main(["config", str(tmp_path / "c.toml")])
    assert sources.load_config(spark, str(tmp_path / "c.toml"))["preprocessing"]["sample_rate"] == 16000
    with pytest.raises(FileExistsError):
        main(["config", str(tmp_path / "c.toml")])


def test_release_meta_over_http(spark):
    import http.server
    import threading

    class Reply(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"name": "v", "locales": {"de": {"clips": 3}}}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Reply)
    threading.Thread(target=server.handle_request, daemon=True).start()
    row = sources.locales(sources.read_release_meta(spark, f"http://127.0.0.1:{server.server_port}/m.json")).first()
    server.server_close()
    assert row["locale"] == "de" and row["clips"] == 3


def test_engines(tmp_path, monkeypatch):
    assert g2p.clean_phones(["ʲ", "a", "S", "t͡s", "ʲ"]) == ["ʲa", "ʃ", "ts", "ʲ"]
    fake = tmp_path / "espeak-ng"
    fake.write_text("#!/bin/sh\nif [ \"$1\" = --voices ]; then printf 'Pty Language\\n 5 de --/M German x\\n 5 en-us --/M English y\\n'; else printf ' h_ˈa_l_oː (en)_j_ɛ_s_(de)_n_t͡s'; fi\n")
    fake.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert g2p.Espeak.supports("de") and g2p.Espeak.voice_of("en") == "en-us" and not g2p.Espeak.supports("fr")
    engine = g2p.Espeak("de", ["h", "a", "l", "oː", "j", "ɛ", "s", "n", "ts"])
    assert engine.process(["hallo"]) == [[(["h", "a", "l", "oː"], None), (["j", "ɛ", "s"], "en"), (["n", "ts"], None)]]
    loud = g2p.Espeak("de", ["h", "a"], before=None, after=lambda s: [x.upper() for x in s])
    assert loud.process(["hallo"]) == [[(["H", "A"], None)]]
    monkeypatch.setenv("PATH", "")
    assert not g2p.Espeak.supports("de") and g2p.Epitran.supports("de") in (False, True)


def test_transcribe_predict_decode(spark, tmp_path):
    rows = spark.createDataFrame([("de", "Da, ja!"), ("de", None)], "lang string, raw_sentence string")
    spoken, inventories = runs.transcribe(rows, [g2p.Letters])
    got = sorted(spoken.collect(), key=lambda r: r["raw_sentence"] is None)
    assert got[0]["phonemes"]["words"] == ["Da", "ja"] and got[0]["phonemes"]["phonemes"][0][0]["transcription"] == list("daja")
    assert inventories.first()["phonemes"] == ["a", "d", "j"]
    target = spark.createDataFrame([(0, 0, "a", ["0", "0"]), (1, 1, "t", ["1", "1"])], "pos int, idx int, phoneme string, features array<string>")
    known = spark.createDataFrame([("a", ["0", "0"]), ("d", ["1", "1"]), ("j", ["1", "0"])], "phoneme string, features array<string>")
    mapped, image = runs.transcribe(rows.filter("raw_sentence is not null"), [g2p.Letters], target, known)
    assert mapped.first()["phonemes"]["phonemes"][0][0]["transcription"] == ["t", "a", "a", "a"] and image.first()["phonemes"] == ["a", "t"]
    feats = spark.createDataFrame([("de", "u", [[1.0], [0.0]])], "lang string, utterance_id string, features array<array<double>>")
    out = runs.predict(feats, lambda batch: [[[-5.0, -0.1] if f[0] else [-0.1, -5.0] for f in x] for x in batch])
    assert runs.decode(out, ["_", "a"]).first()["candidates"] == [["a"]]
    assert runs.decode(out, ["_", "a"], width=3, n_best=2).first()["candidates"][0] == ["a"]


def test_lengths_and_statistics(spark, tmp_path):
    rows = spark.createDataFrame([("train", "de", 0, 1.0, 8000), ("dev", "fr", 0, 2.0, 8000)], "split string, lang string, pos long, duration_s double, sample_rate int")
    sinks.write_lengths(runs.frame_lengths(rows, 16000, 160), str(tmp_path / "l"))
    got = sources.read_lengths(spark, str(tmp_path / "l"), {"train": ["de"]})
    assert [(r["lang"], r["length"]) for r in got.collect()] == [("de", 101)]
    doc = {r["split"]: json.loads(r["json"]) for r in runs.statistics(sources.read_lengths(spark, str(tmp_path / "l")), 100).collect()}
    assert doc["dev"]["fr"]["utterances"] == 1 and doc["dev"]["fr"]["total"] == 2.01


def test_streaming_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"language": "xx", "classifier": "phone", "expected": ["a", "b"], "actual": ["a"], "ts": "2024-01-01T00:00:00Z"}, {"language": "xx", "classifier": "phone", "expected": ["a"], "actual": ["a"], "ts": "2024-01-01T00:01:00Z"}]
    for i, line in enumerate(lines):
        (src / f"{i}.json").write_text(json.dumps(line) + "\n")
    q = streaming.write(streaming.running_statistics(streaming.scored_rows(spark, str(src))), str(tmp_path / "cp"), name="stats", mode="complete")
    q.awaitTermination(60)
    row = spark.table("stats").select("deletions", "correct").first()
    assert tuple(row) == (1, 2)
    assert F is not None
