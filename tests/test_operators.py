from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from phonora.operators import corpus, evaluate, graph, inventory, nearest, remap, sequence, sets, vocabulary
from phonora.operators.graph import AttributeGraph, DependencyCycleError, Node

COLUMNS = "InventoryID int, Glottocode string, ISO6393 string, SpecificDialect string, Phoneme string, Allophones string, Marginal string, SegmentClass string, Source string, tone string, nasal string, high string"
ROWS = [
    (1, "g1", "aaa", None, "p", "p pʰ", "FALSE", "consonant", "S1", "0", "-", "0"),
    (1, "g1", "aaa", None, "a", "a", None, "vowel", "S1", "0", "-", "-"),
    (1, "g1", "aaa", None, "m", None, "TRUE", "consonant", "S1", "0", "+", "0"),
    (2, "g1", "aaa", "d", "i", "i", "FALSE", "vowel", "S1", "0", "-", "+"),
    (3, "g2", "eng", "x", "ai", "ai ∅", "FALSE", "vowel", "S2", "0", "-", "-,+"),
    (3, "g2", "eng", "x", "n", "n", "FALSE", "consonant", "S2", "0", "+", "0"),
    (4, "g2", "eng", "Western and Mid-Western US; Southern California", "n", "n", "FALSE", "consonant", "S2", "0", "+", "0"),
    (5, "g3", "cmn", None, "pʰ", "pʰ", "FALSE", "consonant", "S3", "0", "-", "0"),
]


@pytest.fixture(scope="module")
def table(spark):
    return inventory.with_row_id(spark.createDataFrame(ROWS, COLUMNS).coalesce(1)).cache()


def test_largest_inventory_and_marginals(table):
    usable = inventory.non_marginal(table)
    assert usable.count() == 7
    got = {r["ISO6393"]: (r["Source"], r["SpecificDialect"], r["n"]) for r in inventory.largest_inventories(usable).collect()}
    assert got["aaa"] == ("S1", None, 2) and got["eng"][1] == "x"
    got = {r["ISO6393"]: r["SpecificDialect"] for r in inventory.largest_inventories(usable, inventory.DEFAULT_DIALECTS).collect()}
    assert got["eng"].startswith("Western")
    chosen = inventory.largest_inventories(usable)
    rows = inventory.rows_of(table, chosen)
    assert {r["Phoneme"] for r in rows.filter("ISO6393 = 'aaa'").collect()} == {"p", "a", "m"}  # the marginal row is back


def test_extract(table):
    out = inventory.extract(table.filter("Phoneme <> 'ai'"), ["aaa", "zho"])
    got = {(r["InventoryID"], r["ISO6393"], r["phoneme"]) for r in out.collect()}
    assert got == {(1, "aaa", "p"), (1, "aaa", "a"), (1, "aaa", "m"), (5, "zho", "pʰ")}
    with pytest.raises(ValueError, match="without allophone data"):
        inventory.extract(table, ["qqq"])
    with pytest.raises(ValueError, match="without features"):
        inventory.extract(table, ["eng"])
    out = inventory.extract(table, ["aaa", "eng"], remove_zero=True, attributes=["nasal", "high"])
    assert out.columns[-3:] == ["nasal", "high", "row_id"] and "Marginal" not in out.columns
    borrowed = inventory.extract(table, ["aaa"]).filter("InventoryID = 0").collect()
    assert [(r["phoneme"], r["ISO6393"], r["Source"]) for r in borrowed] == [("pʰ", None, None)]
    assert {r["column"] for r in inventory.singleton_columns(table, ["tone", "nasal"]).collect()} == {"tone"}


def test_backfill(spark, table):
    own = inventory.rows_of(table, inventory.largest_inventories(inventory.non_marginal(table)).filter("ISO6393 = 'aaa'"))
    want = spark.createDataFrame([("aaa", "p"), ("aaa", "n")], "ISO6393 string, Phoneme string")
    got = {r["Phoneme"]: (r["InventoryID"], r["Allophones"]) for r in inventory.backfill(own, table, want).collect()}
    assert got == {"p": (1, "p pʰ"), "n": (1, "n")}


def phones(spark, rows):
    return spark.createDataFrame([(i, i, p, list(f)) for i, (p, f) in enumerate(rows)], "pos int, idx int, phoneme string, features array<string>")


def test_nearest(spark):
    target = phones(spark, [("a", "000"), ("i", "011"), ("u", "111")])
    source = phones(spark, [("a", "111"), ("e", "001"), ("ai", "001")])
    got = {r["source"]: (r["target"], r["distance"]) for r in nearest.nearest_or_same(source, target).collect()}
    assert got == {"a": ("a", 0), "e": ("a", 1), "ai": ("a", 1)}
    rows = nearest.map_inventories(source, target, phones(spark, [("a", "000"), ("i", "011")]), split_complex=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["pos"])):
        got.setdefault(r["source"], []).append(r["target"])
    assert got == {"a": ["a"], "e": ["a"], "ai": ["a", "i"]}
    same = nearest.map_inventories(source, target, threshold=1).filter("source = 'e'").first()
    assert same["target"] == "e"
    assert [r["phoneme"] for r in nearest.unmapped_targets(nearest.map_inventories(source, target), target).orderBy("phoneme").collect()] == ["i", "u"]
    ranked = nearest.k_nearest(source, target, 2).filter("source = 'e'").orderBy("rank").collect()
    assert [(r["rank"], r["target"]) for r in ranked] == [(1, "a"), (2, "i")]


def test_inventories_of_several_blocks(spark):
    import random

    rng = random.Random(3)
    target = phones(spark, [(f"t{i}", rng.choices("01", k=12)) for i in range(50)])
    source = phones(spark, [(f"s{i}", rng.choices("01", k=12)) for i in range(20)])
    plain = lambda df: sorted(map(str, df.collect()))
    for make in (nearest.closest, nearest.pairs, lambda s, t, **k: nearest.k_nearest(s, t, 7, **k)):
        assert plain(make(source, target, rows=9)) == plain(make(source, target))


def test_parts_without_features_are_an_error(spark):
    target = phones(spark, [("a", "000"), ("i", "011")])
    with pytest.raises(Exception, match="no features for o"):
        nearest.map_inventories(phones(spark, [("ao", "001")]), target, phones(spark, [("a", "000")]), split_complex=True).collect()


def test_two_phase_against_brute_force(spark):
    own = [("a", "0000"), ("b", "0011"), ("c", "1111")]
    target = [("x", "0001"), ("y", "0111"), ("z", "0110"), ("b", "1000")]
    d = lambda f, g: sum(p != q for p, q in zip(f, g, strict=True))
    best = lambda p, f, side: p if p in dict(side) else min(enumerate(side), key=lambda e: (d(f, e[1][1]), e[0]))[1][0]
    want = {p: best(p, f, target) for p, f in own}
    for p, f in sorted((t for t in target if t[0] not in want.values())):
        want[best(p, f, own)] = p
    got = {r["source"]: r["target"] for r in nearest.two_phase(phones(spark, own), phones(spark, target)).collect()}
    assert got == want


def test_lookup_and_repair(spark):
    known = phones(spark, [("a", "0"), ("ç", "1"), ("t", "1")])
    df = spark.createDataFrame([("a",), ("zz",)], "p string")
    assert {r["p"]: r["idx"] for r in nearest.indices(df, "p", known, strict=False).collect()} == {"a": 0, "zz": -1}
    with pytest.raises(Exception, match="unknown phoneme zz"):
        nearest.indices(df, "p", known).collect()
    odd = spark.createDataFrame([("ç",), ("ta",), ("q",)], "phoneme string")
    assert {r["phoneme"]: r["repaired"] for r in nearest.repair(odd, known, ["a", "t"]).collect()} == {"ç": "ç", "ta": "t", "q": None}
    wanted = spark.createDataFrame([(0, "t"), (1, "ta")], "pos int, phoneme string")
    assert [(r["idx"], r["phoneme"]) for r in nearest.subset(known, wanted, ["t", "a"]).orderBy("idx").collect()] == [(0, "t"), (1, "ta")]


def test_remap(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "id int, s array<string>")
    mapping = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "source string, pos int, target string")
    assert {r["id"]: r["s"] for r in remap.remap(df, "s", mapping).collect()} == {1: ["x", "y", "z", "c"], 2: []}
    with pytest.raises(Exception, match="no mapping for c"):
        remap.remap(df, "s", mapping, strict=True).collect()
    old, remap.MAP_ENTRIES = remap.MAP_ENTRIES, 1
    try:
        assert {r["id"]: r["s"] for r in remap.remap(df, "s", mapping).collect()} == {1: ["x", "y", "z", "c"], 2: []}
        with pytest.raises(Exception, match="no mapping for c"):
            remap.remap(df, "s", mapping, strict=True).collect()
        twice = df.union(df).union(spark.createDataFrame([(3, None)], "id int, s array<string>"))
        assert sorted((r["id"], r["s"]) for r in remap.remap(twice, "s", mapping).filter("id < 3").collect()) == [(1, ["x", "y", "z", "c"])] * 2 + [(2, [])] * 2
        assert remap.remap(twice, "s", mapping).filter("id = 3").first()["s"] is None
    finally:
        remap.MAP_ENTRIES = old
    runs = spark.createDataFrame([([[(["a"], None)]],), ([[(["a"], "en")]],), ([[(["a"], None), (["b"], None)]],)], "p array<array<struct<transcription:array<string>,language:string>>>")
    assert [r[0] for r in runs.select(remap.only_primary(F.col("p"))).collect()] == [True, False, False]
    assert [r[0] for r in runs.select(remap.flattened_primary(F.col("p")[0])).collect()] == [["a"], [], ["a", "b"]]


def test_vocabulary(spark):
    ids = vocabulary.dense_ids(spark.createDataFrame([(x,) for x in "dbcab"], "v string"), "v", 1)
    assert {r["v"]: r["id"] for r in ids.collect()} == dict(zip("abcd", range(1, 5), strict=True))
    wide = spark.createDataFrame([("p", "+", "-,+"), ("b", "-", "-")], "ph string, f string, g string")
    long = vocabulary.unpivoted(wide, ["ph"], ["f", "g"])
    cats = vocabulary.categories(long)
    assert cats.count() == 4
    coded = vocabulary.binarised(long, ["ph"], cats).withColumnRenamed("ph", "phoneme")
    seq = spark.createDataFrame([(1, ["p", "b", "p"])], "id int, s array<string>")
    got = {r["feature"]: (r["labels"], r["length"]) for r in vocabulary.labels(seq, "id", "s", coded, offset=1).collect()}
    values = {(r["feature"], r["value"]): r["cat"] + 1 for r in cats.collect()}
    plus, minus = values["g", "+"], values["g", "-"]
    assert got["g"] == ([minus, plus, minus, minus, plus], 5)
    back = vocabulary.category_values(vocabulary.labels(seq, "id", "s", coded, offset=1), cats, offset=1).filter("feature = 'g'").first()["labels"]
    assert back == ["-", "+", "-", "-", "+"]
    assert {r["feature"]: r["offset"] for r in vocabulary.category_offsets(cats).collect()} == {"f": 1, "g": 3}


def test_ctc(spark):
    frames = [0, 3, 3, 0, 3, 2, 2, 0]
    df = spark.createDataFrame([(1, t, c, 0.5) for t, c in enumerate(frames)], "u int, t int, c int, p double")
    row = sequence.ctc_greedy(df, ["u"], "t", "c", "p").first()
    assert (row["tokens"], row["timesteps"], row["score"]) == ([3, 3, 2], [2, 5, 6], 4.0)
    emissions = [[float(c == k) for k in range(4)] for c in frames]
    arr = spark.createDataFrame([(emissions, 8)], "e array<array<double>>, n int").select(sequence.ctc_greedy_array(F.col("e"), F.col("n")).alias("d")).first()["d"]
    assert (arr["tokens"], arr["timesteps"], arr["score"]) == ([3, 3, 2], [2, 5, 6], 8.0)
    import math

    sharp = [[math.log(0.97 if c == k else 0.01) for k in range(4)] for c in frames]
    assert sequence.ctc_beam(sharp, ["_", "x", "y", "z"], width=4)[0][0] == ["z", "z", "y"]


def test_beam_search_against_all_paths():
    import itertools
    import math
    import random

    rng = random.Random(2)
    for n, classes in ((1, 3), (3, 3), (5, 3), (4, 4)):
        frames = []
        for _ in range(n):
            x = [rng.random() + 0.05 for _ in range(classes)]
            frames.append([math.log(v / sum(x)) for v in x])
        sums: dict = {}
        for path in itertools.product(range(classes), repeat=n):
            key = tuple(c for c, _ in itertools.groupby(path) if c)
            sums[key] = sums.get(key, 0.0) + math.exp(sum(f[c] for f, c in zip(frames, path, strict=True)))
        want = sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))[:4]
        got = sequence.ctc_beam(frames, list("_xyz"[:classes]), width=1000, n_best=4)
        assert [t for t, _ in got] == [["_xyz"[c] for c in k] for k, _ in want]
        assert [s for _, s in got] == pytest.approx([math.log(v) for _, v in want])
    assert sequence.ctc_beam([], ["_"], 2)[0] == ([], 0.0)


def test_source_maps_are_the_two_phase_scheme(spark):
    import random

    from phonora.plans import runs

    rng = random.Random(6)
    every = phones(spark, [(f"p{i}", rng.choices("01", k=6)) for i in range(25)])
    own = {"aa": ["p3", "p7", "p20"], "bb": ["p1"], "cc": [f"p{i}" for i in range(0, 25, 2)]}
    inventories = spark.createDataFrame([(k, v) for k, v in own.items()], "lang string, phonemes array<string>")
    got = {(r["language"], r["source"]): r["target"] for r in runs.source_maps(inventories, every).collect()}
    want = {(k, r["source"]): r["target"] for k, v in own.items() for r in nearest.two_phase(every, every.filter(F.col("phoneme").isin(v))).collect()}
    assert got == want


def test_batches_and_sampling(spark):
    lengths = [5, 3, 9, 1, 1, 20, 2]
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(lengths)], "g string, i int, n int")
    got = [r["batch"] for r in sequence.frame_batches(df, ["g"], "i", "n", 10).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 4]
    first = spark.createDataFrame([("g", 0, 20), ("g", 1, 2)], "g string, i int, n int")
    assert [r["batch"] for r in sequence.frame_batches(first, ["g"], "i", "n", 10, empty_first=True).orderBy("i").collect()] == [1, 2]
    counts = spark.createDataFrame([("a", 100), ("b", 25)], "lang string, n long")
    assert {r["lang"]: r["samples"] for r in sequence.oversampling(counts).collect()} == {"a": 100, "b": 50}
    rows = spark.createDataFrame([("a", i) for i in range(8)] + [("b", i) for i in range(2)], "lang string, i int")
    drawn = sequence.oversampled(rows, "lang", ["i"]).groupBy("lang", "i").count().collect()
    assert sorted(r["count"] for r in drawn if r["lang"] == "b") == [2, 2] and all(r["count"] == 1 for r in drawn if r["lang"] == "a")
    with pytest.raises(Exception, match="no limit for b"):
        corpus.limited(rows, {"a": 1}, ["i"]).collect()
    assert sequence.islands(spark.createDataFrame([(i, v) for i, v in enumerate("aabba")], "i int, v string"), ["i"], "v").select("island").distinct().count() == 3
    assert [r["i"] for r in sequence.skip(rows.filter("lang = 'a'"), ["i"], 3, 2).collect()] == [3, 4]


def test_graph():
    g = AttributeGraph([Node("c", dependencies=("b", "OUTPUT")), Node("b", dependencies=("a", "OUTPUT_3")), Node("a"), Node("alone")])
    order = g.sort()
    assert order.index("a") < order.index("b") < order.index("c") and g.highest_layer() == 4
    assert AttributeGraph.from_json(g.to_json()).sort() == order
    with pytest.raises(DependencyCycleError):
        AttributeGraph([Node("a", dependencies=("b",)), Node("b", dependencies=("a",))]).sort()
    with pytest.raises(KeyError):
        AttributeGraph([Node("a", dependencies=("zz",))])
    assert graph.attribute_subset([{"name": "x", "dependencies": ["OUTPUT", "y"]}, {"name": "y"}]) == ["x", "y"]


def test_components_table(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5)], "src long, dst long")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert {r["node"]: r["component"] for r in graph.scc_table(edges).collect()} == want
    assert {r["node"]: r["component"] for r in graph.scc_table(edges, driver_edges=0).collect()} == want


def test_evaluate(spark):
    cats = spark.createDataFrame([("a", "high", ["-"]), ("i", "high", ["+"]), ("ai", "high", ["-", "+"])], "phoneme string, feature string, values array<string>")
    rows = [
        ("xx", "u1", {"phone": [["a", "a"], ["a", "i"]], "high": [["-", "+"]]}, [["a", "i"]]),
        ("xx", "u2", {"phone": [["a"]]}, [[]]),
        ("yy", "u3", {"phone": [["ai"]], "high": [["-"]], "unknown": [["q"]]}, [["ai"]]),
        ("yy", "u3", {"phone": [["ai"]]}, [["ai"]]),
    ]
    predictions = spark.createDataFrame(rows, "language string, utterance_id string, predictions map<string, array<array<string>>>, labels array<array<string>>")
    got = {(r["language"], r["classifier"]): (r["insertions"], r["deletions"], r["substitutions"], r["correct"]) for r in evaluate.evaluate(predictions.filter("utterance_id <> 'u3' or size(predictions) = 3"), cats).collect()}
    assert got["xx", "phone"] == (0, 0, 0, 2)  # the better candidate; the empty reference is out
    assert got["yy", "high"] == (0, 1, 0, 1) and got["total", "phone"] == (0, 0, 0, 3) and got["total", "high"] == (0, 1, 0, 3)
    edits = evaluate.utterance_edits(predictions.filter("utterance_id = 'u1'"), cats).filter("classifier = 'phone'").first()
    assert [tuple(e) for e in edits["edits"]] == [(2, "i", "a")]


def test_macro_is_the_mean_of_languages(spark):
    rated = spark.createDataFrame([("a", "phone", 0.2), ("b", "phone", 0.4), ("total", "phone", 0.9), ("a", "high", 0.1), ("b", "high", 0.3)], "language string, classifier string, error_rate double")
    got = {(r["is_phone"], r["language"], r["classifier"]): r["mean_rate"] for r in evaluate.macro_averages(rated).collect()}
    assert got[True, None, None] == pytest.approx(0.3) and got[False, "a", None] == pytest.approx(0.1) and got[False, None, "high"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        evaluate.languages_or_error(rated, ["zz"])


def test_partitions_do_not_matter(spark):
    rows = spark.createDataFrame([(i % 5, i, "abc"[i * 7 % 3], float(i % 11)) for i in range(200)], "u int, t int, c string, p double")
    results = []
    for n in (1, 7):
        df = rows.repartition(n)
        results.append((sorted(map(str, sequence.ctc_greedy(df, ["u"], "t", "c", "p", "a").collect())), sorted(map(str, inventory.first_rows(df.withColumnRenamed("t", "row_id"), "c").collect()))))
    assert results[0] == results[1]


def test_sets(spark):
    df = spark.createDataFrame([(["b", "a"], ["b", "c"])], "a array<string>, b array<string>")
    row = df.select(sets.intersection(F.col("a"), F.col("b")), sets.difference(F.col("a"), F.col("b")), sets.union(F.col("a"), F.col("b")), sets.is_subset(F.col("a"), F.col("b"))).first()
    assert list(row) == [["b"], ["a"], ["a", "b", "c"], False]
    with pytest.raises(KeyError):
        sets.missing_keys(["x"], ["y"])
    with pytest.raises(Exception, match="repeated b"):
        one = spark.createDataFrame([("a",), ("b",)], "k string")
        sets.union_unique(one, spark.createDataFrame([("b",)], "k string"), "k").collect()


def test_indexer(spark, table):
    from phonora.operators.indexer import Indexer

    rows = table.withColumnRenamed("Phoneme", "phoneme")
    x = Indexer(rows, ["tone", "nasal", "high"], ["high"], ["n", "a"])
    assert [(r["idx"], r["phoneme"], r["features"]) for r in x.subset().orderBy("idx").collect()] == [(0, "n", ["0"]), (1, "a", ["-"])]
    assert x.full().count() == 7 and x.full_of_subset().first()["features"] == ["0", "+", "0"]
    assert {(r["value"], r["cat"]) for r in x.categories().collect()} == {("+", 0), ("-", 1), ("0", 2)}
    assert {r["phoneme"]: r["cats"] for r in x.category_ids().collect()}["ai"] == [1, 0]
    again = Indexer.from_state(spark, x.state())
    assert sorted(map(str, again.subset().collect())) == sorted(map(str, x.subset().collect())) and again.full().count() == 7
    assert [r["phoneme"] for r in x.composition(["i", "p"]).orderBy("idx").collect()] == ["i", "p"]


def test_allophones(spark, table):
    from phonora.operators.indexer import Indexer

    phones = Indexer(table.withColumnRenamed("Phoneme", "phoneme"), ["nasal"]).full()
    ids = {r["phoneme"]: r["idx"] for r in phones.collect()}
    edges = vocabulary.allophone_edges(table.filter("ISO6393 = 'aaa'"), phones)
    got = {(r["phoneme_idx"], r["phone_idx"]) for r in edges.collect()}
    assert got == {(ids["p"], ids["p"]), (ids["p"], ids["pʰ"]), (ids["a"], ids["a"]), (ids["i"], ids["i"])}
    logits = spark.createDataFrame([(0, "aaa", ids[p] + 1, v) for p, v in (("p", -2.0), ("pʰ", 1.0), ("a", 0.5))] + [(0, "aaa", 0, 0.1)], "frame int, lang string, phone_idx int, logit double")
    out = {r["phoneme_idx"]: r["logit"] for r in vocabulary.map_allophones(logits, vocabulary.with_blank(edges), ["frame"]).collect()}
    assert out == {0: 0.1, ids["p"] + 1: 1.0, ids["a"] + 1: 0.5}


def test_classifier_subset(spark):
    rows = spark.createDataFrame([({"a": [["x"]], "b": [["y"]]},)], "predictions map<string, array<array<string>>>")
    assert list(evaluate.only_classifiers(rows, ["a"], ["a", "b"]).first()["predictions"]) == ["a"]
    with pytest.raises(KeyError):
        evaluate.only_classifiers(rows, ["q"], ["a"])
