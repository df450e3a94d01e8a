"""More operators on the driver's tables, each called from the library beside its DuckDB equivalent.

``orders`` stands in for a feature table with metadata: one row per order, its key as the order of the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.functions import codes, edit, ipa, numeric, text
from phonora.operators import corpus, evaluate, inventory, nearest, remap, sequence, sets, vocabulary
from phonora.operators.indexer import Indexer
from phonora.plans.queries import _DAYS, _PHONES, _STATS, _day_pairs, _vectors, query
from phonora.session import table

_T = """
with t as (
  select (o_custkey % 40)::int as InventoryID, 'g' || (o_custkey % 40) as Glottocode, 'l' || (o_custkey % 8) as ISO6393,
    nullif('d' || ((o_custkey % 40) // 8), 'd0') as SpecificDialect, 'p' || (o_orderkey * 7 % 97) as Phoneme,
    case when o_orderkey % 11 > 0 then 'p' || (o_orderkey * 7 % 97) || ' p' || (o_orderkey * 13 % 97) end as Allophones,
    case o_orderstatus when 'P' then 'TRUE' when 'F' then 'FALSE' end as Marginal, 's' || ((o_custkey % 40) // 20) as Source,
    o_orderstatus as tone, case o_orderkey % 3 when 0 then '+' when 1 then '-' else '0' end as nasal,
    case when o_orderkey * 7 % 97 % 5 = 0 then '-,+' else '+' end as high, o_orderkey as row_id, (o_orderkey * 7 % 97) as num
  from orders)
"""


def _feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "cast(o_custkey % 40 as int) as InventoryID", "concat('g', o_custkey % 40) as Glottocode", "concat('l', o_custkey % 8) as ISO6393",
        "nullif(concat('d', o_custkey % 40 div 8), 'd0') as SpecificDialect", "concat('p', o_orderkey * 7 % 97) as Phoneme",
        "case when o_orderkey % 11 > 0 then concat('p', o_orderkey * 7 % 97, ' p', o_orderkey * 13 % 97) end as Allophones",
        "case o_orderstatus when 'P' then 'TRUE' when 'F' then 'FALSE' end as Marginal", "concat('s', o_custkey % 40 div 20) as Source",
        "o_orderstatus as tone", "case o_orderkey % 3 when 0 then '+' when 1 then '-' else '0' end as nasal",
        "case when o_orderkey * 7 % 97 % 5 = 0 then '-,+' else '+' end as high", "o_orderkey as row_id",
    )


def _number(phoneme: str = "Phoneme") -> str:
    return f"cast(substr({phoneme}, 2) as int)"


@query(_T + """,
f as (select * from t where ISO6393 in ('l1', 'l2') and num < 50), w as (select * from t where num < 90),
phones as (select distinct unnest(string_split(Allophones, ' ')) as phone from f),
lacking as (select phone from phones where phone not in (select Phoneme from f))
select phone, (select min(row_id) from w where Phoneme = phone) as first_row, case when phone in (select Phoneme from w) then 0 end as inventory from lacking""")
def q04_borrowed_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    borrowed, lacking = inventory.borrowed_phones(rows.filter(f"ISO6393 in ('l1', 'l2') and {_number()} < 50"), rows.filter(f"{_number()} < 90"))
    borrowed = borrowed.filter("ISO6393 is null and Source is null and Allophones is null").select(F.col("Phoneme").alias("phone"), F.col("row_id").alias("first_row"), F.col("InventoryID").alias("inventory"))
    return borrowed.unionByName(lacking.select("phone", F.lit(None).cast("long").alias("first_row"), F.lit(None).cast("int").alias("inventory")))


@query(_T + """,
f as (select * from t where ISO6393 in ('l1', 'l2') and num < 50),
want as (select distinct 'l' || (c_custkey % 4) as lang, 'p' || (c_custkey * 3 % 97) as ph from customer),
kept as (select f.* from f join want on lang = ISO6393 and ph = Phoneme),
lacking as (select * from want where not exists (select 1 from kept where ISO6393 = lang and Phoneme = ph)),
donors as (select * from t qualify row_number() over (partition by Phoneme order by row_id) = 1),
head as (select * from kept qualify row_number() over (partition by ISO6393 order by row_id) = 1)
select ISO6393, Phoneme, Allophones, Marginal, InventoryID, row_id from kept
union all select lang, ph, ph, null, head.InventoryID, donors.row_id from lacking join donors on Phoneme = ph join head on head.ISO6393 = lang""")
def q05_backfill(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    want = table(spark, sf, "customer").selectExpr("concat('l', c_custkey % 4) as ISO6393", "concat('p', c_custkey * 3 % 97) as Phoneme")
    out = inventory.backfill(rows.filter(f"ISO6393 in ('l1', 'l2') and {_number()} < 50"), rows, want)
    return out.select("ISO6393", "Phoneme", "Allophones", "Marginal", "InventoryID", "row_id")


@query("""select n_name as lang, '[{"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}]' as json from nation""")
def q38_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    from phonora import sinks

    return sinks.transcriptions_json(table(spark, sf, "nation").select(F.col("n_name").alias("lang"), "n_nationkey", "n_regionkey"))


@query(_T + "select Phoneme, min(row_id) as first_row, arg_min(ISO6393, row_id) as ISO6393 from t group by all")
def q57_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.first_rows(_feature_table(spark, sf), "Phoneme").select("Phoneme", F.col("row_id").alias("first_row"), "ISO6393")


@query("""
with offered as (select distinct case n_nationkey % 7 when 0 then 'arb' when 1 then 'arz' when 2 then 'cmn' when 3 then 'yue' when 4 then 'ara' when 5 then 'deu' else 'swh' end as used from nation),
m as (select used, case when used in ('arb', 'arz', 'ara') then 'ara' when used in ('cmn', 'yue') then 'zho' when used = 'swh' then 'swa' else used end as macro from offered),
asked as (select unnest(['zho', 'apc', 'swa', 'fra', 'deu']) as requested),
missing as (select requested, case requested when 'apc' then 'ara' else requested end as macro from asked where requested not in (select used from offered where used = 'deu'))
select requested, (select arg_min(used, (case when used <> m.macro then 1 else 0 end) || used) from m where m.macro = missing.macro) as used from missing""")
def q58_macro_fallback(spark: SparkSession, sf: str) -> DataFrame:
    code = "case n_nationkey % 7 when 0 then 'arb' when 1 then 'arz' when 2 then 'cmn' when 3 then 'yue' when 4 then 'ara' when 5 then 'deu' else 'swh' end"
    rows = table(spark, sf, "nation").selectExpr(f"{code} as ISO6393").distinct()
    asked = spark.createDataFrame([(c,) for c in ("zho", "apc", "swa", "fra", "deu")], "ISO6393 string")
    return inventory.macro_fallback(rows, asked, rows.filter("ISO6393 = 'deu'")).select("requested", "used")


@query("select c_custkey, coalesce('nation ' || n_name, c_mktsegment) as segment from customer left join (select r_name, n_name from region join nation on n_nationkey = r_regionkey * 5) on r_name = c_mktsegment or (r_name = 'ASIA' and c_mktsegment = 'AUTOMOBILE')")
def q59_replace_values(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("r_regionkey") * 5)
    mapping = names.select(F.when(F.col("r_name") == "ASIA", "AUTOMOBILE").otherwise(F.col("r_name")).alias("old"), F.concat(F.lit("nation "), "n_name").alias("new"))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return inventory.replace_values(rows, "segment", mapping, "old", "new")


_SPOKEN = """
with w as (select l_returnflag as lang, 0 as engine, l_linestatus as a, 'n' || l_linenumber as b from lineitem union all select l_returnflag, 1, 'q' || (l_quantity::int % 7), 'n' || l_linenumber from lineitem),
inv as (select lang, engine, list_sort(list(distinct phone)) as phonemes from (select lang, engine, unnest([a, b]) as phone from w) group by all)
"""


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    run = lambda *c: F.array(F.struct(F.array(*map(F.expr, c)).alias("transcription"), F.lit(None).cast("string").alias("language")))
    number = "concat('n', l_linenumber)"
    engines = F.array(run("l_linestatus", number), run("concat('q', cast(l_quantity as int) % 7)", number))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("lang"), engines.alias("engines"))


@query(_SPOKEN + "select lang, engine, array_to_string(phonemes, ' ') as phonemes from inv")
def q60_engine_inventories(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.engine_inventories(_spoken(spark, sf), "lang", "engines").select("lang", "engine", F.array_join("phonemes", " ").alias("phonemes"))


@query(_SPOKEN + "select lang, string_agg(phone, ' ' order by phone) as phonemes from (select lang, unnest(phonemes) as phone from inv) group by all")
def q61_concatenated_inventory(spark: SparkSession, sf: str) -> DataFrame:
    found = inventory.concatenated_inventory(inventory.engine_inventories(_spoken(spark, sf), "lang", "engines"), "lang")
    return found.select("lang", F.array_join("phonemes", " ").alias("phonemes"))


@query(_T + "select ISO6393, min(row_id) as first_seen from t group by all")
def q62_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.first_seen(_feature_table(spark, sf), "ISO6393")


@query(_T + """,
m as (select distinct Phoneme as ph, 'x' || (num % 9) as target from t where num < 60)
select ISO6393, string_agg(x, ' ' order by x) as image from (select distinct ISO6393, coalesce(target, Phoneme) as x from t left join m on ph = Phoneme) group by all""")
def q63_image(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    mapping = rows.filter(f"{_number()} < 60").selectExpr("Phoneme as source", "0 as pos", f"concat('x', {_number()} % 9) as target").distinct()
    inv = inventory.language_inventory(rows, "ISO6393", "Phoneme").withColumn("_m", remap.as_map(mapping))
    return inv.select("ISO6393", F.array_join(remap.image(F.col("phonemes"), F.col("_m")), " ").alias("image"))


@query(_T + "select InventoryID, Glottocode, ISO6393, SpecificDialect, Allophones, Source, high, nasal from t")
def q64_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    wanted = [c for c in inventory.feature_columns(rows)[::-1] if c != "tone"]
    return inventory.project(rows, wanted).drop("row_id")


@query(_T + """,
sizes as (select Source, ISO6393, SpecificDialect, count(*) as n from t where Allophones is not null and Marginal is distinct from 'TRUE' group by all),
chosen as (select * from sizes qualify row_number() over (partition by ISO6393 order by n desc, Source nulls first, SpecificDialect nulls first) = 1),
f as (select t.* from t join chosen c on t.ISO6393 = c.ISO6393 and t.Source = c.Source and t.SpecificDialect is not distinct from c.SpecificDialect),
phones as (select distinct unnest(string_split(Allophones, ' ')) as phone from f),
extra as (select * from t where Phoneme in (select phone from phones where phone not in (select Phoneme from f)) qualify row_number() over (partition by Phoneme order by row_id) = 1)
select InventoryID, ISO6393, Phoneme as phoneme, Source, nasal, high, row_id from f union all select 0, null, Phoneme, null, nasal, high, row_id from extra""")
def q65_extract(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.extract(_feature_table(spark, sf)).select("InventoryID", "ISO6393", "phoneme", "Source", "nasal", "high", "row_id")


@query(_T + "select distinct Phoneme as phoneme from t where num not in (select num from t where num % 3 = 0)")
def q66_missing_phones(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    return nearest.missing(rows, "Phoneme", rows.filter(f"{_number()} % 3 = 0").select(F.col("Phoneme").alias("phoneme")))


@query(_T + ", k as (select Phoneme, row_number() over (order by Phoneme) - 1 as i from (select distinct Phoneme from t where num % 3 = 0)) select row_id, coalesce(i, -1)::int as idx from t left join k using (Phoneme)")
def q67_indices(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    ids = vocabulary.dense_ids(rows.filter(f"{_number()} % 3 = 0"), "Phoneme").select(F.col("Phoneme").alias("phoneme"), F.col("id").alias("idx"))
    return nearest.indices(rows.select("row_id", "Phoneme"), "Phoneme", ids, strict=False).select("row_id", F.col("idx").cast("int").alias("idx"))


_NAMED = _PHONES + """,
x as (select 'p' || source as source, 'p' || target as target, target as pos, distance + (length('p' || source) <> length('p' || target))::int as distance from d),
near as (select source, target, distance from x qualify row_number() over (partition by source order by distance, pos) = 1),
mapped as (select source, case when source in (select 'p' || vec_id from target) then source when distance >= 24 then source else target end as target,
  case when source in (select 'p' || vec_id from target) then 0 else distance end as distance from near)
"""


def _mapped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    named = _vectors(spark, sf).select(F.concat(F.lit("p"), "phoneme").alias("phoneme"), "pos", F.col("features").cast("array<string>").alias("features"), "label")
    target = named.withColumn("_k", F.row_number().over(W.partitionBy("label").orderBy("pos"))).filter("_k = 1").select("phoneme", "pos", "features")
    return nearest.map_inventories(named.select("phoneme", "features"), target, threshold=24), target


@query(_NAMED + "select source, 0 as pos, target, distance from mapped")
def q68_map_inventories(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf)[0].select("source", "pos", "target", "distance")


@query(_NAMED + "select 'p' || vec_id as phoneme from target where 'p' || vec_id not in (select target from mapped where source <> 'p' || vec_id)")
def q69_unmapped_targets(spark: SparkSession, sf: str) -> DataFrame:
    mapping, target = _mapped(spark, sf)
    return nearest.unmapped_targets(mapping.filter("source <> target"), target)


@query(_T + """, first as (select Phoneme, nasal from t qualify row_number() over (partition by Phoneme order by row_id) = 1),
w as (select r_regionkey as pos, 'p' || (r_regionkey * 17 + 3) as phoneme from region union all select 10 + r_regionkey, 'p' || r_regionkey || 'x' from region)
select row_number() over (order by pos) - 1 as idx, w.phoneme, nasal from w join first on first.Phoneme = coalesce((select f2.Phoneme from first f2 where f2.Phoneme = w.phoneme), replace(w.phoneme, 'x', ''))""")
def q70_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = inventory.first_rows(_feature_table(spark, sf), "Phoneme").select(F.col("Phoneme").alias("phoneme"), "nasal")
    region = table(spark, sf, "region")
    wanted = region.selectExpr("r_regionkey as pos", "concat('p', r_regionkey * 17 + 3) as phoneme").union(region.selectExpr("10 + r_regionkey", "concat('p', r_regionkey, 'x')"))
    found = nearest.subset(rows, wanted, [f"p{i}" for i in range(5)])
    return found.select(F.col("idx").cast("long").alias("idx"), "phoneme", "nasal")


@query("select n_nationkey, nfc_normalize(n_name || 'e' || chr(769)) as repaired from nation")
def q71_repair(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("é")).alias("phoneme"))
    known = nation.select(ipa.nfc(F.col("phoneme")).alias("phoneme"))
    return nearest.repair(nation, known).join(nation, "phoneme").select("n_nationkey", "repaired")


_EDGES = _T + """,
ids as (select Phoneme, (row_number() over (order by Phoneme) - 1)::int as idx from (select distinct Phoneme from t)),
last as (select * from t qualify row_number() over (partition by ISO6393, Phoneme order by row_id desc) = 1),
edges as (select ISO6393 as lang, a.idx as phoneme_idx, b.idx as phone_idx from (select ISO6393, Phoneme, unnest(string_split(Allophones, ' ')) as phone from last) l join ids a on a.Phoneme = l.Phoneme join ids b on b.Phoneme = l.phone)
"""


def _phones(rows: DataFrame) -> DataFrame:
    return vocabulary.dense_ids(rows, "Phoneme").select(F.col("Phoneme").alias("phoneme"), F.col("id").alias("idx"))


@query(_EDGES + "select * from edges")
def q72_allophone_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    return vocabulary.allophone_edges(rows, _phones(rows))


@query(_EDGES + "select lang, phoneme_idx + 1 as phoneme_idx, phone_idx + 1 as phone_idx, 1.0::double as weight from edges union all select distinct lang, 0, 0, 1.0::double from edges")
def q73_with_blank(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    return vocabulary.with_blank(vocabulary.allophone_edges(rows, _phones(rows)))


@query(_EDGES + "select distinct ISO6393 as lang, idx as phoneme_idx, idx as phone_idx from t join ids using (Phoneme)")
def q74_identity_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    inv = inventory.language_inventory(rows, "ISO6393", "Phoneme").withColumnRenamed("ISO6393", "lang")
    return vocabulary.identity_edges(inv, _phones(rows))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: case w when 'red' then 'ROT' when 'ring' then 'RING' else w end), ' ') as renamed from part")
def q75_renamed(spark: SparkSession, sf: str) -> DataFrame:
    mapping = F.create_map(F.lit("red"), F.lit("ROT"), F.lit("ring"), F.lit("RING"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(remap.renamed(F.split("p_name", " "), mapping), " ").alias("renamed"))


@query(_T + "select distinct Phoneme as phoneme from t where ISO6393 in ('l3', 'l1')")
def q76_phoneme_inventory(spark: SparkSession, sf: str) -> DataFrame:
    inv = inventory.language_inventory(_feature_table(spark, sf), "ISO6393", "Phoneme").withColumnRenamed("ISO6393", "lang")
    return corpus.phoneme_inventory(inv, ["l3", "l1"])


@query(_T + "select (row_number() over (order by ISO6393) - 1)::int as lang_id, string_agg(distinct Phoneme, ' ' order by Phoneme) as phonemes from t group by ISO6393")
def q77_inventories_by_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf).withColumnRenamed("ISO6393", "lang")
    inv = inventory.language_inventory(rows, "lang", "Phoneme").join(corpus.language_ids(rows), "lang")
    return corpus.inventories_map(inv).select(F.explode("inventories").alias("lang_id", "p")).select(F.col("lang_id").cast("int").alias("lang_id"), F.array_join("p", " ").alias("phonemes"))


_CATS = _T + """,
first as (select * from t qualify row_number() over (partition by Phoneme order by row_id) = 1),
long as (select Phoneme as phoneme, 'high' as feature, string_split(high, ',') as v from first union all select Phoneme, 'nasal', string_split(nasal, ',') from first),
cats as (select feature, value, row_number() over (partition by feature order by value) - 1 as cat from (select distinct feature, unnest(v) as value from long))
"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    first = inventory.first_rows(_feature_table(spark, sf), "Phoneme").withColumnRenamed("Phoneme", "phoneme")
    return vocabulary.unpivoted(first, ["phoneme"], ["high", "nasal"])


@query(_CATS + ", parts as (select phoneme, feature, unnest(v) as value, generate_subscripts(v, 1) as i from long) select phoneme, feature, string_agg(cat::varchar, ' ' order by i) as cats from parts join cats using (feature, value) group by all")
def q78_binarised(spark: SparkSession, sf: str) -> DataFrame:
    long = _long(spark, sf)
    coded = vocabulary.binarised(long, ["phoneme"], vocabulary.categories(long))
    return coded.select("phoneme", "feature", F.array_join(F.col("cats").cast("array<string>"), " ").alias("cats"))


@query(_CATS + "select phoneme, feature, array_to_string(v, ',') as value from long")
def q79_category_values(spark: SparkSession, sf: str) -> DataFrame:
    long = _long(spark, sf)
    cats = vocabulary.categories(long)
    coded = vocabulary.binarised(long, ["phoneme"], cats).withColumn("labels", F.transform("cats", lambda x: x + 3))
    return vocabulary.category_values(coded, cats, offset=3).select("phoneme", "feature", F.array_join("labels", ",").alias("value"))


@query(_CATS + """, parts as (select phoneme, feature, unnest(v) as value from long)
select phoneme, sum(cat + 1)::double as e0, sum(case feature when 'high' then 10 else 20 end * (cat + 1))::double as e1 from parts join cats using (feature, value) group by all""")
def q80_composed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    long = _long(spark, sf)
    cats = vocabulary.categories(long)
    vectors = cats.select("feature", "cat", F.array((F.col("cat") + 1).cast("double"), (F.when(F.col("feature") == "high", 10).otherwise(20) * (F.col("cat") + 1)).cast("double")).alias("vector"))
    out = vocabulary.composed_embeddings(vocabulary.binarised(long, ["phoneme"], cats), "phoneme", vectors, 2)
    return out.select("phoneme", F.col("embedding")[0].alias("e0"), F.col("embedding")[1].alias("e1"))


@query(_CATS + "select phoneme, v[1] as high, (select l2.v[1] from long l2 where l2.phoneme = long.phoneme and l2.feature = 'nasal') as nasal from long where feature = 'high'")
def q81_dense_table(spark: SparkSession, sf: str) -> DataFrame:
    dense = vocabulary.dense_table(_long(spark, sf), "phoneme", ["high", "nasal"])
    return dense.select("phoneme", F.col("features")[0].alias("high"), F.col("features")[1].alias("nasal"))


# Edit operations: each cell of the cost table carries what was done on the way to it.
_OP_CELL = "{{'c': ({c})::int, 'o': {o}}}"
_OP_COST = "least(r[j+1]['c'] + 1, nw[j]['c'] + 1, r[j]['c'] + (x <> b[j])::int)"
_OPS = f"""
list_reduce(a, lambda r, x:
  list_reduce(range(1, len(b) + 1), lambda nw, j: list_append(nw,
    case when r[j]['c'] <= least(r[j+1]['c'], nw[j]['c'])
         then case when r[j]['c'] = {_OP_COST} then {_OP_CELL.format(c=_OP_COST, o="r[j]['o']")} else {_OP_CELL.format(c=_OP_COST, o="r[j]['o'] || '2' || x || '>' || b[j] || ' '")} end
         when r[j+1]['c'] < nw[j]['c'] then {_OP_CELL.format(c=_OP_COST, o="r[j+1]['o'] || '1' || x || '> '")} else {_OP_CELL.format(c=_OP_COST, o="nw[j]['o'] || '0>' || b[j] || ' '")} end),
    [{_OP_CELL.format(c="r[1]['c'] + 1", o="r[1]['o'] || '1' || x || '> '")}]),
  list_transform(range(0, len(b) + 1), lambda j: {_OP_CELL.format(c="j", o="array_to_string(list_transform(b[1:j], lambda y: '0>' || y || ' '), '')")}))[-1]"""


@query(_DAYS + f", z as (select user_id, day, {_OPS} as z from pairs) select user_id, day::date::varchar as day, z['c']::double as cost, z['o'] as edits from z")
def q82_edit_operations(spark: SparkSession, sf: str) -> DataFrame:
    out = edit.operations(_day_pairs(spark, sf).withColumn("day", F.col("day").cast("string")), "a", "b")
    one = lambda e: F.concat(e["action"].cast("string"), F.coalesce(e["expected"], F.lit("")), F.lit(">"), F.coalesce(e["actual"], F.lit("")), F.lit(" "))
    return out.select("user_id", "day", F.col("edits_cost").cast("double").alias("cost"), F.array_join(F.transform("edits", one), "").alias("edits"))


@query(_DAYS + """, z as (select user_id, day, list_reduce(a, lambda m, x: list_append(m,
  list_reduce(range(1, len(b) + 1), lambda nw, j: list_append(nw, least(m[-1][j+1] + 1, nw[j] + 1, m[-1][j] + (x <> b[j])::int)), [m[-1][1] + 1])),
  [list_transform(range(0, len(b) + 1), lambda j: j::int)]) as m from pairs)
select user_id, day::date::varchar as day, array_to_string(flatten(m), ' ') as costs from z""")
def q83_cost_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = edit.matrix(_day_pairs(spark, sf).select("user_id", F.col("day").cast("string").alias("day"), "a", "b"), "a", "b")
    return out.select("user_id", "day", F.array_join(F.flatten("costs").cast("array<int>").cast("array<string>"), " ").alias("costs"))


_W_COST = "least(r[j+1]['c'] + 1.5, nw[j]['c'] + 0.5, r[j]['c'] + (length(x) <> length(b[j]))::int + (substr(x, 1, 1) <> substr(b[j], 1, 1))::int)"


def _w_cell(c: str, source: str, add: str | None) -> str:
    part = ", ".join(f"'{k}': ({source}['{k}']" + (" + 1" if k == add else "") + ")::int" for k in "idsm")
    return f"{{'c': ({c})::double, {part}}}"


_W_TRACE = f"""
list_reduce(a, lambda r, x:
  list_reduce(range(1, len(b) + 1), lambda nw, j: list_append(nw,
    case when r[j]['c'] <= least(r[j+1]['c'], nw[j]['c'])
         then case when r[j]['c'] = {_W_COST} then {_w_cell(_W_COST, 'r[j]', 'm')} else {_w_cell(_W_COST, 'r[j]', 's')} end
         when r[j+1]['c'] < nw[j]['c'] then {_w_cell(_W_COST, 'r[j+1]', 'd')} else {_w_cell(_W_COST, 'nw[j]', 'i')} end),
    [{_w_cell("r[1]['c'] + 1.5", 'r[1]', 'd')}]),
  list_transform(range(0, len(b) + 1), lambda j: {{'c': j::double, 'i': j::int, 'd': 0, 's': 0, 'm': 0}}))[-1]"""


@query(_DAYS + f", z as (select user_id, day, {_W_TRACE} as z from pairs) select user_id, day::date::varchar as day, z['i']::bigint as insertions, z['d']::bigint as deletions, z['s']::bigint as substitutions, z['m']::bigint as correct from z")
def q84_weighted_statistics(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect()]  # a handful of event types
    rows = _day_pairs(spark, sf).select("user_id", F.col("day").cast("string").alias("day"), "a", "b")
    out = edit.weighted_statistics(rows, "a", "b", {k: (len(k), k[:1]) for k in kinds}, insertion=0.5, deletion=1.5)
    return out.select("user_id", "day", "edits.*")


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_transform(embedding, lambda x: round(x)::double) as r from embeddings)
select vec_id, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - r[i]) * (e[i] - r[i])))), 6) as frobenius,
  round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * r[i])) / sqrt(len(e)), 6) as scaled,
  round(list_sum(list_transform(e[4:2:-1] || e || e[len(e)-1:len(e)-2:-1], lambda x, i: x * i)), 5) as padded,
  array_to_string(list_transform(range(1, 5), lambda i: case when i < vec_id % 6 then 'T' else 'F' end), '') as mask from v""")
def q85_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings").select("vec_id", e.alias("e"), F.transform(e, lambda x: F.round(x)).alias("r"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    padded = F.transform(numeric.reflect_pad(F.col("e"), 3, 2), lambda x, i: x * (i + 1))
    mask = F.transform(numeric.length_mask((F.col("vec_id") % 6).cast("int"), 5, start=1), lambda x: F.when(x, "T").otherwise("F"))
    return rows.select(
        "vec_id", F.round(numeric.frobenius(F.col("e"), F.col("r")), 6).alias("frobenius"), F.round(numeric.scaled_dot(F.col("e"), F.col("r")), 6).alias("scaled"),
        F.round(total(padded), 5).alias("padded"), F.array_join(mask, "").alias("mask"),
    )


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
s as (select vec_id, e, list_sum(list_transform(e, lambda x: exp(x))) as z from v)
select vec_id, len(e) + 2 as n, round(list_sum(list_transform([7.0, 8.0] || list_transform(e, lambda x: exp(x) / z), lambda x, i: x * i)), 5) as checksum from s""")
def q86_softmax_concat(spark: SparkSession, sf: str) -> DataFrame:
    out = numeric.softmax_concat([F.col("embedding").cast("array<double>")], F.array(F.lit(7.0), F.lit(8.0)))
    rows = table(spark, sf, "embeddings").select("vec_id", out.alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate(F.transform("x", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("checksum"))


@query("""
select o_orderkey, (o_custkey + 4 - 5 + 1)::bigint as same, floor((o_custkey + 2 + 4 - 5) / 3.0)::bigint + 1 as strided, o_custkey::bigint as part, ceil(16000.0 * o_custkey / 8000)::bigint as resampled, trunc(o_custkey / 1000.0 * 16)::int as ms from orders""")
def q87_lengths(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", numeric.conv_length(n, 5).cast("long").alias("same"), numeric.conv_length(n, 5, 3).cast("long").alias("strided"), numeric.split_batch_size(n * 4, 4).cast("long").alias("part"),
        numeric.resampled_length(n / F.lit(8000.0), F.lit(8000), 16_000).cast("long").alias("resampled"), numeric.ms_to_samples(n, 16).alias("ms"),
    )


@query("select p_partkey, 'ʲ' || upper(p_brand[1]) || '|a|ʃ|' || p_type || '|' || 'ts|ʲ' as cleaned, p_name || '/' || lower(p_type) || ' x/y:en' as runs from part")
def q88_phone_strings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    items = F.array(F.lit("ʲ"), F.upper(F.substring("p_brand", 1, 1)), F.lit("A"), F.lit("S"), F.col("p_type"), F.lit("t͡s"), F.lit("ʲ"))
    spoken = F.concat(F.col("p_name"), F.lit(" (de) "), F.lower("p_type"), F.lit(" x(en)y"))
    runs = ipa.language_runs(spoken, "de")
    written = F.transform(runs, lambda r: F.concat(F.array_join(r["transcription"], " "), F.coalesce(F.concat(F.lit(":"), r["language"]), F.lit(""))))
    return rows.select("p_partkey", F.array_join(ipa.clean_phonemes(items), "|").alias("cleaned"), F.array_join(written, "/").alias("runs"))


@query(r"select doc_id, md5(array_to_string(list_filter(string_split(text, ' '), lambda w: not regexp_full_match(w, '\p{P}*')), ' ')) as spoken from documents")
def q89_spoken_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(ipa.spoken_words(F.split("text", " ")), " ").cast("binary")).alias("spoken"))


@query(_T + """,
inv as (select distinct ISO6393, Phoneme from t where num % 2 = 0)
select row_id, coalesce(string_agg(x, ' ' order by i) filter (where (t2.ISO6393, x) in (select (ISO6393, Phoneme) from inv)), '') as kept
from (select row_id, ISO6393, unnest(string_split(Allophones, ' ')) as x, generate_subscripts(string_split(Allophones, ' '), 1) as i from t) t2 group by row_id""")
def q90_filter_by_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_table(spark, sf)
    inv = inventory.language_inventory(rows.filter(f"{_number()} % 2 = 0"), "ISO6393", "Phoneme").withColumnRenamed("ISO6393", "lang")
    said = rows.filter("Allophones is not null").select("row_id", "ISO6393", text.allophone_list(F.col("Allophones")).alias("x"))
    return corpus.restricted_labels(said, "x", inv, "ISO6393").select("row_id", F.array_join("x", " ").alias("kept"))


@query("select n_nationkey, n_name || (case when n_nationkey % 3 = 0 then chr(865) else '' end) || 's' as ipa from nation union all select n_nationkey, n_name || 's' from nation where n_nationkey % 3 = 0")
def q91_untied_copies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, ipa.TIE).otherwise(""), F.lit("s")).alias("ipa"))
    return inventory.with_untied_copies(rows)


@query("select n_nationkey, case when n_nationkey % 2 = 0 then n_name else '' end as kept from nation")
def q92_without_tones(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("꜂")), F.lit("a꜀"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(ipa.without_tones(items), " ").alias("kept"))


@query("select doc_id, mode from documents, (select unnest(['include', 'exclude', 'only']) as mode) where mode = 'include' or (mode = 'exclude') = (lang not in ('en', 'de'))")
def q93_training_mode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    parts = [corpus.training_mode(rows, ["en", "de"], mode).select("doc_id", F.lit(mode).alias("mode")) for mode in ("include", "exclude", "only")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
with v as (select vec_id, label, list_transform(embedding[1:(vec_id % 5 + 1)::bigint], lambda x: round(x, 3)) as x from embeddings),
m as (select label, max(len(x)) as longest from v group by all)
select label, string_agg(len(x)::varchar, ' ' order by vec_id) as lengths, count(*) * any_value(longest) as cells, round(sum(coalesce(list_sum(x), 0)), 2) as total from v join m using (label) group by all""")
def q94_padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    values = F.transform(F.slice("embedding", 1, (F.col("vec_id") % 5 + 1).cast("int")), lambda x: F.round(x, 3))
    rows = table(spark, sf, "embeddings").select("label", "vec_id", values.alias("x")).withColumn("length", F.size("x"))
    out = sequence.padded_batches(rows, ["label"], "vec_id", "x", "length")
    flat = F.flatten("values")
    return out.select("label", F.array_join(F.col("lengths").cast("array<string>"), " ").alias("lengths"), F.size(flat).cast("long").alias("cells"), F.round(F.aggregate(flat, F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The event types of a day as what is expected, those of the next day as what was recognised, twice with a worse candidate first."""
    days = _day_pairs(spark, sf)
    worse = F.concat("b", F.array(F.lit("noise")))
    return days.select(
        (F.col("user_id") % 10).cast("string").alias("language"), F.concat_ws(" ", "user_id", F.col("day").cast("string")).alias("utterance_id"),
        F.create_map(F.lit("phone"), F.array(worse, F.col("b"))).alias("predictions"), F.array("a").alias("labels"),
    )


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("phoneme")).distinct()
    return kinds.select("phoneme", F.lit("length").alias("feature"), F.array(F.length("phoneme").cast("string")).alias("values"))


_WORSE = _STATS.replace("pairs as (select * from p where b is not null)", "pairs as (select user_id, day, a, list_append(b, 'noise') as b from p where b is not null)")


@query(f"""
with good as ({_STATS} select user_id, day, insertions as i, deletions as d, substitutions as s, correct as c from st),
bad as ({_WORSE} select user_id, day, insertions as i, deletions as d, substitutions as s, correct as c from st),
best as (select g.user_id, case when (b.i + b.d + b.s) <= (g.i + g.d + g.s) then struct_pack(i := b.i, d := b.d, s := b.s, c := b.c) else struct_pack(i := g.i, d := g.d, s := g.s, c := g.c) end as z
  from good g join bad b using (user_id, day)),
r as (select (user_id % 10)::varchar as language, z.i as i, z.d as d, z.s as s, z.c as c from best)
select coalesce(language, 'total') as language, 'phone' as classifier, sum(i)::bigint as insertions, sum(d)::bigint as deletions, sum(s)::bigint as substitutions, sum(c)::bigint as correct,
  round((sum(s) + sum(d) + sum(i)) / (sum(s) + sum(d) + sum(c)), 5) as error_rate from r group by rollup (language)""")
def q95_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.evaluate(_predictions(spark, sf), _kinds(spark, sf), kind="double")
    return out.withColumn("error_rate", F.round("error_rate", 5))


@query(_DAYS + """, refs as (select user_id || ' ' || day::date::varchar as utterance_id, a, (user_id % 10)::varchar as language from pairs),
tokens as (select utterance_id, language, unnest(a) as t, generate_subscripts(a, 1) as i from refs)
select language, utterance_id, 'length' as classifier, string_agg(length(t)::varchar, ' ' order by i) as expected from tokens group by all
union all select language, utterance_id, unnest(['phone', 'phoneme']), array_to_string(a, ' ') from refs""")
def q96_expected_labels(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.expected_labels(_predictions(spark, sf), _kinds(spark, sf)).withColumn("expected", F.array_join("expected", " "))


@query(_DAYS + """, said as (select user_id || ' ' || day::date::varchar as utterance_id, (user_id % 10)::varchar as language, b from pairs)
select language, utterance_id, 'phone' as classifier, 0 as rank, array_to_string(list_transform(b || ['noise'], lambda t: case t when 'view' then 'seen' else t end), ' ') as actual from said
union all select language, utterance_id, 'phone', 1, array_to_string(list_transform(b, lambda t: case t when 'view' then 'seen' else t end), ' ') from said""")
def q97_candidates(spark: SparkSession, sf: str) -> DataFrame:
    predictions = _predictions(spark, sf)
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("source")).distinct().union(spark.createDataFrame([("noise",)], "source string"))
    mapping = predictions.select("language").distinct().withColumn("_k", kinds.agg(F.collect_list("source")).scalar()).select("language", F.explode("_k").alias("source"))
    mapping = mapping.withColumn("target", F.when(F.col("source") == "view", "seen").otherwise(F.col("source")))
    return evaluate.candidates(predictions, mapping=mapping).withColumn("actual", F.array_join("actual", " "))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, format('{}: | I: {} D: {} S: {} C: {} | {:.2f}%', l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity::int, l_discount * 100) as line from lineitem")
def q98_described(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumns({"insertions": F.col("l_linenumber"), "deletions": F.col("l_partkey"), "substitutions": F.col("l_suppkey"), "correct": F.col("l_quantity").cast("int"), "error_rate": F.col("l_discount")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", evaluate.described(F.col("l_returnflag")).alias("line"))


@query(r"select page_id, regexp_extract(url, '^https://(.+)/(.+)$', 1) as host, regexp_extract(url, '^https://(.+)/(.+)$', 2) as rest from pages")
def q99_format_parser(spark: SparkSession, sf: str) -> DataFrame:
    fields = text.parsed(F.col("url"), "https://{host}/{rest}")
    return table(spark, sf, "pages").select("page_id", F.coalesce(fields["host"], F.lit("")).alias("host"), F.coalesce(fields["rest"], F.lit("")).alias("rest"))


@query("with v as (select list_sort(list(distinct p_type)) as v from part) select p_partkey, p_type as first, array_to_string([list_position(v, p_type) - 1, list_position(v, p_brand) - 1], ' ') as ids from part, v")
def q100_contours(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    known = part.agg(F.sort_array(F.collect_set("p_type")).alias("v")).scalar()
    rows = part.withColumns({"_v": known, "contour": F.concat_ws(",", "p_type", "p_brand")})
    ids = text.encoded(text.contour(F.col("contour")), F.col("_v"))
    return rows.select("p_partkey", text.first_of_contour(F.col("contour")).alias("first"), F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


@query("""
with w as (select conv_id, string_split(text, ' ')[1:3] as w, [turn::varchar, role] as r from conversations)
select conv_id, r[1] as turn, i::int as i, w[i] as word, r[i] as run from w, (select unnest(range(1, 4)) as i) where i <= greatest(len(w), 2)""")
def q101_zipped(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("string").alias("turn"), remap.zipped(F.slice(F.split("text", " "), 1, 3), F.array(F.col("turn").cast("string"), "role")).alias("z"))
    return rows.select("conv_id", "turn", F.posexplode("z").alias("i", "z")).select("conv_id", "turn", (F.col("i") + 1).alias("i"), F.col("z.word").alias("word"), F.col("z.runs").alias("run"))


@query("""
select conv_id, string_agg(role || ' ' || turn, ' ' order by turn, role) as whole, coalesce(string_agg(role || ' ' || turn, ' ' order by turn, role) filter (where role = 'user'), '') as main
from (select distinct conv_id, turn, role from conversations) group by all""")
def q102_flattened(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role").distinct()
    run = F.struct("turn", "role", F.array("role", F.col("turn").cast("string")).alias("transcription"), F.when(F.col("role") != "user", F.col("role")).alias("language"))
    runs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    return runs.select("conv_id", F.array_join(remap.flattened(F.col("runs")), " ").alias("whole"), F.array_join(remap.flattened_primary(F.col("runs")), " ").alias("main"))


@query("select n_nationkey as k, n_name as name from nation union all select 100 + r_regionkey, r_name from region")
def q103_union_unique(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return sets.union_unique(nations, table(spark, sf, "region").select((100 + F.col("r_regionkey")).alias("k"), F.col("r_name").alias("name")), "k")


@query("select l_orderkey, count(*) as n from lineitem group by all having count(*) > 1")
def q104_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return sets.repeated(table(spark, sf, "lineitem"), "l_orderkey")


@query("select case when doc_id % 2 = 0 then 'train' else 'test' end as split, doc_id, (dense_rank() over (order by lang) - 1)::int as lang_id from documents")
def q105_splits(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    both = corpus.splits(train=docs.filter("doc_id % 2 = 0"), test=docs.filter("doc_id % 2 = 1"))
    return both.join(corpus.language_ids(docs), "lang").select("split", "doc_id", F.col("lang_id").cast("int").alias("lang_id"))


@query("""select 'all' as split, '{' || string_agg('"' || lang || '":{"utterances":' || n || ',"total":' || total || '}', ',' order by lang) || '}' as json from (select lang, count(*) as n, sum(n_chars)::bigint as total from documents group by all)""")
def q106_statistics_json(spark: SparkSession, sf: str) -> DataFrame:
    stats = corpus.statistics(table(spark, sf, "documents").withColumn("split", F.lit("all")), "n_chars").drop("mean")
    return corpus.statistics_json(stats)


@query("select p_partkey, regexp_replace(p_name, '(.)', '\\1|', 'g') as letters, regexp_replace(replace(p_name, ' ', ''), '(.)', '\\1|', 'g') as of_words from part")
def q107_checked_segments(spark: SparkSession, sf: str) -> DataFrame:
    letters = [*map(chr, range(ord("a"), ord("z") + 1)), " "]
    whole = F.array_join(ipa.segment_checked(F.col("p_name"), letters), "|")
    words = F.array_join(ipa.segment_words_checked(F.split("p_name", " "), letters), "|")
    return table(spark, sf, "part").select("p_partkey", F.concat(whole, F.lit("|")).alias("letters"), F.concat(words, F.lit("|")).alias("of_words"))


@query("select n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c: c || chr(771)), ' ') as a, array_to_string(list_transform(string_split(lower(n_name), ''), lambda c: c), ' ') as b from nation")
def q108_split_segments(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("n_name", "(.)", "$1̃")
    found = ipa.split_phoneme_segment(F.concat_ws("|", marked, F.lower("n_name")))
    return table(spark, sf, "nation").select("n_nationkey", found.alias("f")).select("n_nationkey", F.array_join(F.col("f")[0], " ").alias("a"), F.array_join(F.col("f")[1], " ").alias("b"))


@query("""
select doc_id, lang || case doc_id % 3 when 0 then '-Latn-US' when 1 then '-CH' else '' end as standard, case doc_id % 3 when 0 then 'US-valencia' when 1 then 'CH' end as variant,
  case lang when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' end as alpha3 from documents""")
def q109_code_parts(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, "_latn_us").when(F.col("doc_id") % 3 == 1, "-ch").otherwise("")
    parts = F.when(F.col("doc_id") % 3 == 0, "-US-valencia").when(F.col("doc_id") % 3 == 1, "_CH").otherwise("")
    rows = table(spark, sf, "documents").select("doc_id", F.concat("lang", tail).alias("code"), F.concat("lang", parts).alias("tagged"))
    return rows.select("doc_id", codes.standardised(F.col("code")).alias("standard"), codes.variant(F.col("tagged")).alias("variant"), codes.alpha3(F.col("tagged")).alias("alpha3"))


@query(_T + ", first as (select * from t qualify row_number() over (partition by Phoneme order by row_id) = 1) select (row_number() over (order by i) - 1)::int as idx, Phoneme as phoneme, nasal || string_split(high, ',')[1] as features from first join (select unnest(['p5', 'p0', 'p33', 'p96']) as Phoneme, unnest(range(4)) as i) using (Phoneme)")
def q110_composition(spark: SparkSession, sf: str) -> DataFrame:
    x = Indexer(_feature_table(spark, sf).withColumnRenamed("Phoneme", "phoneme"), ["nasal", "high"])
    return x.composition(["p5", "p0", "p33", "p96"]).select(F.col("idx").cast("int").alias("idx"), "phoneme", F.array_join("features", "").alias("features"))


@query(_T + ", first as (select * from t qualify row_number() over (partition by Phoneme order by row_id) = 1) select Phoneme as phoneme, tone || nasal || string_split(high, ',')[1] as features from first where Phoneme = 'p42'")
def q111_feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    x = Indexer(_feature_table(spark, sf).withColumnRenamed("Phoneme", "phoneme"), ["tone", "nasal", "high"])
    return nearest.feature_vector(x.full(), "p42").select("phoneme", F.array_join("features", "").alias("features"))


@query("select vec_id, (row_number() over (order by label, vec_id) - 1)::bigint as place from embeddings")
def q112_places_by_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", "vec_id")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    place = sequence.offsets(counts, "label").select("label", F.col("n").alias("_n"), "offset")
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).join(place, "label")
    return ranked.select("vec_id", sequence.cyclic(F.col("at"), F.col("_n"), F.col("offset")).cast("long").alias("place"))


@query("select user_id, round(sum(value) / count(*), 6) as mean, (max(event_id) % 7 + 3)::bigint as place from events group by all")
def q113_incremental_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.max("event_id").alias("last"))
    return rows.select("user_id", F.round(numeric.incremental_mean(F.col("total"), F.col("n")), 6).alias("mean"), sequence.cyclic(F.col("last"), F.lit(7), F.lit(3)).cast("long").alias("place"))


@query("select case when doc_id % 4 = 0 then null else source end as source, count(*) as n from documents group by all")
def q114_null_if_empty(spark: SparkSession, sf: str) -> DataFrame:
    blank = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source"))
    return corpus.utterance_counts(table(spark, sf, "documents").select(text.null_if_empty(blank).alias("source")), ["source"])


@query("select doc_id, quality from labels where quality is not null")
def q115_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.labelled(table(spark, sf, "labels").filter("quality is not null").select("doc_id", "quality"), "quality")


@query("""
with r as (select l_returnflag as language, l_linestatus as classifier, sum(l_quantity) as insertions from lineitem where l_returnflag <> 'N' or l_linestatus = 'O' group by all)
select l as language, c as classifier, coalesce(insertions, 0)::bigint as insertions, 0::bigint as correct from (select distinct l_returnflag as l from lineitem), (select distinct l_linestatus as c from lineitem) left join r on language = l and classifier = c""")
def q116_complete(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("classifier"), "l_quantity")
    some = rows.filter("language <> 'N' or classifier = 'O'").groupBy("language", "classifier").agg(F.sum("l_quantity").cast("long").alias("insertions"))
    some = some.withColumns({n: F.lit(0).cast("long") for n in edit.STATISTICS if n != "insertions"})
    return evaluate.complete(some, rows, rows).select("language", "classifier", "insertions", "correct")
