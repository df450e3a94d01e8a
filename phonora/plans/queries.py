"""The operators on the driver's tables, each beside its DuckDB equivalent.

``documents`` stands in for a feature table (lang as ISO6393, source as Source), ``events`` for frames
and token sequences, ``embeddings`` for feature vectors.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonora.functions import codes, edit, ipa, numeric, text
from phonora.operators import corpus, evaluate, graph, inventory, nearest, remap, sequence, sets, vocabulary
from phonora.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SIZES = "select lang, source, count(*) as n from documents group by all"
_LARGEST = f"select lang, source, n from (select *, row_number() over (partition by lang order by n desc, source nulls first) as r from ({_SIZES})) where r = 1"


def _largest(spark: SparkSession, sf: str) -> DataFrame:
    sizes = inventory.inventory_sizes(table(spark, sf, "documents"), ["lang", "source"])
    return inventory.largest_per_group(sizes, "lang", "n", ["source"])


@query(_LARGEST)
def q01_largest_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _largest(spark, sf)


@query(f"select d.doc_id, d.lang, d.source, d.n_chars from (select *, nullif(source, 'src1') as s from documents) d where exists (select 1 from (select lang, s, n from (select *, row_number() over (partition by lang order by n desc, s nulls first) as r from (select lang, nullif(source, 'src1') as s, count(*) as n from documents group by all)) where r = 1) c where c.lang = d.lang and c.s is not distinct from d.s)")
def q02_inventory_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("dialect", F.nullif("source", F.lit("src1")))
    chosen = inventory.largest_per_group(inventory.inventory_sizes(docs, ["lang", "dialect"]), "lang", "n", ["dialect"])
    return inventory.rows_of(docs, chosen, ["lang", "dialect"]).select("doc_id", "lang", "source", "n_chars")


_DIALECTS = {"en": "src2", "de": "src4"}


@query("select lang, source, n from (select *, row_number() over (partition by lang order by n desc, source nulls first) as r from (select lang, source, count(*) as n from documents where lang not in ('en', 'de') or (lang = 'en' and source = 'src2') or (lang = 'de' and source = 'src4') group by all)) where r = 1")
def q03_preferred_dialect(spark: SparkSession, sf: str) -> DataFrame:
    kept = inventory.preferred(table(spark, sf, "documents"), _DIALECTS, "lang", "source")
    return inventory.largest_per_group(inventory.inventory_sizes(kept, ["lang", "source"]), "lang", "n", ["source"])


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority is not null and nullif(o_orderstatus, 'F') is distinct from 'P'")
def q06_nonmarginal_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").alias("Allophones"), F.when(F.nullif("o_orderstatus", F.lit("F")) == "P", "TRUE").otherwise(F.when(F.col("o_orderstatus") == "F", None).otherwise("FALSE")).alias("Marginal"))
    return inventory.non_marginal(rows).select("o_orderkey", "o_orderpriority")


@query("select doc_id, quality, toxic from (select *, row_number() over (partition by quality order by doc_id) as r from labels) where r <= 100 and quality - toxic > 0")
def q07_vote_filter_limit(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.limited(table(spark, sf, "labels"), 100, ["doc_id"], "quality").filter("quality - toxic > 0").select("doc_id", "quality", "toxic")


@query("""
with words as (select p_partkey, generate_subscripts(w, 1) as pos, unnest(w) as word from (select p_partkey, string_split(p_name, ' ') as w from part)),
ids as (select word, row_number() over (order by word) - 1 as id from (select distinct word from words))
select p_partkey, string_agg(id::varchar, ' ' order by pos) as ids from words join ids using (word) group by all""")
def q08_vocabulary_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    ids = vocabulary.dense_ids(rows.select(F.explode("words").alias("word")), "word")
    return vocabulary.recoded(rows, "p_partkey", "words", ids, "word").select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("""
select * from (
  select 'n_name' as "column", count(distinct n_name) as n from nation union all select 'n_regionkey', count(distinct n_regionkey) from nation
  union all select 'one', count(distinct 1) from nation union all select 'none', 0) where n <= 1""")
def q09_singleton_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_name", "n_regionkey", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return inventory.singleton_columns(rows, rows.columns)


@query("select distinct lower(c) as phoneme from (select unnest(string_split(text, '')) as c from documents) where regexp_matches(c, '^[A-Za-z]$')")
def q10_shared_inventory(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ""))
    found = inventory.language_inventory(table(spark, sf, "documents").select("lang", F.explode(letters).alias("c")).filter("c <> ''"), "lang", "c")
    return inventory.shared_inventory(found)


_SEGMENTS = ["th", "the", "ing", "sch", "tion", "tr", "ch", "que", "qu", "a", "e", "i", "o", "u"]
_ALTERNATION = "|".join(sorted(_SEGMENTS, key=lambda s: (-len(s), s)))


@query(f"select doc_id, len(s) as n_segments, md5(array_to_string(s, '|')) as segments from (select doc_id, regexp_extract_all(text, '{_ALTERNATION}') as s from documents)")
def q11_segment_longest(spark: SparkSession, sf: str) -> DataFrame:
    found = ipa.segment(F.col("text"), _SEGMENTS)
    return table(spark, sf, "documents").select("doc_id", found.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_segments"), F.md5(F.array_join("s", "|").cast("binary")).alias("segments"))


@query("""
select p_partkey, array_to_string(list_filter(regexp_extract_all(p_name, '(ing|sm|in|r|e|[^|])'), lambda x: x in ('ing', 'sm', 'in', 'r', 'e')), '|') as segments,
  regexp_replace(p_name, '(ing|sm|in|r|e)', '', 'g') as left_over, regexp_replace(p_name, '(ing|sm|in|r|e)', '', 'g') = '' as covered
from part""")
def q12_segment_missing(spark: SparkSession, sf: str) -> DataFrame:
    segments = ["ing", "in", "sm", "r", "e"]
    rows = table(spark, sf, "part").select("p_partkey", ipa.segment(F.col("p_name"), segments).alias("s"), F.array_join(ipa.gaps(F.col("p_name"), segments), "").alias("left_over"))
    return rows.select("p_partkey", F.array_join("s", "|").alias("segments"), "left_over", (F.col("left_over") == "").alias("covered"))


_V = ipa.VOWELS


@query(rf"""
with b as (select doc_id, regexp_replace(text, '[\p{{M}}\p{{Lm}}\p{{Sm}}\p{{Sk}}]', '', 'g') as base from documents)
select doc_id, length(base) as n_base, md5(base) as base, regexp_full_match(base, '[{_V}]*') as vowels_only, length(base) > 1 and regexp_matches(base, '[{_V}]') as complex, regexp_full_match(base, '[{_V}]{{2,}}') as multi_vowel from b""")
def q13_base_characters(spark: SparkSession, sf: str) -> DataFrame:
    base = F.col("base")
    rows = table(spark, sf, "documents").select("doc_id", "text", ipa.base(F.col("text")).alias("base"))
    return rows.select("doc_id", F.length(base).cast("long").alias("n_base"), F.md5(base.cast("binary")).alias("base"), ipa.is_vowel_only(F.col("text")).alias("vowels_only"), ipa.complex_with_vowel(base).alias("complex"), ipa.is_multi_vowel(base).alias("multi_vowel"))


@query("select n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c: c || chr(771)), '|') as clusters, len(string_split(n_name, '')) as n from nation")
def q14_graphemes(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("n_name", "(.)", "$1̃")
    return table(spark, sf, "nation").select("n_nationkey", ipa.split_complex(marked).alias("c")).select("n_nationkey", F.array_join("c", "|").alias("clusters"), F.size("c").cast("long").alias("n"))


# Phones: sign vectors of the embeddings.  The target inventory is the first vector of each label.
_PHONES = """
with v as (select vec_id, label, list_transform(embedding, lambda x: (x > 0)::int) as f from embeddings),
r as (select *, row_number() over (partition by label order by vec_id) as k from v),
target as (select vec_id, f from r where k = 1),
own as (select vec_id, f from r where k = 2),
d as (select s.vec_id as source, t.vec_id as target, list_sum(list_transform(range(1, len(s.f) + 1), lambda i: (s.f[i] <> t.f[i])::int))::int as distance from v s, target t)
"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    signs = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("phoneme"), F.col("vec_id").alias("pos"), signs.alias("features"), "label")


def _nth(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy("label").orderBy("phoneme"))).filter(F.col("_k") == k).select("phoneme", "pos", "features")


@query(_PHONES + "select source, target, distance from d")
def q15_hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    return nearest.pairs(rows, _nth(rows, 1)).select("source", "target", "distance")


@query(_PHONES + ", b as (select source, target, distance, row_number() over (partition by source order by distance, target) as r from d) select source, case when distance >= 24 then source else target end as target, distance from b where r = 1")
def q16_nearest_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    found = nearest.nearest_or_same(rows, _nth(rows, 1))
    return found.select("source", F.when(F.col("distance") >= 24, F.col("source")).otherwise(F.col("target")).alias("target"), "distance")


@query(_PHONES + "select source, rank::int as rank, target, distance from (select *, row_number() over (partition by source order by distance, target) as rank from d) where rank <= 5")
def q17_k_nearest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    return nearest.k_nearest(rows, _nth(rows, 1), 5)


@query(_PHONES + """, x as (select s.vec_id as own, t.vec_id as target, list_sum(list_transform(range(1, len(s.f) + 1), lambda i: (s.f[i] <> t.f[i])::int)) as distance from own s, target t),
p1 as (select own as source, arg_min(target, distance * 1000000 + target) as target from x group by own),
p2 as (select target, arg_min(own, distance * 1000000 + own) as own from x where target not in (select target from p1) group by target)
select source, coalesce((select max(target) from p2 where p2.own = p1.source), p1.target) as target from p1""")
def q18_two_phase_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    return nearest.two_phase(_nth(rows, 2), _nth(rows, 1))


# Token sequences: the event types of a user's day, against those of the user's next day.
_DAYS = """
with days as (select user_id, ts::date as day, list(event_type order by ts, event_id) as a from events group by all),
p as (select user_id, day, a, lead(a) over (partition by user_id order by day) as b from days),
pairs as (select * from p where b is not null)
"""
_CELL = "{{'c': ({c})::int, 'i': ({i})::int, 'd': ({d})::int, 's': ({s})::int, 'm': ({m})::int}}"
_COST = "least(r[j+1]['c'] + 1, nw[j]['c'] + 1, r[j]['c'] + (x <> b[j])::int)"


def _cell(c: str, source: str, add: str | None) -> str:
    part = {k: f"{source}['{k}']" + (" + 1" if k == add else "") for k in "idsm"}
    return _CELL.format(c=c, **part)


_TRACE = f"""
list_reduce(a, lambda r, x:
  list_reduce(range(1, len(b) + 1), lambda nw, j: list_append(nw,
    case when r[j]['c'] <= least(r[j+1]['c'], nw[j]['c'])
         then case when r[j]['c'] = {_COST} then {_cell(_COST, 'r[j]', 'm')} else {_cell(_COST, 'r[j]', 's')} end
         when r[j+1]['c'] < nw[j]['c'] then {_cell(_COST, 'r[j+1]', 'd')} else {_cell(_COST, 'nw[j]', 'i')} end),
    [{_cell("r[1]['c'] + 1", 'r[1]', 'd')}]),
  list_transform(range(0, len(b) + 1), lambda j: {{'c': j::int, 'i': j::int, 'd': 0, 's': 0, 'm': 0}}))[-1]"""


def _day_pairs(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]).alias("a"))
    return days.withColumn("b", F.lead("a").over(W.partitionBy("user_id").orderBy("day"))).filter("b is not null")


@query(_DAYS + "select user_id, day::date::varchar as day, levenshtein(array_to_string(list_transform(a, lambda t: substr(t, 1, 1)), ''), array_to_string(list_transform(b, lambda t: substr(t, 1, 1)), '')) as distance from pairs")
def q19_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _day_pairs(spark, sf).select("user_id", F.col("day").cast("string").alias("day"), edit.distance("a", "b").cast("long").alias("distance"))


_STATS = _DAYS + f", t as (select user_id, day, {_TRACE} as z from pairs), st as (select user_id, day, z['i']::bigint as insertions, z['d']::bigint as deletions, z['s']::bigint as substitutions, z['m']::bigint as correct from t)"


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.with_statistics(_day_pairs(spark, sf), "a", "b").select("user_id", "day", *edit.STATISTICS)


@query(_STATS + "select user_id, day::date::varchar as day, insertions, deletions, substitutions, correct from st")
def q20_edit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf).withColumn("day", F.col("day").cast("string"))


@query(_STATS + """, g as (select (user_id % 10)::varchar as language, strftime(day, '%w') as classifier, insertions, deletions, substitutions, correct from st)
select case when grouping(language) = 1 then 'total' else language end as language, classifier, sum(insertions)::bigint as insertions, sum(deletions)::bigint as deletions, sum(substitutions)::bigint as substitutions, sum(correct)::bigint as correct,
  round((sum(substitutions) + sum(deletions) + sum(insertions)) / (sum(substitutions) + sum(deletions) + sum(correct)), 9) as error_rate
from g group by grouping sets ((language, classifier), (classifier))""")
def q21_rates_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stats(spark, sf).withColumns({"language": (F.col("user_id") % 10).cast("string"), "classifier": (F.dayofweek("day") - 1).cast("string")})
    return evaluate.rates(evaluate.with_totals(rows)).withColumn("error_rate", F.round("error_rate", 9))


@query(_STATS + """, g as (select (user_id % 10)::varchar as language, strftime(day, '%w') as classifier, sum(insertions) as i, sum(deletions) as d, sum(substitutions) as s, sum(correct) as c from st group by all),
r as (select language, classifier, (s + d + i) / (s + d + c) as rate from g)
select language, classifier, round(avg(rate), 9) as mean_rate from r group by grouping sets ((language), (classifier), ())""")
def q21b_macro_averages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stats(spark, sf).withColumns({"language": (F.col("user_id") % 10).cast("string"), "classifier": (F.dayofweek("day") - 1).cast("string")})
    rated = evaluate.rates(evaluate.sums(rows, ["language", "classifier"]))
    return evaluate.macro_averages(rated).select("language", "classifier", F.round("mean_rate", 9).alias("mean_rate"))


@query("""
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount / nullif(l_tax, 0) as rate, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as k from lineitem)
select l_orderkey, l_linenumber, rate from (select *, row_number() over (partition by l_orderkey order by rate, l_linenumber, k) as b from r where rate is not null) where b = 1""")
def q22_best_of_n(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_discount", "l_tax").alias("rate"))
    return evaluate.best_of(rows, ["l_orderkey"], "rate", "l_linenumber", ["l_linenumber"])


@query("""
with m as (select r_name as source, [r_name, 'X'] as target from region where r_regionkey < 2)
select r_regionkey, array_to_string(flatten(list_transform(list_sort(list(n_name)), lambda x: [x]) || [coalesce((select target from m where source = any_value(r_name)), [any_value(r_name)])]), '|') as items
from nation join region on n_regionkey = r_regionkey group by r_regionkey""")
def q23_remap_sequences(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region")
    mapping = regions.filter("r_regionkey < 2").select(F.col("r_name").alias("source"), F.posexplode(F.array("r_name", F.lit("X"))).alias("pos", "target"))
    rows = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.concat(F.sort_array(F.collect_list("n_name")), F.array(F.first("r_name"))).alias("items"))
    return remap.remap(rows, "items", mapping).select("r_regionkey", F.array_join("items", "|").alias("items"))


@query("select conv_id, count(*) as turns from conversations group by conv_id having count(*) filter (where role = 'user') = 1 and count(*) filter (where role = 'assistant') <= 1")
def q24_only_primary(spark: SparkSession, sf: str) -> DataFrame:
    # An engine per role; turns of a role are its runs, and a run of any other role carries a tag.
    runs = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.collect_list(F.struct(F.array("role").alias("transcription"), F.when(~F.col("role").isin("user", "assistant"), F.col("role")).alias("language"))).alias("runs"), F.count("*").alias("n"))
    convs = runs.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role").isin("user", "assistant"), F.col("runs"))).alias("engines"), F.sum("n").alias("turns"), F.max(F.col("role") == "user").alias("has_user"))
    return convs.filter(remap.only_primary(F.col("engines")) & F.col("has_user")).select("conv_id", "turns")


@query("""
with e as (select user_id, event_id, event_type, value, lag(event_type) over w as prev, row_number() over w as n from events window w as (partition by user_id order by ts, event_id))
select user_id, coalesce(string_agg(event_type, ' ' order by n) filter (where event_type <> 'view' and event_type is distinct from prev), '') as tokens,
  coalesce(string_agg(n::varchar, ' ' order by n) filter (where event_type <> 'view' and event_type is distinct from prev), '') as timesteps, round(sum(value), 4) as score
from e group by user_id""")
def q25_ctc_greedy(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("frame", F.struct("ts", "event_id"))
    out = sequence.ctc_greedy(rows, ["user_id"], "frame", "event_type", "value", "view")
    return out.select("user_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.col("timesteps").cast("array<string>"), " ").alias("timesteps"), F.round("score", 4).alias("score"))


@query("select lang, n, coalesce(sum(n) over (order by lang rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from (select lang, count(*) as n from documents group by all)")
def q26_language_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.language_ranges(table(spark, sf, "documents"))


@query("""
with c as (select user_id, event_id, event_type, ts, case when row_number() over w = 1 or event_type is not distinct from lag(event_type) over w then 0 else 1 end as ch from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(ch) over (partition by user_id order by ts, event_id)::bigint as island from c)
select user_id, island, min(event_id) as first_id, count(*) as n from i group by all""")
def q27_consecutive_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequence.islands(table(spark, sf, "events"), ["ts", "event_id"], "event_type", ["user_id"])
    return rows.groupBy("user_id", "island").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


_PART_LONG = "select 'p_brand' as feature, p_brand as value from part union all select 'p_type', p_type from part union all select 'p_size', p_size::varchar from part"


@query(f"select feature, size, (1 + coalesce(sum(size) over (order by feature rows between unbounded preceding and 1 preceding), 0))::bigint as \"offset\" from (select feature, count(distinct value) as size from ({_PART_LONG}) group by all)")
def q28_category_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("string"))
    return vocabulary.category_offsets(vocabulary.categories(vocabulary.unpivoted(rows, ["p_partkey"], ["p_brand", "p_type", "p_size"])))


@query("select event_id, round(value - 0.97 * coalesce(lag(value) over w, lead(value) over w), 6) as emphasised from events window w as (partition by user_id order by ts, event_id)")
def q29_pre_emphasis(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.pre_emphasis(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("emphasised", 6).alias("emphasised"))


@query("select event_id, round((value - avg(value) over w) / sqrt(var_pop(value) over w + 1e-7), 5) as standardised from events window w as (partition by user_id)")
def q30_cmvn(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.standardised(table(spark, sf, "events"), ["user_id"], "value").select("event_id", F.round("standardised", 5).alias("standardised"))


@query("""
with d as (select ts::date as day, round(avg(value), 6) as loss from events group by all),
b as (select day, loss, min(loss) over (order by day rows between unbounded preceding and 1 preceding) as best_before, row_number() over (order by day) as n from d),
i as (select *, coalesce(loss < best_before, true) as improved from b)
select day::date::varchar as day, loss, best_before, improved, (n - max(case when improved then n end) over (order by day))::int as since from i""")
def q31_early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return sequence.improvement(days, "day", "loss").select(F.col("day").cast("string").alias("day"), "loss", "best_before", "improved", F.col("since").cast("int").alias("since"))


@query("""
with recursive o as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as r from documents),
f as (
  select source, doc_id, n_chars, r, 0::bigint as batch, 1::bigint as n, n_chars as longest from o where r = 1
  union all
  select o.source, o.doc_id, o.n_chars, o.r,
    case when (f.n + 1) * greatest(f.longest, o.n_chars) > 40000 then f.batch + 1 else f.batch end,
    case when (f.n + 1) * greatest(f.longest, o.n_chars) > 40000 then 1 else f.n + 1 end,
    case when (f.n + 1) * greatest(f.longest, o.n_chars) > 40000 then o.n_chars else greatest(f.longest, o.n_chars) end
  from f join o on o.source = f.source and o.r = f.r + 1)
select source, doc_id, batch::int as batch from f""")
def q32_frame_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return sequence.frame_batches(rows, ["source"], "doc_id", "n_chars", 40_000).select("source", "doc_id", "batch")


@query("""
with c as (select lang, count(*) as n from documents group by all), w as (select *, pow(n / sum(n) over (), 0.5) as w from c),
t as (select n as top_n, w as top_w from w order by n desc, w desc limit 1)
select lang, n, round_even(top_n / top_w * w, 0)::bigint as samples from w, t""")
def q33_oversampling(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.oversampling(corpus.utterance_counts(table(spark, sf, "documents")))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 50 offset 100")
def q34_skip_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.skip(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 50)


@query("""
select doc_id, (1 + n_chars // 160)::bigint as frames, case when n_chars <= 1 then 1 else (1::bigint << length(ltrim(bin(n_chars - 1), '0'))) end as power,
  (floor((floor((n_chars - 10) / 5.0) + 1 - 3) / 2.0) + 1)::bigint as conv, floor(25 / 1000.0 * n_chars)::int as samples
from documents""")
def q35_frame_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", numeric.frame_count(n, 160).alias("frames"), numeric.next_power_of_two(n).alias("power"), numeric.conv_chain(n, [(10, 5), (3, 2)], use_padding=False).alias("conv"), (F.lit(25) / 1000 * n).cast("int").alias("samples"))


@query("""
select o_orderkey, round(case when o_orderkey < 400 then pow(512, -0.5) * o_orderkey * pow(400, -1.5) when o_orderkey < 600 then pow(512, -0.5) * pow(400, -0.5) else pow(512, -0.5) * pow(o_orderkey - 200, -0.5) end, 9) as rate from orders""")
def q36_learning_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(numeric.warmup_rate(F.col("o_orderkey"), 512, 400, 200), 9).alias("rate"))


@query("select lang, round(sum(n_chars) / 16.0, 6) as total, round(avg(n_chars) / 16.0, 6) as mean, count(*) as n, format('{}:{:02d}:{:02d}', (sum(n_chars) // 16 // 3600)::int, (sum(n_chars) // 16 // 60 % 60)::int, (sum(n_chars) // 16 % 60)::int) as spoken from documents group by all")
def q37_durations(spark: SparkSession, sf: str) -> DataFrame:
    out = corpus.durations(table(spark, sf, "documents"), ["lang"], "n_chars", 16)
    return out.select("lang", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"), "n", numeric.human_duration(F.col("total")).alias("spoken"))


@query(r"select page_id, regexp_replace(url, '([^/])\.[^./]*$', '\1') as stem, 'corpus/' || split_part(split_part(url, '/', 4), '?', 1) || '/audio/' || page_id || '.wav' as path from pages")
def q39_file_stem(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.get(F.split(F.get(F.split("url", "/"), F.lit(3)), r"\?"), F.lit(0))
    return table(spark, sf, "pages").select("page_id", text.without_extension(F.col("url")).alias("stem"), text.audio_path("corpus", F.coalesce(lang, F.lit("")), F.col("page_id").cast("string")).alias("path"))


@query("select distinct lang, case lang when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' end as alpha3, case lang when 'en' then 'en-us' when 'fr' then 'fr-fr' when 'de' then 'de' end as resolved from documents")
def q40_language_codes(spark: SparkSession, sf: str) -> DataFrame:
    offered = codes.code_map(spark, ["en-us", "en-gb", "fr-ca", "fr-fr", "de", "it"], {"en": "en-us", "fr": "fr-fr"})
    rows = table(spark, sf, "documents").select("lang").distinct()
    return codes.resolve(rows, "lang", offered).select("lang", codes.alpha3(F.col("lang")).alias("alpha3"), "resolved")


@query("""
with s as (select l_suppkey as k, list_sort(list(distinct l_returnflag || l_linestatus || l_linenumber % 4)) as inv from lineitem group by all),
t as (select l_suppkey as k, list_sort(list(distinct l_returnflag || l_linestatus || l_linenumber % 5)) as inv from lineitem where l_quantity > 30 group by all),
b as (select s.k, s.inv as a, coalesce(t.inv, []) as b from s left join t on s.k = t.k)
select k, array_to_string(list_sort(list_intersect(a, b)), ',') as common, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as lacking,
  array_to_string(list_sort(list_distinct(a || b)), ',') as either, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as subset
from b""")
def q41_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    kind = lambda n: F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % n).cast("string"))))
    s = rows.groupBy(F.col("l_suppkey").alias("k")).agg(kind(4).alias("a"))
    t = rows.filter("l_quantity > 30").groupBy(F.col("l_suppkey").alias("k")).agg(kind(5).alias("b"))
    s = s.join(t, "k", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    a, b = F.col("a"), F.col("b")
    return s.select("k", F.array_join(sets.intersection(a, b), ",").alias("common"), F.array_join(sets.difference(a, b), ",").alias("lacking"), F.array_join(sets.union(a, b), ",").alias("either"), sets.is_subset(a, b).alias("subset"))


@query("""
with cats as (select p_brand, list(p_size order by p_size) as v from (select distinct p_brand, p_size from part) group by all),
seq as (select l_orderkey, l_linenumber, p_brand, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem join part on l_partkey = p_partkey)
select l_orderkey, len(flatten(list(v order by pos))) as n, list_sum(list_transform(flatten(list(v order by pos)), lambda x, i: (x + 1) * i))::bigint as checksum from seq join cats using (p_brand) group by all""")
def q42_contour_labels(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    cats = part.groupBy(F.col("p_brand").alias("phoneme"), F.lit("size").alias("feature")).agg(F.sort_array(F.collect_set("p_size")).alias("cats"))
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand"))), lambda s: s["p_brand"]).alias("brands"))
    out = vocabulary.labels(rows, "l_orderkey", "brands", cats, offset=1)
    weighted = F.aggregate(F.transform("labels", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("l_orderkey", F.col("length").cast("long").alias("n"), weighted.alias("checksum"))


@query("select l_orderkey, s_nationkey as phoneme_idx, max(l_quantity * (1 + l_discount)) as logit from lineitem join supplier on l_suppkey = s_suppkey group by all")
def q43_allophone_max(spark: SparkSession, sf: str) -> DataFrame:
    logits = table(spark, sf, "lineitem").select("l_orderkey", F.lit("x").alias("lang"), F.col("l_suppkey").alias("phone_idx"), (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("logit"))
    edges = table(spark, sf, "supplier").select(F.lit("x").alias("lang"), F.col("s_suppkey").alias("phone_idx"), F.col("s_nationkey").alias("phoneme_idx"), F.lit(1.0).alias("weight"))
    return vocabulary.map_allophones(logits, edges, ["l_orderkey"]).select("l_orderkey", "phoneme_idx", "logit")


_EDGES = "select n_nationkey as src, (n_nationkey * 7 + 3) % 25 as dst from nation union all select n_nationkey, n_regionkey from nation where n_nationkey > 12"


@query(f"""
with recursive e as ({_EDGES}), p as (select src, dst from e union select p.src, e.dst from p join e on p.dst = e.src),
n as (select src as node from e union select dst from e)
select node, least(node, coalesce((select min(a.dst) from p a join p b on a.src = b.dst and a.dst = b.src where a.src = n.node), node)) as component from n""")
def q44_components(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return graph.scc_table(edges.unionByName(nation.filter("n_nationkey > 12").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))))


@query("""
with m as (select vec_id, list_transform(embedding, lambda x: x::double) as e, list_max(embedding)::double as top from embeddings),
s as (select vec_id, e, top, ln(list_sum(list_transform(e, lambda x: exp(x - top)))) as z from m)
select vec_id, i - 1 as i, round(e[i] - top - z, 6) as log_softmax, round(ln(abs(e[i]) + 1e-5), 6) as compressed from (select *, unnest(range(1, len(e) + 1)) as i from s)""")
def q45_log_softmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    out = rows.select("vec_id", F.posexplode(F.arrays_zip(numeric.log_softmax(F.col("e")).alias("z"), F.col("e").alias("x"))).alias("i", "p"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("p.z", 6).alias("log_softmax"), F.round(numeric.log_compression(F.abs("p.x")), 6).alias("compressed"))


@query("select distinct lang, w as segment from (select lang, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) as w from documents)")
def q46_missing_log(spark: SparkSession, sf: str) -> DataFrame:
    from phonora import sinks

    odd = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([^\x00-\x7F])"), F.lit(1)))
    return sinks.missing_log(table(spark, sf, "documents").select("lang", F.explode(odd).alias("segment")), "lang", "segment")


@query("select p_partkey, regexp_replace(replace(p_name, 'red', '∅'), '( ?∅|∅ ?)', '', 'g') as cleaned from part")
def q47_zero_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ipa.drop_zero(F.replace(F.col("p_name"), F.lit("red"), F.lit("∅"))).alias("cleaned"))


@query("select case doc_id % 3 when 0 then 'train' when 1 then 'dev' else 'test' end as split, lang, count(*) as utterances, sum(n_chars)::bigint as total, round(avg(n_chars), 6) as mean from documents group by all")
def q48_statistics(spark: SparkSession, sf: str) -> DataFrame:
    split = F.element_at(F.array(*map(F.lit, corpus.SPLITS)), (F.col("doc_id") % 3 + 1).cast("int"))
    out = corpus.statistics(table(spark, sf, "documents").withColumn("split", split), "n_chars")
    return out.withColumn("mean", F.round("mean", 6))


@query("select n_nationkey, round(sin(n_nationkey), 9) as p0, round(cos(n_nationkey), 9) as p1, round(sin(n_nationkey * exp(-2 * ln(10000.0) / 4)), 9) as p2, round(cos(n_nationkey * exp(-2 * ln(10000.0) / 4)), 9) as p3 from nation")
def q49_positions(spark: SparkSession, sf: str) -> DataFrame:
    p = numeric.sinusoidal(F.col("n_nationkey"), 4)
    return table(spark, sf, "nation").select("n_nationkey", *[F.round(p[i], 9).alias(f"p{i}") for i in range(4)])


@query("select lang, source, n from (select lang, source, count(*) as n from documents group by all) where n > 1")
def q50_repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.inventory_sizes(table(spark, sf, "documents"), ["lang", "source"]).filter("n > 1")


@query("select user_id, count(*) as n, round(sum(value), 4) as loss, round(sum(value) / count(*), 6) as ratio from events group by all")
def q51_loss_ratio(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.loss_ratio(table(spark, sf, "events").withColumn("one", F.lit(1)), ["user_id"], "value", "one")
    return out.select("user_id", F.col("length").alias("n"), F.round("loss", 4).alias("loss"), F.round("ratio", 6).alias("ratio"))


@query("select event_id, floor((row_number() over (partition by user_id order by event_id) - 1) / 8)::int as batch from events")
def q52_fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.fixed_batches(table(spark, sf, "events"), ["user_id"], "event_id", 8).select("event_id", "batch")


@query("""
with c as (select lang, count(*) as n from documents group by all), w as (select *, pow(n / sum(n) over (), 0.5) as w from c),
t as (select n as top_n, w as top_w from w order by n desc, w desc limit 1),
s as (select lang, n, round_even(top_n / top_w * w, 0)::bigint as samples from w, t),
d as (select lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 as k from documents)
select doc_id, unnest(range(k, samples, n))::bigint as draw from d join s using (lang)""")
def q53_oversampled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.oversampled(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"]).select("doc_id", "draw")


@query("select feature, value from (select 'p_type' as feature, p_type as value from part union select 'p_brand', p_brand from part) except select 'p_brand', p_brand from part where p_size > 25")
def q54_unused_categories(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    cats = vocabulary.categories(vocabulary.unpivoted(part, ["p_partkey"], ["p_type", "p_brand"]))
    used = part.filter("p_size > 25").select(F.lit("p_brand").alias("feature"), F.col("p_brand").alias("value")).join(cats, ["feature", "value"])
    return vocabulary.unused_categories(cats, used).select("feature", "value")


@query("select event_id, count(*) over w as n, round(sum(value) over w, 2) as total from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def q55_running_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequence.running_mean(table(spark, sf, "events"), "event_id", "value", ["user_id"])
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("n", n.cast("long")).select("event_id", "n", F.round(F.col("running_mean") * F.col("n"), 2).alias("total"))


@query()
def q56_turn_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edit statistics of whole neighbouring turns; the cost tables are too large for SQL."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", r"\s+").alias("a"))
    turns = turns.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).filter("b is not null")
    return edit.statistics_arrow(turns, "a", "b").select("conv_id", "turn", "edits.*")


from phonora.plans import more_queries  # noqa: E402, F401  (adds to QUERIES and ORACLES)
