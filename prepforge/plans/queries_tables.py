"""Queries over tables: columns, joins, aggregations, windows, sets, slots, metrics, blends, encoders, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as mt
from ..functions.slots import same_slot, weekly_slot
from ..operators import columns as co
from ..operators import encode as en
from ..operators import ensemble as es
from ..operators import joins as jo
from ..operators import ranks as ra
from ..operators import splits as sp
from ..operators import stats as st
from .flows import slot_features, slot_history_ranking
from .registry import query

# --- columns ---------------------------------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def p01_p02_keep_columns(t):
    df = co.features_only(t("lineitem"), "l_comment")
    return co.keep_present(df, ["l_orderkey", "l_linenumber", "l_quantity", "absent"])


@query("select p_partkey as key_lower, p_name as name_lower from part")
def p03_lower_names(t):
    return co.lower_names(t("part").select(F.col("p_partkey").alias("KEY_LOWER"), F.col("p_name").alias("Name_Lower")))


@query("select event_id, try_cast(json_extract_string(props, '$.page') as int) as page, try_cast(event_type as double) as bad from events")
def p04_declared_casts(t):
    df = t("events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.col("event_type").alias("bad"))
    return co.cast_declared(df, {"page": "int", "bad": "double"})


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from events")
def p05_without_zone(t):
    zoned = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return co.without_zone(zoned, "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("""
select d.doc_id, coalesce(l.quality, -1) as quality, cast(l.quality is null as int) as quality_is_missing, coalesce(l.toxic, 0) as toxic_count,
  cast(l.toxic is null as int) as toxic_count_is_missing, coalesce(case when l.quality = 1 then d.lang end, 'unknown') as lang, cast(l.quality is distinct from 1 as int) as lang_is_missing
from documents d left join labels l using (doc_id)""")
def p06_impute_with_flags(t):
    j = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality", F.col("toxic").alias("toxic_count")), "doc_id", "left")
    j = j.withColumn("lang", F.when(F.col("quality") == 1, F.col("lang")))
    return co.impute(j, {"quality": "numeric", "toxic_count": "count", "lang": "categorical"})


@query("select doc_id, lang from documents")
def p07_drop_sparse_columns(t):
    j = t("documents").select("doc_id", "lang").join(t("labels").filter("toxic = 1").select("doc_id", "toxic"), "doc_id", "left")
    return j.drop(*co.sparse_columns(j))


@query("""
with j as (select d.doc_id, d.lang, l.toxic from documents d left join (select doc_id, toxic from labels where toxic = 1) l using (doc_id))
select unnest(['doc_id', 'lang', 'toxic']) as name, unnest([avg((doc_id is null)::int) > 0.5, avg((lang is null)::int) > 0.5, avg((toxic is null)::int) > 0.5]) as dropped from j""")
def p07_sparse_columns(t):
    """Which columns miss more than half of their values."""
    j = t("documents").select("doc_id", "lang").join(t("labels").filter("toxic = 1").select("doc_id", "toxic"), "doc_id", "left")
    gone = co.sparse_columns(j)
    return j.sparkSession.createDataFrame([(c, c in gone) for c in j.columns], "name string, dropped boolean")


@query("""
select l_orderkey, l_linenumber, least(greatest(l_quantity, 10), 40) as clipped, round(ln(1 + greatest(l_extendedprice, 0)), 9) as log_price,
  round(greatest(exp(least(greatest(l_quantity, -5), 12)) - 1, 0), 6) as safe, round(l_quantity * l_discount, 9) as prod,
  round(case when l_tax > 0.03 then l_discount / (l_tax + 1e-5) end, 9) as ratio, cast(l_tax <= 0.03 as int) as tax_missing from lineitem""")
def p08_p12_arithmetic(t):
    li = t("lineitem").withColumn("tax", F.when(F.col("l_tax") > 0.03, F.col("l_tax")))
    return li.select(
        "l_orderkey", "l_linenumber", co.clip("l_quantity", 10, 40).alias("clipped"), F.round(co.to_log("l_extendedprice"), 9).alias("log_price"), F.round(co.from_log("l_quantity", safe=True), 6).alias("safe"),
        F.round(co.product("l_quantity", "l_discount"), 9).alias("prod"), F.round(co.ratio("l_discount", "tax"), 9).alias("ratio"), co.missing_flag("tax").alias("tax_missing"),
    )


@query("select event_id, 'train' as split from events where event_type = 'purchase' and value > 0")
def p14_p15_mask_and_tag(t):
    return co.tag(t("events").filter("event_type = 'purchase' and value > 0").select("event_id"), "train")


@query("select coalesce(cast(l_quantity as double), 0) as l_quantity, 0.0::double as absent, coalesce(cast(l_tax as double), 0) as l_tax from lineitem")
def p16_align_layout(t):
    return co.align(t("lineitem").select(F.col("l_tax").cast("double").alias("l_tax"), F.col("l_quantity").cast("double").alias("l_quantity"), "l_orderkey"), ["l_quantity", "absent", "l_tax"])


@query("select l_orderkey, l_linenumber, [cast(l_quantity as double), cast(l_tax as double)] as picked from lineitem")
def p17_p19_fuse_and_slice(t):
    from pyspark.ml.functions import vector_to_array

    fused = co.fuse(t("lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")]), ["l_quantity", "l_discount", "l_tax"])
    names = [n for n in co.feature_names(fused) if n != "l_discount"]
    return co.slice_features(fused, names).select("l_orderkey", "l_linenumber", vector_to_array("picked").alias("picked"))


@query("select n_nationkey, 0 as slot_1, n_regionkey as slot_2 from nation")
def p20_ensure_family(t):
    df = t("nation").select("n_nationkey", F.col("n_regionkey").alias("slot_2"))
    return co.ensure_family(df, ["slot_1", "slot_2"]).select("n_nationkey", "slot_1", "slot_2")


# --- joins -----------------------------------------------------------------------------------------------------------------------------


@query("""
select p.event_id, p.user_id, c.event_id as event_id_right, c.value as value_right from (select * from events where event_type = 'purchase') p
asof left join (select * from (select *, row_number() over (partition by user_id, ts order by event_id desc) as r from events where event_type = 'click') where r = 1) c
on p.user_id = c.user_id and p.ts >= c.ts""")
def j01_asof_join(t):
    e = t("events").select("event_id", "ts", "user_id", "event_type", "value")
    out = jo.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), "user_id", "ts", "ts", ["event_id", "value"], tie="event_id")
    return out.select("event_id", "user_id", "event_id_right", "value_right")


_SLOT = "case when hour(ts) between 9 and 20 then cast((isodow(ts) - 1) * 4 + (hour(ts) - 9) // 3 + 1 as int) end"


@query(f"""
with o as (select user_id, {_SLOT} as slot from events where event_type = 'click'), c as (select user_id, count(*) filter (where slot = 1) as s1, count(*) filter (where slot = 28) as s28 from o where slot is not null group by user_id)
select event_id, user_id, {_SLOT} as send_slot, case when event_type = 'click' then {_SLOT} end as open_slot, c.s1 as slot_1_engagements, c.s28 as slot_28_engagements
from events left join c using (user_id)""")
def j02_l3_slot_features(t):
    e = t("events").withColumn("opened", F.when(F.col("event_type") == "click", F.col("ts")))
    return slot_features(e, "user_id", "ts", "opened").select("event_id", "user_id", "send_slot", "open_slot", "slot_1_engagements", "slot_28_engagements")


@query(f"""
select user_id, cast(slot as int) as slot, n from (select distinct user_id from events) u cross join (select unnest(range(1, 29)) as slot) s
left join (select user_id, {_SLOT} as slot, count(*) as n from events group by all) h using (user_id, slot)""")
def j03_j04_expand_and_join(t):
    e = t("events").withColumn("slot", weekly_slot("ts"))
    return jo.left_history(jo.expand_slots(e, "user_id"), st.slot_counts(e, "user_id"), ["user_id", "slot"])


@query("select c.c_custkey, o.n from customer c left join (select o_custkey, count(*) as n from orders group by o_custkey) o on c.c_custkey = o.o_custkey")
def j05_template_join(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left")


@query("select s_suppkey, coalesce(n_name, 'none') as nation from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20")
def j06_map_lookup(t):
    s = t("supplier").select("s_suppkey", "s_nationkey")
    return jo.look_up(s, "s_nationkey", t("nation").filter("n_nationkey < 20"), "n_nationkey", "n_name", "none", "nation").select("s_suppkey", "nation")


@query("select d.doc_id, d.n_chars, length(e.text) as n from documents d join documents e using (doc_id)")
def j07_realign_by_key(t):
    d = t("documents")
    return jo.realign(d.select("doc_id", "n_chars"), d.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")


@query("""
select count(*) filter (where b.doc_id is null) as only_left, count(*) filter (where a.doc_id is null) as only_right,
  count(*) filter (where a.quality <> b.toxic) as different from (select * from labels where doc_id % 7 <> 0) a full join (select * from labels where doc_id % 5 <> 0) b on a.doc_id = b.doc_id""")
def j08_alignment_check(t):
    l = t("labels")
    return jo.mismatches(l.filter("doc_id % 7 != 0").select("doc_id", F.col("quality").alias("v")), l.filter("doc_id % 5 != 0").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


# --- aggregations ----------------------------------------------------------------------------------------------------------------------


@query(f"select user_id, {_SLOT} as slot, count(*) as n from events where {_SLOT} is not null group by all")
def a01_d1_slot_counts(t):
    return st.slot_counts(t("events").withColumn("slot", weekly_slot("ts")), "user_id")


@query("select user_id, " + ", ".join(f"count(*) filter (where slot = {s}) as slot_{s}_engagements" for s in range(1, 29)) + f" from (select user_id, {_SLOT} as slot from events) where slot is not null group by user_id")
def a02_slot_matrix(t):
    return st.slot_matrix(t("events").withColumn("slot", weekly_slot("ts")), "user_id")


@query("select p_brand, count(*) as n from part group by p_brand")
def a03_value_counts(t):
    return st.value_counts(t("part"), "p_brand")


@query("select p_type, count(*) as n from part group by p_type order by n desc, p_type limit 5")
def a04_top_values(t):
    return st.value_counts(t("part"), "p_type", top=5)


@query("select 'text' as name, round(100 * avg(cast(trim(coalesce(text, '')) = '' as int)), 6) as blank_pct from documents union all select 'lang', round(100 * avg(cast(trim(coalesce(lang, '')) = '' as int)), 6) from documents")
def a04_blank_share(t):
    return st.blank_share(t("documents"), "text", "lang")


@query("""
with j as (select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id))
select 'doc_id' as name, count(*) - count(doc_id) as missing, round(100 * (count(*) - count(doc_id)) / count(*), 6) as pct from j
union all select 'quality', count(*) - count(quality), round(100 * (count(*) - count(quality)) / count(*), 6) from j
union all select 'toxic', count(*) - count(toxic), round(100 * (count(*) - count(toxic)) / count(*), 6) from j""")
def a05_missing_report(t):
    return st.missing_report(t("documents").select("doc_id").join(t("labels"), "doc_id", "left"))


@query("""
select 'p_name' as name, count(p_name) as non_null, round(100 * avg(cast(p_name is null as int)), 6) as null_pct, count(distinct p_name) as n_unique, cast(min(length(p_name)) as double) as low,
  cast(max(length(p_name)) as double) as high, round(avg(length(p_name)), 6) as mean, round(median(length(p_name)), 6) as median from part
union all select 'p_size', count(p_size), round(100 * avg(cast(p_size is null as int)), 6), count(distinct p_size), cast(min(p_size) as double), cast(max(p_size) as double), round(avg(p_size), 6), round(median(p_size), 6) from part""")
def a06_column_profile(t):
    p = t("part")
    return st.profile(p, "p_name").unionByName(st.profile(p, "p_size"))


@query("select lang, count(*) as n, round(100 * avg(cast(quality is not null as int)), 6) as quality_pct from documents left join labels using (doc_id) group by lang")
def a07_coverage(t):
    return st.coverage(t("documents").join(t("labels"), "doc_id", "left"), "lang", ["quality"])


@query("select cast(sum(cast(quality is null as int) + cast(toxic is null as int)) as bigint) as nulls from documents left join labels using (doc_id)")
def a08_nulls_left(t):
    return st.nulls_left(t("documents").join(t("labels"), "doc_id", "left").select("quality", "toxic"))


@query("select l_returnflag, min(cast(l_extendedprice as double)) as min, round(median(cast(l_extendedprice as double)), 6) as median, max(cast(l_extendedprice as double)) as max, round(avg(l_extendedprice), 6) as mean, round(stddev_pop(l_extendedprice), 6) as std from lineitem group by l_returnflag")
def a09_summary(t):
    return st.summary(t("lineitem"), "l_extendedprice", "l_returnflag")


@query("select o_orderpriority, round(avg(o_totalprice), 6) as mean, round(stddev_pop(o_totalprice), 6) as std from orders group by o_orderpriority")
def a10_fold_summary(t):
    return st.fold_summary(t("orders"), "o_orderpriority", "o_totalprice")


@query("select sum(cast(quality = 0 as int)) / sum(cast(quality = 1 as int)) as neg_over_pos from labels")
def a15_class_ratio(t):
    return st.class_ratio(t("labels"), "quality")


@query("with n as (select event_type, count(*) as n from events group by event_type) select event_type, n, round((select count(*) from n) / n / (select sum(1.0::double / n) from n), 9) as weight from n")
def a16_class_weights(t):
    return st.class_weights(t("events"), "event_type")


@query("select l_linestatus, count(*) as n from lineitem group by l_linestatus")
def a17_label_distribution(t):
    return st.label_distribution(t("lineitem"), "l_linestatus")


@query("select round(avg(cast(quality = toxic as double)), 9) as agreement from labels")
def a18_agreement(t):
    return st.agreement(t("labels"), "quality", "toxic")


@query("select p_brand as feature, round(avg(p_retailprice), 9) as gain, round(avg(p_size), 9) as split from part group by p_brand")
def a19_mean_importance(t):
    return st.mean_importance(t("part").select(F.col("p_brand").alias("feature"), F.col("p_retailprice").alias("gain"), F.col("p_size").alias("split")))


@query("select 'l_quantity' as name, round(corr(l_quantity, l_extendedprice), 6) as corr from lineitem union all select 'l_discount', round(corr(l_discount, l_extendedprice), 6) from lineitem")
def a20_correlations(t):
    return st.correlations(t("lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@query("select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 60)), 59) as int) as bin, count(*) as n from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) group by 1")
def a22_histogram(t):
    return st.histogram(t("orders"), "o_totalprice", 60)


@query("select round(quantile_cont(cast(value as double), 0.9), 6) as p90, round(quantile_cont(cast(value as double), 0.95), 6) as p95, round(quantile_cont(cast(value as double), 0.98), 6) as p98 from events where value > 1")
def a23_percentile_cuts(t):
    return st.percentiles(t("events"), "value", [0.9, 0.95, 0.98], F.col("value") > 1)


@query("select round(avg(cast(l_discount > 0.01 as double)), 9) as above_0_01, round(avg(cast(l_discount > 0.05 as double)), 9) as above_0_05 from lineitem")
def a28_shares_above(t):
    return st.shares_above(t("lineitem"), "l_discount", [0.01, 0.05])


@query("""
select round(avg(b) - avg(a), 6) as d_mean, round(stddev_samp(b) - stddev_samp(a), 6) as d_std, min(a) as min_a, max(a) as max_a, min(b) as min_b, max(b) as max_b, round(corr(a, b), 6) as corr
from (select cast(l_extendedprice as double) as a, cast(l_extendedprice * (1 - l_discount) as double) as b from lineitem)""")
def a29_compare(t):
    return st.compare(t("lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b")), "a", "b")


# --- windows, top-k, sampling, sets ------------------------------------------------------------------------------------------------------

_RANK = "(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)"


@query("select p_partkey, round(case when p_size > 5 then " + _RANK.format(c="s") + " / (select count(*) from part) end, 9) as r from (select p_partkey, p_size, case when p_size > 5 then p_size end as s from part) order by 1".replace("order by s)", "order by s nulls last)"))
def w01_percent_rank(t):
    p = t("part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_size")).alias("s"))
    return ra.percent_rank_average(p, "s", "r").select("p_partkey", F.round("r", 9).alias("r"))


@query(f"""
select user_id, list('slot_' || slot order by n desc, slot) as slots from (select user_id, {_SLOT} as slot, count(*) as n from events group by all) where slot is not null group by user_id""")
def w02_slot_ranking(t):
    """The first full slice: weekly slots of every user by engagement."""
    return slot_history_ranking(t("events"), "user_id", "ts")


@query("""
with g as (select p_brand as feature, cast(sum(p_retailprice) as double) as gain from part group by p_brand)
select feature, gain, round(sum(gain) over (order by gain desc, feature) / (select sum(gain) from g), 9) as cum, round(sum(gain) over (order by gain desc, feature) / (select sum(gain) from g), 9) <= 0.8 as kept from g""")
def w03_e11_cumulative_gain(t):
    return ra.cumulative_share(t("part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum(F.col("p_retailprice").cast("double")).alias("gain")))


@query("""
with e as (select list_sort(list_distinct(quantile_cont(cast(p_retailprice as double), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from part)
select p_partkey, cast(len(list_filter(e[2:len(e) - 1], lambda x: p_retailprice > x)) as int) as bin from part, e""")
def w04_quantile_bins(t):
    return ra.quantile_bins(t("part"), "p_retailprice", 10).select("p_partkey", "bin")


@query("select c.c_custkey, coalesce(k.code, -1) as code from customer c left join (select c_mktsegment, cast(dense_rank() over (order by c_mktsegment) - 1 as int) as code from (select distinct c_mktsegment from customer where c_custkey % 2 = 0)) k using (c_mktsegment)")
def w05_category_codes(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return ra.encode_category(c, ra.category_codes(c.filter("c_custkey % 2 = 0"), "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "code")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def t02_top_20(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("select arg_max(o_orderpriority, s) as best, arg_min(o_orderpriority, s) as worst from (select o_orderpriority, sum(o_totalprice) as s from orders group by 1)")
def t03_argmax(t):
    s = t("orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return s.agg(F.max_by("o_orderpriority", "s").alias("best"), F.min_by("o_orderpriority", "s").alias("worst"))


@query()
def t06_exact_sample(t):
    return ra.exact_sample(t("orders"), "o_orderkey", 1000, 42).select("o_orderkey")


@query("select user_id, 'a' as part, 1.0::double as weight from events where event_type = 'click' union all select user_id, 'b', 0.5 from events where event_type = 'purchase'")
def u01_u02_weighted_union(t):
    e = t("events")
    cut = lambda kind, part: e.filter(F.col("event_type") == kind).select("user_id", F.lit(part).alias("part"))
    return jo.with_pseudo(cut("click", "a"), cut("purchase", "b"))


@query("select distinct o_custkey from orders")
def u04_distinct_keys(t):
    return t("orders").select("o_custkey").distinct()


@query(f"select a.event_id, coalesce(cast(a.s = b.s as int), 0) as same from (select event_id, user_id, {_SLOT} as s from events) a join (select event_id, {_SLOT.replace('ts', 'ts + interval 1 hour')} as s from events) b using (event_id)")
def d02_same_slot(t):
    e = t("events").select("event_id", weekly_slot("ts").alias("a"), weekly_slot(F.col("ts") + F.expr("interval 1 hour")).alias("b"))
    return e.select("event_id", same_slot("a", "b").alias("same"))


# --- metrics and blends ------------------------------------------------------------------------------------------------------------------

_PRED = "(select l_orderkey, l_linenumber, cast(l_extendedprice as double) as y, cast(l_extendedprice as double) * (1 - l_discount) as a, cast(l_extendedprice as double) * (1 + l_tax) as b, cast(l_quantity * 1000 as double) as c, case when l_returnflag = 'R' then 1 else 0 end as k, cast(l_discount as double) as p from lineitem)"


def _pred(t):
    y = F.col("l_extendedprice").cast("double")
    return t("lineitem").select("l_orderkey", "l_linenumber", y.alias("y"), (y * (1 - F.col("l_discount"))).alias("a"), (y * (1 + F.col("l_tax"))).alias("b"), (F.col("l_quantity") * 1000).cast("double").alias("c"), (F.col("l_returnflag") == "R").cast("int").alias("k"), F.col("l_discount").cast("double").alias("p"))


@query(f"""
select round(100 * avg(case when abs(y) + abs(a) > 0 then abs(y - a) / ((abs(y) + abs(a)) / 2) else 0 end), 6) as zero, round(100 * avg(case when abs(y) + abs(a) > 0 then abs(y - a) / ((abs(y) + abs(a)) / 2) end), 6) as skip,
  round(100 * avg(abs(y - a) / ((abs(y) + abs(a)) / 2 + 1e-8)), 6) as eps, round(avg(abs(y - a)), 6) as mae,
  round(avg(-(k * ln(greatest(p, 1e-15)) + (1 - k) * ln(1 - greatest(p, 1e-15)))), 6) as log_loss, round(avg(case when p < 0.05 then abs(ln(1 + a) - ln(1 + y)) end), 6) as consistency from {_PRED}""")
def x01_x02_x03_x06_x09_errors(t):
    d = _pred(t).withColumn("ly", F.log1p("y"))
    return d.agg(*[F.round(mt.smape("y", "a", z), 6).alias(z) for z in ("zero", "skip", "eps")], F.round(mt.mae("y", "a"), 6).alias("mae"), F.round(mt.log_loss("k", "p"), 6).alias("log_loss"), F.round(mt.consistency("ly", "a", F.col("p") < 0.05), 6).alias("consistency"))


@query(f"""
with r as (select k, {_RANK.format(c='p')} as r from {_PRED}), s as (select sum(r) filter (where k = 1) as s, count(*) filter (where k = 1) as n1, count(*) filter (where k = 0) as n0 from r)
select round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 9) as auc, round(2 * ((s - n1 * (n1 + 1) / 2) / (n1 * n0)) - 1, 9) as gini from s""")
def x04_x05_auc_gini(t):
    return mt.auc(_pred(t), "k", "p")


@query(f"""
with g as (select p, sum(k) as tp, count(*) as n from {_PRED} group by p), c as (select tp, sum(tp) over (order by p desc) as ct, sum(n) over (order by p desc) as cn from g)
select round(sum(tp / (select sum(tp) from g) * ct / cn), 9) as average_precision from c""")
def x07_average_precision(t):
    return mt.average_precision(_pred(t), "k", "p")


@query(f"""
with r as (select l_orderkey, k, row_number() over w as r, sum(k) over (w rows unbounded preceding) as h from {_PRED} window w as (partition by l_orderkey order by p desc, l_linenumber, y, k)),
a as (select l_orderkey, avg(h / r) as ap from r where k = 1 group by l_orderkey) select round(avg(ap), 9) as map, count(*) as keys from a""")
def x07_mean_average_precision(t):
    d = _pred(t).withColumn("tie", F.struct("l_linenumber", "y", "k"))
    return mt.mean_average_precision(d, "l_orderkey", "k", "p", "tie")


@query(f"""
with s as (select abs(avg(b) - avg(a)) as shift, min(b) as low, corr(a, b) as c from {_PRED})
select 'mean_shift' as "check", round(shift, 6) as value, shift < 5 as pass from s union all select 'minimum', round(low, 6), low >= 0 from s union all select 'correlation', round(c, 6), c > 0.99 from s""")
def x10_checks(t):
    return mt.checks(_pred(t), "a", "b")


@query(f"""
select l_orderkey, l_linenumber, round(exp(0.5 * ln(1 + a) / 2 + 0.5 * ln(1 + b) / 2) - 1, 6) as log_blend, round(0.4 * a + 0.3 * b + 0.3 * c, 6) as price_blend, round((a + b + c) / 3, 6) as mean3,
  round(exp(0.6 * ln(1 + greatest(a, 1e-9)) + 0.4 * ln(1 + greatest(b, 1e-9))) - 1, 5) as fixed from {_PRED}""")
def b01_b02_b06_b09_blends(t):
    d = _pred(t).withColumns({"la": F.log1p("a") / 2, "lb": F.log1p("b") / 2})
    return d.select("l_orderkey", "l_linenumber", F.round(es.blend_log({"la": 0.5, "lb": 0.5}), 6).alias("log_blend"), F.round(es.blend_price({"a": 0.4, "b": 0.3, "c": 0.3}), 6).alias("price_blend"), F.round(es.average("a", "b", "c"), 6).alias("mean3"), F.round(es.blend_scale_fixed({"a": 0.6, "b": 0.4}), 5).alias("fixed"))


_GRID = "(select round(0.3 + i * 0.05, 10) as wa, round(0.3 + j * 0.05, 10) as wb, round(1 - (0.3 + i * 0.05) - (0.3 + j * 0.05), 10) as wc from (select unnest(range(0, 5)) as i), (select unnest(range(0, 5)) as j))"


@query(f"""
select wa::double as w_a, wb::double as w_b, wc::double as w_c, round(100 * avg(abs(y - m) / ((abs(y) + abs(m)) / 2)), 6) as smape from (select wa, wb, wc, y, wa * a + wb * b + wc * c as m from {_PRED}, {_GRID} where wc >= 0.2 - 1e-9 and wc <= 0.5 + 1e-9) group by 1, 2, 3""")
def b03_weight_grid(t):
    out = es.search_weights(_pred(t), ["a", "b", "c"], "y", es.weight_grid(), log=False)
    return out.withColumn("smape", F.round("smape", 6))


@query(f"""
select wa as w_a, 1 - wa as w_b, round(100 * avg(abs(y - m) / ((abs(y) + abs(m)) / 2)), 6) as smape from (select w.wa, y, w.wa * a + (1 - w.wa) * b as m from {_PRED}, (select unnest([0.3, 0.4, 0.5, 0.6, 0.7])::double as wa) w) group by 1, 2 order by smape, w_a limit 1""")
def b05_weight_sweep(t):
    grid = [(w, 1 - w) for w in (0.3, 0.4, 0.5, 0.6, 0.7)]
    out = es.search_weights(_pred(t), ["a", "b"], "y", grid, log=False).withColumn("smape", F.round("smape", 6))
    return es.best(out, "smape")


@query(f"select l_orderkey, l_linenumber, round(({_RANK.format(c='a')} + {_RANK.format(c='b')}) / 2 / (select count(*) from lineitem), 9) as r from {_PRED}")
def b07_rank_average(t):
    return es.rank_average(_pred(t), ["a", "b"], "r").select("l_orderkey", "l_linenumber", F.round("r", 9).alias("r"))


@query("""
with s as (select o_orderpriority as strategy, round(avg(o_totalprice) / 1e6, 9) as score from orders group by 1), b as (select arg_max(strategy, score) as best, max(score) as best_score, max(score) filter (where strategy = '1-URGENT') as simple_score from s)
select best, best_score, simple_score, case when best_score - simple_score >= 0.003 then best else '1-URGENT' end as chosen from b""")
def b10_strategy_choice(t):
    s = t("orders").groupBy(F.col("o_orderpriority").alias("strategy")).agg(F.round(F.avg("o_totalprice") / 1e6, 9).alias("score"))
    return es.decide(s, "1-URGENT")


@query(f"""
select id, round(avg(v), 9) as v, round(stddev_pop(v), 9) as spread from (select l_orderkey * 10 + l_linenumber as id, unnest([ln(1 + a), ln(1 + b)]) as v from {_PRED}) group by id having stddev_pop(v) < 0.05""")
def b12_confident_rows(t):
    long = _pred(t).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.explode(F.array(F.log1p("a"), F.log1p("b"))).alias("v"))
    return es.confident(long, "id", "v").select("id", F.round("v", 9).alias("v"), F.round("spread", 9).alias("spread"))


@query("".join(f"{' union all ' if i else ''}select '{m}' as model, round(avg(abs(y - {m})), 6) as mae, round(100 * avg(abs(y - {m}) / ((abs(y) + abs({m})) / 2)), 6) as smape from {_PRED}" for i, m in enumerate("abc")))
def b13_model_table(t):
    return es.model_table(_pred(t), "y", ["a", "b", "c"])


# --- encoders and splits -------------------------------------------------------------------------------------------------------------------


@query("select p_partkey, round((p_size - (select avg(p_size) from part where p_partkey % 5 <> 0)) / (select stddev_pop(p_size) from part where p_partkey % 5 <> 0), 9) as p_size from part")
def e01_e02_scaler(t):
    p = t("part").select("p_partkey", "p_size")
    return en.Scaler(p.filter("p_partkey % 5 != 0"), ["p_size"]).transform(p).withColumn("p_size", F.round("p_size", 9))


@query("select d.p_partkey, coalesce(f.n, 1) as freq from (select p_partkey, case when p_partkey % 11 = 0 then 'MISSING' else p_brand end as b from part) d left join (select case when p_partkey % 11 = 0 then 'MISSING' else p_brand end as b, count(*) as n from part where p_partkey % 2 = 0 group by 1) f on d.b = f.b")
def e03_frequency(t):
    p = t("part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("b"))
    return en.FrequencyEncoder(p.filter("p_partkey % 2 = 0"), "b").transform(p, "freq").select("p_partkey", "freq")


@query("select o_orderkey, cast(o_orderstatus = 'F' as int) as o_orderstatus_f, cast(o_orderstatus = 'O' as int) as o_orderstatus_o, cast(o_orderstatus = 'P' as int) as o_orderstatus_p from orders")
def e05_one_hot_capped(t):
    new = en.one_hot_capped(t("orders"), "o_orderstatus", ["F", "O", "P"])
    return t("orders").select("o_orderkey", *[c.alias(n.lower()) for n, c in new.items()])


@query("""
with v as (select c_mktsegment as s, count(*) as n from customer where c_custkey % 3 <> 0 group by 1), o as (select list(s order by n desc, s) as levels from v)
select c_custkey, list_transform(levels || ['no level'], lambda s: (s = c_mktsegment)::int::double) as onehot from customer, o""")
def e04_e06_one_hot(t):
    from pyspark.ml.functions import vector_to_array

    c = t("customer").select("c_custkey", "c_mktsegment")
    m = en.one_hot(c.filter("c_custkey % 3 != 0"), ["c_mktsegment"])
    return m.transform(en.with_levels(c, ["c_mktsegment"])).select("c_custkey", vector_to_array("c_mktsegment_onehot").alias("onehot"))


@query("select l_orderkey, l_linenumber, l_quantity, l_tax from lineitem")
def e09_leakage_guard(t):
    li = t("lineitem").withColumn("twice", F.col("l_extendedprice") * 2)
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "twice").drop(*en.leaking(li, "l_extendedprice", ["l_tax", "twice"]))


@query("""
with l as (select l_extendedprice::double as y, (l_extendedprice * 2)::double as twice, (-l_extendedprice)::double as minus, l_tax::double as l_tax, l_quantity::double as l_quantity from lineitem)
select unnest(['twice', 'minus', 'l_tax', 'l_quantity']) as name, unnest([abs(corr(y, twice)) > 0.9, abs(corr(y, minus)) > 0.9, abs(corr(y, l_tax)) > 0.9, abs(corr(y, l_quantity)) > 0.9]) as leaks from l""")
def e09_leaking_columns(t):
    """Which columns tell the target."""
    li = t("lineitem").withColumns({"twice": F.col("l_extendedprice") * 2, "minus": -F.col("l_extendedprice")})
    names = ["twice", "minus", "l_tax", "l_quantity"]
    gone = en.leaking(li, "l_extendedprice", names)
    return li.sparkSession.createDataFrame([(c, c in gone) for c in names], "name string, leaks boolean")


@query()
def e10_label_noise(t):
    return t("labels").select("doc_id", "quality", en.label_noise("doc_id", "quality").alias("noisy"))


@query("""
with s as (select p_partkey, p_size, case when p_partkey % 7 <> 0 then p_retailprice end as pr, p_brand from part), f as (select p_brand, count(*) as n from s where p_partkey % 2 = 0 group by 1)
select s.p_partkey, round(p_size * pr, 6) as prod, round(p_size / (pr + 1e-5), 9) as ratio, cast(pr is null as int) as miss, coalesce(f.n, 1) as freq from s left join f using (p_brand)""")
def e12_claim_engineer(t):
    p = t("part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("pr"), "p_brand")
    out = en.ClaimEngineer(p.filter("p_partkey % 2 = 0"), "p_brand", [("p_size", "pr")], [("p_size", "pr")], ["pr"]).transform(p)
    return out.select("p_partkey", F.round("eng_p_size_x_pr", 6).alias("prod"), F.round("eng_p_size_div_pr", 9).alias("ratio"), F.col("eng_pr_is_missing").alias("miss"), F.col("p_brand_freq").alias("freq"))


@query("""
with v as (select p_retailprice::double as x, ln(1 + p_retailprice::double) as l from part), e as (select quantile_cont(l, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) as e from v),
b as (select len(list_filter(list_distinct(e[2:10]), lambda q: l > q))::int as bin, count(*) as n from v, e group by 1)
select bin, 'val' as split, round(n * 0.2)::bigint as n from b where round(n * 0.2) > 0 union all select bin, 'train', n - round(n * 0.2)::bigint from b""")
def v01_stratified_holdout(t):
    """Rows of either part in each decile of the log price: what can be compared, as the rows follow a hash."""
    s = sp.holdout_by_target(t("part"), "p_partkey", "p_retailprice")
    binned = ra.quantile_bins(s.withColumn("l", F.log1p(F.col("p_retailprice").cast("double"))), "l", 10)
    return binned.groupBy("bin", "split").agg(F.count("*").alias("n"))


@query("""
select quality, fold, (n + 4 - fold) // 5 as n from (select quality, count(*) as n from labels group by quality), (select unnest(range(0, 5))::int as fold)
where (n + 4 - fold) // 5 > 0""")
def v04_stratified_folds(t):
    """Rows of each fold in each class; which rows they are follows a hash."""
    return sp.stratified_k_fold(t("labels"), "doc_id", "quality", 5).groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query("""
with s as (select user_id, count(*) as n from events where user_id is not null group by user_id), o as (select user_id, n, row_number() over (order by n desc, user_id) - 1 as o from s)
select (case when o // 10 % 2 = 0 then o % 10 else 9 - o % 10 end)::int as fold, user_id, n from o""")
def v05_v06_group_folds(t):
    return sp.group_sizes(sp.group_k_fold(t("events"), "user_id", 10), "user_id")


@query("select l_orderkey, round(avg(l_extendedprice), 6) as p from lineitem group by l_orderkey")
def v08_fold_mean(t):
    return sp.fold_mean(t("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("p")), "l_orderkey", "p").withColumn("p", F.round("p", 6))


@query()
def v03_k_fold(t):
    return sp.k_fold(t("orders").select("o_orderkey"), "o_orderkey", 5)


@query("select l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount / 7, 6) as score from lineitem")
def p13_round_scores(t):
    d = t("lineitem").withColumn("score", F.col("l_extendedprice").cast("double") * F.col("l_discount") / 7)
    return d.select("l_orderkey", "l_linenumber", co.round_score("score").alias("score"))


@query(f"""
select wa as w_a, wb as w_b, wc as w_c, round(smape, 6) as smape from (
  select i / 100.0::double as wa, j / 100.0::double as wb, (100 - i - j) / 100.0::double as wc, 100 * avg(abs(y - m) / ((abs(y) + abs(m)) / 2)) as smape
  from (select i, j, y, i / 100.0::double * a + j / 100.0::double * b + (100 - i - j) / 100.0::double * c as m from {_PRED}, (select unnest(range(0, 101)) as i), (select unnest(range(0, 101)) as j) where i + j <= 100) group by i, j)""")
def b04_simplex_grid(t):
    out = es.search_weights(_pred(t), ["a", "b", "c"], "y", es.simplex_grid(), log=False)
    return out.withColumn("smape", F.round("smape", 6))


@query(f"select l_orderkey, l_linenumber, y, a, b, round({_RANK.format(c='a')} / (select count(*) from lineitem), 9) as a_rank, round({_RANK.format(c='b')} / (select count(*) from lineitem), 9) as b_rank from {_PRED}")
def b08_meta_features(t):
    out = es.meta_features(_pred(t).select("l_orderkey", "l_linenumber", "y", "a", "b"), ["a", "b"])
    return out.select("l_orderkey", "l_linenumber", "y", "a", "b", F.round("a_rank", 9).alias("a_rank"), F.round("b_rank", 9).alias("b_rank"))


@query("select conv_id, turn, length(text) as n from conversations order by conv_id, turn limit 5")
def t01_t07_sort_and_preview(t):
    return t("conversations").select("conv_id", "turn", F.length("text").alias("n")).orderBy("conv_id", "turn").limit(5)
