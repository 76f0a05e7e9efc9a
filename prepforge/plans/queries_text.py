"""Queries over text and vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as ve
from ..operators.durable import durable
from ..operators.ranks import spread
from ..operators.stats import bounding_box
from .flows import preprocess_catalog
from .registry import query


def _catalog(t):
    """Product texts that follow from part."""
    p = spread(t("part"), "p_partkey")  # a few megabytes of file are millions of parts
    text = F.concat(F.lit("Item Name: "), F.col("p_name"), F.lit("\nBullet Point 1: "), F.col("p_type"), F.lit("\nValue: "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("x250 ml")).otherwise(F.lit(" oz")))
    return p.select(F.col("p_partkey").alias("sample_id"), text.alias("catalog_content"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("http://img/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).alias("image_link"), F.col("p_retailprice").cast("double").alias("price"))


@query(r"select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(nfc_normalize(text), ''), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from documents")
def f01_normalise(t):
    return t("documents").select("doc_id", tx.normalise("text").alias("text"))


@query("""
select p_partkey as sample_id, p_name as item_name, cast(p_size as double) as v0, case when p_size % 2 = 0 then 250.0::double else cast(p_size as double) end as pack_value, case when p_size % 2 = 0 then 'ml' else 'oz' end as pack_unit,
  case when p_size % 2 = 0 then cast(p_size as int) end as pack_count from part""")
def f02_f09_parse_catalog(t):
    c = tx.clean_pack(tx.parse_catalog(_catalog(t)))
    size = t("part").select(F.col("p_partkey").alias("sample_id"), F.col("p_size").cast("double").alias("v0"))
    return c.join(size, "sample_id").select("sample_id", "item_name", "v0", "pack_value", "pack_unit", "pack_count")


@query("""
select p_partkey as sample_id, 'Bullet Point 1: ' || p_type as item_description, case when p_size % 2 = 0 then p_size || 'x250 ml' else p_size || ' oz' end as item_pack,
  case when p_size % 2 = 0 then p_size || 'x250 ml' else p_size || ' oz' end as item_pack_clean, 1 as has_pack from part""")
def f03_f08_catalog_fields(t):
    """Descriptions, packs as found, and packs as they are written again."""
    c = tx.clean_pack(tx.parse_catalog(_catalog(t)))
    return c.select("sample_id", "item_description", "item_pack", "item_pack_clean", "has_pack")


@query(r"""
select doc_id, length(text) as desc_len, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as desc_words, round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / (length(text) + 1e-6), 9) as uppercase_ratio,
  round(length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / (length(text) + 1e-6), 9) as punct_density, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / (length(text) + 1e-6), 9) as digit_ratio from documents""")
def f10_f11_complexity(t):
    c = tx.complexity("text")
    return t("documents").select("doc_id", c["desc_len"].alias("desc_len"), c["desc_words"].alias("desc_words"), *[F.round(c[k], 9).alias(k) for k in ("uppercase_ratio", "punct_density", "digit_ratio")])


def _rounded(x: str, places: int) -> str:
    """SQL for x rounded half up in decimals, as the query rounds: of the shortest number that tells x apart, whatever its size."""
    return f"coalesce(cast(cast(try_cast(cast({x} as varchar) as decimal(38, {places})) as varchar) as double), {x})"


# sums run from the left, as in the query: numbers of 1e15 show the last bit of another order
@query(rf"""
with n as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(\d+(?:\.\d+)?)', 1), lambda x: cast(x as double)) as n from documents),
m as (select doc_id, n, case when len(n) > 0 then list_reduce(n, lambda a, b: a + b) / len(n) else 0.0::double end as mean from n),
s as (select doc_id, n, mean, case when len(n) > 0 then sqrt(list_reduce(list_transform(n, lambda x: (x - mean) * (x - mean)), lambda a, b: a + b) / len(n)) else 0.0::double end as std from m)
select doc_id, len(n) as n_numbers, {_rounded("mean", 6)} as num_mean, {_rounded("std", 4)} as num_std, coalesce(list_max(n), 0) as num_max from s""")
def f12_numbers(t):
    c = tx.numbers("text")
    return t("documents").select("doc_id", c["n_numbers"].alias("n_numbers"), F.round(c["num_mean"], 6).alias("num_mean"), F.round(c["num_std"], 4).alias("num_std"), c["num_max"].alias("num_max"))


@query("select doc_id, " + ", ".join(f"cast(contains(lower(text), '{k}') as int) as kw_{k.replace(' ', '_')}" for k in tx.KEYWORDS) + " from documents")
def f13_keywords(t):
    return t("documents").select("doc_id", *[c.alias(n) for n, c in tx.keywords("text").items()])


@query(r"""
with b as (select doc_id, coalesce(nullif(regexp_extract(text, '^([A-Z][A-Za-z0-9&\-]+)', 1), ''), 'UNKNOWN') as brand from documents)
select doc_id, brand, count(*) over (partition by brand) as brand_freq from b""")
def f14_brand(t):
    from ..operators.joins import look_up

    d = t("documents").select("doc_id", tx.brand("text").alias("brand"))
    return look_up(d, "brand", tx.brand_counts(t("documents"), "text"), "brand", "brand_freq", 1, "brand_freq").select("doc_id", "brand", "brand_freq")


@query("select p_partkey, 'passage: ' || trim(p_name || '. ' || p_type) as combined, case when p_partkey % 2 = 0 then 'img' || p_partkey || '.jpg' else md5('img' || p_partkey) || '.jpg' end as key from part")
def f15_f17_combine_and_key(t):
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("img"), F.col("p_partkey").cast("string")))
    return t("part").withColumn("link", link).select("p_partkey", tx.combine("p_name", "p_type", "passage: ").alias("combined"), tx.cache_key("link").alias("key"))


@query("""
select p_partkey, least(greatest(p_size, 0), 1000)::double as pack_count_c, least(p_retailprice, 10000)::double as pack_value_c, cast(p_size = 1 as int) as is_single_pack, round(p_size * least(p_retailprice, 10000), 6) as pack_count_x_value,
  round(ln(1 + p_size / (least(p_retailprice, 10000) + 1e-6)), 9) as log_count_div_value from part""")
def d09_f18_pack_features(t):
    c = tx.pack_features("p_size", "p_retailprice")
    return t("part").select("p_partkey", *[(F.round(v, 6) if k == "pack_count_x_value" else F.round(v, 9) if k == "log_count_div_value" else v).alias(k) for k, v in c.items()])


@query()
def f18_l1_preprocess_catalog(t):
    c = preprocess_catalog(_catalog(t))
    return tx.tier1(c, tx.brand_counts(c.filter("split = 'train'"), "item_name")).drop("catalog_content")


_HALVES = "(select vec_id, list_transform(embedding[1:32], lambda x: x::double) as a, list_transform(embedding[33:64], lambda x: x::double) as b from embeddings)"


@query(f"""
select vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-8), 6) as a_b_cos, round(sqrt(list_dot_product(a, a)), 6) as a_b_norm_a, round(sqrt(list_dot_product(b, b)), 6) as a_b_norm_b,
  round(sqrt(list_dot_product(a, a)) / (sqrt(list_dot_product(b, b)) + 1e-8), 6) as a_b_norm_ratio, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-8) * ln(1 + greatest(vec_id, 0)), 6) as scaled from {_HALVES}""")
def d03_d06_cross_modal(t):
    h = t("embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    out = ve.all_cross_modal(h, [("a", "b"), ("a", "absent")]).withColumn("scaled", ve.cosine_by_size("a_b_cos", "vec_id"))
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("a_b_cos", "a_b_norm_a", "a_b_norm_b", "a_b_norm_ratio", "scaled")])


@query("""
with e as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)
select vec_id, unnest(range(0, 64))::int as pos, round(unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) as value from e""")
def d07_unit_vectors(t):
    u = t("embeddings").select("vec_id", F.posexplode(ve.unit("embedding")).alias("pos", "value"))
    return u.withColumn("value", F.round("value", 6))


@query("""
with x as (select label, unnest(range(0, 64))::int as pos, unnest(embedding)::double as v, vec_id % 3 <> 0 as m from embeddings)
select label, pos, round(coalesce(sum(v) filter (where m), 0) / greatest(count(*) filter (where m), 1e-9), 6) as value from x group by label, pos""")
def d08_masked_mean(t):
    tokens = t("embeddings").select("label", "embedding", (F.col("vec_id") % 3 != 0).cast("int").alias("m"))
    p = ve.masked_mean(tokens, "label", "embedding", "m")
    return p.select("label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query()
def e07_e08_x08_pca(t):
    e = t("embeddings")
    pca = ve.CentredPca(e.filter("vec_id % 5 != 0"), "embedding", 12)
    return pca.with_error(e.select("vec_id", "embedding"), "latent").select("vec_id", "latent", "latent_rmse", F.lit(sum(pca.explained)).alias("explained"))


@query("select user_id, min(value) as lo, max(value) as hi, count(*) as n from events group by user_id")
def a21_extent_by_key(t):
    return t("events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))


@query("select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, round(min(z), 6) as min_z, round(max(z), 6) as max_z, count(*) as n from (select (l_partkey % s)::double as x, (l_suppkey % s)::double as y, l_extendedprice / 1000 as z from lineitem, (select greatest(ceil(sqrt(count(*) / 15.0)), 4)::bigint as s from lineitem))")
def a21_d10_g24_bounding_box(t):
    b = durable(bounding_box(points(t)))
    return b.select("min_x", "max_x", "min_y", "max_y", F.round("min_z", 6).alias("min_z"), F.round("max_z", 6).alias("max_z"), "n")


def points(t):
    """lineitem as a point cloud over about as many places as a fifteenth of its lines, so that the grid grows with the table."""
    li = t("lineitem")
    side = max(math.ceil(math.sqrt(li.count() / 15.0)), 4)
    return li.select(F.pmod("l_partkey", F.lit(side)).cast("double").alias("x"), F.pmod("l_suppkey", F.lit(side)).cast("double").alias("y"), (F.col("l_extendedprice").cast("double") / 1000).alias("z"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.pmod("l_orderkey", F.lit(3)).cast("int").alias("village"))
