"""URL filter lists with dates: each capture is judged by the list as it stood at fetch time.

Dated list entries (add or remove a pattern) become validity intervals. A capture is looked up under every key that a list may name: its
address, its host, and the host and all its parent domains as domains. An as-of join finds, for each key, the last list change at or before the fetch: list
changes and look-ups are united, sorted by key and time, and the last change is carried forward by a window. The most specific active
entry decides (address, then host, then longer domains before shorter), and of equals a block.

A key may stand in a third of all look-ups (a large host, a top-level domain). Keys with more look-ups than their share of a partition
are split by salts, and only their list changes are repeated for each salt; there are at most 4 such keys for each shuffle partition,
which bounds the table that is broadcast. DataFrame functions only.

Defined cases: captures without url or fetch time match nothing (blocked is false); rows that repeat an id are separate captures; entries
without pattern, time or known action are left out; of changes to one pattern at one time, a removal counts last and a block counts over
an allow; a host of any number of labels is looked up under all its suffixes; an empty list blocks nothing; other columns of both tables are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def address_of(url: Column) -> Column:
    """Host and path, without scheme, port, query and fragment, and without a final slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, "/$", ""))


def intervals(entries: DataFrame, kind: str = "kind", pattern: str = "pattern", action: str = "action", at: str = "at") -> DataFrame:
    """kind, pattern, action, valid_from and valid_to (null: still valid) of each stretch in which a pattern is listed."""
    own = _changes(entries, kind, pattern, action, at)
    later = Window.partitionBy("kind", "pattern").orderBy("at")
    return own.withColumn("valid_to", F.lead("at").over(later)).filter("action != 'remove'").select("kind", "pattern", "action", F.col("at").alias("valid_from"), "valid_to")


def _changes(entries: DataFrame, kind: str, pattern: str, action: str, at: str) -> DataFrame:
    """One change for each pattern and time."""
    own = entries.select(F.col(f"`{kind}`").alias("kind"), F.lower(F.col(f"`{pattern}`")).alias("pattern"), F.col(f"`{action}`").alias("action"), F.col(f"`{at}`").alias("at"))
    own = own.filter("kind in ('address', 'host', 'domain') and pattern is not null and at is not null and action in ('block', 'allow', 'remove')")
    force = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    return own.groupBy("kind", "pattern", "at").agg(F.max_by("action", force).alias("action"))


def _lookups(captures: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """n (a number of the capture), key, at and one row for each kind and pattern that may be listed."""
    own = captures.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("at")).filter("url is not null and at is not null")
    host = host_of(F.col("url"))
    own = own.select("id", "url", "at", host.alias("host"), F.split(host, r"\.").alias("labels")).filter("host != ''")
    lengths = F.sequence(F.lit(1), F.size("labels"))
    domains = F.transform(lengths, lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("labels", -n, n), ".").alias("pattern"), n.cast("int").alias("rank")))
    exact = F.array(
        F.struct(F.lit("address").alias("kind"), F.lower(address_of(F.col("url"))).alias("pattern"), F.lit(10**9 + 1).alias("rank")),
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.lit(10**9).alias("rank")),
    )
    return own.select("id", "url", "at", F.explode(F.concat(exact, domains)).alias("k")).select("id", "url", "at", "k.kind", "k.pattern", "k.rank")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "id", url: str = "url", fetched: str = "fetched_at", kind: str = "kind", pattern: str = "pattern", action: str = "action", at: str = "at") -> DataFrame:
    """key, url, fetched_at, n_active (list entries in force), kind, pattern, action and since of the deciding entry, and blocked."""
    spark = captures.sparkSession
    looked = _lookups(captures, key, url, fetched)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = looked.groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fair = max(1000, total // (4 * parts))
    hot = F.broadcast(counts.filter(F.col("n") > fair).select("kind", "pattern", F.ceil(F.col("n") / fair).cast("int").alias("salts")))  # at most 4 * parts rows
    salted = looked.join(hot, ["kind", "pattern"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "at", "url"), F.col("salts")).cast("int"), F.lit(0)))
    asks = salted.select("kind", "pattern", "salt", "at", F.lit(1).alias("side"), F.lit(None).cast("struct<action:string,since:timestamp>").alias("change"), F.struct("id", "url", "rank").alias("ask"))
    listed = _changes(entries, kind, pattern, action, at).join(hot, ["kind", "pattern"], "left")
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    change = F.struct("action", F.col("at").cast("timestamp").alias("since"))
    ask_type = dict(asks.dtypes)["ask"]
    listed = listed.select("kind", "pattern", "salt", "at", F.lit(0).alias("side"), change.alias("change"), F.lit(None).cast(ask_type).alias("ask"))
    carried = Window.partitionBy("kind", "pattern", "salt").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = listed.unionByName(asks).withColumn("last", F.last("change", ignorenulls=True).over(carried)).filter("side = 1 and last.action != 'remove'")
    best = F.max(F.struct("ask.rank", (F.col("last.action") == "block").cast("int").alias("b"), "kind", "pattern", "last.action", "last.since"))
    verdict = found.groupBy(F.col("ask.id").alias("id"), F.col("ask.url").alias("url"), "at").agg((F.countDistinct("kind", "pattern")).alias("n_active"), best.alias("best"))
    own = captures.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("at"))
    out = own.join(verdict, ["id", "url", "at"], "left")
    return out.select(
        F.col("id").alias(key), F.col("url").alias(url), F.col("at").alias(fetched), F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("best.kind").alias("kind"), F.col("best.pattern").alias("pattern"), F.col("best.action").alias("action"), F.col("best.since").alias("since"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list that follows from the pages themselves: hosts, domains and addresses are added and removed on days that their first page sets."""
    day = lambda n: F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")))
    host = host_of(F.col("url"))
    hosts = pages.groupBy(host.alias("pattern")).agg(F.min("page_id").alias("m")).withColumn("kind", F.lit("host"))
    domains = pages.groupBy(F.substring_index(host, ".", -2).alias("pattern")).agg(F.min("page_id").alias("m")).withColumn("kind", F.lit("domain"))
    addresses = pages.filter("page_id % 40 = 0").groupBy(F.lower(address_of(F.col("url"))).alias("pattern")).agg(F.min("page_id").alias("m")).withColumn("kind", F.lit("address"))
    m = F.col("m")
    named = lambda a, n: F.struct(F.lit(a).alias("action"), day(n).alias("at"))
    host_changes = F.concat(
        F.when(m % 3 != 1, F.array(named("block", m * 13 % 200))).otherwise(F.array(named("allow", m * 5 % 366))),
        F.when(m % 2 == 0, F.array(named("remove", m * 13 % 200 + 60))).otherwise(F.expr("array()")),
        F.when(m % 5 == 0, F.array(named("block", m * 13 % 200 + 120))).otherwise(F.expr("array()")),
    )
    other = F.array(named("block", m * 7 % 300))
    changes = hosts.withColumn("c", F.explode(host_changes)).unionByName(domains.unionByName(addresses).withColumn("c", F.explode(other)))
    return changes.select("kind", "pattern", "c.action", "c.at")


def op2_url_lists(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))) + F.make_dt_interval(hours=(F.col("page_id") % 24).cast("int"))
    out = filter_captures(pages.withColumn("fetched_at", fetched), dated_list(pages), key="page_id")
    return out.select("page_id", "url", F.col("fetched_at").cast("string"), "n_active", "kind", "pattern", "action", F.col("since").cast("string"), "blocked")


_PAGES = r"""
p0 as (
  select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/$', '') as path,
    timestamp '2024-01-01' + to_days(cast(page_id * 37 % 366 as int)) + to_hours(cast(page_id % 24 as int)) as ts from pages),
p as (select *, lower(host || path) as address, string_split(host, '.') as labels from p0)"""

QUERIES = {"op2_url_lists": op2_url_lists}
ORACLE = {
    "op2_url_lists": f"""
with {_PAGES},
h as (select host as pattern, min(page_id) as m from p group by host),
d as (select array_to_string(labels[-2:], '.') as pattern, min(page_id) as m from p group by 1),
a as (select address as pattern, min(page_id) as m from p where page_id % 40 = 0 group by address),
raw as (
  select 'host' as kind, pattern, case when m % 3 <> 1 then 'block' else 'allow' end as action, case when m % 3 <> 1 then m * 13 % 200 else m * 5 % 366 end as n from h
  union all select 'host', pattern, 'remove', m * 13 % 200 + 60 from h where m % 2 = 0
  union all select 'host', pattern, 'block', m * 13 % 200 + 120 from h where m % 5 = 0
  union all select 'domain', pattern, 'block', m * 7 % 300 from d
  union all select 'address', pattern, 'block', m * 7 % 300 from a),
changes as (select kind, pattern, n, arg_max(action, case action when 'remove' then 2 when 'block' then 1 else 0 end) as action from raw group by kind, pattern, n),
iv as (
  select kind, pattern, action, timestamp '2024-01-01' + to_days(cast(n as int)) as valid_from,
    timestamp '2024-01-01' + to_days(cast(lead(n) over (partition by kind, pattern order by n) as int)) as valid_to from changes),
keys as (
  select page_id, ts, 'address' as kind, address as pattern, 1000000001 as rank from p
  union all select page_id, ts, 'host', host, 1000000000 from p
  union all select page_id, ts, 'domain', array_to_string(labels[-k:], '.'), k from (select page_id, ts, labels, unnest(range(1, len(labels) + 1)) as k from p)),
m as (
  select k.page_id, k.rank, iv.* from keys k join iv on k.kind = iv.kind and k.pattern = iv.pattern
  where iv.action <> 'remove' and k.ts >= iv.valid_from and (iv.valid_to is null or k.ts < iv.valid_to)),
best as (select *, row_number() over (partition by page_id order by rank desc) as r, count(*) over (partition by page_id) as n_active from m)
select p.page_id, p.url, strftime(p.ts, '%Y-%m-%d %H:%M:%S') as fetched_at, coalesce(b.n_active, 0) as n_active, b.kind, b.pattern, b.action,
  strftime(b.valid_from, '%Y-%m-%d %H:%M:%S') as since, coalesce(b.action = 'block', false) as blocked
from p left join best b on p.page_id = b.page_id and b.r = 1""",
}
