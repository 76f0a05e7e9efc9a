"""Importance resampling towards a target: documents whose hashed n-grams are likelier in the target are drawn more often.

Features are the runs of 1 to n consecutive words of a text, hashed to buckets by the crc32 of their bytes. All documents and all texts of
the target count their features by bucket: a task adds its rows up and sends at most a row for each bucket. A bucket's gain is the log ratio
of its smoothed shares; a document's weight is the mean gain of its features, and its score adds Gumbel noise of its id, so that the
highest scores are a sample without replacement.

The work on texts is done by Arrow kernels on slices of a megabyte, or of one longer text: ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode turn texts into words and indices into their dictionary. Shifted indices form n-grams, of which only distinct pairs of
a shorter n-gram and a word are hashed (crc32 goes on from the shorter one's); take looks gains up, and sums go by document.

Ranks come from one range partition of (score, doc_id) with the rows before each partition; there is no global window. What is broadcast is the
table of gains, BUCKETS numbers, and one number for each partition.

Defined cases: null and blank texts have no features, weight 0, and are not drawn; an empty target or corpus leaves the smoothing; rows
without doc_id take the noise of an empty id and come last among ties; rows that repeat a doc_id each have a row and a rank, fewer features
first among ties; an empty table gives no rows; texts are read whole; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .conversations import CRC_STEPS, crc_sql
from .textcore import column_bytes, parts

NGRAM, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: What is not a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE = 1 << 20


def features(texts: pa.Array, n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of n-grams the row and crc32 of every occurrence."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), SEPARATORS)
    flat, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded, rows = flat.filter(real).dictionary_encode(), rows.filter(real).to_numpy(zero_copy_only=False)
    word, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, known), np.int64, len(known))
    gram = word
    out = [(rows, crc[gram])]
    for k in range(1, n):
        # the gram at i goes on with the word at i + k; distinct pairs get numbers of their own
        inside = np.flatnonzero(rows[:-k] == rows[k:]) if len(rows) > k else np.zeros(0, np.int64)
        pairs = np.full(len(rows), -1)
        pairs[inside] = gram[inside] * max(len(known), 1) + word[inside + k]
        distinct, gram_of = np.unique(pairs[inside], return_inverse=True)
        crc = np.fromiter((zlib.crc32(b" " + known[p % len(known)], int(crc[p // len(known)])) for p in distinct.tolist()), np.int64, len(distinct))
        gram = np.zeros(len(rows), np.int64)
        gram[inside] = gram_of
        out.append((rows[inside], crc[gram_of]))
    return np.bincount(rows, minlength=len(texts)), out


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    _, off = column_bytes(column)
    for lo, hi in parts(off, SLICE):
        yield lo, column.slice(lo, hi - lo)


def bucket_counts(docs: DataFrame, text: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n (features in it) over all texts, for buckets that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                for _, crc in features(part, n)[1]:
                    total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    shared.tune(docs.sparkSession)
    return shared.pick(docs, text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's share in the target and in the source, from bucket counts (at most buckets rows each)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, source), (t, target)):
        for r in df.collect():
            counts[r.bucket] = r.n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((x + 1) * all_s / ((y + 1) * all_t))) for x, y in zip(t.astype(float).tolist(), s.astype(float).tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """key, n_words, n_features and weight (floored mean of gains) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            for lo, part in _slices(batch.column(1)):
                n_words, grams = features(part, n)
                total, count = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for rows, crc in grams:
                    if len(rows):
                        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                        total[rows[begin]] += np.add.reduceat(gain.take(crc % len(gain)), begin)
                        count[rows[begin]] += np.diff(np.r_[begin, len(rows)])
                yield pa.RecordBatch.from_pydict({key: batch.column(0).slice(lo, len(part)), "n_words": pa.array(n_words), "n_features": pa.array(count), "weight": pa.array(total // np.maximum(count, 1))})

    shared.tune(docs.sparkSession)
    return shared.pick(docs, key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_words long, n_features long, weight long")


def drawn(weighted: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Every row with its score, and the rank of those that are drawn: percent of the rows with least_words words or more, by falling score."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = weighted.withColumn("score", F.col("weight") + noise).withColumn("later", (F.col("n_words") < least_words).cast("int"))
    order = ["later", F.desc("score"), F.col(key).asc_nulls_last(), "n_features"]
    n = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: ranges are sampled before they are dealt, and rows are counted by range
    dealt = shared.durable(shared.durable(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    sizes = {r.part: (r.n, r.fit) for r in dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(1 - F.col("later")).alias("fit")).collect()}
    before, at = {}, 0
    for part in sorted(sizes):
        before[part] = at
        at += sizes[part][0]
    last = percent * sum(fit for _, fit in sizes.values()) // 100
    offsets = weighted.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "part").select(key, "n_features", "weight", "score", F.when(place <= last, place).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score and rank (null if not drawn) of every document; target: texts of the wanted kind."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, text, n, buckets), buckets)
    return drawn(weights(docs, gain, key, text, n), percent, least_words, seed, key)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLE = {
    "op12_importance_resampling": f"""
with crc_steps as ({CRC_STEPS}), d as (select doc_id, {_WORDS} as ws from documents), e as (select {_WORDS} as ws from benchmark),
w as (select doc_id, unnest(ws) as w from d), v as (select unnest(ws) as w from e),
b as (select w, {crc_sql("w")} % 10000 as b from (select distinct w from (select w from w union all select w from v)), crc_steps),
s as (select b, count(*) as s from w join b using (w) group by b), t as (select b, count(*) as t from v join b using (w) group by b),
n as (select (select coalesce(sum(s), 0) from s)::double as alls, (select coalesce(sum(t), 0) from t)::double as allt),
g as (select distinct b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (alls + 10000) / ((coalesce(s, 0) + 1)::double * (allt + 10000)))) as g from b left join s using (b) left join t using (b), n),
f as (select doc_id, count(*) as n, floor(sum(g)::double / count(*)) as weight from w join b using (w) join g using (b) group by doc_id),
r as (select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join f on f.doc_id = d.doc_id),
p as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_features >= 20)
select r.*, case when rank <= floor(10 * (select count(*) from p) / 100) then rank end as rank from r left join p on p.doc_id = r.doc_id""",
}
