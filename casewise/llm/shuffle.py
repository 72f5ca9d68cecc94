"""Two-pass external shuffle into shards.

Pass one scatters records uniformly over memory-sized buckets by a seeded hash; pass two
permutes each bucket by Fisher-Yates, seeded by its number, and writes it. Buckets end to end
are the shuffled order, which is cut into shards of equal counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import Scratch

BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 20  # beyond, buckets grow: their counts (8 bytes each) go to every task


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0 .. n - 1: each place, from the last, swaps with one up to it."""
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(1, n + 1))
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draws[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def _permute(starts: np.ndarray, seed: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        expected = int(starts[bucket + 1] - starts[bucket])
        if len(table) != expected:
            raise RuntimeError(f"bucket {bucket} has {len(table)} rows, {expected} were counted: the input isn't the same at each reading")
        table = table.sort_by([("place", "ascending")])  # shuffled blocks arrive in any order
        table = table.take(pa.array(fisher_yates(len(table), seed, bucket)))
        return pa.table({"at": pa.array(starts[bucket] + np.arange(len(table))), "record": table.column("record")})

    return run


def external_shuffle(docs: DataFrame, path: str, shards: int = 16, seed: int = 11, text_col: str = "text") -> DataFrame:
    """Write all rows below ``path``, a folder for each shard; return them as read back.

    Columns: shard, slot (gapless from 0 within a shard), record (the whole input row as a
    struct, so no name can clash). Shards' counts are at most one apart. The order depends
    only on the rows and ``seed``; rows equal in all columns are interchangeable. A bucket that is
    over-full, by many rows, many equal ones or a very long text, is dealt over more buckets.
    Null and empty texts are rows like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets_at_least = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns])
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(buckets_at_least, min(MOST_BUCKETS, math.ceil(total / BUCKET_BYTES)))
    keyed = docs.select(F.struct("*").alias("record"), place.alias("place"), size.alias("size"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.lit(buckets)).cast("int"))

    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    full = {r.bucket: math.ceil(r.size / BUCKET_BYTES) for r in sizes if r.size > 4 * max(BUCKET_BYTES, total / buckets)}
    if full:  # dealt over more buckets by other hashes; equal rows, counted first, by their number among their like
        edges = np.cumsum([buckets, *full.values()]).tolist()
        spread = F.broadcast(spark.createDataFrame([(b, at, n) for (b, n), at in zip(full.items(), edges)], "bucket int, first int, spread int"))  # fewer than the buckets
        also = F.xxhash64(F.lit(seed + 2), *[F.col(f"record.`{c}`") for c in docs.columns])
        like = keyed.join(spread, "bucket").groupBy("first", "spread", "place", also.alias("also")).agg(F.first("record").alias("record"), F.first("size").alias("size"), F.count("*").alias("n"))
        like = like.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
        salted = (F.col("first") + F.pmod(F.xxhash64(F.lit(seed + 3), "place", "copy"), F.col("spread"))).cast("int").alias("bucket")
        keyed = keyed.join(spread, "bucket", "left_anti").select("record", "place", "size", "bucket").union(like.select("record", "place", "size", salted))
        buckets += sum(full.values())
        sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(buckets + 1, dtype=np.int64)
    for r in sizes:
        counts[r.bucket + 1] = r.n
    starts = np.cumsum(counts)
    rows = int(starts[-1])
    shared = spark.sparkContext.broadcast(starts)
    permute = lambda table: _permute(shared.value, seed)(table)
    shuffled = keyed.select("bucket", "place", "record").groupBy("bucket").applyInArrow(permute, StructType([StructField("at", LongType()), StructField("record", docs.schema)]))

    small, more = divmod(rows, shards)  # the first shards have one row more
    at, edge = F.col("at"), F.lit(more * (small + 1))
    after = at - edge
    shard = F.when(at < edge, F.floor(at / F.lit(small + 1))).otherwise(F.lit(more) + F.floor(after / F.lit(max(1, small))))
    slot = F.when(at < edge, F.pmod(at, F.lit(small + 1))).otherwise(F.pmod(after, F.lit(max(1, small))))
    placed = shuffled.select(shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), "record")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select("shard", "slot", "record")


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = external_shuffle(docs, Scratch(spark, "shuffle").path("shards"))
    text = F.col("record.text")
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
