"""Sharding: a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minewright.llm.common import ALIKE, materialize, new_path, with_copy_number


def offsets(counts: DataFrame, group: int = 1024) -> DataFrame:
    """counts (_bucket, _n) plus _offset, the rows of all lower buckets.

    Summed in two levels, so that no task sees more than `group` buckets or all groups' totals.
    """
    counts = counts.withColumn("_group", F.expr(f"_bucket div {group}"))
    totals = counts.groupBy("_group").agg(F.sum("_n").alias("_total"))
    before = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_group", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return counts.join(totals, "_group").select("_bucket", "_n", (F.col("_base") + F.col("_before")).alias("_offset"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 2 << 20) -> DataFrame:
    """docs plus shard (int) and slot (long): all rows in uniformly random order, dealt to the shards.

    Pass 1 scatters records by a seeded hash of id and text over so many buckets that one holds
    `bucket_bytes` on average. Pass 2 draws a Fisher-Yates permutation of each bucket's records.
    The permutation is written to the shared folder before it is used, so a lost task can't draw it
    anew. A record's place in the whole order is its bucket's offset plus its permuted index. Shards are
    consecutive ranges of places: with n rows, the first n mod shards of them hold n div shards + 1 rows,
    the others one less; slots count from a shard's first place. So row counts differ by one at most,
    slots have no gaps, and a bucket lies in one shard or at a border, where it can be written at once.
    Equal texts aren't kept together: they are spread like all others.

    Nulls: a null id or text is hashed as such. Records that are alike in both share a bucket; where they are many, they are
    numbered among themselves (see with_copy_number()) and scattered by their number as well, so repeats of one row don't fill a
    bucket. Either way the order is the same however rows are dealt. Which of the alike ones stands at which of their places is open. Very long texts: a record must fit into a row, and a bucket holds at least one.
    Columns named shard or slot in the input are replaced, others kept, whatever their names. Empty tables
    give no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs = docs.select(*names).toDF(*(inner := [f"c{i}" for i in range(len(names))]))
    key, text = (F.col(inner[names.index(c)]) for c in (id_col, text_col))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    tie = F.xxhash64(F.lit(seed), key, F.crc32(text.cast("binary")))
    same = docs.groupBy(tie.alias("tie")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    total, rows, most = same.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > ALIKE:
        docs = with_copy_number(docs, "copy", key, text)
        tie = F.when(F.col("copy") == 0, tie).otherwise(F.xxhash64(F.lit(seed), key, F.crc32(text.cast("binary")), F.col("copy")))
    each, more = divmod(rows, shards)
    buckets = max(shards, -(-total // bucket_bytes))
    scattered = docs.withColumn("_tie", tie).withColumn("_bucket", F.pmod("_tie", F.lit(buckets)))
    counts = scattered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    placed = offsets(counts).repartition(max(1, min(buckets // 64, 200 + buckets // 2048)), "_bucket").sortWithinPartitions("_bucket")
    # shuffle() is Spark's Fisher-Yates; its stream is fixed by the seed, the task's number and the order within.
    placed = materialize(placed.select("_bucket", "_offset", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), F.lit(seed)).alias("_perm")), "permutations")
    order = W.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), "_tie"), "_tie", key)
    # A task takes some 8 buckets, more only where that would make too many tasks.
    parts = min(buckets, max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(buckets // 8, 50_000)))
    numbered = scattered.repartition(parts, "_bucket").withColumn("_i", F.row_number().over(order))
    joined = numbered.join(placed, "_bucket").withColumn("_place", F.col("_offset") + F.element_at("_perm", F.col("_i")))
    shard_of = f"CASE WHEN _place < {more * (each + 1)} THEN _place div {each + 1} ELSE {more} + (_place - {more * (each + 1)}) div {max(1, each)} END"
    joined = joined.withColumn("_shard", F.expr(shard_of))
    slot = F.col("_place") - F.col("_shard") * each - F.least(F.col("_shard"), F.lit(more))
    return joined.select(*[F.col(i).alias(c) for i, c in zip(inner, names, strict=True)], F.col("_shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; every task writes the buckets that it has shuffled, each in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_files(docs: DataFrame, **options) -> DataFrame:
    """shard(), written by write_shards() to the shared folder and read back."""
    path = new_path(docs.sparkSession, "shards")
    write_shards(out := shard(docs, **options), path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
