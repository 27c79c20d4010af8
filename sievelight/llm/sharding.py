"""Operator 5: jump consistent hashing of rows to shards, in SQL expressions only.

The shard of a row depends on its key and the shard count alone; when a shard
is appended, a row either stays or moves to the new shard.

Defined cases: a key that is no integer counts as its 64-bit hash; a null key counts as 0; a null text has size 8 and checksum 0;
repeated rows share a shard and take different slots; an empty table gives an
empty result; clashing input columns are renamed to ``input_<name>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm._common import free_names, settle

#: Multiplier of the 64-bit generator that defines jump consistent hashing.
MULTIPLIER = 2862933555777941757
#: Rows of a shard are ordered by this many hash buckets first, so no window holds a whole shard.
SLOT_BUCKETS = 4096
#: Jumps tried in the first pass; the few longer chains run the exact rest.
FIRST_JUMPS = 16


def _next_state(h: str, l: str) -> tuple[str, str]:
    """SQL for the high and low 32 bits of (h:l) * MULTIPLIER + 1 mod 2^64, free of overflow."""
    ch, cl = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    c1, c0 = cl >> 16, cl & 0xFFFF
    d1, d0 = ch >> 16, ch & 0xFFFF
    low = f"({l} * {c0}L + shiftleft(({l} * {c1}L) & 65535L, 16) + 1L)"
    carry = f"(shiftright({low}, 32) + shiftright({l} * {c1}L, 16))"
    by_low = f"({h} * {c0}L + shiftleft(({h} * {c1}L) & 65535L, 16))"
    by_high = f"({l} * {d0}L + shiftleft(({l} * {d1}L) & 65535L, 16))"
    return f"(({carry} + {by_low} + {by_high}) & 4294967295L)", f"({low} & 4294967295L)"


def _jumps(start: str, steps: int, shards: int) -> str:
    """SQL that advances a state struct (h, l, b, j) by up to ``steps`` jumps."""
    h, l = _next_state("s.h", "s.l")
    step = (
        f"(s, i) -> if(s.j >= {shards}L, s, "
        f"transform(array(named_struct('h', {h}, 'l', {l}, 'b', s.j)), s -> named_struct('h', s.h, 'l', s.l, 'b', s.b, "
        f"'j', cast(floor((s.b + 1L) * (2147483648D / (shiftright(s.h, 1) + 1L))) as bigint)))[0])"
    )
    return f"aggregate(sequence(1, {steps}), {start}, {step})"


def integer_key(df: DataFrame, key: str) -> str:
    """SQL of a column as a 64-bit integer."""
    name = f"`{key}`"
    return name if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else f"if({name} is null, 0L, xxhash64({name}))"


def jump_hash(key: str, shards: int) -> Column:
    """Shard from 0 to ``shards`` - 1 of the 64-bit integer that SQL expression ``key`` gives."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = f"coalesce(cast({key} as bigint), 0L)"
    start = f"named_struct('h', shiftrightunsigned({k}, 32), 'l', {k} & 4294967295L, 'b', -1L, 'j', 0L)"
    first = _jumps(start, min(FIRST_JUMPS, shards), shards)
    return F.expr(
        f"transform(array({first}), t -> if(t.j >= {shards}L, t.b, {_jumps('t', shards, shards)}.b))[0]"
    ).cast("int")


def slot_bucket(key: str) -> Column:
    """Bucket of a key in the order of slots: from the generator's first value."""
    k = f"coalesce(cast({key} as bigint), 0L)"
    h, _ = _next_state(f"shiftrightunsigned({k}, 32)", f"({k} & 4294967295L)")
    return F.expr(f"{h} % {SLOT_BUCKETS}")


def with_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard and grown_shard; a projection, without any shuffle."""
    docs = free_names(docs, ["size", "text_crc32", "law", "shard", "grown_shard"])
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "*",
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(integer_key(docs, key), shards).alias("shard"),
        jump_hash(integer_key(docs, key), shards + 1).alias("grown_shard"),
    )


def with_slots(sharded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in order of (bucket, key, size, checksum).

    Rows are first summed by (shard, bucket, key, size, checksum, scan task); a
    window never holds more than a bucket's different keys, or one task's
    copies of one row, so a key with a third of all rows stays spread out.
    Only a table of at most shards x SLOT_BUCKETS rows is broadcast.
    """
    sharded = free_names(sharded, ["slot"])
    rows = settle(sharded.withColumns({"_bucket": slot_bucket(integer_key(sharded, key)), "_task": F.spark_partition_id()}))
    by = ["shard", "_bucket", F.col(key).alias("_key"), "size", "text_crc32", "_task"]
    groups = settle(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    buckets = groups.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select("shard", "_bucket", before.alias("_bucket_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32", "_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_start", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    starts = starts.join(F.broadcast(offsets), ["shard", "_bucket"]).withColumn("_start", F.col("_start") + F.col("_bucket_start"))
    same = (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("size") == F.col("_s")) & (F.col("text_crc32") == F.col("_c")) & (F.col("_task") == F.col("_t"))
    single = starts.select(F.col("_key").alias("_k"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), F.col("_task").alias("_t"), "_start")
    rank = F.row_number().over(Window.partitionBy(key, "size", "text_crc32", "_task").orderBy(F.lit(0))) - 1
    placed = rows.join(single, same).withColumn("slot", (F.col("_start") + rank).cast("long"))
    return placed.drop("_bucket", "_task", "_k", "_s", "_c", "_t", "_start")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, law, shard, grown_shard and slot."""
    return with_slots(with_shards(docs, shards, key, text), key)


def op5_query(docs: DataFrame) -> DataFrame:
    """The digest of query op5."""
    narrow = with_shards(docs.select("doc_id", "text")).drop("text")
    return with_slots(narrow).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
