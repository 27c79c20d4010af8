import zlib
from collections import Counter

from pyspark.sql import functions as F

from sievelight.llm import sharding


def jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 300), *(k * 7919**4 % (1 << 62) for k in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for shards in (1, 2, 24, 25, 1000):
        for k, s in df.select("k", sharding.jump_hash("k", shards)).collect():
            assert s == jump(k, shards), (k, shards)


def test_long_chains_are_finished(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_JUMPS", 1)
    for k, s in spark.range(300).select("id", sharding.jump_hash("id", 64)).collect():
        assert s == jump(k, 64)


def test_shards(spark):
    rows = [(k, "t" * (k % 5)) for k in range(500)] + [(7, "same")] * 300 + [(9, None), (None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("SHARD", F.lit("old")).repartition(7)
    out = sharding.shard_documents(df)
    assert "input_SHARD" in out.columns
    got = out.collect()
    assert len(got) == len(rows)
    slots = Counter()
    for r in got:
        slots[r["shard"]] += 1
        body = (r["text"] or "").encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "key"
        assert r["shard"] == jump(r["doc_id"] or 0, 24) and r["grown_shard"] in (r["shard"], 24)
    for shard, n in slots.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_balance(spark):
    counts = [r[1] for r in spark.range(48000).groupBy(sharding.jump_hash("id", 24)).count().collect()]
    assert len(counts) == 24 and max(counts) < 1.1 * 2000 and min(counts) > 0.9 * 2000


def test_main_path_has_no_python(spark):
    plan = sharding.shard_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_keys_of_other_types_and_very_long_texts(spark):
    """A key that is no integer is hashed; a null key counts as 0."""
    rows = [(f"k{i % 50}", "x" * (10 if i else 3_000_000), i) for i in range(200)] + [(None, "y", -1), (None, "y", -1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, SHARD int")
    out = sharding.shard_documents(df, 7)
    got = out.collect()
    assert len(got) == 202 and "input_SHARD" in out.columns and {r["shard"] for r in got if r["doc_id"] is None} == {0}
    of = {}
    for r in got:
        assert of.setdefault(r["doc_id"], r["shard"]) == r["shard"] and r["grown_shard"] in (r["shard"], 7)
    for shard in set(of.values()):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert max(r["size"] for r in got) == 3_000_008 and len(set(of.values())) > 3
