"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from sievelight.llm import queries as llm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    syllables = {"en": ["the", "ing", "er", "and", "wh", "th"], "fr": ["eau", "é", "ment", "que", "ou", "ç"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    item = prose("en", 40)
    passage = prose("en", 60)
    texts = [(k, prose(lang := rng.choice(["en", "fr"]), rng.randint(60, 200)), lang) for k in range(150)]
    texts += [(200, texts[5][1], texts[5][2]), (201, texts[6][1] + " x", texts[6][2]), (202, prose("en", 50) + " " + item + " " + prose("en", 50), "en")]
    texts += [(k, prose("en", 80) + " " + passage + " " + prose("en", 80), "en") for k in (210, 211)]
    texts += [(220, "1234 5678 !!", "en"), (221, None, "en"), (222, "qzx jqv xzj wqx " * 30, None)]
    root = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in texts], SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, passage


def test_stages(spark, folder):
    root, passage = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, root).persist()
        seen.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        if name == "substring dedup":
            texts = {r["doc_id"]: r for r in docs.collect()}
            assert passage in texts[210]["text"] and passage not in texts[211]["text"] and texts[211]["text"]
            assert all(len(r["text"]) == r["n_chars"] for r in texts.values())
    clean = set(range(150)) | {202, 210, 211}
    assert seen[0] == clean | {200, 201}
    assert seen[1] == clean - {x for x in clean if x not in seen[1]} and 200 not in seen[1] and {5, 6, 202, 210, 211} <= seen[1]
    assert len(seen[1]) >= len(clean) - 2
    assert seen[2] == seen[1] and seen[3] == seen[2] - {202} and seen[4] == seen[3]


def test_run_equals_the_stages(spark, folder):
    root, _ = folder
    rows = corpus_pipeline.run(spark, root).collect()
    assert rows and {r["length"] <= 1024 for r in rows} == {True}
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for each in filled.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length


def test_empty_tables_clashing_names_and_repeated_rows(spark, folder, tmp_path):
    """Further columns keep their names and values; every stage takes an empty table, repeated rows and a very long text."""
    root, _ = folder
    long = " ".join(f"the{k % 97}ing and wh er {k}th" for k in range(40_000))
    docs = spark.read.parquet(f"{root}/documents.parquet")
    extra = docs.union(docs.where("doc_id = 7")).union(spark.createDataFrame([(900, long, "en", None, None)], SCHEMA))
    for name in ("lang_pred", "Score", "n_words", "spans", "print", "key"):
        extra = extra.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    empty = extra.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).count() == 0, name
        extra = stage(spark, extra, root).persist()
        if name != corpus_pipeline.STAGES[-1][0]:
            wrong = extra.where(F.col("lang_pred") != F.concat(F.lit("lang_pred "), F.col("doc_id").cast("string")))
            assert wrong.count() == 0 and [c for c in extra.columns][-6:] == ["lang_pred", "Score", "n_words", "spans", "print", "key"]
            assert extra.where("doc_id = 900").count() == 1
        empty = extra.limit(0)


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(llm.oracle_sql()) <= set(llm.queries())


@pytest.mark.parametrize("name", ["op5_sharding", "op6_substring_dedup"])
def test_sql(spark, name):
    import os

    import duckdb

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got, expected = llm.queries()[name](spark, data).toPandas(), con.sql(llm.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).itertuples(index=False)))
    assert rows(got) == rows(expected)
