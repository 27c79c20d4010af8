import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import language_id as li


def symbols(text):
    """Symbols of a text by the definition, with the spaces around it."""
    out = [0] * li.ORDER
    for c in (text or "").lower():
        s = int(li._symbols()[ord(c)])
        if s or out[-1]:
            out.append(s)
    return out + [0] if out[-1] else out


def test_grams_by_definition():
    texts = ["Ab, c", "", None, "  x!! y", "é1ß", "!!", "日本 語", "a" * 50]
    grams, owner, letters = li.stream(texts)
    for k, t in enumerate(texts):
        s = symbols(t)
        expected = [sum(x << li.BITS * (li.ORDER - 1 - i) for i, x in enumerate(s[p - li.ORDER + 1 : p + 1])) for p in range(li.ORDER, len(s))]
        assert grams[owner == k].tolist() == expected, t
        assert letters[k] == sum(c.isalpha() for c in (t or "").lower())


def kneser_ney(counts, order, gram, alphabet, tables):
    """Interpolated Kneser-Ney by dictionaries; ``gram`` is a tuple."""
    if order == 0:
        return 1 / alphabet
    own, discount = tables[order]
    context = gram[:-1]
    total = sum(n for g, n in own.items() if g[:-1] == context)
    rest = kneser_ney(counts, order - 1, gram[1:], alphabet, tables)
    if not total:
        return rest
    kinds = sum(1 for g in own if g[:-1] == context)
    return max(own.get(gram, 0) - discount, 0) / total + discount * kinds / total * rest


def test_probabilities_equal_brute_force():
    texts = ["abc abd", "aab", "cab bad"]
    grams, owner, _ = li.stream(texts)
    keys, n = np.unique(grams, return_counts=True)
    model = li.LanguageModel(["x"], np.zeros(len(keys), np.int64), keys, n)
    unpack = lambda g: tuple(int(g) >> li.BITS * (li.ORDER - 1 - k) & 0xFFF for k in range(li.ORDER))
    counts = {unpack(g): int(k) for g, k in zip(keys, n, strict=True)}
    tables, own = {}, counts
    for order in range(li.ORDER, 0, -1):
        once, twice = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        tables[order] = (own, min(max(once / max(1, once + 2 * twice) if once else 0.5, 0.1), 0.95))
        lower = {}
        for g in own:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        own = lower
    alphabet = len(tables[1][0]) + 1
    tests, _, _ = li.stream(["abc", "bbb zz", "dab"])
    got = model.log_probabilities(tests)[:, 0]
    for g, p in zip(tests, got, strict=True):
        assert np.exp(p) == pytest.approx(kneser_ney(counts, li.ORDER, unpack(g), alphabet, tables), rel=1e-4)


def test_table_finds_all():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    table = li.Table(keys, np.arange(len(keys), dtype=np.float32)[:, None])
    at, found = table.find(keys)
    assert found.all() and (table.values[at, 0] == np.arange(len(keys))).all()
    assert not table.find(keys + np.uint64(1 << 61))[1].any()
    assert not li.Table(keys[:0], np.zeros((0, 1), np.float32)).find(keys[:5])[1].any()


def test_held_out_rule(spark):
    import zlib

    for k, flag in spark.range(50).select("id", li.held_out("id")).collect():
        assert flag == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_cases(spark):
    rows = [(k, f"the quick brown fox number {w} jumps", "en") for k, w in enumerate("abcdefghij")] + [(20 + k, f"der schnelle fuchs {w} springt über", "de") for k, w in enumerate("abcdefghij")]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !!", None), (53, "the brown fox", None), (53, "the brown fox", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("Score", F.lit(1))
    out = li.identify(df)
    assert "input_Score" in out.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[50]["lang_pred"] == got[51]["lang_pred"] == got[52]["lang_pred"] == "und" and got[50]["score"] == 0
    assert got[53]["lang_pred"] == "en" and got[25]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert li.identify(df.limit(0)).count() == 0
    unlabelled = li.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_accuracy_and_rejection(spark):
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    out = li.identify(docs).toPandas()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and out.rejected.sum() == 0
    model = li.fit(docs)
    odd = spark.createDataFrame([("xq zjw qpx vkq " * 40,), ("Да и вот так далее " * 20,)], "text string")
    assert all(r["rejected"] for r in li.predicted(odd, model).collect())


@pytest.mark.parametrize("fan_in", [li.FAN_IN, 2])
def test_counts_equal_brute_force(spark, monkeypatch, fan_in):
    from collections import Counter

    monkeypatch.setattr(li, "FAN_IN", fan_in)
    rows = [("abc abd abc", "x"), ("aab", "x"), ("cab bad", "y"), ("abc", "y"), (None, "x"), ("abc", None)] * 3
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    expected, got = Counter(), Counter()
    for t, lang in rows:
        if t and lang:
            expected.update((lang, int(g)) for g in li.stream([t])[0])
    packed = li.gram_counts(df, "text", "lang").collect()
    for r in packed:
        for g, n in zip(np.frombuffer(r["grams"], np.uint64), np.frombuffer(r["counts"], np.int64), strict=True):
            got[r["lang"], int(g)] += int(n)
    assert got == expected and len({(r["lang"], r["range"]) for r in packed}) == len(packed)


def test_models_hold_every_gram_of_all_rows(spark):
    rows = [(f"the quick brown fox number {w} jumps", "en") for w in "abcdefghijklmnopqrst"] * 5 + [(f"der schnelle fuchs {w} springt", "de") for w in "abcdefghijklmnopqrst"]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = li.fit(df).value
    assert model.grams[-1].size == len(np.unique(li.stream([r[0] for r in rows])[0]))
    assert [r[0] for r in model.predict(["der fuchs springt", "the fox jumps"])] == ["de", "en"]


def test_limits_without_documents_to_keep_apart(spark):
    """One labelled text: its language is predicted, and other letters are rejected all the same."""
    one = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    model = li.fit(spark.createDataFrame([(one, "en")], "text string, lang string")).value
    assert model.limits and model.predict([one])[0][0] == "en" and not model.predict([one])[0][4]
    assert model.predict(["xq zjw qpx vkq " * 40])[0][4]


def test_ties_go_to_the_first_language_and_long_texts_are_whole(spark):
    texts = ["alpha beta gamma", "delta epsilon"]
    keys, n = np.unique(li.stream(texts)[0], return_counts=True)
    both = li.LanguageModel(["aa", "bb"], np.repeat([0, 1], len(keys)), np.tile(keys, 2), np.tile(n, 2))
    assert [r[0] for r in both.predict(["alpha", "zzz"])] == ["aa", "aa"] and both.predict(["alpha"])[0][1] == pytest.approx(0.5)
    rows = [(1, "der schnelle fuchs springt über den hund " * 5, "de"), (4, "the quick brown fox jumps over the dog " * 5, "en"), (2, "the quick brown fox " * 10 + "der schnelle fuchs springt " * 60_000, None)]
    got = {r["doc_id"]: r for r in li.predicted(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), li.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))).collect()}
    assert got[2]["lang_pred"] == "de" and got[2]["n_letters"] == 160 + 23 * 60_000
