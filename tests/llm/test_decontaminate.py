import random

import pytest

from sievelight.llm import decontaminate as dc


def distance(item, text):
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[at] = rng.choice("abcxyz")
        elif kind == 1:
            s.insert(at, rng.choice("abcxyz"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def test_matches_equal_brute_force():
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(k, dc.normal(words(rng.randint(6, 25)))) for k in range(8)] + [(8, "short item")]
    matcher = dc.Matcher(items)
    for _ in range(120):
        k, item = rng.choice(items)
        text = dc.normal(words(rng.randint(0, 20)) + " " + edited(rng, item, rng.randint(0, dc.budget(item) + 3)) + " " + words(rng.randint(0, 20)))
        found = {matcher.ids[n]: (d, a, b) for n, d, a, b in matcher.find(text)}
        for i, t in items:
            d = distance(t, text)
            if d <= dc.budget(t):
                assert found[i][0] == d
                assert distance(t, text[found[i][1] : found[i][2]]) == d
            else:
                assert i not in found


def test_cases(spark, monkeypatch):
    item = "The capital of the invented country is a city by the sea, known for its lamps."
    near = item.replace("invented", "inventive").upper()
    bench = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, item), (None, "a second item, long enough to be looked for in texts")], "item_id bigint, text string")
    rows = [(10, "x " + item.replace(" ", "\n ")), (11, near), (12, "nothing"), (13, None), (14, ""), (10, item), (None, item), (15, "a second item, long enough to be looked for in texts")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, distance string")
    for most in (dc.BLOCK_CHARS, 50):
        monkeypatch.setattr(dc, "BLOCK_CHARS", most)
        got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in dc.contaminated(docs, bench).collect()), key=str)
        expected = [(d, i, 0) for d in (10, 10, None) for i in (1, 4)] + [(11, i, 3) for i in (1, 4)] + [(15, None, 0)]
        assert got == sorted(expected, key=str)
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [12, 13, 14, None]
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 10, 29, 30, 100, 1000])
def test_budget(n):
    assert dc.budget("x" * n) == (int(0.08 * n) if n >= 30 else 0)


def test_long_texts_repeated_rows_and_ties(spark):
    """An item far inside a text of megabytes is found; equal rows report alike; of equal places the first counts."""
    item = "an answer that only the benchmark has, word for word, number 42"
    long = "filler words of no interest " * 60_000
    rows = [(1, long + item + " " + long, "x"), (2, item + " and again " + item, "x"), (2, item + " and again " + item, "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    found = [tuple(r) for r in dc.contaminated(docs, bench).select("doc_id", "item_id", "distance", "match_start").collect()]
    assert sorted(found) == [(1, 7, 0, len(long)), (2, 7, 0, 0), (2, 7, 0, 0)]
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 150)
    items = [(k, f"the item with number {k} is told apart by this tail {k * 7919}") for k in range(12)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id bigint, text string")
    found = dc.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).where("distance = 0").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(k, k) for k in range(12)]
