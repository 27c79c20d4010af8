import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sievelight.llm import simhash
from sievelight.llm.components import components


def brute_fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = low.encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_shingle_hash_is_sparks(spark):
    assert xxhash.xxh64_intdigest("é b c d".encode(), 42) == spark.range(1).select(F.xxhash64(F.lit("é b c d"))).first()[0] % (1 << 64)


@pytest.mark.parametrize("text", [None, "", " ", "One", "A b C", "a b c d", "a b c d e", "É É É É é", "w " * 2000, "x\u2003y\x1cz A\x0bB"])
def test_fingerprints(text):
    h = simhash.shingle_hashes(text)
    assert simhash.majority(np.array(h, np.uint64), np.array([len(h)]))[0] == brute_fingerprint(text)


def test_majority_over_many_documents():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 255, 256, 0, 700, 3])
    h = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = simhash.majority(h, counts), 0
    for n, f in zip(counts, got, strict=True):
        part = h[at : at + n]
        at += n
        assert f == sum(1 << b for b in range(64) if 2 * int((part >> np.uint64(b) & np.uint64(1)).sum()) > n)


def near(rng, n):
    """Random fingerprints with chains, rings and a dense group."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    center = rng.getrandbits(64)
    out += [center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)]
    return [*out, 0, 1, (1 << 64) - 1, (1 << 64) - 2]


@pytest.mark.parametrize("words", [1, 3])
@pytest.mark.parametrize("rows", [1 << 18, 64])
def test_components_equal_brute_force(spark, monkeypatch, rows, words):
    monkeypatch.setattr(simhash, "MAX_GROUP_ROWS", rows)
    radius = 4 if words == 1 else 40
    rng = random.Random(3)
    prints = sorted(set(near(rng, 250)))
    if words > 1:
        prints = sorted({p << 128 | rng.getrandbits(128) for p in prints} | {p << 128 | 5 for p in prints})
    size = 8 * words
    df = spark.createDataFrame([(bytearray(x.to_bytes(size, "big")), x.bit_count()) for x in prints], "print binary, population int")
    links = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in simhash.fingerprint_links(df, radius, words).collect()]
    at = {x: k for k, x in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(prints))] == brute_components(prints, radius)


def test_a_forest_not_all_pairs():
    dense = np.array([[1 << b] for b in range(60)] + [[0]], np.uint64)
    assert len(simhash.linked(dense, None, 4)) == 60
    assert len(simhash.linked(dense[:30], dense[30:], 4)) == 60


def test_near_copies_by_similarity(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, expected = [], {}
    for k in range(120):
        w = fresh(rng.randint(100, 400))
        v = list(w)
        for at in rng.sample(range(len(v)), max(1, len(v) // (60 if k % 2 else 8))):
            v[at] = fresh(1)[0]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        expected[2 * k + 1] = jaccard(shingles(w), shingles(v))
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(2 * k in kept for k in range(120))
    assert all(d not in kept for d, j in expected.items() if j >= 0.83)
    assert all(d in kept for d, j in expected.items() if j < 0.5)


def test_star_steps(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200 + k) for k in range(50)] + [(300 + k, 300 + (k * 7 + 3) % 40) for k in range(40)] + [(5, 5), (1, 0)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def documents():
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 300))) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + k, t.upper()) for k, t in enumerate(base[:10])] + [(200 + k, t + " tail") for k, t in enumerate(base[:20])]
    rows += [(300, None), (301, ""), (302, " \n"), (None, base[3]), (3, base[3]), (3, base[3])]
    return rows


def test_documents_equal_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, component_id int").repartition(4)
    got = simhash.near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = brute_components(prints, 4)
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    expected = sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r["doc_id"] for r in simhash.keep_first(df).collect()]
    least = {r["component_id"] for r in simhash.near_duplicates(df, **simhash.NEAR).collect()}
    assert sorted(k for k in kept if k is not None) == sorted(least) and kept.count(None) == 1


def fresh(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = fresh(rng, 1)[0]
    return out


def equal_brute_force(spark, texts):
    """Components of the near copies by sets of five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id bigint, text string")
    got = dict(simhash.near_duplicates(df, **simhash.NEAR).select("doc_id", "component_id").collect())
    kept = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    return got == {k: find(k) for k in range(len(texts))} and kept == {find(k) for k in range(len(texts))}


def test_links_are_verified_similarities(spark):
    rng = random.Random(21)
    texts = [fresh(rng, 100) for _ in range(48)]
    texts += [changed(rng, w, k % 6 + 1) for k, w in enumerate(texts)]  # from 0.9 to 0.5
    base = fresh(rng, 120)
    texts += [changed(rng, base, 4) for _ in range(40)]  # all resemble each other, few pairs are as similar as 0.8
    assert equal_brute_force(spark, texts)


def test_short_texts_and_repeated_lines_are_found(spark):
    rng = random.Random(22)
    texts = []
    for n in [8] * 60 + [10] * 30:  # one word more: similarities of 0.8 and 0.857
        w = fresh(rng, n)
        texts += [w, w + fresh(rng, 1)]
    for k in range(20):  # a line appended three or five times: 0.87
        w, line = fresh(rng, 100), fresh(rng, 10)
        texts += [w, w + line * (3 + 2 * (k % 2))]
    assert equal_brute_force(spark, texts)
