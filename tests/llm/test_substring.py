import random
import re

import pytest

from sievelight.llm import substring_dedup as sd


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    """For each row: words, and which are covered by windows that a smaller id has."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                x = tuple(w[i : i + 13])
                first[x] = min(first.get(x, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((w, gone))
    return out


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "x.", "ÿ\u2003ÿ"]
    new = lambda n: [rng.choice(vocabulary) + str(rng.randint(0, 99)) for _ in range(n)]
    passages = [new(rng.randint(13, 70)) for _ in range(6)]
    rows = []
    for k in range(80):
        w = new(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, max(0, len(p) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = p[cut:] if rng.random() < 0.5 else p
        rows.append((k if rng.random() < 0.9 else rng.randint(0, 80), rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(3, rows[3][1]), (200, rows[3][1]), (201, rows[5][1] + " " + rows[3][1]), (None, rows[5][1]), (300, None), (301, ""), (302, " \n")]
    rows += [(400 + k, "a b " * 30) for k in range(3)] + [(500, "same " * 100)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = corpus(rng)
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id bigint, text string, SPANS int").repartition(5)
    out = sd.dedup_substrings(df)
    assert "input_SPANS" in out.columns
    got = {r["input_SPANS"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for k, (w, gone) in enumerate(brute(rows)):
        r = got[k]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone)), rows[k]
        assert words(r["text"]) == [x for x, y in zip(w, gone, strict=True) if not y]
        if not any(gone):
            assert r["text"] == rows[k][1]
        covered = [False] * len(w)
        texts = {}
        for d, t in rows:
            if d is not None:
                texts.setdefault(d, []).append(words(t))
        for s in r["spans"]:  # a factor is found word for word at the place that it names
            assert s["words"] >= 13 and s["ref_id"] < rows[k][0]
            own = w[s["start"] : s["start"] + s["words"]]
            at = s["ref_start"]
            assert any(own == x[at : at + s["words"]] for x in texts[s["ref_id"]]) or len(texts[s["ref_id"]]) > 1
            after = s["start"] + s["words"]  # the reference ends or differs there
            assert after == len(w) or not all(x[at : at + s["words"] + 1] == [*own, w[after]] for x in texts[s["ref_id"]])
            covered[s["start"] : s["start"] + s["words"]] = [True] * s["words"]
        assert covered == gone


@pytest.mark.parametrize("fan_in", [sd.FAN_IN, 3])
def test_many_small_blocks_and_ranges(spark, monkeypatch, fan_in):
    monkeypatch.setattr(sd, "FAN_IN", fan_in)
    monkeypatch.setattr(sd, "BLOCKS_A_RANGE", 4)
    rows = corpus(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    out = sd.dedup_substrings(df)
    assert sorted((len(w), sum(g)) for w, g in brute(rows)) == sorted((r["n_words"], r["n_removed"]) for r in out.collect())
    assert sd.dedup_substrings(df.limit(0)).count() == 0


def test_words_at_document_edges():
    import pyarrow as pa

    batch = pa.record_batch({"id": pa.array([1, 2, 3, None]), "t": pa.array(["ab cd", None, "ef\x0bgh", ""])})
    p = sd.Parsed(batch, "id", "t")
    assert p.counts.tolist() == [2, 0, 2, 0]
    assert [bytes(p.data[a:b]) for a, b in zip(p.starts, p.ends, strict=True)] == [b"ab", b"cd", b"ef", b"gh"]
    q = sd.Parsed(batch.slice(2, 1), "id", "t")
    assert (q._hashed(0) == p._hashed(0)[2:]).all() and (q._hashed(1) == p._hashed(1)[2:]).all()


def test_digest(spark):
    import hashlib

    rows = [(1, "a  b\tc"), (2, None)]
    got = {r["doc_id"]: r for r in sd.op6_query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["kept_sha256"] == hashlib.sha256(b"a b c").hexdigest() and got[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_nothing_repeats(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(20)]
    out = sd.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == 20 and not any(r["n_removed"] or r["spans"] for r in out)


def test_factors_are_the_longest(spark):
    """A factor goes on in its document through windows that smaller documents have."""
    p = [f"p{k}" for k in range(90)]
    rows = [(1, p[20:40]), (2, p[50:70]), (5, ["x", *p[:80], "y"]), (7, p[:30] + ["z"] + p[30:60]), (9, [*p, "q"]), (11, p[10:65])]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in sd.dedup_substrings(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == [] and got[5] == [(21, 20, 1, 0), (51, 20, 2, 0)]
    assert got[7] == [(0, 30, 5, 1), (31, 30, 5, 31)]
    assert got[9] == [(0, 80, 5, 1)]  # words 80 to 89 are new
    assert got[11] == [(0, 55, 5, 11)]


def block(rows):
    import pyarrow as pa

    return pa.record_batch({"id": pa.array([r[0] for r in rows], pa.int64()), "t": pa.array([r[1] for r in rows])})


def test_removal_rests_on_the_factors(monkeypatch):
    """Without the factor step nothing is removed."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = " ".join(f"w{k}" for k in range(30))
    rows = block([(1, text), (2, "new " + text + " end")])
    p = sd.Parsed(rows, "id", "t")
    first, second = p.windows()
    mine = p.doc == 1
    order = np.argsort(first[mine])
    owned = {name: sd._bytes(name, x[mine][order]) for name, x in (("hash", first), ("second", second), ("owner", p.doc), ("spot", p.place.astype(np.uint32)))}
    kind = pa.list_(pa.struct([(n, pa.binary()) for n in owned]))
    answers = pa.list_(pa.struct([("doc", pa.int64()), ("segments", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([sd._packed(rows)]), pa.array([[owned]], kind), pa.array([None], answers)], names=["packed", "owned", "answers"])
    run = lambda: next(sd._factored(iter([batch]), "id", "t", to_arrow_schema(StructType.fromDDL(sd.SPANS)))).to_pylist()
    assert [r["n_removed"] for r in run()] == [0, 30] and run()[1]["t"] == "new end"
    monkeypatch.setattr(sd, "factors", lambda *_: [])
    assert [r["n_removed"] for r in run()] == [0, 0] and run()[1]["t"] == rows.column("t")[1].as_py()


def test_a_very_long_text_and_clashing_names(spark):
    """A document of 300,000 words, with a passage of another one, a block alone."""
    rng = random.Random(4)
    long = [f"{rng.getrandbits(40):x}" for _ in range(300_000)]
    rows = [(2, " ".join(long[1000:1050]), "a"), (1, " ".join(long), "b"), (3, " ".join(long[5:200]), None)]
    got = {r["doc_id"]: r for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3)] == [0, 50, 195] and got[1]["n_words"] == 300_000 and got[2]["input_n_words"] == "a"


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        sd.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
