import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import packing
from sievelight.llm.queries import tokenizer_path


def naive(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 5, 10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.best_fit(dict(Counter(lengths)), capacity):
        for k in range(n):
            bins[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
    for each in bins.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == naive(lengths, capacity)


def test_segment_tree():
    tree = packing.SegmentTree(10)
    assert tree.tightest(0) is None
    for at in (3, 7, 10):
        tree.mark(at, True)
    assert [tree.tightest(k) for k in range(12)] == [3, 3, 3, 3, 7, 7, 7, 7, 10, 10, 10, None]
    tree.mark(7, False)
    assert tree.tightest(4) == 10


TEXTS = [None, "", " ", "\n \n", "a  b\x1c!x  \n\n y<|endoftext|> z\t\tq", "it's  don't we'll", "«a», b  c.", "é, à! 𝒳", "...a.b,c  d\u00a0e\u2003f", "word " * 3000, "x\x85y", "1234 5,6"]


def reference(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def split(flat, counts):
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_ids_equal_the_tokenizer(monkeypatch):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcé .,\n!'\t#0") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    expected = [reference(t) for t in texts]
    for most in (packing.MEMO, 50):
        monkeypatch.setattr(packing, "MEMO", most)
        packing._memo.cache_clear()
        for _ in range(2):
            assert split(*packing.token_ids(pa.array(texts), tokenizer_path())) == expected
            for i in range(0, len(texts), 7):
                assert split(*packing.token_ids(pa.array(texts)[i : i + 7], tokenizer_path())) == expected[i : i + 7]
    packing._memo.cache_clear()


def test_pack_documents(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, "no id", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id int").repartition(3)
    out = packing.pack_documents(df, tokenizer_path()).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for k, t in enumerate(TEXTS):
        ids = [*reference(t), packing.END_ID]
        pieces = sorted(by[k], key=lambda r: r["piece"])
        if k == 3:
            pieces = pieces[::2]
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == len(ids) and all(r["length"] == 1024 for r in pieces[1:])
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert len(by[3]) == 2 and len(by[None]) == 1
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for each in filled.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) == len(naive([r["length"] for r in out], 1024))
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_pieces_hold_their_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    pieces = packing.to_pieces(df, tokenizer_path(), capacity=4).orderBy("piece").collect()
    ids = [*reference("a b c d e f"), 2]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in pieces] == [ids[:3], ids[3:]]


def test_one_length_stays_spread(spark):
    rows = spark.range(0, 3000, 1, 12).select(F.col("id").alias("doc_id"), F.lit(1024).cast("long").alias("length"))
    out = packing.pack(rows)
    assert out.select("sequence_id").distinct().count() == 3000


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"use_regex": False}, None])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    """A tokenizer that doesn't split where chunks are cut gives its own ids all the same."""
    import json

    from tokenizers import Tokenizer

    said = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    if change is None:
        said["normalizer"] = {"type": "Lowercase"}
    else:
        said["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    assert packing.cuttable(tokenizer_path()) and not packing.cuttable(str(path))
    texts = ["Hello, World! it's  a\n test", "", "é x.", "Same again. Same again."]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, counts = packing.Memo(str(path)).tokens(np.frombuffer(data, np.uint8), offsets)
    plain = Tokenizer.from_file(str(path))
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]
