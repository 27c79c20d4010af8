"""Operator 10: SimHash fingerprints, linked by a tiled exact comparison.

Equal fingerprints are merged first. The different ones are dealt into groups
of at most MAX_GROUP_ROWS with close population counts; two groups meet only if
their population counts can lie within the radius. Inside a pair of groups,
numpy compares tiles by exclusive-or and bit counts and skips tiles whose
16-bit words' population counts differ by more than the radius in sum. A pair
of groups reports a spanning forest of its links, never all pairs.

The comparison is exact, and quadratic in the number of different fingerprints
but for what is skipped. A fingerprint has one or more words of 64 bits: word
0 comes from XXH64, the others from remixing it. 64 bits and a radius of 4 find
copies with very few changes.

With ``similar``, documents are linked if the Jaccard similarity of their sets
of shingles is at least that, and by nothing else; fingerprints only find the
candidates. Each different shingle then counts once, equal sets are merged
first, and groups are made by the sets' sizes, which such pairs have in common
to within ``similar``. The radius of NEAR is 76 of 256 bits: pairs at 0.8 have
an expected distance of 39 with a deviation of 6 (48 for sets of 4 and 5, the
smallest that differ), strangers 128 with a deviation of 8. The members of a
pair of tiles that have candidates form a block; the sets of a block meet in
one task, which computes all their intersections and reports a spanning forest
of the links found. So every candidate is verified, and no link rests on
another one that fails.

Defined cases: a null or empty text has fingerprint zero; a text of fewer
words than a shingle has its whole sequence as the only shingle; rows with a
null id take part, but a null is never a component's id unless it has no other;
repeated rows share their component; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import byte_lengths, mapped, mix64, plus, settle, split_by, text_runs
from sievelight.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Shingles, words of 64 bits, radius of the candidates and least similarity of near copies.
NEAR = {"shingle": 5, "words": 4, "radius": 76, "similar": 0.8}
#: Most fingerprints in a group, groups at least (so that small inputs spread), and fingerprints in a tile.
MAX_GROUP_ROWS, LEAST_GROUPS = 1 << 18, 12
TILE = 256
#: Members of the sets on one side of a block, about, and columns of a step in counting common ones.
BLOCK_MEMBERS, BLOCK_COLUMNS = 1 << 19, 4096
#: Lane sums of a byte stay under 256 for this many rows.
_LANE_ROWS = 255


def shingle_hashes(text: str | None, words_per: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z, and the six ASCII white space characters
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= words_per:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words_per] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words_per - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each document: ``counts`` hashes belong to each, in order. A bit is set if set in over half."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    n = counts[filled]
    chunks = -(-n // _LANE_ROWS)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(len(n)), chunks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = first[owner] + within * _LANE_ROWS
    lanes = np.uint64(0x0101010101010101)
    of_doc = np.cumsum(chunks) - chunks
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, at)
        by_byte = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(by_byte, of_doc, axis=0)
        bits = (2 * total > n[:, None]).astype(np.uint64)
        out[filled] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(texts: list[str | None], shingle: int = SHINGLE_WORDS, words: int = 1) -> np.ndarray:
    """A row of ``words`` unsigned 64-bit integers for each text."""
    return fingerprints_of([shingle_hashes(t, shingle) for t in texts], words)


def fingerprints_of(hashes: list, words: int) -> np.ndarray:
    """A row of ``words`` unsigned 64-bit integers for each collection of hashes."""
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter((h for each in hashes for h in each), np.uint64, int(counts.sum()))
    columns = [majority(flat if k == 0 else mix64(flat + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), counts) for k in range(words)]
    return np.stack(columns, axis=1)


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """The different shingle hashes of each text, ascending."""
    return [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in texts]


def set_names(sets: list[np.ndarray]) -> list[bytes]:
    """A 128-bit hash of each set."""
    import xxhash

    return [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]


def _packed_rows(prints: np.ndarray) -> pa.Array:
    """Fingerprints as big-endian binary values, so that their hex digits read as numbers do."""
    data = prints.astype(">u8").tobytes()
    size = 8 * prints.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(prints), [None, pa.py_buffer(np.arange(0, len(data) + 1, size, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def _fingerprints(batches: Iterator[pa.RecordBatch], text: str, shingle: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text)
        parts = [fingerprints(texts.slice(a, b - a).to_pylist(), shingle, words) for a, b in text_runs(byte_lengths(texts))]
        own = np.concatenate([np.zeros((0, words), np.uint64), *parts])
        keep = [i for i, name in enumerate(batch.schema.names) if name != text]
        arrays = [*(batch.column(i) for i in keep), _packed_rows(own), pa.array(np.bitwise_count(own).sum(axis=1), pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[i] for i in keep), "print", "population"])


def _pack(table: pa.Table) -> pa.Table:
    """A group's fingerprints, sorted for tight tiles, in one binary value."""
    rows = table.column("print").to_pylist()
    bits = np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(len(rows), -1)
    words = word_counts(bits)
    order = np.lexsort((*bits.T, words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    return pa.table({"part": table.column("part").slice(0, 1), "packed": pa.array([bits[order].tobytes()], pa.binary())})


def word_counts(bits: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit words of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(bits).astype("<u8").view("<u2").reshape(len(bits), -1))


class Forest:
    """Union-find over local indices that notes the unions made."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.made: list[tuple[int, int]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if (up == r).all():
                break
            r = up
        p[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        if not differ.any():
            return
        for x, y in np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], axis=1), axis=0).tolist():
            x, y = self._root(x), self._root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.made.append((x, y))

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            x = int(self.parent[x])
        return x


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Pairs of fingerprints whose links span all links between two groups, or inside one (``right`` None).

    Fingerprints are rows; the result has shape (pairs, 2, words).
    """
    other = left if right is None else right
    both = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    forest = Forest(len(both))
    words = left.shape[1]

    def ranges(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, cuts = word_counts(bits).astype(np.int16), np.arange(0, len(bits), TILE)
        return np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)

    (low_a, high_a), (low_b, high_b) = ranges(left), ranges(other)
    columns_a, columns_b = np.ascontiguousarray(left.T), np.ascontiguousarray(other.T)
    xor, count, total = np.empty((TILE, TILE), np.uint64), np.empty((TILE, TILE), np.uint8), np.empty((TILE, TILE), np.uint16)
    for i in range(len(low_a)):
        apart = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        near = np.flatnonzero(apart <= radius)
        a = columns_a[:, i * TILE : (i + 1) * TILE]
        for j in (near if right is not None else near[near >= i]).tolist():
            b = columns_b[:, j * TILE : (j + 1) * TILE]
            x, c, t = (y[: a.shape[1], : b.shape[1]] for y in (xor, count, total))
            for k in range(words):
                np.bitwise_xor(a[k][:, None], b[k][None, :], out=x)
                np.bitwise_count(x, out=c)
                if k == 0:
                    t[...] = c
                else:
                    np.add(t, c, out=t)
                    if k + 1 < words and t.min() > radius:
                        break
            hit = t <= radius
            if right is None and i == j:
                hit = np.triu(hit, 1)
            if hit.any():
                p, q = np.nonzero(hit)
                forest.link(p + i * TILE, q + j * TILE + shift)
    return both[np.array(forest.made, np.int64).reshape(-1, 2)]


def _compare(batches: Iterator[pa.RecordBatch], radius: int, words: int) -> Iterator[pa.RecordBatch]:
    rows = lambda x: np.frombuffer(x, np.uint64).reshape(-1, words)
    for batch in batches:
        for a, b in zip(batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist(), strict=True):
            pairs = linked(rows(a), None if b is None else rows(b), radius)
            yield pa.RecordBatch.from_arrays([_packed_rows(pairs[:, 0]), _packed_rows(pairs[:, 1])], names=["a", "b"])


def _group_pairs(rows: DataFrame, reach: int, pack, spread: str) -> DataFrame | None:
    """Packed groups (part_a, part_b, packed_a, packed_b) that can hold links, b null for a group with itself; None without rows.

    ``rows`` have a class; classes further apart than ``reach`` hold no link.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("class").count().collect()}  # as many rows as classes
    if not sizes:
        return None
    most = max(1, min(MAX_GROUP_ROWS, -(-sum(sizes.values()) // LEAST_GROUPS)))
    shares = {p: -(-n // most) for p, n in sizes.items()}
    share = F.element_at(F.create_map(*(F.lit(x) for p in sorted(shares) for x in (p, shares[p]))), F.col("class"))
    part = F.col("class").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64(spread), share)
    groups = settle(rows.withColumn("part", part).drop("class").groupBy("part").applyInArrow(pack, "part bigint, packed binary"))
    known = groups.select("part", F.shiftright("part", 32).alias("class"))
    wide = known.select(F.col("part").alias("part_a"), F.explode(F.sequence("class", F.col("class") + reach)).alias("_class"))
    met = wide.join(known.select(F.col("part").alias("part_b"), F.col("class").alias("_class")), "_class").where("part_a <= part_b").drop("_class")
    pairs = met.join(groups.toDF("part_a", "packed_a"), "part_a").join(groups.toDF("part_b", "packed_b"), "part_b")
    pairs = pairs.select("part_a", "part_b", "packed_a", F.when(F.col("part_a") != F.col("part_b"), F.col("packed_b")).alias("packed_b"))
    return pairs.repartition(max(1, min(2000, sum(shares.values()) * (reach + 1))))


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, words: int = 1) -> DataFrame:
    """Spanning links (a, b) among different fingerprints; ``prints`` has print and population."""
    spark = prints.sparkSession
    width = max(1, radius // 4)  # population counts of one class
    reach = (radius - 1) // width + 1 if radius else 0  # classes further apart than this hold no link
    distinct = prints.select("print", F.floor(F.col("population") / width).cast("int").alias("class"))
    sizes = {r[0]: r[1] for r in distinct.groupBy("class").count().collect()}  # as many rows as population counts, at most
    if not sizes:
        return spark.createDataFrame([], "a binary, b binary")
    rows = max(1, min(MAX_GROUP_ROWS, -(-sum(sizes.values()) // LEAST_GROUPS)))
    shares = {p: -(-n // rows) for p, n in sizes.items()}
    share = F.element_at(F.create_map(*(F.lit(x) for p in sorted(shares) for x in (p, shares[p]))), F.col("class"))
    part = F.col("class").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("print"), share)
    groups = settle(distinct.select(part.alias("part"), "print").groupBy("part").applyInArrow(_pack, "part bigint, packed binary"))
    known = groups.select("part", F.shiftright("part", 32).alias("class"))
    wide = known.select(F.col("part").alias("part_a"), F.explode(F.sequence("class", F.col("class") + reach)).alias("_class"))
    met = wide.join(known.select(F.col("part").alias("part_b"), F.col("class").alias("_class")), "_class").where("part_a <= part_b").drop("_class")
    pairs = met.join(groups.toDF("part_a", "packed_a"), "part_a").join(groups.toDF("part_b", "packed_b"), "part_b")
    pairs = pairs.select("packed_a", F.when(F.col("part_a") != F.col("part_b"), F.col("packed_b")).alias("packed_b"))
    tasks = max(1, min(2000, sum(shares.values()) * (reach + 1)))
    return mapped(pairs.repartition(tasks), partial(_compare, radius=radius, words=words), "a binary, b binary")


def _sets(batches: Iterator[pa.RecordBatch], text: str, shingle: int, words: int) -> Iterator[pa.RecordBatch]:
    """Fingerprint, name and size of each text's set of shingles."""
    for batch in batches:
        texts = batch.column(text)
        prints, names, sizes = [np.zeros((0, words), np.uint64)], [], []
        for a, b in text_runs(byte_lengths(texts)):
            sets = shingle_sets(texts.slice(a, b - a).to_pylist(), shingle)
            prints.append(fingerprints_of(sets, words))
            names += set_names(sets)
            sizes += map(len, sets)
        keep = [i for i, name in enumerate(batch.schema.names) if name != text]
        arrays = [*(batch.column(i) for i in keep), _packed_rows(np.concatenate(prints)), pa.array(names, pa.binary()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[i] for i in keep), "print", "name", "size"])


def _members(batches: Iterator[pa.RecordBatch], text: str, shingle: int) -> Iterator[pa.RecordBatch]:
    """Name and members of each text's set of shingles."""
    for batch in batches:
        texts = batch.column(text)
        for a, b in text_runs(byte_lengths(texts)):
            sets = shingle_sets(texts.slice(a, b - a).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(set_names(sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["name", "members"])


def _pack_sets(table: pa.Table) -> pa.Table:
    """A group's sets by size in one binary value: fingerprint, name (two words) and size of each."""
    read = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), ">u8").astype(np.uint64).reshape(table.num_rows, -1)
    sizes = table.column("size").to_numpy().astype(np.uint64)
    rows = np.concatenate([read("print"), read("name"), sizes[:, None]], axis=1)
    return pa.table({"part": table.column("part").slice(0, 1), "packed": pa.array([rows[np.argsort(sizes, kind="stable")].tobytes()], pa.binary())})


def candidates(left: np.ndarray, right: np.ndarray | None, radius: int, words: int, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs within the radius whose sizes allow ``similar``, a tile at a time.

    Rows are those of ``_pack_sets``; ``right`` None: pairs inside ``left``.
    """
    other = left if right is None else right
    sizes_a, sizes_b = left[:, -1].astype(np.float64), other[:, -1].astype(np.float64)
    columns_a, columns_b = np.ascontiguousarray(left[:, :words].T), np.ascontiguousarray(other[:, :words].T)
    starts_b = np.arange(0, len(other), TILE)
    low_b, high_b = sizes_b[starts_b], sizes_b[np.minimum(starts_b + TILE, len(other)) - 1]
    xor, count, total = np.empty((TILE, TILE), np.uint64), np.empty((TILE, TILE), np.uint8), np.empty((TILE, TILE), np.uint16)
    for i in range(-(-len(left) // TILE)):
        a = columns_a[:, i * TILE : (i + 1) * TILE]
        low, high = sizes_a[i * TILE], sizes_a[min((i + 1) * TILE, len(left)) - 1]
        near = np.flatnonzero((low_b * similar <= high) & (low * similar <= high_b))
        for j in (near if right is not None else near[near >= i]).tolist():
            b = columns_b[:, j * TILE : (j + 1) * TILE]
            x, c, t = (y[: a.shape[1], : b.shape[1]] for y in (xor, count, total))
            t[...] = 0
            for k in range(words):
                np.bitwise_xor(a[k][:, None], b[k][None, :], out=x)
                np.bitwise_count(x, out=c)
                np.add(t, c, out=t)
            hit = t <= radius
            if right is None and i == j:
                hit = np.triu(hit, 1)
            if hit.any():
                p, q = np.nonzero(hit)
                p, q = p + i * TILE, q + j * TILE
                fits = np.minimum(sizes_a[p], sizes_b[q]) >= similar * np.maximum(sizes_a[p], sizes_b[q])
                if fits.any():
                    yield p[fits], q[fits]


def _runs(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Rows cut so that the sets of a run have about BLOCK_MEMBERS members at most."""
    run = np.cumsum(sizes[rows].astype(np.int64)) // BLOCK_MEMBERS
    return np.split(rows, np.flatnonzero(np.diff(run)) + 1)


def _find(batches: Iterator[pa.RecordBatch], radius: int, words: int, similar: float) -> Iterator[pa.RecordBatch]:
    """Blocks of candidates: a row for each member of either side."""
    rows = lambda x: np.frombuffer(x, np.uint64).reshape(-1, words + 3)
    for batch in batches:
        for part_a, part_b, a, b in zip(*(batch.column(c).to_pylist() for c in ("part_a", "part_b", "packed_a", "packed_b")), strict=True):
            left, right = rows(a), None if b is None else rows(b)
            other = left if right is None else right
            for p, q in candidates(left, right, radius, words, similar):
                for first in _runs(np.unique(p), left[:, -1]):
                    mine = q[np.isin(p, first)]
                    for second in _runs(np.unique(mine), other[:, -1]):
                        block = np.array([part_a, part_b, first[0], second[0]], np.int64).tobytes()
                        names = np.concatenate([left[first, words : words + 2], other[second, words : words + 2]])
                        sides = np.repeat(np.array([0, 1], np.int32), [len(first), len(second)])
                        yield pa.RecordBatch.from_arrays([pa.array([block] * len(sides), pa.binary()), pa.array(sides), _packed_rows(names)], names=["block", "side", "name"])


def shared_members(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left has in common with each one on the right."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(both), BLOCK_COLUMNS):
        some = both[at : at + BLOCK_COLUMNS]
        held = []
        for sets in (left, right):
            has = np.zeros((len(sets), len(some)), np.float32)
            for k, x in enumerate(sets):
                inside = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
                place = np.searchsorted(some, inside)
                has[k, place[some[place] == inside]] = 1
            held.append(has)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def _verified(table: pa.Table, similar: float) -> pa.Table:
    """Names of a spanning forest of a block's pairs whose Jaccard similarity is at least ``similar``."""
    sides = table.column("side").to_numpy()
    names = np.array(table.column("name").to_pylist(), dtype=object)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
    at = [np.flatnonzero(sides == k) for k in (0, 1)]
    shared = shared_members(*([sets[i] for i in each] for each in at))
    sizes = [np.array([len(sets[i]) for i in each]) for each in at]
    p, q = np.nonzero(shared / (sizes[0][:, None] + sizes[1][None, :] - shared) >= similar)
    _, node = np.unique(np.array([x.hex() for x in names]), return_inverse=True)  # inside one tile a set can be on both sides
    forest = Forest(int(node.max()) + 1)
    forest.link(node[at[0][p]], node[at[1][q]])
    named = dict(zip(node.tolist(), names, strict=True))
    return pa.table({k: pa.array([named[m[i]] for m in forest.made], pa.binary()) for i, k in enumerate("ab")})


def similarity_links(narrow: DataFrame, nodes: DataFrame, radius: int, shingle: int, words: int, similar: float) -> DataFrame:
    """Links (a, b) among names of sets that span all pairs as similar as ``similar``.

    A set so small that another one can't be as similar without being equal takes no part.
    """
    sized = nodes.where(F.col("size") >= similar * (F.col("size") + 1)).select("print", "name", "size")
    classed = sized.withColumn("class", F.floor(F.log("size") / -math.log(similar)).cast("int"))
    pairs = _group_pairs(classed, 1, _pack_sets, "name")
    if pairs is None:
        return nodes.sparkSession.createDataFrame([], "a binary, b binary")
    blocks = settle(mapped(pairs, partial(_find, radius=radius, words=words, similar=similar), "block binary, side int, name binary"))
    wanted = settle(blocks.select("name").distinct())
    keys = nodes.join(wanted, "name", "left_semi").where("_least IS NOT NULL").select("_least").distinct()
    rows = split_by(narrow, "_key", keys, "left_semi").unionByName(narrow.where("_key IS NULL"))
    members = mapped(rows.select("_text"), partial(_members, text="_text", shingle=shingle), "name binary, members binary")
    members = members.join(wanted, "name", "left_semi").groupBy("name").agg(F.first("members").alias("members"))

    def verified(block: pa.Table) -> pa.Table:
        return _verified(block, similar)

    return settle(blocks.join(members, "name").groupBy("block").applyInArrow(verified, "a binary, b binary"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE_WORDS, words: int = 1, similar: float | None = None
) -> DataFrame:
    """(key, fingerprint, component_id) for each row; a component's id is its smallest key.

    Fingerprints within the radius are linked or, with ``similar``, sets of
    shingles with at least that Jaccard similarity.
    """
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if similar is None:
        schema = plus(narrow.drop("_text"), "print binary, population int")
        prints = settle(mapped(narrow, partial(_fingerprints, text="_text", shingle=shingle, words=words), schema))
        nodes = settle(prints.groupBy("print", "population").agg(F.min("_key").alias("_least")))
        roots, node = components(fingerprint_links(nodes, radius, words), "a", "b"), "print"
    else:
        schema = plus(narrow.drop("_text"), "print binary, name binary, size bigint")
        prints = settle(mapped(narrow, partial(_sets, text="_text", shingle=shingle, words=words), schema))
        nodes = settle(prints.groupBy("print", "name", "size").agg(F.min("_key").alias("_least")))
        roots, node = components(similarity_links(narrow, nodes, radius, shingle, words, similar), "a", "b"), "name"
    rooted = nodes.join(roots, F.col(node) == F.col("node"), "left").select(node, "_least", F.coalesce("root", node).alias("root"))
    rooted = settle(rooted)
    ids = settle(rooted.groupBy("root").agg(F.min("_least").alias("component_id")))  # apart from the join, whose large component Spark then splits
    named = rooted.join(ids, "root").select(node, "component_id")
    return prints.join(named, node).select(F.col("_key").alias(key), F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    radius: int = NEAR["radius"],
    shingle: int = NEAR["shingle"],
    words: int = NEAR["words"],
    similar: float | None = NEAR["similar"],
) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component.

    Rows with a null key stay. Rows that share key and text are one document,
    of which one row stays.
    """
    found = near_duplicates(docs, key, text, radius, shingle, words, similar)
    found = settle(found.select(F.col(key).alias("_key"), (F.col(key) != F.col("component_id")).alias("_gone")))
    kept = split_by(docs, key, found.where("_gone").select("_key").distinct(), "left_anti")
    shared = settle(found.where("_key IS NOT NULL AND NOT _gone").groupBy("_key").count().where("count > 1").select("_key"))
    if shared.isEmpty():
        return kept
    alone = split_by(kept, key, shared, "left_anti")
    return alone.unionByName(split_by(kept, key, shared, "left_semi").dropDuplicates([key, text]))


def op10_query(docs: DataFrame) -> DataFrame:
    """The digest of query op10."""
    return near_duplicates(docs)
