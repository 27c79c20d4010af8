"""Operator 6: substring dedup by relative Lempel-Ziv parsing.

Documents are packed into reference blocks of about BLOCK_BYTES of text, and
the blocks are indexed twice, each time by hash range, so no block meets all
others:

1. *Seeds.* Every window of MIN_WORDS words names its smallest SEED_WORDS-gram
   hash; equal windows name equal seeds wherever they stand. A seed found in
   one document alone ends there, which drops most of the corpus.
2. *Windows.* Windows under shared seeds are indexed by a 96-bit hash with the
   smallest document that holds them, and where in it: the reference holds
   each window once, where it first stands.

A document is then parsed greedily. Where its next window is in the reference
at an earlier document, a factor starts, and it is the longest that any
indexed document gives which holds one of the windows that follow: it goes on
through windows that the reference has elsewhere, as long as the same document
really continues alike. To tell that, each document's places of windows owned
by others are sent to the blocks that refer to it; equal owners and places
mean equal windows, so no text has to be compared. Where a factor ends,
windows across its boundary are looked up as well, and the first found starts
a factor that overlaps. Every factor has at least MIN_WORDS words and becomes
a duplicate span, and the words of spans are what is removed. These are
exactly the words of windows that also start in a document with a smaller id,
since every such window lies in a factor, and a factor's words all stand in a
smaller document.

A group in a reduce step is a range of hashes over a bounded number of blocks;
of a passage that all blocks share it holds one entry a block, and past
FAN_IN blocks entries are merged in two levels, with finer ranges in the second.

Defined cases: ids are integers (others raise); null and empty texts have no
words and stay as they are; a row with a null id neither owns nor loses words;
rows that share an id do not count as earlier than each other; long texts form
a block alone; an empty table gives an empty result; clashing input columns
are renamed to ``input_<name>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievelight.llm._common import BASES, byte_lengths, free_names, mapped, mix64, piece_hash, plus, settle, text_runs

#: Fewest words of a duplicate span, and words of a seed in it.
MIN_WORDS = 13
SEED_WORDS = 5
BLOCK_BYTES = 1 << 20
#: Blocks whose entries make up one hash range, on average.
BLOCKS_A_RANGE = 16
#: Blocks whose entries meet in one group before they are merged, and most hash ranges that a block's entries are dealt to.
FAN_IN, MOST_RANGES = 4096, 4096
#: Parts that requests for one document are dealt to, at most.
MOST_SALTS = 16


def _packed(batch: pa.RecordBatch) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpacked(data: bytes) -> pa.RecordBatch:
    import zstandard

    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(data)) as reader:
        return reader.read_next_batch()


def _to_blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start, stop in text_runs(byte_lengths(batch.column(text)), BLOCK_BYTES):
            rows = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(rows)], pa.binary())], names=["block", "packed"])
            block += 1


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Parsed:
    """Words of a block's documents as hashes, with the windows that lie inside one document."""

    def __init__(self, batch: pa.RecordBatch, key: str, text: str):
        texts = batch.column(text).fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        solid = self.solid = ~_SPACE[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.offsets] = True  # no word reaches from one document into the next
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        #: First byte of each word, and the byte after its last.
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.owner = np.searchsorted(self.offsets[1:], self.starts, side="right")
        self.counts = np.bincount(self.owner, minlength=len(texts))
        keys = batch.column(key)
        self.ids = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = keys.is_valid().to_numpy(zero_copy_only=False)
        self.first = np.cumsum(self.counts) - self.counts
        place = np.arange(len(self.owner)) - self.first[self.owner]
        fits = (place + MIN_WORDS <= self.counts[self.owner]) & known[self.owner]
        #: Where windows start among all words, their documents' ids, and their places in the document.
        self.at = np.flatnonzero(fits)
        self.doc = self.ids[self.owner[self.at]]
        self.place = place[self.at]
        self._words: dict[int, np.ndarray] = {}

    def _hashed(self, which: int) -> np.ndarray:
        """A hash of each word: of its bytes from its start, and its length."""
        if which not in self._words:
            self._words[which] = piece_hash(self.data, self.starts, self.ends - self.starts, which, self.solid)
        return self._words[which]

    def _rolled(self, which: int, words: int) -> np.ndarray:
        h = self._hashed(which)
        n = max(0, len(h) - words + 1)
        total = np.zeros(n, np.uint64)
        for k in range(words):
            total = total * np.uint64(BASES[which]) + h[k : k + n]
        return mix64(total)

    def seeds(self) -> np.ndarray:
        """The seed of each window."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        least, have = self._rolled(0, SEED_WORDS), 1
        want = MIN_WORDS - SEED_WORDS + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return least[self.at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The 96-bit hash of each window, in parts of 64 and 32."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return self._rolled(0, MIN_WORDS)[self.at], (self._rolled(1, MIN_WORDS)[self.at] >> np.uint64(32)).astype(np.uint32)


#: Packed columns of hashes are random and stay as they are; all others are compressed.
RANDOM = ("hash", "second")


def _squeezed(x: np.ndarray) -> bytes:
    """Compressed values: their bytes by significance, since the high ones are mostly alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _values(name: str, data: bytes, kind) -> np.ndarray:
    """The values of one packed column of one row."""
    import zstandard

    if name in RANDOM:
        return np.frombuffer(data, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _bytes(name: str, x: np.ndarray) -> bytes:
    return x.tobytes() if name in RANDOM else _squeezed(x)


def _ranges(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of sorted hashes into ranges, and the range of each piece."""
    of = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return cuts, of[cuts].astype(np.int64)


def _emit(block: int, ranges: int, columns: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """One row a range; ``columns`` are sorted by the hash, which comes first."""
    cuts, of = _ranges(columns[0][1], ranges)
    ends = np.append(cuts[1:], len(columns[0][1]))
    arrays = [pa.array(of), pa.array(np.full(len(of), block, np.int64))]
    arrays += [pa.array([_bytes(name, x[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()) for name, x in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["range", "block", *(name for name, _ in columns)])


def _seed_entries(batches: Iterator[pa.RecordBatch], key: str, text: str, ranges: int) -> Iterator[pa.RecordBatch]:
    """Different seeds of a block, each with whether several of its documents have it."""
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            p = Parsed(_unpacked(packed), key, text)
            seeds, doc = p.seeds(), p.doc
            if not len(seeds):
                continue
            new = np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (doc[1:] != doc[:-1])])
            seeds, doc = seeds[new], doc[new]
            order = np.lexsort((doc, seeds))
            seeds, doc = seeds[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
            several = np.maximum.reduceat(doc, start) != doc[start]
            yield _emit(block, ranges, [("hash", seeds[start]), ("several", several.astype(np.uint8))])


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """A packed column's values of all rows, and the row of each."""
    parts = [_values(name, x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate([np.zeros(0, kind), *parts]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _by_block(table: pa.Table, row: np.ndarray, columns: list[tuple[str, np.ndarray]]) -> pa.Table:
    """Answers for the blocks: a row for each that has any."""
    order = np.argsort(row, kind="stable")
    row = row[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(row))[: len(start)]
    blocks = table.column("block").to_numpy()
    out = {"block": pa.array(blocks[row[start]], pa.int64())}
    for name, values in columns:
        values = values[order]
        out[name] = pa.array([_bytes(name, values[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary())
    return pa.table(out)


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n - 1, bool)
    for x in sorted_columns:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _shared(hashes: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of sorted ``hashes``' starts, and which of them stand more than once or are marked."""
    start = _starts(hashes)
    if not len(start):
        return start, np.zeros(0, bool)
    return start, (np.diff(np.append(start, len(hashes))) > 1) | (np.maximum.reduceat(several, start) > 0)


def _shared_seeds(table: pa.Table) -> pa.Table:
    """Tell each block which of its seeds several documents have."""
    hashes, row = _column(table, "hash", np.uint64)
    several, _ = _column(table, "several", np.uint8)
    order = np.argsort(hashes, kind="stable")
    hashes, row, several = hashes[order], row[order], several[order]
    start, many = _shared(hashes, several)
    shared = np.repeat(many, np.diff(np.append(start, len(hashes))))
    return _by_block(table, row[shared], [("hash", hashes[shared])])


def _fine_rows(table: pa.Table, fine: int, columns: list[tuple[str, np.ndarray]]) -> pa.Table:
    """A lot's entries, sorted by hash, in a row for each of ``fine`` ranges of all hashes."""
    cuts, of = _ranges(columns[0][1], fine)
    ends = np.append(cuts[1:], len(columns[0][1]))[: len(cuts)]
    out = {c: pa.array([table.column(c)[0].as_py()] * len(cuts), pa.int64()) for c in ("range", "lot")} | {"fine": pa.array(of, pa.int64())}
    return pa.table(out | {name: pa.array([_bytes(name, x[i:j]) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()) for name, x in columns})


def _seeds_of_lot(table: pa.Table, fine: int) -> pa.Table:
    """A lot's different seeds."""
    hashes, _ = _column(table, "hash", np.uint64)
    several, _ = _column(table, "several", np.uint8)
    order = np.argsort(hashes, kind="stable")
    hashes, several = hashes[order], several[order]
    start, many = _shared(hashes, several)
    return _fine_rows(table, fine, [("hash", hashes[start]), ("several", many.astype(np.uint8))])


def _by_lot(table: pa.Table, row: np.ndarray, columns: list[tuple[str, np.ndarray]]) -> pa.Table:
    """Answers for the lots, each with its range."""
    named = table.rename_columns(["block" if c == "lot" else c for c in table.column_names])
    out = _by_block(named, row, columns)
    return pa.table({"range": pa.array(np.full(out.num_rows, table.column("range")[0].as_py()), pa.int64()), "lot": out.column("block")} | {name: out.column(name) for name, _ in columns})


def _seeds_over_lots(table: pa.Table) -> pa.Table:
    """Tell each lot which of its seeds several documents have."""
    hashes, row = _column(table, "hash", np.uint64)
    several, _ = _column(table, "several", np.uint8)
    order = np.argsort(hashes, kind="stable")
    hashes, row, several = hashes[order], row[order], several[order]
    start, many = _shared(hashes, several)
    shared = np.repeat(many, np.diff(np.append(start, len(hashes))))
    return _by_lot(table, row[shared], [("hash", hashes[shared])])


def _seeds_to_blocks(entries: pa.Table, shared: pa.Table) -> pa.Table:
    """Pass a lot's answer on to its blocks."""
    hashes, row = _column(entries, "hash", np.uint64)
    known = np.unique(_column(shared, "hash", np.uint64)[0])
    take = np.isin(hashes, known)
    return _by_block(entries, row[take], [("hash", hashes[take])])


def _window_entries(batches: Iterator[pa.RecordBatch], key: str, text: str, ranges: int) -> Iterator[pa.RecordBatch]:
    """Different windows of a block under shared seeds, each with its smallest document and place."""
    for batch in batches:
        for block, packed, shared in zip(*(batch.column(c).to_pylist() for c in ("block", "packed", "shared")), strict=True):
            p = Parsed(_unpacked(packed), key, text)
            if not shared:
                continue
            known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in shared]))
            seeds = p.seeds()
            at = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
            take = known[at] == seeds
            first, second = (x[take] for x in p.windows())
            doc, place = p.doc[take], p.place[take]
            if not len(first):
                continue
            order = np.lexsort((place, doc, second, first))
            first, second, doc, place = first[order], second[order], doc[order], place[order]
            start = _starts(first, second)
            several = np.maximum.reduceat(doc, start) != doc[start]
            spot = place[start].astype(np.uint32) | several.astype(np.uint32) << np.uint32(31)
            yield _emit(block, ranges, [("hash", first[start]), ("second", second[start]), ("doc", doc[start]), ("spot", spot)])


def _windows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Sorted window entries: first and second part, row, document, place, whether several documents stand behind it."""
    first, row = _column(table, "hash", np.uint64)
    second, doc, spot = (_column(table, c, k)[0] for c, k in (("second", np.uint32), ("doc", np.int64), ("spot", np.uint32)))
    several, spot = spot >> np.uint32(31) > 0, spot & np.uint32(0x7FFFFFFF)
    order = np.lexsort((spot, doc, second, first))
    return tuple(x[order] for x in (first, second, row, doc, spot, several))


def _owners(first: np.ndarray, second: np.ndarray, *of_start: np.ndarray) -> list[np.ndarray]:
    """For each entry, the values of its window's first entry, which is the owner's."""
    start = _starts(first, second)
    count = np.diff(np.append(start, len(first)))
    return [np.repeat(x[start], count) for x in of_start]


def _owned_windows(table: pa.Table) -> pa.Table:
    """Tell each block which of its windows a document smaller than one of its own has."""
    first, second, row, doc, spot, several = _windows(table)
    owner, owner_spot = _owners(first, second, doc, spot)
    lost = several | (doc > owner)
    return _by_block(table, row[lost], [("hash", first[lost]), ("second", second[lost]), ("owner", owner[lost]), ("spot", owner_spot[lost])])


def _windows_of_lot(table: pa.Table, fine: int) -> pa.Table:
    """A lot's different windows, each with its smallest document."""
    first, second, _, doc, spot, _ = _windows(table)
    start = _starts(first, second)
    return _fine_rows(table, fine, [("hash", first[start]), ("second", second[start]), ("doc", doc[start]), ("spot", spot[start])])


def _windows_over_lots(table: pa.Table) -> pa.Table:
    """Tell each lot the owner of each of its windows."""
    first, second, row, doc, spot, _ = _windows(table)
    owner, owner_spot = _owners(first, second, doc, spot)
    return _by_lot(table, row, [("hash", first), ("second", second), ("doc", owner), ("spot", owner_spot)])


def _windows_to_blocks(entries: pa.Table, owners: pa.Table) -> pa.Table:
    """Tell each block which of its windows a document smaller than one of its own has."""
    first, second, row, doc, spot, several = _windows(entries)
    start = _starts(first, second)
    count = np.diff(np.append(start, len(first)))
    # Both sides hold the same different windows, in the same order once sorted.
    known, known_second, _, known_doc, known_spot, _ = _windows(owners)
    assert (known == first[start]).all() and (known_second == second[start]).all()
    owner, owner_spot = np.repeat(known_doc, count), np.repeat(known_spot, count)
    lost = several | (doc > owner)
    return _by_block(entries, row[lost], [("hash", first[lost]), ("second", second[lost]), ("owner", owner[lost]), ("spot", owner_spot[lost])])


def _exchanged(entries: DataFrame, ranges: int, lots: int, direct, of_lot, over_lots, to_blocks, fields: str, between: str, answers: str) -> DataFrame:
    """Answers for the blocks from entries by hash range.

    One group a range where the blocks are few. Else the blocks of a range are
    dealt to lots of about FAN_IN; each lot is merged to its different hashes,
    the lots are merged by ranges as much finer as there are more of them, and
    the answers go back the same way.
    """
    if lots == 1:
        return entries.groupBy("range").applyInArrow(direct, answers)
    dealt = entries.withColumn("lot", F.pmod(F.xxhash64("block"), F.lit(lots)).cast("bigint"))
    fine = ranges * max(1, lots // BLOCKS_A_RANGE)

    def merge(table: pa.Table) -> pa.Table:
        return of_lot(table, fine)

    merged = dealt.groupBy("range", "lot").applyInArrow(merge, f"range bigint, lot bigint, fine bigint, {fields}")
    decided = merged.groupBy("fine").applyInArrow(over_lots, f"range bigint, lot bigint, {between}")
    return dealt.groupBy("range", "lot").cogroup(decided.groupBy("range", "lot")).applyInArrow(to_blocks, answers)


#: Places where a document has windows that the reference has elsewhere: first place, windows, owner, owner's first place.
SEGMENT = np.dtype([("place", "<i4"), ("count", "<i4"), ("owner", "<i8"), ("spot", "<i4")])


def _stretches(row: np.ndarray, place: np.ndarray, owner: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive windows of a row begin, and where segments of them with one owner do."""
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    turns = apart | (owner[1:] != owner[:-1]) | (spot[1:] != spot[:-1] + 1)
    return tuple(np.flatnonzero(np.concatenate([[True], x])) for x in (apart, turns))


def _segments(place: np.ndarray, owner: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """One document's windows as segments."""
    _, start = _stretches(np.zeros(len(place), np.int8), place, owner, spot)
    out = np.zeros(len(start), SEGMENT)
    out["place"], out["owner"], out["spot"] = place[start], owner[start], spot[start]
    out["count"] = np.diff(np.append(start, len(place)))[: len(start)]
    return out


class Hits:
    """A block's windows that the reference has at a smaller document: row, place, owner and its place."""

    def __init__(self, p: Parsed, owned: list | None):
        self.row = self.place = self.owner = self.spot = self.where = np.zeros(0, np.int64)
        if not owned:
            return
        known = [np.concatenate([_values(c, x[c], k) for x in owned]) for c, k in (("hash", np.uint64), ("second", np.uint32), ("owner", np.int64), ("spot", np.uint32))]
        order = np.argsort(known[0], kind="stable")  # different windows share the first part in one case of 2^64
        hashes, second, owner, spot = (x[order] for x in known)
        first, other = p.windows()
        at = np.minimum(np.searchsorted(hashes, first), len(hashes) - 1)
        hit = (hashes[at] == first) & (second[at] == other) & (owner[at] < p.doc)
        self.where, at = np.flatnonzero(hit), at[hit]
        self.row, self.place = p.owner[p.at[self.where]], p.place[self.where]
        self.owner, self.spot = owner[at], spot[at].astype(np.int64)

    def of_many(self) -> np.ndarray:
        """Owners in runs of several segments."""
        runs, segments = _stretches(self.row, self.place, self.owner, self.spot)
        if not len(runs):
            return np.zeros(0, np.int64)
        run = np.searchsorted(runs, segments, side="right") - 1
        return np.unique(self.owner[segments][np.bincount(run, minlength=len(runs))[run] > 1])


def _references(p: Parsed, hits: Hits) -> Iterator[tuple[int, bytes]]:
    """(id, segments) of documents some of whose windows the reference has elsewhere: at a smaller document, or earlier in their own text."""
    if not len(p.at):
        return
    row, (first, second) = p.owner[p.at], p.windows()
    order = np.lexsort((p.place, second, first, row))
    start = _starts(row[order], first[order], second[order])
    earliest = np.empty(len(order), np.int64)
    earliest[order] = np.repeat(p.place[order][start], np.diff(np.append(start, len(order))))
    owner, spot, elsewhere = p.doc.copy(), earliest, earliest < p.place
    owner[hits.where], spot[hits.where], elsewhere[hits.where] = hits.owner, hits.spot, True
    row, place, owner, spot = (x[elsewhere] for x in (row, p.place, owner, spot))
    edges = _starts(row)
    for i, j in zip(edges.tolist(), np.append(edges[1:], len(row))[: len(edges)].tolist(), strict=True):
        yield int(p.ids[row[i]]), _segments(place[i:j], owner[i:j], spot[i:j]).tobytes()


def _links(batches: Iterator[pa.RecordBatch], key: str, text: str, salts: int) -> Iterator[pa.RecordBatch]:
    """Of each block: documents' segments, once for each salt, and requests for the documents that it refers to."""
    for batch in batches:
        for block, packed, owned in zip(*(batch.column(c).to_pylist() for c in ("block", "packed", "owned")), strict=True):
            p = Parsed(_unpacked(packed), key, text)
            hits = Hits(p, owned)
            rows = [(doc, salt, None, data) for doc, data in _references(p, hits) for salt in range(salts)]
            rows += [(doc, block % salts, block, None) for doc in hits.of_many().tolist()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "salt", "block", "segments"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests met with segments, both in the order of documents and segments first; one document is held at a time."""
    doc, held = None, []
    for batch in batches:
        out = []
        for d, block, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "block", "segments")), strict=True):
            if d != doc:
                doc, held = d, []
            if block is None:
                held.append(data)
            else:
                out += [(block, d, x) for x in held]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "doc", "segments"])


def _alike(owner: np.ndarray, spot: np.ndarray, doc: int, first: int, segments: np.ndarray | None) -> np.ndarray:
    """Whether each window of a run is the one that ``doc`` has at the places from ``first`` on."""
    place = np.arange(first, first + len(owner))
    if segments is None or not len(segments):
        return (owner == doc) & (spot == place)
    x = segments[np.maximum(np.searchsorted(segments["place"], place, side="right") - 1, 0)]
    past = place - x["place"]
    inside = (past >= 0) & (past < x["count"])
    return np.where(inside, (x["owner"] == owner) & (x["spot"] + past == spot), (owner == doc) & (spot == place))


def _longest(owner: np.ndarray, spot: np.ndarray, starts: np.ndarray, known: dict[int, list[np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """Greedy factors (window, windows, owner, owner's place) of a run of several segments, which begin at ``starts``."""
    size = len(owner)
    segments = list(zip(starts.tolist(), [*starts[1:].tolist(), size], owner[starts].tolist(), spot[starts].tolist(), strict=True))
    owned: dict[tuple[int, int], int] = {}
    for i, j, doc, at in segments:
        owned[doc, at - i] = owned.get((doc, at - i), 0) + j - i
    stretches = []
    for doc, shift in sorted(owned, key=lambda x: (-owned[x], x)):
        for its in known.get(doc) or (None,):
            same = np.concatenate([[False], _alike(owner, spot, doc, shift, its), [False]])
            edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
            if edges == [0, size]:  # none is longer
                return [(0, size, doc, shift)]
            stretches += [(i, -j, doc, shift) for i, j in zip(edges[::2], edges[1::2], strict=True)]
    # Rows that share an id may have answered for one another, so a segment always counts for itself.
    stretches += [(i, -j, doc, at - i) for i, j, doc, at in segments]
    stretches.sort()
    out, at, k = [], 0, 0
    best = (0, 0, 0)
    while at < size:
        while k < len(stretches) and stretches[k][0] <= at:
            best = max(best, (-stretches[k][1], -stretches[k][2], stretches[k][3]))
            k += 1
        stop, doc, shift = best[0], -best[1], best[2]
        out.append((at, stop - at, doc, at + shift))
        at = stop  # the first window across the factor's boundary
    return out


def factors(row: np.ndarray, place: np.ndarray, owner: np.ndarray, spot: np.ndarray, known: dict[int, list[np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
    """Greedy factors (row, start, words, owner, owner's start) of a block's documents.

    ``row``, ``place``: windows that the reference has, ascending; ``owner``
    and ``spot``: where. ``known``: segments of the documents referred to.
    Only consecutive windows can lie in one factor.
    """
    runs, segments = _stretches(row, place, owner, spot)
    ends = np.append(runs[1:], len(place))[: len(runs)]
    first, last = np.searchsorted(segments, runs), np.searchsorted(segments, ends)
    out = []
    for a, b, i, j in zip(runs.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        found = [(0, b - a, int(owner[a]), int(spot[a]))] if j - i == 1 else _longest(owner[a:b], spot[a:b], segments[i:j] - a, known)
        out += [(int(row[a]), int(place[a]) + at, n + MIN_WORDS - 1, doc, its) for at, n, doc, its in found]
    return out


def cut(data: bytes, starts: np.ndarray, removed: np.ndarray) -> str:
    """The text without the removed words and the white space after each. ``starts``: where words start."""
    starts = np.append(starts, len(data))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in edge.reshape(-1, 2).tolist():
        out.append(data[at : starts[a]])
        at = int(starts[b])
    out.append(data[at:])
    return b"".join(out).decode()


def _factored(batches: Iterator[pa.RecordBatch], key: str, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed, owned, answers in zip(*(batch.column(c).to_pylist() for c in ("packed", "owned", "answers")), strict=True):
            rows = _unpacked(packed)
            p = Parsed(rows, key, text)
            hits = Hits(p, owned)
            known: dict[int, list[np.ndarray]] = {}
            for x in answers or ():
                known.setdefault(x["doc"], []).append(np.frombuffer(x["segments"], SEGMENT))
            found = factors(hits.row, hits.place, hits.owner, hits.spot, known)
            spans: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            covered = np.zeros(len(p.owner) + 1, np.int64)
            for row, start, words, doc, its in found:
                spans[row].append({"start": start, "words": words, "ref_id": doc, "ref_start": its})
                covered[p.first[row] + start] += 1
                covered[p.first[row] + start + words] -= 1
            covered = np.cumsum(covered)[:-1] > 0
            removed = np.bincount(p.owner[covered], minlength=rows.num_rows)
            texts = rows.column(text)
            if found:
                new = texts.to_pylist()
                for d in np.flatnonzero(removed).tolist():
                    words = slice(p.first[d], p.first[d] + p.counts[d])
                    new[d] = cut(p.data[p.offsets[d] : p.offsets[d + 1]].tobytes(), p.starts[words] - p.offsets[d], covered[words])
                texts = pa.array(new, texts.type)
            arrays = [texts if f.name == text else rows.column(f.name) for f in rows.schema]
            made = pa.array(spans, schema.field("spans").type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p.counts), pa.array(removed), made], names=[*rows.schema.names, "n_words", "n_removed", "spans"])


NAMES = ["n_words", "n_removed", "spans"]
SPANS = "n_words bigint, n_removed bigint, spans array<struct<start: bigint, words: bigint, ref_id: bigint, ref_start: bigint>>"


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without duplicate spans, with n_words, n_removed and spans.

    The text is compressed once into blocks that are written to the shared
    folder; the two index steps and the factoring read those, and only packed
    blocks and packed hashes are shuffled.
    """
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be an integer column")
    docs = free_names(docs, NAMES)
    schema = plus(docs, SPANS)
    blocks = settle(mapped(docs, partial(_to_blocks, text=text), "block bigint, packed binary"))
    n = blocks.count()
    ranges, lots = max(1, min(MOST_RANGES, n // BLOCKS_A_RANGE)), -(-n // FAN_IN) or 1
    named = {"key": key, "text": text}
    seeds = mapped(blocks, partial(_seed_entries, ranges=ranges, **named), "range bigint, block bigint, hash binary, several binary")
    shared = _exchanged(
        seeds, ranges, lots, _shared_seeds, _seeds_of_lot, _seeds_over_lots, _seeds_to_blocks, "hash binary, several binary", "hash binary", "block bigint, hash binary"
    )
    shared = shared.groupBy("block").agg(F.collect_list("hash").alias("shared"))
    windows = mapped(
        blocks.join(shared, "block", "left"),  # left as below, so that one exchange of the blocks serves all
        partial(_window_entries, ranges=ranges, **named),
        "range bigint, block bigint, hash binary, second binary, doc binary, spot binary",
    )
    fields, answers = "hash binary, second binary, doc binary, spot binary", "block bigint, hash binary, second binary, owner binary, spot binary"
    owned = _exchanged(windows, ranges, lots, _owned_windows, _windows_of_lot, _windows_over_lots, _windows_to_blocks, fields, fields, answers)
    owned = blocks.join(owned.groupBy("block").agg(F.collect_list(F.struct("hash", "second", "owner", "spot")).alias("owned")), "block", "left")
    links = mapped(owned, partial(_links, salts=min(lots, MOST_SALTS), **named), "doc bigint, salt bigint, block bigint, segments binary")
    met = links.repartition("doc", "salt").sortWithinPartitions("doc", "salt", F.asc_nulls_first("block"))
    known = mapped(met, _answered, "block bigint, doc bigint, segments binary").groupBy("block").agg(F.collect_list(F.struct("doc", "segments")).alias("answers"))
    kind = StructType.fromDDL(SPANS)
    from pyspark.sql.pandas.types import to_arrow_schema

    return mapped(owned.join(known, "block", "left"), partial(_factored, schema=to_arrow_schema(kind), **named), schema)


def op6_query(docs: DataFrame) -> DataFrame:
    """The digest of query op6."""
    done = dedup_substrings(docs.select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
