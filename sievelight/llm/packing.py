"""Operator 3: best-fit decreasing packing of tokenised documents.

Documents become token ids and an end id; only those longer than a sequence are
cut, so that the first piece takes the remainder. Pieces of one length are
interchangeable, so best-fit decreasing needs no more than how many pieces
there are of each length: at most ``capacity`` counters on the driver, whatever
the corpus. A segment tree over remaining capacities finds the tightest open
bins, and all bins alike are filled at once. The plan that results maps the
rank of a piece within its length to a sequence and an offset; ranks are
numbered inside each task's rows, so a length that a third of the pieces share
stays spread out.

Defined cases: a null text is an empty one, and becomes the end id alone;
repeated rows are packed each; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm._common import byte_lengths, mapped, piece_hash, settle, text_runs

CAPACITY = 1024
END_ID = 2
#: Chunks of text whose ids a worker remembers (some 40 bytes each).
MEMO = 1_200_000
#: White space and separators, other than spaces and line ends, where a text is tokenised whole;
#: and the bytes that all of them begin with.
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[*range(10), *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 10]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?|#$%&*"]] = True


def cuttable(path: str) -> bool:
    """Whether a tokenizer splits at the places where ``Memo`` cuts: byte-level pre-tokens by their usual expression, no prefix space, no normaliser."""
    import json

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = said.get("pre_tokenizer") or {}
    return said.get("normalizer") is None and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space", True) and steps.get("use_regex", True)


class Memo:
    """A tokenizer that remembers the ids of chunks it has met.

    Byte-level pre-tokens never run from a character that is no white space
    into white space, nor from a letter into a plain mark, so texts are cut
    there and each different chunk is tokenised once. Chunks are known by a
    96-bit hash, kept in sorted arrays; when those are full, chunks not met
    since the last time are dropped. Tokenizers of another kind get whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer, self.cuttable = Tokenizer.from_file(path), cuttable(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum())), counts

    def _keep(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Remember new chunks; ``first`` is sorted and new."""
        if len(self.first) + len(first) > MEMO:
            use = self.met
            take = np.repeat(self.at[use] - (np.cumsum(self.count[use]) - self.count[use]), self.count[use]) + np.arange(int(self.count[use].sum()))
            self.ids = self.ids[take]
            self.first, self.second, self.count = self.first[use], self.second[use], self.count[use]
            self.at = np.cumsum(self.count) - self.count
            self.met = np.zeros(len(self.first), bool)
        if len(self.first) + len(first) > MEMO:
            return
        into = np.searchsorted(self.first, first)
        self.at = np.insert(self.at, into, len(self.ids) + np.cumsum(counts) - counts)
        self.first, self.second = np.insert(self.first, into, first), np.insert(self.second, into, second)
        self.count, self.met = np.insert(self.count, into, counts), np.insert(self.met, into, False)
        self.ids = np.concatenate([self.ids, ids])

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; text i is ``data`` from offsets[i] to offsets[i + 1]."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if not self.cuttable:
            return self._encoded([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        space, edge = _SPACE[data], np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = edge[:-1].copy()
        begin[1:] |= (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        for i in self._whole(data, offsets):
            begin[offsets[i] + 1 : offsets[i + 1]] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        first = piece_hash(data, starts, ends - starts, 0)
        second = (piece_hash(data, starts, ends - starts, 1) >> np.uint64(32)).astype(np.uint32)
        different, where, of = np.unique(first, return_index=True, return_inverse=True)
        if (second[where][of] != second).any():  # two chunks of one hash: as good as never, and then not hashed
            return self._encoded([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        second = second[where]
        spot = np.minimum(np.searchsorted(self.first, different), max(0, len(self.first) - 1))
        known = (self.first[spot] == different) & (self.second[spot] == second) if len(self.first) else np.zeros(len(different), bool)
        self.met[spot[known]] = True
        new = np.flatnonzero(~known)
        at, count = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
        at[known], count[known] = self.at[spot[known]], self.count[spot[known]]
        made, counts = self._encoded([data[starts[k] : ends[k]].tobytes().decode() for k in where[new]])
        pool = np.concatenate([self.ids, made])
        at[new], count[new] = len(self.ids) + np.cumsum(counts) - counts, counts
        each = count[of]
        total = np.cumsum(each)
        flat = pool[np.repeat(at[of] - (total - each), each) + np.arange(int(total[-1]))]
        owner = np.searchsorted(offsets[1:], starts, side="right")
        fresh = (self.first[spot[new]] != different[new]) if len(self.first) else np.ones(len(new), bool)
        take = np.repeat(fresh, counts)
        self._keep(different[new][fresh], second[new][fresh], made[take], counts[fresh])
        return flat, np.bincount(owner, each, n).astype(np.int64)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that hold other white space than spaces and line ends, or an added token's string."""
        odd = np.flatnonzero(_ODD_BYTES[data])
        doubtful = set(np.unique(np.searchsorted(offsets[1:], odd, side="right")).tolist())
        found = [i for i in doubtful if _ODD.search(data[offsets[i] : offsets[i + 1]].tobytes().decode())]
        whole = data.tobytes()
        for a in self.added:
            at = whole.find(a)
            while at >= 0:
                found.append(int(np.searchsorted(offsets[1:], at, side="right")))
                at = whole.find(a, at + 1)
        return found


@lru_cache(2)
def _memo(path: str) -> Memo:
    return Memo(path)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, without special tokens, and how many each text has; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return _memo(path).tokens(data, offsets - offsets[0])


def _to_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch.column("text")
        for start, stop in text_runs(byte_lengths(texts)):
            which, piece, first, ids = [], [], [], []
            flat, counts = token_ids(texts.slice(start, stop - start), path)
            flat = flat.astype("<u4", copy=False)
            at = 0
            for i, n in enumerate(counts.tolist(), start):
                data = flat[at : at + n].tobytes() + end
                at += n
                a, b, k = 0, (n + 1) % capacity or capacity, 0
                while a <= n:
                    which.append(i)
                    piece.append(k)
                    first.append(a)
                    ids.append(data[4 * a : 4 * b])
                    a, b, k = b, b + capacity, k + 1
            key = batch.column("key").take(pa.array(which, pa.int64()))
            length = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([key, pa.array(piece, pa.int32()), pa.array(first, pa.int64()), length, pa.array(ids, pa.binary())], names=["key", "piece", "start", "length", "ids"])


def to_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids): ids are little-endian unsigned 32-bit integers. No shuffle."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary"
    return mapped(narrow, partial(_to_pieces, path=tokenizer, capacity=capacity, end_id=end_id), schema).withColumnRenamed("key", key)


class SegmentTree:
    """Which remaining capacities have open bins; finds the least that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, at: int, open_: bool) -> None:
        at += self.size
        self.any[at] = open_
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The least marked capacity of at least ``least``."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` of lengths.

    Rows (length, first rank, pieces, first sequence, offset): the pieces of a
    length with these ranks go to consecutive sequences, one each.
    """
    tree = SegmentTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs of sequences
    plan, sequences = [], 0

    def add(room: int, first: int, bins: int) -> None:
        if bins and room:
            open_bins.setdefault(room, []).append((first, bins))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, bins = sequences, -(-left // (capacity // length))
                sequences += bins
            else:
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.mark(room, False)
            each = room // length  # best fit returns to the bin it has just used while that has room
            full = min(bins, left // each)
            for k in range(each):
                if full:
                    plan.append((length, rank, full, first, capacity - room + k * length))
                    rank += full
            add(room - each * length, first, full)
            left -= full * each
            first, bins = first + full, bins - full
            if bins and left:
                last = min(left, each)
                for k in range(last):
                    plan.append((length, rank, 1, first, capacity - room + k * length))
                    rank += 1
                add(room - last * length, first, 1)
                left -= last
                first, bins = first + 1, bins - 1
            add(room, first, bins)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """All columns of ``pieces`` with sequence_id and offset. Lengths from 1 to ``capacity``.

    The rows are written to the shared folder first, so that tokenising isn't
    done twice and ranks are stable; leave large columns out and join them by
    key and piece if they are needed in place.
    """
    spark = pieces.sparkSession
    rows = settle(pieces.withColumn("_task", F.spark_partition_id()))
    groups = settle(rows.groupBy(F.col(length).alias("_length"), F.col("_task").alias("_of")).agg(F.count("*").alias("_n")))
    counts = {r[0]: r[1] for r in groups.groupBy("_length").agg(F.sum("_n")).collect()}  # capacity rows at most
    plan = best_fit(counts, capacity)
    before = Window.partitionBy("_length").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("_length", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = [F.col(c) for c in pieces.columns if c != length and pieces.schema[c].dataType.typeName() not in ("map", "variant")]
    rank = F.row_number().over(Window.partitionBy(length, "_task").orderBy(*order)) - 1
    ranked = rows.join(offsets, (F.col(length) == F.col("_length")) & (F.col("_task") == F.col("_of"))).withColumn("_rank", F.col("_before") + rank)
    table = spark.createDataFrame(plan, "_l bigint, _first bigint, _count bigint, sequence_first bigint, offset bigint")
    fits = (F.col(length) == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    placed = ranked.join(F.broadcast(table), fits)  # the plan's size depends on the capacity alone
    placed = placed.withColumn("sequence_id", F.col("sequence_first") + F.col("_rank") - F.col("_first"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    pieces = to_pieces(docs, tokenizer, key, text)
    return pack(pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digest of query op3."""
    return pack_documents(docs, tokenizer)
