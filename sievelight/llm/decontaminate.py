"""Operator 8: benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces: a copy with
at most k edits holds one piece unchanged, at its place but for k characters.
One automaton finds all pieces of all items in one pass over a text; around
each hit the item is verified with Myers' bit-parallel edit distance.

Texts and items are compared in lower case with every run of white space as
one space. Items are the stated query set: they are taken in blocks of at most
BLOCK_CHARS characters, one automaton and one pass over the texts each, so what
is broadcast has a bound whatever the benchmark's size.

Defined cases: null and empty texts hold no item; null or empty items are
found nowhere; items under SHORT characters have a budget of 0; of one item in
one row the best place counts, of equals the first; repeated rows and items
each report; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import mapped, settle, split_by

#: Edits allowed for each character of an item, and the length from which any are.
ERROR_RATE = 0.08
SHORT = 30
#: Characters of items whose pieces one automaton holds, in a worker's memory.
BLOCK_CHARS = 1 << 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return int(ERROR_RATE * len(item)) if len(item) >= SHORT else 0


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.item, self.most = item, budget(item)
        self.equal: dict[str, int] = {}
        for i, c in enumerate(item):
            self.equal[c] = self.equal.get(c, 0) | 1 << i

    def search(self, text: str, most: int) -> tuple[int, int] | None:
        """Least distance of the item to a part of ``text``, and the first end of such a part."""
        size = len(self.item)
        mask, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, score, best, end = mask, 0, size, most + 1, -1
        equal = self.equal
        for i, c in enumerate(text):
            e = equal.get(c, 0)
            vertical = e | minus
            e = (((e & plus) + plus) ^ plus) | e
            up = minus | (~(e | plus) & mask)
            down = plus & e
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            up = (up << 1) & mask
            plus = ((down << 1) & mask) | (~(vertical | up) & mask)
            minus = up & vertical
        return None if end < 0 else (best, end)


class Matcher:
    """All items of a block: piece automaton and verification."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.patterns = [Pattern(t) for _, t in items]
        self.backward: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            parts = p.most + 1
            cuts = [len(p.item) * j // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(p.item[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, found)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item in a normalised text."""
        hits: dict[int, list[int]] = {}
        for last, found in self.automaton.iter(text):
            for n, ends in found:
                hits.setdefault(n, []).append(last + 1 - ends)
        out = []
        for n, starts in hits.items():
            best = self._verify(n, text, sorted(set(starts)))
            if best is not None:
                out.append((n, *best))
        return out

    def _verify(self, n: int, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        """Best place among the windows in which the item can begin at ``starts``."""
        p = self.patterns[n]
        size, most, best = len(p.item), p.most, None
        at = 0
        while at < len(starts):
            low = max(0, starts[at] - most)
            high = starts[at] + size + most
            while at + 1 < len(starts) and starts[at + 1] - most <= high:
                at += 1
                high = starts[at] + size + most
            at += 1
            window = text[low:high]
            exact = window.find(p.item)
            got = (0, exact + size) if exact >= 0 else p.search(window, most)
            if got is not None and (best is None or got[0] < best[0]):
                best = (got[0], low + got[1])
                if not got[0]:
                    break
        if best is None:
            return None
        distance, end = best
        if not distance:
            return 0, end - size, end
        back = self.backward.setdefault(n, Pattern(p.item[::-1]))
        length = back.search(text[max(0, end - size - most) : end][::-1], distance)
        return distance, end - length[1], end


FOUND = "item_id bigint, distance int, match_start int, match_end int"


def _search(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items.value)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        rows: list[tuple] = []
        which: list[int] = []
        texts = batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            t = texts[i].as_py()
            if t:
                for n, distance, start, end in matcher.find(normal(t)):
                    which.append(i)
                    rows.append((matcher.ids[n], distance, start, end))
        keys = batch.column(0).take(pa.array(which, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["key", "item_id", "distance", "match_start", "match_end"])


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in blocks of at most BLOCK_CHARS characters, a longer item alone; the driver holds one block."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("bigint"), text).toLocalIterator():
        t = normal(row[1])
        if not t:
            continue
        if held and size + len(t) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row[0], t))
        size += len(t)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, distance, match_start, match_end): each benchmark item found in a row; places in the normalised text."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {narrow.schema['key'].dataType.simpleString()}, {FOUND}"
    out, last = None, None
    for block in blocks(benchmark, item, item_text):
        if last is not None:  # settled, so that no more than one block's automaton is needed at a time
            last = settle(last)
            out = last if out is None else out.union(last)
        last = mapped(narrow, partial(_search, items=spark.sparkContext.broadcast(block)), schema)
    if last is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    return (last if out is None else out.union(last)).withColumnRenamed("key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows with a null key are judged by none and stay."""
    found = contaminated(docs, benchmark, key, text)
    return split_by(docs, key, found.where(F.col(key).isNotNull()).select(F.col(key).alias("_gone")).distinct(), "left_anti")


def op8_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of query op8."""
    return contaminated(docs.select("doc_id", "text"), benchmark)
