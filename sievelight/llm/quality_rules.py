"""Operator 9: compression bands over whole documents and fixed chunks.

Text that repeats itself compresses far better than prose, and random or
encoded text far worse. The ratio (compressed bytes / bytes) of a whole text
must lie in a band that depends on its length, and so must the ratios of its
chunks of fixed size, but for a small share of them. Encoded text whose ratio
prose can have too (hex) is known by its long runs without white space.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; a text shorter than the first limit has no band; repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import byte_lengths, free_names, mapped, plus, text_runs


@dataclass(frozen=True)
class CompressionBands:
    """Limits by UTF-8 length. ``limits``: (bytes from, least ratio, most ratio), ascending."""

    limits: tuple[tuple[int, float, float], ...] = ((256, 0.35, 1.02), (1024, 0.33, 0.80), (4096, 0.30, 0.72), (16384, 0.25, 0.68), (65536, 0.20, 0.66))
    chunk_bytes: int = 4096
    #: Band of one chunk, and the share of chunks that may leave it.
    chunk_least: float = 0.25
    chunk_most: float = 0.65
    #: A chunk with over half its bytes in runs of encoded text is bad from this ratio on: hex lies at 0.52, as dense prose may.
    encoded_least: float = 0.45
    chunk_share: float = 0.25
    level: int = 3

    def band(self, n: int) -> tuple[float, float] | None:
        found = None
        for least, low, high in self.limits:
            if n >= least:
                found = (low, high)
        return found


OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "n_chunks", "n_bad_chunks", "verdict", "kept"]
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: A run of base64 or hex.
_ENCODED = re.compile(rb"[0-9A-Za-z+/=_-]{60,}")


def chunk_is_dense(chunk: bytes, ratio: float, bands: CompressionBands) -> bool:
    """Whether a chunk is incompressible: by its ratio, or as encoded text that doesn't repeat itself."""
    if ratio > bands.chunk_most:
        return True
    return ratio >= bands.encoded_least and 2 * sum(map(len, _ENCODED.findall(chunk))) > len(chunk)


def compression(data: bytes, bands: CompressionBands, compressor) -> tuple[float | None, int, int, str]:
    """Whole ratio, chunks, chunks outside their band, and verdict: ok, repetitive or incompressible."""
    n = len(data)
    band = bands.band(n)
    if band is None:
        return None, 0, 0, "ok"
    ratio = len(compressor.compress(data)) / n
    size = bands.chunk_bytes
    low = high = 0
    starts = list(range(0, n - size + 1, size))
    if n > size and n % size:  # the tail is judged in a last chunk that overlaps the one before
        starts.append(n - size)
    chunks = len(starts) if len(starts) > 1 else 0
    if chunks:
        for at in starts:
            chunk = data[at : at + size]
            r = len(compressor.compress(chunk)) / size
            low += r < bands.chunk_least
            high += chunk_is_dense(chunk, r, bands)
    most = bands.chunk_share * chunks
    if ratio < band[0] or low > most:
        verdict = "repetitive"
    elif ratio > band[1] or high > most:
        verdict = "incompressible"
    else:
        verdict = "ok"
    return ratio, chunks, low + high, verdict


def repeated_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(codes)
    if n < 4:
        return 0
    most = int(codes.max()) + 1
    pair = codes[:-1].astype(np.int64) * most + codes[1:]
    _, pair = np.unique(pair[:-1], return_inverse=True)
    window = pair.astype(np.int64) * most + codes[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
    return len(lines) - len(set(lines))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = text.encode().split()  # bytes split at exactly the six ASCII white space characters
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    codes = pd.factorize(np.array(words, dtype=object))[0] if len(words) > 3 else np.zeros(0, np.int64)
    return len(words), chars, len(_SYMBOLS.findall(text)), duplicate_lines(text), repeated_words(codes)


def _judge(batches: Iterator[pa.RecordBatch], text: str, bands: CompressionBands, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
    for batch in batches:
        texts = batch.column(text)
        for start, stop in text_runs(byte_lengths(texts)):
            part = batch.slice(start, stop - start)
            rows = []
            for t in texts.slice(start, stop - start).to_pylist():
                n, chars, symbols, lines, repeats = base_counts(t)
                failed = n < 50 or 100 * repeats > 50 * n
                ratio, chunks, bad, verdict = compression((t or "").encode(), bands, compressor)
                rows.append((n, chars, symbols, lines, repeats, failed, ratio, chunks, bad, verdict, not failed and verdict == "ok"))
            own = list(zip(*rows, strict=True))
            arrays = [*part.columns, *(pa.array(v, schema.field(k).type) for k, v in zip(OWN, own, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*part.schema, *(schema.field(k) for k in OWN)]))


def quality_rules(docs: DataFrame, text: str = "text", bands: CompressionBands | None = None) -> DataFrame:
    """All columns of ``docs`` with the base counts, the ratios, the verdict and ``kept``. No shuffle."""
    docs = free_names(docs, OWN)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    own = pa.schema(list(zip(OWN, kinds, strict=True)))
    names = ["bigint"] * 5 + ["boolean", "double", "bigint", "bigint", "string", "boolean"]
    schema = plus(docs, ", ".join(map(" ".join, zip(OWN, names, strict=True))))
    return mapped(docs, partial(_judge, text=text, bands=bands or CompressionBands(), schema=own), schema)


def op9_query(docs: DataFrame) -> DataFrame:
    """The digest of query op9."""
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", *OWN[:6], "kept", F.round("ratio", 6).alias("ratio"), "verdict")
