"""Readers: files of lines, tails of files, the files of a session, and single messages.

Lines come as (file, line_number from 1, line, is_valid, raw). Lines end with
``\\n`` or ``\\r\\n``. A line that is no UTF-8 is kept with replacement
characters and flagged, and ``raw`` has its bytes, so that a writer can leave
it as it was; ``raw`` is null for all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATTERN = "*.jsonl"
#: Files up to this size are one row before they are split; larger ones are read in splits.
WHOLE = 4 << 20
#: Bytes that a tail's reader holds at a time, besides a line's.
STEP = 1 << 20


def read_lines(spark: SparkSession, paths: str | list[str], whole: int = WHOLE) -> DataFrame:
    """Lines of every ``.jsonl`` file below ``paths``, of any size.

    A small file is one row, and its lines are numbered as they are split off.
    Larger files are read in splits; a first pass counts the lines of each
    split, so that lines get their numbers without being shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).load(paths)
    small = split_content(files.where(F.col("length") <= whole).select(F.col("path").alias("file"), "content"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).option("lineSep", "\n").text(paths).where(F.col("_metadata.file_size") > whole)
    at = text.select(F.col("_metadata.file_path").alias("_address"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").cast("binary").alias("_raw"))
    splits = at.groupBy("_address", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_address").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    name = F.url_decode(F.replace(F.col("_address"), F.lit("+"), F.lit("%2B")))  # an address here, a plain path in the other reader
    starts = splits.select("_address", "_block", name.alias("file"), (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    # Splits are few. Without the hint Spark takes them for many, and sends every line to its file's partition.
    numbered = at.join(F.broadcast(starts), ["_address", "_block"])
    large = numbered.select("file", (F.col("_id") + F.col("_shift")).alias("line_number"), "_raw")
    return small.unionByName(_decoded(large))


def _decoded(rows: DataFrame, *more: str) -> DataFrame:
    """(file, line_number, line, is_valid, raw) of rows with a line's bytes ``_raw``, and ``more`` columns."""
    raw = F.expr("CASE WHEN substring(_raw, -1, 1) = X'0D' THEN substring(_raw, 1, octet_length(_raw) - 1) ELSE _raw END")
    text = F.col("_bare").cast("string")
    valid = F.is_valid_utf8(text)
    return rows.withColumn("_bare", raw).select("file", "line_number", F.make_valid_utf8(text).alias("line"), valid.alias("is_valid"), F.when(~valid, F.col("_bare")).alias("raw"), *more)


def split_content(files: DataFrame) -> DataFrame:
    """Lines of (file, content) rows."""
    text = F.col("content").cast("string")
    # Latin-1 has a character for each byte, so invalid files are split byte by byte. How a line was
    # decoded goes along as its first character: the content itself must not pass the explode, where
    # an expression of it would be computed for every line.
    marked = lambda text, mark: F.concat(F.lit(mark), F.replace(F.regexp_replace(text, r"\n\z", ""), F.lit("\n"), F.lit(f"\n{mark}")))
    either = F.when(F.is_valid_utf8(text), marked(text, "u")).otherwise(marked(F.decode("content", "ISO-8859-1"), "b"))
    parts = F.when(F.octet_length("content") == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(either, "\n", -1))
    rows = files.select("file", F.posexplode(parts).alias("_at", "_marked"))
    bare = rows.select("file", (F.col("_at").cast("long") + 1).alias("line_number"), F.col("_marked").startswith("u").alias("_valid"), F.expr(r"regexp_replace(substring(_marked, 2), '\\r\\z', '')").alias("_line"))
    raw = F.when(~F.col("_valid"), F.encode("_line", "ISO-8859-1"))
    rows = bare.select("file", "line_number", "_line", raw.alias("_raw"))
    valid = F.col("_raw").isNull() | F.is_valid_utf8(F.col("_raw").cast("string"))
    line = F.when(F.col("_raw").isNull(), F.col("_line")).otherwise(F.make_valid_utf8(F.col("_raw").cast("string")))
    return rows.select("file", "line_number", line.alias("line"), valid.alias("is_valid"), F.when(~valid, F.col("_raw")).alias("raw"))


def local_path(file: str) -> str:
    """The path on a mounted file system behind a name with ``file:`` in front; nothing in it is encoded."""
    return re.sub("^file:/*", "/", file)


def whole_name(path: str) -> str:
    """A path with every character that a reader takes for a pattern escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _tail(path: str, skip: int, size: int) -> Iterator[bytes]:
    """Lines, each with its end, of the bytes from ``skip`` to ``size``."""
    with open(path, "rb") as f:
        f.seek(skip)
        left, rest = size - skip, b""
        while left > 0 and (data := f.read(min(STEP, left))):
            left -= len(data)
            *lines, rest = (rest + data).split(b"\n")
            yield from (x + b"\n" for x in lines)
        if rest:
            yield rest


def _newlines(path: str, upto: int) -> int:
    with open(path, "rb") as f:
        n, left = 0, upto
        while left > 0 and (data := f.read(min(STEP, left))):
            left -= len(data)
            n += data.count(b"\n")
    return n


def _read_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            path = local_path(r["file"])
            before = (_newlines(path, r["skip"]) if r["lines_before"] is None else r["lines_before"]) if r["skip"] else 0
            rows, held = [], 0
            for k, x in enumerate(_tail(path, r["skip"], r["size"])):
                rows.append((r["file"], before + k + 1, x.removesuffix(b"\n"), x.endswith(b"\n")))
                held += len(x)
                if held > STEP:
                    yield _tail_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _tail_batch(rows)


def _tail_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("file", pa.string()), ("line_number", pa.int64()), ("_raw", pa.binary()), ("ended", pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def read_tails(files: DataFrame) -> DataFrame:
    """Lines of (file, size, skip, lines_before) rows behind ``skip`` bytes, numbered as in the whole file.

    Only the tail is read, unless ``lines_before`` is null, when the lines
    before it are counted. For file systems that every executor mounts. A
    column ``ended`` says whether the line has its end yet.
    """
    tails = files.select("file", "size", "skip", "lines_before").mapInArrow(_read_tails, "file string, line_number bigint, _raw binary, ended boolean")
    return _decoded(tails, "ended")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_us, size) of every ``.jsonl`` file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).load(root)
    return files.select("path", F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"))


def session_files(transcript: str | Path) -> list[str]:
    """A transcript and the files in ``<its name without suffix>/subagents`` beside it."""
    path = Path(transcript)
    return [str(path), *sorted(str(p) for p in (path.parent / path.stem / "subagents").glob(PATTERN))]


def guarded(path: str | Path, root: str | Path) -> Path:
    """The real path, which must exist and lie below ``root``."""
    real = Path(path).expanduser().resolve(strict=True)
    if not real.is_relative_to(Path(root).expanduser().resolve()):
        raise PermissionError(f"{real} lies outside {root}")
    return real
