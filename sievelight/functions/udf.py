"""The kernel as functions for SQL: scrub a text, a JSON value or a message, and list findings."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, arrow_udtf

from sievelight.config import Settings
from sievelight.functions.kernel import Scrubber, parse_json, write_json

RESULT = "struct<text: string, redactions: array<struct<pattern_name: string, start: int, end: int, matched_text: string>>>"
LINE = "struct<new_line: string, redactions: array<struct<pattern_name: string, start: int, end: int, matched_text: string>>, status: string>"
_FIELDS = ("pattern_name", "start", "end", "matched_text")
_KIND = pa.struct([("text", pa.string()), ("redactions", pa.list_(pa.struct([("pattern_name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched_text", pa.string())])))])

_LINE_KIND = pa.struct([("new_line", pa.string()), ("redactions", _KIND.field("redactions").type), ("status", pa.string())])
_FOUND = (("line", pa.string()), ("pattern_name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("matched_text", pa.string()))


def _json(scrubber: Scrubber, rule) -> object:
    def scrub(text: str) -> tuple[str, list]:
        try:
            value = parse_json(text)
        except ValueError:
            return text, []
        new, found = rule(scrubber)(value)
        return (write_json(new), found) if found else (text, [])

    return scrub


def _function(settings: Settings, of):
    """An Arrow function over batches of texts; rules are compiled once a task, and null stays null."""

    @arrow_udf(RESULT)
    def scrub(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rule = of(Scrubber(settings))
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                if text is None:
                    out.append(None)
                else:
                    new, found = rule(text)
                    out.append({"text": new, "redactions": [dict(zip(_FIELDS, r, strict=True)) for r in found]})
            yield pa.array(out, _KIND)

    return scrub


def scrub_text(settings: Settings):
    """Twin of the native ``detect.scrub``, for custom patterns that have no native form."""
    return _function(settings, lambda s: s.scrub_text)


def scrub_json(settings: Settings):
    """Every string of a JSON value; what is no JSON stays."""
    return _function(settings, lambda s: _json(s, lambda x: x.scrub_tree))


def scrub_message(settings: Settings):
    """A JSON message, where its type says."""
    return _function(settings, lambda s: _json(s, lambda x: x.scrub_message))


def scrub_line(settings: Settings):
    """A line of JSON: its new text, its different findings, and what became of it; null for null."""

    @arrow_udf(LINE)
    def scrub(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scrubber = Scrubber(settings)
        for batch in batches:
            yield _scrubbed(scrubber, batch)

    return scrub


def _scrubbed(scrubber: Scrubber, batch: pa.Array) -> pa.Array:
    """A batch of lines as ``scrub_line`` returns it."""
    collects = gc.isenabled()
    gc.disable()  # JSON values hold no cycles, and many live at once
    try:
        return _line_array([None if line is None else safe(scrubber, line) for line in batch.to_numpy(zero_copy_only=False).tolist()])
    finally:
        if collects:
            gc.enable()


def _line_array(rows: list[tuple | None]) -> pa.Array:
    """Rows of (new line, redactions, status) as one array, made column by column."""
    found = [x for r in rows if r is not None for x in r[1]]
    columns = list(zip(*found, strict=True)) or [()] * len(_FIELDS)
    kind = _LINE_KIND.field("redactions").type
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
    offsets = pa.array([0, *accumulate(0 if r is None else len(r[1]) for r in rows)], pa.int32())
    missing = pa.array([r is None for r in rows], pa.bool_())
    new, status = (pa.array([None if r is None else r[k] for r in rows], pa.string()) for k in (0, 2))
    return pa.StructArray.from_arrays([new, pa.ListArray.from_arrays(offsets, values, type=kind), status], fields=list(_LINE_KIND), mask=missing)


def safe(scrubber: Scrubber, line: str) -> tuple[str, list, str]:
    """A line that can't be scrubbed stays and is marked, so that it never ends a job."""
    try:
        return scrubber.scrub_line(line)
    except Exception:  # whatever a line does, the others must be scrubbed
        return line, [], "error"


def extract_redactions(settings: Settings):
    """Table function over a table with a column ``line``: all its columns but the line's new text, a row for each different finding."""

    @arrow_udtf(returnType="line string, pattern_name string, start int, end int, matched_text string")
    class Extract:
        def __init__(self):
            self.scrubber = Scrubber(settings)

        def eval(self, batch: pa.RecordBatch):
            lines = batch.column("line").to_pylist()
            found = [(line, *x) for line in lines if line is not None for x in safe(self.scrubber, line)[1]]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.table({name: pa.array(values, kind) for (name, kind), values in zip(_FOUND, columns, strict=True)})

    return Extract


def register(spark: SparkSession, settings: Settings) -> None:
    """Name the functions in SQL: scrub_text, scrub_json, scrub_message and the table function extract_redactions."""
    for f in (scrub_text, scrub_json, scrub_message):
        spark.udf.register(f.__name__, f(settings))
    spark.udtf.register("extract_redactions", extract_redactions(settings))
