"""Incremental scans on Structured Streaming.

The file source's checkpoint replaces offsets by file: each new file is read
once, and every batch is scrubbed by the same operators as a batch scan. For
messages that arrive as rows, ``new_lines`` keeps the highest line of each file
as state and lets only later ones through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievelight.config import Settings
from sievelight.operators.findings import scrub_lines


def stream_scan(spark: SparkSession, source: str, sink: str, checkpoint: str, settings: Settings, available_now: bool = True, per_trigger: int = 1000) -> StreamingQuery:
    """Scrub every new ``.jsonl`` file below ``source`` and append (file, line, new_line, redactions, status) to ``sink``."""
    lines = (
        spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", per_trigger).schema("value string").load(source)
    )
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    writer = scrub_lines(named, settings).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _later(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else 0
    most = last
    for rows in batches:
        fresh = rows[rows["line_number"] > last].sort_values("line_number")
        fresh = fresh.drop_duplicates("line_number")
        if len(fresh):
            most = max(most, int(fresh["line_number"].max()))
            yield fresh[["file", "line_number", "line"]]
    state.update((most,))


def new_lines(lines: DataFrame) -> DataFrame:
    """Of streamed (file, line_number, line) rows those beyond the highest number seen of their file."""
    return lines.groupBy("file").applyInPandasWithState(_later, "file string, line_number bigint, line string", "last bigint", "append", GroupStateTimeout.NoTimeout)
