"""Writers of scrubbed files: to a new folder, or in place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_bytes(scrubbed: DataFrame) -> DataFrame:
    """``scrubbed`` with ``_bytes``, what is to be written of each line: its own bytes unless it was redacted."""
    raw = F.col("raw") if "raw" in scrubbed.columns else F.lit(None).cast("binary")
    own = F.when((F.col("status") != "redacted") & raw.isNotNull(), raw).otherwise(F.col("new_line").cast("binary"))
    return scrubbed.withColumn("_bytes", own)


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write sorted lines beside their file, then rename over it; a file's lines pass by one batch at a time."""
    import os
    import shutil
    import tempfile

    from sievelight.sources.lines import local_path

    file = path = temp = out = None
    done: list[tuple[str, int]] = []

    def finish() -> None:
        nonlocal out, temp
        if out is not None:
            out.close()
            size = os.path.getsize(temp)
            os.chmod(temp, os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644)
            os.replace(temp, path)
            done.append((file, size))
            out = temp = None

    try:
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column("file")), 0
            for name, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if name != file:
                    finish()
                    skip = batch.column("skip")[start].as_py()
                    file, path = name, local_path(name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path))
                    out = os.fdopen(handle, "wb")
                    if skip:
                        with open(path, "rb") as old:  # the part done before stays as it is
                            shutil.copyfileobj(_Head(old, skip), out)
                out.write(b"\n".join([*batch.column("_bytes").slice(start, stop - start).to_numpy(zero_copy_only=False), b""]))
                start = stop
        finish()
    except BaseException:
        if out is not None:
            out.close()
            os.unlink(temp)
        raise
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["file", "size"])


class _Head:
    """The first bytes of an open file."""

    def __init__(self, file, left: int):
        self.file, self.left = file, left

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines by file. Few large files are dealt over more tasks than cores, which evens them out."""
    spark = lines.sparkSession
    least = 4 * spark.sparkContext.defaultParallelism
    return lines.repartition("file") if int(spark.conf.get("spark.sql.shuffle.partitions")) >= least else lines.repartition(least, "file")


def _replaced(lines: DataFrame) -> list[tuple[str, int]]:
    """Write the files of (file, line_number, skip, _bytes) rows."""
    ordered = _dealt(lines).sortWithinPartitions("file", "line_number").select("file", "skip", "_bytes")
    return [tuple(r) for r in ordered.mapInArrow(_replace, "file string, size bigint").collect()]


def write_in_place(scrubbed: DataFrame, few: bool = True) -> list[tuple[str, int]]:
    """Replace each file that has a redacted line, atomically; returns (file, new size).

    For file systems that every executor mounts; elsewhere write a new folder.
    All lines get ``\\n`` as their end; the bytes of lines without a redaction
    stay. ``skip``, where there is such a column, are the bytes of a resumed
    file that stay in front. A file's lines are sorted and streamed, so it
    may be of any size. ``few``: names of the changed files can be broadcast,
    and only lines of these are shuffled.
    """
    skip = F.col("skip") if "skip" in scrubbed.columns else F.lit(0)
    changed = scrubbed.where("status = 'redacted'").select("file").distinct()
    lines = line_bytes(scrubbed).join(F.broadcast(changed) if few else changed, "file", "left_semi").select("file", "line_number", skip.cast("long").alias("skip"), "_bytes")
    return _replaced(lines)  # a row for each changed file


def write_files(lines: DataFrame) -> list[tuple[str, int]]:
    """Write (file, line_number, line) rows to the local or mounted files they name; returns (file, size)."""
    rows = lines.select("file", "line_number", F.lit(0).cast("long").alias("skip"), F.col("line").cast("binary").alias("_bytes"))
    return _replaced(rows)  # a row for each file


def write_folder(scrubbed: DataFrame, path: str) -> None:
    """Every line in a new folder, in order; ``source=`` sub-folders carry a file's address, percent-encoded."""
    lines = line_bytes(scrubbed).select(F.url_encode("file").alias("source"), "line_number", F.col("_bytes").cast("string").alias("value"))
    lines.repartitionByRange("source", "line_number").sortWithinPartitions("source", "line_number").select("source", "value").write.partitionBy("source").text(path)
