"""State between runs as tables: the manifest of scanned files, offsets, and run histories.

A table is a folder of Parquet snapshots, one for each version; the newest is
read, and writing a new one never touches what readers hold.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, mtime_us bigint, size bigint, fingerprint string"
OFFSETS = "file string, size bigint, fingerprint string, lines bigint"
SESSION_RUNS = "timestamp_epoch bigint, file string, redactions bigint, duration_ms bigint, file_size_bytes bigint"
SCAN_RUNS = "timestamp_epoch bigint, files_scanned bigint, files_modified bigint, total_redactions bigint, errors bigint, duration_ms bigint, dry_run boolean, files_cached bigint, redactions_by_pattern map<string,bigint>"


class StateTable:
    """A snapshot table below ``root``. A missing one reads as empty."""

    def __init__(self, spark: SparkSession, root: str, name: str, ddl: str, keep: int = 2):
        self.spark, self.root, self.ddl, self.keep = spark, f"{root.rstrip('/')}/{name}", ddl, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete snapshots, oldest first."""
        if not self._fs.exists(self._path):
            return []
        done = (s.getPath() for s in self._fs.listStatus(self._path))
        ok = [p.getName() for p in done if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in ok if n.startswith("v") and n[1:].isdigit())

    def read(self) -> DataFrame:
        """The newest snapshot that can be read; a damaged one counts as missing."""
        for version in reversed(self.versions()):
            found = self.spark.read.schema(self.ddl).parquet(f"{self.root}/v{version}")
            try:
                found.write.format("noop").mode("overwrite").save()  # state is small; damage shows when it is read
            except Exception as error:  # whatever is wrong with a file, state can be made anew
                warnings.warn(f"{self.root}/v{version} can't be read: {str(error).splitlines()[0]}", stacklevel=2)
            else:
                return found
        return self.spark.createDataFrame([], self.ddl)

    def write(self, df: DataFrame) -> None:
        """A new snapshot; of the old ones the newest stays for running readers.

        A version's folder appears by one rename, which fails if another writer
        has taken the number, and is then tried with the next.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        temp = f"{self.root}/_{uuid.uuid4().hex}"
        df.write.parquet(temp)
        while True:
            found = self.versions()
            to = path(f"{self.root}/v{found[-1] + 1 if found else 0}")
            if not self._fs.exists(to) and self._fs.rename(path(temp), to):
                break
        for old in found[: max(0, len(found) + 1 - self.keep)]:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{old}"), True)

    def append(self, rows: DataFrame, newest: int | None = None, order: str = "timestamp_epoch") -> None:
        """Add rows; with ``newest``, a history of so many is kept."""
        both = self.read().unionByName(rows)
        self.write(both.orderBy(F.desc(order)).limit(newest) if newest else both)


def partitioned(files: DataFrame, manifest: DataFrame, fingerprint: str) -> DataFrame:
    """``files`` with ``part``: cached for those that the manifest has unchanged under the same settings, else scan. One join serves both."""
    valid = manifest.where(F.col("fingerprint") == fingerprint).select("path", "mtime_us", "size").distinct().withColumn("_known", F.lit(True))
    joined = files.join(valid, ["path", "mtime_us", "size"], "left")
    return joined.withColumn("part", F.when(F.col("_known"), "cached").otherwise("scan")).drop("_known")


def unchanged(files: DataFrame, manifest: DataFrame, fingerprint: str) -> DataFrame:
    """Files whose path, time and size the manifest has under the same settings."""
    valid = manifest.where(F.col("fingerprint") == fingerprint)
    return files.join(valid, ["path", "mtime_us", "size"], "left_semi")


def to_scan(files: DataFrame, manifest: DataFrame, fingerprint: str) -> DataFrame:
    """Files that are new or changed, or all where the settings have changed."""
    valid = manifest.where(F.col("fingerprint") == fingerprint)
    return files.join(valid, ["path", "mtime_us", "size"], "left_anti")


def refreshed(manifest: DataFrame, scanned: DataFrame, present: DataFrame, fingerprint: str) -> DataFrame:
    """The next manifest: scanned files replace their entries, and files that are gone are dropped.

    ``scanned`` must leave out files that failed.
    """
    old = manifest.where(F.col("fingerprint") == fingerprint).join(scanned, "path", "left_anti").join(present, "path", "left_semi")
    new = scanned.select("path", "mtime_us", "size", F.lit(fingerprint).alias("fingerprint"))
    return old.unionByName(new)


def pending(files: DataFrame, offsets: DataFrame, fingerprint: str) -> DataFrame:
    """(file, size, skip, lines_before) of files with anything new: ``skip`` bytes were done before, with so many lines where that is known.

    A file of its recorded size is left out, a longer one resumes there, a
    shorter one was replaced and starts anew.
    """
    lines = F.col("lines") if "lines" in offsets.columns else F.lit(None).cast("long")
    valid = offsets.where(F.col("fingerprint") == fingerprint).select("file", F.col("size").alias("_done"), lines.alias("lines_before"))
    rows = files.join(valid, "file", "left").where(F.col("_done").isNull() | (F.col("_done") != F.col("size")))
    resumes = F.col("_done") < F.col("size")
    rows = rows.withColumn("skip", F.when(resumes, F.col("_done")).otherwise(F.lit(0).cast("long")))
    return rows.withColumn("lines_before", F.when(resumes, F.col("lines_before"))).drop("_done")
