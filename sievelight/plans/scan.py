"""Whole runs: a scan of a tree, one session's files, and the status report."""

from __future__ import annotations

import json
import time
import warnings
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.config import Settings
from sievelight.functions.display import basename, format_bytes, format_duration_ms, format_epoch, pluralise
from sievelight.operators.findings import count_by_pattern, file_results, findings, report, scrub_lines
from sievelight.operators.statistics import HISTORY, RECENT, SERIES, last_runs, nearest_rank_by, recent_with_redactions, sparklines
from sievelight.plans.state import MANIFEST, OFFSETS, SCAN_RUNS, SESSION_RUNS, StateTable, pending, refreshed, to_scan
from sievelight.sources.lines import discover, guarded, read_lines, read_tails, session_files, whole_name
from sievelight.sources.sinks import write_in_place

#: Files up to which they are opened by name, and up to which their names are broadcast.
BY_NAME, BROADCAST_NAMES = 10_000, 500_000
ROWS = "section string, key string, value string"


@dataclass
class ScanResult:
    """What a scan found. DataFrames are lazy but for ``scrubbed``, which is held until ``close``."""

    scrubbed: DataFrame
    findings: DataFrame
    by_pattern: DataFrame
    files: DataFrame
    report: DataFrame
    summary: dict

    def close(self) -> None:
        self.scrubbed.unpersist()


def _lines_of(spark: SparkSession, root: str, wanted: DataFrame, scanned: int, total: int) -> DataFrame:
    """Lines of the wanted files. Few ones are opened by name; of more the names are broadcast, and only beyond that lines are shuffled."""
    if scanned == total or not scanned:
        return read_lines(spark, root) if scanned else read_lines(spark, root).limit(0)
    if scanned <= BY_NAME:
        return read_lines(spark, [whole_name(r["path"]) for r in wanted.select("path").collect()])
    names = wanted.select(F.col("path").alias("file"))
    return read_lines(spark, root).join(F.broadcast(names) if scanned <= BROADCAST_NAMES else names, "file", "left_semi")


def scan(spark: SparkSession, root: str, settings: Settings, state: str | None = None, fix: bool = False, use_cache: bool = True, truncate: bool = True) -> ScanResult:
    """Scan every ``.jsonl`` file below ``root``; ``fix`` rewrites files with findings in place.

    ``state`` names the folder of the manifest and the run history. Files that
    the manifest has unchanged under the same settings are left out; only a
    fixing scan adds to it.
    """
    began = time.time()
    mark = settings.fingerprint()
    present = discover(spark, root)
    manifest = StateTable(spark, state, "manifest", MANIFEST) if state else None
    wanted = to_scan(present, manifest.read(), mark) if manifest and use_cache else present
    wanted = wanted.persist()
    total, scanned = present.count(), wanted.count()
    scrubbed = scrub_lines(_lines_of(spark, root, wanted, scanned, total), settings).persist()
    found = findings(scrubbed, "file", "line_number")
    files = file_results(scrubbed)
    counts = {r["pattern_name"]: r["count"] for r in count_by_pattern(found).collect()}  # a row for each pattern
    totals = files.agg(F.count_if(F.expr("errors > 0")).alias("failed"), F.count_if(F.expr("redactions > 0")).alias("changed"), F.count_if(F.expr("errors > 0 OR undecoded > 0")).alias("errors")).first()
    if fix and totals["changed"]:
        write_in_place(scrubbed, few=totals["changed"] <= BROADCAST_NAMES)
    summary = {
        "timestamp_epoch": int(began),
        "files_scanned": scanned,
        "files_modified": totals["changed"],
        "total_redactions": sum(counts.values()),
        "errors": totals["errors"],
        "duration_ms": int((time.time() - began) * 1000),
        "dry_run": not fix,
        "files_cached": total - scanned,
        "redactions_by_pattern": counts,
    }
    if state:
        if fix:
            # Sizes have changed since ``wanted`` was read; its paths are persisted, and files that failed stay out.
            now = discover(spark, root)
            done = now.join(wanted.select("path"), "path", "left_semi")
            if totals["failed"]:
                done = done.join(files.where("errors > 0").select(F.col("file").alias("path")), "path", "left_anti")
            manifest.write(refreshed(manifest.read(), done, now, mark))
        StateTable(spark, state, "scan_runs", SCAN_RUNS).append(spark.createDataFrame([tuple(summary.values())], SCAN_RUNS), newest=HISTORY)
    wanted.unpersist()
    return ScanResult(scrubbed, found, count_by_pattern(found), files, report(found, truncate), summary)


def scrub_session(spark: SparkSession, transcript: str, root: str, settings: Settings, state: str, active: bool = False) -> DataFrame | None:
    """Scrub what a transcript and its sub-files have gained since the last call, in place.

    Returns (file, lines, lines_modified, redactions, malformed, errors), or nothing if
    ``active`` says that a run of the same session is still at work.
    """
    if active:
        return None
    began = time.time()
    path = guarded(transcript, root)
    mark = settings.fingerprint()
    offsets = StateTable(spark, state, "offsets", OFFSETS)
    names = [Path(p) for p in session_files(path)]
    sizes = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in names], "file string, size bigint")  # the files of one session
    todo = pending(sizes, offsets.read(), mark).persist()
    lines = read_tails(todo).join(F.broadcast(todo.select("file", "skip")), "file")
    scrubbed = scrub_lines(lines, settings).persist()
    result = file_results(scrubbed)
    rows = result.collect()
    written = dict(write_in_place(scrubbed)) if any(r["redactions"] for r in rows) else {}
    ends = scrubbed.groupBy("file").agg(F.max("line_number").alias("last"), F.bool_and("ended").alias("ended"))
    last = {r["file"]: r["last"] if r["file"] in written else r["last"] - (not r["ended"]) for r in ends.collect()}
    seen = {r["file"]: (r["size"], r["skip"], r["lines_before"]) for r in todo.collect()}
    done = [(f, written.get(f, size), mark, last.get(f, before if skip else 0)) for f, (size, skip, before) in seen.items()]
    done = spark.createDataFrame(done, OFFSETS)
    others = offsets.read().where(F.col("fingerprint") == mark).join(done, "file", "left_anti")
    offsets.write(others.unionByName(done))
    ms = int((time.time() - began) * 1000)
    runs = [(int(began), r["file"], r["redactions"], ms, written.get(r["file"], seen[r["file"]][0])) for r in rows]
    if runs:
        StateTable(spark, state, "session_runs", SESSION_RUNS).append(spark.createDataFrame(runs, SESSION_RUNS), newest=HISTORY)
    out = spark.createDataFrame(rows, result.schema)
    scrubbed.unpersist()
    todo.unpersist()
    return out


def on_event(spark: SparkSession, event: str, root: str, settings: Settings, state: str) -> DataFrame | None:
    """``scrub_session`` for an event as JSON: ``transcript_path``, and ``stop_hook_active`` for a run within a run.

    An event never fails its sender: what can't be used is a warning, and
    nothing is returned. A transcript that doesn't exist is left alone.
    """
    try:
        said = json.loads(event)
        transcript = said["transcript_path"]
        if said.get("stop_hook_active", False):
            return None
        if not Path(transcript).expanduser().exists():
            return None
        return scrub_session(spark, str(Path(transcript).expanduser()), root, settings, state)
    except (ValueError, KeyError, TypeError, AttributeError, PermissionError) as error:
        warnings.warn(f"event not handled: {error!r}", stacklevel=2)
        return None


def coverage(files: DataFrame) -> DataFrame:
    """One row: files and bytes."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def status(spark: SparkSession, root: str, settings: Settings, state: str) -> DataFrame:
    """(section, key, value) rows: configuration, recent redactions, run statistics, the last scan, coverage."""
    runs = StateTable(spark, state, "session_runs", SESSION_RUNS).read()
    scans = StateTable(spark, state, "scan_runs", SCAN_RUNS).read()
    return status_rows(configured(spark, settings), runs, scans, coverage(discover(spark, root)))


def configured(spark: SparkSession, settings: Settings) -> DataFrame:
    """What detection works with, as (section, key, value)."""
    fixed = [
        ("Detection", "built-in patterns", str(len(settings.patterns))),
        ("Detection", "custom patterns", str(len(settings.custom))),
        ("Detection", "entropy", f"on, threshold {settings.entropy.threshold}" if settings.entropy.enabled else "off"),
        ("Config", "allowed hashes", str(len(settings.allow_hashes))),
        ("Config", "blocked strings", str(len(settings.block_strings))),
        ("Config", "blocked hashes", str(len(settings.block_hashes))),
    ]
    return spark.createDataFrame(fixed, ROWS)


def status_rows(rows: DataFrame, runs: DataFrame, scans: DataFrame, covered: DataFrame) -> DataFrame:
    """The report's rows from the run histories and the coverage.

    Each section is one small row unpivoted; histories are bounded.
    """
    recent = recent_with_redactions(runs, "redactions", ["timestamp_epoch", "file"])
    shown = F.concat(pluralise(F.col("redactions"), "redaction", "redactions"), F.lit(", "), format_epoch(F.col("timestamp_epoch")))
    parts = [rows, recent.select(F.lit("Recent redactions").alias("section"), basename(F.col("file")).alias("key"), shown.alias("value"))]
    total = runs.agg(F.count_if(F.col("redactions") > 0).alias("n")).where(F.col("n") > RECENT)
    more = F.concat(F.lit("and "), (F.col("n") - RECENT).cast("string"), F.lit(" more of "), F.col("n").cast("string"))
    parts.append(total.select(F.lit("Recent redactions").alias("section"), F.lit("…").alias("key"), more.alias("value")))
    newest = runs.orderBy(F.desc("timestamp_epoch"), F.desc("file")).limit(1)
    parts.append(_unpivoted(newest, "Stats", {"last run": format_epoch(F.col("timestamp_epoch")), "last file": F.concat(basename(F.col("file")), F.lit(", "), format_bytes(F.col("file_size_bytes"))), "last time": format_duration_ms(F.col("duration_ms"))}))
    latency = nearest_rank_by(runs.withColumn("_all", F.lit(1)), "_all", "duration_ms")
    parts.append(_unpivoted(latency, "Stats", {"runs": F.col("count").cast("string"), "average": F.format_string("%.1fms", F.col("avg")), "p50": format_duration_ms(F.col("p50")), "p95": format_duration_ms(F.col("p95")), "max": format_duration_ms(F.col("max"))}))
    shown = runs.withColumn("_all", F.lit(1))
    last = last_runs(shown, "_all", ["timestamp_epoch", "file"], keep=SERIES)
    for key, column in (("latency", "duration_ms"), ("redactions", "redactions")):
        parts.append(sparklines(last, "_all", ["timestamp_epoch", "file"], column).select(F.lit("Stats").alias("section"), F.lit(key).alias("key"), F.col("series").alias("value")))
    files = F.concat(F.col("files_scanned").cast("string"), F.lit(" scanned, "), F.when(F.col("files_cached") > 0, F.concat(F.col("files_cached").cast("string"), F.lit(" cached, "))).otherwise(""), F.col("files_modified").cast("string"), F.lit(" modified"))
    scan = scans.orderBy(F.desc("timestamp_epoch")).limit(1)
    parts.append(
        _unpivoted(
            scan,
            "Last scan",
            {
                "when": format_epoch(F.col("timestamp_epoch")),
                "mode": F.when(F.col("dry_run"), "dry-run").otherwise("live"),
                "files": files,
                "redactions": F.col("total_redactions").cast("string"),
                "errors": F.col("errors").cast("string"),
                "duration": format_duration_ms(F.col("duration_ms")),
                "throughput": throughput(F.col("duration_ms"), F.col("files_scanned")),
            },
        )
    )
    by = scan.select(F.explode("redactions_by_pattern").alias("key", "n"))
    parts.append(by.select(F.lit("Last scan by pattern").alias("section"), "key", F.col("n").cast("string").alias("value")))
    parts.append(covered.select(F.lit("Coverage").alias("section"), F.col("files").cast("string").alias("key"), format_bytes(F.col("bytes")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def throughput(duration_ms: Column, files: Column) -> Column:
    """Milliseconds a file; null where no file was scanned."""
    return F.when(files > 0, F.format_string("%.1fms/file", duration_ms / files))


def _unpivoted(row: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
    """One row's values as (section, key, value) rows; null ones are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))
    return row.select(F.explode(pairs).alias("p")).where("p.value IS NOT NULL").select(F.lit(section).alias("section"), "p.key", "p.value")
