"""From lines or messages to findings, and from findings to counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.config import Settings
from sievelight.functions import detect
from sievelight.functions.detect import quoted
from sievelight.functions.patterns import PLACEHOLDER, PREFIX_BYTES, SENSITIVE_KEYS, SKIPPED_PREFIXES

BLANK = r"(?U)^\s*$"


def skippable_sql(line: str) -> str:
    head = f"cast(substring(cast({line} AS binary), 1, {PREFIX_BYTES}) AS string)"
    return "(" + " OR ".join(f"contains({head}, {quoted(p)})" for p in SKIPPED_PREFIXES) + ")"


def skippable(line: str) -> Column:
    """Whether the first bytes of a line name a message type without content."""
    return F.expr(skippable_sql(line))


def candidate_sql(line: str, settings: Settings) -> str:
    """A cheap native test that every line which could change passes, to keep the rest from Python.

    Escapes may hide characters of a keyword or token from it, so a line with
    a backslash always passes; any sensitive name or blocked value may need the walk.
    """
    if settings.block_hashes:
        return "true"
    escape, names = quoted("\\"), quoted("|".join(SENSITIVE_KEYS))
    return f"({detect.may_hit_sql(line, settings)} OR contains({line}, {escape}) OR rlike(lower({line}), {names}))"


def scrub_lines(lines: DataFrame, settings: Settings) -> DataFrame:
    """All columns of ``lines`` with new_line, redactions and status.

    Statuses: blank, skipped, clean, malformed, redacted, error; a null line is blank.
    One pass: native expressions decide what a line is, and only lines that
    could change are not null in what goes to Python, in Arrow batches.
    Nothing is shuffled.
    """
    from sievelight.functions.udf import scrub_line

    skipped = "false" if settings.strict_router else f"{skippable_sql('line')} AND NOT {detect.blocked_sql('line', settings)}"
    known = (
        f"CASE WHEN line IS NULL OR rlike(line, {quoted(BLANK)}) THEN 'blank' WHEN {skipped} THEN 'skipped' "
        # A JSON value that Spark's reader refuses may still be one by our rules; Python decides.
        f"WHEN NOT {candidate_sql('line', settings)} AND try_parse_json(line) IS NOT NULL THEN 'clean' END"
    )
    asked = lines.withColumn("_known", F.expr(known)).withColumn("_done", scrub_line(settings)(F.expr("CASE WHEN _known IS NULL THEN line END")))
    own = {"new_line": "coalesce(_done.new_line, line)", "redactions": f"coalesce(_done.redactions, {detect.NO_REDACTIONS})", "status": "coalesce(_done.status, _known)"}
    return asked.select(*lines.columns, *(F.expr(sql).alias(name) for name, sql in own.items()))


def spans_of(texts: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """(key, start, stop, rank, name, value) rows of all detectors' spans, before the merge.

    Tokens inside a pattern's span and blocked strings inside any span are
    left out: none that starts as early reaches as far, which a running
    maximum tells for spans of one text, sorted once.
    """
    n = len(settings.all_patterns)
    both = F.concat(detect.pattern_spans(text, settings), detect.entropy_tokens(text, settings, n))
    found = texts.select(key, F.explode(both).alias("s")).select(key, "s.*")
    found = _uncovered(found, key, n, settings)
    if not settings.block_strings:
        return found
    hits = texts.select(key, F.explode(detect.block_hits(text, settings, n + 1)).alias("s")).select(key, "s.*")
    blocks = islands(hits, key, touching=False, more={"rank": F.min_by("rank", F.struct("start", -F.col("stop"), "rank"))})
    valued = blocks.join(texts.select(key, F.col(text).alias("_text")), key)  # blocked strings are few
    value = F.col("_text").substr(F.col("start") + 1, F.col("stop") - F.col("start"))
    valued = valued.select(key, "start", "stop", "rank", F.col("pattern_name").alias("name"), value.alias("value")).where(~F.col("value").startswith(PLACEHOLDER))
    return _uncovered(found.unionByName(valued), key, n + 1, settings)


def _uncovered(spans: DataFrame, key: str, rank: int, settings: Settings) -> DataFrame:
    """Spans below ``rank``, and of the others those inside none of them and not allowed."""
    order = Window.partitionBy(key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("rank") < rank, F.col("stop"))).over(order)
    kept = (F.col("rank") < rank) | ((F.coalesce(F.col("_reach"), F.lit(-1)) < F.col("stop")) & ~F.expr(detect.allowed_sql("value", settings)))
    return spans.withColumn("_reach", reach).where(kept).drop("_reach")


def findings(scrubbed: DataFrame, *keys: str) -> DataFrame:
    """One row for each redaction, under the key columns.

    The outer explode keeps Catalyst from inferring a filter below it, which
    would compute the redactions a second time.
    """
    return scrubbed.select(*keys, F.explode_outer("redactions").alias("r")).where("r IS NOT NULL").select(*keys, "r.*")


def different(found: DataFrame, *keys: str) -> DataFrame:
    """A finding once for each key, pattern and text."""
    return found.groupBy(*keys, "pattern_name", "matched_text").agg(F.min("start").alias("start"), F.min_by("end", "start").alias("end"))


def count_by_pattern(found: DataFrame) -> DataFrame:
    """(pattern_name, count), the most frequent first."""
    return found.groupBy("pattern_name").count().orderBy(F.desc("count"), "pattern_name")


def file_results(scrubbed: DataFrame, file: str = "file") -> DataFrame:
    """One row a file: lines, lines_modified, redactions, malformed, errors, undecoded (lines that are no UTF-8)."""
    undecoded = F.count_if(~F.col("is_valid")) if "is_valid" in scrubbed.columns else F.lit(0).cast("long")
    return scrubbed.groupBy(file).agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("status") == "redacted").alias("lines_modified"),
        F.coalesce(F.sum(F.size("redactions")), F.lit(0)).cast("long").alias("redactions"),
        F.count_if(F.col("status") == "malformed").alias("malformed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        undecoded.alias("undecoded"),
    )


def report(found: DataFrame, truncate: bool = True) -> DataFrame:
    """Findings as lines of a difference report; secrets are shortened unless asked for whole."""
    from sievelight.functions.display import escaped, truncate_secret

    shown = truncate_secret(F.col("matched_text")) if truncate else escaped(F.col("matched_text"))
    text = F.concat(F.lit("L"), F.col("line_number").cast("string"), F.lit(": "), shown, F.lit(" → [REDACTED:"), F.col("pattern_name"), F.lit("]"))
    return found.select("file", "line_number", "pattern_name", text.alias("report"))


def islands(spans: DataFrame, key: str, touching: bool = True, more: dict[str, Column] | None = None) -> DataFrame:
    """Merge (key, start, stop, rank, name) rows into islands by windows: the relational form of the merge.

    Each key's spans are sorted once; a running maximum of ends marks where an
    island begins, and a running sum numbers it. Offsets that touch are one
    island only where ``touching`` says so. ``more``: further aggregates.
    """
    order = Window.partitionBy(key).orderBy("start", F.desc("stop"), "rank")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | ((F.col("start") > reach) if touching else (F.col("start") >= reach)), 1).otherwise(0)
    numbered = spans.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("name", F.struct("start", -F.col("stop"), "rank"))
    own = [F.min("start").alias("start"), F.max("stop").alias("stop"), first.alias("pattern_name")]
    return numbered.groupBy(key, "_island").agg(*own, *(c.alias(n) for n, c in (more or {}).items())).drop("_island")
