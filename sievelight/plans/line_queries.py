"""Registered queries over lines of JSON, trees of files, state and settings.

Lines are made from templates in which ``@+`` stands for a mail address that
has to go, ``@-`` for one that stays where it is and ``@!`` for a sensitive
field's value, so that SQL knows every rewritten line. Trees of files are
written to the folder that ``spark.checkpoint.dir`` names, or else a temporary one.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.config import RULESET, Entropy, Settings, parse, sha256_hex
from sievelight.functions import detect, display, udf
from sievelight.functions.patterns import BUILT_IN, Pattern
from sievelight.operators import findings as ops
from sievelight.plans import scan as plans
from sievelight.plans import state
from sievelight.plans.queries import _BLOCKED, _MAIL_RX, _MAILS, _TALKS, CUSTOM, _documents, _durations, _DURATIONS_DUCK, _files, _FILES_DUCK, _manifest, _quoted, conversation_lines, query
from sievelight.sources import lines as src
from sievelight.sources.sinks import write_files

MAIL = "[REDACTED:mail-address]"
FORCED = "[REDACTED:sensitive-field]"
#: Messages of each type and shape, with keys in order as a rewritten line has them.
MESSAGES = (
    '{"message":{"content":"a @+ b"},"type":"user"}',
    '{"message":{"content":[{"text":"@+","type":"text"},"@+"]},"type":"user"}',
    '{"message":{"content":[{"source":{"data":"@-"},"type":"image"}]},"type":"user"}',
    '{"message":{"content":[{"content":[{"data":"@+","type":"image"}],"type":"tool_result"}]},"type":"user"}',
    '{"message":{"content":"a"},"toolUseResult":{"stdout":"@+"},"type":"user"}',
    '{"cwd":"@-","message":{"content":"a"},"type":"user"}',
    '{"message":{"content":{"k":"@+"}},"type":"user"}',
    '{"message":{"content":[{"content":["@+"],"id":"@-","input":{"a":["@+"]},"text":"@+","thinking":"@+"}]},"type":"assistant"}',
    '{"message":{"content":"@-"},"type":"assistant"}',
    '{"message":{"content":[{"text":"@-","type":"image"},"@-"]},"type":"assistant"}',
    '{"data":{"x":"@+"},"other":"@-","type":"progress"}',
    '{"content":"@+","other":"@-","type":"queue-operation"}',
    '{"content":"@-","type":"system"}',
    '{"snapshot":"@-","type":"file-history-snapshot"}',
    '{"deep":[[{"x":"@+"}]],"type":"novel"}',
    '["@+",{"password":"@!"}]',
    '{"api_key":["@!",["@!"]],"credentials":{"user":"@+"},"passwordless":"@+","type":"novel"}',
    '{"message":{"id":"@-"},"type":"assistant"}',
)
#: Lines that the line scrubber tells apart: each with its status.
LINES = (
    *((m, "redacted" if "@+" in m or "@!" in m else "clean") for m in MESSAGES if '"type":"system"' not in m and "snapshot" not in m),
    ('{"type":"system","content":"@-"}', "skipped"),
    ('{"type":"file-history-snapshot","content":"@-"}', "skipped"),
    ('{"p":"' + "x" * 37 + '","type":"system"}', "skipped"),  # the type ends with the 60th byte
    ('{"p":"' + "x" * 38 + '","type":"system"}', "clean"),
    ('{"type": "system","content":"@-"}', "clean"),
    ("", "blank"),
    (" \t ", "blank"),
    ('{"type":"user",@-', "malformed"),
    ("{oops", "malformed"),
    ('{"n":1.50}', "clean"),
)


def _case(key: str, values: list[str]) -> str:
    return f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values)) + " END)"


def _filled(template: str, key: str, duck: bool, gone: str | None = None, kept: str | None = None, forced: str | None = None) -> str:
    """SQL of a template's line, each kind of place with its own value or else the address."""
    mail = f"'user' || CAST({key} AS {'VARCHAR' if duck else 'STRING'}) || '@mail.example'"
    value = lambda v: mail if v is None else _quoted(v)
    return f"replace(replace(replace({template}, '@+', {value(gone)}), '@-', {value(kept)}), '@!', {value(forced)})"


def _places(template: str, marks: str) -> str:
    return " + ".join(f"(length({template}) - length(replace({template}, '{m}', ''))) // 2" for m in marks.split())


def _events(spark: SparkSession, sf_dir: str, templates: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return rows.select("event_id", F.expr(_filled(_case("event_id", templates), "event_id", False)).alias("line"))


_MESSAGE = _case("event_id", list(MESSAGES))


@query(f"SELECT event_id, {_filled(_MESSAGE, 'event_id', True, gone=MAIL, forced=FORCED)} AS text, CAST({_places(_MESSAGE, '@+ @!')} AS INTEGER) AS n FROM events")
def message_paths(spark, sf_dir):
    """Messages of every type, scrubbed where their type says; images stay."""
    done = _events(spark, sf_dir, list(MESSAGES)).withColumn("r", udf.scrub_message(_MAILS)("line"))
    return done.select("event_id", "r.text", F.size("r.redactions").alias("n"))


@query(f"SELECT event_id, {_filled(_MESSAGE, 'event_id', True, gone=MAIL, kept=MAIL, forced=FORCED)} AS text, CAST({_places(_MESSAGE, '@+ @- @!')} AS INTEGER) AS n FROM events")
def json_tree_leaves(spark, sf_dir):
    """The same values walked whole: every leaf, with sensitive fields' values replaced, also in arrays but not in objects below."""
    udf.register(spark, _MAILS)
    _events(spark, sf_dir, list(MESSAGES)).createOrReplaceTempView("sievelight_messages")
    return spark.sql("SELECT event_id, r.text, size(r.redactions) AS n FROM (SELECT event_id, scrub_json(line) AS r FROM sievelight_messages)")


_LINE = _case("event_id", [t for t, _ in LINES])
_STATUS = _case("event_id", [s for _, s in LINES])
_NEW_LINE = _filled(_LINE, "event_id", True, gone=MAIL, forced=FORCED)
#: Different findings of a line: one address, and one forced value.
_FOUND = f"(CASE WHEN contains({_LINE}, '@+') THEN 1 ELSE 0 END + CASE WHEN contains({_LINE}, '@!') THEN 1 ELSE 0 END)"


@query(f"SELECT event_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'redacted' THEN {_NEW_LINE} ELSE {_filled(_LINE, 'event_id', True)} END AS new_line, CAST({_FOUND} AS INTEGER) AS n FROM events")
def line_statuses(spark, sf_dir):
    """What becomes of blank, skipped, malformed, clean and redacted lines."""
    done = ops.scrub_lines(_events(spark, sf_dir, [t for t, _ in LINES]), _MAILS)
    return done.select("event_id", "status", "new_line", F.size("redactions").alias("n"))


@query(f"WITH {_TALKS} SELECT 'c' || CAST(conv_id AS VARCHAR) AS file, pattern_name, matched_text, n FROM (SELECT conv_id, 'mail-address' AS pattern_name, value AS matched_text, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, {_MAIL_RX})) AS value FROM talks WHERE role <> 'system') WHERE strlen(value) >= 8 GROUP BY ALL)")
def table_function_findings(spark, sf_dir):
    """Findings by the Arrow table function over a whole table of lines."""
    udf.register(spark, _MAILS)
    conversation_lines(spark, sf_dir).createOrReplaceTempView("sievelight_lines")
    found = spark.sql("SELECT r.* FROM extract_redactions(TABLE(SELECT concat(file, ' ', line) AS tagged, line FROM sievelight_lines)) r")
    files = spark.table("sievelight_lines").select("file", "line").distinct()
    return found.distinct().join(files, "line").groupBy("file", "pattern_name", "matched_text").agg(F.count("*").alias("n"))


# Trees of files ----------------------------------------------------------------------------------------------


def _root(spark: SparkSession) -> str:
    """A new folder for a tree of files, removed at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        path = tempfile.mkdtemp(prefix="sievelight-")
    else:
        path = f"{src.local_path(shared)}/tree-{uuid.uuid4().hex}"
        Path(path).mkdir(parents=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


FILES = 40
_IN_FILES = f"SELECT event_id, event_id % {FILES} AS f, event_id // {FILES} + 1 AS line_number, {{line}} AS line FROM events"
_TREE = f"tree AS ({_IN_FILES.format(line=_filled(_LINE, 'event_id', True))}), new_tree AS (SELECT event_id, f, line_number, {_STATUS} AS status, {_FOUND} AS n, CASE WHEN {_STATUS} = 'redacted' THEN {_NEW_LINE} ELSE line END AS line FROM tree)"


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Every FILES-th event's line in one file, half of them one level deeper; and a file that is no line file."""
    root = _root(spark)
    lines = _events(spark, sf_dir, [t for t, _ in LINES])
    f = F.col("event_id") % FILES
    name = F.concat(F.lit(f"{root}/p"), F.when(f % 2 == 0, "/deep").otherwise(""), F.lit("/f"), f.cast("string"), F.when(f == FILES - 1, ".txt").otherwise(".jsonl"))
    write_files(lines.select(name.alias("file"), F.floor(F.col("event_id") / FILES).alias("line_number"), "line"))
    return root


def _file_number(file) -> F.Column:
    return F.regexp_extract(display.basename(file), r"f(\d+)\.jsonl", 1).cast("long")


@query(
    f"WITH {_TREE} SELECT f, count(*) AS lines, count(*) FILTER (WHERE status = 'redacted') AS lines_modified, CAST(sum(n) AS BIGINT) AS redactions, count(*) FILTER (WHERE status = 'malformed') AS malformed, CAST(0 AS BIGINT) AS errors FROM new_tree WHERE f <> {FILES - 1} GROUP BY f"
)
def scan_files(spark, sf_dir):
    """A dry run over a tree: each file's counts."""
    seen = plans.scan(spark, _tree(spark, sf_dir), _MAILS)
    return seen.files.select(_file_number(F.col("file")).alias("f"), "lines", "lines_modified", "redactions", "malformed", "errors")


@query(f"WITH {_TREE} SELECT pattern_name, count(*) AS count FROM (SELECT unnest(CASE WHEN contains({_LINE}, '@+') THEN ['mail-address'] ELSE [] END || CASE WHEN contains({_LINE}, '@!') THEN ['sensitive-field'] ELSE [] END) AS pattern_name FROM new_tree WHERE f <> {FILES - 1}) GROUP BY pattern_name")
def scan_by_pattern(spark, sf_dir):
    """Redactions of a tree by pattern."""
    return plans.scan(spark, _tree(spark, sf_dir), _MAILS).by_pattern


@query(
    f"WITH {_TREE} SELECT f, line_number, 'L' || CAST(line_number AS VARCHAR) || ': user' || substr(CAST(event_id AS VARCHAR) || '@mail.example', 1, 4) || '...mple → {MAIL}' AS report FROM new_tree WHERE f <> {FILES - 1} AND contains({_LINE}, '@+')"
)
def scan_report(spark, sf_dir):
    """The difference report of a tree, with line numbers from 1."""
    seen = plans.scan(spark, _tree(spark, sf_dir), _MAILS)
    return seen.report.where("pattern_name = 'mail-address'").select(_file_number(F.col("file")).alias("f"), "line_number", "report")


@query(f"WITH {_TREE} SELECT f, line_number, line FROM new_tree WHERE f <> {FILES - 1}")
def scan_fixed_lines(spark, sf_dir):
    """A tree fixed in place and read again, every line."""
    root = _tree(spark, sf_dir)
    plans.scan(spark, root, _MAILS, fix=True).close()
    return src.read_lines(spark, root).select(_file_number(F.col("file")).alias("f"), "line_number", "line")


@query(f"WITH {_TREE} SELECT f, line_number, line, true AS is_valid FROM tree WHERE f <> {FILES - 1}")
def lines_of_split_files(spark, sf_dir):
    """Lines of files read in splits, numbered without a shuffle of lines."""
    rows = src.read_lines(spark, _tree(spark, sf_dir), whole=0)
    return rows.select(_file_number(F.col("file")).alias("f"), "line_number", "line", "is_valid")


@query(f"WITH {_TREE} SELECT status, count(*) AS n FROM new_tree WHERE f <> {FILES - 1} GROUP BY status")
def streamed_lines(spark, sf_dir):
    """A tree through the streaming scan, by status."""
    from sievelight.streaming.tail import stream_scan

    root, out = _tree(spark, sf_dir), _root(spark)
    stream_scan(spark, root, f"{out}/sink", f"{out}/marks", _MAILS).awaitTermination()
    return spark.read.parquet(f"{out}/sink").groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"WITH {_TREE}, total AS (SELECT count(DISTINCT f) AS files, count(DISTINCT CASE WHEN n > 0 THEN f END) AS modified, CAST(sum(n) AS BIGINT) AS found, count(DISTINCT CASE WHEN contains({_LINE}, '@!') THEN f END) AS forced, count(*) FILTER (WHERE contains({_LINE}, '@!')) AS again FROM new_tree WHERE f <> {FILES - 1}) "
    "SELECT 1 AS run, files AS files_scanned, CAST(0 AS BIGINT) AS files_cached, modified AS files_modified, found AS total_redactions, CAST(0 AS BIGINT) AS errors, true AS dry_run FROM total UNION ALL "
    "SELECT 2, files, 0, modified, found, 0, false FROM total UNION ALL SELECT 3, 0, files, 0, 0, 0, false FROM total UNION ALL SELECT 4, files, 0, forced, again, 0, true FROM total"
)
def scan_runs(spark, sf_dir):
    """A preview, a fix, a second fix that finds all files cached, and a preview whose settings void the manifest; from the history.

    A sensitive field's placeholder is long enough to count again.
    """
    root, states = _tree(spark, sf_dir), _root(spark)
    other = Settings(entropy=Entropy(enabled=False, threshold=9.0), patterns=(), custom=CUSTOM[:1])
    for settings, fix in ((_MAILS, False), (_MAILS, True), (_MAILS, True), (other, False)):
        plans.scan(spark, root, settings, states, fix=fix).close()
    runs = state.StateTable(spark, states, "scan_runs", state.SCAN_RUNS).read()
    order = Window.orderBy("timestamp_epoch", "files_cached", F.desc("dry_run"))  # a bounded history
    return runs.select(F.row_number().over(order).alias("run"), "files_scanned", "files_cached", "files_modified", "total_redactions", "errors", "dry_run")


@query(
    f"WITH {_TREE}, s AS (SELECT CASE f WHEN 1 THEN 's1.jsonl' ELSE 'a' || CAST(f AS VARCHAR) || '.jsonl' END AS file, line_number, n, status, line_number <= (SELECT max(line_number) // 2 FROM new_tree) AS early FROM new_tree WHERE f BETWEEN 1 AND 4) "
    "SELECT CASE WHEN early THEN 1 ELSE 2 END AS run, file, count(*) AS lines, count(*) FILTER (WHERE status = 'redacted') AS lines_modified, CAST(sum(n) AS BIGINT) AS redactions FROM s GROUP BY ALL"
)
def session_resume(spark, sf_dir):
    """A transcript and its sub-files, scrubbed, appended to, and resumed behind the bytes done before; a run within a run does nothing."""
    root, states = Path(_root(spark)), _root(spark)
    lines = _events(spark, sf_dir, [t for t, _ in LINES]).select("event_id", (F.col("event_id") % FILES).alias("f"), (F.floor(F.col("event_id") / FILES) + 1).alias("line_number"), "line").where("f BETWEEN 1 AND 4")
    half = spark.read.parquet(f"{sf_dir}/events.parquet").agg((F.floor(F.max("event_id") / FILES) + 1).alias("n")).first()["n"] // 2
    path = lambda name: F.when(F.col("f") == 1, f"{root}/s1{name}").otherwise(F.concat(F.lit(f"{root}/s1/subagents/a"), F.col("f").cast("string"), F.lit(name)))
    write_files(lines.where(F.col("line_number") <= half).withColumn("file", path(".jsonl")))
    write_files(lines.where(F.col("line_number") > half).withColumn("file", path(".more")))
    transcript, out = str(root / "s1.jsonl"), []
    for run in (1, 2):
        if run == 2:
            for file in src.session_files(transcript):
                with open(file, "ab") as f, open(Path(file).with_suffix(".more"), "rb") as more:
                    shutil.copyfileobj(more, f)
        event = {"transcript_path": transcript, "stop_hook_active": True}
        assert plans.on_event(spark, json.dumps(event), str(root), _MAILS, states) is None
        done = plans.on_event(spark, json.dumps(event | {"stop_hook_active": False}), str(root), _MAILS, states)
        out.append(done.select(F.lit(run).alias("run"), display.basename(F.col("file")).alias("file"), "lines", "lines_modified", "redactions"))
    assert plans.scrub_session(spark, transcript, str(root), _MAILS, states).count() == 0
    return out[0].unionByName(out[1])


@query("SELECT * FROM (VALUES ('s1.jsonl', true, 's1.jsonl,a.jsonl'), ('missing.jsonl', false, 'missing.jsonl'), ('../outside.jsonl', false, 'outside.jsonl')) t(name, inside, session)")
def guarded_paths(spark, sf_dir):
    """Which transcripts may be opened, and the files of their sessions; folders beside the right one don't count."""
    base = Path(_root(spark))
    root = base / "projects"
    for name in ("s1/subagents/a.jsonl", "s1/subagents/note.txt", "subagents/b.jsonl", "s1/c.jsonl", "s1.jsonl", "../outside.jsonl"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("")
    rows = []
    for name in ("s1.jsonl", "missing.jsonl", "../outside.jsonl"):
        try:
            inside = src.guarded(root / name, root).exists()
        except (PermissionError, FileNotFoundError):
            inside = False
        rows.append((name, inside, ",".join(Path(p).name for p in src.session_files(root / name))))
    return spark.createDataFrame(rows, "name string, inside boolean, session string")


# Settings, lists and state -----------------------------------------------------------------------------------

_HITS_DUCK = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS rank, CAST(sum(length(g)) OVER (PARTITION BY doc_id ORDER BY o) + (o - 1) * {len(b)} AS INTEGER) AS start, CAST(sum(length(g)) OVER (PARTITION BY doc_id ORDER BY o) + o * {len(b)} AS INTEGER) AS stop FROM (SELECT doc_id, unnest(list_slice(p, 1, -2)) AS g, generate_subscripts(list_slice(p, 1, -2), 1) AS o FROM (SELECT doc_id, string_split(text, '{b}') AS p FROM documents WHERE contains(text, '{b}')))"
    for k, b in enumerate(_BLOCKED)
)


@query(
    f"WITH hits AS ({_HITS_DUCK}), marked AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits), "
    "numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS UNBOUNDED PRECEDING) AS island FROM marked) SELECT doc_id, min(start) AS start, max(stop) AS stop FROM numbered GROUP BY doc_id, island"
)
def block_string_islands(spark, sf_dir):
    """Hits of blocked strings; only those that strictly overlap are joined."""
    settings = Settings(entropy=Entropy(enabled=False), patterns=(), block_strings=_BLOCKED)
    hits = _documents(spark, sf_dir).select("doc_id", F.explode(detect.block_hits("text", settings, 0)).alias("s")).select("doc_id", "s.*")
    return ops.islands(hits, "doc_id", touching=False).select("doc_id", "start", "stop")


@query("SELECT doc_id, regexp_replace(text, '(?:eaux )+', '[REDACTED:blacklist]', 'g') AS text, contains(text, 'eaux ') AS hit FROM documents")
def blocked_string_scrub(spark, sf_dir):
    """A blocked string, rewritten by the whole scrubber; hits that touch make one placeholder."""
    settings = Settings(entropy=Entropy(enabled=False), patterns=(), block_strings=("eaux ",))
    done = _documents(spark, sf_dir).withColumn("r", detect.scrub("text", settings))
    return done.select("doc_id", "r.text", detect.blocked("text", settings).alias("hit"))


_VALUE = "CASE doc_id % 5 WHEN 0 THEN 'éé4567' WHEN 1 THEN '1234567' WHEN 2 THEN '12345678' WHEN 3 THEN '[REDACTED:x]' ELSE 'éé34567890' END"


@query(f"SELECT doc_id, 'id=' || CASE WHEN doc_id % 5 IN (0, 2, 4) THEN '[REDACTED:id]' ELSE {_VALUE} END || ' id=1234567' AS text FROM documents")
def short_and_placeholder_values(spark, sf_dir):
    """Values under eight bytes and placeholders stay; two-byte characters count twice."""
    settings = Settings(entropy=Entropy(enabled=False), patterns=(), custom=(Pattern("id", r"id=([^ ]+)", ("id=",), 1),))
    rows = _documents(spark, sf_dir).select("doc_id", F.expr(f"'id=' || {_VALUE} || ' id=1234567'").alias("text"))
    return rows.select("doc_id", detect.scrub("text", settings)["text"].alias("text"))


_TOML = b"""
[entropy]
exclude_patterns = ["GITHUB_.*"]
[allowlist]
hashes = ["%s"]
[blacklist]
strings = ["short", "mail.example or"]
[[patterns]]
name = "mail"
regex = 'user[0-9]+@mail\\.example'
keywords = ["@mail"]
""" % sha256_hex("user00000@mail.example").encode()
_TOML_TEXT = "'by user' || lpad(CAST(doc_id // 5 AS {s}), 5, '0') || '@mail.example or x' || CASE WHEN doc_id % 2 = 0 THEN ' short' ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN doc_id // 5 = 0 THEN replace({_TOML_TEXT.format(s='VARCHAR')}, 'mail.example or', '[REDACTED:blacklist]') ELSE regexp_replace({_TOML_TEXT.format(s='VARCHAR')}, 'user[0-9]+@mail.example or', '[REDACTED:mail]') END AS text FROM documents")
def toml_rules(spark, sf_dir):
    """Rules from TOML: a pattern, an allowed value, a blocked string; entropy off by a switch."""
    settings = parse(_TOML, Entropy(enabled=False))
    rows = _documents(spark, sf_dir).select("doc_id", F.expr(_TOML_TEXT.format(s="STRING").replace("doc_id // 5", "doc_id div 5")).alias("text"))
    return rows.select("doc_id", detect.scrub("text", settings)["text"].alias("text"))


_MARKS = ((b"", True, 4.5), (b"", False, 4.5), (b"a = 1", True, 4.5), (b"", True, 3.0))


@query(
    " UNION ALL ".join(
        f"SELECT {k} AS variant, sha256('{source.decode()}'::BLOB || 'entropy:{'on' if on else 'off'}'::BLOB || '{h}'::BLOB || '{RULESET}'::BLOB) AS fingerprint"
        for k, (source, on, h) in enumerate((s, o, r"\x00\x00\x00\x00\x00\x00\x12@" if t == 4.5 else r"\x00\x00\x00\x00\x00\x00\x08@") for s, o, t in _MARKS)
    )
)
def settings_fingerprints(spark, sf_dir):
    """What marks a set of rules: its text, the entropy switch and threshold, and the rule set's version."""
    rows = [(k, parse(source, Entropy(on, t)).fingerprint()) for k, (source, on, t) in enumerate(_MARKS)]
    return spark.createDataFrame(rows, "variant int, fingerprint string")


@query(
    f"WITH {_FILES_DUCK}, e AS (SELECT f.*, m.path IS NOT NULL AS same FROM files f LEFT JOIN manifest m ON m.path = f.path AND m.mtime_us = f.mtime_us AND m.size = f.size) "
    "SELECT CASE WHEN same AND k % 3 <> 0 THEN 'cached' ELSE 'scan' END AS part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY 1"
)
def manifest_by_fingerprint(spark, sf_dir):
    """Entries made under other settings count as missing."""
    files = _files(spark, sf_dir)
    now, before = Settings().fingerprint(), Settings(entropy=Entropy(threshold=4.0)).fingerprint()
    other = F.expr("CAST(regexp_extract(path, '[0-9]+', 0) AS BIGINT)") % 3 == 0
    manifest = _manifest(files).withColumn("fingerprint", F.when(other, before).otherwise(now))
    return state.partitioned(files, manifest, now).groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {_DURATIONS_DUCK} SELECT event_id AS timestamp_epoch, event_type AS file, v AS redactions FROM e ORDER BY event_id DESC LIMIT 100")
def state_history(spark, sf_dir):
    """A bounded history as a state table: appended to twice, with a damaged newest snapshot that is passed over."""
    root = _root(spark)
    runs = _durations(spark, sf_dir).select(F.col("event_id").alias("timestamp_epoch"), F.col("event_type").alias("file"), F.col("v").alias("redactions"), F.lit(0).cast("long").alias("duration_ms"), F.lit(0).cast("long").alias("file_size_bytes"))
    kept = state.StateTable(spark, root, "session_runs", state.SESSION_RUNS)
    for part in (0, 1):
        kept.append(runs.where(F.col("timestamp_epoch") % 2 == part), newest=100)
    broken = Path(root) / "session_runs" / "v9"
    broken.mkdir()
    (broken / "_SUCCESS").touch()
    (broken / "part-0.parquet").write_bytes(b"no table")
    return kept.read().select("timestamp_epoch", "file", "redactions")


@query("SELECT o_orderkey, 'f' || CAST(o_custkey AS VARCHAR) || '.jsonl' AS name, CAST(o_orderkey % 3 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 1 THEN ' redaction' ELSE ' redactions' END AS said FROM orders")
def path_labels(spark, sf_dir):
    """Names of files without their folders, and counted nouns."""
    path = F.concat(F.lit("file:/a/b c/"), F.col("o_orderpriority"), F.lit("/f"), F.col("o_custkey").cast("string"), F.lit(".jsonl"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", display.basename(path).alias("name"), display.pluralise(F.col("o_orderkey") % 3, "redaction", "redactions").alias("said"))


@query("SELECT source, count(*) FILTER (WHERE " + " OR ".join(f"contains(lower(text), {_quoted(k)})" for p in BUILT_IN for k in p.keywords) + ") AS hit, count(*) AS n FROM documents GROUP BY source")
def any_keyword(spark, sf_dir):
    """Texts that any pattern's keywords let through."""
    settings = Settings(entropy=Entropy(enabled=False))
    return _documents(spark, sf_dir).groupBy("source").agg(F.count_if(detect.any_keyword_hit("text", settings)).alias("hit"), F.count("*").alias("n"))


_RUNS = f"WITH {_DURATIONS_DUCK}, runs AS (SELECT event_id AS timestamp_epoch, '/t/' || event_type AS file, v // 10 % 4 AS redactions, v AS duration_ms, CAST(event_id AS BIGINT) * 7 AS file_size_bytes FROM e ORDER BY event_id DESC LIMIT 100)"
_SPARK_DUCK = "(SELECT string_agg(['▁','▂','▃','▄','▅','▆','▇','█'][CASE WHEN top = 0 THEN 1 ELSE CAST(floor(CAST(v AS DOUBLE) / top * 7 + 0.5) AS BIGINT) + 1 END], '' ORDER BY t) FROM (SELECT {c} AS v, timestamp_epoch AS t, max({c}) OVER () AS top FROM (SELECT * FROM runs ORDER BY timestamp_epoch DESC LIMIT 30)))"
_MS = "CASE WHEN {c} < 1000 THEN CAST({c} AS VARCHAR) || 'ms' WHEN {c} < 60000 THEN printf('%.1fs', {c} / 1000.0) ELSE CAST({c} // 60000 AS VARCHAR) || 'm ' || CAST(({c} % 60000) // 1000 AS VARCHAR) || 's' END"
_SIZE = "CASE WHEN {c} < 1024 THEN CAST({c} AS VARCHAR) || ' B' WHEN {c} < 1048576 THEN printf('%.1f KB', {c} / 1024.0) WHEN {c} < 1073741824 THEN printf('%.1f MB', {c} / 1048576.0) ELSE printf('%.2f GB', {c} / 1073741824.0) END"
_AT = "strftime(make_timestamp(CAST({c} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC'"


@query(
    f"{_RUNS}, last AS (SELECT * FROM runs ORDER BY timestamp_epoch DESC LIMIT 1), hits AS (SELECT * FROM runs WHERE redactions > 0 ORDER BY timestamp_epoch DESC), lat AS (SELECT count(*) AS n, avg(duration_ms) AS a, max(duration_ms) AS m, list_sort(list(duration_ms)) AS s FROM runs), "
    "scan AS (SELECT 1700000000 AS t, 40 AS files, 7 AS modified, 9 AS cached, 123 AS found, 2 AS errors, 61500 AS ms), files AS (SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS b FROM orders), "
    f"r AS (SELECT 'Recent redactions' AS section, substr(file, 4) AS key, CAST(redactions AS VARCHAR) || CASE WHEN redactions = 1 THEN ' redaction, ' ELSE ' redactions, ' END || {_AT.format(c='timestamp_epoch')} AS value FROM (SELECT * FROM hits LIMIT 3) "
    "UNION ALL SELECT 'Recent redactions', '…', 'and ' || CAST(count(*) - 3 AS VARCHAR) || ' more of ' || CAST(count(*) AS VARCHAR) FROM hits HAVING count(*) > 3 "
    f"UNION ALL SELECT 'Stats', 'last run', {_AT.format(c='timestamp_epoch')} FROM last UNION ALL SELECT 'Stats', 'last file', substr(file, 4) || ', ' || {_SIZE.format(c='file_size_bytes')} FROM last UNION ALL SELECT 'Stats', 'last time', {_MS.format(c='duration_ms')} FROM last "
    f"UNION ALL SELECT 'Stats', 'runs', CAST(n AS VARCHAR) FROM lat UNION ALL SELECT 'Stats', 'average', printf('%.1fms', a) FROM lat UNION ALL SELECT 'Stats', 'max', {_MS.format(c='m')} FROM lat "
    f"UNION ALL SELECT 'Stats', 'p50', {_MS.format(c='s[CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT) + 1]')} FROM lat UNION ALL SELECT 'Stats', 'p95', {_MS.format(c='s[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1]')} FROM lat "
    f"UNION ALL SELECT 'Stats', 'latency', {_SPARK_DUCK.format(c='duration_ms')} UNION ALL SELECT 'Stats', 'redactions', {_SPARK_DUCK.format(c='redactions')} "
    f"UNION ALL SELECT 'Last scan', 'when', {_AT.format(c='t')} FROM scan UNION ALL SELECT 'Last scan', 'mode', 'live' UNION ALL SELECT 'Last scan', 'files', '40 scanned, 9 cached, 7 modified' UNION ALL SELECT 'Last scan', 'redactions', '123' UNION ALL SELECT 'Last scan', 'errors', '2' UNION ALL SELECT 'Last scan', 'duration', '1m 1s' UNION ALL SELECT 'Last scan', 'throughput', printf('%.1fms/file', CAST(ms AS DOUBLE) / files) FROM scan "
    "UNION ALL SELECT 'Last scan by pattern', 'jwt', '23' UNION ALL SELECT 'Last scan by pattern', 'mail', '100' "
    f"UNION ALL SELECT 'Coverage', CAST(n AS VARCHAR), {_SIZE.format(c='b')} FROM files) SELECT * FROM r"
)
def status_report(spark, sf_dir):
    """The status report from histories, the last scan and the coverage of a folder."""
    runs = _durations(spark, sf_dir).orderBy(F.desc("event_id")).limit(100)  # a run history has no more
    runs = runs.select(F.col("event_id").alias("timestamp_epoch"), F.concat(F.lit("/t/"), "event_type").alias("file"), F.expr("v div 10 % 4").alias("redactions"), F.col("v").alias("duration_ms"), (F.col("event_id") * 7).alias("file_size_bytes"))
    scans = spark.createDataFrame([(1_600_000_000, 1, 1, 1, 0, 5, True, 0, {}), (1_700_000_000, 40, 7, 123, 2, 61_500, False, 9, {"jwt": 23, "mail": 100})], state.SCAN_RUNS)
    rows = plans.status_rows(spark.createDataFrame([], plans.ROWS), runs, scans, plans.coverage(_files(spark, sf_dir)))
    return rows


@query("SELECT count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS bytes, printf('%.1fms/file', 61500.0 / count(*)) AS throughput FROM orders")
def coverage_and_throughput(spark, sf_dir):
    """Files and bytes of a listing, and a scan's time a file."""
    total = plans.coverage(_files(spark, sf_dir))
    return total.select("files", "bytes", plans.throughput(F.lit(61_500.0), F.col("files")).alias("throughput"))
