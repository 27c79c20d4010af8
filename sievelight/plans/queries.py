"""The registered queries of the secret-detection engine, each with DuckDB SQL where SQL can say it.

The driver's tables hold no built-in secret, so most queries run over texts
with planted values, made alike in Spark and in SQL from hashes of the row's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.config import Entropy, Settings
from sievelight.functions import detect, display
from sievelight.functions.patterns import BUILT_IN, EXCLUDED_TOKEN, KNOWN_EXAMPLES, SENSITIVE_KEYS, TOKEN, Pattern, with_prefix_group
from sievelight.operators import findings as ops
from sievelight.operators import statistics as stats
from sievelight.plans import state
from sievelight.sources.tables import table

#: Planted value of each pattern; {h}, {i} and {j} are hex hashes. Valid in Spark SQL and DuckDB.
PLANTED = {
    "aws-access-key": "'AKIA' || upper(substr({h}, 1, 16))",
    "aws-secret-key": "'aws_secret_key = \"' || substr({h}, 1, 40) || '\"'",
    "github-token": "'ghp_' || substr({h}, 1, 36)",
    "github-fine-grained": "'github_pat_' || substr({h}, 1, 22)",
    "gitlab-token": "'glpat-' || substr({h}, 1, 20)",
    "jwt": "'eyJ' || substr({h}, 1, 12) || '.eyJ' || substr({i}, 1, 12) || '.' || substr({j}, 1, 12)",
    "private-key": "'-----BEGIN RSA PRIVATE ' || 'KEY-----'",
    "connection-string": "'postgres://u:p@h/' || substr({h}, 1, 8)",
    "password-assignment": "'pwd = \"' || substr({h}, 1, 12) || '\"'",
    "stripe-key": "'sk_test_' || substr({h}, 1, 24)",
    "slack-token": "'xoxb-' || substr({h}, 1, 16)",
    "slack-webhook": "'https://hooks.slack.com/services/T0/B0/' || substr({h}, 1, 8)",
    "anthropic-key": "'sk-ant-' || substr({h}, 1, 24)",
    "openai-key": "'sk-' || substr({h}, 1, 24)",
    "google-api-key": "'AIza' || substr({h}, 1, 35)",
    "google-oauth-secret": "'client_secret: \"GOCSPX-' || substr({h}, 1, 20) || '\"'",
    "npm-token": "'npm_' || substr({h}, 1, 36)",
    "generic-api-key": "'api_key = \"' || substr({h}, 1, 24) || '\"'",
    "heroku-api-key": "'heroku_api_key = 01234567-89ab-cdef-0123-456789abcdef'",
    "twilio-api-key": "'SK' || substr({h}, 1, 32)",
    "sendgrid-key": "'SG.' || substr({h}, 1, 22) || '.' || substr({i}, 1, 22)",
}
#: Rules for what the tables do hold: mail addresses, IPv4 addresses, quoted tokens.
CUSTOM = (
    Pattern("mail-address", r"[a-z0-9._]+@[a-z0-9.-]+\.[a-z]{2,}", ("@",)),
    Pattern("ipv4", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    Pattern("quoted-token", r"token = \"([0-9a-f]{16,})\"", ("token",), 1),
)
PLAIN = Settings(entropy=Entropy(enabled=False))
SCORED = Settings()


def _hash(sql: str, duck: bool) -> str:
    return f"sha256(CAST({sql} AS VARCHAR))" if duck else f"sha2(CAST({sql} AS STRING), 256)"


def _token(duck: bool) -> str:
    return f"to_base64(unhex({_hash('doc_id', True)}))" if duck else f"base64(unhex({_hash('doc_id', False)}))"


def _planted_sql(duck: bool) -> str:
    """SQL of a planted text: the document, a value of the pattern that its id picks, words, and the value again."""
    parts = {"h": _hash("doc_id", duck), "i": _hash("doc_id + 1", duck), "j": _hash("doc_id + 2", duck)}
    cases = " ".join(f"WHEN {k} THEN {PLANTED[p.name].format(**parts)}" for k, p in enumerate(BUILT_IN))
    more = f"WHEN {len(BUILT_IN)} THEN {_token(duck)} WHEN {len(BUILT_IN) + 1} THEN 'GITHUB_TOKEN=ghp_' || substr({_token(duck)}, 2, 36) WHEN {len(BUILT_IN) + 2} THEN '{KNOWN_EXAMPLES[0]}'"
    value = f"(CASE doc_id % {len(BUILT_IN) + 4} {cases} {more} ELSE 'nothing here' END)"
    return f"coalesce(text, '') || ' é ' || {value} || ' mid — ' || {value} || ' end'"


def _documents(spark: SparkSession, sf_dir: str, heavy: bool = True) -> DataFrame:
    return table(spark, sf_dir, "documents", heavy)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.expr(_planted_sql(False)).alias("text"))


def _planted_duck() -> str:
    return f"planted AS (SELECT doc_id, {_planted_sql(True)} AS text FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _keywords_duck(pattern: Pattern, text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {_quoted(k)})" for k in pattern.keywords) + ")" if pattern.keywords else "true"


def _spans_duck(patterns: tuple[Pattern, ...], table: str = "planted") -> str:
    """SQL of every span after the filters: (doc_id, rank, pattern_name, start, stop, value), offsets in code points."""
    each = []
    for k, p in enumerate(patterns):
        wide, lead, value = p.regex, "''", "f"
        if p.group is not None:
            wide, group = with_prefix_group(p.regex, p.group)
            lead, value = "l", "v"
            more = f", unnest(regexp_extract_all(text, {_quoted(wide)}, 1)) AS l, unnest(regexp_extract_all(text, {_quoted(wide)}, {group})) AS v"
        else:
            more = ""
        each.append(
            f"SELECT doc_id, {k} AS rank, {_quoted(p.name)} AS pattern_name, f, {value} AS value, spot + length({lead}) AS start FROM ("
            f"SELECT *, sum(length(g)) OVER w + coalesce(sum(length(f)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM ("
            f"SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(p.regex)})) AS f{more}, "
            f"unnest(list_slice(string_split_regex(text, {_quoted(p.regex)}), 1, len(regexp_extract_all(text, {_quoted(p.regex)})))) AS g, "
            f"generate_subscripts(regexp_extract_all(text, {_quoted(p.regex)}), 1) AS o "
            f"FROM {table} WHERE {_keywords_duck(p)} AND regexp_matches(text, {_quoted(p.regex)})) "
            f"WINDOW w AS (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING))"
        )
    examples = " AND ".join(f"NOT contains(f, {_quoted(x)})" for x in KNOWN_EXAMPLES)
    return f"SELECT doc_id, rank, pattern_name, CAST(start AS INTEGER) AS start, CAST(start + length(value) AS INTEGER) AS stop, value FROM ({' UNION ALL '.join(each)}) WHERE strlen(value) >= 8 AND NOT starts_with(value, '[REDACTED:') AND {examples}"


_EXCLUDED_DUCK = f"regexp_full_match(v, {_quoted('|'.join(EXCLUDED_TOKEN))})"


def _tokens_duck(table: str = "planted") -> str:
    """SQL of every token with its place."""
    rx = _quoted(TOKEN)
    return (
        "SELECT doc_id, v, CAST(spot AS INTEGER) AS start, CAST(spot + length(v) AS INTEGER) AS stop, "
        "CASE WHEN v = '' THEN 0 ELSE list_aggregate(string_split(v, ''), 'entropy') END AS h FROM ("
        "SELECT *, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) + coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM ("
        f"SELECT doc_id, unnest(regexp_extract_all(text, {rx})) AS v, unnest(list_slice(string_split_regex(text, {rx}), 1, len(regexp_extract_all(text, {rx})))) AS g, generate_subscripts(regexp_extract_all(text, {rx}), 1) AS o "
        f"FROM {table} WHERE regexp_matches(text, {rx})))"
    )


def _merged_duck(entropy: bool, patterns: tuple[Pattern, ...] = BUILT_IN, texts: str | None = None) -> str:
    """WITH parts that end in islands (doc_id, island, start, stop, pattern_name); ``texts`` defines planted."""
    rank = len(patterns)
    more = (
        f", scored AS (SELECT t.doc_id, {rank} AS rank, 'high-entropy' AS pattern_name, t.start, t.stop FROM ({_tokens_duck()}) t WHERE h >= 4.5 AND NOT {_EXCLUDED_DUCK} "
        "AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = t.doc_id AND f.start <= t.start AND f.stop >= t.stop))"
        if entropy
        else ""
    )
    union = "SELECT doc_id, rank, pattern_name, start, stop FROM found" + (" UNION ALL SELECT * FROM scored" if entropy else "")
    return (
        f"{texts or _planted_duck()}, found AS ({_spans_duck(patterns)}){more}, spans AS ({union}), "
        "marked AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans), "
        "numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS UNBOUNDED PRECEDING) AS island FROM marked), "
        "islands AS (SELECT doc_id, island, min(start) AS start, max(stop) AS stop, arg_min(pattern_name, (start, -stop, rank)) AS pattern_name FROM numbered GROUP BY doc_id, island)"
    )


_SCRUBBED_DUCK = (
    "pieces AS (SELECT i.doc_id, i.island, substr(p.text, CAST(coalesce(lag(i.stop) OVER (PARTITION BY i.doc_id ORDER BY i.island), 0) + 1 AS BIGINT), CAST(i.start - coalesce(lag(i.stop) OVER (PARTITION BY i.doc_id ORDER BY i.island), 0) AS BIGINT)) || '[REDACTED:' || i.pattern_name || ']' AS piece, i.stop FROM islands i JOIN planted p USING (doc_id)), "
    "rebuilt AS (SELECT doc_id, string_agg(piece, '' ORDER BY island) AS head, max(stop) AS last, count(*) AS n FROM pieces GROUP BY doc_id)"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _exploded(df: DataFrame, settings: Settings) -> DataFrame:
    return df.select("doc_id", "text", F.explode(detect.pattern_spans("text", settings)).alias("s"))


@query(f"WITH {_planted_duck()} SELECT pattern_name, count(*) AS n FROM ({_spans_duck(BUILT_IN)}) GROUP BY pattern_name")
def pattern_hits_planted(spark, sf_dir):
    """Raw hits of each pattern, before any merge."""
    return _exploded(planted(spark, sf_dir), PLAIN).groupBy(F.col("s.name").alias("pattern_name")).agg(F.count("*").alias("n"))


@query(
    f"SELECT pattern_name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_spans_duck(CUSTOM, 'documents')}) GROUP BY pattern_name"
)
def custom_pattern_hits(spark, sf_dir):
    """Hits of user-defined patterns over the texts as they are."""
    settings = Settings(entropy=Entropy(enabled=False), patterns=(), custom=CUSTOM)
    found = _exploded(_documents(spark, sf_dir), settings)
    return found.groupBy(F.col("s.name").alias("pattern_name")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH {_planted_duck()} " + " UNION ALL ".join(f"SELECT {_quoted(p.name)} AS pattern_name, count(*) FILTER (WHERE {_keywords_duck(p)}) AS n FROM planted" for p in BUILT_IN))
def keyword_prefilter_counts(spark, sf_dir):
    """Texts that each pattern's keywords let through; one pass for all patterns."""
    lowered = planted(spark, sf_dir).select(F.lower("text").alias("lowered"))
    counts = lowered.agg(*(F.count_if(detect.keyword_hit("lowered", p)).alias(p.name) for p in BUILT_IN))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p.name).alias("pattern_name"), F.col(f"`{p.name}`").alias("n")) for p in BUILT_IN))).alias("r")).select("r.*")


@query(f"WITH {_planted_duck()} SELECT doc_id, regexp_replace(text, {_quoted(BUILT_IN[2].regex)}, '[REDACTED:github-token]', 'g') AS text FROM planted WHERE contains(lower(text), 'ghp_')")
def single_pattern_redact(spark, sf_dir):
    """One pattern without a group: a plain replacement."""
    rows = planted(spark, sf_dir).where(F.lower("text").contains("ghp_"))
    return rows.select("doc_id", F.regexp_replace("text", BUILT_IN[2].regex, r"[REDACTED:github-token]").alias("text"))


@query(
    f"WITH {_planted_duck()} SELECT s.doc_id, pattern_name, s.start, stop, value, CAST(strlen(substr(text, 1, s.start)) AS INTEGER) AS start_byte FROM ({_spans_duck(BUILT_IN)}) s JOIN planted p ON s.doc_id = p.doc_id"
)
def spans_with_offsets(spark, sf_dir):
    """Every span with code point and byte offsets."""
    found = _exploded(planted(spark, sf_dir), PLAIN)
    return found.select("doc_id", F.col("s.name").alias("pattern_name"), "s.start", "s.stop", "s.value", detect.byte_offset(F.col("text"), F.col("s.start")).alias("start_byte"))


@query(f"WITH {_merged_duck(True)} SELECT doc_id, pattern_name, start, stop FROM islands")
def merged_spans(spark, sf_dir):
    """Islands of all detectors' spans, by windows."""
    found = ops.spans_of(planted(spark, sf_dir), "doc_id", "text", SCORED)
    return ops.islands(found, "doc_id").select("doc_id", "pattern_name", "start", "stop")


@query(
    f"WITH {_merged_duck(True)}, {_SCRUBBED_DUCK} SELECT p.doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_redactions FROM planted p LEFT JOIN rebuilt r ON p.doc_id = r.doc_id"
)
def scrub_text_full(spark, sf_dir):
    """The whole detector over every text: rewritten text and number of redactions."""
    done = planted(spark, sf_dir).withColumn("r", detect.scrub("text", SCORED))
    return done.select("doc_id", F.col("r.text").alias("text"), F.size("r.redactions").alias("n_redactions"))


@query(f"WITH {_planted_duck()} SELECT doc_id, v AS token, CAST(start AS INTEGER) AS start, round(h, 6) AS entropy FROM ({_tokens_duck()})")
def entropy_scores(spark, sf_dir):
    """Every long token with its entropy."""
    found = planted(spark, sf_dir).select("doc_id", F.explode(detect.token_spans("text")).alias("s"))
    return found.select("doc_id", F.col("s.value").alias("token"), "s.start", F.round(detect.shannon_entropy("s.value"), 6).alias("entropy"))


@query(f"WITH {_planted_duck()} SELECT doc_id, v AS token, start, stop FROM ({_tokens_duck()}) WHERE h >= 3.5 AND NOT {_EXCLUDED_DUCK} AND NOT regexp_full_match(v, 'GITHUB_.*')")
def high_entropy_tokens(spark, sf_dir):
    """Tokens that reach a threshold and no exclusion, with a user's exclusion."""
    settings = Settings(entropy=Entropy(threshold=3.5, exclude=("GITHUB_.*", "(bad")))
    rows = planted(spark, sf_dir).select("doc_id", F.explode(detect.entropy_tokens("text", settings, 0)).alias("s"))
    return rows.select("doc_id", F.col("s.value").alias("token"), "s.start", "s.stop")


@query(f"WITH {_planted_duck()} SELECT doc_id, v AS token FROM ({_tokens_duck()}) WHERE {_EXCLUDED_DUCK}")
def entropy_excluded(spark, sf_dir):
    """Tokens that the built-in exclusions drop, such as paths."""
    tokens = planted(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    return tokens.where(detect.excluded_token("token", SCORED))


@query(
    f"WITH mails AS ({_spans_duck(CUSTOM[:1], 'documents')}), allow AS (SELECT DISTINCT sha256(value) AS hash FROM mails WHERE substr(sha256(value), 1, 1) < '8') "
    "SELECT doc_id, value, start FROM mails WHERE sha256(value) NOT IN (SELECT hash FROM allow)"
)
def allowlist_anti(spark, sf_dir):
    """Findings whose hash is not on an allow list, as an anti join with a list of any size."""
    settings = Settings(entropy=Entropy(enabled=False), patterns=(), custom=CUSTOM[:1])
    found = _exploded(_documents(spark, sf_dir), settings).select("doc_id", F.col("s.value").alias("value"), "s.start", F.sha2("s.value", 256).alias("hash"))
    allow = found.where(F.substring("hash", 1, 1) < "8").select("hash").distinct()
    return found.join(allow, "hash", "left_anti").select("doc_id", "value", "start")


_BLOCKED = ("the and at", "nd and the", "of the the")


@query(
    "SELECT doc_id, CAST(len(regexp_extract_all(text, 'the and at')) + len(regexp_extract_all(text, 'nd and the')) + len(regexp_extract_all(text, 'of the the')) AS INTEGER) AS hits, "
    "contains(text, 'the and at') AS has_first FROM documents WHERE contains(text, 'the and at') OR contains(text, 'nd and the') OR contains(text, 'of the the')"
)
def blocklist_substring(spark, sf_dir):
    """Hits of blocked strings, before overlapping ones are joined."""
    text = F.col("text")
    rows = _documents(spark, sf_dir, heavy=False).where(detect.blocked("text", Settings(block_strings=_BLOCKED)))
    count = sum((F.size(F.regexp_extract_all(text, F.lit(b), F.lit(0))) for b in _BLOCKED), F.lit(0))
    return rows.select("doc_id", count.alias("hits"), text.contains(_BLOCKED[0]).alias("has_first"))


@query("SELECT d.doc_id FROM documents d WHERE sha256(d.text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0)")
def blocklist_hash_semi(spark, sf_dir):
    """Whole values whose hash is blocked, as a semi join with a list of any size."""
    docs = _documents(spark, sf_dir, heavy=False).select("doc_id", F.sha2("text", 256).alias("hash"))
    block = docs.where("doc_id % 7 = 0").select("hash")
    return docs.join(block, "hash", "left_semi").select("doc_id")


_KEYS_SQL = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'password' WHEN 1 THEN 'db_password' WHEN 2 THEN 'dbpassword' WHEN 3 THEN 'API_KEY' WHEN 4 THEN 'apiKey' ELSE 'x-token' END AS key, event_type || '-' || CAST(user_id AS {s}) AS value FROM events"


@query(
    f"WITH k AS ({_KEYS_SQL.format(s='VARCHAR')}) SELECT key, regexp_matches(lower(key), '(^|_)({'|'.join(SENSITIVE_KEYS)})$') AS sensitive, count(*) AS n FROM k GROUP BY ALL"
)
def sensitive_keys(spark, sf_dir):
    """Field names that make a value secret."""
    rows = _keys(spark, sf_dir)
    return rows.groupBy("key", detect.sensitive_key(F.col("key")).alias("sensitive")).agg(F.count("*").alias("n"))


def _keys(spark, sf_dir) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("sievelight_events")
    return spark.sql(_KEYS_SQL.format(s="STRING").replace("FROM events", "FROM sievelight_events"))


@query(
    f"WITH k AS ({_KEYS_SQL.format(s='VARCHAR')}) SELECT event_id, CASE WHEN regexp_matches(lower(key), '(^|_)({'|'.join(SENSITIVE_KEYS)})$') AND strlen(value) >= 8 THEN '[REDACTED:sensitive-field]' ELSE value END AS value FROM k"
)
def force_redact_leaves(spark, sf_dir):
    """Values of sensitive fields that are long enough are replaced whole."""
    force = detect.sensitive_key(F.col("key")) & detect.forced("value", PLAIN)
    return _keys(spark, sf_dir).select("event_id", F.when(force, "[REDACTED:sensitive-field]").otherwise(F.col("value")).alias("value"))


#: Each turn mentions an address, every other turn twice. Valid in Spark SQL and DuckDB.
_TALK = "text || ' write to user' || CAST(conv_id AS {s}) || '@mail.example' || CASE WHEN turn % 2 = 0 THEN ' or user' || CAST(conv_id AS {s}) || '@mail.example' ELSE '' END"
_TALKS = f"talks AS (SELECT conv_id, turn, role, {_TALK.format(s='VARCHAR')} AS text FROM conversations)"


def _talks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", F.expr(_TALK.format(s="STRING")))


def conversation_lines(spark, sf_dir) -> DataFrame:
    """Conversations as lines of JSON: the role is the type, the conversation the file, the turn the line."""
    rows = _talks(spark, sf_dir)
    content = F.when(F.col("role") == "user", F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))).otherwise(
        F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message")))
    )
    line = F.concat(F.lit('{"type":"'), F.col("role"), F.lit('",'), F.substring(content, F.lit(2), F.length(content)))
    return rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line_number"), "role", "text", line.alias("line"))


_MAILS = Settings(entropy=Entropy(enabled=False), patterns=(), custom=CUSTOM[:1])
_MAIL_RX = _quoted(CUSTOM[0].regex)


@query(f"WITH {_TALKS} SELECT conv_id, turn, regexp_replace(text, {_MAIL_RX}, '[REDACTED:mail-address]', 'g') AS text FROM talks WHERE role = 'user'")
def user_text_scrub(spark, sf_dir):
    """Users' plain content, by the native scrubber."""
    rows = _talks(spark, sf_dir).where("role = 'user'")
    return rows.select("conv_id", "turn", detect.scrub("text", _MAILS)["text"].alias("text"))


@query(f"WITH {_TALKS} SELECT 'c' || CAST(conv_id AS VARCHAR) AS file, turn AS line_number, 'mail-address' AS pattern_name, value AS matched_text FROM (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, {_MAIL_RX})) AS value FROM talks WHERE role <> 'system') WHERE strlen(value) >= 8")
def line_findings(spark, sf_dir):
    """Lines of JSON through the whole line scrubber: a finding once a line, pattern and text."""
    done = ops.scrub_lines(conversation_lines(spark, sf_dir).select("file", "line_number", "line"), _MAILS)
    return ops.findings(done, "file", "line_number").select("file", "line_number", "pattern_name", "matched_text")


@query(
    f"WITH {_TALKS}, f AS (SELECT DISTINCT conv_id, turn, value FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, {_MAIL_RX})) AS value FROM talks WHERE role <> 'system') WHERE strlen(value) >= 8) "
    "SELECT (SELECT count(DISTINCT conv_id) FROM f) AS files_modified, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM f)) AS lines_modified, (SELECT count(*) FROM f) AS total_redactions"
)
def line_dedupe_counts(spark, sf_dir):
    """Files and lines with a redaction, and redactions."""
    done = ops.scrub_lines(conversation_lines(spark, sf_dir).select("file", "line_number", "line"), _MAILS)
    files = ops.file_results(done)
    return files.agg(F.count_if(F.col("redactions") > 0).alias("files_modified"), F.sum("lines_modified").alias("lines_modified"), F.sum("redactions").alias("total_redactions"))


@query("SELECT role, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY role")
def skip_prefilter(spark, sf_dir):
    """Lines that their first bytes rule out."""
    return conversation_lines(spark, sf_dir).where(ops.skippable("line")).groupBy("role").agg(F.count("*").alias("n"))


def _files(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("mtime_us"), F.col("o_custkey").cast("long").alias("size"))


def _manifest(files: DataFrame) -> DataFrame:
    """Of three files in four an entry; of one in five of these with another size, and two of files that are gone."""
    key = F.expr("CAST(substr(path, 2) AS BIGINT)")
    known = files.where(key % 4 != 0).select(F.when(key % 10 < 2, F.concat(F.lit("gone"), "path")).otherwise(F.col("path")).alias("path"), "mtime_us", (F.col("size") + (key % 5 == 0).cast("long")).alias("size"), F.lit("fp").alias("fingerprint"))
    return known


_FILES_DUCK = "files AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS mtime_us, CAST(o_custkey AS BIGINT) AS size FROM orders), manifest AS (SELECT CASE WHEN k % 10 < 2 THEN 'gone' || path ELSE path END AS path, mtime_us, size + (CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) AS size FROM files WHERE k % 4 <> 0)"


@query(
    f"WITH {_FILES_DUCK} SELECT CASE WHEN EXISTS (SELECT 1 FROM manifest m WHERE m.path = f.path AND m.mtime_us = f.mtime_us AND m.size = f.size) THEN 'cached' ELSE 'scan' END AS part, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files f GROUP BY 1"
)
def cache_partition(spark, sf_dir):
    """Files split into unchanged ones and those to scan."""
    files = _files(spark, sf_dir)
    manifest = _manifest(files)
    return state.partitioned(files, manifest, "fp").groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(
    f"WITH {_FILES_DUCK}, todo AS (SELECT * FROM files f WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.path = f.path AND m.mtime_us = f.mtime_us AND m.size = f.size)) "
    "SELECT path, mtime_us, size FROM todo UNION ALL SELECT path, mtime_us, size FROM manifest m WHERE path NOT IN (SELECT path FROM todo) AND path IN (SELECT path FROM files)"
)
def cache_prune(spark, sf_dir):
    """The next manifest: scanned files enter, and entries of files that are gone leave."""
    files = _files(spark, sf_dir)
    manifest = _manifest(files)
    return state.refreshed(manifest, state.to_scan(files, manifest, "fp"), files, "fp").select("path", "mtime_us", "size")


@query(f"WITH {_TALKS} SELECT 'c' || CAST(c.conv_id AS VARCHAR) AS file, c.turn AS line_number, c.text FROM talks c JOIN (SELECT conv_id, max(turn) // 2 AS done FROM conversations GROUP BY conv_id) o ON c.conv_id = o.conv_id WHERE c.turn > o.done")
def incremental_tail(spark, sf_dir):
    """Lines beyond each file's recorded one."""
    lines = conversation_lines(spark, sf_dir).select("file", "line_number", "text")
    done = lines.groupBy("file").agg(F.floor(F.max("line_number") / 2).alias("done"))
    return lines.join(done, "file").where("line_number > done").drop("done")


@query(
    "WITH o AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS file, CAST(o_custkey AS BIGINT) AS size, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey - 1 ELSE o_custkey + 5 END AS done FROM orders) "
    "SELECT file, size, CAST(CASE WHEN done < size THEN done ELSE 0 END AS BIGINT) AS skip FROM o WHERE done IS NULL OR done <> size"
)
def offset_resume(spark, sf_dir):
    """From which byte each file is read again: none, its tail, or all of it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, size = F.col("o_orderkey"), F.col("o_custkey").cast("long")
    files = orders.select(F.concat(F.lit("o"), key.cast("string")).alias("file"), size.alias("size"))
    done = orders.where(key % 4 != 0).select(F.concat(F.lit("o"), key.cast("string")).alias("file"), F.when(key % 4 == 1, size).when(key % 4 == 2, size - 1).otherwise(size + 5).alias("size"), F.lit("fp").alias("fingerprint"))
    return state.pending(files, done, "fp").drop("lines_before")


_RANK = "list_sort(list(v))[CAST(floor({p} * (count(*) - 1) + 0.5) AS BIGINT) + 1]"


def _durations(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", F.floor(F.col("value") * 10).cast("long").alias("v"))


_DURATIONS_DUCK = "e AS (SELECT event_type, event_id, CAST(floor(value * 10) AS BIGINT) AS v FROM events)"


@query(f"WITH {_DURATIONS_DUCK} SELECT event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, round(avg(v), 6) AS avg, max(v) AS max, {_RANK.format(p=0.5)} AS p50, {_RANK.format(p=0.95)} AS p95 FROM e GROUP BY event_type")
def latency_summary(spark, sf_dir):
    """Count, sum, mean, maximum and nearest-rank percentiles of each group."""
    out = stats.nearest_rank_by(_durations(spark, sf_dir), "event_type", "v")
    return out.select("event_type", F.col("count").alias("n"), "total", F.round("avg", 6).alias("avg"), "max", "p50", "p95")


@query(f"WITH {_DURATIONS_DUCK} SELECT event_type, " + ", ".join(f"{_RANK.format(p=p / 100)} AS p{p}" for p in (0, 10, 25, 75, 90, 99, 100)) + " FROM e GROUP BY event_type")
def nearest_rank_percentiles(spark, sf_dir):
    out = stats.nearest_rank_by(_durations(spark, sf_dir), "event_type", "v", (0, 10, 25, 75, 90, 99, 100))
    return out.drop("count", "avg", "total", "max")


@query(f"WITH {_DURATIONS_DUCK} SELECT event_type, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM e) WHERE n <= 100")
def history_last_100(spark, sf_dir):
    """The bounded history of each group."""
    return stats.last_runs(_durations(spark, sf_dir), "event_type", ["event_id"])


@query(f"WITH {_DURATIONS_DUCK} SELECT event_type, event_id, v FROM e WHERE v > 0 ORDER BY event_id DESC LIMIT 3")
def recent_nonzero_top3(spark, sf_dir):
    """The newest runs with anything to report."""
    return stats.recent_with_redactions(_durations(spark, sf_dir), "v", ["event_id"])


@query(
    f"WITH {_DURATIONS_DUCK}, l AS (SELECT event_type, event_id, CAST(v AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM e) WHERE n <= 30), "
    "m AS (SELECT *, max(v) OVER (PARTITION BY event_type) AS top FROM l) "
    "SELECT event_type, string_agg(['▁','▂','▃','▄','▅','▆','▇','█'][CASE WHEN top = 0 THEN 1 ELSE CAST(floor(v / top * 7 + 0.5) AS BIGINT) + 1 END], '' ORDER BY event_id) AS series FROM m GROUP BY event_type"
)
def sparkline_by_type(spark, sf_dir):
    """A sparkline of each group's last thirty values."""
    history = stats.last_runs(_durations(spark, sf_dir), "event_type", ["event_id"])
    return stats.sparklines(history, "event_type", ["event_id"], "v")


@query(
    "SELECT event_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.2f GB', b / 1073741824.0) END AS size, "
    "CASE WHEN b < 1000 THEN CAST(b AS VARCHAR) || 'ms' WHEN b < 60000 THEN printf('%.1fs', b / 1000.0) ELSE CAST(b // 60000 AS VARCHAR) || 'm ' || CAST((b % 60000) // 1000 AS VARCHAR) || 's' END AS duration, "
    "strftime(make_timestamp(CAST(b AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS moment FROM (SELECT event_id, CAST(event_id AS BIGINT) * event_id * 8 AS b FROM events)"
)
def formatted_values(spark, sf_dir):
    """Sizes, durations and moments as people read them."""
    b = F.col("b")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id").cast("long") * F.col("event_id") * 8).alias("b"))
    return rows.select("event_id", display.format_bytes(b).alias("size"), display.format_duration_ms(b).alias("duration"), display.format_epoch(b).alias("moment"))


@query(
    "WITH r AS (SELECT event_id, (event_id * event_id) % 400000 AS ago FROM events) SELECT event_id, CASE WHEN ago < 60 THEN 'just now' WHEN ago < 120 THEN '1 minute ago' WHEN ago < 3600 THEN CAST(ago // 60 AS VARCHAR) || ' minutes ago' WHEN ago < 7200 THEN '1 hour ago' WHEN ago < 86400 THEN CAST(ago // 3600 AS VARCHAR) || ' hours ago' WHEN ago < 172800 THEN '1 day ago' ELSE CAST(ago // 86400 AS VARCHAR) || ' days ago' END AS said FROM r"
)
def relative_times(spark, sf_dir):
    """How long ago something was."""
    now = F.lit(1_700_000_000)
    ago = (F.col("event_id") * F.col("event_id")) % 400000
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", display.format_relative(now - ago, now).alias("said"))


@query("SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS line_ends FROM documents GROUP BY source")
def line_end_counts(spark, sf_dir):
    """Texts, bytes and line ends of each source."""
    text = F.col("text")
    return _documents(spark, sf_dir, heavy=False).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).cast("long").alias("bytes"), F.sum(display.count_lines(text)).cast("long").alias("line_ends"))


@query(
    f"WITH {_merged_duck(False)} SELECT i.doc_id, 'L1: ' || substr(v, 1, 8) || '...' || right(v, 4) || ' → [REDACTED:' || pattern_name || ']' AS report FROM (SELECT i.doc_id, pattern_name, replace(replace(substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), chr(10), '\\n'), chr(13), '\\r') AS v FROM islands i JOIN planted p ON i.doc_id = p.doc_id) i"
)
def diff_report(spark, sf_dir):
    """Findings as report lines with shortened secrets."""
    rows = planted(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.lit(1).alias("line_number"), detect.scrub("text", PLAIN)["redactions"].alias("redactions"))
    return ops.report(ops.findings(rows, "file", "line_number")).select(F.col("file").cast("long").alias("doc_id"), "report")


@query(f"WITH {_merged_duck(True)} SELECT pattern_name, count(*) AS count FROM (SELECT DISTINCT p.doc_id, pattern_name, substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS v FROM islands i JOIN planted p ON i.doc_id = p.doc_id) GROUP BY pattern_name")
def redactions_by_pattern(spark, sf_dir):
    """Different findings of each pattern: the flagship count."""
    rows = planted(spark, sf_dir).select("doc_id", detect.scrub("text", SCORED)["redactions"].alias("redactions"))
    return ops.count_by_pattern(ops.different(ops.findings(rows, "doc_id"), "doc_id"))


def _line_duck(text: str) -> str:
    """SQL of a conversation's line as it is rewritten, with keys in order."""
    return f"CASE WHEN role = 'user' THEN '{{\"message\":{{\"content\":' || CAST(to_json({text}) AS VARCHAR) || '}},\"type\":\"user\"}}' ELSE '{{\"message\":{{\"content\":[{{\"text\":' || CAST(to_json({text}) AS VARCHAR) || ',\"type\":\"text\"}}]}},\"type\":\"' || role || '\"}}' END"


_SPOKEN = f"{_TALKS}, planted AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, role, text FROM talks WHERE role <> 'system')"


@query(
    f"WITH {_merged_duck(True, BUILT_IN + CUSTOM, _SPOKEN)}, {_SCRUBBED_DUCK}, kinds AS (SELECT doc_id, count(DISTINCT (pattern_name, substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)))) AS n FROM islands JOIN planted USING (doc_id) GROUP BY doc_id), "
    "done AS (SELECT p.*, coalesce(k.n, 0) AS n, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END AS new_text FROM planted p LEFT JOIN rebuilt USING (doc_id) LEFT JOIN kinds k USING (doc_id)) "
    f"SELECT 'c' || CAST(conv_id AS VARCHAR) AS file, turn AS line_number, {_line_duck('new_text')} AS new_line, 'redacted' AS status, CAST(n AS INTEGER) AS n_redactions FROM done UNION ALL "
    "SELECT 'c' || CAST(conv_id AS VARCHAR), turn, '{\"type\":\"system\",\"message\":{\"content\":[{\"type\":\"text\",\"text\":' || CAST(to_json(text) AS VARCHAR) || '}]}}', 'skipped', 0 FROM talks WHERE role = 'system'"
)
def scrub_json_lines(spark, sf_dir):
    """Conversations as JSON lines, rewritten by all detectors."""
    settings = Settings(custom=CUSTOM)
    return ops.scrub_lines(conversation_lines(spark, sf_dir).select("file", "line_number", "line"), settings).select("file", "line_number", "new_line", "status", F.size("redactions").alias("n_redactions"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation turn: its line, rewritten, with what was found."""
    return scrub_json_lines(spark, sf_dir)
