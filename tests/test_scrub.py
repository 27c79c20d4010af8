"""Composite semantics of the text scrubber, natively and in Python."""

import base64
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings as options
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.config import Entropy, Settings, block_list, sha256_hex
from sievelight.functions import detect
from sievelight.functions.kernel import Scrubber
from sievelight.functions.patterns import KNOWN_EXAMPLES, Pattern

A = hashlib.sha256(b"1").hexdigest()
GHP = "ghp_" + A[:36]
HIGH = base64.b64encode(hashlib.sha256(b"7").digest()).decode()
OFF = Entropy(enabled=False)
ALLOW = frozenset([sha256_hex(GHP)])

TEXTS = [
    "",
    "nothing to see",
    f"one {GHP} here",
    f"é {GHP} — {GHP} — AKIA{A[:16].upper()}",
    f"touching AKIA{A[:16].upper()}ghp_{A[:36]}",
    f"GITHUB_TOKEN={GHP}",
    f"x {HIGH} y",
    f"password = '{A[:12]}' and api_key = \"{A[:24]}\"",
    f"aws_secret_key = \"{A[:40]}\"",
    f"example {KNOWN_EXAMPLES[0]} and {KNOWN_EXAMPLES[1]}",
    "[REDACTED:github-token] stays, password = '[REDACTED:password-assignment]'",
    "my blocked phrase and blocked phrase again, blocked phrases",
    "/usr/lib/some/long/path/of/many/parts/x1y2z3",
    "line one\nGHP_nothing\r\nsk-" + A[:24],
    "heroku api_key: 01234567-89ab-cdef-0123-456789abcdef",
    "𝒳 surrogate pairs " + GHP + " 𝒴",
]
SETTINGS = {
    "regex": Settings(entropy=OFF),
    "entropy": Settings(),
    "low": Settings(entropy=Entropy(threshold=3.0, exclude=("[0-9a-f]+", "("))),
    "allow": Settings(entropy=OFF, allow_hashes=ALLOW),
    "block": Settings(entropy=OFF, block_strings=block_list(["blocked phrase", "phrase and blocked", "my blocked phrase"])),
    "block allow": Settings(entropy=OFF, block_strings=("blocked phrase",), allow_hashes=frozenset([sha256_hex("blocked phrase")])),
    "custom": Settings(entropy=OFF, custom=(Pattern("opt", r"id:(?:([a-z]{8,})|[0-9]{8,})", (), 1), Pattern("plain", "nothing [a-z]+"))),
}


@pytest.mark.parametrize("name", [n for n in SETTINGS if n != "custom"])
def test_native_equals_python(spark, name):
    settings = SETTINGS[name]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", detect.scrub("text", settings).alias("r")).collect()
    twin = Scrubber(settings)
    for text, r in rows:
        new, found = twin.scrub_text(text)
        assert r["text"] == new
        assert [tuple(x) for x in r["redactions"]] == found
    for text, r in rows:  # what is left between the redactions is the text's own
        at, gaps = 0, []
        for x in r["redactions"]:
            assert x["start"] >= at and text[x["start"] : x["end"]] == x["matched_text"]
            gaps.append(text[at : x["start"]])
            at = x["end"]
        assert all(g in r["text"] for g in gaps)
        again, more = twin.scrub_text(r["text"])
        assert again == r["text"] or name == "low"
        del more


def test_null_stays_null(spark):
    row = spark.createDataFrame([(None,)], "text string").select(detect.scrub("text", Settings())).first()
    assert row[0] is None


def run(text, **settings):
    return Scrubber(Settings(**settings)).scrub_text(text)


def test_names_and_places():
    assert run(f"a {GHP} b", entropy=OFF) == ("a [REDACTED:github-token] b", [("github-token", 2, 42, GHP)])
    new, found = run(f"GITHUB_TOKEN={GHP}")
    assert new == "[REDACTED:high-entropy]" and found[0][1] == 0  # the token starts earlier, and so names the island


def test_only_the_value_of_an_assignment():
    assert run("pwd: 'abcdefgh'!", entropy=OFF)[0] == "pwd: '[REDACTED:password-assignment]'!"


def test_examples_pass_patterns_but_not_entropy():
    assert run(KNOWN_EXAMPLES[0], entropy=OFF)[1] == []
    assert run(KNOWN_EXAMPLES[1])[1][0][0] == "high-entropy"


def test_touching_spans_join_but_touching_block_hits_do_not():
    key = "AKIA" + "A1" * 8
    assert run(key + GHP, entropy=OFF)[0] == "[REDACTED:aws-access-key]"
    twin = Scrubber(Settings(entropy=OFF, block_strings=("abcdefgh",)))
    assert twin.block_spans("abcdefghabcdefgh") == [(0, 8), (8, 16)]


def test_allow_list_wins():
    assert run(f"x {GHP}", entropy=OFF, allow_hashes=ALLOW)[1] == []
    assert run("blocked phrase", entropy=OFF, block_strings=("blocked phrase",), allow_hashes=frozenset([sha256_hex("blocked phrase")]))[1] == []


def test_block_list_is_filtered():
    with pytest.warns(UserWarning, match="placeholder"):
        assert block_list(["REDACTED"]) == ()
    with pytest.warns(UserWarning, match="under 8"):
        assert block_list(["short", "long enough"]) == ("long enough",)


@options(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([GHP, HIGH, "blocked phrase", "=", " ", "é", "\n", "password='", A[:12], "'", "sk-", "x"]), max_size=9))
def test_scrubbing_twice_changes_nothing(parts):
    twin = Scrubber(Settings(block_strings=("blocked phrase",)))
    once, _ = twin.scrub_text("".join(parts))
    assert twin.scrub_text(once)[0] == once


def test_prefilter_lets_every_finding_through(spark):
    settings = Settings(block_strings=("blocked phrase",))
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", detect.may_hit("text", settings)).collect()
    twin = Scrubber(settings)
    assert all(hit for text, hit in rows if twin.scrub_text(text)[1])


@pytest.mark.parametrize(
    ("key", "expected"),
    [("password", True), ("db_password", True), ("dbpassword", False), ("API_KEY", True), ("apiKey", True), ("x-token", False), ("accessToken", False), ("token\n", False), ("my_token", True), ("", False)],
)
def test_sensitive_keys(spark, key, expected):
    from sievelight.functions.kernel import sensitive_key

    assert sensitive_key(key) is expected
    assert spark.createDataFrame([(key,)], "k string").select(detect.sensitive_key(F.col("k"))).first()[0] is expected


def test_byte_offsets(spark):
    row = spark.createDataFrame([("éa𝒳b", 3)], "t string, o int").select(detect.byte_offset(F.col("t"), F.col("o"))).first()
    assert row[0] == len("éa𝒳".encode())


@pytest.mark.parametrize("name", [n for n in SETTINGS if n != "custom"])
def test_relational_merge_equals_the_kernel(spark, name):
    from sievelight.operators.findings import islands, spans_of

    settings = SETTINGS[name]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    a = {tuple(r) for r in islands(spans_of(df, "id", "text", settings), "id").select("id", "start", "stop", "pattern_name").collect()}
    twin = Scrubber(settings)
    assert a == {(i, s, e, n) for i, t in enumerate(TEXTS) for n, s, e, _ in twin.scrub_text(t)[1]}


def test_positions_over_many_chunks(spark):
    text = "é".join(f"id:{k:08d} " for k in range(3 * detect.CHUNK + 5))
    for pattern in (Pattern("id", r"id:([0-9]{8})", (), 1), Pattern("id", r"\bid:([0-9]{8})\b", (), 1), Pattern("id", r"id:[0-9]{8}")):
        settings = Settings(entropy=OFF, patterns=(), custom=(pattern,))
        spans = spark.createDataFrame([(text,)], "t string").select(F.explode(detect.pattern_spans("t", settings)).alias("s")).select("s.*").collect()
        assert [(s["name"], s["start"], s["stop"], s["value"]) for s in spans] == [r[:3] + (r[3],) for r in Scrubber(settings).scrub_text(text)[1]]


def test_a_long_text_in_time(spark):
    """Five MB with 90,000 tokens: work in proportion to the text."""
    import time

    text = " ".join(base64.b64encode(hashlib.sha256(str(k).encode()).digest()).decode() + (" " + GHP if k % 9 == 0 else "") for k in range(90_000))
    began = time.perf_counter()
    row = spark.createDataFrame([(text,)], "text string").select(F.size(detect.scrub("text", Settings())["redactions"])).first()
    spans = spark.createDataFrame([(text,)], "text string").select(F.size(detect.token_spans("text"))).first()
    assert row[0] >= 90_000 and spans[0] == 100_000
    assert time.perf_counter() - began < 60


def test_expressions_are_quick_to_build(spark):
    import time

    detect.scrub("text", Settings())
    began = time.perf_counter()
    detect.scrub("text", Settings())
    detect.pattern_spans("text", Settings())
    assert time.perf_counter() - began < 2
