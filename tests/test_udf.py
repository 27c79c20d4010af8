"""The kernel's functions in SQL."""

import json

from sievelight.config import Entropy, Settings
from sievelight.functions import udf
from sievelight.functions.patterns import Pattern

KEY = "ghp_" + "a1B2" * 9
RED = "[REDACTED:github-token]"


def test_functions_in_sql(spark):
    udf.register(spark, Settings(entropy=Entropy(enabled=False)))
    rows = [(f"x {KEY}",), (json.dumps({"a": [KEY], "password": "abcdefgh1"}),), (json.dumps({"type": "system", "a": KEY}),), (None,)]
    spark.createDataFrame(rows, "t string").createOrReplaceTempView("udf_rows")
    got = spark.sql("SELECT t, scrub_text(t).text AS a, scrub_json(t).text AS b, scrub_message(t) AS c FROM udf_rows").collect()
    plain, tree, system, null = got
    assert plain["a"] == "x " + RED and plain["b"] == plain["t"]
    assert json.loads(tree["b"]) == {"a": [RED], "password": "[REDACTED:sensitive-field]"}
    assert system["c"]["text"] == system["t"] and system["c"]["redactions"] == [] and RED in system["b"]
    assert null["a"] is None and null["c"] is None
    found = spark.sql("SELECT r.* FROM extract_redactions(TABLE(SELECT t AS line FROM udf_rows)) r").collect()
    assert sorted((r["line"], r["pattern_name"], r["matched_text"]) for r in found) == [(rows[1][0], "github-token", KEY), (rows[1][0], "sensitive-field", "abcdefgh1")]
    assert spark.sql("SELECT r.* FROM extract_redactions(TABLE(SELECT t AS line FROM udf_rows WHERE false)) r").count() == 0


def test_groups_inside_other_groups_have_a_python_form(spark):
    settings = Settings(entropy=Entropy(enabled=False), patterns=(), custom=(Pattern("deep", r"id:(?:#([0-9]{8,})|nobody)", (), 1),))
    df = spark.createDataFrame([("id:#12345678 id:nobody",)], "t string")
    assert df.select(udf.scrub_text(settings)("t")["text"]).first()[0] == "id:#[REDACTED:deep] [REDACTED:deep]"


def test_a_failing_line_is_marked(spark, monkeypatch):
    class Broken:
        def scrub_line(self, line):
            raise RuntimeError(line)

    assert udf.safe(Broken(), "x") == ("x", [], "error")
