import pytest
from pyspark.sql import functions as F

from sievelight.functions import display as d
from sievelight.operators import statistics as stats


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("n", "text"), [(0, "1970-01-01 00:00:00 UTC"), (1704067200, "2024-01-01 00:00:00 UTC"), (4102444799, "2099-12-31 23:59:59 UTC")])
def test_epoch(spark, n, text):
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert one(spark, d.format_epoch(F.lit(n))) == text
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(("n", "text"), [(42, "42ms"), (999, "999ms"), (1500, "1.5s"), (59999, "60.0s"), (125000, "2m 5s")])
def test_duration(spark, n, text):
    assert one(spark, d.format_duration_ms(F.lit(n))) == text


@pytest.mark.parametrize(("n", "text"), [(500, "500 B"), (1536, "1.5 KB"), (2097152, "2.0 MB"), (3 << 30, "3.00 GB")])
def test_bytes(spark, n, text):
    assert one(spark, d.format_bytes(F.lit(n))) == text


@pytest.mark.parametrize(
    ("n", "text"),
    [(253402300800, "10000-01-01 00:00:00 UTC"), (2900000000000, "93867-05-05 19:33:20 UTC"), (9223372036854, "294247-01-10 04:00:54 UTC"), (-62135596801, "0000-12-31 23:59:59 UTC"), (-1, "1969-12-31 23:59:59 UTC"), (-99999999999, "-1199-02-15 14:13:21 UTC"), (1710037800, "2024-03-10 02:30:00 UTC")],
)
def test_epoch_of_any_size(spark, n, text):
    for zone in ("UTC", "America/New_York"):  # an hour that a zone leaves out is one like any other
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert one(spark, d.format_epoch(F.lit(n))) == text
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_epoch_to_the_last_long(spark):
    assert one(spark, d.format_epoch(F.lit((1 << 63) - 1))).endswith("-12-04 15:30:07 UTC")


def test_ties_are_rounded_as_c_does(spark):
    rows = spark.range(1000, 60000, 7).union(spark.range(1000, 60000, 50)).select("id", d.format_duration_ms(F.col("id")).alias("said")).collect()
    assert [(r["id"], r["said"]) for r in rows] == [(r["id"], f"{r['id'] / 1000:.1f}s") for r in rows]
    sizes = [8 * k * k for k in range(12, 40000, 4)] + [1024 * k + 256 for k in range(1, 900)] + [(1 << 20) - 1, (1 << 30) - 1, (1 << 52) + (1 << 27)]
    said = lambda n: f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" if n < 1 << 30 else f"{n / (1 << 30):.2f} GB"
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", d.format_bytes(F.col("n")).alias("said")).collect()
    assert [(r["n"], r["said"]) for r in rows] == [(r["n"], said(r["n"])) for r in rows if r["n"] >= 1024]


@pytest.mark.parametrize(("ago", "text"), [(-5, "just now"), (59, "just now"), (60, "1 minute ago"), (150, "2 minutes ago"), (3600, "1 hour ago"), (7300, "2 hours ago"), (86400, "1 day ago"), (200000, "2 days ago")])
def test_relative(spark, ago, text):
    assert one(spark, d.format_relative(F.lit(1000000 - ago), F.lit(1000000))) == text


@pytest.mark.parametrize(("values", "text"), [([], ""), ([0, 0], "▁▁"), ([0, 50, 100], "▁▅█"), (list(range(40)), None)])
def test_sparkline(spark, values, text):
    got = one(spark, d.sparkline(F.lit([float(v) for v in values]) if values else F.expr("cast(array() as array<double>)")))
    assert got == text if text is not None else len(got) == 30 and got[-1] == "█"


def test_truncate_escape_basename_plural(spark):
    assert one(spark, d.truncate_secret(F.lit("ab\ncdefghijklmnop"))) == "ab\\ncdef...mnop"
    assert one(spark, d.truncate_secret(F.lit("éé"))) == "éé...éé"
    assert one(spark, d.basename(F.lit("/a/b.jsonl"))) == "b.jsonl"
    assert one(spark, d.pluralise(F.lit(1), "entry", "entries")) == "1 entry"
    assert one(spark, d.pluralise(F.lit(2), "entry", "entries")) == "2 entries"
    assert one(spark, d.count_lines(F.lit("a\nb\n"))) == 2


def test_nearest_rank(spark):
    values = F.lit([10 * k for k in range(1, 11)])
    assert one(spark, d.nearest_rank(values, 50)) == 60 and one(spark, d.nearest_rank(values, 95)) == 100
    assert one(spark, d.nearest_rank(F.expr("cast(array() as array<int>)"), 50)) is None
    rows = spark.createDataFrame([("a", 10 * k) for k in range(1, 11)] + [("b", 7)] * 3 + [("c", None)], "g string, v bigint")
    got = {r["g"]: r.asDict() for r in stats.nearest_rank_by(rows, "g", "v").collect()}
    assert got["a"] == {"g": "a", "count": 10, "avg": 55.0, "total": 550, "max": 100, "p50": 60, "p95": 100}
    assert got["b"]["p50"] == 7 and "c" not in got


def test_history(spark):
    runs = spark.createDataFrame([("f", k, k % 3) for k in range(150)], "g string, t bigint, n bigint")
    kept = sorted(r["t"] for r in stats.last_runs(runs, "g", ["t"]).collect())
    assert (len(kept), kept[0], kept[-1]) == (100, 50, 149)
    assert [r["t"] for r in stats.recent_with_redactions(runs, "n", ["t"]).collect()] == [149, 148, 146]
