"""Formatting and statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs of a sparkline from low to high, and how many values it shows.
GLYPHS = ("▁", "▂", "▃", "▄", "▅", "▆", "▇", "█")
WIDTH = 30
# Seconds of the 400 years after which dates repeat.
ERA = 146097 * 86400


def _div(n: Column, by: int) -> Column:
    """Whole part of a quotient of integers, exact at any size."""
    return F.call_function("div", n, F.lit(by))


def format_epoch(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC``, whatever the session's time zone; years take as many digits as they need."""
    # Dates repeat every 400 years, so a time of any size is one of the first 400 with its year moved.
    # A zone-less timestamp and its own text keep the session's zone out of it.
    whole = F.floor(seconds).cast("long")
    eras = _div(whole, ERA) - F.when(whole % ERA < 0, 1).otherwise(0)
    at = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.pmod(whole, F.lit(ERA)))
    return F.concat(F.format_string("%04d", F.year(at) + eras * 400), F.substring(at.cast("string"), 5, 15), F.lit(" UTC"))


def format_duration_ms(ms: Column) -> Column:
    minutes = F.concat(_div(ms, 60000).cast("string"), F.lit("m "), _div(ms % 60000, 1000).cast("string"), F.lit("s"))
    # The quotient of under 64 s, times 2^52, is a whole number, so its tenths are rounded from its very bits.
    bits = F.when(ms < 60000, (ms / F.lit(1000.0) * F.lit(float(1 << 52))).cast("long"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(_rounded(bits, 52, 1), F.lit("s"))).otherwise(minutes)


def _rounded(n: Column, power: int, digits: int) -> Column:
    """``n / 2^power`` with so many decimal digits, ties to even; ``format_string`` rounds ties up."""
    one, scale = 1 << power, 10**digits
    parts = n % one * scale
    down, rest = _div(parts, one), parts % one
    up = F.when((rest > one >> 1) | ((rest == one >> 1) & (down % 2 == 1)), 1).otherwise(0)
    total = _div(n, one) * scale + down + up
    return F.concat(_div(total, scale).cast("string"), F.lit("."), F.lpad((total % scale).cast("string"), digits, "0"))


def format_bytes(n: Column) -> Column:
    scaled = lambda power, digits, unit: F.concat(_rounded(n.cast("long"), 10 * power, digits), F.lit(unit))
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, scaled(1, 1, " KB"))
        .when(n < 1 << 30, scaled(2, 1, " MB"))
        .otherwise(scaled(3, 2, " GB"))
    )


def format_relative(seconds: Column, now: Column) -> Column:
    """How long ago; the future and the last minute are just now."""
    ago = now - seconds

    def unit(size: int, name: str) -> Column:
        n = F.floor(ago / size)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(ago < 60, "just now").when(ago < 3600, unit(60, "minute")).when(ago < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


def sparkline(values: Column) -> Column:
    """Glyphs of the last WIDTH values, scaled by their maximum; empty for none."""
    last = F.slice(values, F.greatest(F.size(values) - WIDTH + 1, F.lit(1)), WIDTH)
    top = F.array_max(last)
    # Ratios are never negative, so adding a half and flooring rounds half away from zero.
    place = lambda v: F.when(top == 0, 0).otherwise(F.floor(v / top * (len(GLYPHS) - 1) + 0.5))
    glyphs = F.array(*(F.lit(g) for g in GLYPHS))
    return F.when(F.size(values) == 0, "").otherwise(F.array_join(F.transform(last, lambda v: F.element_at(glyphs, place(v).cast("int") + 1)), ""))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def truncate_secret(text: Column) -> Column:
    """The first eight and last four characters, enough to recognise a value."""
    shown = escaped(text)
    return F.concat(F.substring(shown, 1, 8), F.lit("..."), F.right(shown, F.lit(4)))


def count_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pluralise(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def nearest_rank(sorted_values: Column, percent: int) -> Column:
    """The value at round(percent / 100 * (n - 1)), half away from zero, of an ascending array."""
    n = F.size(sorted_values)
    at = F.floor(F.lit(percent / 100.0) * (n - 1) + 0.5).cast("int")
    return F.when(n > 0, F.element_at(sorted_values, F.least(at, n - 1) + 1))
