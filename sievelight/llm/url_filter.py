"""Operator 4: URL filters by rules, then by a ratio of character language models.

Host and path rules decide first; the longest fitting rule wins. URLs that a
rule accepts or rejects train two smoothed variable-order Markov models of
characters; all other URLs are rejected when their length-normalised
log-likelihood difference (accepted minus rejected) falls under a threshold
calibrated on rule-labelled URLs that a first model has not seen; the final
model counts these too. A score at the threshold is allowed.

The models count every gram and context of the URLs they are trained on, each
under a 64-bit hash of its own, so what is sent to the driver and broadcast
grows with the different grams of the labelled URLs.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is judged by the method; without labelled URLs of both kinds the method
allows everything; repeated rows get equal results; an empty table gives an
empty result; clashing input columns are renamed to ``input_<name>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import free_names, mapped, mix64, plus
from sievelight.llm.language_id import Table

#: Longest context plus one.
ORDERS = 5
#: Keys that a task holds before it merges equal ones.
HELD = 1_000_000
#: Of ten folds of the labelled URLs, this one calibrates the threshold.
FOLDS, HELD_OUT = 10, 0
#: Share of held-out accepted URLs that the threshold may reject.
FALSE_REJECTS = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of query op4.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    fits = [
        (r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path))
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    pick = lambda value: reduce(lambda rest, x: F.when(x[1], value(x[0])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(lambda r: F.lit(r.name)), pick(lambda r: F.lit(r.verdict))


def _stream(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all URLs, each between start marks and an end mark; places that are scored; URL of each."""
    bodies = [(u or "").encode("utf-8", "surrogatepass") for u in urls]
    mark = b"\x01" * (ORDERS - 1)
    symbols = np.frombuffer(b"".join(mark + b + b"\x02" for b in bodies), np.uint8).astype(np.uint64)
    lengths = np.array([len(b) + 1 for b in bodies], np.int64)
    owner = np.repeat(np.arange(len(bodies)), lengths)
    return symbols, np.arange(len(owner)) + (owner + 1) * (ORDERS - 1), owner


def _hashes(symbols: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For order 1, 2, ... hashes of the gram that ends at each place, and of its context."""
    context = np.zeros(len(at), np.uint64)
    for order in range(1, ORDERS + 1):
        if order > 1:
            context = mix64(context * np.uint64(257) + symbols[at - (order - 1)] + np.uint64(1))
        yield mix64(context + (symbols[at] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), context


def _keys(hashes: np.ndarray, kind: np.ndarray | int, order: int, part: int) -> np.ndarray:
    """Keys of grams (part 0) or contexts (part 1) of one order and kind."""
    own = np.asarray((kind * ORDERS + order) * 2 + part + 1, np.uint64)
    return mix64(hashes + np.atleast_1d(own) * np.uint64(0xC2B2AE3D27D4EB4F))


def count_urls(urls: list[str | None], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that hash (kind, order, gram or context), and how often each occurs."""
    if not urls:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    symbols, at, owner = _stream(urls)
    kind = kinds.astype(np.int64)[owner]
    keys = [_keys(hashes, kind, order, part) for order, both in enumerate(_hashes(symbols, at)) for part, hashes in enumerate(both)]
    return np.unique(np.concatenate(keys), return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with their counts, apart for URLs that calibrate and others."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for part, each in enumerate(held):
            if each:
                key, of = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, of, np.concatenate([n for _, n in each]))
                each.clear()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), part, np.int8)), pa.array(n)], names=["key", "part", "n"])

    for batch in batches:
        urls, kinds, parts = batch.column("url").to_pylist(), batch.column("kind").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
        for part in (0, 1):
            at = np.flatnonzero(parts == part)
            held[part].append(count_urls([urls[i] for i in at.tolist()], kinds[at]))
            size += len(held[part][-1][0])
        if size > HELD:
            yield from merged()
            size = 0
    yield from merged()


class RatioModel:
    """Interpolated Markov models of accepted (0) and rejected (1) URLs.

    Each order is mixed with the shorter one by count / (count + STRENGTH) of
    its context, down to the uniform distribution over bytes.
    """

    STRENGTH = 4.0

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.table = Table(keys.view(np.uint64), counts.astype(np.float64)[:, None])
        start = np.zeros(1, np.uint64)  # the empty context
        self.usable = bool(len(keys)) and all(self._counts(start, kind, 0, 1)[0] > 0 for kind in (0, 1))

    def _counts(self, hashes: np.ndarray, kind: int, order: int, part: int) -> np.ndarray:
        at, found = self.table.find(_keys(hashes, kind, order, part))
        return np.where(found, self.table.values[at, 0], 0.0)

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Accepted minus rejected log-likelihood, nats a character; 0 without both kinds."""
        if not self.usable or not urls:
            return np.zeros(len(urls))
        symbols, at, owner = _stream(urls)
        p = np.full((2, len(at)), 1 / 256)
        for order, (gram, context) in enumerate(_hashes(symbols, at)):
            seen, base = (np.stack([self._counts(hashes, kind, order, part) for kind in (0, 1)]) for part, hashes in enumerate((gram, context)))
            p = (seen + self.STRENGTH * p) / (base + self.STRENGTH)
        logs = np.log(p)
        return np.bincount(owner, logs[0] - logs[1], len(urls)) / np.bincount(owner, minlength=len(urls))


def _score(batches: Iterator[pa.RecordBatch], url: str, own: str, model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = model.value.scores(batch.column(url).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, own])


def _scored(df: DataFrame, url: str, model) -> DataFrame:
    return mapped(df, partial(_score, url=url, own="score", model=model), plus(df, "score double"))


def fit(judged: DataFrame, url: str) -> tuple[object, float]:
    """The broadcast model of all rule-labelled rows, and the threshold.

    A first model without one fold of the different labelled URLs scores that
    fold. The threshold lies half way between its lowest accepted and highest
    rejected scores, but for FALSE_REJECTS of either, and never rejects more
    accepted URLs than that. Without accepted URLs in the fold it is 0, where
    both models agree.
    """
    context = judged.sparkSession.sparkContext
    part = (fold_of("url") == HELD_OUT).cast("tinyint")
    labelled = judged.where("verdict IS NOT NULL").select(F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("kind")).withColumn("part", F.coalesce(part, F.lit(0).cast("tinyint")))
    counted = mapped(labelled, _count, "key bigint, part tinyint, n bigint").groupBy("key").agg(F.sum(F.when(F.col("part") == 0, F.col("n")).otherwise(0)).alias("first"), F.sum("n").alias("n")).toArrow()
    key, first, n = (counted.column(c).to_numpy() for c in ("key", "first", "n"))
    whole = RatioModel(key, n)
    if not whole.usable:
        return context.broadcast(whole), -np.inf
    early = context.broadcast(RatioModel(key[first > 0], first[first > 0]))
    low, high = (
        _scored(labelled.where("part = 1"), "url", early)
        .agg(
            F.percentile_approx(F.when(F.col("kind") == 0, F.col("score")), FALSE_REJECTS, 10000),
            F.percentile_approx(F.when(F.col("kind") == 1, F.col("score")), 1 - FALSE_REJECTS, 10000),
        )
        .first()
    )
    usable = early.value.usable
    early.unpersist()
    threshold = 0.0 if low is None or not usable else low if high is None else min(low, (low + high) / 2)
    return context.broadcast(whole), threshold


def fold_of(url: str) -> Column:
    return F.pmod(F.xxhash64(F.col(url)), F.lit(FOLDS))


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, score, judged_by and verdict (allow or block)."""
    pages = free_names(pages, ["host", "path", "rule", "score", "judged_by", "verdict"])
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": verdict})
    model, threshold = fit(judged, url)
    by_model = F.when(F.col("score") < F.lit(threshold), "block").otherwise("allow")
    return _scored(judged, url, model).withColumns(
        {"judged_by": F.when(F.col("rule").isNull(), "model").otherwise("rule"), "verdict": F.coalesce("verdict", by_model)}
    )


def op4_query(pages: DataFrame) -> DataFrame:
    """The digest of query op4."""
    return filter_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "judged_by", F.round("score", 6).alias("score"))
