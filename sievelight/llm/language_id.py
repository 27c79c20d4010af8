"""Operator 7: language identification by character models with interpolated Kneser-Ney smoothing.

Texts are lower-cased; every run of characters that are no letters becomes one
space. The counts of the longest grams come from every training document;
lower orders are Kneser-Ney continuation counts, which follow from them. Each
order is stored as a sorted array of gram hashes with one row of log
probabilities, a column for each language, so one search serves all languages.
The lowest cross-entropy a character wins; a text is rejected when that
cross-entropy, relative to its language's mean, lies above a limit calibrated
on a fold of documents that a first model has not seen; the final model counts
that fold too. Without such documents the training ones give the means, and
the least limit holds.

The model is broadcast and holds every gram of the training documents, so its
size grows with the different grams of all languages.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
not rejected or scored; without training rows every text is ``und``; rows with
a null language train nothing; ties go to the language that sorts first; a
long text is read in steps of whole texts, and one longer than a step alone;
repeated rows get equal results; an empty table gives an empty result;
clashing input columns are renamed to ``input_<name>``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import byte_lengths, free_names, mapped, mix64, plus, settle, text_runs

ORDER = 5
BITS = 12
#: Hash ranges over which grams are summed, at least, and tasks whose grams of a range are summed in one group.
LEAST_RANGES, FAN_IN = 32, 256
#: Grams a task holds before it merges equal ones.
HELD = 1_000_000
#: Bytes of text that are turned into grams at a time; each takes some hundred bytes of arrays.
STEP_BYTES = 1 << 19
#: One of so many training documents calibrates the rejection.
CALIBRATION_FOLD = 20
#: Letters from which each band of lengths starts, the quantile of its documents, and the margin above it (texts that mix languages stay).
BANDS, QUANTILE, MARGIN = (0, 64, 256, 1024, 4096), 0.999, 1.5
#: Documents that calibrate a band at least; a limit is never lower than this many times the mean, and is that in bands with fewer.
LEAST_BAND, LEAST_LIMIT = 20, 1.8
UNKNOWN = "und"
#: How fast scores part with the square root of the letters.
SHARPNESS = 10.0


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for all but letters; those from 3840 up share 255 symbols."""
    table = np.zeros(0x110000, np.uint16)
    letters = np.fromiter((i for i in range(1, 0x110000) if chr(i).isalpha()), np.int64)
    table[letters] = np.where(letters < 3840, letters, 3841 + letters % 255)
    return table


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed grams of the longest order at each scored place, the text of each, and letters of each text."""
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    pad = np.zeros(ORDER, np.uint32)
    sizes = np.array([len(p) for p in points], np.int64)
    parts = [x for p in points for x in (pad, p)]
    symbols = _symbols()[np.concatenate([*parts, pad])]
    owner = np.repeat(np.arange(len(texts) + 1), np.append(sizes + ORDER, ORDER))
    letters = np.bincount(owner[symbols > 0], minlength=len(texts))[: len(texts)]
    # Of each run of zeros one is kept, and all ORDER of a text's start; its last one closes the text before.
    place = np.arange(len(owner)) - np.repeat(np.cumsum(np.append(sizes + ORDER, ORDER)) - np.append(sizes + ORDER, ORDER), np.append(sizes + ORDER, ORDER))
    before = np.concatenate([[1], symbols[:-1]])
    keep = (symbols > 0) | (before > 0) | (place < ORDER)
    symbols, owner, place = symbols[keep].astype(np.uint64), owner[keep], place[keep]
    grams = np.zeros(len(symbols), np.uint64)
    for k in range(ORDER):
        grams[k:] |= symbols[: len(symbols) - k] << np.uint64(BITS * k)
    scored = place >= ORDER
    # The first place of a text's padding doubles as the end of the text before it.
    end = np.flatnonzero((place == 0) & (owner > 0))
    scored[end] = symbols[end - 1] > 0
    owner = owner - ((place == 0) & (owner > 0))
    scored &= owner < len(texts)
    return grams[scored], owner[scored], letters


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(counts, start)


def _by_range(lang: str | None, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A language's grams in packed rows, one for each hash range."""
    of = (((mix64(keys) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of, keys, counts = of[order], keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(of))[: len(start)]
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (keys, counts)]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(start), pa.string()), pa.array(of[start]), *packed], names=["lang", "range", "grams", "counts"])


def _count(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged() -> None:
        for lang, parts in held.items():
            held[lang] = [_summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for keys, counts in parts:
                yield _by_range(lang, keys, counts, ranges)
        held.clear()

    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang").to_pylist()
        for start, stop in text_runs(byte_lengths(texts), STEP_BYTES):
            grams, owner, _ = stream(texts.slice(start, stop - start).to_pylist())
            names, of = np.unique(np.array(langs[start:stop], dtype=object), return_inverse=True)
            of = of[owner]
            for k, lang in enumerate(names):
                keys, counts = np.unique(grams[of == k], return_counts=True)
                held.setdefault(lang, []).append((keys, counts))
                size += len(keys)
            if size > HELD:
                merged()
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from flushed()
                    size = 0
    merged()
    yield from flushed()


def _sum(table: pa.Table) -> pa.Table:
    """One range of a language: equal grams of all tasks summed."""
    keys, counts = (np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in (("grams", np.uint64), ("counts", np.int64)))
    keys, counts = _summed(keys, counts)
    out = table.select(["lang", "range"]).slice(0, 1)
    return out.append_column("grams", pa.array([keys.tobytes()], pa.binary())).append_column("counts", pa.array([counts.tobytes()], pa.binary()))


PACKED = "lang string, range bigint, grams binary, counts binary"


def gram_counts(training: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, range, grams, counts) over all rows of ``training`` with a language: packed grams and how often each occurs.

    A range of a language is first summed over lots of FAN_IN tasks, so that
    no group grows with the input beyond its different grams.
    """
    rows = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    ranges = max(LEAST_RANGES, int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    lots = mapped(rows, partial(_count, ranges=ranges), PACKED).withColumn("lot", F.floor(F.spark_partition_id() / FAN_IN))
    summed = lots.groupBy("lang", "range", "lot").applyInArrow(_sum, PACKED)
    return settle(summed.groupBy("lang", "range").applyInArrow(_sum, PACKED))


class Table:
    """A sorted array of hashes with a row of values for each.

    Hashes are uniform, so a directory by their leading bits leaves a search
    no more than a few steps.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix64(keys)
        order = np.argsort(hashes)
        self.size = len(keys)
        self.hashes = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.ascontiguousarray(values[order])
        bits = max(4, self.size.bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(self.hashes[:-1] >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key, and whether it is there."""
        hashes = mix64(keys)
        at = self.directory[(hashes >> self.shift).astype(np.int64)]
        there = self.hashes[at]
        low = np.flatnonzero(there < hashes)
        while len(low):
            at[low] += 1
            there[low] = self.hashes[at[low]]
            low = low[there[low] < hashes[low]]
        found = (there == hashes) & (at < self.size)
        at[at == self.size] = 0
        return at, found


class LanguageModel:
    """Kneser-Ney models of all languages over shared tables."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.limits: dict[int, float] = {}
        self.means = np.ones(max(1, len(langs)))
        self.grams: list[Table] = []
        self.backoffs: list[Table] = []
        if not langs:
            return
        keys, row = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, (row, lang), n)
        levels = []
        for order in range(ORDER, 0, -1):
            levels.append((order, keys, counts))
            if order > 1:
                suffix, of = np.unique(keys & np.uint64((1 << BITS * (order - 1)) - 1), return_inverse=True)
                lower = np.zeros((len(suffix), len(langs)))
                np.add.at(lower, of, counts > 0)  # in how many ways each is preceded
                keys, counts = suffix, lower
        size = len(levels[-1][1]) + 1
        below: np.ndarray | None = None
        below_keys = np.zeros(0, np.uint64)
        for order, keys, counts in reversed(levels):
            once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
            discount = np.clip(np.where(once > 0, once / np.maximum(1, once + 2 * twice), 0.5), 0.1, 0.95)
            contexts, of = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, of, counts)
            np.add.at(kinds, of, counts > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(counts - discount, 0) / np.maximum(total, 1)[of]
            if below is None:
                rest = np.full((len(keys), len(langs)), 1 / size)
            else:
                rest = below[np.searchsorted(below_keys, keys & np.uint64((1 << BITS * (order - 1)) - 1))]
            p = own + weight[of] * rest
            self.grams.append(Table(keys, np.log(p).astype(np.float32)))
            self.backoffs.append(Table(contexts, np.log(weight).astype(np.float32)))
            below, below_keys = p, keys
        self.floor = float(-np.log(size))

    def log_probabilities(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row for each gram with the log probability of its last symbol in each language."""
        if order == 0:
            return np.full((len(grams), len(self.langs)), self.floor, np.float32)
        table = self.grams[order - 1]
        at, found = table.find(grams)
        out = table.values[at]
        lost = np.flatnonzero(~found)
        if len(lost):
            shorter = grams[lost]
            out[lost] = self.log_probabilities(shorter & np.uint64((1 << BITS * (order - 1)) - 1), order - 1)
            backoff = self.backoffs[order - 1]
            at, found = backoff.find(shorter >> np.uint64(BITS))
            out[lost[found]] += backoff.values[at[found]]
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol of each text in each language (nan without a letter), and the letters."""
        grams, owner, letters = stream(texts)
        out = np.full((len(texts), max(1, len(self.langs))), np.nan)
        if self.langs and len(grams):
            logs = self.log_probabilities(grams)
            n = np.bincount(owner, minlength=len(texts))
            for k in range(len(self.langs)):
                total = np.bincount(owner, logs[:, k], len(texts))
                out[:, k] = np.where(letters > 0, -total / np.maximum(n, 1), np.nan)
        return out, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, int, bool]]:
        """Language, score, cross-entropy, letters and rejection of each text."""
        entropies, letters = self.cross_entropies(texts)
        rows = []
        for e, n in zip(entropies, letters.tolist(), strict=True):
            if n == 0 or not self.langs:
                rows.append((UNKNOWN, 0.0, None, n, False))
                continue
            best = int(np.argmin(e))
            score = 1 / float(np.exp(-(e - e[best]) * SHARPNESS * np.sqrt(n)).sum())
            band = max(i for i, least in enumerate(BANDS) if n >= least)
            limit = self.limits.get(band)
            rows.append((self.langs[best], score, float(e[best]), n, limit is not None and e[best] / self.means[best] > limit))
        return rows


OWN = "lang_pred string, score double, cross_entropy double, n_letters bigint, rejected boolean"
NAMES = [x.split()[0] for x in OWN.split(", ")]


def _predict(batches: Iterator[pa.RecordBatch], text: str, model) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
    for batch in batches:
        texts = batch.column(text)
        for start, stop in text_runs(byte_lengths(texts), STEP_BYTES):
            part = batch.slice(start, stop - start)
            rows = model.value.predict(texts.slice(start, stop - start).to_pylist())
            own = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, *NAMES])


def predicted(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the five columns of OWN. ``model``: a broadcast LanguageModel. No shuffle."""
    docs = free_names(docs, NAMES)
    return mapped(docs, partial(_predict, text=text, model=model), plus(docs, OWN))


def _model(packed: list[dict], langs: list[str]) -> LanguageModel:
    values = [np.concatenate([np.zeros(0, k), *(np.frombuffer(r[c], k) for r in packed)]) for c, k in (("grams", np.uint64), ("counts", np.int64))]
    place = np.repeat(np.array([langs.index(r["lang"][1:]) for r in packed], np.int64), [len(r["grams"]) // 8 for r in packed])
    return LanguageModel(langs if len(place) else [], place, *values)


def fit(training: DataFrame, text: str = "text", lang: str = "lang"):
    """A broadcast model of all rows with a language; its rejection is calibrated with one of the rest but a fold, on that fold."""
    spark = training.sparkSession
    rows = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    fold = F.when(F.pmod(F.xxhash64("text"), F.lit(CALIBRATION_FOLD)) == 0, "1").otherwise("0")
    packed = gram_counts(rows.withColumn("part", F.concat(fold, "lang")), "text", "part").toArrow().to_pylist()
    langs = sorted({r["lang"][1:] for r in packed})
    known = [r for r in packed if r["lang"][0] == "0"]
    apart = 0 < len(known) < len(packed) and {r["lang"][1:] for r in known} == set(langs)
    means, bands = _seen(rows.where(fold == "1"), _model(known, langs)) if apart else ({}, {})  # the first model is gone before the final one is made
    del known
    model = _model(packed, langs)
    if model.langs:
        if not means:  # too few documents to keep any apart
            means, bands = _seen(rows, model)
        if means:
            model.means = np.array([means.get(x, float(np.mean(list(means.values())))) for x in langs])
            model.limits = {i: max(bands.get(i, 0.0) * MARGIN, LEAST_LIMIT) for i in range(len(BANDS))}
    return spark.sparkContext.broadcast(model)


def _seen(rows: DataFrame, model: LanguageModel) -> tuple[dict[str, float], dict[int, float]]:
    """Mean cross-entropy of each language over rightly predicted rows, and of each band the high quantile of their ratios to it."""
    first = rows.sparkSession.sparkContext.broadcast(model)
    seen = predicted(rows, first).where("lang_pred = lang").select("lang", "cross_entropy", "n_letters").persist()
    means = {r[0]: r[1] for r in seen.where(f"n_letters >= {BANDS[1]}").groupBy("lang").agg(F.avg("cross_entropy")).collect()}
    bands: dict[int, float] = {}
    if means:
        mean = F.element_at(F.create_map(*(F.lit(x) for k, v in means.items() for x in (k, v))), F.col("lang"))
        band = F.lit(0)
        for i, least in enumerate(BANDS):
            band = F.when(F.col("n_letters") >= least, i).otherwise(band)
        ratios = seen.select(band.alias("band"), (F.col("cross_entropy") / mean).alias("x")).groupBy("band")
        bands = {r["band"]: r["x"] for r in ratios.agg(F.percentile_approx("x", QUANTILE, 10000).alias("x"), F.count("x").alias("n")).collect() if r["n"] >= LEAST_BAND}
    seen.unpersist()
    first.unpersist()
    return means, bands


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from the training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """All columns of ``docs`` with held_out and the columns of OWN, by a model of the rows not held out."""
    docs = free_names(docs, ["held_out", *NAMES])
    model = fit(docs.where(~held_out(key)), text, lang)
    return predicted(docs.withColumn("held_out", held_out(key)), model, text)


def op7_query(docs: DataFrame) -> DataFrame:
    """The digest of query op7."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    found = predicted(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", F.round("cross_entropy", 6).alias("cross_entropy"))
