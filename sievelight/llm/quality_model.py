"""Operator 2: a quality classifier learned from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (of all documents;
3^labellers patterns at most) estimates how each labeller votes on good and on
bad documents, without any given label, and the posterior of each pattern.
Posteriors then are the soft targets of a hashed linear scorer, fitted on a
sample of at most MAX_TRAINING different texts (those of the smallest text
hashes, each once, however many copies it has), which scores every document by
its words and word shapes.

Defined cases: a null or empty text has no features and gets the score of the
scorer's bias, and is not kept; short texts get few votes; a score at the
threshold is kept; a long text is read whole, one longer than a step alone;
repeated rows get equal results; an empty table gives an empty result; clashing input columns are
renamed to ``input_<name>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import byte_lengths, free_names, mapped, mix64, plus, settle, text_runs

MAX_TRAINING = 12_000
FEATURE_BITS = 17
THRESHOLD = 0.25
#: Fewest words on which labellers of shares vote.
ENOUGH = 20
GOOD, BAD, NONE = 1, 0, 2
#: Most rounds of expectation-maximisation, and the shift of a posterior below which it has ended.
ROUNDS, LEAST_SHIFT = 200, 1e-7


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _CAPITALS + _CAPITALS.lower()
_HIGH = bytes(range(128, 256))
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_MARK = re.compile(rb"[#*$%&|<>{}]")


def statistics(words: list[bytes], codes: np.ndarray, text: str) -> dict[str, float]:
    """Shares of a text with at least one word."""
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode()
    ascii_ = len(data.translate(None, _HIGH))
    # Characters beyond ASCII count as letters; capitals are those of ASCII.
    letters = len(data) - len(data.translate(None, _LETTERS)) + len(text) - ascii_
    pairs = codes[:-1].astype(np.int64) * (int(codes.max()) + 1) + codes[1:] if n > 1 else np.zeros(0, np.int64)
    return {
        "words": n,
        "symbols": sum(map(text.count, "#*$%&|<>{}")) / n,
        "shouts": text.count("!") / n,
        "upper": (len(data) - len(data.translate(None, _CAPITALS))) / max(1, letters),
        "letters": letters / max(1, len(text)),
        "odd_words": sum(not _LETTER.search(w) for w in words) / n,
        "marked_words": sum(_MARK.search(w) is not None for w in words) / n,
        "ends": sum(w[-1:] in (b".", b"?", b"!", b":") for w in words) / n,
        "word_length": sum(map(len, words)) / n,
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "same_pairs": 1 - len(np.unique(pairs)) / max(1, len(pairs)),
        "kinds": len(np.unique(codes)) / n,
    }


#: Name, statistic, (good from, good to), (bad under, bad over); between them the labeller is silent.
LABELLERS = (
    ("symbols", "symbols", (0.0, 0.05), (None, 0.20)),
    ("odd words", "odd_words", (0.0, 0.05), (None, 0.15)),
    ("marked words", "marked_words", (0.0, 0.03), (None, 0.15)),
    ("shouting", "shouts", (0.0, 0.05), (None, 0.25)),
    ("capitals", "upper", (0.0, 0.15), (None, 0.40)),
    ("letters", "letters", (0.70, 1.0), (0.60, None)),
    ("sentences", "ends", (0.03, 0.30), (0.008, 0.60)),
    ("word length", "word_length", (3.0, 9.0), (2.0, 14.0)),
    ("lines", "same_lines", (0.0, 0.10), (None, 0.30)),
    ("phrases", "same_pairs", (0.0, 0.20), (None, 0.50)),
    ("variety", "kinds", (0.30, 1.0), (0.15, None)),
)


def votes(stats: dict[str, float]) -> list[int]:
    out = []
    for _, name, (low, high), (under, over) in LABELLERS:
        x = stats[name]
        if stats["words"] < ENOUGH and name not in ("symbols", "upper", "shouts"):
            out.append(NONE)
        elif low <= x <= high:
            out.append(GOOD)
        elif under is not None and x < under or over is not None and x > over:
            out.append(BAD)
        else:
            out.append(NONE)
    return out


_CLASS = np.zeros(256, np.uint8)
_CLASS[:] = ord("s")
for _a, _b, _c in ((0x61, 0x7A, "a"), (0x41, 0x5A, "A"), (0x30, 0x39, "0"), (0x80, 0xFF, "u")):
    _CLASS[_a : _b + 1] = ord(_c)
for _c in b".,;:!?'-":
    _CLASS[_c] = _c
_TRANSLATE = _CLASS.tobytes()


def shape(word: bytes) -> bytes:
    """Classes of a word's bytes, each run as one: ``Hello.`` gives ``Aa.``."""
    s = word.translate(_TRANSLATE)
    return bytes(c for i, c in enumerate(s) if i == 0 or c != s[i - 1])


class Features:
    """Hashed features of the documents of a run, by their words."""

    def __init__(self, texts: list[str | None]):
        self.words = [(t or "").encode().split() for t in texts]
        flat = [w for ws in self.words for w in ws]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.first = np.cumsum(self.counts) - self.counts
        self.codes, unique = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), np.array([], object))
        slots = np.uint64(64 - FEATURE_BITS)
        of_word = pd.util.hash_array(np.array([w.lower() for w in unique], dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
        of_shape = pd.util.hash_array(np.array([b"\x00" + shape(w) for w in unique], dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
        self.word_slot = (mix64(of_word) >> slots).astype(np.int64)
        self.shape_slot = (mix64(of_shape) >> slots).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and weights of one document: shares of its words and of its shapes, each scaled to length one."""
        at = self.first[i]
        codes = self.codes[at : at + self.counts[i]]
        out = []
        for slots in (self.word_slot, self.shape_slot):
            s, n = np.unique(slots[codes], return_counts=True)
            out.append((s, n / max(1e-9, np.sqrt((n.astype(float) ** 2).sum()))))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


class Scorer:
    """A logistic model over hashed features."""

    def __init__(self):
        self.weights = np.zeros(1 << FEATURE_BITS, np.float32)
        self.bias = 0.0

    def fit(self, slots: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.3, decay: float = 1e-6) -> None:
        """Adagrad over batches in the order given; classes weigh alike."""
        if not len(target):
            return
        good = max(float(target.mean()), 1e-6)
        weight = target * (0.5 / good) + (1 - target) * (0.5 / max(1 - good, 1e-6))
        weight = np.minimum(weight, 20.0)
        squares = np.full(1 << FEATURE_BITS, 1e-6)
        w = np.zeros(1 << FEATURE_BITS)
        b, bias_squares = 0.0, 1e-6
        for _ in range(epochs):
            for at in range(0, len(target), batch):
                s, v = np.concatenate(slots[at : at + batch]), np.concatenate(values[at : at + batch])
                row = np.repeat(np.arange(len(target[at : at + batch])), [len(x) for x in slots[at : at + batch]])
                z = np.bincount(row, w[s] * v, len(target[at : at + batch])) + b
                slip = (1 / (1 + np.exp(-z)) - target[at : at + batch]) * weight[at : at + batch] / batch
                touched, of = np.unique(s, return_inverse=True)
                g = np.bincount(of, slip[row] * v, len(touched)) + decay * w[touched]
                squares[touched] += g * g
                w[touched] -= rate * g / np.sqrt(squares[touched])
                bias_squares += slip.sum() ** 2
                b -= rate * slip.sum() / np.sqrt(bias_squares)
        self.weights, self.bias = w.astype(np.float32), b

    def scores(self, texts: list[str | None]) -> np.ndarray:
        f = Features(texts)
        z = np.full(len(texts), self.bias)
        for slots in (f.word_slot, f.shape_slot):
            s = slots[f.codes].astype(np.int64) + f.owner * (1 << FEATURE_BITS)
            each, n = np.unique(s, return_counts=True)
            owner, slot = each >> FEATURE_BITS, each & ((1 << FEATURE_BITS) - 1)
            norm = np.sqrt(np.bincount(owner, n.astype(float) ** 2, len(texts)))
            z += np.bincount(owner, self.weights[slot] * n, len(texts)) / np.maximum(norm, 1e-9)
        return 1 / (1 + np.exp(-z))


def label_model(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each row of votes, the vote tables [class, labeller, vote], and the share of good.

    Starts from the majority of votes. Labellers are taken as independent
    given the class, and silence as no evidence.
    """
    n, labellers = patterns.shape
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    posterior = np.clip((good + 1) / (good + 3 * bad + 1.25), 0.02, 0.98)
    onehot = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
    tables, share = np.zeros((2, labellers, 2)), 0.5
    for _ in range(ROUNDS):
        share = float(np.clip((posterior * counts).sum() / max(1, counts.sum()), 0.01, 0.99))
        for c, p in enumerate((1 - posterior, posterior)):
            seen = np.einsum("n,nlv->lv", p * counts, onehot) + 0.5
            tables[c] = seen / seen.sum(axis=1, keepdims=True)
        logs = np.einsum("nlv,clv->nc", onehot, np.log(tables)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        shift = float(np.abs(new - posterior).max()) if n else 0.0
        posterior = new
        if shift < LEAST_SHIFT:
            break
    return posterior, tables, share


def _observe(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Votes of every text as one integer (-1 without words), and features of those whose hash is at most ``most``, once a task for equal texts."""
    done: set[int] = set()  # as many as the sample has, at most
    for batch in batches:
        texts = batch.column("text")
        hashes = batch.column("hash").to_numpy(zero_copy_only=False)
        for start, stop in text_runs(byte_lengths(texts)):
            part = texts.slice(start, stop - start).to_pylist()
            f = Features(part)
            codes = np.split(f.codes, np.cumsum(f.counts)[:-1]) if len(part) else []
            pattern, slots, values = [], [], []
            for i, t in enumerate(part):
                if not f.counts[i]:
                    pattern.append(-1)
                else:
                    v = votes(statistics(f.words[i], codes[i], t))
                    pattern.append(sum(x * 3**k for k, x in enumerate(v)))
                h = int(hashes[start + i])
                s, w = f.of(i) if f.counts[i] and h <= most and h not in done else (None, None)
                if s is not None:
                    done.add(h)
                slots.append(s)
                values.append(w)
            arrays = [pa.array(pattern, pa.int32()), batch.column("hash").slice(start, stop - start), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["pattern", "hash", "slots", "weights"])


def sample_limit(rows: DataFrame) -> int:
    """The hash up to which about twice MAX_TRAINING different texts lie; the smallest hashes of these are the sample."""
    different = rows.select("hash").distinct().count()
    return -(1 << 63) + min((1 << 64) - 1, (1 << 65) * MAX_TRAINING // max(1, different))


def fit(docs: DataFrame, text: str = "text"):
    """A broadcast Scorer, and (posterior by pattern, tables, share) of the label model."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    most = sample_limit(rows)
    seen = settle(mapped(rows, partial(_observe, most=most), "pattern int, hash bigint, slots array<int>, weights array<float>"))
    counted = seen.where("pattern >= 0").groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r[0] for r in counted], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 if len(codes) else np.zeros((0, len(LABELLERS)), np.int64)
    posterior, tables, share = label_model(patterns, np.array([r[1] for r in counted], float))
    of = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    sample = seen.where("slots IS NOT NULL").dropDuplicates(["hash"]).orderBy("hash").limit(MAX_TRAINING).toArrow()
    scorer = Scorer()
    slots = [np.asarray(x.as_py(), np.int64) for x in sample.column("slots")]
    values = [np.asarray(x.as_py(), np.float64) for x in sample.column("weights")]
    scorer.fit(slots, values, np.array([of[p] for p in sample.column("pattern").to_pylist()]))
    return spark.sparkContext.broadcast(scorer), (of, tables, share)


def _score(batches: Iterator[pa.RecordBatch], text: str, scorer, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(text)
        for start, stop in text_runs(byte_lengths(texts)):
            part = batch.slice(start, stop - start)
            body = texts.slice(start, stop - start).to_pylist()
            scores = scorer.value.scores(body)
            kept = [bool(s >= threshold and t and t.strip()) for s, t in zip(scores, body, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(kept)], names=[*part.schema.names, "quality_score", "kept"])


def classify(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with quality_score (0 to 1) and kept."""
    docs = free_names(docs, ["quality_score", "kept"])
    scorer, _ = fit(docs, text)
    return mapped(docs, partial(_score, text=text, scorer=scorer, threshold=threshold), plus(docs, "quality_score double, kept boolean"))


def op2_query(docs: DataFrame) -> DataFrame:
    """The digest of query op2."""
    return classify(docs.select("doc_id", "text")).select("doc_id", F.round("quality_score", 6).alias("quality_score"), "kept")
