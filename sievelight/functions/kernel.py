"""The Python twin of the native expressions, and the walk over JSON values.

Used where nested JSON has to be rewritten, which no built-in expresses.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from typing import Any

from sievelight.config import Settings, sha256_hex
from sievelight.functions.patterns import EXCLUDED_TOKEN, KNOWN_EXAMPLES, MIN_FORCED_BYTES, MIN_SPAN_BYTES, PLACEHOLDER, PREFIX_BYTES, SENSITIVE_KEYS, SKIPPED_PREFIXES, TOKEN, WHITE, compiled

#: (pattern name, start, end, matched text); offsets count code points.
Redaction = tuple[str, int, int, str]
MAX_JSON_DEPTH = 127
_TOKEN = re.compile(TOKEN)
_EXCLUDED = compiled(f"^(?:{'|'.join(EXCLUDED_TOKEN)})\\Z")
_LONE = re.compile("[\ud800-\udfff]")
_BLANK = re.compile(rf"[{WHITE}]*\Z")
_SENSITIVE, _SENSITIVE_ENDS = frozenset(SENSITIVE_KEYS), tuple("_" + k for k in SENSITIVE_KEYS)
_SKIPPED = tuple(p.encode() for p in SKIPPED_PREFIXES)


def entropy(token: str) -> float:
    """Bits a byte over the byte frequencies."""
    data = token.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


class Scrubber:
    """All rules of a run, compiled once."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.rules = [(p, compiled(p.regex)) for p in settings.all_patterns]
        valid = []
        for p in settings.entropy.exclude:
            try:
                compiled(p)
                valid.append(p)
            except re.error:
                continue
        self.user_excluded = compiled(f"^(?:{'|'.join(valid)})\\Z") if valid else None
        #: ASCII texts of fewer characters never change: matches, forced values and tokens (20) have a least length, blocked values none.
        self.least = 0 if settings.block_strings or settings.block_hashes else min(MIN_SPAN_BYTES, MIN_FORCED_BYTES)

    def allowed(self, value: str) -> bool:
        return bool(self.settings.allow_hashes) and sha256_hex(value) in self.settings.allow_hashes

    def hash_blocked(self, value: str) -> bool:
        return bool(self.settings.block_hashes) and sha256_hex(value) in self.settings.block_hashes

    def blocked(self, text: str) -> bool:
        return any(s in text for s in self.settings.block_strings) or self.hash_blocked(text)

    def _regex_spans(self, text: str) -> list[tuple[int, int, str]]:
        lowered, out = text.lower(), []
        for pattern, rule in self.rules:
            if pattern.keywords and not _holds(lowered, pattern.keywords):
                continue
            for m in rule.finditer(text):
                if _holds(m[0], KNOWN_EXAMPLES):
                    continue
                group = pattern.group if pattern.group is not None and m[pattern.group] is not None else 0
                value = m[group]
                if (len(value) >= MIN_SPAN_BYTES or len(value.encode()) >= MIN_SPAN_BYTES) and not value.startswith(PLACEHOLDER) and not self.allowed(value):
                    out.append((*m.span(group), pattern.name))
        return out

    def _tokens(self, text: str) -> list[tuple[int, int]]:
        e = self.settings.entropy
        if not e.enabled:
            return []
        return [
            m.span()
            for m in _TOKEN.finditer(text)
            if len(m[0]) >= e.min_len and not _EXCLUDED.match(m[0]) and not (self.user_excluded and self.user_excluded.match(m[0])) and entropy(m[0]) >= e.threshold
        ]

    def block_spans(self, text: str) -> list[tuple[int, int]]:
        hits = []
        for entry in self.settings.block_strings:
            at = text.find(entry)
            while at >= 0:
                hits.append((at, at + len(entry)))
                at = text.find(entry, at + len(entry))
        out: list[list[int]] = []
        for a, b in sorted(hits, key=lambda s: (s[0], -s[1])):
            if out and a < out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def scrub_text(self, text: str) -> tuple[str, list[Redaction]]:
        """The rewritten text, and what was replaced."""
        if len(text) < self.least and text.isascii():
            return text, []
        spans = self._regex_spans(text)
        if self.settings.entropy.enabled:
            more = [(a, b, "high-entropy") for a, b in _outside(self._tokens(text), spans) if not self.allowed(text[a:b])]
            spans += more
        if self.settings.block_strings:
            more = [(a, b, "blacklist") for a, b in _outside(self.block_spans(text), spans) if not self.allowed(text[a:b]) and not text.startswith(PLACEHOLDER, a)]
            spans += more
        if not spans:
            return text, []
        if len(spans) == 1:
            a, b, name = spans[0]
            return f"{text[:a]}{PLACEHOLDER}{name}]{text[b:]}", [(name, a, b, text[a:b])]
        islands: list[list] = []
        for a, b, name in sorted(spans, key=lambda s: (s[0], -s[1])):
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b, name])
        out, at = [], 0
        for a, b, name in islands:
            out += [text[at:a], f"{PLACEHOLDER}{name}]"]
            at = b
        return "".join(out) + text[at:], [(name, a, b, text[a:b]) for a, b, name in islands]

    def scrub_tree(self, value: Any, force: bool = False) -> tuple[Any, list[Redaction]]:
        """A JSON value with all its strings scrubbed. Keys stay. Arrays pass the force on, objects set it anew."""
        if isinstance(value, str):
            if len(value) < self.least and value.isascii():
                return value, []
            if force and len(value.encode()) >= MIN_FORCED_BYTES:
                return (value, []) if self.allowed(value) else (f"{PLACEHOLDER}sensitive-field]", [("sensitive-field", 0, len(value), value)])
            if self.settings.block_hashes and self.hash_blocked(value) and not self.allowed(value):
                return f"{PLACEHOLDER}blacklist]", [("blacklist", 0, len(value), value)]
            return self.scrub_text(value)
        found: list[Redaction] = []
        if isinstance(value, list):
            out: Any = []
            for item in value:
                new, more = self.scrub_tree(item, force)
                out.append(new)
                found += more
            return out, found
        if isinstance(value, dict):
            out = {}
            for key in sorted(value):
                out[key], more = self.scrub_tree(value[key], sensitive_key(key))
                found += more
            return out, found
        return value, found

    def scrub_message(self, value: Any) -> tuple[Any, list[Redaction]]:
        """A message scrubbed where its ``type`` says that people's or tools' content is."""
        kind = value.get("type") if isinstance(value, dict) else None
        if kind in ("system", "file-history-snapshot"):
            return value, []
        if kind in ("progress", "queue-operation"):
            return self._at(value, ("data" if kind == "progress" else "content",), self.scrub_tree)
        if kind == "user":
            value, found = self._at(value, ("message", "content"), self._user_content)
            value, more = self._at(value, ("toolUseResult",), self.scrub_tree)
            return value, found + more
        if kind == "assistant":
            return self._at(value, ("message", "content"), self._blocks)
        return self.scrub_tree(value)

    @staticmethod
    def _at(value: Any, path: tuple[str, ...], rule) -> tuple[Any, list[Redaction]]:
        """Apply a rule at a path; a missing step changes nothing."""
        if not isinstance(value, dict) or path[0] not in value:
            return value, []
        if len(path) > 1:
            new, found = Scrubber._at(value[path[0]], path[1:], rule)
        else:
            new, found = rule(value[path[0]])
        return {**value, path[0]: new}, found

    def _user_content(self, content: Any) -> tuple[Any, list[Redaction]]:
        if isinstance(content, str):
            return self.scrub_text(content)
        if not isinstance(content, list):
            return self.scrub_tree(content)
        return self._each(content, self.scrub_tree)

    def _blocks(self, content: Any) -> tuple[Any, list[Redaction]]:
        return self._each(content, self._block) if isinstance(content, list) else (content, [])

    def _block(self, block: Any) -> tuple[Any, list[Redaction]]:
        found: list[Redaction] = []
        text = lambda v: self.scrub_text(v) if isinstance(v, str) else (v, [])
        for key, rule in (("text", text), ("thinking", text), ("input", self.scrub_tree), ("content", self.scrub_tree)):
            block, more = self._at(block, (key,), rule)
            found += more
        return block, found

    @staticmethod
    def _each(items: list, rule) -> tuple[list, list[Redaction]]:
        """Apply a rule to all items but images."""
        out, found = [], []
        for item in items:
            if not (isinstance(item, dict) and item.get("type") == "image"):
                item, more = rule(item)
                found += more
            out.append(item)
        return out, found

    def scrub_line(self, line: str) -> tuple[str, list[Redaction], str]:
        """A line's new text, its different redactions, and what became of it.

        blank, skipped, malformed and clean lines stay as they are.
        """
        if not line.startswith(("{", "[")) and _BLANK.match(line):
            return line, [], "blank"
        if not self.settings.strict_router and skippable(line) and not self.blocked(line):
            return line, [], "skipped"
        try:
            value = parse_json(line)
        except ValueError:
            return line, [], "malformed"
        new, found = self.scrub_message(value)
        if not found:
            return line, [], "clean"
        if len(found) > 1:
            different = {(r[0], r[3]): r for r in reversed(found)}
            found = [different[k] for k in sorted(different)]
        return write_json(new), found, "redacted"


def _holds(text: str, parts: tuple[str, ...]) -> bool:
    """Whether any of the parts is in the text."""
    for part in parts:  # faster than a generator, for the few parts of each
        if part in text:
            return True
    return False


def _outside(candidates: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidates that lie inside no span: none that starts as early reaches as far."""
    if not spans or not candidates:
        return candidates
    spans = sorted(spans)
    starts, reach = [s[0] for s in spans], list(accumulate((s[1] for s in spans), max))
    at = [bisect_right(starts, a) for a, _ in candidates]
    return [c for c, k in zip(candidates, at, strict=True) if not k or reach[k - 1] < c[1]]


@lru_cache(4096)
def sensitive_key(key: str) -> bool:
    lowered = key.lower()
    return lowered in _SENSITIVE or lowered.endswith(_SENSITIVE_ENDS)


def skippable(line: str) -> bool:
    """Whether the first bytes name a message type without content."""
    if not _holds(line, SKIPPED_PREFIXES):
        return False
    head = line[:PREFIX_BYTES].encode("utf-8", "surrogatepass")[:PREFIX_BYTES]
    return any(p in head for p in _SKIPPED)


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


def _finite(number: str) -> float:
    value = float(number)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


# Made once: the module's functions make new ones for every call with options, and so does an encoder of the one behind it.
_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_float=_finite)
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)
_MAKE = json.encoder.c_make_encoder
_CHUNKS = _MAKE and _MAKE(None, _ENCODER.default, json.encoder.encode_basestring, None, ":", ",", True, False, True)


def _depth(value: Any) -> int:
    deepest, todo = 0, [(value, 1)]
    while todo:
        v, d = todo.pop()
        if isinstance(v, (dict, list)):
            deepest = max(deepest, d)
            todo += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def parse_json(line: str) -> Any:
    """A JSON value, by strict rules: no NaN, no lone surrogates, bounded depth and numbers."""
    try:
        try:
            value, end = _DECODER.scan_once(line, 0)
        except StopIteration:
            end = -1
        if end != len(line):  # white space around it, or no value
            value = _DECODER.decode(line)
    except RecursionError as error:
        raise ValueError("nested too deep") from error
    if "\\u" in line and _LONE.search(json.dumps(value, ensure_ascii=False)):
        raise ValueError("lone surrogate")
    if line.count("[") + line.count("{") > MAX_JSON_DEPTH and _depth(value) > MAX_JSON_DEPTH:
        raise ValueError("nested too deep")
    return value


def write_json(value: Any) -> str:
    """Compact JSON with sorted keys and raw non-ASCII characters."""
    return "".join(_CHUNKS(value, 0)) if _CHUNKS else _ENCODER.encode(value)
