"""Detection as native expressions, and the scrubber behind a native gate.

Expressions are composed as SQL text and parsed in one step, since building
large trees call by call costs seconds before any row is read. Texts are named
by SQL: a column's name, or any expression.

Spark has no function that returns the positions of all matches, but the gaps
from ``split`` and the matches from ``regexp_extract_all`` come in the same
order, so running sums of their lengths give every start. The sums run in
chunks and then over the chunks, so a text costs time in proportion to its
matches. Offsets count code points; thresholds count bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.config import Settings
from sievelight.functions.patterns import EXCLUDED_TOKEN, KNOWN_EXAMPLES, MIN_FORCED_BYTES, MIN_SPAN_BYTES, PLACEHOLDER, SENSITIVE_KEYS, TOKEN, Pattern, portable, with_prefix_group

#: A span: ``rank`` keeps the order of detectors.
SPAN = "struct<start:int,stop:int,rank:int,name:string,value:string>"
REDACTIONS = "array<struct<pattern_name:string,start:int,end:int,matched_text:string>>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
NO_REDACTIONS = f"cast(array() as {REDACTIONS})"
#: Matches that one running sum goes over before the sums of chunks are added up.
CHUNK = 256


def quoted(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def _named(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` under a name, so that it is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def keyword_sql(lowered: str, pattern: Pattern) -> str:
    """Whether a pattern's keywords let it run; without keywords it always does."""
    return _any([f"contains({lowered}, {quoted(k)})" for k in pattern.keywords]) if pattern.keywords else "true"


def keyword_hit(lowered: str, pattern: Pattern) -> Column:
    return F.expr(keyword_sql(lowered, pattern))


def _lowered_hit(text: str, settings: Settings) -> str:
    hits = [keyword_sql("_low", p) for p in settings.all_patterns]
    return "true" if "true" in hits else f"exists(array(lower({text})), _low -> {_any(hits)})"


def any_keyword_hit(text: str, settings: Settings) -> Column:
    return F.expr(_lowered_hit(text, settings))


def _sums(lengths: str) -> str:
    """For each of an array of integers the sum of those before it."""
    none = "named_struct('sum', 0, 'each', cast(array() as array<int>))"
    fold = lambda items, value: f"aggregate({items}, {none}, (_a, _x) -> named_struct('sum', _a.sum + {value}, 'each', concat(_a.each, array(_a.sum))))"
    chunks = f"transform(sequence(0, greatest(size(_n) - 1, 0) div {CHUNK}), _c -> {fold(f'slice(_n, _c * {CHUNK} + 1, {CHUNK})', '_x')})"
    total = f"flatten(zip_with(_s, {fold('_s', '_x.sum')}.each, (_p, _b) -> transform(_p.each, _v -> _v + _b)))"
    return _named(lengths, "_n", _named(chunks, "_s", total))


def _spans(text: str, regex: str, parts: str, keep: str, name: str, rank: int) -> str:
    """Spans of the parts of all matches that ``keep`` allows.

    ``parts`` makes a struct of full match ``f``, what leads to the value ``l``
    and the value ``v`` from the array ``_m`` of matches; ``keep`` tests ``_q``.
    """
    starts = _sums("zip_with(_g, _m, (_x, _y) -> length(_x) + length(_y))")
    placed = f"zip_with({parts}, zip_with(_g, {starts}, (_x, _y) -> _y + length(_x)), (_x, _y) -> named_struct('f', _x.f, 'v', _x.v, 'at', _y + length(_x.l)))"
    out = f"named_struct('start', _q.at, 'stop', _q.at + length(_q.v), 'rank', {rank}, 'name', {quoted(name)}, 'value', _q.v)"
    found = f"transform(filter({placed}, _q -> {keep}), _q -> {out})"
    placed = _named(f"slice(split({text}, {quoted(regex)}, -1), 1, size(_m))", "_g", found)
    return f"coalesce({_named(f'regexp_extract_all({text}, {quoted(regex)}, 0)', '_m', f'CASE WHEN size(_m) > 0 THEN {placed} ELSE {NO_SPANS} END')}, {NO_SPANS})"


_CLASS, _ANCHOR = re.compile(r"\[\^?[^\]]*\]"), re.compile(r"\\[bBAzZG]|[\^$]")
_WHOLE = "transform(_m, _x -> named_struct('f', _x, 'l', '', 'v', _x))"


def _with_group(text: str, pattern: Pattern, regex: str) -> str:
    """Parts of matches whose secret is a group. One that took no part is reported as empty: then the whole match counts."""
    found = with_prefix_group(regex, pattern.group)
    if found is None:
        raise ValueError(f"pattern {pattern.name!r}: its group has no native form")
    wide, group = quoted(found[0]), found[1]
    if _ANCHOR.search(_CLASS.sub("", regex)):  # what stands around a match counts
        both = f"zip_with(regexp_extract_all({text}, {wide}, 1), regexp_extract_all({text}, {wide}, {group}), (_x, _y) -> named_struct('l', _x, 'v', _y))"
        pairs = f"zip_with(_m, {both}, (_x, _y) -> named_struct('f', _x, 'l', _y.l, 'v', _y.v))"
    else:
        pairs = f"transform(_m, _x -> named_struct('f', _x, 'l', regexp_extract(_x, {wide}, 1), 'v', regexp_extract(_x, {wide}, {group})))"
    return f"transform({pairs}, _x -> CASE WHEN _x.v = '' THEN named_struct('f', _x.f, 'l', '', 'v', _x.f) ELSE _x END)"


def allowed_sql(value: str, settings: Settings) -> str:
    """Whether a value's hash is on the allow list; an empty list is never hashed for."""
    return f"sha2({value}, 256) IN ({', '.join(quoted(h) for h in sorted(settings.allow_hashes))})" if settings.allow_hashes else "false"


def _pattern_sql(text: str, pattern: Pattern, rank: int, settings: Settings, lowered: str) -> str:
    regex = portable(pattern.regex)
    parts = _WHOLE if pattern.group is None else _with_group(text, pattern, regex)
    keep = [f"octet_length(_q.v) >= {MIN_SPAN_BYTES}", f"NOT startswith(_q.v, {quoted(PLACEHOLDER)})"]
    keep += [f"NOT contains(_q.f, {quoted(x)})" for x in KNOWN_EXAMPLES]
    keep += [f"NOT {allowed_sql('_q.v', settings)}"] if settings.allow_hashes else []
    return f"CASE WHEN {keyword_sql(lowered, pattern)} THEN {_spans(text, regex, parts, ' AND '.join(keep), pattern.name, rank)} ELSE {NO_SPANS} END"


def pattern_spans(text: str, settings: Settings) -> Column:
    """Spans of all patterns after the example, length, placeholder and allow filters."""
    if not settings.all_patterns:
        return F.expr(NO_SPANS)
    each = [_pattern_sql(text, p, k, settings, "_low") for k, p in enumerate(settings.all_patterns)]
    return F.expr(_named(f"lower({text})", "_low", f"concat({', '.join(each)})"))


def entropy_sql(token: str) -> str:
    """Bits a byte of an ASCII token; 0 for an empty one."""
    counts = f"transform(array_distinct(split({token}, '')), _c -> length({token}) - length(replace({token}, _c, '')))"
    total = f"aggregate({counts}, 0D, (_a, _k) -> _a - _k / length({token}) * log2(_k / length({token})))"
    return f"CASE WHEN length({token}) > 0 THEN {total} ELSE 0D END"


def shannon_entropy(token: str) -> Column:
    return F.expr(entropy_sql(token))


def excluded_sql(token: str, settings: Settings) -> str:
    """Paths, links, addresses, placeholders and UUIDs, and what the user excludes."""
    rules = [portable(f"^(?:{'|'.join(EXCLUDED_TOKEN)})$")]
    valid = [p for p in settings.entropy.exclude if _compiles(p)]
    if valid:
        rules.append(portable(f"^(?:{'|'.join(valid)})$"))
    return _any([f"rlike({token}, {quoted(r)})" for r in rules])


def excluded_token(token: str, settings: Settings) -> Column:
    return F.expr(excluded_sql(token, settings))


def _compiles(regex: str) -> bool:
    try:
        re.compile(portable(regex))
    except re.error:
        return False
    return True


def token_spans(text: str, rank: int = 0) -> Column:
    """Every long token with its place."""
    return F.expr(_spans(text, TOKEN, _WHOLE, "true", "high-entropy", rank))


def entropy_tokens(text: str, settings: Settings, rank: int) -> Column:
    """Spans of tokens whose entropy reaches the threshold."""
    e = settings.entropy
    if not e.enabled:
        return F.expr(NO_SPANS)
    distinct = max(1, int(2**e.threshold - 1e-9))  # fewer different characters can't reach the threshold
    keep = [f"length(_q.v) >= {e.min_len}", f"size(array_distinct(split(_q.v, ''))) >= {distinct}", f"NOT {excluded_sql('_q.v', settings)}", f"{entropy_sql('_q.v')} >= {e.threshold!r}D"]
    return F.expr(_spans(text, TOKEN, _WHOLE, " AND ".join(keep), "high-entropy", rank))


def block_hits(text: str, settings: Settings, rank: int) -> Column:
    """Hits of blocked strings, each string's from left to right, before they are joined."""
    if not settings.block_strings:
        return F.expr(NO_SPANS)
    regexes = [r"\Q" + entry.replace(r"\E", r"\E\\E\Q") + r"\E" for entry in settings.block_strings]
    each = [f"CASE WHEN contains({text}, {quoted(s)}) THEN {_spans(text, r, _WHOLE, 'true', 'blacklist', rank + k)} ELSE {NO_SPANS} END" for k, (s, r) in enumerate(zip(settings.block_strings, regexes, strict=True))]
    return F.expr(f"concat({', '.join(each)})")


def blocked_sql(text: str, settings: Settings) -> str:
    """Whether a text holds a blocked string or is a blocked value."""
    hits = [f"contains({text}, {quoted(s)})" for s in settings.block_strings]
    if settings.block_hashes:
        hits.append(f"sha2({text}, 256) IN ({', '.join(quoted(h) for h in sorted(settings.block_hashes))})")
    return _any(hits)


def blocked(text: str, settings: Settings) -> Column:
    return F.expr(blocked_sql(text, settings))


def may_hit_sql(text: str, settings: Settings) -> str:
    """A cheap test that every text with a finding passes."""
    tests = [_lowered_hit(text, settings)]
    if settings.entropy.enabled:
        tests.append(f"rlike({text}, {quoted(TOKEN)})")
    tests += [f"contains({text}, {quoted(s)})" for s in settings.block_strings]
    return _any(tests)


def may_hit(text: str, settings: Settings) -> Column:
    return F.expr(may_hit_sql(text, settings))


def scrub(text: str, settings: Settings) -> Column:
    """``struct<text, redactions>`` of a text; null for null.

    Spans of many detectors have to be merged and the text rewritten at any
    length in one pass, which folds over arrays can't do. So texts that the
    native gate lets through, and only these, go to the Arrow kernel.
    """
    from sievelight.functions.udf import scrub_text

    asked = F.expr(f"CASE WHEN {may_hit_sql(text, settings)} THEN {text} END")
    untouched = F.expr(f"CASE WHEN {text} IS NOT NULL THEN named_struct('text', {text}, 'redactions', {NO_REDACTIONS}) END")
    return F.coalesce(scrub_text(settings)(asked), untouched)


def sensitive_key(key: Column) -> Column:
    """Whether a field's name is one of the sensitive ones, or ends with one after an underscore."""
    return F.lower(key).rlike(rf"(?:^|_)(?:{'|'.join(SENSITIVE_KEYS)})\z")


def forced(value: str, settings: Settings) -> Column:
    """Whether the value of a sensitive field is replaced whole."""
    return F.expr(f"octet_length({value}) >= {MIN_FORCED_BYTES} AND NOT {allowed_sql(value, settings)}")


def byte_offset(text: Column, offset: Column) -> Column:
    """UTF-8 bytes before a code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), offset)).cast("int")
