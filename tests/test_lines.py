"""Lines of JSON: routing, files, incremental runs, reports."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sievelight.config import Entropy, Settings, sha256_hex
from sievelight.functions import udf
from sievelight.functions.kernel import Scrubber, parse_json, skippable
from sievelight.operators import findings as ops
from sievelight.plans import scan as plans
from sievelight.plans.state import MANIFEST, OFFSETS, SESSION_RUNS, StateTable, pending, refreshed, to_scan
from sievelight.sources import lines as src

KEY = "ghp_" + "a1B2" * 9
OFF = Settings(entropy=Entropy(enabled=False))
RED = "[REDACTED:github-token]"


def line(**fields):
    return json.dumps(fields, separators=(",", ":"))


def user(content, **more):
    return line(type="user", message={"content": content}, **more)


CASES = {
    "system": (line(type="system", content=KEY), 0, "skipped"),
    "system with a space": ('{"type": "system", "content": "' + KEY + '"}', 0, "clean"),
    "snapshot": (line(type="file-history-snapshot", x=KEY), 0, "skipped"),
    "user text": (user("x " + KEY), 1, "redacted"),
    "user blocks": (user([{"type": "text", "text": KEY}, KEY]), 1, "redacted"),
    "user image": (user([{"type": "image", "source": {"data": KEY}}]), 0, "clean"),
    "nested image": (user([{"type": "tool_result", "content": [{"type": "image", "data": KEY}]}]), 1, "redacted"),
    "tool result": (user("a", toolUseResult={"stdout": KEY}), 1, "redacted"),
    "user other field": (user("a", cwd=KEY), 0, "clean"),
    "assistant": (line(type="assistant", message={"content": [{"text": KEY, "thinking": KEY, "input": {"a": [KEY]}, "content": KEY, "id": KEY}]}), 1, "redacted"),
    "assistant string": (line(type="assistant", message={"content": KEY}), 0, "clean"),
    "assistant string item": (line(type="assistant", message={"content": [KEY]}), 0, "clean"),
    "progress": (line(type="progress", data={"x": KEY}, other=KEY), 1, "redacted"),
    "queue": (line(type="queue-operation", content=KEY), 1, "redacted"),
    "unknown": (line(type="novel", deep=[[{"x": KEY}]]), 1, "redacted"),
    "no object": (json.dumps([KEY]), 1, "redacted"),
    "malformed": ('{"type":"user",' + KEY, 0, "malformed"),
    "nan": ('{"x": NaN, "y": "' + KEY + '"}', 0, "malformed"),
    "lone surrogate": ('{"x": "\\ud800", "y": "' + KEY + '"}', 0, "malformed"),
    "huge": ('{"x": 1e999, "y": "' + KEY + '"}', 0, "malformed"),
    "deep": ("[" * 200 + '"' + KEY + '"' + "]" * 200, 0, "malformed"),
    "blank": (" \t ", 0, "blank"),
    "sensitive": (line(type="novel", password="abcdefgh1"), 1, "redacted"),
    "sensitive short": (line(type="novel", password="abc"), 0, "clean"),
    "sensitive list": (line(type="novel", token=["abcdefgh1"]), 1, "redacted"),
    "sensitive object": (line(type="novel", credentials={"user": "abcdefgh1"}), 0, "clean"),
    "escaped": ('{"type":"novel","x":"' + KEY.replace("g", "\\u0067") + '"}', 1, "redacted"),
    "duplicate keys": ('{"x":"a","x":"' + KEY + '"}', 1, "redacted"),
}


@pytest.mark.parametrize("name", CASES)
def test_routing(name):
    text, n, status = CASES[name]
    new, found, got = Scrubber(OFF).scrub_line(text)
    assert (len(found), got) == (n, status)
    assert (new == text) == (status != "redacted")


def test_spark_agrees_with_the_kernel(spark):
    rows = [(k, t) for k, (t, _, _) in CASES.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "file string, line string")
    for settings in (OFF, Settings(), Settings(block_strings=("type",)), Settings(block_hashes=frozenset([sha256_hex(KEY)])), Settings(strict_router=True)):
        twin = Scrubber(settings)
        for r in ops.scrub_lines(df, settings).collect():
            if r["line"] is None:
                assert r["status"] == "blank" and r["redactions"] == []
                continue
            new, found, status = twin.scrub_line(r["line"])
            assert (r["new_line"], [tuple(x) for x in r["redactions"]], r["status"]) == (new, found, status), r["file"]


def test_reported_once_but_rewritten_everywhere():
    new, found, _ = Scrubber(OFF).scrub_line(line(type="novel", a=KEY, b="x " + KEY))
    assert len(found) == 1 and new.count(RED) == 2


def test_block_hashes_reach_whole_leaves_only():
    s = Settings(entropy=Entropy(enabled=False), block_hashes=frozenset([sha256_hex("my whole value")]))
    assert Scrubber(s).scrub_line(line(type="novel", a="my whole value"))[1][0][0] == "blacklist"
    assert Scrubber(s).scrub_line(line(type="novel", a="my whole value!"))[1] == []
    assert Scrubber(s).scrub_line(user("my whole value"))[1] == []


def test_sensitive_field_is_counted_again_but_stays():
    once = Scrubber(OFF).scrub_line(line(type="novel", password="abcdefgh1"))[0]
    twice, found, _ = Scrubber(OFF).scrub_line(once)
    assert twice == once and len(found) == 1


def test_allowed_sensitive_value_is_left_alone():
    s = Settings(allow_hashes=frozenset([sha256_hex("x" + KEY)]))
    assert Scrubber(s).scrub_line(line(type="novel", password="x" + KEY))[2] == "clean"


def test_prefix_is_cut_between_characters():
    assert not skippable("é" * 40 + '"type":"system"')
    assert skippable('{"type":"system"')


def test_json_is_compact_and_sorted():
    new = Scrubber(OFF).scrub_line('{"b": 1.50, "a": ["é", "' + KEY + '"]}')[0]
    assert new == '{"a":["é","' + RED + '"],"b":1.5}'
    with pytest.raises(ValueError, match="JSON"):
        parse_json("[Infinity]")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "projects"
    (root / "p" / "s1" / "subagents").mkdir(parents=True)
    (root / "p" / "subagents").mkdir()
    (root / "p" / "s1.jsonl").write_text("\n".join([user("hello"), user(KEY), "", user("x " + KEY)]) + "\n")
    (root / "p" / "s1" / "subagents" / "a.jsonl").write_text(user(KEY) + "\r\n" + user("no") + "\r\n")
    (root / "p" / "subagents" / "b.jsonl").write_text(user("clean") + "\n")
    (root / "p" / "note.txt").write_text(KEY)
    return root


def test_line_numbers_and_ends(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"a\r\n\nb\xff\nlast")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "ended.jsonl").write_bytes(b"one\n")
    rows = [(r["file"].rsplit("/", 1)[1], r["line_number"], r["line"], r["is_valid"]) for r in src.read_lines(spark, str(tmp_path)).collect()]
    assert sorted(rows) == [("ended.jsonl", 1, "one", True), ("x.jsonl", 1, "a", True), ("x.jsonl", 2, "", True), ("x.jsonl", 3, "b�", False), ("x.jsonl", 4, "last", True)]


def test_session_files_and_guard(tree, tmp_path):
    names = [p[len(str(tree)) :] for p in src.session_files(tree / "p" / "s1.jsonl")]
    assert names == ["/p/s1.jsonl", "/p/s1/subagents/a.jsonl"]
    assert src.guarded(tree / "p" / "s1.jsonl", tree).name == "s1.jsonl"
    (tmp_path / "out.jsonl").write_text("x")
    with pytest.raises(PermissionError):
        src.guarded(tmp_path / "out.jsonl", tree)
    with pytest.raises(FileNotFoundError):
        src.guarded(tree / "gone.jsonl", tree)


def test_scan_previews_then_fixes_then_caches(spark, tree, tmp_path):
    state = str(tmp_path / "state")
    before = (tree / "p" / "s1.jsonl").read_bytes()
    seen = plans.scan(spark, str(tree), OFF, state)
    assert seen.summary["files_scanned"] == 3 and seen.summary["files_modified"] == 2 and seen.summary["total_redactions"] == 3
    assert seen.summary["dry_run"] and (tree / "p" / "s1.jsonl").read_bytes() == before
    assert {r["report"] for r in seen.report.where("line_number = 2").collect()} == {"L2: ghp_a1B2...a1B2 → " + RED}
    assert [tuple(r) for r in seen.by_pattern.collect()] == [("github-token", 3)]
    seen.close()
    done = plans.scan(spark, str(tree), OFF, state, fix=True)
    assert done.summary["total_redactions"] == 3
    done.close()
    text = (tree / "p" / "s1.jsonl").read_text()
    assert KEY not in text and text.count(RED) == 2 and text.splitlines()[0] == user("hello")
    assert (tree / "p" / "s1" / "subagents" / "a.jsonl").read_bytes().count(b"\r") == 0
    assert (tree / "p" / "note.txt").read_text() == KEY
    again = plans.scan(spark, str(tree), OFF, state, fix=True)
    assert again.summary["files_cached"] == 3 and again.summary["files_scanned"] == 0
    again.close()
    other = plans.scan(spark, str(tree), Settings(), state)
    assert other.summary["files_scanned"] == 3  # other settings void the manifest
    other.close()
    assert plans.scan(spark, str(tree), OFF, state, use_cache=False).summary["files_scanned"] == 3


def test_session_resumes_where_it_stopped(spark, tree, tmp_path):
    state, path = str(tmp_path / "state"), tree / "p" / "s1.jsonl"
    assert plans.scrub_session(spark, str(path), str(tree), OFF, state, active=True) is None
    first = {r["file"].rsplit("/", 1)[1]: r["redactions"] for r in plans.scrub_session(spark, str(path), str(tree), OFF, state).collect()}
    assert first == {"s1.jsonl": 2, "a.jsonl": 1}
    assert plans.scrub_session(spark, str(path), str(tree), OFF, state).count() == 0
    head = path.read_bytes()
    with path.open("a") as f:
        f.write(user("new " + KEY) + "\n" + user("fine") + "\n")
    rows = plans.scrub_session(spark, str(path), str(tree), OFF, state).collect()
    assert [(r["lines"], r["redactions"]) for r in rows] == [(2, 1)]
    assert path.read_bytes().startswith(head) and KEY not in path.read_text()
    path.write_text(user(KEY) + "\n")  # shorter than recorded: starts anew
    rows = plans.scrub_session(spark, str(path), str(tree), OFF, state).collect()
    assert [(r["lines"], r["redactions"]) for r in rows] == [(1, 1)]
    runs = StateTable(spark, state, "session_runs", SESSION_RUNS).read()
    assert runs.count() == 4
    report = {(r["section"], r["key"]): r["value"] for r in plans.status(spark, str(tree), OFF, state).collect()}
    assert report["Detection", "built-in patterns"] == "21" and report["Stats", "runs"] == "4"
    assert report["Coverage", "3"].endswith(" B")
    assert report["Stats", "last time"] and report["Recent redactions", "…"] == "and 1 more of 4"


def test_resumed_lines_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b"a\nb\nc\r\nd\xff\nlast")
    rows = [(f"file:{path}", path.stat().st_size, 4, before) for before in (None, 2, 7)]
    df = spark.createDataFrame(rows, "file string, size bigint, skip bigint, lines_before bigint")
    got = [(r["line_number"], r["line"], r["is_valid"], r["raw"], r["ended"]) for r in src.read_tails(df).collect()]
    one = [("c", True, None, True), ("d\ufffd", False, b"d\xff", True), ("last", True, None, False)]
    assert sorted(got, key=str) == sorted([(n + k, *x) for n in (3, 3, 8) for k, x in enumerate(one)], key=str)


def test_files_read_in_splits_equal_whole_ones(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_bytes(b"".join(f"line {i} of {k}".encode() + (b"\xff" if i % 50 == 0 else b"") + (b"\r\n" if i % 3 else b"\n") for i in range(2000)) + b"end")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        order = ["file", "line_number"]
        name = F.regexp_extract("file", r"([^/]+)$", 1).alias("file")
        a, b = (src.read_lines(spark, str(tmp_path), whole=w).select(name, "line_number", "line", "is_valid", "raw").orderBy(*order).collect() for w in (0, 1 << 20))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert a == b and len(a) == 6003


def test_numbers_out_of_range_without_an_exponent():
    with pytest.raises(ValueError):
        parse_json('{"x": 1' + "0" * 400 + '.0, "y": 1}')
    assert parse_json('{"x": 1' + "0" * 400 + ', "y": 1.5e3}') == {"x": 10**400, "y": 1500.0}


def test_lines_become_an_array_as_their_rows_say():
    rows = [("a", [("p", 0, 1, "x"), ("q", 1, 3, "é")], "redacted"), None, ("b", [], "clean"), ("c", [("p", 2, 4, "y")], "redacted")]
    found = lambda r: [{"pattern_name": n, "start": a, "end": b, "matched_text": t} for n, a, b, t in r]
    for part in (rows, rows[1:], [None], []):
        assert udf._line_array(part).to_pylist() == [r and {"new_line": r[0], "redactions": found(r[1]), "status": r[2]} for r in part]


def test_a_file_is_split_in_linear_time(spark, tmp_path):
    """Lines of either decoding come out whole, and the content doesn't go along with every line."""
    (tmp_path / "a.jsonl").write_bytes(b"ub\r\n\n\xc3\xa9u\nb")
    (tmp_path / "b.jsonl").write_bytes(b"bu\r\n\n\xffu\n\n")
    rows = src.read_lines(spark, str(tmp_path))
    got = [(r["line_number"], r["line"], r["is_valid"], r["raw"]) for r in rows.orderBy("file", "line_number").collect()]
    assert got == [(1, "ub", True, None), (2, "", True, None), (3, "éu", True, None), (4, "b", True, None), (1, "bu", True, None), (2, "", True, None), (3, "\ufffdu", False, b"\xffu"), (4, "", True, None)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    kept = re.findall(r"\[([^\[\]]*)\], false, \[_at#", plan)  # what goes along with every line
    assert kept and not any("content" in x for x in kept)


def test_lines_of_split_files_are_not_shuffled(spark, tmp_path):
    """However large Spark takes the counts of splits for, they go to the lines."""
    (tmp_path / "x.jsonl").write_text("a\nb\n")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = src.read_lines(spark, str(tmp_path), whole=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_of_a_file_are_written_together(tmp_path, monkeypatch):
    """One write for a file's lines of a batch, also of a file that goes on in the next batch; the head of a resumed one stays."""
    import os

    import pyarrow as pa

    from sievelight.sources import sinks

    opened, writes = os.fdopen, []

    class Counted:
        def __init__(self, *args):
            self.file = opened(*args)

        def write(self, data):
            writes.append(data)
            return self.file.write(data)

        def close(self):
            self.file.close()

    monkeypatch.setattr(os, "fdopen", Counted)
    names = [str(tmp_path / n) for n in "abc"]
    (tmp_path / "b").write_bytes(b"head\nold")
    rows = [[(names[0], 0, b"1"), (names[0], 0, b""), (names[1], 5, b"2\xff"), (names[1], 5, b"3")], [(names[1], 5, b"4"), (names[2], 0, b"5")]]
    kinds = {"file": pa.string(), "skip": pa.int64(), "_bytes": pa.binary()}
    batches = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*r, strict=True), kinds.values(), strict=True)], names=list(kinds)) for r in rows]
    done = [r for b in sinks._replace(iter(batches)) for r in b.to_pylist()]
    assert [(tmp_path / n).read_bytes() for n in "abc"] == [b"1\n\n", b"head\n2\xff\n3\n4\n", b"5\n"]
    assert [(r["file"], r["size"]) for r in done] == list(zip(names, (3, 12, 2), strict=True))
    assert writes.count(b"head\n") == 1 and len(writes) == 5  # the head, and a piece of each file and batch


def test_files_are_dealt_over_more_tasks_than_cores(spark):
    from sievelight.sources import sinks

    rows = spark.createDataFrame([("a", 1, 0, b"x")], "file string, line_number bigint, skip bigint, _bytes binary")
    assert sinks._dealt(rows).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_short_texts_are_not_searched(monkeypatch):
    """Texts too short for any rule pass at once, unless something shorter is blocked."""
    asked, search = [], Scrubber._regex_spans
    monkeypatch.setattr(Scrubber, "_regex_spans", lambda self, text: asked.append(text) or search(self, text))
    value = {"type": "novel", "a": ["text", "é" * 4, "8 letter", ""], "password": "abcdefg"}
    assert Scrubber(OFF).scrub_message(value)[1] == [] and asked == ["é" * 4, "8 letter"]
    assert len(Scrubber(Settings(block_strings=("tex",))).scrub_message(value)[1]) == 1
    assert len(Scrubber(Settings(block_hashes=frozenset([sha256_hex("text")]))).scrub_message(value)[1]) == 1


def test_numbers_out_of_range_behind_a_key_that_comes_again():
    assert Scrubber(OFF).scrub_line('{"x":1e999,"x":"' + KEY + '"}')[2] == "malformed"
    assert parse_json(' {"x": 1.5} ') == {"x": 1.5} and parse_json("[-0.0,1E5]") == [-0.0, 1e5]


def test_no_garbage_is_collected_within_a_batch(monkeypatch):
    import gc

    import pyarrow as pa

    seen = []
    monkeypatch.setattr(udf, "safe", lambda scrubber, line: seen.append(gc.isenabled()) or (line, [], "clean"))
    assert len(udf._scrubbed(Scrubber(OFF), pa.array(["a", None]))) == 2
    assert seen == [False] and gc.isenabled()


def test_odd_names_of_files(spark, tmp_path):
    """Blanks, signs of patterns and what looks encoded: one name in both readers, and written to."""
    names = ["a b.jsonl", "c%41+d.jsonl", "e[1]{2}.jsonl", "é#f.jsonl"]
    root = tmp_path / "odd tree"
    root.mkdir()
    for name in names:
        (root / name).write_text(user(KEY) + "\n")
    whole, split = (sorted(r["file"] for r in src.read_lines(spark, str(root), whole=w).collect()) for w in (1 << 20, 0))
    assert whole == split and sorted(src.local_path(f) for f in whole) == sorted(str(root / n) for n in names)
    state = str(tmp_path / "state")
    plans.scan(spark, str(root), OFF, state, fix=True).close()
    assert all(KEY not in (root / name).read_text() for name in names)
    (root / names[2]).write_text(user(KEY) + "\n" + user(KEY) + "\n")
    again = plans.scan(spark, str(root), OFF, state, fix=True)
    assert (again.summary["files_scanned"], again.summary["total_redactions"]) == (1, 2) and KEY not in (root / names[2]).read_text()
    again.close()


def test_bytes_of_other_lines_never_change(spark, tmp_path):
    path = tmp_path / "tree" / "x.jsonl"
    path.parent.mkdir()
    other = b'{"x":"\xe9"}'
    path.write_bytes(other + b"\n" + user(KEY).encode() + b"\n\xef\xbb\xbf  \n" + other)
    done = plans.scan(spark, str(path.parent), OFF, fix=True)
    assert done.summary["errors"] == 1 and done.summary["total_redactions"] == 1
    done.close()
    assert path.read_bytes() == other + b"\n" + Scrubber(OFF).scrub_line(user(KEY))[0].encode() + b"\n\xef\xbb\xbf  \n" + other + b"\n"


def test_lines_are_scrubbed_in_one_scan(spark, tmp_path):
    spark.createDataFrame([("f", user(KEY))], "file string, line string").write.parquet(str(tmp_path / "t"))
    plan = ops.scrub_lines(spark.read.parquet(str(tmp_path / "t")), OFF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1


def test_events_never_fail_their_sender(spark, tree, tmp_path):
    state, root, path = str(tmp_path / "state"), str(tree), str(tree / "p" / "s1.jsonl")
    run = lambda event: plans.on_event(spark, event if isinstance(event, str) else json.dumps(event), root, OFF, state)
    assert run({"transcript_path": path, "stop_hook_active": True}) is None
    assert run({"transcript_path": str(tree / "gone.jsonl")}) is None
    (tmp_path / "outside.jsonl").write_text(user(KEY))
    for event in ("no json", "[]", {}, {"transcript_path": None}, {"transcript_path": str(tmp_path / "outside.jsonl")}):
        with pytest.warns(UserWarning, match="not handled"):
            assert run(event) is None
    assert KEY in (tmp_path / "outside.jsonl").read_text()
    assert sum(r["redactions"] for r in run({"transcript_path": path}).collect()) == 3


def test_manifest_operators(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 2)], "path string, mtime_us bigint, size bigint")
    manifest = spark.createDataFrame([("a", 1, 1, "f"), ("c", 1, 1, "f"), ("gone", 1, 1, "f"), ("b", 1, 1, "old")], MANIFEST)
    todo = to_scan(files, manifest, "f")
    assert sorted(r[0] for r in todo.collect()) == ["b", "c"]
    assert sorted(tuple(r) for r in refreshed(manifest, todo, files, "f").collect()) == [("a", 1, 1, "f"), ("b", 1, 1, "f"), ("c", 1, 2, "f")]
    assert to_scan(files, manifest, "new").count() == 3


def test_offsets(spark):
    files = spark.createDataFrame([("same", 5), ("more", 9), ("less", 3), ("new", 4)], "file string, size bigint")
    offsets = spark.createDataFrame([("same", 5, "f", 1), ("more", 5, "f", 2), ("less", 5, "f", 1)], OFFSETS)
    assert sorted((r["file"], r["skip"], r["lines_before"]) for r in pending(files, offsets, "f").collect()) == [("less", 0, None), ("more", 5, 2), ("new", 0, None)]


def test_state_table_keeps_snapshots(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), "t", "timestamp_epoch bigint, v bigint")
    assert t.read().count() == 0
    for k in range(4):
        t.append(spark.createDataFrame([(k, k)], "timestamp_epoch bigint, v bigint"), newest=3)
    assert sorted(r[0] for r in t.read().collect()) == [1, 2, 3]
    assert t.versions() == [2, 3]


def test_stream_equals_batch(spark, tree, tmp_path):
    from sievelight.streaming.tail import stream_scan

    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")
    stream_scan(spark, str(tree), sink, mark, OFF).awaitTermination(120)
    read = lambda: sorted((r["line"], r["new_line"], r["status"]) for r in spark.read.parquet(sink).collect())
    batch = sorted((r["line"], r["new_line"], r["status"]) for r in ops.scrub_lines(src.read_lines(spark, str(tree)), OFF).collect())
    assert read() == batch
    (tree / "p" / "later.jsonl").write_text(user("later " + KEY) + "\n")
    stream_scan(spark, str(tree), sink, mark, OFF).awaitTermination(120)
    assert len(read()) == len(batch) + 1  # only the new file


def test_new_lines_by_state(spark, tmp_path):
    from sievelight.streaming.tail import new_lines

    schema = "file string, line_number bigint, line string"
    source = tmp_path / "in"
    spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("g", 1, "x")], schema).coalesce(1).write.json(str(source))

    def run():
        stream = new_lines(spark.readStream.schema(schema).json(str(source)))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("f", 1), ("f", 2), ("g", 1)]
    spark.createDataFrame([("f", 2, "b"), ("f", 3, "c")], schema).coalesce(1).write.mode("append").json(str(source))
    assert run() == [("f", 1), ("f", 2), ("f", 3), ("g", 1)]


def test_folder_sink(spark, tree, tmp_path):
    from sievelight.sources.sinks import write_folder

    done = ops.scrub_lines(src.read_lines(spark, str(tree)), OFF)
    write_folder(done, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where(F.col("value").contains(KEY)).count() == 0
    assert spark.read.text(str(tmp_path / "out")).count() == 7


def test_folder_sink_keeps_files_apart(spark, tmp_path):
    from sievelight.sources.sinks import write_folder

    rows = [("/x/a/b.jsonl", 1, "one", "clean"), ("/x/a_b.jsonl", 1, "two", "clean"), ("/x/a%2Fb.jsonl", 1, "three", "clean")]
    write_folder(spark.createDataFrame(rows, "file string, line_number bigint, new_line string, status string"), str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out")).select(F.url_decode("source"), "value").collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], r[2]) for r in rows)


def test_damaged_state_counts_as_missing(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), "t", "timestamp_epoch bigint")
    t.append(spark.createDataFrame([(1,)], "timestamp_epoch bigint"))
    t.append(spark.createDataFrame([(2,)], "timestamp_epoch bigint"))
    newest = tmp_path / "t" / f"v{t.versions()[-1]}"
    for file in newest.glob("*.parquet"):
        file.write_bytes(b"broken")
    for file in newest.glob(".*.crc"):
        file.unlink()
    with pytest.warns(UserWarning, match="can't be read"):
        assert [r[0] for r in t.read().collect()] == [1]