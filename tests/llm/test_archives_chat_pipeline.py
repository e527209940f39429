"""Archives, tool calls and the corpus pipeline."""
from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from ledgerlens.llm import tool_calls, warc
from ledgerlens.llm.queries import REGISTRY


def test_arc_versions_and_conversion():
    v1 = warc.ArcRecord("http://a/", "10.0.0.1", "19970203040506", "text/html", b"HTTP/1.0 200 OK\n\n<p>\n\n", 1)
    v2 = warc.ArcRecord("dns:a", "-", "1997", "text/dns", b"a 10.0.0.1", 2, {"code": "200"})
    data = warc.arc_bytes(v1) + warc.arc_bytes(v2)
    back = list(warc.read_arc(data))
    assert [(r.url, r.version, r.content) for r in back] == [(v1.url, 1, v1.content), (v2.url, 2, v2.content)]
    a, b = (warc.convert(r) for r in back)
    assert a.headers["WARC-Type"] == "response" and a.payload == b"<p>\n\n" and a.headers["WARC-Date"] == "1997-02-03T04:05:06Z"
    assert a.headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>\n\n").digest()).decode()
    assert b.headers["WARC-Type"] == "resource" and b.headers["WARC-Date"] == "1997-01-01T00:00:00Z"
    assert warc.convert(warc.ArcRecord("filedesc://x", "-", "1997", "text/plain", b"")).headers["WARC-Type"] == "warcinfo"
    assert a.headers["WARC-Record-ID"] == warc.convert(back[0]).headers["WARC-Record-ID"] != b.headers["WARC-Record-ID"]
    with pytest.raises(ValueError):
        warc.parse_arc_header(b"too few fields")


def expected_pages(rows):
    best = {}
    for i, t in rows:
        if i is not None:
            best[t or ""] = min(best.get(t or "", i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        first = best.get(t or "")
        again = i is not None and first < i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark):
    rows = [(1, "x\r\n\r\nWARC/1.1\r\nq\n"), (2, None), (3, ""), (4, "é\n\n"), (9, "é\n\n"), (4, "é\n\n"), (None, "é\n\n"),
            (5, "x\r\n\r\nWARC/1.1\r\nq\n"), (12, "\n"), (13, "\r\n\r\n"), (14, "z" * 300_000), (15, "\x00")]
    pages = spark.createDataFrame([(i, f"http://ü {i}\n" if i else None, t, "d", 7) for i, t in rows],
                                  "page_id long, url string, html string, payload string, size int")
    out = warc.round_trip(pages)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=repr) == expected_pages(rows)
    assert out.filter("not digest_ok").count() == 0
    small = warc.round_trip(pages, least_bytes=4)
    assert {r.page_id for r in small.filter("record_type = 'revisit'").collect()} == {5, 9}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    got = [tuple(r) for r in REGISTRY["op2_warc"][0](spark, SF_SMALL).collect()]
    assert sorted(got, key=repr) == expected_pages(rows)


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, wave int"


def test_linking_ordering_and_schemas(spark):
    ok = '{"query": "é", "limit": 3}'
    calls = spark.createDataFrame([
        (1, 1, "a", "search", ok, ["b", "nowhere"], "x"), (1, 2, "b", "search", '{"limit": 0}', None, "x"), (1, 3, "c", "lookup", "{", ["a"], "x"),
        (2, 1, "a", "search", ok, ["b"], "x"), (2, 2, "b", "search", ok, ["a"], "x"), (2, 3, "z", "search", ok, [], "x"),
        (3, 1, "a", "nothing", None, [], "x"), (3, 1, "a", "nothing", None, [], "x"), (None, 1, "a", "search", ok, [], "x"),
        (3, None, None, None, None, None, None)], CALLS)
    results = spark.createDataFrame([(1, 2, "a", "late", 1), (1, 1, "a", "early", 1), (9, 1, "q", None, 1), (None, 1, "a", "", 1)], RESULTS)
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "z"), (3, "a"), (9, "q")}
    assert [got[(1, c)].wave for c in "bac"] == [0, 1, 2]
    assert got[(1, "a")].status == "linked" and got[(1, "a")].n_results == 2
    assert got[(1, "a")].problems == ["uses nowhere: no such call"]
    assert got[(1, "b")].problems == ["$.limit: below 1", "$.query: missing"] and got[(1, "b")].status == "unanswered"
    assert got[(1, "c")].problems == ["$: not JSON"]
    assert [got[(2, c)].status for c in "abz"] == ["cycle", "cycle", "unanswered"]
    assert got[(3, "a")].problems == ["no such tool"] and got[(9, "q")].status == "orphan"
    assert got[(1, "a")].canonical == ('{"arguments":{"limit":3,"query":"é"},"conversation":1,"id":"a","name":"search",'
                                       '"result":"early","status":"linked","uses":["b","nowhere"]}')
    assert tool_calls.link(calls.limit(0), results.limit(0)).count() == 0


def test_every_conversation_is_ordered(spark):
    calls, results = tool_calls.calls_of(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    rows = calls.collect()
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results).collect()}
    for c in rows:
        for u in c.uses:
            used, mine = got.get((c.conv_id, u)), got[(c.conv_id, c.call_id)]
            if used is not None and used.status != "orphan" and mine.status != "cycle":
                assert (used.wave, used.turn, used.call_id) < (mine.wave, mine.turn, mine.call_id)
    answered = {(r.conv_id, r.call_id) for r in results.collect()}
    assert all((k in answered) == (r.status in ("linked", "orphan") or r.n_results > 0) for k, r in got.items())


def test_schema_subset():
    schema = {"type": "array", "items": {"type": "integer", "maximum": 3}}
    assert tool_calls.violations([1, 2.0, 4, "x", True], schema) == ["$[2]: above 3", "$[3]: not integer", "$[4]: not integer"]
    assert tool_calls.canonical({"b": 1, "a": [1.5, None, "é"]}) == '{"a":[1.5,null,"é"],"b":1}'


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, SF_SMALL)
        assert kept.columns == columns, name
    assert 0 < kept.count() <= docs.count() and kept.select("doc_id").distinct().count() == kept.count()
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 2048


def test_pipeline_takes_awkward_documents(spark):
    long = "this line is surely long enough to be compared with all the other lines"
    rows = [(1, long), (2, long), (2, long), (3, None), (4, ""), (None, None), (5, "a b c")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            frame = step(spark, frame, SF_SMALL)
        frame.collect()


@pytest.mark.parametrize("text, problem", [
    ("[" * 100_000 + "]" * 100_000, "$: nested too deeply"), ('{"a":' * 50_000 + "1" + "}" * 50_000, "$: nested too deeply"),
    ("1" * 5000, "$: number out of range"), ("1e999", "$: number out of range"), ('"\\ud800"', "$: unpaired surrogate"),
    ('{"\\udfff": 1}', "$: unpaired surrogate"), ("NaN", "$: not JSON"), ("", "$: not JSON"), ("{", "$: not JSON")])
def test_arguments_that_cannot_be_held(text, problem):
    assert tool_calls.parsed(text) == (None, [problem])


def test_arguments_with_one_text_for_equal_values():
    assert tool_calls.parsed(None) == (None, [])
    assert tool_calls.parsed('{"b": 2.0, "a": -0.0, "c": 1e3, "d": 0.5}') == ({"b": 2, "a": 0, "c": 1000, "d": 0.5}, [])
    assert tool_calls.canonical(tool_calls.parsed('{"b": 2.0, "a": 1}')[0]) == '{"a":1,"b":2}'
    assert tool_calls.parsed('{"x": {"a": 1, "a": 2}}') == ({"x": {"a": 2}}, ["$: repeated key"])
    assert tool_calls.violations(int("7" * 400), {"type": "integer", "minimum": 1}) == []


def test_awkward_arguments_do_not_end_the_job(spark):
    texts = ["[" * 5000 + "]" * 5000, "9" * 6000, '{"query":"\\ud800"}', '{"query":"a","query":"b"}', '{"query":"ok","limit":2.0}',
             None, '{"query":"' + "x" * 300_000 + '"}', '{"query":"n","limit":' + "9" * 400 + "}"]
    calls = spark.createDataFrame([(1, i, f"c{i}", "search", t, []) for i, t in enumerate(texts)],
                                  "conv_id long, turn int, call_id string, name string, arguments string, uses array<string>")
    results = spark.createDataFrame([], "conv_id long, turn int, call_id string, content string")
    got = [r for r in tool_calls.link(calls, results).orderBy("turn").collect()]
    assert [r.problems for r in got] == [
        ["$: nested too deeply"], ["$: number out of range"], ["$: unpaired surrogate"], ["$: repeated key"], [], ["$: not object"],
        [], ["$.limit: above 50"]]
    assert '"limit":2,' in got[4].canonical and got[4].valid


def test_query_validity_and_canonical_text_against_brute_force(spark):
    """Arguments judged by rules written out for the three tools, records rebuilt key by key."""
    import json
    rules = {
        "search": lambda a: set(a) <= {"query", "limit"} and len(a.get("query", "")) >= 1 and 1 <= a.get("limit", 1) <= 50,
        "lookup": lambda a: {"key", "exact"} <= set(a) <= {"key", "exact", "fields"} and isinstance(a["exact"], bool),
        "measure": lambda a: {"text", "unit"} <= set(a) and a["unit"] in ("chars", "words"),
    }
    calls, results = tool_calls.calls_of(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    asked = {(r.conv_id, r.call_id): r for r in calls.collect()}
    answer = {(r.conv_id, r.call_id): r.content for r in results.collect()}
    seen = 0
    for r in tool_calls.link(calls, results).collect():
        call = asked.get((r.conv_id, r.call_id))
        record = json.loads(r.canonical)
        assert r.canonical == json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert record["result"] == answer.get((r.conv_id, r.call_id)) and record["status"] == r.status
        if call is None:
            assert r.status == "orphan" and not r.valid and record["arguments"] is None
            continue
        arguments = json.loads(call.arguments)
        there = all((r.conv_id, u) in asked for u in call.uses)
        assert r.valid == (rules[call.name](arguments) and there) and bool(r.problems) == (not r.valid)
        assert record["arguments"] == arguments and record["uses"] == sorted(set(call.uses))
        seen += 1
    assert seen == len(asked) > 0
