import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.operators import audit as A
from maskwright.operators.dictionary import dictionary_spans
from maskwright.operators.detectors import occurrences
from maskwright.operators.policy import rules_from_table
from maskwright.operators.scored import score_entities, spans_from_reply, spans_from_scores
from maskwright.operators.vault import anonymize
from maskwright.sources import config as C
from maskwright.sources import files as S
from maskwright.operators.rpc import sanitize_rpc
from maskwright.sources.lines import read_lines
from maskwright.sources.chat import message_parts, read_chat_requests, read_rpc, read_sse, rebuild_messages


def test_requests(spark, tmp_path):
    body = {"model": "gpt-4o", "stream": True, "department": "hr", "user": "u1", "messages": [
        {"role": "user", "content": "hi"}, {"role": "user", "content": [{"type": "text", "text": "mail x@y.com"}, {"type": "image_url", "image_url": {"url": "u"}}]},
        {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": '{"to": "x@y.com"}'}}]}]}
    lines = [{"request_id": "a", "remote_addr": "1.1.1.1", "x_role": "dev", "body": json.dumps(body)},
             {"request_id": "b", "body": '{"messages": "no"}'}, {"request_id": "c", "body": "{oops"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    got = read_chat_requests(spark, str(tmp_path / "r.json"))
    r = got.requests.first()
    assert (r["client"], r["session_id"], r["department"], r["role"], r["model"], r["is_streaming"]) == ("1.1.1.1", "u1", "hr", "dev", "gpt-4o", True)
    assert r["prompt"].startswith("hi\n[{") and got.requests.count() == 1
    assert sorted(x["request_id"] for x in got.rejects.collect()) == ["b", "c"]
    parts = [(p["turn"], p["part_idx"], p["part_kind"], p["text"]) for p in got.parts.orderBy("turn", "part_idx").collect()]
    assert parts == [(0, 0, "content", "hi"), (1, 0, "block", "mail x@y.com"), (2, 0, "tool_arg", '{"to": "x@y.com"}')]
    done = anonymize(got.parts, "text", ["session_id"], ["turn", "part_idx"]).rewritten
    messages = spark.createDataFrame([("u1", i, json.dumps(m)) for i, m in enumerate(body["messages"])], "session_id string, turn int, m string")
    assert message_parts(messages, "m").count() == 3
    new = {x["turn"]: json.loads(x["m"]) for x in rebuild_messages(messages, "m", done, ["session_id", "turn"], "sanitized").collect()}
    assert new[1]["content"] == [{"type": "text", "text": "mail [EMAIL_1]"}, {"type": "image_url", "image_url": {"url": "u"}}]
    assert new[2]["tool_calls"][0]["function"]["arguments"] == '{"to": "[EMAIL_1]"}' and new[0]["content"] == "hi"


def test_rules(spark, tmp_path):
    cfg = {"Dictionaries": [{"name": "p", "type": "project", "terms": [" Titan ", "", 7]}, {"name": "", "terms": ["x"]}, {"name": "n"},
                            {"name": "q", "terms": ["RedAlert"], "case_sensitive": True}],
           "patterns": [{"name": "emp", "type": "employee_id", "pattern": "EMP-[0-9]{5}"}, {"name": "bad", "pattern": "(["}, {"name": "nop"}]}
    (tmp_path / "c.json").write_text(json.dumps(cfg, indent=2))
    rules = C.load_rules(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, rules.terms.collect())) == [("p", "PROJECT", "7", False), ("p", "PROJECT", "Titan", False), ("q", "CUSTOM", "RedAlert", True)]
    detectors, bad = C.detectors_from_rules(rules)
    assert bad == ["bad"] and "EMPLOYEE_ID" in detectors.types
    assert {tuple(r) for r in C.rule_inventory(rules.terms).collect()} == {("p", "PROJECT", 2), ("q", "CUSTOM", 1)}
    new = spark.createDataFrame([("p", "PROJECT", "Zeus", False), ("r", "CUSTOM", "", False), (None, "X", "y", False)], rules.terms.schema)
    table, rejects = C.upsert_rules(rules.terms, new, "dict_name")
    assert sorted(r["term"] for r in table.collect()) == ["RedAlert", "Zeus"] and rejects.count() == 2


def test_policy_file(spark, tmp_path):
    cfg = {"rules": [{"id": "a", "match": {"department": ["hr", "it"], "model": "gpt-*", "minRiskScore": 5}, "action": "WARN"},
                     {"id": "b", "action": "BLOCK", "match": {"entities": ["NIR"]}, "reason": "no"}]}
    (tmp_path / "p.json").write_text(json.dumps(cfg, indent=1))
    table = C.load_policy(spark, str(tmp_path / "p.json"))
    assert table.first()["default_action"] == "CLOAK"
    a, b = rules_from_table(table)
    assert a.department == ("hr", "it") and a.model == ("gpt-*",) and a.role is None and a.min_risk == 5
    assert b.entities == ("NIR",) and b.reason == "no" and b.action == "BLOCK"


def test_files(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.csv").write_text("x\ny")
    (docs / "b.MD").write_text("# t")
    assert {(r["name"], r["format"], r["content"]) for r in S.read_documents(spark, str(docs)).collect()} == {("a.csv", "csv", "x\ny"), ("b.MD", "markdown", "# t")}
    df = A.audit_records(spark.range(2).withColumn("m", F.expr("map('PERSON', 1)")), "m", request_id=F.col("id").cast("string"),
                         timestamp=F.lit("2026-01-01T00:00:00Z"), model=F.lit("m"), entities_detected=F.lit(1), processing_latency_ms=F.lit(1), upstream_latency_ms=F.lit(2),
                         is_streaming=F.lit(False), status=F.lit("SUCCESS"), firewall_flags=F.array(F.lit("A")))
    sealed = A.seal_audit(df.withColumn("c", F.lit(0)), ["c"], ["id"]).drop("c", "id", "m")
    log = str(tmp_path / "log")
    S.write_audit(sealed, log)
    (tmp_path / "log" / "part-bad.json").write_text('{"broken\n')
    back = S.read_audit(spark, log)
    assert {r["hash"]: r["entity_breakdown"] for r in back.collect()} == {r["hash"]: r["entity_breakdown"] for r in sealed.collect()}
    assert A.verify_audit(back.withColumn("c", F.lit(0)), ["c"], ["request_id"]).first()["valid"]
    S.write_syslog(sealed, str(tmp_path / "sys"))
    assert spark.read.text(str(tmp_path / "sys")).filter("value like '<14>1 %'").count() == 2
    counts = S.write_siem(sealed, lambda body, head: 1 / 0 if '"request_id":"1"' in body else head["Authorization"] == "Bearer k", "k").agg(F.sum("sent"), F.sum("failed")).first()
    assert tuple(counts) == (1, 1)
    S.write_markdown_report(sealed, ["timestamp"], str(tmp_path / "md"))
    assert "| `PERSON` | 2 | **100%** |" in [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]


def test_lines(spark, tmp_path):
    lines = ['data: {"choices":[{"delta":{"content":"hé"}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"role":"a"}}]}', "event: x", "data: {bad", " "]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "seq long, line string")
    got = read_sse(df).orderBy("seq").collect()
    assert [r["delta"] for r in got] == ["hé", None, None, None, None, None]
    assert [r["done"] for r in got] == [False, True, False, False, False, False]
    assert [r["passthrough"] is None for r in got] == [True, True, False, False, False, False]
    many = [f'{{"n":{i}}}' for i in range(3000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.split").write_text("\n".join(f"{name}{m}" for m in many) + "\n")
    (tmp_path / "empty.split").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("1000b", "0")):
            spark.conf.set(k, v)
        read = spark.read.text(str(tmp_path / "*.split"))
        assert read.rdd.getNumPartitions() > 20
        got = sorted((r["file"][-7], r["line_no"], r["line"]) for r in read_lines(spark, str(tmp_path / "*.split")).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(name, i, f"{name}{m}") for name in "ab" for i, m in enumerate(many)]
    (tmp_path / "log.jsonl").write_text('{"request_id":"a","hash":"h"}\n\n{"request_id":\n[1]\n{"request_id":"b","risk_score":"x"}\n{"request_id":"c"}\n')
    log = S.read_audit_log(spark, str(tmp_path / "log.jsonl"))
    assert [(r["line_no"], r["request_id"], r["hash"]) for r in log.records.orderBy("line_no").collect()] == [(0, "a", "h"), (5, "c", None)]
    assert [(r["line_no"], r["line"][:2]) for r in log.rejects.orderBy("line_no").collect()] == [(2, '{"'), (3, "[1"), (4, '{"')]
    call = '{"jsonrpc":"2.0","id":1,"method":"tools/call","params":{"name":"s","arguments":{"to":"%s"}}}'
    (tmp_path / "rpc.ndjson").write_text("\n".join(call % m for m in ("b@x.com", "a@x.com", "b@x.com")))
    done, _ = sanitize_rpc(read_rpc(spark, str(tmp_path / "rpc.ndjson")))
    assert [r["sanitized_line"] for r in done.orderBy("seq").collect()] == [call % f"[EMAIL_{n}]" for n in (1, 2, 1)]
    (tmp_path / "l.ndjson").write_text('{"a":1}\nnope\n{"b":2}')
    assert [r["is_json"] for r in read_rpc(spark, str(tmp_path / "l.ndjson")).collect()] == [True, False, True]


def test_scored(spark):
    text = "Contact  Jean Dupont chez Acme pour Jean Dupontel."
    df = spark.createDataFrame([(text,)], "text string")

    def fn(texts):
        return [[{"label": "B-PER", "word": "Jean", "start": 8, "end": 13, "score": 0.8}, {"label": "I-PER", "word": "Dupont", "start": 14, "end": 20, "score": 0.9},
                 {"label": "ORG", "word": "Acme", "start": None, "end": None}, {"label": "LOC", "word": "Paris", "start": 0, "end": 3}, {"label": "PER", "word": "##el"}] for _ in texts]

    spans = score_entities(df, "text", fn).first()["model_spans"]
    assert [(s["type"], s["value"], s["start"], s["confidence"]) for s in spans] == [("PERSON", "Jean Dupont", 9, 0.9), ("ORGANIZATION", "Acme", 26, 0.9)]
    failed = score_entities(df, "text", lambda t: 1 / 0).first()
    assert failed["model_spans"] == [] and failed["model_failed"]
    two = spark.createDataFrame([("bad Ann",), ("good Ann",)], "text string").coalesce(1)
    picky = lambda texts: [[{"label": "PER", "word": "Ann", "start": t.index("Ann"), "end": len(t)}] if "bad" not in t else 1 / 0 for t in texts]
    rows = {r["text"]: r for r in score_entities(two, "text", picky).collect()}
    assert len(rows["good Ann"]["model_spans"]) == 1 and not rows["good Ann"]["model_failed"] and rows["bad Ann"]["model_failed"]
    for reply in ('```json\n{"entities": [{"type": "person", "value": " jean dupont "}]}\n```', 'Sure: [{"type":"X","value":"Jean Dupont"}] ok', '[{"value": "Jean Dupont"}, {"value": "J"}]'):
        row = df.withColumn("r", F.lit(reply)).select(spans_from_reply("text", "r").alias("s")).first()["s"]
        assert [(s["type"], s["value"]) for s in row] == [("PERSON", "Jean Dupont")]
    assert df.withColumn("r", F.lit("none")).select(spans_from_reply("text", "r").alias("s")).first()["s"] == []
    assert [s["start"] for s in df.select(occurrences("text", "jean", "PERSON", 0.9).alias("s")).first()["s"]] == [9, 36]


def test_json_that_cannot_be_text(spark):
    from maskwright.functions.json_text import document_pieces

    deep = "[" * 3000 + '"a"' + "]" * 3000
    df = spark.createDataFrame([('{"a":"\\ud800 a@b.com"}',), (deep,), ('{"a":"\\ud83d\\ude00","b":[1,{"c":"x"}]}',)], "t string")
    got = [r[0] for r in df.select(document_pieces("t")).collect()]
    assert got[0] is None and [p["text"] for p in got[2] if p["kind"]] == ["\U0001f600", "x"]


def test_policy_default(spark):
    from maskwright.operators.policy import decide
    from maskwright.sources.config import parse_policy

    rules = parse_policy(spark.createDataFrame([('{"defaultAction":"BLOCK","rules":[{"id":"r","action":"ALLOW","match":{"role":"x"}}]}',)], "value string"))
    asked = spark.createDataFrame([("y",), ("x",)], "role string")
    assert {r["role"]: r["decision"]["action"] for r in decide(asked, rules).collect()} == {"y": "BLOCK", "x": "ALLOW"}


def test_large_dictionary(spark):
    terms = spark.createDataFrame([("d", "PROJECT", "Project Apollo", False), ("d", "PROJECT", "apollo", False), ("c", "CUSTOM", "RedAlert", True),
                                   ("d", "PROJECT", "C++", False), ("d", "PROJECT", "a b c d e f", False), ("s", "CUSTOM", "@@", False)],
                                  "dict_name string, type string, term string, case_sensitive boolean")
    df = spark.createDataFrame([(1, "the project apollo and Apollo"), (2, "redalert RedAlert c++ C"), (3, "a b c d e g"), (4, "x @@ a B c d E f")], "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["term_spans"]] for r in dictionary_spans(df, terms).collect()}
    assert got == {1: ["project apollo", "Apollo"], 2: ["RedAlert", "c++"], 4: ["@@", "a B c d E f"]}
