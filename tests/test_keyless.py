"""Rows whose keys are null or repeated, long texts, and chains of blocks."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from maskwright.operators import audit as A
from maskwright.operators.canary import inject_canaries
from maskwright.operators.dictionary import dictionary_spans
from maskwright.operators.guard import Limits, judge_usage, with_usage
from maskwright.operators.joins import join_null_safe
from maskwright.operators.leaks import check_responses
from maskwright.operators.spans import SPANS, find_spans, longest_cover, overlap_groups, replace_spans, resolve_overlaps
from maskwright.operators.vault import anonymize, build_vault, lookup_originals, restore
from maskwright.plans.jobs import check_responses_job, gate_requests


def test_join_null_safe(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(None, "x"), (2, "y")], "k int, w string")
    assert {tuple(r) for r in join_null_safe(left, right, ["k"]).collect()} == {(1, "a", None), (None, "b", "x")}
    assert [r["v"] for r in join_null_safe(left, right, ["k"], "left_anti").collect()] == ["a"]


def test_anonymize_keeps_text_without_keys(spark):
    rows = [(None, 1, "Keep this. Mail c@d.com now."), (None, None, "c@d.com again"), (1, None, "Mail e@f.org now."), (1, None, "and g@h.org, e@f.org")]
    df = spark.createDataFrame(rows, "session int, turn int, text string")
    done = anonymize(df, "text", ["session"], ["turn"])
    # rows that share their keys are one place: the value that starts first in its text counts first
    got = sorted(r["sanitized"] for r in done.rewritten.collect())
    assert got == sorted(["Keep this. Mail [EMAIL_1] now.", "[EMAIL_1] again", "Mail [EMAIL_2] now.", "and [EMAIL_1], [EMAIL_2]"])
    assert done.rewritten.columns == ["session", "turn", "text", "sanitized", "entities"]
    back = restore(done.rewritten, done.vault, "sanitized", ["session"], ["turn"])
    assert all(r["restored"] == r["text"] for r in back.collect())
    # a later run goes on with the numbers of the null session
    more = anonymize(spark.createDataFrame([(None, 3, "c@d.com and z@z.com")], "session int, turn int, text string"), "text", ["session"], ["turn"], vault=done.vault)
    assert more.rewritten.first()["sanitized"] == "[EMAIL_1] and [EMAIL_2]"
    asked = spark.createDataFrame([(None, "[email_2]")], "session int, p string")
    assert lookup_originals(asked, more.vault, "p", ["session"]).first()["original_value"] == "z@z.com"
    terms = spark.createDataFrame([("d", "CLIENT", "Acme Global", False)], "dict_name string, type string, term string, case_sensitive boolean")
    named = anonymize(spark.createDataFrame([(None, None, "for acme global"), (None, None, "no one")], "session int, turn int, text string"), "text", ["session"], ["turn"], terms=terms)
    assert sorted(r["sanitized"] for r in named.rewritten.collect()) == ["for [CLIENT_1]", "no one"]


def test_a_span_without_replacement_is_redacted(spark):
    df = spark.createDataFrame([("a secret b", [("T", "secret", 2, 8, 1.0, 0, {})])], f"t string, s {SPANS}")
    assert df.select(replace_spans("t", "s", lambda s: F.lit(None).cast("string"))).first()[0] == "a [REDACTED_T] b"


def test_leaks_without_keys_are_caught(spark):
    replies = spark.createDataFrame(
        [(None, 1, "leak x@y.com"), (1, None, "leak v@w.com"), (2, 2, "a@b.com"), (2, 2, "long text then c@d.com"), (None, None, "CL-CANARY-X")],
        "session_id int, request_id int, response string",
    )
    vault = build_vault(spark.createDataFrame([(None, 0, "EMAIL", "x@y.com", 0)], "session_id int, turn int, type string, value string, start int"), ["session_id"], ["turn"])
    none = vault.limit(0)
    for order in (["request_id"], []):
        got = {r["response"]: (r["checked"], len(r["leaks"])) for r in check_responses(replies, none, "response", ["session_id"], order).collect()}
        assert got == {
            "leak x@y.com": ("leak [REDACTED_EMAIL]", 1), "leak v@w.com": ("leak [REDACTED_EMAIL]", 1), "a@b.com": ("[REDACTED_EMAIL]", 1),
            "long text then c@d.com": ("long text then [REDACTED_EMAIL]", 1), "CL-CANARY-X": ("CL-CANARY-X", 0),
        }
    known = {r["response"]: len(r["leaks"]) for r in check_responses(replies, vault, "response", ["session_id"]).collect()}
    assert known["leak x@y.com"] == 0 and known["leak v@w.com"] == 1
    token = "CL-CANARY-TOKEN-0123456789ab"
    registry = spark.createDataFrame([(token,)], "token string")
    alarms = spark.createDataFrame([(None, None, f"here {token}"), (None, None, "fine")], "session_id int, request_id int, response string")
    seen = {r["response"]: (r["blocked"], r["block_reason"]) for r in check_responses_job(alarms, none, registry).collect()}
    assert seen == {f"here {token}": (True, f"Canary token leakage detected ({token})"), "fine": (False, None)}


def test_canaries_without_session(spark):
    rows = [(None, 1, "system", "be kind"), (None, 2, "user", "hi"), (2, None, "system", "x"), (2, 1, "user", "y"), (3, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = [tuple(r) for r in inject_canaries(df, "secret").collect()]
    assert len(got) == 6 and {r[:3] for r in got} == {r[:3] for r in rows} | {(3, 0, "system")}
    assert all("CL-CANARY-" in r[3] for r in got if r[2] == "system")


def test_gate_counts_each_request_once(spark):
    rows = [(i, "s", c, t, "hello") for i, c, t in ((1, "a", 1), (None, "a", 100), (2, None, 200), (2, None, None))]
    df = spark.createDataFrame(rows, "request_id long, session_id string, client string, sec int, prompt string")
    df = df.select("request_id", "session_id", "client", F.timestamp_seconds("sec").alias("ts"), F.lit("d").alias("department"), F.lit("r").alias("role"), F.lit("m").alias("model"), F.lit(False).alias("is_streaming"), "prompt")
    gate = gate_requests(df)
    assert sorted(str(r["request_id"]) for r in gate.audit.collect()) == sorted(["1", "None", "2", "2"]) or gate.audit.count() == 4
    assert gate.outbound.count() == 4 and set(gate.outbound.columns) >= set(df.columns)


def test_breaker_cools_down(spark):
    prompts = [("a", 0, "same"), ("a", 1, "same"), ("a", 2, "same"), ("a", 3, "other"), ("a", 31, "other2"), ("a", 32, "fine"), ("b", 3, "free")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(prompts)], "id int, client string, sec int, prompt string")
    df = with_usage(df.withColumn("ts", F.timestamp_seconds("sec")), "prompt")
    got = {r["id"]: (r["allowed"], r["circuit_state"], r["reason"]) for r in judge_usage(df, "client", "ts", "id", Limits(cooldown_ms=30_000)).collect()}
    assert [got[i][0] for i in range(7)] == [True, True, False, False, False, True, True]
    assert got[3][1:] == ("OPEN", "Agentic loop circuit breaker tripped. Cooling down for 29s.") and got[4][2].endswith("1s.") and got[5][1] == "CLOSED"


def test_many_spans_equal_few(spark):
    draw = random.Random(4)
    cases = []
    for n in (1, 31, 33, 64, 65, 300, 900):
        for wide in (n * 2, n * 30):
            cases.append([(a := draw.randint(0, wide), a + draw.randint(1, 9), draw.choice([0.5, 0.9])) for _ in range(n)])

    def direct(spans):
        taken = []
        for i in sorted(range(len(spans)), key=lambda i: (spans[i][0] - spans[i][1], -spans[i][2], spans[i][0], i)):
            if all(max(spans[i][0], spans[j][0]) >= min(spans[i][1], spans[j][1]) for j in taken):
                taken.append(i)
        return sorted(spans[i][:2] for i in taken)

    df = spark.createDataFrame([(i, [("T", "v", a, b, c, 0, {}) for a, b, c in r]) for i, r in enumerate(cases)], f"id int, s {SPANS}")
    for r in df.select("id", longest_cover("s").alias("o")).collect():
        assert [(x["start"], x["end"]) for x in r["o"]] == direct(cases[r["id"]])
    items = df.select("id", overlap_groups(F.transform("s", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))).alias("g"))
    for r in items.collect():
        ends = 0
        for group in r["g"]:
            assert group[0]["start"] >= ends
            ends = max(x["end"] for x in group)
        assert sorted(x["i"] for g in r["g"] for x in g) == list(range(len(cases[r["id"]])))


def test_long_texts_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"a{i}@b.com" for i in range(n)),)], "t string").coalesce(1)
        spans = resolve_overlaps(find_spans(F.col("t"), r"[a-z0-9]+@[a-z]+\.com", "EMAIL", 0.9))
        start = time.time()
        assert df.select(F.size(spans)).first()[0] == n
        return time.time() - start

    seconds(2000)
    few, many = min(seconds(2000) for _ in range(2)), min(seconds(8000) for _ in range(2))
    assert many <= 4.5 * few
    assert seconds(100_000) < 60


def test_dictionary_shuffles_hits_only(spark):
    texts = spark.createDataFrame([(i, " ".join(f"word{(i * 31 + j) % 997}" for j in range(200)) + (" acme global" if i % 50 == 0 else "")) for i in range(300)], "doc_id int, text string")
    terms = spark.createDataFrame([("d", "CLIENT", "Acme Global", False), ("d", "CLIENT", None, False)], "dict_name string, type string, term string, case_sensitive boolean")
    got = dictionary_spans(texts, terms)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 300, 50))


def test_sealed_blocks(spark):
    rows = [(c, b, i) for c in ("x", None) for b in range(9) for i in range(b * 10, b * 10 + 4)]
    df = spark.createDataFrame(rows, "source string, hour int, n int")
    df = A.audit_records(df.withColumn("_m", F.create_map().cast("map<string,int>")), "_m", request_id=F.col("n").cast("string"), timestamp=F.lit("t"), entities_detected=F.lit(1))
    columns = [c for c in df.columns if c != "_m"]
    sealed = A.seal_blocks(df.select(*columns), ["source"], ["n"], "hour", width=3)
    check = lambda rows, heads=sealed.heads: {r["source"]: tuple(r)[1:] for r in A.verify_blocks(rows, heads, sealed.roots, ["source"], ["n"], "hour", width=3).collect()}
    assert check(sealed.rows) == {"x": (True, 0, None, None), None: (True, 0, None, None)}
    heads = sorted((r["hour"], r["latest_hash"], r["records"]) for r in sealed.heads.filter("source = 'x'").collect())
    level = [f"{h}:{n}" for _, h, n in heads]
    while len(level) > 1:
        level = [hashlib.sha256("|".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
    assert {r["root"] for r in sealed.roots.filter("source = 'x'").collect()} == set(level)
    here = F.coalesce(F.col("source") == "x", F.lit(False))
    changed = check(sealed.rows.withColumn("entities_detected", F.when(here & (F.col("n") == 42), 7).otherwise(F.col("entities_detected"))))
    assert changed[None][0] and changed["x"][:3] == (False, 1, 4) and "Tampered" in changed["x"][3]
    cut = check(sealed.rows.filter(~(here & (F.col("n") == 53))))
    assert cut["x"][:3] == (False, 1, 5) and "does not end" in cut["x"][3]
    gone = check(sealed.rows.filter(~(here & (F.col("hour") == 6))))
    assert gone["x"] == (False, 1, 6, "Block 6 is missing")
    forged = check(sealed.rows.filter(~(here & (F.col("hour") == 6))), sealed.heads.filter(~(here & (F.col("hour") == 6))))
    assert forged["x"] == (False, 0, None, "Heads do not give the root") and forged[None][0]
