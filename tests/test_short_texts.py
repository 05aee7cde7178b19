"""Tables of short texts: the test in front of the detectors, values found by place, tasks, sessions of one text."""

from pyspark.sql import functions as F

from maskwright.operators.detectors import detect, DetectorSet, find_entities, may_hold
from maskwright.operators.spans import resolve_overlaps
from maskwright.operators.vault import WORD, anonymize, value_hits
from maskwright.plans import catalog, seeded

ODD = [
    "ſncf", "İng OPENAİ", "vınci", "KERING", "a b", "SIREN 552032534", "SIREN: 552 032 534", "02 0794 608 1", "0207946081",
    "1 85 05 2A 108 123 45", "1850575108123", "(555) 234-1234", "+1 (555) 234-1234", "x+49 301 2345 123", "06.12.34.56.78", "06_12_34_56_78",
    "ssn 100101000", "Nino: AB123456C", "AB 12 34 56 C", "10 k€", "chf 3", "::1", "fd00:1:2:3:4:5:6:7", "1.2.3.4", "M. Dupont", "Me Martin",
    "hôpital Paris", "Hospital Paris", "Bank One", "Firm One", "Acme Co", "9 Corp", "société Un", "Client : Paul", "4539 1488 0343 6467",
    "552 032 534 00018", "FR7630003000011234567890188", "sk-abcdefghijklmnopqrstuv", "ghp_" + "a1" * 20, "Dear Anne", "Chère Anne", "Maître Paul",
]


def test_a_short_text_with_entities_is_never_passed_over(spark):
    first = spark.createDataFrame([(t,) for t in ODD] + [(f"x {t}, y",) for t in ODD], "text string")
    rare = spark.range(340).select((F.col("id") + 1).alias("c_custkey"))
    rare.createOrReplaceTempView("mw_rare_customers")
    values = spark.sql(seeded.RARE_ROWS.replace("FROM customer", "FROM mw_rare_customers")).select(F.concat("head", "value").alias("text"))
    texts = first.unionByName(values)
    every = DetectorSet()
    found = texts.select("text", may_hold(F.col("text")).alias("may"), detect("text", lambda g: resolve_overlaps(every.raw(g))).alias("spans"))
    assert found.filter("size(spans) > 0").count() > 300
    assert found.filter("size(spans) > 0 AND NOT may").collect() == []


def test_order_texts_are_passed_over_and_dealt_out(spark, sf, tmp_path):
    for name in ("orders", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts, _ = catalog._order_texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert texts.filter(may_hold(F.col("text"))).count() == 0


def test_values_found_by_place_are_those_of_their_pattern(spark):
    texts = ["Acme a", "xAcme Acme", "acme_ acme", "ACME", "é acme é", "a a a", "xa a a", "#1 #1x", "", "a\x01a", "ac.me acxme", "K k", "2acme", "acme"]
    values = ["Acme", "a a", "#1", "a", "ac.me", "k", "ACME ACME", "K", "a\x01a", "x"]
    df = spark.createDataFrame([(t, v, c) for t in texts for v in values for c in (False, True)], "t string, v string, c boolean")
    # beside a sign that is not ASCII the pattern decides
    both = df.select("t", "v", "c", value_hits(F.col("t"), F.col("v"), WORD, F.col("c")).alias("fast"),
                     value_hits(F.concat(F.col("t"), F.lit("…")), F.col("v"), WORD, F.col("c")).alias("pattern"))
    assert both.filter("fast != pattern").collect() == []
    assert both.filter("size(fast) > 0").count() > 20


def test_sessions_of_one_text_know_their_own_values(spark):
    rows = [("s", 1, "Bonjour M. Jean Dupont, Jean Dupont."), ("t", 1, "Jean Dupont called"), (None, 1, "M. Paul Martin"), (None, 2, "Paul Martin")]
    done = anonymize(spark.createDataFrame(rows, "s string, n int, text string"), "text", ["s"], ["n"]).rewritten
    assert {(r.s, r.n): r.sanitized for r in done.collect()} == {
        ("s", 1): "Bonjour M. [PERSON_1], [PERSON_1].", ("t", 1): "Jean Dupont called", (None, 1): "M. [PERSON_1]", (None, 2): "[PERSON_1]",
    }
