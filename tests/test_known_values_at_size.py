import random

from pyspark.sql import functions as F

from maskwright.functions import fixed_values as fixed
from maskwright.functions.entropy import may_reach, shannon_entropy
from maskwright.functions.text import java_pattern
from maskwright.operators import detectors as d
from maskwright.operators.spans import find_spans
from maskwright.operators.vault import anonymize_conversations, gram_sizes, sift_grams


def test_the_filter_of_grams_grows_with_its_list(spark):
    listed = spark.range(600_000).select(F.concat(F.lit("v"), "id").alias("_gram"), F.lit(1).alias("_size"))
    sizes, bits = gram_sizes(listed, "_size")
    assert sizes == [1]
    others = spark.range(40_000).select(F.concat(F.lit("other"), "id").alias("_gram"))
    assert sift_grams(others, listed, bits).count() < 4_000
    assert sift_grams(listed.limit(1000), listed, bits).count() == 1000


def test_known_values_are_found_beside_own_spans(spark):
    rows = [(1, 0, "Bonjour M. Luc Moreau, mail luc@x.org"), (1, 1, "Luc Moreau luc@x.org Luc Moreau;luc@x.org. Client: Luc Moreau"),
            (1, 2, "xLuc Moreau; M. Paul Petit, Luc Moreau"), (1, 3, "Luc M. Paul Petit, Moreau")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = [r["sanitized"] for r in anonymize_conversations(df).rewritten.orderBy("turn").collect()]
    assert got == ["Bonjour M. [PERSON_1], mail [EMAIL_1]", "[PERSON_1] [EMAIL_1] [PERSON_1];[EMAIL_1]. Client: [PERSON_1]",
                   "xLuc Moreau; M. [PERSON_2], [PERSON_1]", "Luc M. [PERSON_2], Moreau"]


def test_places_of_few_and_many_matches(spark):
    texts = ["é" * k + "".join(f"x{i}é{'-' * (i % 3)}" for i in range(k)) + "." for k in (0, 1, 2, 15, 16, 17, 40, 100)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", find_spans("t", r"x[0-9]+", "CUSTOM", 0.9).alias("s")).collect()
    for r in found:
        assert [r["t"][s["start"]:s["end"]] for s in r["s"]] == [s["value"] for s in r["s"]]
        assert len(r["s"]) == r["t"].count("x")


def test_too_few_signs_for_an_entropy(spark):
    values = ["0123456789abcdef" * 2, "ab" * 20, "a", "", "0123456789" * 3]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for bits in (3.0, 3.4, 4.0, 4.2):
        assert df.filter((shannon_entropy("v") >= bits) & ~may_reach(F.col("v"), bits)).count() == 0
    assert df.filter(may_reach(F.col("v"), 4.0)).count() == 1


def test_quick_patterns_keep_all_matches_of_random_texts(spark):
    rng = random.Random(7)
    pieces = ["a.b", "x_y", "@", "ex.org", "-", "%", " ", " ", "é", "É", "Acme", "B&B", "12", "SARL", "Co.", "Inc", "sas", "Ltd", ".", "\n", "Xé", "_"]
    texts = [("".join(rng.choice(pieces) for _ in range(40)),) for _ in range(2000)]
    df = spark.createDataFrame(texts, "t string")
    for name in ("EMAIL", "ORG_SUFFIXED"):
        every = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
        assert df.filter(F.size(every(d._p(name))) > 0).count() > 20
        assert df.filter(~every(java_pattern(getattr(fixed, name))).eqNullSafe(every(d._p(name)))).count() == 0, name


def test_mapped_addresses_are_still_found(spark):
    df = spark.createDataFrame([("see 10.1.2.3, 8.8.8.8 and ::FFFF:10.4.5.6 or ::ffff:9.9.9.9.",)], "t string")
    both = df.select(F.transform(d.find_entities("t"), lambda s: F.concat_ws(" ", s["type"], s["value"])).alias("f")).first()["f"]
    plain = df.select(F.transform(d.detect("t", d.plain_ipv4), lambda s: s["value"]).alias("f")).first()["f"]
    assert plain == ["10.1.2.3", "8.8.8.8", "10.4.5.6", "9.9.9.9"]
    assert {f.split(" ")[1].split(":")[-1] for f in both} == set(plain)
    assert "INTERNAL_IP 10.1.2.3" in both and "IP_ADDRESS 8.8.8.8" in both
