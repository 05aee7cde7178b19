"""URL filters: host and path rules, and trust carried over the link graph of hosts.

A rule decides the pages that it fits. Hosts that rules mostly allow are trusted seeds, hosts that
rules mostly block are blocked seeds. Personalised PageRank carries trust along the
links between hosts, and distrust against them: who links to a blocked host is
suspect. A host whose distrust outweighs its trust is blocked. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.staging import stage

DAMPING = 0.85
#: Links that a walk from a seed takes at most; what lies beyond carries under 4 % of a seed.
STEPS = 20
#: A host is a seed where rules give at least this share of its pages one verdict.
SEED_SHARE = 0.5
#: A host is blocked where distrust is this share of trust and distrust together, and at least ``LEAST`` of a seed.
THRESHOLD, LEAST = 0.5, 0.01
#: Targets of one host that one task joins; more are dealt over several.
BLOCK = 100_000
#: Parts that a key's rows are dealt over in joins, so that one host may have most pages.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table ``verdict host path``; a longer list comes as a table from its own source."""
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in r._asdict().items()]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def linked_hosts(html: Column) -> Column:
    """Hosts of a page's absolute and protocol-relative links, repeats included."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LINK), F.lit(1))
    return F.transform(links, lambda u: F.translate(F.regexp_extract(u, r"^[^/]*//([^/?#]*)", 1), _UPPER, _LOWER))


def fitting_rules(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key rule decided`` of the rows of ``key host path`` that a rule fits: of several the longest,
    then that with the longer host, then a block.

    Every suffix and prefix of a rule's shape (labels of its host, length of its path) is
    looked up by equality, so the number of rules does not matter.
    """
    known = rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isin("allow", "block")).select(
        "verdict", F.translate("host", _UPPER, _LOWER).alias("_suffix"), F.coalesce("path", F.lit("")).alias("_prefix")
    )
    known = known.groupBy("_suffix", "_prefix").agg(F.max("verdict").alias("_verdict"))  # "block" is above "allow"
    shaped = known.select(F.size(F.split("_suffix", r"\.")).alias("labels"), F.length("_prefix").alias("chars"))
    shapes = sorted(map(tuple, shaped.distinct().collect()))  # a few: labels of a name, lengths of rule paths
    if not shapes:
        return rows.select(key, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("decided")).limit(0)
    fits = [
        F.struct(
            F.substring_index("host", ".", -labels).alias("_suffix"),
            F.when(F.length("path") >= chars, F.substring("path", 1, chars)).alias("_prefix"),
        )
        for labels, chars in shapes
    ]
    sought = rows.select(key, "host", "path").select(key, F.inline(F.array(*fits))).filter(F.col("_prefix").isNotNull())
    sought = sought.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    dealt = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = sought.join(dealt, ["_suffix", "_prefix", "_salt"])
    rule = F.concat("_suffix", "_prefix")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("_suffix").alias("h"), F.col("_verdict").alias("decided"), rule.alias("rule")))
    return found.groupBy(key).agg(best.alias("_best")).select(key, "_best.rule", "_best.decided")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src dst links`` between different hosts, from ``host targets`` of each page."""
    pairs = pages.select(F.col("host").alias("src"), F.explode("targets").alias("dst"))
    return pairs.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("links"))


def walk_scores(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS, block: int = BLOCK) -> DataFrame:
    """``kind node score``: personalised PageRank from each kind's seeds over its own edges.

    ``edges`` has ``kind src dst links``, ``seeds`` has ``kind node mass``. The score sums
    ``damping ** k`` times the mass that arrives after k links, a host's mass leaving in proportion
    to its links; a seed's own mass counts whole. That is the usual rank up to one factor a kind:
    mass that ends at a host without links would return to the seeds. Each step is
    a written table of the nodes that it reaches; it ends early where no more than a
    billionth of the seeds' mass is left. A source with more than ``block`` targets is dealt over parts.
    """
    totals = edges.groupBy("kind", "src").agg(F.sum("links").alias("all"), F.ceil(F.count("*") / block).cast("int").alias("parts"))
    hubs = stage(totals.filter("parts > 1").select(F.col("kind").alias("_k"), F.col("src").alias("_s"), "parts"))
    share = (F.col("links") / F.col("all") * damping).alias("share")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")
    edge_salt = F.pmod(F.xxhash64("dst", F.lit(1)), F.lit(SALTS)).cast("int")
    dealt = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    links = edges.withColumn("_salt", edge_salt).join(dealt, ["kind", "src", "_salt"]).select("kind", "src", part, "dst", share)
    links = stage(links)
    term = stage(seeds.select("kind", "node", F.col("mass").cast("double").alias("mass")))
    terms, start = term, None
    for step in range(steps + 1):
        left = term.agg(F.sum("mass")).first()[0] or 0.0
        start = left if start is None else start
        if not left or left <= 1e-9 * start or step == steps:
            break
        on = (F.col("kind") == F.col("_k")) & (F.col("node") == F.col("_s"))
        sent = term.join(hubs, on, "left").drop("_k", "_s")
        sent = sent.select("kind", F.col("node").alias("src"), "mass", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        moved = sent.join(links, ["kind", "src", "part"]).groupBy("kind", "dst").agg(F.sum(F.col("mass") * F.col("share")).alias("mass"))
        term = stage(moved.select("kind", F.col("dst").alias("node"), "mass"))
        terms = terms.unionAll(term)
    return terms.groupBy("kind", "node").agg(F.sum("mass").alias("score"))


def host_scores(edges: DataFrame, hosts: DataFrame, seed_share: float = SEED_SHARE, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """``host trust distrust`` of hosts that seeds reach; ``hosts`` has ``host pages allowed blocked`` (by rules)."""
    seed = lambda kind, count: hosts.filter((F.col(count) > 0) & (F.col(count) >= seed_share * F.col("pages"))).select(
        F.lit(kind).alias("kind"), F.col("host").alias("node"), F.lit(1.0).alias("mass")
    )
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    scores = walk_scores(stage(forward.unionAll(back)), seed("trust", "allowed").unionAll(seed("distrust", "blocked")), damping, steps)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return scores.groupBy(F.col("node").alias("host")).agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, threshold: float = THRESHOLD, least: float = LEAST,
    seed_share: float = SEED_SHARE, damping: float = DAMPING, steps: int = STEPS,
) -> DataFrame:
    """``page_id host path rule verdict trust distrust`` for every row of ``page_id url html``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed; so is every page that neither a rule nor the graph speaks against. Null ``html`` has no
    links; relative links stay on their host and links of a host to itself are no
    edges. Null ids, repeated rows and empty tables need no care: a row is judged by
    its url. Other columns are ignored. The html is read once.
    """
    url = F.col("url").cast("string")
    seen = stage(
        pages.select(
            F.col("page_id").cast("long"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"),
            linked_hosts(F.col("html").cast("string")).alias("targets"),
        ).withColumn("_row", F.monotonically_increasing_id())
    )
    ruled = fitting_rules(seen, rules, "_row")
    judged = stage(seen.select("page_id", "host", "path", "_row").join(ruled, "_row", "left").drop("_row"))
    count = lambda verdict: F.count_if(F.col("decided") == verdict)
    hosts = judged.filter("host != ''").groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
    scores = host_scores(host_edges(seen), hosts, seed_share, damping, steps)
    dealt = scores.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = judged.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    both = rows.join(dealt, ["host", "_salt"], "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    bad = (distrust >= least) & (distrust >= threshold * (trust + distrust))
    verdict = F.coalesce("decided", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
