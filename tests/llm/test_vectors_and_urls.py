"""Whitening, hard negatives and URL filters against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest

from maskwright.llm import negatives, queries, urls, whitening

VECTORS = "vec_id long, embedding array<float>, label int, anchor boolean, component int, score string"
ODD = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 1.0]]


def vectors(spark, n=160, dim=3, seed=1, grid=8):
    """Clustered vectors on a coarse grid, so that scores tie; odd vectors, a null id, a repeated row, a null label."""
    draw = random.Random(seed)
    rows = [(i, [draw.randint(-grid, grid) / 16 + (i % 4) / 8 for _ in range(dim)], i % 3, i % 5 == 0) for i in range(n)]
    rows += [(n + i, v, 1, False) for i, v in enumerate(ODD)]
    rows += [(None, [0.5] * dim, 1, False), rows[5], (n + 20, [0.25] * dim, None, True), (n + 21, [0.0] * dim, 2, True), (n + 22, [0.5] * (dim + 1), 1, True)]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS)


def whole(v, scale=256):
    if not v or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [math.floor(scale * c) for c in v]


def check_white(got, rows, keep):
    """Recomputed by an eigensolver from the same rows."""
    x = [(r["vec_id"], whole(r["embedding"])) for r in rows]
    x = [(i, v) for i, v in x if v and len(v) == len(rows[0]["embedding"])]
    fit = np.array(sorted({tuple(v) for _, v in x}), np.float64)
    n, total = len(fit), fit.sum(axis=0)
    cov = (fit - total / n).T @ (fit - total / n) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:keep], axes[:, ::-1][:, :keep]
    assert len(got) == len(x) * min(keep, fit.shape[1])
    for c in range(1, len(values) + 1):
        mine = [g for g in got if g["component"] == c]
        axis = axes[:, c - 1]
        key = lambda i, d: (i is None, i or 0, d)
        found = sorted((key(g["vec_id"], int(g["deviation"])), g["whitened"]) for g in mine)
        wanted = sorted((key(i, sum((n * a - int(s)) ** 2 for a, s in zip(v, total))), float((np.array(v) - total / n) @ axis / np.sqrt(values[c - 1]))) for i, v in x)
        assert [k for k, _ in found] == [k for k, _ in wanted]
        sign = np.sign(sum(a * b for (_, a), (_, b) in zip(found, wanted)))
        assert max(abs(a - sign * b) for (_, a), (_, b) in zip(found, wanted)) < 1e-9
        assert {g["n"] for g in mine} == {n} and len({g["identity_error"] for g in mine}) == 1
        assert all(abs(g["explained"] - values[c - 1] / np.trace(cov)) < 1e-9 and g["identity_error"] < 1e-9 for g in mine)


def test_whitening_against_eigensolver(spark, sf):
    df = vectors(spark, dim=6, grid=40)
    got = whitening.whiten(df).collect()
    assert {"label", "anchor", "score", "_component"} <= set(whitening.whiten(df).columns)  # clashing name
    check_white([{**g.asDict(), "component": g["_component"]} for g in got], df.collect(), 4)
    real = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    check_white(queries.op11_whitening(spark, sf).collect(), real.collect(), 4)


def test_whitening_far_from_zero(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((300, 5)) * [1, 2, 3, 4, 5] + 1e6  # centring first keeps the small spread
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    fit = np.floor(256 * x)
    cov = np.cov(fit.T, bias=True)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert all(abs(g["explained"] - values[g["component"] - 1] / np.trace(cov)) < 1e-6 and g["identity_error"] < 1e-8 for g in got)


def test_whitening_without_spread(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r["n"], r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whiten(same).collect()} == {(1, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    by = {}
    for r in whitening.whiten(line).collect():
        by.setdefault(r["component"], []).append(r["whitened"])
    assert abs(np.var(by[1]) - 1) < 1e-9 and set(by[2] + by[3]) == {0.0}
    assert whitening.whiten(vectors(spark).limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [3e9 * i, 1e9]) for i in range(50)], "vec_id long, embedding array<double>")
    got = [r for r in whitening.whiten(huge).collect() if r["component"] == 1]
    xs = [math.floor(256 * 3e9 * i) for i in range(50)]
    assert sorted(int(r["deviation"]) for r in got) == sorted((50 * v - sum(xs)) ** 2 for v in xs)


@pytest.mark.parametrize("kind", range(4))
def test_components_to_double_precision(kind):
    draw = np.random.default_rng(kind)
    for n in (1, 2, 3, 17, 60):
        q, _ = np.linalg.qr(draw.standard_normal((n, n)))
        values = [np.arange(n, 0, -1.0), 10.0 ** -np.arange(n), 1 + 1e-9 * np.arange(n), np.r_[5.0, np.ones(n - 1)]][kind]
        a = (q * values) @ q.T
        found, axes = whitening.top_components((a + a.T) / 2, 4)
        assert np.abs(found - np.sort(values)[::-1][:4]).max() < 1e-14 * values.max() * 10
        assert np.abs(axes.T @ axes - np.eye(len(found))).max() < 1e-14 * 10
        assert np.abs(a @ axes - axes * found).max() < 1e-14 * 10 * values.max()


def brute_negatives(rows, positives=5, count=5, low=80, high=100):
    rows = [(r["vec_id"], r["label"], r["anchor"], whole(r["embedding"])) for r in rows]
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[3]]
    out = []
    for at, (i, label, anchor, x) in enumerate(rows):
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, lab) for k, (j, lab, _, y) in enumerate(rows) if k != at and len(y) == len(x))
        for s, j, _ in [t for t in scored if t[2] == label][:positives]:
            fine = [t for t in scored if t[2] != label and -low * s <= -100 * t[0] <= -high * s]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fine[:count])]
    return sorted(out)


@pytest.mark.parametrize("block,leaf", [(4096, 24), (40, 2), (13, 1)])
def test_hard_negatives_against_brute_force(spark, block, leaf):
    for dim, grid in ((3, 8), (8, 30)):
        df = vectors(spark, dim=dim, grid=grid)
        got = [tuple(r) for r in negatives.hard_negatives(df, block=block, leaf=leaf).collect()]
        assert sorted(got) == brute_negatives(df.collect())
    assert negatives.hard_negatives(vectors(spark).limit(0)).count() == 0


def test_cover_tree_covers_and_skips():
    draw = np.random.default_rng(5)
    middle = draw.standard_normal((40, 8))
    x = np.floor(64 * (np.repeat(middle, 50, axis=0) + 0.05 * draw.standard_normal((2000, 8))))
    tree = negatives.CoverTree(x, leaf=8)
    points = tree.points / np.linalg.norm(tree.points, axis=1, keepdims=True)
    below = {k: set(tree.order[tree.low[k] : tree.high[k]].tolist()) for k in range(len(tree.centre))}
    for k in reversed(range(len(tree.centre))):
        for kid in range(tree.first[k], tree.last[k]):
            below[k] |= below[kid] | ({tree.centre[kid]} if not tree.own[kid] else set())
        angles = np.arccos(np.clip(points[list(below[k])] @ points[tree.centre[k]], -1, 1)) if below[k] else np.zeros(1)
        assert angles.max() <= tree.cone[k] + 1e-6
    assert below[0] == set(range(1, 2000))
    ids = np.arange(2000)
    for i in range(0, 2000, 97):
        scores = x @ x[i]
        for low, high in ((-np.inf, np.inf), (0.6 * scores[i], 0.9 * scores[i])):
            got = tree.search(x[i], [(low, high)], 5, lambda r: np.ones(len(r), bool), ids)[0]
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            wanted = inside[np.lexsort((inside, -scores[inside]))][:5]
            assert got[0].tolist() == wanted.tolist() and got[1].tolist() == scores[wanted].tolist()
    assert tree.scored < 0.5 * 2 * 21 * 2000  # bounds skip most rows


PAGES = [
    ("http://good.com/a", '<a href="https://Friend.org/x">x</a><a href="/rel">y</a><a href=//mid.org/z>'),
    ("http://spam.net/es/1", '<a href="http://other.org/">'),
    ("http://farm.org/", "<A HREF = \"http://spam.net/es/1\">1</a><a href='http://spam.net/es/2'><a href='http://farm.org/self'>"),
    ("http://friend.org/p?q", None), (None, "x"), ("nonsense", ""), ("http://mid.org/q#x", '<a href="http://spam.net/fr/">'),
    ("http://spam.net/fr/", ""), ("http://com", ""), ("HTTP://WWW.Example.COM/en/x", ""), ("http://a.example.com/en/", "<a href='http://x.org"),
    ("http://example.com/fr?/en/", ""), ("://", ""), ("http://x.org/" + "a" * 50000, "<p>" * 20000), ("http://x.org/", '<link href="//spam.net/es">'),
    ("http://good.com/a", '<a href="https://Friend.org/x">x</a>'), ("http://notcom/en", ""), ("http://b.com?x", ""), ("http://.com/", ""),
]


def brute_urls(pages, rules, steps=urls.STEPS):
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        stop = next((i for i, c in enumerate(rest) if i >= end and c in "?#"), len(rest))
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:stop]

    out, edges, hosts = [], {}, {}
    for i, (url, html) in enumerate(pages):
        host, path = parts(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict), default=None)
        out.append((i, host, path, best and best.host + best.path, best and best.verdict))
        if host:
            n = hosts.setdefault(host, [0, 0, 0])
            n[0] += 1
            n[1] += bool(best and best.verdict == "allow")
            n[2] += bool(best and best.verdict == "block")
        import re

        for link in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)""", html or ""):
            to = re.split(r"[/?#]", link.split("//", 1)[1])[0].lower()
            if host and to and to != host:
                edges[host, to] = edges.get((host, to), 0) + 1
    scores = {}
    for kind, at, pairs in (("trust", 1, edges), ("distrust", 2, {(b, a): n for (a, b), n in edges.items()})):
        now = {h: 1.0 for h, n in hosts.items() if n[at] and 2 * n[at] >= n[0]}
        total = {}
        for (a, _), n in pairs.items():
            total[a] = total.get(a, 0) + n
        score = dict(now)
        for _ in range(steps):
            new = {}
            for (a, b), n in pairs.items():
                if a in now:
                    new[b] = new.get(b, 0) + 0.85 * now[a] * n / total[a]
            now = new
            for k, v in new.items():
                score[k] = score.get(k, 0) + v
        scores[kind] = score
    for k, (i, host, path, rule, verdict) in enumerate(out):
        t, d = scores["trust"].get(host, 0), scores["distrust"].get(host, 0)
        out[k] = (i, host, path, rule, verdict or ("block" if d >= 0.01 and d >= 0.5 * (t + d) else "allow"), round(t, 9), round(d, 9))
    return out


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, host string, rule string")
    for rules in (queries.URL_RULES, [], [urls.Rule("block", "x.org", "/a"), urls.Rule("allow", "x.org", "/a")]):
        got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in urls.judge_urls(df, urls.rule_table(spark, rules)).collect()]
        assert sorted(got) == brute_urls(PAGES, rules)
    assert ("farm.org", "block") in {(r["host"], r["verdict"]) for r in urls.judge_urls(df, urls.rule_table(spark, queries.URL_RULES)).collect()}
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, queries.URL_RULES)).count() == 0


def test_url_walk_with_hubs_and_sql(spark, tmp_path):
    """A hub is dealt over parts; the checking SQL agrees on pages with links."""
    draw = random.Random(2)
    tops = ["com", "net", "org", "example.com", "www.example.com"]
    name = lambda k: f"h{k}.{tops[k % 5]}"
    pages = []
    for i in range(300):
        k = 0 if i % 3 == 0 else draw.randint(0, 30)  # one host has a third
        links = "".join(f'<a href="http://{name(draw.randint(0, 40))}/{j}">' for j in range(draw.randint(0, 4)))
        pages.append((i, f"http://{name(k)}/{draw.choice(['en', 'es', 'fr'])}/{i}", links))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    wanted = brute_urls([p[1:] for p in pages], queries.URL_RULES)
    got = urls.judge_urls(df, urls.rule_table(spark, queries.URL_RULES)).collect()
    assert sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == wanted
    assert {r[4] for r in wanted if r[3] is None} == {"allow", "block"}
    edges = spark.createDataFrame([("t", "hub", f"n{i}", 1 + i % 3) for i in range(50)] + [("t", f"n{i}", "hub", 1) for i in range(50)], "kind string, src string, dst string, links long")
    seeds = spark.createDataFrame([("t", "hub", 1.0), ("t", "alone", 1.0)], "kind string, node string, mass double")
    cut, plain = ({r["node"]: r["score"] for r in urls.walk_scores(edges, seeds, steps=6, block=b).collect()} for b in (7, 1000))
    assert cut.keys() == plain.keys() and all(abs(cut[k] - plain[k]) < 1e-12 for k in cut)
    assert abs(plain["hub"] - sum(0.85 ** k for k in (0, 2, 4, 6))) < 1e-12
    path = str(tmp_path / "pages.parquet")
    df.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    assert sorted(con.sql(queries.ORACLES["op13_url_filters"]).fetchall()) == sorted((r[0], *r[1:5]) for r in wanted)
