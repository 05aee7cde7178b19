"""Training-text operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, edit_counts, langid, packing, quality, sharding, simhash, token_store, toxicity, vectors
from maskwright.llm.components import components
from maskwright.llm.tokens import WordEncoder, default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, _text_bytes int"
ODD = [None, "", "   ", "a", "same text here", "same text here", "x<|endoftext|>y", "日本語 é É ½ 🙂 don't", "a\x00b\x1cc", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long, repeated and odd texts, a null id, clashing columns."""
    rows = [(i, t, None, None, None, 0.5, "x", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "same text here", "en", "s", 1, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(default_tokenizer())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library(real, library):
    texts = [r["text"] or "" for r in real.limit(60).collect()] + [t or "" for t in ODD] + ["ÀÉŸ ß ẞ K", "'s 't'''s we'll", "!!'s a.b,c"]
    small = WordEncoder(default_tokenizer(), most=50)
    for encoder in (WordEncoder(default_tokenizer()), small):
        assert [i.tolist() for i in encoder.ids(texts)] == [library(t) for t in texts]


def test_fullest_against_all_subsets():
    draw = random.Random(1)
    for _ in range(60):
        items = [draw.randint(1, 30) for _ in range(draw.randint(1, 9))]
        room = draw.randint(1, 60)
        counts = sorted({n: items.count(n) for n in items}.items(), reverse=True)
        got = packing.fullest(counts, room)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(n * c for n, c in got) == best and all(c <= dict(counts)[n] for n, c in got)


def check_packing(rows, wanted, capacity):
    pieces, sequences = {}, {}
    for r in rows:
        ids = wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(ids), crc(ids), r["start"]) == (r["length"], r["ids_crc32"], r["piece"] * capacity)
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return pieces, len(sequences)


def test_packing(real, docs, empty, library):
    wanted = {r["doc_id"]: [*library(r["text"]), 1] for r in real.collect()}
    pieces, used = check_packing(packing.pack_documents(real).collect(), wanted, 4096)
    assert pieces == {d: len(i) for d, i in wanted.items()}
    assert used <= -(-sum(map(len, wanted.values())) // 4096) + 1
    rows = packing.pack_documents(docs, capacity=64).collect()
    wanted = {i: [*library(t), 1] for i, t in enumerate(ODD)} | {None: [*library(ODD[4]), 1]}
    pieces, _ = check_packing(rows, wanted, 64)
    assert pieces[4] == 2 * len(wanted[4]) and pieces[0] == 1
    assert packing.pack_documents(empty).count() == 0
    whole = packing.sequences(docs, capacity=64).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(pieces.values()) and all(len(r["ids"]) == 4 * r["length"] for r in whole)


def brute_contamination(text, items, size=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = cut(text), set(), set()
    for item, t in items:
        bs = cut(t)
        k = min(size, len(bs))
        known = {tuple(bs[i : i + k]) for i in range(len(bs) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[i : i + k]) in known:
                hit |= set(range(i, i + k))
                found.add(str(item))
    listed = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def test_decontamination(spark, real, docs, empty):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(6)] + ["É", "ab"]
    items = [(1, " ".join(draw.choices(words, k=15))), (2, "É ab"), (3, None), (10, "..."), (11, "w1 W2, w3"), (12, "w1 w2 w3")]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 60))) for _ in range(40)] + [f"x {items[0][1]} y {items[0][1].upper()}", None, ""]
    bench = spark.createDataFrame([*items, (None, "w0 w1")], "item_id long, text string")
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, n_hit int")
    for most in (decontaminate.BROADCAST_WINDOWS, 2):
        found = decontaminate.hits(rows, bench, most=most)
        assert found.select("doc_id", "at", "length").distinct().count() == decontaminate.hits(rows, bench).select("doc_id", "at", "length").distinct().count()

    def wanted(text):  # the item without an id hits words, but is neither counted nor named
        n_words, n_hit, _, _, bad = brute_contamination(text, [*items, ("", "w0 w1")])
        return (n_words, n_hit, *brute_contamination(text, items)[2:4], bad)

    for r in decontaminate.contamination(rows, bench).collect():
        assert tuple(r)[1:6] == wanted(texts[r["doc_id"]]), texts[r["doc_id"]]
    only = decontaminate.contamination(rows.limit(0).union(spark.createDataFrame([(1, "w0 w1 zz", 0)])), bench.filter("item_id IS NULL")).first()
    assert (only["n_hit"], only["n_items"], only["contaminated"]) == (2, 0, True)
    kept = decontaminate.remove_documents(rows, bench)
    assert kept.columns == rows.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not wanted(t)[4]}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(rows, bench.filter("item_id = 1")).collect()}
    assert clean[40] == "x y" and clean[41] is None and clean[0] == texts[0]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.contamination(docs, bench).count() == 12


def test_codes_round_trip():
    draw = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), draw.integers(0, 49408, 3000), draw.integers(0, 2**32, 1500), np.full(1024, 300), np.full(512, 7)):
        ids = np.asarray(ids, np.uint32)
        levels = token_store.encode(ids)
        assert token_store.read_range(levels, 0, len(ids)).tolist() == ids.tolist()
        for i in draw.integers(0, max(1, len(ids)), 50 if len(ids) else 0):
            assert token_store.access(levels, int(i)) == ids[i]
            assert token_store.read_range(levels, int(i), len(ids)).tolist() == ids[i:].tolist()


@pytest.mark.parametrize("segment", [40, 1 << 18])
def test_token_store(spark, real, docs, empty, library, tmp_path, segment):
    for name, table in (("real", real), ("odd", docs), ("none", empty)):
        token_store.write_store(table, str(tmp_path / name), segment=segment)
        got = token_store.document_digests(spark, str(tmp_path / name)).orderBy(F.col("start")).collect()
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        start = 0
        assert len(got) == len(rows)
        for r, want in zip(got, rows):
            ids = [*library(want["text"]), 1]
            assert tuple(r) == (want["doc_id"], start, len(ids), crc(ids))
            start += len(ids)


def test_token_at(spark, docs, library, tmp_path):
    token_store.write_store(docs, str(tmp_path / "store"), segment=40)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    ids = [i for r in rows for i in [*library(r["text"]), token_store.END_ID]]
    for i in (0, 1, 41, len(ids) // 2, len(ids) - 1):
        assert token_store.token_at(spark, str(tmp_path / "store"), i) == ids[i]
    for i in (-1, len(ids)):
        with pytest.raises(IndexError):
            token_store.token_at(spark, str(tmp_path / "store"), i)


def test_edit_counts(docs, empty, library):
    encoder, draw = WordEncoder(default_tokenizer()), random.Random(3)
    for _ in range(150):
        text = "".join(draw.choices(["ab", " ", "c'", "\n", "9", "é", ", ", "longer words here "], k=draw.randint(0, 300)))
        counted = edit_counts.CountedText(text, encoder)
        for _ in range(5):
            a = draw.randint(-2, len(text) + 2)
            b, new = a + draw.choice([0, 1, 5, 400]), draw.choice(["", " ", "x", "two words", "\n"])
            low, high = min(max(a, 0), len(text)), min(max(b, a, 0), len(text))
            text = text[:low] + new + text[high:]
            counted.edit(a, b, new)
            assert "".join(counted.parts) == text and counted.tree.total == len(library(text))
    got = {r["doc_id"]: r for r in edit_counts.count_with_edits(docs, edit_counts.revision_edits(F.col("text"))).collect()}
    assert got[0]["tokens_before"] == 0 and got[9]["tokens_before"] == len(library(ODD[9])) and got[9]["encoded_chars"] < len(ODD[9]) / 10
    assert edit_counts.count_with_edits(docs, F.lit(None)).filter("tokens_before <> tokens_after").count() == 0
    assert edit_counts.count_with_edits(empty, F.lit(None)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in edit_counts.recount(docs).collect()}[7] == len(library(ODD[7]))


def test_difference_is_tight_and_keeps_labels():
    sizes = np.random.default_rng(4).integers(16, 9000, 1500).astype(float)
    sums = np.bincount(sharding.difference(sizes, 40), sizes, 40)
    assert np.ptp(sums) <= 16
    start = np.zeros(40)
    start[3] = 90_000
    sums = np.bincount(sharding.difference(sizes, 40, start), sizes, 40) + start
    assert np.ptp(sums) <= 64 and sorted(np.bincount(sharding.difference([5.0, 4, 3], 2), [5.0, 4, 3], 2)) == [5, 7]


def test_sharding(spark, real, docs, empty):
    for table, shards in ((real, 40), (docs, 3)):
        rows = sharding.shard_documents(table, shards).collect()
        assert len(rows) == table.count()
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        where = {}
        for r in rows:
            assert where.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    groups = spark.range(9000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(5000)) + 16).alias("bytes"))
    placed = sharding.assign_groups(groups, 40, large=50, block_groups=1000)
    sums = [r["b"] for r in placed.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert placed.count() == 9000 and len(sums) == 40 and max(sums) - min(sums) <= 200
    assert sharding.shard_documents(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, near):
    least = dict.fromkeys(keys)
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in seen and near(x, y):
                    seen.add(y)
                    todo.append(y)
        least[k] = min(seen)
    return least


def test_trie_links_all_pairs():
    draw = np.random.default_rng(6)
    values = draw.integers(0, 2**63, 300).astype(np.uint64)
    near = values[:40]
    for _ in range(20):
        near = np.unique(np.concatenate([near, near[draw.integers(0, len(near), 30)] ^ (np.uint64(1) << draw.integers(0, 64, 30).astype(np.uint64))]))
    values = np.unique(np.concatenate([values, near]))
    got = {(int(i), int(j)) for a, b in simhash.trie_links(values, np.array([0, len(values)]), 63, 4) for i, j in zip(a, b)}
    i, j = np.where(np.triu(np.bitwise_count(values[:, None] ^ values) <= 4, 1))
    assert got == set(zip(i.tolist(), j.tolist()))


def test_simhash(real, docs, empty):
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    want = brute_components(list(prints), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(real).collect()}
    assert {d: (int(r["fingerprint"], 16), r["component_id"]) for d, r in got.items()} == {d: (prints[d], want[d]) for d in prints}
    assert {r["doc_id"] for r in simhash.deduplicate(real).collect()} == set(want.values())
    odd = simhash.near_duplicates(docs).collect()
    assert len(odd) == 12 and {r["component_id"] for r in odd if r["doc_id"] in (0, 1, 2)} == {0} and {r["component_id"] for r in odd if r["doc_id"] in (4, 5, None)} == {4}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 6, 7, 8, 9]
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_rows_without_id(spark):
    """Groups with and without ids side by side, edited copies in all of them."""
    draw = random.Random(13)
    base = [[f"{draw.choice('abcdefgh')}{draw.randint(0, 999)}" for _ in range(400)] for _ in range(5)]

    def copy(i):  # the same words but for a late one: few bits differ
        return next(t for k in range(200) if (t := " ".join([*base[i][:-1], f"z{k}"])) and 0 < (brute_fingerprint(t) ^ brute_fingerprint(" ".join(base[i]))).bit_count() <= 4)

    whole = [" ".join(b) for b in base]
    rows = [
        (None, whole[0], "nulls"), (None, whole[0], "nulls"), (None, copy(0), "nulls"),  # nulls only
        (7, whole[1], "mixed"), (None, whole[1], "mixed"), (None, copy(1), "mixed"),  # copies of a document with an id
        (None, whole[2], "alone"), (9, whole[3], "ids"), (8, copy(3), "ids"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    want = brute_components(sorted(set(prints)), lambda x, y: (x ^ y).bit_count() <= 4)
    groups = {p: min((d for (d, _, _), q in zip(rows, prints) if d is not None and want[q] == want[p]), default=None) for p in prints}
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 9 and all(r["component_id"] == groups[int(r["fingerprint"], 16)] for r in found)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_fp"]) for r in kept.collect()) == [(0, "alone"), (0, "nulls"), (7, "mixed"), (8, "ids")]


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = set(edges) | {(b, a) for a, b in edges}
    want = brute_components(sorted({x for e in edges if e[0] != e[1] for x in e}), lambda x, y: (x, y) in linked)
    assert got == want


def test_vectors(spark):
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(60, 24))
    near = np.concatenate([c + draw.normal(size=(draw.integers(1, 12), 24)) * 0.17 for c in centres])
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf")] * 24, [1e-200] * 24, [1.0, 1.0]]
    every = [*near.tolist(), *[near[0].tolist()] * 30, *bad]
    rows = spark.createDataFrame([Row(vec_id=i, embedding=v, label=0, n=1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int, n int")
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for v in every]
    unit = [np.array(v) / np.abs(v).max() if ok else None for v, ok in zip(every, fit)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    close = lambda i, j: fit[i] and fit[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    links = {i: sum(close(i, j) for j in range(len(every)) if j != i) for i in range(len(every))}
    want = brute_components(list(links), lambda i, j: i != j and close(i, j))
    for block in (vectors.BLOCK, 5):
        got = {r["vec_id"]: r for r in vectors.near_vectors(rows, block=block).collect()}
        found = sum(r["n_links"] for r in got.values())
        assert len(got) == len(every) and all(got[i]["n_links"] <= links[i] for i in links)
        assert found >= 0.97 * sum(links.values()) and sum(got[i]["component_id"] == want[i] for i in want) >= 0.97 * len(want)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values()) and not any(got[len(near) + 30 + k]["n_links"] for k in range(6))
    assert vectors.near_vectors(rows.limit(0)).count() == 0


@pytest.mark.parametrize("hashes", [2, 3, 6])
def test_vectors_of_mixed_lengths(spark, monkeypatch, hashes):
    monkeypatch.setattr(vectors, "hashes_for", lambda n, dim: hashes)
    draw, every = np.random.default_rng(12), []
    for dim in (16, 512, 768, 1536):
        for _ in range(30):
            one = draw.normal(size=dim)
            every += [one.tolist(), (one * 2 + draw.normal(size=dim) * 1e-6).tolist()]
    rows = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<double>")
    got = vectors.near_vectors(rows).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"]) for r in sorted(got, key=lambda r: r["vec_id"])] == [(i, 1, i - i % 2) for i in range(240)]
    for dim in (512, 513, 768, 1024, 1536):
        codes = vectors.bucket_codes(vectors._unit(draw.normal(size=(40, dim))), hashes)
        assert (codes >= 0).all() and (codes.astype(vectors.code_type(hashes, dim)) == codes).all()


def test_toxicity(spark, sf, real, docs, empty):
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = toxicity.toxicity(rows, labels).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert right >= 0.94 and sum(r["predicted"] and not r["toxic"] for r in got) <= 0.02 * len(got)
    odd = toxicity.toxicity(docs, labels)
    assert odd.count() == 12 and odd.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    kept = toxicity.remove_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 12 and toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_sample(spark):
    labels = spark.range(12000).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).cast("int").alias("toxic"))
    assert {r["toxic"]: r["count"] for r in toxicity.sample(labels).groupBy("toxic").count().collect()} == {0: 2500, 1: 2500}


def test_quality(spark, sf, docs, empty):
    folder = sf.replace("sf0.001", "sf0.01")
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality(rows).join(labels, "doc_id").select("good", "quality").collect()
    assert sum(r["good"] == r["quality"] for r in got) >= 0.97 * len(got)
    assert sum(r["quality"] and not r["good"] for r in got) <= 0.01 * len(got)
    assert quality.quality(docs).filter("score IS NOT NULL").count() == 12 and quality.quality(empty).count() == 0
    kept = quality.remove_poor(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == 12


def test_automaton_and_phrases():
    draw = random.Random(10)
    text = [draw.randint(1, 3) for _ in range(60)]
    table = langid.automaton(text, 5)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(80):
        query = [draw.randint(1, 4) for _ in range(draw.randint(0, 25))]
        count, open_ = 0, ()
        for c in query:
            if (*open_, c) in inside:
                open_ = (*open_, c)
            else:
                count, open_ = count + (1 if open_ else 0), (c,)
                if open_ not in inside:
                    count, open_ = count + 1, ()
        count += bool(open_)
        blocks = np.zeros((25, 1), np.int64)
        blocks[: len(query), 0] = query
        assert abs(int(langid.phrases(table, blocks, np.array([len(query)]))[0]) - count) <= 1


def test_language(spark, sf, docs, empty):
    rows = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = langid.languages(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = {r["doc_id"]: r for r in langid.languages(docs.unionByName(rows.limit(50).select("doc_id", "text", "lang", "source", "n_chars"), True)).collect()}
    assert odd[None]["lang_pred"] != "und"
    alone = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs.filter("doc_id IS NOT NULL")).collect()}
    assert set(alone.values()) == {"und"} and langid.languages(empty).count() == 0


def test_pipeline(spark, sf, docs, library):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    first = rows = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, rows, sf)
        assert after.columns == first.columns
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in rows.select("doc_id").collect()}
        rows = after
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == rows.count()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), sf).count() == 0
    # odd documents: nulls, repeats, clashing columns; what each stage keeps of them, row for row
    given = [tuple(r) for r in docs.collect()]
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = lambda name: [tuple(r) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()]
    less = lambda rows: sorted(map(repr, rows))
    toxic = toxicity.toxicity(docs, labels).select("doc_id", "predicted").collect()
    assert less(r[0] for r in kept("toxicity")) == less(r["doc_id"] for r in toxic if not r["predicted"])
    good = quality.quality(docs).select("doc_id", "good").collect()
    assert less(r[0] for r in kept("quality")) == less(r["doc_id"] for r in good if r["good"])
    bad = {r["mark"] for r in decontaminate.contamination(docs, bench).filter("contaminated").select("mark").collect()}
    marks = {r["text"]: r["m"] for r in docs.select("text", F.xxhash64("text").alias("m")).collect()}
    assert less(kept("decontamination")) == less(r for r in given if marks[r[1]] not in bad)
    groups = {}
    for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    left = kept("near_duplicates")
    assert set(map(repr, left)) <= set(map(repr, given)) and len({r[0] for r in left}) == len(left) == len(groups)
    assert all(sum(r[0] in ids for r in left) == 1 for ids in groups.values())
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, sf)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(library(r[1])) + 1 for r in given)
