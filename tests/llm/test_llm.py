"""Brute-force and edge-case tests of the numbered operators."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from riskflow.llm import (
    common, decontaminate, language_gru, mixing, multi_index, quality_rules, run_index, sharding, simhash,
    toxicity, warc,
)
from riskflow.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Size` string, target int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} and some more words here {i % 7} " * (i % 5 + 1), "en", f"s{i % 3}", 1, "x", i) for i in range(60)]
    rows += [(None, "null id text", "en", None, None, None, None), (61, None, None, None, None, None, None),
             (62, "", "fr", "s0", 0, "", 0), (63, "same row", "fr", "s1", 8, "y", 1), (63, "same row", "fr", "s1", 8, "y", 1),
             (64, "long " * 30_000, "de", "s2", 1, "z", 2)]
    return spark.createDataFrame(rows, SCHEMA)


def sizes_of(pdf):
    return pdf.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "max"))


def test_mix_hits_targets(spark, docs):
    got = mixing.mix_sizes(docs).toPandas()
    assert len(got) == docs.count()
    assert (got["taken"] <= 3 * got["size"]).all()
    for row in sizes_of(got).itertuples():
        assert abs(row.taken - row.target) <= row.n
    again = mixing.mix_sizes(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mix_rows_follow_the_plan(spark, docs):
    plan = mixing.mix_sizes(docs).toPandas()
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = out.select(common.word_count(out["text"]).alias("w")).toPandas()["w"].sum()
    assert taken == plan["taken"].sum()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_sizes(docs.limit(0)).count() == 0


def test_targets_stop_at_the_cap(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sources.withColumn("n_units", sources.source_size)).collect()}
    assert got["b"] == 30 and got["c"] == 30 and got[None] == 0
    assert got["a"] == pytest.approx(960)


def test_shards_are_exact(spark, docs):
    got = sharding.shard_rows(docs, shards=7).toPandas()
    counts = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    table = sharding.shard_table(docs, shards=7)
    assert table.columns == [*docs.columns, "shard", "slot"] and table.count() == len(got)
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    rows = np.array([sharding.draw_counts(rng, np.array([30, 20, 50]), 40) for _ in range(4000)])
    assert (rows.sum(axis=1) == 40).all()
    assert np.allclose(rows.mean(axis=0), [12, 8, 20], atol=0.2)
    big = np.array([sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(3000)], dtype=float)
    assert abs(big.mean() - 4e5) < 60 and abs(big.std() / np.sqrt(1e6 * 0.4 * 0.6) - 1) < 0.06


def test_shuffle_is_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    df = spark.createDataFrame([(i, "t") for i in range(200)], "doc_id long, text string")
    seen = np.zeros((2, 4))
    for seed in range(30):
        got = sharding.shard_rows(df, shards=4, seed=seed).toPandas()
        for half in (0, 1):
            seen[half] += np.bincount(got[got["doc_id"] // 100 == half]["shard"], minlength=4)
    assert np.abs(seen / seen.sum() - 0.125).max() < 0.02


def simhash_of(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(ids, prints, distance=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, v in enumerate(ids):
        least.setdefault(find(i), []).append(v)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_against_all_pairs(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash_of(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], components_of([r.doc_id for r in rows], prints)))
    got = Counter(tuple(r) for r in simhash.near_duplicate_classes(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({w[2] for w in want})
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0


def test_link_forest_of_many_near_prints():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(3000)], dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base[rng.integers(0, 3, 3000)] ^ flips]))
    a, b = simhash.links(prints, 3, 6)
    c, d = simhash._forest(prints, 3)
    assert (np.bitwise_count(a ^ b) <= 3).all() and len(c) <= len(prints)

    def classes(x, y):
        root = {int(p): int(p) for p in prints}

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v
        for p, q in zip(x.tolist(), y.tolist()):
            s, t = find(p), find(q)
            root[max(s, t)] = min(s, t)
        return [find(int(p)) for p in prints]

    assert classes(a, b) == classes(c, d)


def test_templates_catch_other_numbers(spark):
    bench = spark.createDataFrame(
        [(1, "A train leaves the station at 40 km per hour and meets Anna after 3 hours, how far is 40 km from town"), (2, None), (3, ""),
         (4, "short item")], "item_id long, text string")
    rows = [
        (1, "Intro text. A train leaves the station at 55 km per hour and meets Berta after 9 hours, how far is 55 km from town and so on", "x"),
        (2, "Intro text. A train leaves the station at 55 km per hour and meets Berta after 9 hours, how far is 71 km from town and so on", "x"),
        (3, "nothing of the kind is in this text at all, it is only about trains", "x"), (4, None, "x"), (5, "", "x"), (6, "a short item here", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = {(r.id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (6, 4)} and got[1, 1].changed_slots > 0
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 6
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def cut_of(texts, length):
    blobs = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many", [4096, 1])
def test_repeats_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(run_index, "MANY", many)
    rng = np.random.default_rng(3)
    shared = ["".join(rng.choice(list("abcdé "), 90)) for _ in range(4)]
    texts = [
        "".join(shared[rng.integers(4)] if rng.random() < 0.5 else "".join(rng.choice(list("xyz"), 30)) for _ in range(rng.integers(1, 8)))
        for _ in range(60)
    ] + ["q" * 700, None, "", "tail " * 100, texts_copy := "copy " * 60, texts_copy]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = run_index.cut_repeats(df, length=50, gram=16)
    assert sorted(tuple(r) for r in got.select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == cut_of(texts, 50)
    assert run_index.cut_repeats(df.limit(0)).count() == 0


def test_run_index_streams_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(60):
        width, length = int(rng.integers(1, 4)), int(rng.integers(3, 12))
        blobs = [bytes(rng.integers(0, width, rng.integers(length, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        count = Counter(b[i:i + length] for b in blobs for i in range(len(b) - length + 1))
        for b, got in zip(blobs, run_index.repeated_windows(blobs, length)):
            assert list(got) == [i for i in range(len(b) - length + 1) if count[b[i:i + length]] > 1]


def test_warc_round_trip(spark, tmp_path):
    rows = [
        (1, "u", "x" * 200), (1, "u", "x" * 200), (2, None, "x" * 200), (None, "v\nw", "x" * 200), (5, "a", None), (5, "a", None),
        (6, "b", "abc"), (7, "c", "q\r\n\r\nWARC/1.1\r\nfoo: 1\r\n\r\n" + "z" * 150), (8, "d", "tail\r\n\r\n"), (9, "e", "y" * 120 + "\r"),
        (10, "é", "é\r\n\r\né" * 60), (11, "f", "WARC/1.1\r\n"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_index(df).collect())
    want = Counter()
    seen_first = False
    for page, _, html in rows:
        same = html == "x" * 200
        kind = "revisit" if same and (page != 1 or seen_first) else "response"
        seen_first |= same and page == 1
        want[page, len((html or "").encode()), digest(html), kind, 1 if kind == "revisit" else None] += 1
    assert got == want
    assert warc.archive_index(df.limit(0)).count() == 0


def test_nearest_finds_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[700:] = x[3]
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(900)]
    rows += [(900, None, 0), (1000, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1200, [1.0, None] + [1.0] * 14, 0), (0, [float(v) for v in x[0]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = multi_index.nearest(df).toPandas()
    hit = n = 0
    for q, part in got.groupby("query_id"):
        gap = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        gap[q] = np.inf
        want = np.lexsort((np.arange(900), gap))[:10]
        part = part.sort_values("rank")
        assert np.allclose(part["score"], gap[part["id"]], rtol=1e-12)
        hit, n = hit + len(set(part["id"]) & set(want)), n + 10
    assert set(got["query_id"]) == set(range(0, 900, 100)) and hit / n >= 0.9
    assert multi_index.nearest(df.limit(0)).count() == 0


def test_substring_probing_is_exhaustive():
    codes = np.random.default_rng(2).integers(0, 256, (500, 8)).astype(np.uint8)
    index = multi_index.SubstringIndex(codes)
    for radius in (0, 9, 20, 28):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(axis=1) <= radius)
        assert (index.within(codes[7], radius) == want).all()


def test_decoder_restores_words(spark, small_dir):
    costs = toxicity.language_model(toxicity.count_characters(common.table(spark, small_dir, "documents"), "text"))
    decoder = toxicity.Decoder(costs)
    assert decoder.restore("a clean text, with 3 numbers") == "a clean text, with 3 numbers"
    assert decoder.restore("s t u p i d") == "stupid" and decoder.restore("i.d.i.o.t") == "idiot"
    assert decoder.restore("m0r0n") == "moron" and decoder.restore(None) == ""


@pytest.mark.parametrize("score,label", [(toxicity.score_toxicity, "toxic"), (quality_rules.score_quality, "quality")])
def test_scores_of_edge_rows(spark, docs, score, label):
    rows = [(i, i % 2) for i in range(40)] + [(None, 1), (61, None)]
    labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
    for truth in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        got = score(docs, truth).toPandas()
        assert len(got) == docs.count() and got["score"].between(0, 1).all() and set(got["predicted"]) <= {0, 1}
    assert score(docs.limit(0), labels).count() == 0


def test_gradients_match_differences():
    net = language_gru.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, n = language_gru.pack([b"abc", b"de", b"fghij"])
    y = np.array([0, 1, 2])
    _, grads = net.gradients(x, n, y)
    for name in ("uf", "xb", "o", "vb"):
        place = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, eps = net.w[name][place], 1e-2
        net.w[name][place] = keep + eps
        up, _ = net.gradients(x, n, y)
        net.w[name][place] = keep - eps
        down, _ = net.gradients(x, n, y)
        net.w[name][place] = keep
        assert grads[name][place] == pytest.approx((up - down) / (2 * eps), rel=0.05)


def test_languages_of_edge_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(language_gru, "STEPS", 40)
    got = {(r.doc_id, r.lang_pred) for r in language_gru.identify(docs).collect()}
    assert (61, "und") in got and (62, "und") in got
    none = language_gru.identify(docs.where("lang is null"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_gru.identify(docs.limit(0)).count() == 0


def test_held_out_quality(spark, small_dir):
    sf = small_dir.replace("sf0.001", "sf0.01")
    labels = common.table(spark, sf, "labels").toPandas()
    for name, label, floor in (("op3_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.93)):
        got = QUERIES[name](spark, sf).toPandas().merge(labels, on="doc_id")
        out = got[got["held_out"]]
        assert (out["predicted"] == out[label]).mean() >= floor, name


def test_pages_agree_with_sql(spark, small_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small_dir}/pages.parquet'")
    want = sorted(map(str, con.sql(ORACLES["op5_warc"]).fetchall()))
    got = sorted(str(tuple(r)) for r in QUERIES["op5_warc"](spark, small_dir).collect())
    assert got == want


def test_pipeline_stages_chain(spark, small_dir):
    import corpus_pipeline

    docs = common.table(spark, small_dir, "documents")
    columns, rows = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES:
        before = docs.count()
        docs = function(spark, docs, small_dir)
        docs = mixing.stage(docs, "test-pipeline")
        if name not in ("mix_sources", "shard"):
            assert docs.count() <= before
        if name == "shard":
            assert docs.count() == before
        else:
            assert docs.columns == columns, name
    assert docs.columns == [*columns, "shard", "slot"] and 0 < docs.count() <= 3 * rows


def test_segments_are_sorted_out_alike_at_any_frame_size(monkeypatch):
    monkeypatch.setattr(run_index, "MANY", 5)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({
        "h": rng.integers(0, 12, 300) ** 2 // 12, "f1": rng.integers(0, 9, 300), "f2": 0, "k1": np.arange(300),
        "k2": 0, "first": 0, "n": 1, "kind": rng.choice([0, 1, 1, 2], 300),
    }).sort_values(["h", "f1", "f2"], kind="stable").reset_index(drop=True)

    def run(size):
        frames = (rows.iloc[i:i + size] for i in range(0, len(rows), size))
        out = pd.concat(list(run_index._sort_out(frames)))
        return sorted(zip(out["k1"].astype(int), out["kind"].astype(int)))

    open_ = rows[rows["kind"] > 0]
    kinds = open_.groupby("h")["f1"].nunique()
    want = [(r.k1, 0) for r in rows[rows["kind"] == 0].itertuples()]
    for (h, _), group in open_.groupby(["h", "f1"]):
        again = len(group) > 1 or (group["kind"] == 2).any()
        first = 0 if kinds[h] == 1 else (4 if again else 3) if kinds[h] > 5 else 2 if again else 1
        if again or kinds[h] > 1:
            want += [(group["k1"].iloc[0], first), *((k, 0) for k in group["k1"].iloc[1:])]
    assert all(run(size) == sorted(want) for size in (1, 2, 7, 40, 300))
