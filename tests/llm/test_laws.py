"""Laws and recomputed results: big draws, shard cells, mixing targets, languages, rules, archive ids."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import common, language_gru, mixing, quality_rules, sharding, warc


@pytest.mark.parametrize("good", [3, 10, 40])
def test_big_draws_follow_the_law(good):
    """Few good ones of 2e9, half of all drawn: binomial to nine digits."""
    rng = np.random.default_rng(good)
    draws = 20_000
    seen = np.bincount([sharding.hypergeometric(rng, good, 2 * 10**9 - good, 10**9) for _ in range(draws)], minlength=good + 1)
    want = np.array([math.comb(good, k) * 0.5**good for k in range(good + 1)]) * draws
    big = want >= 5
    chi = ((seen[big] - want[big]) ** 2 / want[big]).sum()
    assert chi < big.sum() + 4 * math.sqrt(2 * big.sum())
    assert seen.sum() == draws and len(seen) == good + 1


def test_only_letters_are_letters():
    assert [bool(language_gru._LETTER.search(t)) for t in ("½ ²", "Ⅷ ①", "12_", "", "é", "9日", "ʰ")] == [False] * 4 + [True] * 3


def _plain_targets(sizes, cap=3.0):
    """Weights 1, 2, 3 by code point, null last; what is above the cap is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - cap * sum(sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else weight[s] * left / share for s in names}
        over = {s for s in names if target[s] > cap * sizes[s] and s not in full}
        if not over:
            return target
        full |= over


def test_mixing_targets_and_sizes_recomputed(spark, small_dir):
    docs = common.table(spark, small_dir, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("source")
    )
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 50 == 1, "Ärger").when(F.col("doc_id") == 2, "z").otherwise(F.col("source")))
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    sizes = {}
    for source, n in words.values():
        sizes[source] = sizes.get(source, 0) + n
    target = _plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(words)
    for r in got:
        source, n = words[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and r.target == pytest.approx(target[source])
        assert n == 0 or (r.taken % n == 0 and abs(r.taken / n - target[source] / sizes[source]) < 1)
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= max(n for s, n in words.values() if s == source)


def test_cells_have_the_hypergeometric_mean_and_variance(spark):
    """Rows of each partition for each shard over many seeds, against n K (N - K) (N - n) / N^2 (N - 1)."""
    sizes = spark.createDataFrame([(0, 30), (1, 10), (2, 20)], "part int, n long")
    seen = []
    for seed in range(60):
        rows = sharding.communication_matrix(sizes, 3, seed).orderBy("part").collect()
        seen.append([r.counts for r in rows])
    seen = np.array(seen, dtype=float)
    assert (seen.sum(axis=2) == [30, 10, 20]).all() and (seen.sum(axis=1) == 20).all()
    for i, n in enumerate((30, 10, 20)):
        mean, var = n / 3, n * 20 * 40 * (60 - n) / (3600 * 59)
        assert np.abs(seen[:, i].mean(axis=0) - mean).max() < 4.5 * math.sqrt(var / 60)
        assert (np.abs(seen[:, i].var(axis=0, ddof=1) / var - 1) < 0.9).all()


def test_shards_carry_sizes_and_checksums(spark, small_dir):
    docs = common.table(spark, small_dir, "documents")
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = sharding.shard_rows(docs).collect()
    assert len(got) == len(text)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got)


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(4)
    net = language_gru.Network(3)
    for k in net.w:
        net.w[k] = rng.normal(0, 0.4, net.w[k].shape).astype(np.float32)
    return net


def test_labeller_equals_the_network_text_by_text(network):
    texts = ["some words some more", "один два три", "", None, "x" * 100 + " y", "日本語のテキスト " * 3, "a"]
    got = language_gru.Labeller(network).documents(texts)
    for text, row in zip(texts, got):
        parts = [p for w in (text or "").encode().split() for p in language_gru.pieces(w)]
        total, n = np.zeros(3), 0
        for part in parts:
            x, length = language_gru.pack([part])
            total += network.label(x, length).sum(axis=(0, 1))
            n += int(length[0])
        assert np.allclose(row, total / max(1, n), atol=1e-5)


def test_languages_held_out_and_rare(spark, small_dir, monkeypatch):
    """Given rows, a language of few documents in a script of its own, and one given text with a third of all rows."""
    monkeypatch.setattr(language_gru, "STEPS", 500)
    docs = common.table(spark, small_dir, "documents").select("doc_id", "text", "lang")
    n = docs.count()
    words = ["привет", "дорога", "солнце", "вечер", "машина", "книга", "работа", "город"]
    rare = spark.createDataFrame(
        [(10**6 + i, " ".join(words[(i + j * (i % 3 + 1)) % 8] for j in range(30)), "ru") for i in range(12)], docs.schema
    )
    common_text = docs.where("lang = 'en' and length(text) > 50").orderBy("doc_id").first().text
    copies = spark.range(n // 2).select(
        (F.col("id") + 2 * 10**6).alias("doc_id"), F.lit(common_text).alias("text"), F.lit("en").alias("lang")
    )
    whole = docs.unionByName(rare).unionByName(copies)
    got = language_gru.identify(whole).join(whole, "doc_id").where("held_out and lang is not null").toPandas()
    got = got[got["lang_pred"] != "und"]
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.95
    assert (got[got["lang"] == "ru"]["lang_pred"] == "ru").all() and (got["lang"] == "ru").any()


def test_rules_score_as_a_walk_in_python(spark):
    rules = [(((0, "<=", 2.0),), 0.7), (((0, ">", 2.0), (1, "<=", 5.0)), -1.1), (((1, ">", 5.0),), 0.2)]
    ops = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    points = [(float(a), float(b)) for a in (0, 2, 3) for b in (4, 5, 6)]
    df = spark.createDataFrame(points, "s double, t double")
    got = df.select("s", "t", quality_rules.score_column(rules, -0.3, ["s", "t"]).alias("p")).collect()
    for r in got:
        z = -0.3 + sum(w for rule, w in rules if all(ops[op]((r.s, r.t)[i], at) for i, op, at in rule))
        assert r.p == pytest.approx(1 / (1 + math.exp(-z)))


def test_archive_ids_of_any_type(spark):
    """Text ids with blanks, line breaks and signs; an empty one; one that reads null; repeated short rows."""
    ids = ["a b", "a%20b", "a+b", "x\r\ny", "", "null", None, "é/ü", "z", "z"]
    rows = [(i, "u", "p" * 20) for i in ids] + [(i, None, "q" * 300) for i in ids]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("payload", F.lit(1)).withColumn("record", F.lit("r"))
    got = warc.archive_index(pages).collect()
    key = lambda v: (v is None, v or "")
    assert sorted((r.page_id for r in got), key=key) == sorted(ids * 2, key=key)
    assert sum(r.record_type == "response" for r in got) == len(ids) + 1
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {""}
