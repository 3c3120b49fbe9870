"""Brute-force and edge-case tests of lexical search, packing and hard-negative mining."""

import functools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import hard_negatives, lexical, packing
from riskflow.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, rank int, `Score` double, terms string, item_id long, length int, `piece` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5, "x", 7, 3, 9) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x-y", "a_b", "Z9", "日本"]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 60]) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    rows += [(1000 + i, "w1 w2 w3 Été") for i in range(25)]  # ties
    rows += [(1000, "w1 w2 w3 Été"), (None, "w1 w2 w3 Été w4"), (2000, None), (2001, ""), (2002, "--- !!"),
             (2003, "w5 " * 50_000), (2004, "q" * 300_000)]
    return rows


def brute_ranks(docs, items, k=10):
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(lexical.TERM, t or "")]
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(w for _, c, _ in held for w in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * len(held) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1)))
                * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
                for w, q in Counter(words(text)).items() if c[w]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out[item] = [(r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return {i: r for i, r in out.items() if r}


@pytest.mark.parametrize("block", [100, 3_000, 1_000_000])
def test_lexical_ranks_equal_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(lexical.search_blocks, "__defaults__", (block,))
    items = [(1, "w1 W2 w3 été"), (2, "Été w5 w5 w59"), (3, None), (4, ""), (5, "nowhere"), (6, "日本 x y"),
             (7, "w1 " * 3000), (None, "Z9 w7")]
    got = defaultdict(list)
    for r in lexical.ranked(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    assert {i: sorted(r) for i, r in got.items()} == brute_ranks(texts, items)


def test_lexical_terms_and_passes(spark, texts, monkeypatch):
    items = [(i, f"w{i} w{i + 1} Été") for i in range(20)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, lexical.ranked(frame(spark, texts), asked).collect()))
    monkeypatch.setattr(lexical, "PASS_TERMS", 15)
    assert sorted(map(tuple, lexical.ranked(frame(spark, texts), asked).collect())) == one
    got = frame(spark, texts).select(lexical.term_column(F.col("text"))).collect()
    assert [[w.encode() for w in r[0]] for r in got] == [lexical.terms_of(t) for _, t in texts]
    none = frame(spark, []), asked.limit(0)
    assert lexical.ranked(none[0], asked).count() == 0 == lexical.ranked(frame(spark, texts), none[1]).count()


def test_lexical_search_opens_few_intervals():
    """Bounds cut the search short: documents that cannot be among the first are not scored."""
    rng = np.random.default_rng(1)
    doc = np.repeat(np.arange(4000), 10)
    term = rng.integers(0, 200, len(doc))
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    block = lexical.Block(doc, term, rng.integers(1, 1000, len(doc)), 4000)
    queries = lexical.Queries(np.array([0, 3]), np.array([3, 50, 120]), np.array([1, 2, 1]))
    best = lexical.Best(1, 10)
    scored = lexical.search(block, queries, np.full(200, 7), best, np.arange(4000))
    dense = np.zeros((200, 4000), dtype=np.int64)
    dense[block.key // 4000, block.doc] = block.impact
    want = 7 * (dense[3] + 2 * dense[50] + dense[120])
    order = np.lexsort((np.arange(4000), -want))[:10]
    assert best.place.tolist() == order.tolist() and best.score.tolist() == want[order].tolist()
    assert scored < 200 < (want > 0).sum()


def test_range_maxima():
    rng = np.random.default_rng(2)
    block = lexical.Block(np.arange(300), np.zeros(300, dtype=np.int64), rng.integers(0, 50, 300), 300)
    low = rng.integers(0, 299, 500)
    high = np.array([rng.integers(a + 1, 301) for a in low])
    assert [block.impact[a:b].max() for a, b in zip(low, high)] == block.impact[block.best(low, high)].tolist()


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_those_of_the_tokenizer(texts):
    encoder = packing.Encoder.of(packing.default_tokenizer())
    assert encoder.by_rank
    odd = ["a  b\n\n c", " x", "I'm 12½ ok", " 　é", "日本 語", " " * 20_000 + "x", "don't\tstop", "\n"]
    for text in [t for _, t in texts if t] + odd:
        assert encoder(text) == struct.pack(f"<{len(ids_of(text)) - 1}I", *ids_of(text)[:-1]), text[:50]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_is_whole_and_tight(spark, texts, rule):
    got = packing.pack_documents(frame(spark, texts), capacity=64, rule=rule).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = Counter()
    for i, text in texts:
        ids = ids_of(text)
        over = len(ids) % 64
        cuts = ([(0, over)] if over else []) + [(a, 64) for a in range(over, len(ids), 64)]
        for piece, (a, n) in enumerate(cuts):
            want[(i, piece, a, n, zlib.crc32(struct.pack(f"<{n}I", *ids[a:a + n])))] += 1
    rows = got.astype(object).where(got.notna(), None)
    have = Counter((r.doc_id if r.doc_id is None else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert have == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 64) * 1.02 + 1
    empty = packing.pack_documents(frame(spark, []))
    assert empty.count() == 0 and empty.columns == list(got.columns)


def one_by_one(lengths, full, weights, rule):
    """Vector best fit row by row."""
    bins, w, full = [], np.array(weights), np.array(full, dtype=float)
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], dtype=float)
        able = [i for i, left in enumerate(bins) if (left >= need).all()]
        if not able:
            bins.append(full - need)
            continue
        if rule == "norm":
            best = min(able, key=lambda i: (w * ((bins[i] - need) / full) ** 2).sum())
        else:
            best = max(able, key=lambda i: (w * (bins[i] / full) * (need / full)).sum())
        bins[best] = bins[best] - need
    return sorted(tuple(b) for b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents,attention", [(None, None), (3, None), (None, 2_000), (4, 3_000)])
def test_plan_is_vector_best_fit(rule, documents, attention):
    rng = random.Random(11)
    for _ in range(6):
        lengths = [rng.randint(1, 40) for _ in range(300)]
        plan = packing.lay_out(dict(Counter(lengths)), 100, documents, attention, rule=rule)
        got = sorted(tuple(map(float, g.left)) for g in plan for _ in range(g.n))
        full = (100, documents or 100, attention or 10_000)
        assert got == one_by_one(lengths, full, packing.WEIGHTS, rule)
        assert all((g.left >= 0).all() for g in plan)
        assert sum(g.n * each for g in plan for _, _, each, _ in g.holds) == 300
    with pytest.raises(ValueError):
        packing.lay_out({50: 1}, 100, attention=2_000)


def test_every_capacity_holds(spark):
    docs = frame(spark, [(i, "word " * (i % 30)) for i in range(300)])
    pieces = packing.stage(packing.token_pieces(docs, capacity=64), "test-pieces")
    got = packing.pack(pieces, capacity=64, documents=5, attention=2_100 * 2).toPandas()
    per = got.assign(cost=got["length"] ** 2).groupby("sequence_id").agg(n=("length", "size"), t=("length", "sum"), c=("cost", "sum"))
    assert (per["n"] <= 5).all() and (per["t"] <= 64).all() and (per["c"] <= 4_200).all() and len(got) == 300


def test_sequences_hold_the_ids(spark):
    rows = [(i, f"some text {i} " * (i % 9)) for i in range(40)] + [(1, "some text 1 "), (None, None)]
    got = packing.sequences(frame(spark, rows), capacity=32).collect()
    flat = Counter(tuple(r.ids[a:a + n]) for r in got for a, n in zip(np.cumsum([0, *r.lengths[:-1]]), r.lengths))
    want = Counter()
    for _, text in rows:
        ids = ids_of(text)
        for a, n in packing.cut(len(ids), 32):
            want[tuple(ids[a:a + n])] += 1
    assert flat == want and all(len(r.ids) <= 32 for r in got)


VECTORS = "vec_id long, embedding array<float>, label int, node long, `key` string, rank int, score double"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "k", 2, 3.0) for i, v, y in rows], VECTORS)


def brute_negatives(rows):
    held = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y) for i, v, y in rows
            if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, y in held:
        if i % 10:
            continue
        near = sorted((-dot(v, u), j) for j, u, z in held if z == y and j != i)[:5]
        for s, p in near:
            ps = -s
            found = sorted((-dot(v, u), j) for j, u, z in held if z != y and 80 * ps <= 100 * dot(v, u) <= 100 * ps)[:5]
            out += [(i, p, r + 1, j, ps, -t) for r, (t, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("fan,leaf", [(4, 20), (16, 64), (3, 10_000)])
def test_hard_negatives_equal_brute_force(spark, fan, leaf):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.3, size=8)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(500 + i, [0.5] * 8, i % 3) for i in range(60)]  # copies
    rows += [(500, [0.5] * 8, 0), (700, [0.0] * 8, 1), (710, [0.1] * 3, 1), (720, None, 1), (730, [0.1] * 8, None),
             (740, [float("nan")] + [0.1] * 7, 1), (750, [None] + [0.1] * 7, 1), (760, [float("inf")] * 8, 2), (None, [0.2] * 8, 1),
             (770, [], 2), (780, [1.0] * 8, 9)]
    got = hard_negatives.hard_negatives(
        vector_frame(spark, rows), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0, fan=fan, leaf_rows=leaf
    )
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_ranges_eliminate_subtrees(spark):
    """Far clusters are left out of a search, and no row within a window is."""
    rng = np.random.default_rng(4)
    rows = [(i, (30 * np.eye(6)[i % 6] + rng.normal(size=6)).astype(int).tolist()) for i in range(600)]
    df = spark.createDataFrame([(i, i, 0, v) for i, v in rows], "key long, id long, label int, vec array<long>")
    norm = max(sum(x * x for x in v) for _, v in rows)
    tree = hard_negatives.Tree.grow(df, hard_negatives._Space(6, norm, 40), fan=6, leaf_rows=20)
    low = 700
    asked = df.where("id < 30").withColumns({"low": F.array(F.lit(low)), "high": F.array(F.lit(None).cast("long"))})
    visits = tree.reached(asked).select("key", "node").distinct().toPandas()
    leaf = dict(map(tuple, tree.leaves.select("id", "node").collect()))
    seen = set(map(tuple, visits.to_numpy().tolist()))
    for i, v in rows[:30]:
        assert all((i, leaf[j]) in seen for j, u in rows if np.dot(v, u) >= low)
    assert len(seen) < 0.4 * 30 * len(set(leaf.values()))
    assert sorted(leaf) == list(range(600))


def test_hard_negatives_of_nothing(spark):
    run = lambda rows: hard_negatives.hard_negatives(
        vector_frame(spark, rows), "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0
    ).collect()
    assert run([]) == [] and run([(10, [1.0], 1)]) == [] and run([(10, [1.0], 1), (11, [1.0], 1)]) == []
    assert [tuple(r) for r in run([(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)])] == [(10, 11, 1, 12, 65536, 256 * 230)]


def test_queries_equal_their_sql(spark, small_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {name} as select * from '{small_dir}/{name}.parquet'")
    for name in ("op11_lexical_search", "op13_hard_negatives"):
        want = con.sql(ORACLES[name])
        got = QUERIES[name](spark, small_dir).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()), name
