"""Ranked lexical search with range-maximum tables over posting lists.

One scan turns every document into its length and the occurrences of the terms that some
query asks for. Document frequencies, the number of documents and their total length come
from all of them. Then blocks of documents are indexed: each term's posting list has the
impact of every posting and a sparse table of range maxima over them.

A query starts with one interval, the whole block. The bound of an interval is the sum,
over the query's terms, of the largest impact that the term's list has inside it, one
look-up in its table each. Intervals are taken best bound first and split at the document
where the term that weighs most has its largest impact: that document is scored exactly,
and what lies left and right of it gets bounds of its own. Intervals whose bound cannot
reach the k-th best score found so far are never opened. Many queries and their best few
intervals are worked on together, as arrays.

Blocks are cut from the partitions of the staged postings, so no posting is shuffled; each
task returns at most k documents a query, which are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.llm.common import col, row_hash, small_batches
from riskflow.workspace import stage

#: Fixed value: a term is a run of letters and digits, or of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents returned for each query.
TOP = 10
#: Weight of a document's length in its measure, in hundredths.
LENGTH_SHARE = 75
#: Postings that are indexed together, about, and (query, term) pairs asked in one pass, about.
BLOCK_POSTINGS, PASS_TERMS = 1_000_000, 400_000
#: Of a query's open intervals, the best of which share is split in one step, and how many at least.
STEP_SHARE, STEP_LEAST = 2, 16

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, only A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def term_column(text: Column) -> Column:
    """The same as a column."""
    found = F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.translate(t, upper, lower))


def count_terms(docs: DataFrame, id_col: str, text_col: str, wanted: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) per document with a term: its length and its wanted terms, by number."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
    ])
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # at most PASS_TERMS and one query's terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            at, lengths, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    found = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                    at.append(i)
                    lengths.append(len(words))
                    terms.append([t for t, _ in found])
                    counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
                ],
                schema.names,
            )

    return docs.select(col(id_col).alias("id"), col(text_col).alias("t")).mapInArrow(count, schema)


@dataclass(frozen=True)
class Statistics:
    """Counts over all documents: documents with a term, all their terms, documents of each term."""

    documents: int
    length: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        ratio = (2 * self.documents + 2) / (2 * self.holding.astype(np.float64) + 1)
        return np.floor(1000 * np.log(ratio)).astype(np.int64)

    def impacts(self, n: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The part of a posting's score that its document gives, before the term's weight."""
        measure = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * self.documents) // self.length
        return (1_000_000_000 * count) // (1000 * count + 8 * measure)


@dataclass(frozen=True)
class Queries:
    """Distinct terms of each query, one query after another, and how often each is asked."""

    start: np.ndarray
    term: np.ndarray
    times: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1


class Block:
    """Posting lists of some documents, each with its impacts and their range maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.key = term[order].astype(np.int64) * n_docs + doc[order]
        self.doc = doc[order]
        self.impact = impact[order]
        longest = int(np.bincount(term).max()) if len(term) else 0
        # Row j holds where the largest of 2 ** j neighbouring impacts stands; the first of equals.
        self.table = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            half = 1 << (len(self.table) - 1)
            a, b = self.table[-1][:-half], self.table[-1][half:]
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a))
        self.offset = np.cumsum([0, *map(len, self.table)])
        self.flat = np.concatenate(self.table)

    def best(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the largest impact of each non-empty range stands."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        a = self.flat[self.offset[level] + low]
        b = self.flat[self.offset[level] + high - (1 << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def find(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where each term's list reaches a document or passes it."""
        return np.searchsorted(self.key, term * self.n_docs + doc)


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` owners, which come in order; exact."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(owner, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


@dataclass
class _Open:
    """Intervals (query, first document, end, bound) and their non-empty lists, interval by interval."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bound: np.ndarray
    owner: np.ndarray  # interval of each list
    term: np.ndarray
    weight: np.ndarray
    a: np.ndarray  # range of each list
    b: np.ndarray
    top: np.ndarray  # its largest impact

    def pick(self, keep: np.ndarray) -> _Open:
        number = np.cumsum(keep) - 1
        lists = keep[self.owner]
        return _Open(
            self.query[keep], self.low[keep], self.high[keep], self.bound[keep], number[self.owner[lists]],
            *(x[lists] for x in (self.term, self.weight, self.a, self.b, self.top)),
        )


def _bounded(block: Block, query, low, high, owner, term, weight, a, b) -> _Open:
    """Intervals with their bounds; empty lists go, and intervals that hold no posting."""
    some = b > a
    owner, term, weight, a, b = (x[some] for x in (owner, term, weight, a, b))
    top = block.best(a, b) if len(a) else a
    bound = _sums(weight * block.impact[top], owner, len(query))
    return _Open(query, low, high, bound, owner, term, weight, a, b, top).pick(bound > 0)


def _joined(x: _Open, y: _Open) -> _Open:
    parts = [np.concatenate([getattr(x, f), getattr(y, f)]) for f in ("query", "low", "high", "bound")]
    owner = np.concatenate([x.owner, y.owner + len(x.query)])
    return _Open(*parts, owner, *(np.concatenate([getattr(x, f), getattr(y, f)]) for f in ("term", "weight", "a", "b", "top")))


class Best:
    """The k best documents of each query so far: higher scores first, then smaller places."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query = self.score = self.place = np.zeros(0, dtype=np.int64)
        self.least = np.zeros(n, dtype=np.int64)  # a score must reach it, and be above 0

    def add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[query])
        if not good.any():
            return
        query, score, place = (
            np.concatenate(x) for x in zip((self.query, self.score, self.place), (query[good], score[good], place[good]))
        )
        order = np.lexsort((place, -score, query))
        query, score, place = query[order], score[order], place[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        keep = rank < self.k
        self.query, self.score, self.place = query[keep], score[keep], place[keep]


def search(block: Block, queries: Queries, weights: np.ndarray, best: Best, place: np.ndarray) -> int:
    """Add the best documents of a block; returns how many were scored.

    ``place`` orders documents of equal score. An interval whose bound equals the k-th best
    score stays open, because a document in it may come before that one.
    """
    n = len(queries)
    owner = np.repeat(np.arange(n), np.diff(queries.start))
    weight = weights[queries.term] * queries.times
    zero = np.zeros(len(owner), dtype=np.int64)
    whole = _bounded(
        block, np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, block.n_docs), owner, queries.term, weight,
        block.find(queries.term, zero), block.find(queries.term, zero + block.n_docs),
    )
    scored, now = 0, whole
    while len(now.query):
        now = now.pick(now.bound >= best.least[now.query])
        if not len(now.query):
            break
        order = np.lexsort((-now.bound, now.query))
        query = now.query[order]
        first = np.searchsorted(query, query)
        size = np.searchsorted(query, query, side="right") - first
        chosen = np.zeros(len(order), dtype=bool)
        chosen[order] = np.arange(len(order)) - first < np.maximum(STEP_LEAST, size // STEP_SHARE)
        take, rest = now.pick(chosen), now.pick(~chosen)
        # Each interval is split where its heaviest list has its largest impact.
        gain = take.weight * block.impact[take.top]
        by = np.lexsort((gain, take.owner))
        heaviest = by[np.searchsorted(take.owner[by], np.arange(len(take.query)), side="right") - 1]
        at = block.doc[take.top[heaviest]]
        each = at[take.owner]
        mid = block.find(take.term, each)
        there = (mid < take.b) & (block.doc[np.minimum(mid, len(block.doc) - 1)] == each)
        score = _sums(np.where(there, take.weight * block.impact[np.minimum(mid, len(block.doc) - 1)], 0), take.owner, len(at))
        best.add(take.query, score, place[at])
        scored += len(at)
        left = _bounded(block, take.query, take.low, at, take.owner, take.term, take.weight, take.a, np.minimum(mid, take.b))
        right = _bounded(block, take.query, at + 1, take.high, take.owner, take.term, take.weight, np.minimum(mid, take.b) + there, take.b)
        for part in (left, right):
            rest = _joined(rest, part.pick(part.bound >= best.least[part.query]))
        now = rest
    return scored


def arrange(n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """An order of documents in which neighbours are alike: by the commonest term, then by length.

    Range maxima of alike documents are close to what each of them has. Any order gives
    the same answer.
    """
    best = np.lexsort((term, -count, doc))
    first = np.searchsorted(doc[best], np.arange(len(n)))
    held = np.zeros(len(n), dtype=np.int64)
    some = np.bincount(doc, minlength=len(n)) > 0
    held[some] = term[best[first[some]]]
    return np.lexsort((n, held))


def _blocks(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            size += len(part.column("terms").flatten())
            if size >= postings:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search_blocks(
    postings: DataFrame, queries: Queries, statistics: Statistics, k: int, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """(query, id, score): the k best documents of each query in each block, by its number."""
    spark = postings.sparkSession
    held = spark.sparkContext.broadcast((queries, statistics))  # bounded by the pass
    schema = T.StructType([
        T.StructField("query", T.IntegerType()), T.StructField("id", postings.schema["id"].dataType),
        T.StructField("score", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, statistics = held.value
        weights = statistics.weights()
        least = np.zeros(len(queries), dtype=np.int64)
        for table in _blocks(batches, block_postings):
            n = table.column("n").to_numpy()
            size = table.column("terms").combine_chunks()
            size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in (size.chunks if isinstance(size, pa.ChunkedArray) else [size])])
            doc = np.repeat(np.arange(len(n)), size)
            term, count = (
                np.concatenate([c.flatten().to_numpy() for c in table.column(x).chunks]).astype(np.int64)
                for x in ("terms", "counts")
            )
            if not len(term):
                continue
            order = arrange(n, doc, term, count)
            new = np.empty(len(n), dtype=np.int64)
            new[order] = np.arange(len(n))
            block = Block(new[doc], term, statistics.impacts(n[doc], count), len(n))
            ids = table.column("id").combine_chunks()
            rank = np.empty(len(n), dtype=np.int64)
            rank[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(n))
            best = Best(len(queries), k)
            best.least = least
            search(block, queries, weights, best, rank[order])
            least = best.least
            by_rank = np.argsort(rank)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query, pa.int32()), ids.take(pa.array(by_rank[best.place])), pa.array(best.score)],
                schema.names,
            )

    return postings.mapInArrow(run, schema)


def ranked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", k: int = TOP,
) -> DataFrame:
    """(item id, rank, document id, score): the k best documents of each item with a score above 0.

    Every row of ``docs`` is a document, repeated rows too; documents of equal score stand
    by id, null last. Items equal in id and text are one; null and empty texts on either
    side have no terms, are not counted and match nothing; an empty table on either side
    gives an empty result. Texts are read whole, however long, and other columns not at all.
    """
    spark = docs.sparkSession
    pairs = stage(
        items.select(col(item_id).alias("item_id"), col(item_text).alias("t")).distinct()
        .select("item_id", row_hash(["t"], 5).alias("text_hash"), F.explode(term_column(F.col("t"))).alias("term"))
        .groupBy("item_id", "text_hash", "term").agg(F.count("*").alias("times"))
        .withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text_hash")),
        "lexical-items",
    )
    found = None
    passes = -(-pairs.count() // PASS_TERMS)
    for p in range(passes):
        own = pairs.where(F.pmod("item", F.lit(passes)) == p)
        # About PASS_TERMS rows; queries beyond that wait for the next pass over the documents.
        rows = own.select("item", "term", "times").toPandas().sort_values(["item", "term"], ignore_index=True)
        names, number = np.unique(rows["term"].to_numpy(dtype=str), return_inverse=True)
        keys, start = np.unique(rows["item"].to_numpy(dtype=np.int64), return_index=True)
        queries = Queries(np.append(start, len(rows)), number.astype(np.int64), rows["times"].to_numpy(dtype=np.int64))
        with small_batches(spark):
            postings = stage(
                count_terms(docs, id_col, text_col, {t.encode(): i for i, t in enumerate(names.tolist())}), "lexical-postings"
            )
        total = postings.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        holding = np.zeros(len(names), dtype=np.int64)
        held = postings.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()  # one row a term
        holding[held["t"].to_numpy(dtype=np.int64)] = held["count"].to_numpy(dtype=np.int64)
        best = search_blocks(postings, queries, Statistics(total["n"], total["length"] or 1, holding), k)
        numbers = spark.createDataFrame([(i, int(x)) for i, x in enumerate(keys)], "query int, item long")
        part = stage(best.join(F.broadcast(numbers), "query").select("item", "id", "score"), "lexical-best")
        found = part if found is None else found.unionByName(part)
    kinds = {"item": "long", "id": docs.schema[id_col].dataType.simpleString(), "score": "long"}
    if found is None:
        found = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in kinds.items()))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = pairs.select("item", "item_id").distinct()
    return top.join(named, "item").select(
        F.col("item_id").alias(item_id), "rank", F.col("id").alias(id_col), "score"
    )


ORACLE = """
WITH words AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
      lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark)
  GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, total GROUP BY term),
scores AS (
  SELECT item_id, p.doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings p USING (term) JOIN weights USING (term) JOIN lengths l ON l.doc_id = p.doc_id, total
  GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
