"""Best-fit packing of tokenised documents under several capacities at once.

Every piece of a document asks for a vector of resources: its tokens, one of the places
for documents, and an attention cost that grows with the square of its length. A sequence
has a capacity for each. Longer pieces come first; a piece goes to the open sequence that
is best by one of two rules, among those where it fits under every capacity:

``norm``: the weighted norm of what would be left is smallest.
``dot``: the weighted dot product of the piece and what is left is largest.

A piece's vector follows from its length alone, so the choice is made for lengths, not
rows: Spark counts the pieces of each length, the plan is laid out over that histogram (no
more rows than a sequence has tokens, whatever the corpus), and pieces of a length are
dealt to the planned places by their rank. So the packing is one for the whole corpus, with
no waste at the seams of partitions, and no text moves.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.llm.common import col, hidden, row_hash, small_batches
from riskflow.workspace import stage

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 1024, 2
#: Weights of tokens, documents and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.05, 0.05)
_LONG_RUN = re.compile(r"\s{10000}")
#: Rows of a length that are numbered together, about.
_BUCKET = 50_000
_LEAST_BUCKETS = 32


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable characters of Latin-1 stand for themselves, the others are counted from 256.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """A byte-level vocabulary as bytes and ranks, if its ids are in the order of its merges.

    Then merging by rank gives the ids that merging by list gives. None for other models.
    """
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("unk_token")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )
    if not plain:
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)):
        return None
    byte_of = {letter: b for b, letter in _BYTE_LETTERS.items()}
    singles = [vocab[letter] for letter in byte_of if letter in vocab]
    if len(singles) != 256 or merged and max(singles) > merged[0]:
        return None
    known = {*singles, *merged}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i in known}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit numbers.

    The ids are those of ``tokenizers`` without special tokens. A byte-level vocabulary is
    applied by ``tiktoken``, which gives the same ids in a quarter of the time; texts with
    a run of more than ``_LONG_RUN`` white-space characters, and other models, go through
    ``tokenizers`` itself.
    """

    known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        self.by_rank = ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each Python worker and file."""
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_rank and not _LONG_RUN.search(text):
            return self.by_rank.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, what is over comes first."""
    over = n % capacity
    first = [(0, over)] if over else []
    return first + [(at, capacity) for at in range(over, n, capacity)]


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end: int = END, capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32), and ``ids`` on request: a row for each piece.

    A document is the ids of its text and the id ``end``; a null text is an empty one and
    has just the end. Documents of more than ``capacity`` ids are cut. Every row is a
    document, repeated rows too. Whole texts are encoded, however long.
    """
    path = tokenizer or default_tokenizer()
    last = struct.pack("<I", end)
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            rows, held = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder(text) + last
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((at, piece, start, length, zlib.crc32(own)))
                    if with_ids:
                        held.append(np.frombuffer(own, "<u4").astype("int64"))
            if rows:
                at, piece, start, length, crc = (pa.array(x) for x in zip(*rows))
                arrays = [batch.column(0).take(at), piece.cast(pa.int32()), start, length, crc]
                if with_ids:
                    arrays.append(pa.array(held, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return df.select(col(id_col).alias("id"), col(text_col).alias("t")).mapInArrow(encode, schema)


@dataclass
class Sequences:
    """``n`` sequences filled alike: what is left of each capacity, and what they hold."""

    n: int
    left: np.ndarray
    holds: list[tuple[int, int, int, int]]  # length, first rank of the length, pieces of it each, offset


def lay_out(
    counts: dict[int, int], capacity: int = CAPACITY, documents: int | None = None,
    attention: int | None = None, weights: Iterable[float] = WEIGHTS, rule: str = "norm",
) -> list[Sequences]:
    """Sequences for so many pieces of each length, by vector best fit.

    Sequences filled alike are one entry, so the work follows the number of lengths. Each
    step either uses up a length or the sequences of an entry that still take it, and splits
    off at most two entries; there are no more than ``2 * lengths + 1`` of them.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    full = np.array([capacity, documents or capacity, attention or capacity**2], dtype=np.int64)
    w = np.array(list(weights), dtype=float)
    if any(length > full[0] or length * length > full[2] for length in counts):
        raise ValueError("a piece does not fit an empty sequence")
    done: list[Sequences] = []  # nothing fits any more
    open_: list[Sequences] = []
    left = np.zeros((0, 3), dtype=np.int64)
    least = min(counts, default=0)

    for length in sorted(counts, reverse=True):
        need, rest, rank = np.array([length, 1, length * length], dtype=np.int64), counts[length], 0
        while rest:
            able = np.flatnonzero((left >= need).all(axis=1))
            if len(able):
                room = left[able]
                if rule == "norm":
                    after = (room - need) / full
                    best = able[np.argmin((w * after * after).sum(axis=1))]
                else:
                    best = able[np.argmax((w * (room / full) * (need / full)).sum(axis=1))]
                group, known = open_[best], True
            else:
                group, known = Sequences(rest, full, []), False
            # Nothing else fits once a sequence is opened for lack of room, and by the norm the
            # sequence just used is the best again; by the dot product its equals come first.
            each = 1 if known and rule == "dot" else min(rest, int((group.left // need).min()))
            n = min(group.n, rest // each)
            offset = capacity - int(group.left[0])
            used = Sequences(n, group.left - each * need, [*group.holds, (length, rank, each, offset)])
            rest, rank = rest - n * each, rank + n * each
            if known:
                # Those split off take the first pieces of each length, the others the rest.
                group.n -= n
                group.holds = [(size, r + e * n, e, o) for size, r, e, o in group.holds]
                if not group.n:
                    del open_[best]
                    left = np.delete(left, best, axis=0)
            if used.left[0] < least or used.left[1] < 1 or used.left[2] < least * least:
                done.append(used)
            else:
                open_.append(used)
                left = np.vstack([left, used.left])
    return done + open_


_PLACES = "length long, first_rank long, end_rank long, each long, first_sequence long, first_offset long"


def places(spark: SparkSession, plan: list[Sequences]) -> DataFrame:
    """Where the pieces of a length go, by ranges of their rank within the length.

    At most as many rows as there are lengths times entries of the plan.
    """
    rows, base = [], 0
    for group in plan:
        for length, rank, each, offset in group.holds:
            rows.append((length, rank, rank + each * group.n, each, base, offset))
        base += group.n
    return spark.createDataFrame(rows, _PLACES)


def pack(
    pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, documents: int | None = None,
    attention: int | None = None, weights: Iterable[float] = WEIGHTS, rule: str = "norm",
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a staged table of pieces, each row once.

    No sequence holds more than ``capacity`` tokens, ``documents`` pieces or an attention
    cost (sum of squared lengths) of ``attention``; None sets no bound of its own. The
    histogram that reaches the driver has at most ``capacity`` rows. A length with very many
    pieces is numbered in buckets of hashes, whose sizes are counted first, so no task takes
    a length whole. Equal rows get places of their own; an empty table gives an empty result.
    """
    names = pieces.columns
    h, bucket, rank, before = hidden(pieces, "h", "bucket", "rank", "before")
    counts = {r[0]: r[1] for r in pieces.groupBy(col(length_col)).count().collect()}
    most = max(counts.values(), default=0)
    buckets = max(_LEAST_BUCKETS, -(-most // _BUCKET))
    plan = places(pieces.sparkSession, lay_out(counts, capacity, documents, attention, weights, rule))
    keyed = pieces.withColumn(h, row_hash(names, 7)).withColumn(bucket, F.pmod(F.col(h), F.lit(buckets)))
    sizes = keyed.groupBy(col(length_col).alias(length_col), bucket).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(length_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(length_col, bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy(length_col, bucket).orderBy(h)
    ranked = (
        keyed.withColumn(rank, F.row_number().over(own) - 1).join(offsets, [length_col, bucket])
        .withColumn(rank, F.col(rank) + F.col(before))
    )
    plan = plan.select(*[F.col(c).alias(f"__plan_{c}") for c in plan.columns])
    p = {c: F.col(f"__plan_{c}") for c in ("length", "first_rank", "end_rank", "each", "first_sequence", "first_offset")}
    nth = F.col(rank) - p["first_rank"]
    # The plan is bounded by the capacity, not by the corpus.
    return ranked.join(
        F.broadcast(plan),
        (col(length_col) == p["length"]) & (F.col(rank) >= p["first_rank"]) & (F.col(rank) < p["end_rank"]),
    ).select(
        *[col(c) for c in names],
        (p["first_sequence"] + F.floor(nth / p["each"])).cast("long").alias("sequence_id"),
        (p["first_offset"] + F.pmod(nth, p["each"]) * p["length"]).cast("long").alias("offset"),
    )


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end: int = END, capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None,
    weights: Iterable[float] = WEIGHTS, rule: str = "norm",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Null and empty texts are one token long; repeated rows and rows with a null id are
    packed like any others; an empty table gives an empty result; other columns are not
    read, whatever their names. Whole texts are tokenised, however long.
    """
    with small_batches(df.sparkSession):
        pieces = stage(token_pieces(df, id_col, text_col, tokenizer, end, capacity), "pack-pieces")
    return pack(pieces, "length", capacity, documents, attention, weights, rule).withColumnRenamed("id", id_col)


def sequences(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end: int = END, capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None,
    weights: Iterable[float] = WEIGHTS, rule: str = "norm",
) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences themselves, pieces in their order."""
    with small_batches(df.sparkSession):
        pieces = stage(token_pieces(df, id_col, text_col, tokenizer, end, capacity, with_ids=True), "pack-pieces")
    placed = pack(pieces.drop("ids"), "length", capacity, documents, attention, weights, rule)
    key = ["id", "piece", "length", "ids_crc32"]
    # Equal pieces may have several places; they are the same ids, so one copy of them will do.
    ids = pieces.dropDuplicates(key).select(*[F.col(c).alias(f"__{c}") for c in key], "ids")
    same = [placed[c].eqNullSafe(F.col(f"__{c}")) for c in key]
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        placed.join(ids, same).groupBy("sequence_id").agg(held.alias("held"))
        .select(
            "sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"),
            F.transform("held", lambda x: F.size(x["ids"])).alias("lengths"),
        )
    )
