"""Removal of long repeated byte strings with run-length suffix indexes.

A byte goes if it is covered by a string of ``length`` bytes that starts at another place
as well. All windows of that length are judged, in this way:

1. Every window picks the ``GRAM``-byte string in it with the smallest hash, the leftmost of
   equals. Windows that pick the same place form a *segment*. Equal windows pick equal
   strings at equal offsets, so only segments with the same picked hash can share a window.
2. Segments are shuffled by that hash. Equal segments are told by a 128-bit fingerprint:
   all their windows occur again. Segments of one hash that differ may share some windows;
   their bytes are fetched.
3. For a batch of such segments a run-length index is built: the Burrows-Wheeler transform
   of their concatenation, cut into runs, with text positions sampled at the run ends only.
   How far the text at a position agrees with its neighbours in suffix order needs to be
   measured at the samples alone; between samples that number falls by one a byte. So one
   stream over the text gives the matching statistic of every position, the longest match
   starting there that starts anywhere else too. Positions with ``length`` or more are marked.
4. A hash with very many different segments is not given to one task: its windows are
   fingerprinted one by one and counted by fingerprint, which is exact as well.

Marks are joined back to the texts, whose marked bytes are cut out. Equal texts are one text
with a count; a text that occurs twice repeats wholly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import col, small_batches
from riskflow.workspace import stage

LENGTH, GRAM = 200, 40
#: Bytes of segments that are indexed together.
BATCH_BYTES = 1 << 20
#: Different segments of one hash beyond which its windows are counted one by one.
MANY = 4_096
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of a text looked at a time.
_PART = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of the bases and of their inverses modulo 2**64, made where they are used.
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables:
        base = int(_BASES[which])
        _tables[which] = (_powers(base, _PART + 4096), _powers(pow(base, -1, 1 << 64), _PART + 4096))
    return _tables[which]


class Rolling:
    """Fingerprints of any stretch of a short byte array from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        power, self.undo = _table(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """Fingerprints of all stretches of one width, in order."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.undo[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.undo[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def picked(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of its smallest, the leftmost of equals."""
    n = len(grams) - width + 1
    blocks = -(-len(grams) // width)
    grid = np.full((blocks, width), np.iinfo(np.uint64).max, dtype=np.uint64)
    grid.ravel()[: len(grams)] = grams
    left = np.minimum.accumulate(grid, axis=1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    # The first place that reaches a prefix minimum, and where a suffix minimum stands.
    place = np.arange(grid.size).reshape(blocks, width)
    new = np.ones((blocks, width), dtype=bool)
    np.less(left[:, 1:], left[:, :-1], out=new[:, 1:])
    at_left = np.maximum.accumulate(np.where(new, place, -1), axis=1).ravel()[width - 1: width - 1 + n]
    stands = np.where(right == grid, place, grid.size)
    at_right = np.minimum.accumulate(stands[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    low_left, low_right = left.ravel()[width - 1: width - 1 + n], right.ravel()[:n]
    first = low_right <= low_left
    return np.where(first, at_right, at_left), np.where(first, low_right, low_left)


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, picked hash, two fingerprints) of all segments."""
    n = len(data) - length + 1
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(n, 0), _PART):
        m = min(_PART, n - at)
        chunk = data[at: at + m + length - 1]
        one, two = Rolling(chunk, 0), Rolling(chunk, 1)
        place, least = picked(one.all(gram), length - gram + 1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        count = np.diff(np.concatenate([cut, [m]]))
        end = cut + count + length - 1
        # The offset of the picked string is part of a segment's identity.
        shift = mix((place[cut] - cut).astype(np.uint64))
        parts.append((cut + at, count, least[cut], one.of(cut, end) ^ shift, two.of(cut, end) + shift))
    if not parts:
        e = np.empty(0, np.int64)
        return e, e, e.astype(np.uint64), e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more, by prefix doubling."""
    n = len(text)
    packed = np.zeros(n + 8, dtype=np.uint64)
    packed[:n] = text
    key = np.zeros(n, dtype=np.uint64)
    for k in range(4):
        key = (key << np.uint64(16)) | packed[k: n + k]
    have = 4
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, dtype=np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, dtype=np.int64)
        later[: n - have] = rank[have:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        have *= 2


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to ``most``; 0 symbols never agree."""
    n = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    padded = np.concatenate([text, np.zeros(most + 1, text.dtype)])
    for k in range(most):
        x, y = padded[a[live] + k], padded[b[live] + k]
        live = live[(x == y) & (x != 0)]
        if not len(live):
            break
        n[live] += 1
    return n


class RunIndex:
    """Run-length Burrows-Wheeler index of a text of symbols; symbol 0 ends a segment.

    ``depth`` is at least the longest segment with its end, so that suffixes are in full
    order up to their first end; equal ones stand by position, which agrees with the order
    of the suffixes one symbol earlier.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.size, self.depth = len(text), depth
        order = suffix_order(text, depth)
        transform = text[order - 1]
        # Ends never agree with each other, so each is a run of its own.
        head = np.flatnonzero((transform[1:] != transform[:-1]) | (transform[1:] == 0)) + 1
        self.runs = len(head) + 1
        self.up, self.up_match = order[head], common(text, order[head], order[head - 1], depth)
        self.down, self.down_match = order[head - 1], self.up_match

    def statistics(self) -> np.ndarray:
        """Stream the text once: the longest match of each position that starts elsewhere."""
        best = np.zeros(self.size, dtype=np.int64)
        for at, match in ((self.up, self.up_match), (self.down, self.down_match)):
            sort = np.argsort(at, kind="stable")
            ends = np.full(self.size, -1, dtype=np.int64)
            ends[at[sort]] = at[sort] + match[sort]
            sampled = ends >= 0
            last = np.maximum.accumulate(np.where(sampled, np.arange(self.size), -1))
            known = last >= 0
            reach = np.where(known, ends[np.maximum(last, 0)], 0)
            best = np.maximum(best, reach - np.arange(self.size))
        return np.maximum(best, 0)


def repeated_windows(blobs: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment the offsets of windows that occur at another place of any segment."""
    sizes = np.array([len(b) + 1 for b in blobs])
    text = np.zeros(int(sizes.sum()), dtype=np.uint16)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(b + b"\0" for b in blobs), dtype=np.uint8)
    text[:] = flat.astype(np.uint16) + 1
    text[starts + sizes - 1] = 0
    hits = np.flatnonzero(RunIndex(text, int(sizes.max())).statistics() >= length)
    owner = np.searchsorted(starts, hits, side="right") - 1
    return [hits[owner == i] - starts[i] for i in range(len(blobs))] if len(blobs) < 64 else [
        part - s for part, s in zip(np.split(hits, np.searchsorted(owner, np.arange(1, len(blobs)))), starts)
    ]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted columns."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group is cut between two frames."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        first = _runs(*[pdf[k].to_numpy() for k in key])[-1]
        same = held and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in key)
        if first == 0 and (same or not held):
            held.append(pdf)
            continue
        if same or not held:
            yield pd.concat([*held, pdf.iloc[:first]], ignore_index=True)
        else:
            yield pd.concat(held, ignore_index=True)
            if first:
                yield pdf.iloc[:first]
        held = [pdf.iloc[first:]]
    if held:
        yield pd.concat(held, ignore_index=True)


_PLACE = "k1 long, k2 long, first long, n long"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream sorted segments: all but the first of equal ones become kind 0, the first 1 or 2.

    Only the last row is held back, until the next frame tells whether it has copies.
    """
    last, inside = None, False
    for pdf in chain(batches, [None]):
        if pdf is not None:
            settled = (pdf["kind"] == 0).to_numpy()
            if settled.any():
                yield pdf[settled]
            pdf = pdf[~settled]
            if not len(pdf):
                continue
        rows = pd.concat([x for x in (last, pdf) if x is not None] or [pd.DataFrame()], ignore_index=True)
        if not len(rows):
            continue
        new = np.zeros(len(rows) + 1, dtype=bool)
        new[_runs(*[rows[c].to_numpy() for c in ("h", "f1", "f2")])] = True
        new[0], new[-1] = not inside, True
        again = ~new[1:] | (rows["kind"].to_numpy() == 2)
        rows["kind"] = np.where(new[:-1], np.where(again, 2, 1), 0)
        upto = len(rows) if pdf is None else len(rows) - 1
        if upto:
            yield rows.iloc[:upto]
        if pdf is not None:
            last, inside = pdf.iloc[-1:], not new[-2]


def _sort_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give segments of one picked hash their kind.

    0: its windows are repeated, 1: to index, 2: repeated and a reference for others, 3 and
    4: the same where very many differ. Segments without another of their hash are left out.
    At most ``MANY`` rows of a hash are held; from there on its rows are passed on at once.
    """
    columns = ["h", "k1", "k2", "first", "n", "kind"]
    held, hot = None, None
    for pdf in _settle(batches):
        pdf = pdf[columns]
        yield pdf[pdf["kind"] == 0]
        pdf = pdf[pdf["kind"] > 0]
        if hot is not None and len(pdf):
            passed = (pdf["h"] == hot).to_numpy()
            yield pdf[passed].assign(kind=pdf.loc[passed, "kind"] + 2)
            pdf = pdf[~passed]
        if not len(pdf):
            continue
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        group = _runs(rows["h"].to_numpy())
        sizes = np.diff(np.concatenate([group, [len(rows)]]))
        hot = rows["h"].iloc[-1] if sizes[-1] > MANY else None
        upto = len(rows) if hot is not None else int(group[-1])
        yield _labelled(rows, sizes).iloc[:upto].query("kind >= 0")
        held = rows.iloc[upto:] if upto < len(rows) else None
    if held is not None:
        yield _labelled(held, np.array([len(held)])).query("kind >= 0")


def _labelled(rows: pd.DataFrame, sizes: np.ndarray) -> pd.DataFrame:
    kinds, kind = np.repeat(sizes, sizes), rows["kind"].to_numpy()
    alone = np.where(kind == 2, 0, -1)
    return rows.assign(kind=np.where(kinds == 1, alone, np.where(kinds > MANY, kind + 2, kind)))


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle equal segments of one batch before the shuffle.

    One of them goes on to its hash's task as repeated (kind 2; a single one has kind 1).
    The others are settled: kind 0, spread over the tasks by their own place.
    """
    pdf = pdf.iloc[np.lexsort((pdf["f2"], pdf["f1"], pdf["h"]))].reset_index(drop=True)
    same = _runs(*[pdf[c].to_numpy() for c in ("h", "f1", "f2")])
    copies = np.diff(np.concatenate([same, [len(pdf)]]))
    kind = np.zeros(len(pdf), dtype=np.int32)
    kind[same] = np.where(copies > 1, 2, 1)
    place = mix(pdf["k1"].to_numpy().view(np.uint64) + pdf["first"].to_numpy().astype(np.uint64)).view(np.int64)
    return pdf.assign(kind=kind, h=np.where(kind == 0, place, pdf["h"]))


def _index_batches(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            pdf = pd.concat(held, ignore_index=True)
            hits = repeated_windows(pdf["bytes"].tolist(), length)
            mine = (pdf["kind"] == 1).to_numpy()
            k1, k2, first = (pdf[c].to_numpy() for c in ("k1", "k2", "first"))
            rows = [(k1[i], k2[i], first[i] + a, n) for i in np.flatnonzero(mine) for a, n in _stretches(hits[i])]
            yield pd.DataFrame(rows, columns=["k1", "k2", "first", "n"])

        for pdf in _whole_groups(batches, ["h"]):
            held.append(pdf)
            size += int(pdf["bytes"].str.len().sum())
            if size >= BATCH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _stretches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(at):
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        for part in np.split(at, cut):
            yield int(part[0]), len(part)


def _window_prints(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k1, k2, first, kind, blob in zip(pdf["k1"], pdf["k2"], pdf["first"], pdf["kind"], pdf["bytes"]):
                data = np.frombuffer(blob, dtype=np.uint8)
                at = np.arange(len(data) - length + 1)
                w1, w2 = (Rolling(data, i).all(length) for i in (0, 1))
                yield pd.DataFrame({
                    "w1": w1.view(np.int64), "w2": w2.view(np.int64), "k1": k1, "k2": k2, "first": first + at, "kind": kind,
                })

    return run


def _keys(digest: Column) -> tuple[Column, Column]:
    part = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    return part(1), part(17)


def repeated_marks(texts: DataFrame, often: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, first, n): runs of window starts that occur elsewhere, in texts that occur once.

    ``texts`` has byte strings ``b`` with their keys k1 and k2 and an id ``i``; ``often``
    has the keys of texts that occur more than once and the id ``r`` of one such row.
    """
    spark = texts.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for pdf in batches:
            out = []
            for k1, k2, b in zip(pdf["k1"], pdf["k2"], pdf["b"]):
                # Equal texts repeat wholly, which is known; a task looks at one of them.
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                first, n, h, f1, f2 = segments(np.frombuffer(b, dtype=np.uint8), length, gram)
                if len(first):
                    out.append(pd.DataFrame({
                        "h": h.view(np.int64), "f1": f1.view(np.int64), "f2": f2.view(np.int64),
                        "k1": k1, "k2": k2, "first": first, "n": n,
                    }))
            if out:
                yield _combine(pd.concat(out, ignore_index=True))

    with small_batches(spark, 1024):
        pieces = texts.where(F.octet_length("b") >= length).mapInPandas(
            cut, f"h long, f1 long, f2 long, {_PLACE}, kind int"
        )
        sorted_ = pieces.repartition("h").sortWithinPartitions("h", "f1", "f2")
        with small_batches(spark, 20_000):
            found = stage(sorted_.mapInPandas(_sort_out, "h long, k1 long, k2 long, first long, n long, kind int"), "runs-kinds")
        found = found.join(often.select("k1", "k2", "r", F.lit(True).alias("copied")), ["k1", "k2"], "left")
        asked = found.where("kind > 0").groupBy("k1", "k2", "r", "copied").agg(F.collect_list(
            F.struct("h", "first", "n", F.when(F.col("copied"), F.col("kind") + F.col("kind") % 2).otherwise(F.col("kind")).alias("kind"))
        ).alias("s"))
        fetched = (
            texts.hint("shuffle_hash").join(asked, ["k1", "k2"])
            .where(F.col("copied").isNull() | F.col("i").eqNullSafe(F.col("r")))
            .select("k1", "k2", "b", F.explode("s").alias("s"))
            .select(
                "s.h", "k1", "k2", "s.first", "s.kind",
                F.substring("b", (F.col("s.first") + 1).cast("int"), (F.col("s.n") + length - 1).cast("int")).alias("bytes"),
            )
        )
        fetched = stage(fetched, "runs-fetched")
        marks = found.where("kind in (0, 2, 4) and copied is null").select("k1", "k2", "first", "n")
        indexed = fetched.where("kind <= 2").repartition("h").sortWithinPartitions("h")
        marks = marks.unionByName(stage(indexed.mapInPandas(_index_batches(length), _PLACE), "runs-marks"))
        hot = fetched.where("kind > 2")
        if not hot.isEmpty():
            windows = stage(hot.repartition(F.xxhash64("k1", "k2", "first")).mapInPandas(
                _window_prints(length), "w1 long, w2 long, k1 long, k2 long, first long, kind int"
            ), "runs-windows")
            # A window of a segment that has copies occurs twice already.
            often = windows.groupBy("w1", "w2").agg(
                (F.count("*") + F.max((F.col("kind") == 4).cast("int"))).alias("c")
            ).where("c > 1").select("w1", "w2")
            marks = marks.unionByName(
                windows.where("kind = 3").join(often, ["w1", "w2"], "left_semi").select("k1", "k2", "first", F.lit(1).cast("long").alias("n"))
            )
    return marks


def cut_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and spans.

    ``spans`` lists (start, end) of the removed runs of bytes. A null or empty text keeps
    its zero bytes; a text below ``length`` bytes loses nothing; rows that repeat a text of
    at least that length lose all of it; an empty table gives an empty result; other
    columns are not read.
    """
    spark = df.sparkSession
    b = F.coalesce(col(text_col), F.lit("")).cast("binary")
    digest = F.sha2(b, 256)
    k1, k2 = _keys(digest)
    rows = stage(
        df.select(col(id_col).alias("id"), digest.alias("sha"), F.octet_length(b).cast("long").alias("n_bytes")), "runs-rows"
    )
    k = _keys(F.col("sha"))
    often = stage(
        rows.groupBy("sha", "n_bytes").agg(F.count("*").alias("m"), F.min("id").alias("r"))
        .select("*", k[0].alias("k1"), k[1].alias("k2")).where((F.col("m") > 1) & (F.col("n_bytes") >= length)),
        "runs-often",
    )
    keyed = df.select(b.alias("b"), k1.alias("k1"), k2.alias("k2"), col(id_col).alias("i"))
    marks = repeated_marks(keyed, often, length, gram)
    lists = stage(
        marks.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("s")), "runs-lists"
    )

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sha, data, found in zip(pdf["sha"], pdf["b"], pdf["s"]):
                spans: list[list[int]] = []
                for w in found:
                    start, end = int(w["first"]), int(w["first"] + w["n"] - 1 + length)
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                out.append((sha, kept.hexdigest(), [tuple(s) for s in spans]))
            yield pd.DataFrame(out, columns=["sha", "kept", "spans"])

    texts = keyed.withColumn("sha", F.sha2("b", 256))
    spans_type = "array<struct<start: long, end: long>>"
    with small_batches(spark, 256):
        changed = stage(
            texts.join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("sha", "b", "s")
            .mapInPandas(shorten, f"sha string, kept string, spans {spans_type}").dropDuplicates(["sha"]),
            "runs-changed",
        )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    gone = often.select("sha", F.sha2(F.lit("").cast("binary"), 256).alias("kept"), whole.alias("spans"))
    out = rows.join(changed.unionByName(gone), "sha", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(spans_type))
    )
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        F.col("id").alias(id_col), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"), "spans",
    )
