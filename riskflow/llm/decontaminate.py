"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become token templates: numbers, units and names turn into typed
placeholders, every other token into its lower-case letters and digits. Windows of
consecutive template tokens of an item are hashed, and documents are joined with them by
hash. What a window's placeholders stood for must then be consistent: over the windows of
one place where a document runs along an item, each value of the item must always meet
the same value of the document, and the other way round. So a question with other numbers
is caught, and a text that only shares a pattern is not.

All of it is DataFrame functions. Windows are hashed inside each row; only windows whose
hash the benchmark has leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import col, hidden, let, row_hash
from riskflow.workspace import stage

#: Tokens of a window.
WINDOW = 8
#: Share of an item's windows that a document must run along.
SHARE = 0.3
#: Units of measure and currencies that become a placeholder.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "g", "kg", "mg", "lb", "lbs", "oz", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents",
)
_NUMBER = r"^[+\-]?\p{N}[\p{N}.,:/%]*$"
_BARE = r"^[\p{L}\p{N}]++\z"
_MARKS = r"^[^\p{L}\p{N}+\-]+|[^\p{L}\p{N}%]+$"


def tokens(text: Column) -> Column:
    """(raw, word) per white-space token that holds a letter or digit; a null text has none."""
    raw = F.split(F.coalesce(text, F.lit("")), r"\s+")
    # Most tokens are letters and digits only and stand as they are; the check costs less than the cut.
    pairs = F.transform(raw, lambda w: F.struct(
        w.alias("raw"), F.when(w.rlike(_BARE), w).otherwise(F.regexp_replace(w, _MARKS, "")).alias("word")
    ))
    return F.filter(pairs, lambda t: t["word"].rlike(r"[\p{L}\p{N}]"))


def templates(toks: Column) -> Column:
    """Typed placeholders for numbers, units and names; lower case for the rest.

    A name is a capitalised word inside a sentence. At the start of a text or sentence a
    capital says nothing, so the word stands for itself.
    """
    def one(toks: Column, t: Column, i: Column) -> Column:
        w, low = t["word"], F.lower(t["word"])
        inside = (i > 0) & ~F.get(toks, i - 1)["raw"].rlike(r"[.!?:][^\p{L}\p{N}]*$")
        return (
            F.when(w.rlike(_NUMBER), F.lit("<number>"))
            .when(w.rlike(r"^\p{Lu}\p{Ll}+$") & inside, F.lit("<name>"))
            .when(low.isin(*UNITS), F.lit("<unit>"))
            .otherwise(low)
        )

    return let(toks, lambda held: F.transform(held, lambda t, i: one(held, t, i)))


def window_hashes(words: Column, widths: list[int], salt: int = 0) -> Column:
    """(width, pos, hash) of all windows of consecutive words, for each width."""

    def of(codes: Column, width: int) -> Column:
        at = F.when(F.size(codes) >= width, F.sequence(F.lit(0), F.size(codes) - width))
        return F.transform(F.coalesce(at, F.array().cast("array<int>")), lambda i: F.struct(
            F.lit(width).alias("width"), i.alias("pos"),
            F.xxhash64(F.lit(salt), *[F.get(codes, i + j) for j in range(width)]).alias("hash"),
        ))

    codes = F.transform(words, lambda w: F.xxhash64(w))
    return let(codes, lambda c: F.concat(*[of(c, w) for w in widths]))


def _is_slot(token: Column) -> Column:
    return token.isin("<number>", "<name>", "<unit>")


def prepare_benchmark(bench: DataFrame, id_col: str, text_col: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Items with their templates, and their windows by hash.

    An item with fewer tokens than a window is one window of its own width. Windows of
    nothing but placeholders are no evidence and are left out; an item that has no other is
    compared by its words as they stand. A document must hold at least ``share`` of the
    windows that are left.
    """
    toks = F.col("toks")
    plain = F.transform(toks, lambda t: F.lower(t["word"]))
    items = (
        bench.select(col(id_col).alias("item_id"), tokens(col(text_col)).alias("toks")).distinct()
        .select("item_id", plain.alias("item_words"), templates(toks).alias("item_template"))
        .where(F.size("item_words") > 0)
        .withColumn("width", F.least(F.lit(WINDOW), F.size("item_words")))
        .withColumn("literal", F.transform("item_template", lambda t: ~_is_slot(t)))
        .withColumn("at", F.filter(
            F.sequence(F.lit(0), F.size("item_words") - F.col("width")),
            lambda p: F.exists(F.slice("literal", p + 1, F.col("width")), lambda x: x),
        ))
        .withColumn("by_words", F.size("at") == 0)
        .withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "item_words", "item_template"))
    )
    items = stage(items, "bench-items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most WINDOW values
    hashed = lambda words, salt: F.filter(
        window_hashes(F.col(words), widths, salt), lambda x: x["width"] == F.col("width")
    )
    windows = items.select("item", "by_words", "at", F.inline(
        F.when(F.col("by_words"), hashed("item_words", 1)).otherwise(hashed("item_template", 0))
    ))
    kept = F.col("by_words") | F.array_contains("at", F.col("pos"))
    windows = stage(
        windows.where(kept).select("width", "hash", "item", F.col("pos").alias("item_pos"), "by_words"), "bench-windows"
    )
    sizes = windows.groupBy("item").agg(F.count("*").cast("int").alias("n_windows"))
    sizes = sizes.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n_windows") * share)).cast("int"))
    return items.join(sizes, "item"), windows


def contaminated(
    df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bench_id: str = "item_id", bench_text: str = "text", share: float = SHARE,
) -> DataFrame:
    """(k1, k2, id, item_id, n_windows, matched, changed_slots) for every document and item.

    A row says that the document runs along the item, without a shift, over at least
    ``share`` of the item's windows with consistent placeholders; k1 and k2 are hashes of
    the document's id and text. Of several such places the best counts. Null and empty
    texts and items match nothing; rows equal in id and text are one; an empty table on
    either side gives an empty result; other columns are not read, whatever their names.
    Texts are read whole: only windows of the benchmark leave a row, and of the places where
    they stand in line only those go on that have enough of them, with the words at their
    placeholders, a row each.
    """
    docs = df.select(
        row_hash([id_col, text_col], 1).alias("k1"), row_hash([id_col, text_col], 2).alias("k2"),
        col(id_col).alias("id"), col(text_col).alias("text"),
    )
    out = ["k1", "k2", "id", "item_id", "n_windows", "matched", "changed_slots"]
    schema = (
        f"k1 long, k2 long, id {df.schema[id_col].dataType.simpleString()}, "
        f"item_id {bench.schema[bench_id].dataType.simpleString()}, n_windows int, matched int, changed_slots int"
    )
    if bench.where(col(bench_text).rlike(r"[\p{L}\p{N}]")).isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    items, windows = prepare_benchmark(bench, bench_id, bench_text, share)
    sought = {(r.by_words, r.width) for r in windows.select("by_words", "width").distinct().collect()}
    by_template, by_words = (sorted(w for words, w in sought if words == kind) for kind in (False, True))
    known = stage(windows.select("width", "hash").distinct(), "bench-hashes")
    # Texts are cut into tokens once; only ids and hashes leave the row.
    hashes = lambda t: F.concat(*[h for h in (
        window_hashes(templates(t), by_template) if by_template else None,
        window_hashes(F.transform(t, lambda x: F.lower(x["word"])), by_words, 1) if by_words else None,
    ) if h is not None])
    found = docs.select("k1", "k2", "id", F.inline(let(tokens(F.col("text")), hashes)))
    found = stage(found.join(known, ["width", "hash"], "left_semi"), "bench-found")
    hits = (
        found.join(windows, ["width", "hash"])
        .groupBy("k1", "k2", "id", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.sort_array(F.collect_set("item_pos")).alias("hits"))  # at most the item's windows
        .withColumn("matched", F.size("hits"))
    )
    # Placeholders inside the windows that were met.
    covered = lambda t: F.exists("hits", lambda p: (p <= t) & (t < p + F.col("width")))
    slots = F.filter(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda t: ~F.col("by_words") & _is_slot(F.get("item_template", t)) & covered(t),
    )
    cells = F.transform("slots", lambda t: F.struct(
        F.get("item_template", t).alias("kind"), F.get("item_words", t).alias("a"), (F.col("shift") + t).alias("pos")
    ))
    place = ["k1", "k2", "id", "item", "item_id", "shift", "n_windows", "matched"]
    places = stage(
        hits.join(items, "item").where(F.col("matched") >= F.col("need"))
        .withColumn("slots", slots).select(*place, cells.alias("cells")),
        "bench-places",
    )
    bare = places.where(F.size("cells") == 0).select(*place, F.lit(0).alias("changed_slots"))
    filled = places.where(F.size("cells") > 0).select(*place, F.inline("cells"))
    touched = docs.join(filled.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    words = touched.select("k1", "k2", F.posexplode(tokens(F.col("text"))).alias("pos", "tok"))
    words = words.select("k1", "k2", "pos", F.lower("tok.word").alias("b"))
    pairs = F.collect_set(F.struct("kind", "a", "b", "pos")).alias("pairs")  # at most the item's slots
    n = lambda f: F.size(F.array_distinct(F.transform("pairs", f)))
    both = n(lambda p: F.struct(p["kind"], p["a"], p["b"]))
    consistent = (both == n(lambda p: F.struct(p["kind"], p["a"]))) & (both == n(lambda p: F.struct(p["kind"], p["b"])))
    judged = (
        filled.join(words, ["k1", "k2", "pos"]).groupBy(*place).agg(pairs).where(consistent)
        .select(*place, F.size(F.filter("pairs", lambda p: p["a"] != p["b"])).alias("changed_slots"))
        .unionByName(bare)
    )
    best = F.max(F.struct("matched", (-F.col("changed_slots")).alias("same"))).alias("best")
    return (
        judged.groupBy("k1", "k2", "id", "item_id", "n_windows").agg(best)
        .select("k1", "k2", "id", "item_id", "n_windows", "best.matched", (-F.col("best.same")).alias("changed_slots"))
        .select(*out)
    )


def decontaminate(
    df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bench_id: str = "item_id", bench_text: str = "text", share: float = SHARE,
) -> DataFrame:
    """The rows of ``df``, all columns, that run along no benchmark item.

    Rows with a null or empty text stay; equal rows stay or go together; columns may have
    any names; an empty benchmark leaves all rows.
    """
    names = df.columns
    k1, k2 = hidden(df, "k1", "k2")
    bad = contaminated(df, bench, id_col, text_col, bench_id, bench_text, share)
    bad = stage(bad.select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct(), "bench-bad")
    keyed = df.withColumns({k1: row_hash([id_col, text_col], 1), k2: row_hash([id_col, text_col], 2)})
    return keyed.join(bad, [k1, k2], "left_anti").select(*[col(c) for c in names])
