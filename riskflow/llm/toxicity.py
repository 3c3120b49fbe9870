"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over all texts. Noisy spans of a text (letters mixed
with look-alike digits and signs, single letters spaced out, letters repeated) become
lattices: each character may stand for itself, for the letters it resembles, or, if it is a
separator or a repetition, for nothing. Viterbi decoding picks the most probable letters
under the channel and the language model; clean spans have one path and stay as they are.
The restored text is scored by words and word beginnings whose association with the label
was learned from labelled rows, and the sum of their weights is turned into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import col, held_out, hidden, small_batches
from riskflow.workspace import stage

#: The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Symbol 0 is a boundary, 1 to 26 are letters, 27 is any other letter.
N_SYMBOLS = 28
#: Costs of the channel, in nats.
SWAP, WILD, DROP_SEPARATOR, DROP_REPEAT, DROP_DOUBLE, KEEP_SIGN = 1.0, 3.0, 0.5, 1.0, 5.0, 8.0
_SEPARATORS = " .,_*-~'/"
_SIGNS = "0123456789@$!|+(€£*"
#: Readings of spans of so many characters are kept for the next time.
_LONGEST_KNOWN = 64
_WORDS = re.compile(r"[^\W\d_]+")

#: A feature must occur in so many toxic rows, and be so much more frequent there.
MIN_TOXIC, MIN_LOG_ODDS = 3, 1.5
#: Likelihood ratio asked for beyond that of the best of as many chance features.
EVIDENCE = 6.0
#: Penalty of the lasso, in rows, and most distinct feature sets that it is fitted on.
LASSO, FIT_ROWS = 2.0, 40_000
#: Most features a model may have (capacity of the model, strongest first).
MAX_FEATURES = 50_000


def symbols(text: str) -> np.ndarray:
    """Symbols of a lower-case text; boundaries are collapsed later by the counts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(len(codes) + 2, dtype=np.int64)
    letter = (codes >= 97) & (codes <= 122)
    out[1:-1] = np.where(letter, codes - 96, np.where(codes >= 192, 27, 0))
    return out


def count_characters(df: DataFrame, text_col: str) -> DataFrame:
    """(code, n): trigram counts of symbols over all texts, at most ``N_SYMBOLS ** 3`` rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N_SYMBOLS**3, dtype=np.int64)
        for pdf in batches:
            for text in pdf["t"]:
                if text:
                    s = symbols(text.lower())
                    total += np.bincount((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:], minlength=N_SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    counts = df.select(col(text_col).alias("t")).mapInPandas(count, "code long, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs -log p(third | first, second), smoothed by the bigram and the uniform."""
    table = np.zeros(N_SYMBOLS**3)
    rows = counts.toPandas()  # at most N_SYMBOLS ** 3 rows
    table[rows["code"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    three = table.reshape((N_SYMBOLS,) * 3)
    two = three.sum(axis=0)
    p2 = (two + 1.0) / (two + 1.0).sum(axis=1, keepdims=True)
    p3 = (three + 10.0 * p2[None]) / (three.sum(axis=2, keepdims=True) + 10.0)
    return -np.log(p3)


_LETTER, _MARK, _SPACE, _DIGIT = 1, 2, 4, 8


def _classes() -> np.ndarray:
    """Letter, sign and space flags of the characters below 0x3000; later ones are letters."""
    table = np.zeros(0x3001, dtype=np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = (_LETTER if ch.isalpha() else 0) | (_SPACE if ch.isspace() else 0)
    for ch in [*LOOKALIKES, *_SEPARATORS.strip()]:
        table[ord(ch)] |= _MARK
    for ch in LOOKALIKES:
        table[ord(ch)] |= _DIGIT
    table[0x3000] = _LETTER
    return table


def noisy_regions(text: str, table: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of whole tokens that may hold a noisy span, in order and apart.

    A stretch has a sign followed by a letter, a letter three times running, or two single
    letters side by side. Everything else is clean, so the pattern runs over little text.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 3:
        return []
    kind = table[np.minimum(codes, 0x3000)]
    letter = (kind & _LETTER) > 0
    sign = np.flatnonzero(((kind[:-1] & _MARK) > 0) & letter[1:])
    same = codes[1:] == codes[:-1]
    triple = np.flatnonzero(same[1:] & same[:-1] & letter[2:])
    solid = letter | ((kind & _DIGIT) > 0)
    edge = np.concatenate([[False], solid, [False]])
    alone = np.flatnonzero(solid & ~edge[:-2] & ~edge[2:])
    near = np.flatnonzero(np.diff(alone) <= 3)
    first = np.concatenate([sign, triple, alone[near]])
    if not len(first):
        return []
    last = np.concatenate([sign, triple, alone[near + 1]])
    space = np.concatenate([[-1], np.flatnonzero(kind & _SPACE), [len(codes)]])
    start = space[np.searchsorted(space, first, side="right") - 1] + 1
    end = space[np.searchsorted(space, last, side="left")]
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.concatenate([at[1:] - 1, [len(end) - 1]])].tolist()))


_IS_LETTER, _IS_WORD, _IS_ALNUM, _IS_SIGN, _IS_GAP, _IS_BODY = 1, 2, 4, 8, 16, 32


class _Kinds(dict):
    """What a character may be in a noisy span, worked out when first met."""

    def __missing__(self, ch: str) -> int:
        letter = ch.isalnum() and not ch.isdecimal()
        kind = (
            _IS_LETTER * letter | _IS_WORD * (ch.isalnum() or ch == "_") | _IS_ALNUM * ch.isalnum()
            | _IS_SIGN * (ch in _SIGNS) | _IS_GAP * (ch in _SEPARATORS) | _IS_BODY * (ch in _SIGNS or ch in "._-~'")
        )
        self[ch] = kind
        return kind


_KINDS = _Kinds()


def noisy_spans(text: str) -> list[tuple[int, int]]:
    """Noisy spans of a stretch, first come first, in time in proportion to its length.

    At each place the first of these that holds is taken:
    four or more single letters or signs with one or two separators between them;
    letters and signs mixed, up to the first letter after a sign that ends a word;
    letters with one of them three times running.
    The first two begin and end where no word does. Everything that may follow a place is
    known from a pass from right to left.
    """
    n = len(text)
    kind = [*map(_KINDS.__getitem__, text), 0, 0, 0]
    # Where the spaced form ends if it goes on at a place after 0, 1, 2, 3 or more characters.
    spaced: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * (n + 4)
    mixed_end, next_sign, letter_end = [-1] * (n + 1), [n] * (n + 1), [0] * (n + 1)
    leads, tripled = [False] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        k, after = kind[i], kind[i + 1]
        if k & (_IS_ALNUM | _IS_SIGN):
            ends = [0, 0, 0, 0]
            if after & _IS_GAP:
                two, one = spaced[i + 3] if kind[i + 2] & _IS_GAP else (0, 0, 0, 0), spaced[i + 2]
                ends = [two[c] or one[c] for c in (1, 2, 3, 3)]
            if not ends[3] and k & _IS_ALNUM and not after & (_IS_WORD | _IS_SIGN):
                ends[3] = i + 1
            spaced[i] = tuple(ends)
        if k & (_IS_LETTER | _IS_BODY):
            mixed_end[i] = i + 1 if k & _IS_LETTER and not after & _IS_WORD else mixed_end[i + 1]
            next_sign[i] = i if k & _IS_BODY else next_sign[i + 1]
            leads[i] = bool(k & _IS_LETTER) or bool(k & _IS_SIGN) and leads[i + 1]
        if k & _IS_LETTER:
            letter_end[i] = letter_end[i + 1] if after & _IS_LETTER else i + 1
            if after & _IS_LETTER:
                three = kind[i + 2] & _IS_LETTER and text[i] == text[i + 1] == text[i + 2]
                tripled[i] = bool(three) or tripled[i + 1]
    found, i = [], 0
    while i < n:
        end = 0
        if not i or not kind[i - 1] & (_IS_WORD | _IS_SIGN):
            end = spaced[i][0]
            if not end and leads[i] and next_sign[i] < n:
                end = max(0, mixed_end[next_sign[i] + 1])
        if not end and tripled[i]:
            end = letter_end[i]
        if end:
            found.append((i, end))
        i = end or i + 1
    return found


class Decoder:
    """Viterbi decoding of noisy spans; spans seen before are looked up."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.table = costs, _classes()
        self.known: dict[str, str] = {}

    def __reduce__(self):
        return Decoder, (self.costs,)

    def restore(self, text: str | None) -> str:
        text = (text or "").lower()
        regions = noisy_regions(text, self.table)
        if not regions:
            return text
        out, at = [], 0
        for start, end in regions:
            region, done = text[start:end], 0
            out.append(text[at:start])
            for first, last in noisy_spans(region):
                out += [region[done:first], self.decode(region[first:last])]
                done = last
            out.append(region[done:])
            at = end
        return "".join([*out, text[at:]])

    def decode(self, span: str) -> str:
        """The cheapest reading of a whole span, however long."""
        said = self.known.get(span)
        if said is None:
            said = self._decode(span)
            if len(span) <= _LONGEST_KNOWN:
                if len(self.known) >= 100_000:
                    self.known.clear()
                self.known[span] = said
        return said

    def _decode(self, span: str) -> str:
        costs = self.costs
        # Cost of each pair of last symbols, and its reading as a chain of characters.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, ch in enumerate(span):
            again = i > 0 and span[i - 1] == ch
            options: list[tuple[str, float]] = []
            if ch.isalpha():
                options.append((ch, 0.0))
                if again:
                    many = span[i - 2:i] == ch * 2 if i > 1 else False
                    many = many or span[i + 1:i + 2] == ch
                    options.append(("", DROP_REPEAT if many else DROP_DOUBLE))
            else:
                options += [(c, SWAP) for c in LOOKALIKES.get(ch, "")]
                if ch == "*":
                    options += [(c, WILD) for c in ALPHABET]
                if ch in _SEPARATORS:
                    options.append(("", DROP_SEPARATOR))
                options.append((ch, KEEP_SIGN))
            best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, said) in states.items():
                for c, extra in options:
                    if c:
                        s = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
                        state, now = (b, s), cost + extra + float(costs[a, b, s])
                    else:
                        state, now = (a, b), cost + extra
                    if state not in best or now < best[state][0]:
                        best[state] = (now, (said, c) if c else said)
            states = best
        ended = ((cost + float(costs[a, b, 0]), a, b) for (a, b), (cost, _) in states.items())
        _, a, b = min(ended)
        said, out = states[a, b][1], []
        while said is not None:
            said, c = said
            out.append(c)
        return "".join(reversed(out))


def token_features(token: str) -> tuple[str, ...]:
    """The words inside a white-space token, and the beginnings of the longer ones."""
    out: list[str] = []
    for w in (token,) if token.isalpha() else _WORDS.findall(token):
        out.append(w)
        if len(w) > 4:
            out.append("^" + w[:4])
        if len(w) > 5:
            out.append("^" + w[:5])
    return tuple(out)


_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”„’…"


class Finder:
    """The distinct features of a restored text, of those ``wanted`` if given."""

    def __init__(self, wanted: frozenset | None):
        self.wanted = wanted
        self.starts = None if wanted is None else frozenset(f.lstrip("^")[:4] for f in wanted)

    def find(self, restored: str) -> set[str]:
        found: set[str] = set()
        starts = self.starts
        for token in set(restored.split()):
            word = token.strip(_PUNCT)
            if starts is None:
                found.update(token_features(word))
            elif word[:4] in starts or not word.isalpha():
                found.update(f for f in token_features(word) if f in self.wanted)
        return found


def learn(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, costs: np.ndarray) -> dict:
    """Feature weights and the calibration of their sum, from labelled rows not held out.

    Features of toxic rows are counted first; the other rows are then counted for those
    features only. All labelled rows take part; counts are combined before the shuffle.
    """
    spark = df.sparkSession
    truth = (
        labels.where(col(label_col).isNotNull()).groupBy(col(id_col).alias("i"))
        .agg((F.avg(col(label_col)) >= 0.5).cast("int").alias("y"))
    )
    decoder = Decoder(costs)

    @F.pandas_udf("string")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(sorted(set(decoder.restore(t).split()))) for t in texts], dtype=object)

    # Texts are shuffled and restored once; features need only a text's distinct tokens.
    # The join is the same at every size: labels grow with the texts and are not broadcast.
    with small_batches(spark):
        rows = stage(
            df.where(~held_out(col(id_col))).select(col(id_col).alias("i"), col(text_col).alias("t"))
            .join(truth.hint("merge"), "i").select(tokens("t").alias("t"), "y"),
            "toxicity-train",
        )

    def count(wanted: frozenset | None):
        finder = Finder(wanted)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                seen: Counter = Counter()
                for text in pdf["t"]:
                    seen.update(finder.find(text))
                yield pd.DataFrame({"f": list(seen.keys()), "n": list(seen.values())})
        return run

    def counted(y: int, wanted: frozenset | None) -> DataFrame:
        part = rows.where(F.col("y") == y).select("t").mapInPandas(count(wanted), "f string, n long")
        return part.groupBy("f").agg(F.sum("n").alias("n"))

    with small_batches(spark, 2048):
        size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
        prior = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        if not n_toxic or not n_clean:
            return {"weights": {}, "a": 0.0, "b": _logit(prior)}
        toxic = counted(1, None).where(F.col("n") >= MIN_TOXIC)
        toxic = {r.f: r.n for r in toxic.orderBy(F.desc("n"), "f").limit(MAX_FEATURES).collect()}
        clean = {r.f: r.n for r in counted(0, frozenset(toxic)).collect()}  # at most MAX_FEATURES rows
        weights = choose(toxic, clean, n_toxic, n_clean)
        weights = fit_weights(rows, weights)
        scored = rows.select("y", weigher(weights)("t").alias("s"))
        bins = scored.groupBy(F.round("s", 1).alias("s"), "y").agg(F.count("*").alias("n"))
        a, b = fit_curve(bins.toPandas())
    return {"weights": weights, "a": a, "b": b}


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds of the features whose likelihood ratio holds against testing them all."""
    names = list(toxic)
    if not names:
        return {}
    a = np.array([toxic[f] for f in names], dtype=float)
    b = np.array([clean.get(f, 0) for f in names], dtype=float)
    rate = (a + b) / (n_toxic + n_clean)

    def part(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        k = np.minimum(k, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.where(k > 0, k * np.log(k / n / p), 0.0)
            miss = np.where(k < n, (n - k) * np.log((1 - k / n) / np.maximum(1 - p, 1e-12)), 0.0)
        return hit + miss

    ratio = 2 * (part(a, n_toxic, rate) + part(b, n_clean, rate))
    odds = np.log((a + 0.1) / (n_toxic + 1)) - np.log((b + 0.1) / (n_clean + 1))
    keep = (ratio >= 2 * np.log(len(names)) + EVIDENCE) & (odds >= MIN_LOG_ODDS)
    return {f: float(w) for f, w, k in zip(names, odds, keep) if k}


def fit_weights(rows: DataFrame, candidates: dict[str, float]) -> dict[str, float]:
    """Lasso logistic weights of the candidate features, from restored texts.

    Rows are first counted by their set of features, so copies of a text are one example.
    At most ``FIT_ROWS`` distinct sets, in hash order, are fitted on the driver.
    """
    finder = Finder(frozenset(candidates))

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(finder.find(t)) for t in texts], dtype=object)

    sets = (
        rows.select(found("t").alias("fs"), "y").groupBy("fs", "y").agg(F.count("*").alias("n"))
        .orderBy(F.xxhash64("fs", "y")).limit(FIT_ROWS).toPandas()
    )
    names = {f: i for i, f in enumerate(sorted(candidates))}
    lists = [[names[f] for f in fs] for fs in sets["fs"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.array([i for x in lists for i in x], dtype=np.int64)
    y = sets["y"].to_numpy(dtype=float)
    n = np.where([len(x) == 0 for x in lists], sets["n"].to_numpy(dtype=float), 1.0)
    w = lasso(row, column, len(names), y, n)
    return {f: float(w[i]) for f, i in names.items() if w[i] > 0}


def lasso(row: np.ndarray, column: np.ndarray, width: int, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-negative lasso logistic weights by accelerated proximal gradient steps."""
    deg = np.bincount(row, minlength=len(y)) + 1.0
    step = np.full(width, 1.0)
    total = np.bincount(column, weights=(n * deg)[row], minlength=width)
    step = 4.0 / np.maximum(total, 1.0)
    step_b = 4.0 / max(float((n * deg).sum()), 1.0)
    w, b = np.zeros(width), _logit(float((n * y).sum() / n.sum()))
    v, vb, t = w, b, 1.0
    for _ in range(400):
        z = np.bincount(row, weights=v[column], minlength=len(y)) + vb
        r = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(column, weights=r[row], minlength=width)
        new = np.maximum(v - step * (g + LASSO), 0.0)
        new_b = vb - step_b * float(r.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def fit_curve(bins: pd.DataFrame) -> tuple[float, float]:
    """Newton steps for a logistic curve over binned sums (at most a few hundred rows)."""
    x, y, n = (bins[c].to_numpy(dtype=float) for c in ("s", "y", "n"))
    w = np.zeros(2)
    m = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (n * (y - p)) - 1e-2 * w
        hess = (m * (n * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def weigher(weights: dict[str, float], decoder: Decoder | None = None) -> Callable[[str], Column]:
    """A column function: the sum of the weights of a text's features, restored if a decoder is given."""
    finder = Finder(frozenset(weights))

    def score(text: str | None) -> float:
        if not text:
            return 0.0
        found = finder.find(decoder.restore(text) if decoder else text)
        return sum(sorted(weights[f] for f in found))

    @F.pandas_udf("double")
    def sums(texts: pd.Series) -> pd.Series:
        return pd.Series([score(t) for t in texts], dtype="float64")

    return sums


def add_sums(df: DataFrame, text_col: str, out: str, model: dict, costs: np.ndarray) -> DataFrame:
    """Add the sum of the weights of a restored text's features."""
    return df.withColumn(out, weigher(model["weights"], Decoder(costs))(col(text_col)))


def restore_texts(df: DataFrame, text_col: str, out: str, costs: np.ndarray) -> DataFrame:
    """Add the restored (lower-case, deobfuscated) text."""
    decoder = Decoder(costs)

    @F.pandas_udf("string")
    def restored(texts: pd.Series) -> pd.Series:
        return pd.Series([decoder.restore(t) for t in texts], dtype=object)

    return df.withColumn(out, restored(col(text_col)))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The character model of all texts of ``df`` and the scorer of its labelled rows."""
    with small_batches(df.sparkSession, 2048):
        costs = language_model(count_characters(df, text_col))
    return learn(df, id_col, text_col, labels, label_col, costs) | {"costs": costs}


def add_scores(df: DataFrame, model: dict, text_col: str, out: str) -> DataFrame:
    """Add the probability of being toxic, 0 to 1."""
    odds = F.lit(model["a"]) * F.col(out) + F.lit(model["b"])
    return add_sums(df, text_col, out, model, model["costs"]).withColumn(out, 1 / (1 + F.exp(-odds)))


def score_toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", threshold: float = 0.3,
) -> DataFrame:
    """One row per input row: id, held_out, score and predicted.

    Null and empty texts have no features and get the score of a text without any; a null
    id is not held out; without labels of both classes every score is the labels' mean, 0
    without labels; repeated rows stay; an empty table gives an empty result; other
    columns are not read.
    """
    model = train(df, labels, id_col, text_col, label_col)
    with small_batches(df.sparkSession, 2048):
        scored = stage(
            add_scores(df.select(col(id_col).alias("i"), col(text_col).alias("t")), model, "t", "score")
            .select("i", "score"),
            "toxicity",
        )
    return scored.select(
        F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", threshold: float = 0.3,
) -> DataFrame:
    """The rows of ``df``, all columns, whose score stays below the threshold."""
    model = train(df, labels, id_col, text_col, label_col)
    (score,) = hidden(df, "score")
    return add_scores(df, model, text_col, score).where(F.col(score) < threshold).drop(score)
