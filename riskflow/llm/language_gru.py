"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a token's bytes forwards and backwards and gives every position a
distribution over languages; a document's probabilities are the mean over all its
positions. It is trained in numpy by backpropagation through time on a bounded sample of
labelled documents, drawn for each language on its own, so a rare one is learned as well. State starts anew at each token, so a token's label sums depend on the
token alone: a task labels each token of a batch once and looks repeated ones up, yet every
position of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import col, held_out, small_batches
from riskflow.workspace import stage

#: Training only: different documents, at most, shared out evenly among the languages; tokens
#: of each, in hash order; characters of a token.
TRAIN_ROWS, TRAIN_TOKENS, TRAIN_CHARS = 4_000, 60, 256
HIDDEN, PIECE, BATCH, STEPS, RATE = 16, 16, 256, 1_500, 0.01
#: Tokens a task remembers at most before it starts anew.
REMEMBER = 200_000
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pack(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with a space on both sides, zero padded, one row per token; lengths)."""
    n = np.fromiter((len(t) + 2 for t in tokens), dtype=np.int64, count=len(tokens))
    out = np.zeros((len(tokens), PIECE + 2), dtype=np.uint8)
    flat = np.frombuffer(b"".join(b" " + t + b" " for t in tokens), dtype=np.uint8)
    row = np.repeat(np.arange(len(tokens)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, n


def pieces(token: bytes) -> list[bytes]:
    return [token] if len(token) <= PIECE else [token[i:i + PIECE] for i in range(0, len(token), PIECE)]


class Network:
    """Weights of both directions and the output layer."""

    def __init__(self, classes: int, seed: int = 42):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.w: dict[str, np.ndarray] = {"o": rng.normal(0, 0.1, (2 * h, classes)), "c": np.zeros(classes)}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (256, 3 * h))
            self.w["u" + d] = rng.normal(0, h**-0.5, (h, 3 * h))
            self.w["v" + d] = np.zeros(3 * h)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        h, (n, steps) = HIDDEN, x.shape
        state, out, tape = np.zeros((n, h), np.float32), np.zeros((steps, n, h), np.float32), []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        for t in order:
            a = self.w["x" + d][x[:, t]] + self.w["v" + d]
            u = state @ self.w["u" + d]
            rz = _sigmoid(a[:, :2 * h] + u[:, :2 * h])
            cand = np.tanh(a[:, 2 * h:] + rz[:, :h] * u[:, 2 * h:])
            new = cand + rz[:, h:] * (state - cand)
            new = np.where(live[:, t, None], new, state)
            if keep:
                tape.append((t, state, rz, cand, u))
            state = out[t] = new
        return out, tape

    def label(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of every position: (steps, rows, classes); padding is zero."""
        steps = int(n.max())
        x, live = x[:, :steps], np.arange(steps)[None] < n[:, None]
        both = np.concatenate([self._run(x, live, "f", False)[0], self._run(x, live, "b", False)[0]], axis=2)
        z = both @ self.w["o"] + self.w["c"]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True) * live.T[:, :, None]

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h, steps = HIDDEN, int(n.max())
        x, live = x[:, :steps], np.arange(steps)[None] < n[:, None]
        runs = {d: self._run(x, live, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        z = both @ self.w["o"] + self.w["c"]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        weight = live.T / live.sum()
        rows = np.arange(len(y))
        loss = -float((np.log(p[:, rows, y] + 1e-9) * weight).sum())
        p[:, rows, y] -= 1
        dz = (p * weight[:, :, None]).astype(np.float32)
        g = {"o": np.einsum("tnh,tnc->hc", both, dz), "c": dz.sum(axis=(0, 1))}
        back = dz @ self.w["o"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            gx, gu = np.zeros_like(self.w["x" + d]), np.zeros_like(self.w["u" + d])
            gv, carry = np.zeros_like(self.w["v" + d]), np.zeros((len(y), h), np.float32)
            for t, state, rz, cand, u in reversed(runs[d][1]):
                on = live[:, t, None]
                total = carry + part[t]
                dn = np.where(on, total, 0)
                r, zt = rz[:, :h], rz[:, h:]
                dc = dn * (1 - zt) * (1 - cand * cand)
                da = np.concatenate([dc * u[:, 2 * h:] * r * (1 - r), dn * (state - cand) * zt * (1 - zt), dc], axis=1)
                du = np.concatenate([da[:, :2 * h], dc * r], axis=1)
                np.add.at(gx, x[:, t], da)
                gv += da.sum(axis=0)
                gu += state.T @ du
                carry = np.where(on, dn * zt, total) + du @ self.w["u" + d].T
            g |= {"x" + d: gx, "u" + d: gu, "v" + d: gv}
        return loss, g

    def fit(self, tokens: list[bytes], y: np.ndarray, seed: int = 42) -> None:
        """Adam steps over random batches of tokens; a language is met by the root of its share."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        x, n = pack(tokens)
        odds = np.cumsum(np.bincount(y)[y] ** -0.5)
        for step in range(1, STEPS + 1):
            at = np.minimum(np.searchsorted(odds, rng.random(BATCH) * odds[-1], side="right"), len(y) - 1)
            _, g = self.gradients(x[at], n[at], y[at])
            rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                self.w[k] -= (rate * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], Network | None]:
    """(languages, network) from labelled rows that are not held out."""
    rows = (
        df.where(~held_out(col(id_col)) & col(lang_col).isNotNull() & col(text_col).isNotNull())
        .select(col(lang_col).alias("l"), col(text_col).alias("t"))
    )
    rows = rows.withColumn("h", F.xxhash64("t"))
    found = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    langs = sorted(r.l for r in found)
    if len(langs) < 2:
        return langs, None
    each = max(1, TRAIN_ROWS // len(langs))
    # Different texts below a bound of each language's own: few more than wanted, all of a rare one.
    bounds = F.create_map(*[F.lit(v) for r in found for v in (r.l, min(1.0, 1.3 * each / max(1, r.n)))])
    place = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
    words = F.transform(F.array_distinct(F.split("t", r"\s+")), lambda w: F.struct(
        F.xxhash64(w), F.substring(w, 1, TRAIN_CHARS).alias("w")
    ))
    drawn = (
        rows.where(place < F.element_at(bounds, F.col("l")))
        .select("l", "h", F.slice(F.array_sort(words), 1, TRAIN_TOKENS)["w"].alias("ws"))
        .dropDuplicates(["l", "h"]).toPandas()
    )
    sample = drawn.sort_values(["l", "h"]).groupby("l").head(each)
    code = {lang: i for i, lang in enumerate(langs)}
    tokens, y = [], []
    for lang, words in zip(sample["l"], sample["ws"]):
        for w in words:
            for piece in pieces(w.encode("utf-8", "surrogatepass")):
                if piece:
                    tokens.append(piece)
                    y.append(code[lang])
    if not tokens:
        return langs, None
    net = Network(len(langs))
    net.fit(tokens, np.array(y))
    return langs, net


class Labeller:
    """Sums of position probabilities of tokens; tokens seen before are looked up."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.sums = np.zeros((0, len(net.w["c"]) + 1))

    def __reduce__(self):
        return Labeller, (self.net,)

    def add(self, new: list[bytes]) -> None:
        cut = [pieces(t) for t in new]
        owner = np.repeat(np.arange(len(new)), [len(c) for c in cut])
        flat = [p for c in cut for p in c]
        order = np.argsort([len(p) for p in flat], kind="stable")
        sums = np.zeros((len(new), self.sums.shape[1]))
        for i in range(0, len(order), 4096):
            at = order[i:i + 4096]
            x, n = pack([flat[j] for j in at])
            np.add.at(sums, owner[at], np.concatenate([self.net.label(x, n).sum(axis=0), n[:, None]], axis=1))
        for t in new:
            self.known[t] = len(self.known)
        self.sums = np.concatenate([self.sums, sums])

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Mean position probabilities of each text; zeros for a text without tokens."""
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.known})
        if len(self.known) + len(fresh) > REMEMBER:
            self.known, self.sums = {}, self.sums[:0]
            fresh = list({w for ws in split for w in ws})
        if fresh:
            self.add(fresh)
        out = np.zeros((len(texts), self.sums.shape[1] - 1))
        for i, words in enumerate(split):
            if words:
                total = self.sums[[self.known[w] for w in words]].sum(axis=0)
                out[i] = total[:-1] / total[-1]
        return out


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred and score.

    A text that is null or has no letter is ``und`` with score 0. With one learned language
    every other text is that language with score 1; with none all are ``und``. Repeated
    rows stay; an empty table gives an empty result; other columns are not read.
    """
    langs, net = train(df, id_col, text_col, lang_col)
    labeller = Labeller(net) if net else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) and _LETTER.search(t) else None for t in pdf["t"]]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if labeller is not None:
                p = labeller.documents(texts)
                best = p.argmax(axis=1)
            for i, t in enumerate(texts):
                if t is not None and labeller is not None:
                    lang[i], score[i] = langs[best[i]], p[i, best[i]]
                elif t is not None and len(langs) == 1:
                    lang[i], score[i] = langs[0], 1.0
            yield pd.DataFrame({"i": pdf["i"], "lang_pred": lang, "score": np.clip(score, 0, 1)})

    id_type = df.schema[id_col].dataType.simpleString()
    with small_batches(df.sparkSession, 1024):
        out = stage(
            df.select(col(id_col).alias("i"), col(text_col).alias("t"))
            .mapInPandas(run, f"i {id_type}, lang_pred string, score double"),
            "language",
        )
    return out.select(F.col("i").alias(id_col), held_out(F.col("i")).alias("held_out"), "lang_pred", "score")
