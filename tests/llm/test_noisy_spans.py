"""Noisy spans against the patterns that define them, and decoding against enumeration."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from riskflow.llm import common, toxicity as T

SIGN = r"0-9@$!|+(€£*"
PATTERN = re.compile(
    rf"(?<![\w{SIGN}])(?:(?:[^\W_]|[{SIGN}])[ .,_*\-~'/]{{1,2}}){{3,}}[^\W_](?![\w{SIGN}])"
    rf"|(?<![\w{SIGN}])(?=[{SIGN}]*[^\W\d_])[^\W\d_]*(?:[{SIGN}._\-~'][^\W\d_{SIGN}]*?)+[^\W\d_]+(?!\w)"
    r"|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*"
)


@pytest.mark.parametrize("alphabet", ["ab1. *", "abé@-_ .'", "aab!3 ,/~½", "a* ", "ab.c d0$"])
def test_spans_are_those_of_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 18)))
        assert T.noisy_spans(text) == [m.span() for m in PATTERN.finditer(text)], text


@pytest.fixture(scope="module")
def decoder(spark, small_dir):
    counts = T.count_characters(common.table(spark, small_dir, "documents"), "text")
    return T.Decoder(T.language_model(counts))


def readings(span):
    """Every reading of a span with its channel cost."""
    for i, ch in enumerate(span):
        if ch.isalpha():
            own = [(ch, 0.0)]
            if i and span[i - 1] == ch:
                many = span[max(0, i - 2):i] == ch * 2 or span[i + 1:i + 2] == ch
                own.append(("", T.DROP_REPEAT if many else T.DROP_DOUBLE))
        else:
            own = [(c, T.SWAP) for c in T.LOOKALIKES.get(ch, "")]
            own += [(c, T.WILD) for c in T.ALPHABET] if ch == "*" else []
            own += [("", T.DROP_SEPARATOR)] if ch in T._SEPARATORS else []
            own.append((ch, T.KEEP_SIGN))
        yield own


def cost(decoder, said, extra):
    codes = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0 for c in said), 0]
    return extra + sum(float(decoder.costs[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:]))


def test_decoding_is_the_cheapest_reading(decoder):
    rng = random.Random(2)
    for _ in range(150):
        span = "".join(rng.choice("abest1034@$.-* ") for _ in range(rng.randint(1, 6)))
        if span.count("*") > 1:
            continue
        best = min(
            cost(decoder, "".join(c for c, _ in way), sum(x for _, x in way)) for way in itertools.product(*readings(span))
        )
        said = decoder.decode(span)
        ways = ["".join(c for c, _ in way) for way in itertools.product(*readings(span))
                if abs(cost(decoder, "".join(c for c, _ in way), sum(x for _, x in way)) - best) < 1e-9]
        assert said in ways, span


def test_long_spans_are_read_whole(decoder):
    """A long span is one lattice: its reading costs no more than that of its parts."""
    def spent(span, said):
        """Cost of the cheapest way from a span to a reading, by the place reached in it."""
        reach = {0: 0.0}
        for own in readings(span):
            now = {}
            for at, x in reach.items():
                for c, extra in own:
                    if said.startswith(c, at):
                        now[at + len(c)] = min(now.get(at + len(c), np.inf), x + extra)
            reach = now
        return cost(decoder, said, reach[len(said)])

    rng = random.Random(7)
    for _ in range(20):
        span = "".join(rng.choice("aeinrst") + rng.choice([" ", "", "-"]) for _ in range(120)) + "x"
        parts = "".join(decoder.decode(span[i:i + 48]) for i in range(0, len(span), 48))
        assert spent(span, decoder.decode(span)) <= spent(span, parts) + 1e-9


@pytest.mark.parametrize("text", ["ab" * 200_000 + "=aaa", "a-" * 200_000, "a" + "*" * 3_000 + "=", "a." * 100_000 + "9", "é" * 400_000])
def test_long_tokens_take_linear_time(decoder, text):
    start = time.time()
    assert decoder.restore(text) is not None
    assert time.time() - start < 60
    small = T.noisy_spans(text[:1000])
    assert all(0 <= a < b <= 1000 for a, b in small) and np.all(np.diff([x for s in small for x in s]) >= 0)
