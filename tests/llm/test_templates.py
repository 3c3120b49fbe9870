"""Template matching against a plain matcher, and on texts that are hard on memory."""

import math
import random

import pytest
import regex

from riskflow.llm import decontaminate as D

DOCS = "doc_id long, text string, k1 string, item_id long, width int, hits string"


def brute_tokens(text):
    out = []
    for raw in regex.split(r"\s+", text or ""):
        word = regex.sub(D._MARKS, "", raw)
        if regex.search(r"[\p{L}\p{N}]", word):
            out.append((raw, word))
    return out


def brute_template(toks):
    out = []
    for i, (_, w) in enumerate(toks):
        inside = i > 0 and not regex.search(r"[.!?:][^\p{L}\p{N}]*$", toks[i - 1][0])
        if regex.search(D._NUMBER, w):
            out.append("<number>")
        elif regex.search(r"^\p{Lu}\p{Ll}+$", w) and inside:
            out.append("<name>")
        else:
            out.append("<unit>" if w.lower() in D.UNITS else w.lower())
    return out


def brute(docs, bench, share=D.SHARE):
    found = set()
    for doc_id, text in docs:
        toks = brute_tokens(text)
        template, words = brute_template(toks), [w.lower() for _, w in toks]
        for item_id, item in bench:
            own = brute_tokens(item)
            if not own:
                continue
            want, raw = brute_template(own), [w.lower() for _, w in own]
            width = min(D.WINDOW, len(own))
            at = [p for p in range(len(own) - width + 1) if any(t[0] != "<" for t in want[p:p + width])]
            by_words = not at
            at = at or list(range(len(own) - width + 1))
            need, best = max(1, math.ceil(len(at) * share)), None
            a, b = (raw, words) if by_words else (want, template)
            for shift in range(-len(own), len(words)):
                hits = [p for p in at if shift + p >= 0 and b[shift + p:shift + p + width] == a[p:p + width]]
                if len(hits) < need:
                    continue
                slots = [] if by_words else [t for t in range(len(own)) if want[t][0] == "<" and any(p <= t < p + width for p in hits)]
                pairs = {(want[t], raw[t], words[shift + t]) for t in slots}
                if len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs}):
                    changed = sum(raw[t] != words[shift + t] for t in slots)
                    best = max(best or (0, 0), (len(hits), -changed))
            if best:
                found.add((doc_id, item_id, len(at), best[0], -best[1]))
    return found


def test_matches_equal_a_plain_matcher(spark):
    rng = random.Random(3)
    vocabulary = ["the", "train", "left", "Anna", "Bob", "12", "40", "7.5", "km", "hours", "town", "ran.", "Why", "a-b", "(so)", "3"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, sentence(rng.randint(1, 30))) for i in range(25)]
    bench += [(30, "1 2 3 4 5 6 7 8"), (31, "1 2 3 4 5 6 7 8 9 10"), (32, None), (33, ""), (34, "--"), (35, "12 km 12 km 12 km 12 km x 12")]
    change = {"12": "99", "40": "41", "Anna": "Carl", "km": "miles"}
    docs = []
    for i in range(120):
        item = rng.choice(bench)[1] or ""
        words = item.split()
        if i % 3:
            words = [change.get(w, w) for w in words]
        if i % 5 == 0 and words:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, f"{sentence(rng.randint(0, 12))} {' '.join(words)} {sentence(rng.randint(0, 12))}"))
    docs += [(200, None), (201, ""), (202, "9 8 7 6 5 4 3 2 1 0 9 8 7"), (203, "0 1 2 3 4 5 6 7 8 9 10 11"), (5, docs[5][1]), (None, bench[0][1])]
    frame = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in docs], DOCS)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contaminated(frame, items).collect()
    have = [(r.id, r.item_id, r.n_windows, r.matched, r.changed_slots) for r in got]
    assert set(have) == brute(docs, bench) and len(have) == len(set(have))
    bad = {r[0] for r in have}
    kept = D.decontaminate(frame, items)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


@pytest.mark.parametrize("make", ["numbers", "periodic"])
def test_number_heavy_texts_are_bounded(spark, make):
    """20,000 numbers against 100 items of numbers, and a text of one period in every place."""
    rng = random.Random(1)
    if make == "numbers":
        text = " ".join(str(rng.randint(0, 9)) for _ in range(20_000))
        bench = [(i, " ".join(str(rng.randint(10, 99)) for _ in range(40))) for i in range(99)] + [(99, text[200:300])]
        want = {99}
    else:
        text = "x 1 2 3 " * 5_000
        bench = [(i, f"x {i} 2 {i} " * 8) for i in range(20)]
        # Two of an item's numbers are equal, the text's are not.
        want = set()
    docs = spark.createDataFrame([(1, text, "", 0, 0, "")], DOCS)
    got = D.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r.item_id for r in got} == want
