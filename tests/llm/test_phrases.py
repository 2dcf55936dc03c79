import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import phrases


def lowered(t):
    return "".join(c.lower() if c < "\x80" else c for c in t)


def brute(rows, least, top=2000):
    """rows: text, lang."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lowered(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(5, len(w) - i) + 1):
                    count[tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held.get(p[i:j], 0), a)
        scored = []
        for p, a in often.items():
            if held.get(p, 0) < a:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(rng, n):
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    fixed = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(6)]
    rows = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(0, 30)):
            t += (rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary)) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "])
        rows.append((t.title() if rng.random() < 0.2 else t, rng.choice(["en", "en", "de", None, "und"])))
    return rows


def mined(df, least):
    return sorted(map(tuple, phrases.mine(df, least=least).collect()))


@pytest.mark.parametrize("hot", [phrases.HOT, 20])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    rows = texts(random.Random(1), 500)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, 8)
    assert mined(df, 8) == want and len(want) > 50 and {r[0] for r in want} == {"en", "de", "und"}


def test_text_and_routes_in_parts(spark, monkeypatch):
    """Tasks that work in many small steps count the same."""
    rows = texts(random.Random(2), 300)
    monkeypatch.setattr(phrases, "CHUNK", 900)
    monkeypatch.setattr(phrases, "SORTED", 5)
    monkeypatch.setattr(phrases, "PIECE", 50)
    assert mined(spark.createDataFrame(rows, "text string, lang string").repartition(2), 5) == brute(rows, 5)


def test_hard_rows(hard, hard_rows, empty):
    rows = [(t, lang) for _, t, lang, *_ in hard_rows]
    assert mined(hard, 3) == brute(rows, 3)
    assert mined(empty, 2) == []


def test_ties_and_places_at_the_end_of_a_language(spark):
    rows = [("b a c a b a", "x"), ("c a", "x"), ("b a. c a", "x"), ("a", None), ("", "y"), (None, "z"), ("..", "x")] * 3
    assert mined(spark.createDataFrame(rows, "text string, lang string"), 3) == brute(rows, 3)


def test_sorting_counts_prefixes():
    rng = np.random.default_rng(5)
    letters = rng.integers(0, 3, (400, 4))
    for row in letters:
        row[rng.integers(2, 5) :] = -1
    n = rng.integers(1, 4, 400)
    got = {(tuple(letters[i, :k]), c) for i, k, c in phrases.frequent_prefixes(letters, n, 30)}
    count = Counter()
    for row, c in zip(letters.tolist(), n.tolist(), strict=True):
        for k in range(2, 5):
            if row[k - 1] >= 0:
                count[tuple(row[:k])] += c
    assert got == {(p, c) for p, c in count.items() if c >= 30}
