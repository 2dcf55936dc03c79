import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import langid

SYLLABLES = {"aa": ["ba", "lo", "mi", "ré"], "bb": ["kt", "zu", "pf", "ö"], "cc": ["the", "ing", "ou", "er"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def letters(t):
    return "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()


def parts(word):
    marked = f"<{word}>"
    return [marked[i : i + n] for n in range(1, 6) for i in range(len(marked) - n + 1)]


class Brute:
    """The method in plain Python."""

    def __init__(self, rows):
        rows = [r for r in rows if r[1] is not None and r[2] is not None and r[0] is not None]
        docs = Counter(r[2] for r in rows)
        self.langs = sorted(docs)
        self.prior = {x: math.log(docs[x] / len(rows)) for x in self.langs}
        self.words, self.grams = ({x: Counter() for x in self.langs} for _ in range(2))
        for _, t, lang in rows:
            for w in letters(t):
                self.words[lang][w] += 1
                self.grams[lang].update(parts(w))

    def log(self, counts, item, lang):
        known = set().union(*counts.values())
        return math.log((counts[lang][item] + 0.5) / (sum(counts[lang].values()) + 0.5 * len(known)))

    def cut(self, word):
        marked, i, out, known = f"<{word}>", 0, [], set().union(*self.grams.values())
        while i < len(marked):
            n = next((n for n in range(5, 0, -1) if i + n <= len(marked) and marked[i : i + n] in known), None)
            if n:
                out.append(marked[i : i + n])
            i += n or 1
        return out

    def predict(self, t):
        if not letters(t):
            return "und", 0.0
        total, known = dict(self.prior), set().union(*self.words.values())
        for w in letters(t):
            for x in self.langs:
                total[x] += self.log(self.words, w, x) if w in known else sum(self.log(self.grams, g, x) for g in self.cut(w))
        best = max(self.langs, key=total.get)
        return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_same_as_plain_python(spark, monkeypatch):
    rng = random.Random(5)
    learn = [(i, text(rng, lang, rng.randint(1, 6)), lang) for i in range(30) for lang in [rng.choice(sorted(SYLLABLES))]] + [(30, None, "aa"), (31, "lo ba", None), (None, "ing", "bb")]
    ask = [text(rng, rng.choice(sorted(SYLLABLES)), rng.randint(0, 6)) for _ in range(40)] + ["", None, "ba½lo", "½ ² ①", "İstanbul baba", "x" * 40, "ba" * 30, learn[0][1].upper()]
    brute, model = Brute(learn), langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    want = [brute.predict(t) for t in ask]
    for piece in (langid.PIECE, 20):  # texts in one piece, and cut
        monkeypatch.setattr(langid, "PIECE", piece)
        got = langid.predict(model, ask)
        assert [x[0] for x in got] == [x[0] for x in want]
        assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-4)
    rows = spark.createDataFrame(list(enumerate(ask)), "i long, text string")
    assert [r.lang_pred for r in langid.identify(rows, model).orderBy("i").collect()] == [x[0] for x in want]


def test_rare_words_count(spark):
    """A word seen once is known; `least` is a parameter."""
    df = spark.createDataFrame([(1, "once", "x"), (2, "twice twice", "y")], "doc_id long, text string, lang string")
    key = lambda w: langid.words(langid.codes_of(w))[2]
    assert langid.train(df)["words"].find(np.concatenate((key("once"), key("never")))).tolist()[1] == -1
    assert langid.train(df)["words"].find(key("once"))[0] >= 0
    assert langid.train(df, least=2)["words"].find(key("once"))[0] == -1


def test_number_signs_are_no_letters(spark):
    df = spark.createDataFrame([(1, "some words", "en"), (2, "des mots", "fr")], "doc_id long, text string, lang string")
    got = langid.predict(langid.train(df), ["½ ² ① Ⅷ 12", "½a"])
    assert got[0] == ("und", 0.0) and got[1][0] in ("en", "fr")


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(3, 40)), lang) for i in range(600) for lang in [rng.choice(sorted(SYLLABLES))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 3 <> 0"))
    got = langid.identify(df.where("doc_id % 3 = 0"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.lang_score <= 1 for r in got)


def test_bounded_sample(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, text(rng, "aa", 5), "aa") for i in range(2000)], "doc_id long, text string, lang string")
    few = langid.train(df, max_docs=50)
    assert 0 < len(few["words"].key) < len(langid.train(df)["words"].key)


def test_many_languages(spark):
    df = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q", f"l{i}") for i in range(1200)], "doc_id long, text string, lang string")
    assert len(langid.train(df)["langs"]) == 1200


def test_hard_rows(hard, hard_rows, empty):
    model = langid.train(hard)
    got = langid.identify(hard, model)
    assert got.columns == [*hard.columns, "lang_pred", "lang_score"]
    rows = got.collect()
    assert len(rows) == len(hard_rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {r[0] for r in hard_rows if not any(c.isalpha() for c in r[1] or "")}
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(hard, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(hard.withColumn("lang_pred", F.lit("old")), model).where("lang_pred = 'old'").count() == 0
