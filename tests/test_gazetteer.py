import random
import re

import pytest

from maskwright.functions import patterns as P
from maskwright.operators import gazetteer


def brute(text, names):
    """Leftmost longest, by trying every name at every place."""
    words = [m.span() for m in re.finditer(r"\w+", text or "")]
    out, at = [], 0
    for i, (start, _) in enumerate(words):
        best = None
        for name, kind in names:
            own = [m.span() for m in re.finditer(r"\w+", name or "")]
            if not own or i + len(own) > len(words):
                continue
            end = words[i + len(own) - 1][1]
            if " ".join(text[start:end].split()) == " ".join(name[own[0][0] : own[-1][1]].split()) and (best is None or (end, ) > (best[0], ) or end == best[0] and kind < best[1]):
                best = (end, kind)
        if best and start >= at:
            out.append((start, best[0], " ".join(text[start : best[0]].split()), best[1]))
            at = best[0]
    return out


NAMES = [("San", "x"), ("San Jose", "CITY"), ("San  Jose del Cabo", "CITY"), ("Jose del", "y"), ("St. Louis", "CITY"), ("Wilkes-Barre", "CITY"), ("del Cabo San", "z"), ("San Jose", "AREA"), ("New York", "CITY"), ("York New", "w"), (None, "none"), ("", "none"), ("--", "none"), ("Île", "CITY")]


@pytest.mark.parametrize("bits", [gazetteer.BITS, 3])
def test_equals_brute_force(spark, bits):
    rng = random.Random(3)
    parts = ["San", "Jose", "del", "Cabo", "St.", "St", "Louis", "Wilkes-Barre", "Wilkes", "Barre", "New", "York", "Île", "île", "new", "Sandel", "é"]
    docs = [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", "\n", "  ", ", ", "-"]) for _ in range(rng.randint(0, 30))), "extra") for i in range(80)]
    docs += [(100, None, None), (101, "", None), (None, "in San Jose", None), (102, "New York " * 20_000, None), (103, "a😀b San Jose", None)]
    frame = spark.createDataFrame(docs, "doc long, text string, category string").repartition(5)
    names = spark.createDataFrame(NAMES, "name string, category string")
    got = {}
    for r in gazetteer.find_names(frame, "doc", "text", names, bits=bits).collect():
        got.setdefault(r.doc, []).append((r.start, r.end, r.text, r.category))
    want = {d: x for d, t, _ in docs if d != 102 and (x := brute(t, NAMES))}
    assert len(got.pop(102)) == 20_000
    assert {d: sorted(x) for d, x in got.items()} == want and sum(map(len, want.values())) > 200


def test_same_as_the_pattern_of_cities(spark):
    listed = re.search(r"\(\?:(.*)\)\\b$", P.CITY.regex)[1].split("|")
    names = [(x.replace(r"\s+", " ").replace("\\.", ".").replace(".?", "."), "CITY") for x in listed]
    text = " and ".join(n for n, _ in names) + ". Bostonian, in  New\nYork; Chicago-Boston."
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    got = [(r.start, r.end) for r in gazetteer.find_names(docs, "doc", "text", spark.createDataFrame(names, "name string, category string")).orderBy("start").collect()]
    assert got == [m.span() for m in re.finditer(P.CITY.regex, text)]


def test_empty_tables_and_large_lists(spark):
    docs = spark.createDataFrame([("a", "Town 999 and Town 123456"), ("b", "Village 5")], "id string, body string")
    many = spark.range(200_000).selectExpr("concat('Town ', id) as name", "'CITY' as category")
    found = gazetteer.find_names(docs, "id", "body", many)
    assert sorted((r.id, r.text) for r in found.collect()) == [("a", "Town 123456"), ("a", "Town 999")]
    assert gazetteer.find_names(docs, "id", "body", many.limit(0)).count() == 0
    assert gazetteer.find_names(docs.limit(0), "id", "body", many.limit(10)).count() == 0
