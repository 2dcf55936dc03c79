"""Where patterns match, as arrays of spans, in built-in expressions only.

A text is the gaps between its matches and the matches in turn, so offsets follow from the lengths
of both. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import NEEDS, Pattern

SPAN = "struct<seq:int,start:int,end:int,category:string,text:string,confidence:double,source:string,shifted_text:string,custom_token:string>"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """A constant array, in one call."""
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def lookup(table: Mapping[str, str | int]) -> Column:
    """A constant map, in one call."""
    return F.expr(f"map({', '.join(_quoted(k) + ', ' + (_quoted(v) if isinstance(v, str) else str(v)) for k, v in table.items())})")


def among(x: Column, values: Iterable[str]) -> Column:
    return F.array_contains(strings(values), x)


def holds_any(text: Column, words: Iterable[str]) -> Column:
    return F.exists(strings(words), lambda w: F.contains(text, w))


def strip(x: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


#: Signs that patterns fold to s and i, but lower case doesn't; the last stands behind i in the lower case of the one before.
_FOLDED = ("ſıİ\u0307", "sii")


def low(text: Column) -> Column:
    """text in lower case, as far as patterns fold it."""
    return F.lower(F.when(_wide(text), F.translate(text, *_FOLDED)).otherwise(text))


def shape(low: Column) -> Column:
    """low with every digit as 0 and all white space as blanks."""
    wide = F.translate(F.regexp_replace(F.regexp_replace(low, r"\p{Nd}", "0"), r"(?U)\s", " "), *_FOLDED)
    return F.when(_wide(low), wide).otherwise(F.translate(low, "123456789\t\n\x0b\f\r", "000000000     "))


def words(shape: Column) -> Column:
    return F.split(shape, "[^a-z]+")


def _wide(x: Column) -> Column:
    """Whether there is a sign beyond ASCII."""
    return F.octet_length(x) != F.char_length(x)


def gate(p: Pattern, low: Column, shaped: Column | None = None, worded: Column | None = None) -> Column:
    """Whether the pattern may match. low: the text in lower case; shaped and worded: its shape and words, if they are at hand."""
    shaped = shape(low) if shaped is None else shaped
    needs = p.needs or NEEDS.get(p.name, [""])
    whole = [x[1:] for x in needs if x[:1] == "="]
    tests = [F.arrays_overlap(words(shaped) if worded is None else worded, strings(whole))] if whole else []
    tests += [F.contains(shaped, F.lit(x)) for x in needs if x[:1] not in "=~" or not x]
    tests += [F.rlike(low, F.lit("(?U)" + x[1:])) for x in needs if x[:1] == "~"]
    return reduce(Column.__or__, tests)


#: Noncharacters that mark where matches and their groups stand while they are taken apart.
_EDGE, _GROUP = "\ufdd0", "\ufdd1"


def matches(text: Column, regex: Column | str, groups: int = 0, when: Column | None = None) -> Column:
    """array<struct<at, m, g1...>>: start and text of each match, and its groups' texts ('' for
    those that take no part). when: a cheap condition without which there is no match.

    One replacement marks the matches and a split takes them out: regexp_extract_all copies the whole
    text for each match."""
    pattern = F.lit(regex) if isinstance(regex, str) else regex
    none = F.array().cast(f"array<struct<{','.join(['at:int', 'm:string', *[f'g{i}:string' for i in range(1, groups + 1)]])}>>")
    marked = F.contains(text, F.lit(_EDGE)) | F.contains(text, F.lit(_GROUP))
    clean = F.when(marked, F.translate(text, _EDGE + _GROUP, "\ufffd\ufffd")).otherwise(text)
    shape = _EDGE + "$0" + "".join(f"{_GROUP}${i}" for i in range(1, groups + 1)) + _EDGE
    pieces = F.split(F.regexp_replace(clean, pattern, F.lit(shape)), _EDGE, -1)
    own = lambda piece: F.substring_index(piece, _GROUP, 1) if groups else piece

    def starts(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at = acc["at"] + F.length(F.get(x, 2 * i))
            return F.struct((at + F.length(own(F.get(x, 2 * i + 1)))).alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(x) - 3) / 2).cast("int")), zero, step)["all"]

    def take(x: Column, at: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            parts = F.split(F.get(x, 2 * i + 1), _GROUP, -1) if groups else F.array(F.get(x, 2 * i + 1))
            return let(parts, lambda p: F.struct(a.alias("at"), F.when(marked, F.substring(text, a + 1, F.length(F.get(p, F.lit(0))))).otherwise(F.get(p, F.lit(0))).alias("m"), *[F.get(p, F.lit(j)).alias(f"g{j}") for j in range(1, groups + 1)]))

        return F.transform(at, one)

    out = let(pieces, lambda x: F.when(F.size(x) > 1, let(starts(x), lambda at: take(x, at))).otherwise(none))
    return out if when is None else F.when(when, out).otherwise(none)


def span(start: Column, end: Column, category: str, text: Column, confidence: float, source: str, custom: str | None = None) -> Column:
    """A span without its place among the others."""
    return F.struct(F.lit(0).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(category).alias("category"), text.alias("text"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("shifted_text"), F.lit(custom).cast("string").alias("custom_token"))


def find_spans(text: Column, p: Pattern, custom: str | None = None, when: Column | None = None) -> Column:
    """The pattern's spans in text, in order. when: as in matches()."""

    def make(start: Column, value: Column, shown: Column, size: Column) -> Column:
        return span(start, start + size, p.category, shown, p.confidence, p.source, custom)

    def value(x: Column) -> Column:
        own = x["g2"] != ""
        v = F.when(own, x["g2"]).otherwise(x["m"])
        return make(x["at"] + F.when(own, F.length(x["g1"])).otherwise(0), v, v, F.length(v))

    if p.kind in ("whole", "trimmed"):
        shown = strip if p.kind == "trimmed" else lambda x: x
        out = F.transform(matches(text, p.java), lambda x: make(x["at"], x["m"], shown(x["m"]), F.length(x["m"])))
    elif p.kind == "value":
        out = F.transform(matches(text, p.java, 2), value)
    elif p.kind == "stripped":
        out = F.transform(matches(text, p.java, 2), lambda x: let(strip(x["g2"]), lambda v: make(x["at"] + F.length(x["g1"]), v, v, F.length(v))))
    else:
        raise ValueError(p.kind)
    return out if when is None else F.when(when, out).otherwise(no_spans())


def numbered(*found: Column) -> Column:
    """All spans in one array, each with its place as seq."""
    return F.transform(F.concat(*found), lambda s, i: s.withField("seq", i))
