"""JSON as text: a strict check of the grammar and a minifier, both by patterns over the raw text.

A record is turned into a skeleton, in which every string is one letter, every other scalar another, and blanks are gone. Then
innermost objects and arrays become scalars, level by level, until one letter is left or nothing more fits. Possessive
repetitions keep the patterns from going back, so a record's time is in proportion to its length for each level of nesting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1F]*+)*+"'
SCALAR = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null"
#: Marks of values in a skeleton; no JSON text holds these characters bare.
KINDS = {"string": "\x01", "scalar": "\x02", "object": "\x03", "array": "\x04", "objects": "\x05", "empty": "\x06"}
VALUE = r"[\x01-\x06]"
OBJECT = rf"\{{(?:\x01:{VALUE}(?:,\x01:{VALUE})*+)?+\}}"
ARRAY = rf"\[(?:{VALUE}(?:,{VALUE})*+)?+\]"
#: What stands for what, in the order of a level's steps: empty arrays, arrays of objects only, other arrays, objects.
STEPS = ((r"\[\]", "empty"), (r"\[\x03(?:,\x03)*+\]", "objects"), (ARRAY, "array"), (OBJECT, "object"))
#: Whole texts that one pattern tells: objects of scalars and of objects and arrays of scalars, and arrays of such objects. What a
#: value is shows in its first character, so that possessive repetitions lose nothing; all other texts go through their skeleton.
_BLANK = r"[ \t\n\r]*+"


def _listed(opening: str, item: str, closing: str) -> str:
    return rf"{opening}{_BLANK}(?:{item}{_BLANK}(?:,{_BLANK}{item}{_BLANK})*+)?+{closing}"


def _object_of(value: str) -> str:
    return _listed(r"\{", rf"{STRING}{_BLANK}:{_BLANK}(?:{value})", r"\}")


PLAIN = rf"{STRING}|{SCALAR}"
SHALLOW = _object_of(rf"{PLAIN}|{_object_of(PLAIN)}|{_listed(r'\[', f'(?:{PLAIN})', r'\]')}")
SHALLOW_OBJECT = rf"\A{_BLANK}{SHALLOW}{_BLANK}\z"
SHALLOW_OBJECTS = rf"\A{_BLANK}\[{_BLANK}{SHALLOW}{_BLANK}(?:,{_BLANK}{SHALLOW}{_BLANK})*+\]{_BLANK}\z"
#: Levels of nesting that are taken by default; Spark's own JSON functions take no more.
DEPTH = 1000


def skeleton(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, F.lit(STRING), F.lit(KINDS["string"])), F.lit(SCALAR), F.lit(KINDS["scalar"]))
    return F.regexp_replace(marked, F.lit(r"[ \t\n\r]++"), F.lit(""))


def _flattened(skeleton: Column, depth: int) -> Column:
    """What is left of a skeleton after ``depth`` levels. Each level makes the text shorter or is the last that is looked at."""

    def level(held: Column, _: Column) -> Column:
        flat = held["text"]
        for pattern, kind in STEPS:
            flat = F.regexp_replace(flat, F.lit(pattern), F.lit(KINDS[kind]))
        return F.when(F.length(held["text"]) == held["before"], held).otherwise(F.struct(flat.alias("text"), F.length(held["text"]).alias("before")))

    def levels(text: Column) -> Column:
        opening = F.length(text) - F.length(F.translate(text, "{[", ""))
        start = F.struct(text.alias("text"), F.lit(-1).alias("before"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), opening))), start, level)["text"]

    return _once(skeleton, levels)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_kind(text: Column, depth: int = DEPTH) -> Column:
    """What a JSON text (RFC 8259) is: ``string``, ``scalar``, ``object``, ``array``, ``objects`` for an array of nothing but objects,
    or ``empty`` for one of nothing. Else, with a question mark in front, what is wrong: ``?null``, ``?syntax``, or ``?depth`` where the
    text is nested deeper than ``depth`` levels and no other fault is seen. Repeated keys and numbers of any size are valid; a byte
    order mark is not."""
    left = F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit("")).otherwise(_flattened(skeleton(text), depth))

    def named(x: Column) -> Column:
        found = F.when(x.rlike(f"{ARRAY}|{OBJECT}"), "?depth").otherwise("?syntax")
        for kind, mark in KINDS.items():
            found = F.when(x == mark, kind).otherwise(found)
        return found

    known = F.when(text.isNull(), "?null")
    if depth >= 3:
        known = known.when(text.rlike(SHALLOW_OBJECT), "object").when(text.rlike(SHALLOW_OBJECTS), "objects")
    return known.otherwise(_once(left, named))


def json_problem(text: Column, depth: int = DEPTH) -> Column:
    """Null for a valid JSON text, else ``null``, ``syntax`` or ``depth``, as ``json_kind`` has them."""
    return _once(json_kind(text, depth), lambda k: F.when(k.startswith("?"), F.substring(k, 2, 9)))


def json_minified(text: Column) -> Column:
    """The text without blanks outside of strings. Keys keep their order and repetitions, and scalars their spelling."""
    return F.regexp_replace(text, F.lit(rf"({STRING})|[ \t\n\r]++"), F.lit("$1"))


def js_number(text: Column) -> Column:
    """A JSON number as JavaScript prints it: the shortest digits of the double, plain from 1e-6 to below 1e21."""

    def parts(java: Column) -> Column:
        whole, fraction = F.regexp_extract(java, r"^-?([0-9]+)", 1), F.regexp_extract(java, r"\.([0-9]+)", 1)
        exponent = F.coalesce(F.regexp_extract(java, r"E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
        digits, kept = F.concat(whole, fraction), F.regexp_replace(F.concat(whole, fraction), "^0+", "")
        point = F.length(whole) + exponent - (F.length(digits) - F.length(kept))
        return F.struct(F.when(java.startswith("-"), "-").otherwise("").alias("sign"), F.regexp_replace(kept, "0+$", "").alias("digits"), point.alias("point"), java.alias("java"))

    def written(p: Column) -> Column:
        d, n, k = p["digits"], p["point"], F.length(p["digits"])
        power = n - 1
        tail = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
        plain = F.when(n >= k, F.concat(d, F.repeat(F.lit("0"), n - k))).when(n > 0, F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d)
        shown = F.when((n > 0) & (n <= 21), plain).when((n > -6) & (n <= 0), small).when(k == 1, F.concat(d, tail)).otherwise(F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, F.lit(2), k), tail))
        return F.when(d == "", F.when(p["java"].contains("Inf"), p["java"]).otherwise("0")).otherwise(F.concat(p["sign"], shown))

    return _once(_once(text.try_cast("double").cast("string"), parts), written)


#: What marks a number that is carried as a string; a text with this escape of its own keeps its numbers' spelling.
MARK = "\x02"


def with_marked_numbers(text: Column) -> Column:
    """A minified JSON text with its numbers as marked strings in JavaScript's spelling, so that no reader respells them. A text with
    none but short integers needs no marks."""
    tokens = F.regexp_extract_all(text, F.lit(rf"({STRING}|-?[0-9][0-9.eE+-]*+|[^\"0-9-]++)"), F.lit(1))
    short = lambda t: t.rlike("^(?:0|-?[1-9][0-9]{0,14}+)$")  # noqa: E731  # a short integer is spelled as it is
    marked = F.transform(tokens, lambda t: F.when(short(t), F.concat(F.lit('"\\u0002'), t, F.lit('"'))).when(t.rlike("^-?[0-9]"), F.concat(F.lit('"\\u0002'), js_number(t), F.lit('"'))).otherwise(t))
    plain = ~F.regexp_replace(text, F.lit(STRING), F.lit("")).rlike("[0-9][.eE]|-0|[0-9]{16}")
    return F.when(text.contains("\\u0002") | plain, text).otherwise(F.array_join(marked, ""))


def without_marks(value: Column) -> Column:
    """A field's text with the marks of numbers gone: of its own, or of those in a nested text."""
    return F.when(value.startswith(MARK), F.substring(value, 2, 1 << 30)).when(value.rlike(r"^[\[{]"), F.regexp_replace(value, r'"\\u0002([^"]*+)"', "$1")).otherwise(value)
