import base64
import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from loomwork.functions import js_compat as js
from loomwork.functions import json_text
from loomwork.operators import integrity, reshape
from tests.conftest import rows


def test_hashes_groups_and_manifest(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k long, t string")
    hashed = integrity.content_hash(df, "k", "t")
    a = hashlib.sha256(b"a").hexdigest()
    assert rows(integrity.duplicate_groups(hashed, "k")) == [(1, a, 2, 1), (2, a, 2, 1)]
    expected = spark.createDataFrame([(1, a.upper() + " "), (2, "beef"), (3, "  "), (9, a)], "k long, expected string")
    assert dict(rows(integrity.verify_manifest(hashed, expected, "k"))) == {1: "match", 2: "mismatch", 3: "no_expected", 4: "unlisted", 9: "missing"}


def test_payloads(spark):
    long = "é" * 100
    df = spark.createDataFrame([(1, base64.b64encode("hé你".encode()).decode()), (2, "***"), (3, base64.b64encode(b"\xff\xfe").decode()), (4, "aG Vs\nbG8=")], "k long, p string")
    got = {r.k: (r.ok, r.reason, r.decoded) for r in integrity.decode_payloads(df, "k", "p").collect()}
    assert got == {1: (True, None, "hé你"), 2: (False, "not_base64", None), 3: (False, "not_utf8", None), 4: (True, None, "hello")}
    one = spark.createDataFrame([(1, long)], "k long, p string")
    assert integrity.encode_payloads(one, "k", "p").first().payload == base64.b64encode(long.encode()).decode()


def test_url_rules(spark):
    df = spark.createDataFrame([("a b+c!~*'()é/?",)], "t string")
    encoded = df.select(js.url_encode(F.col("t")).alias("e"))
    assert encoded.first().e == "a%20b%2Bc!~*'()%C3%A9%2F%3F"
    assert encoded.select(js.url_decode(F.col("e")).alias("d")).first().d == df.first().t
    bad = spark.createDataFrame([("%zz",), ("a+b",)], "t string")
    assert [r.d for r in bad.select(js.url_decode(F.col("t")).alias("d")).collect()] == [None, "a+b"]
    urls = spark.createDataFrame([(1, "http://h.x/p?a=1&b=x%20y&c&d=%zz"), (2, "http://h.x/")], "k long, u string")
    got = rows(integrity.url_components(urls, "k", "u").select("k", "param", "value", "ok"))
    assert got == [(1, "a", "1", True), (1, "b", "x y", True), (1, "c", "", True), (1, "d", None, False), (2, None, None, True)]


def test_strength(spark):
    table = [("", 0, 0, "Not generated"), ("abc", 14, 1, "Fair"), ("Abc123!xYz90Qw", 91, 4, "Very strong"), ("a b", 17, 1, "Fair"), ("a\u3000b", 17, 1, "Fair"), ("\U0001f600", 10, 1, "Fair"), ("qwertyuiop", 47, 2, "Good"), ("k7Jw2pQx9m", 60, 3, "Strong")]
    df = spark.createDataFrame([(t,) for t, *_ in table], "t string")
    assert [tuple(r) for r in df.select(*integrity.strength(F.col("t"))).collect()] == [tuple(want) for _, *want in table]


def test_strength_is_worked_out_once(spark):
    """Each token's classes are looked for once, however often its bits are looked at; small letters, ASCII and other texts agree."""
    import math

    words = ["lowercaseonly", "UPPERCASE", "Mixed-case_9", "with,marks!", "snake_case_", "123456789", "żółćżółćżó", "żółć_żółćA1", "abc\u3000def", "\U0001f600" * 5, "a\x1fbcdefgh"]
    df = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "short words")], "k int, t string")
    got = integrity.secret_strength(df, "k", "t", r"\S{5,}")

    def bits(t):
        pool = sum(n for n, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (28, "[^A-Za-z0-9\u3000]")) if re.search(p, t))
        return round(len(t.encode("utf-16-be")) // 2 * math.log2(max(pool, 48 if re.search("[_\u3000-]", t) else 1)))

    level = lambda b: 4 if b >= 80 else 3 if b >= 60 else 2 if b >= 40 else 1
    want = [(1, hashlib.sha256(t.encode()).hexdigest(), b, level(b), integrity.STRENGTHS[level(b)]) for t in words for b in [bits(t)]]
    assert rows(got) == sorted([*want, *((3, hashlib.sha256(t.encode()).hexdigest(), 24, 1, "Fair") for t in ("short", "words"))])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[0-9]") < 8


def test_shallow_texts_are_told_by_one_pattern(spark):
    """What the pattern takes is what the skeleton says, and it leaves nothing invalid through."""
    good = {"object": ['{}', ' { "a" : [1, -2.5e3, "x"], "b":{"c":null} }\n', '{"a":[]}', '{"\\u00e9\\"":"}"}'], "objects": ['[{}]', '[ {"a":1} , {"b":[true]} ]']}
    bad = ['{"a":01}', '{"a":1,}', '{"a" 1}', '[{"a":1},]', '{"a":"\x01"}', '{"a":1} x', '{"a":+1}', "{'a':1}", '{"a":[1,]}', '{"a":NaN}', '{"a":1}\x0b', '{"a":"\\x"}', '[]', '[{},1]', '"{}"', '{"a":{"b":{"c":1}}}']
    table = [(t, kind) for kind, texts in good.items() for t in texts]
    df = spark.createDataFrame([*table, *((t, None) for t in bad)], "t string, kind string")
    t = F.col("t")
    told = F.when(t.rlike(json_text.SHALLOW_OBJECT), "object").when(t.rlike(json_text.SHALLOW_OBJECTS), "objects")
    for r in df.select("t", "kind", told.alias("told"), json_text.json_kind(t).alias("found"), json_text.json_kind(t, 2).alias("slow")).collect():
        assert r.told == r.kind and (r.kind is None or r.found == r.kind), r
        assert r.found == r.slow or r.slow == "?depth", r


def test_size_labels(spark):
    df = spark.createDataFrame([(0,), (-1,), (1023,), (1024,), (1536,), (1 << 30,), (5 << 40,)], "b long")
    assert [r[0] for r in df.select(js.size_label(F.col("b"))).collect()] == ["0 B", "0 B", "1023 B", "1.00 KB", "1.50 KB", "1.00 GB", "5120.00 GB"]


RECORDS = [(1, '{"b": 1, "a": {"x": [1, {}]}}'), (2, '{"a": null, "c": "yes"}'), (3, "[1, 2]"), (4, "nope"), (5, '{"c": "1e5", "k k": "~"}'), (6, None)]


def test_keys_and_wide(spark):
    df = spark.createDataFrame(RECORDS, "id long, j string")
    assert rows(reshape.discover_keys(df, "j", "id").drop("first_item")) == [("a", 1, 1, 2), ("b", 1, 0, 1), ("c", 2, 1, 2), ("k k", 5, 1, 1)]
    wide = {r.id: (r.a, r.c) for r in reshape.json_to_wide(df, "id", "j", ["a", "c"]).collect()}
    assert wide == {1: ('{"x":[1,{}]}', ""), 2: ("", "yes"), 5: ("", "1e5")}
    assert rows(reshape.wide_rejects(df, "id", "j")) == [(3, "not_objects"), (4, "syntax"), (6, "null")]


TABLES = [
    ("plain", '[{"x": "1", "y": 2e0}, {"y": null, "z": [1.0, "2"]}]'), ("words", '["p", "q"]'), ("hole", '[{"x": 1}, null]'), ("lists", "[[3], [4]]"), ("one", '{"X": true, "k": 0.10, "item": -0}'),
    ("tail", '{"x": 1} more'), ("single", "{'x': 1}"), ("none", "[]"), ("bare", "[{}, {}]"), ("text", '"x"'), ("void", None), ("twice", '{"x": 1, "x": "last"}'), ("deep", '{"x": ' + "[" * 2000 + "]" * 2000 + "}"),
]


def test_tables_of_json(spark):
    df = spark.createDataFrame(TABLES, "k string, j string")
    wide = reshape.json_to_wide(df, "k", "j")
    # keys in the order they are first seen by id: of "one", "plain" and "twice"; taken names are told apart in any case
    assert wide.columns == ["k", "item", "X", "k_2", "item_2", "x_2", "y", "z", "more"]
    want = [("one", 0, "true", "0.1", "0", "", "", "", ""), ("plain", 0, "", "", "", "1", "2", "", ""), ("plain", 1, "", "", "", "", "", '[1,"2"]', ""), ("twice", 0, "", "", "", "last", "", "", "")]
    assert rows(wide) == want
    rejects = {"words": "not_objects", "hole": "not_objects", "lists": "not_objects", "tail": "syntax", "single": "syntax", "none": "no_fields", "bare": "no_fields", "text": "not_array", "void": "null", "deep": "depth"}
    assert dict(rows(reshape.wide_rejects(df, "k", "j"))) == rejects
    narrow = {(r.k, r.item): (r.X, r.more) for r in reshape.json_to_wide(df, "k", "j", widest=1).collect()}
    assert narrow["one", 0] == ("true", '{"k":"0.1","item":"0"}') and narrow["twice", 0] == ("", '{"x":"last"}')
    long = rows(reshape.json_to_long(df, "k", "j"))
    assert ("plain", 1, "y", "") in long and ("plain", 1, "z", '[1,"2"]') in long and len(long) == 8
    assert reshape.json_to_wide(df.where("false"), "k", "j").columns == ["k", "item", "more"]


def strictly(text):
    """What a JSON parser says that takes no words for numbers."""

    def no(word):
        raise ValueError(word)

    try:
        return json.loads(text, parse_constant=no)
    except ValueError:
        return ValueError


def test_gate_is_strict_and_keeps_the_order(spark):
    rng = random.Random(4)
    parts = ["{", "}", "[", "]", ":", ",", '"a"', '"b\\n"', '"\\u00e9"', '"\\x"', "1", "-0", "01", "1.", "1e5", "-1.5E+3", "true", "null", "nul", " ", "\n", "'a'", "NaN", "\x0b", "\x01", "﻿", '"', '"tab\there"', ".5", "+1", "1 2"]

    def value(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(['"a"', '"\\"q\\\\"', "1", "-0.5e-3", "true", "null", ' "x" ', '""'])
        if rng.random() < 0.6:
            return "{" + ",".join(rng.choice(['"k"', '"a b"', ' "j" ']) + ":" + value(depth - 1) for _ in range(rng.randint(0, 3))) + " }"
        return "[ " + " , ".join(value(depth - 1) for _ in range(rng.randint(0, 3))) + "]"

    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(1500)] + [value(4) for _ in range(700)]
    for _ in range(900):
        whole = value(3)
        at = rng.randrange(len(whole) + 1)
        texts.append(whole[:at] + rng.choice([*parts, ""]) + whole[at + rng.randint(0, 1) :])
    texts += ['{"t":"x"} trailing', "{'a':1}", '{"b": 1e2, "a": [ ], "b": "\\u0041"}', '"' + "\\n" * 100_000 + '"', "[" + ",".join("1" * 50_000) + "]", "[" * 900 + "]" * 900, "[" * 500 + "]" * 499, None]
    got = reshape.json_gate(spark.createDataFrame(list(enumerate(texts)), "raw int, ok string"), "raw", "ok").collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r[0]]
        if text is None or strictly(text) is ValueError:
            assert (r[1], r.reason, r.minified) == (False, "null" if text is None else "syntax", None), text
        else:
            assert r[1] and strictly(r.minified) == strictly(text) and r.bytes_after == len(r.minified.encode()) <= r.bytes_before
    assert [r.minified for r in got if texts[r[0]] == '{"b": 1e2, "a": [ ], "b": "\\u0041"}'] == ['{"b":1e2,"a":[],"b":"\\u0041"}']
    deep = spark.createDataFrame([(1, "[" * 2000 + "]" * 2000)], "k int, j string")
    assert reshape.json_gate(deep, "k", "j").first().reason == "depth"


def test_numbers_as_javascript_prints_them(spark):
    made = {"1e2": "100", "1.0": "1", "1.50": "1.5", "-0": "0", "0.1": "0.1", "1e21": "1e+21", "1e-7": "1e-7", "123456789012345678901234567890": "1.2345678901234568e+29", "12345678.5": "12345678.5", "-2.5E3": "-2500", "0.000001": "0.000001", "123e-20": "1.23e-18"}
    df = spark.createDataFrame([(k,) for k in made], "t string")
    assert {r.t: r.n for r in df.select("t", json_text.js_number(F.col("t")).alias("n")).collect()} == made


def test_leaf_rejects(spark):
    df = spark.createDataFrame([*RECORDS, (7, '{"a": 1} x'), (8, '{"a": 1, "a": 2}')], "id long, j string")
    assert rows(reshape.leaf_rejects(df, "id", "j")) == [(4, "syntax"), (6, "null"), (7, "syntax"), (8, "repeated_keys")]
    assert {r.id for r in reshape.leaf_paths(df, "id", "j").collect()} == {1, 2, 3, 5}


def test_gate_accounts_for_every_row(spark):
    df = spark.createDataFrame(RECORDS, "id long, j string")
    gated = reshape.json_gate(df, "id", "j")
    assert gated.count() == len(RECORDS)
    assert {r.id for r in gated.where("ok").collect()} == {1, 2, 3, 5}


def test_leaves(spark):
    df = spark.createDataFrame(RECORDS, "id long, j string")
    got = {(r.id, r.path): (r.kind, r.value, r.truncated) for r in reshape.leaf_paths(df, "id", "j").collect()}
    assert got[1, "a.x[0]"] == ("bigint", "1", False) and got[1, "a.x[1]"] == ("object", "{}", False)
    assert got[2, "a"][0] == "null" and got[5, '"k k"'] == ("string", "~", False) and got[3, "[1]"][1] == "2"
    shallow = {(r.path): r.truncated for r in reshape.leaf_paths(df.where("id = 1"), "id", "j", depth=1).collect()}
    assert shallow["a"] is True and shallow["b"] is False
    assert (4, "") not in got and (6, "") not in got
    named = spark.createDataFrame([(1, '{"open": {"v": [[1], 2]}, "pos": null}'), (2, "5"), (3, "{}"), (4, None)], "key long, value string")
    got = {(r.key, r.path): (r.value, r.truncated) for r in reshape.leaf_paths(named, "key", "value", depth=3).collect()}
    assert got == {(1, "open.v[0]"): ("[1]", True), (1, "open.v[1]"): ("2", False), (1, "pos"): (None, False), (2, ""): ("5", False), (3, ""): ("{}", False)}


def test_ambiguous(spark):
    words, numbers = ["No", "TRUE", "~", "n"], ["7", "+0.25", ".5", "3.", "2E-8", "-1e+2"]
    blanks, marks, plain = ["", " ", "\u3000"], ["end ", "\u00a0x", "k: v", "#1", "a\tb"], ["east", "1e", "e5", ".", "1.2.3", "1-2", "0x1f", "nope", "NaN", "5 km", "--1", "1d"]
    leaves = spark.createDataFrame([("p", v) for v in words + numbers + blanks + marks + plain], "path string, value string")
    assert {r.rule: r.n for r in reshape.ambiguous_scalars(leaves).collect()} == {"word": 4, "number": 6, "blank": 3, "marks": 5}


def test_drop_sensitive(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "x"}), (2, {"b": "x"}), (3, None), (4, {}), (5, {"a": None, "z": None}), (None, {"c": "y", "a": "q"})], "id long, m map<string,string>")
    want = [(None, '{"c":"y"}', 1), (1, '{"b":"2"}', 1), (2, '{"b":"x"}', 0), (2, '{"b":"x"}', 0), (3, None, 0), (4, "{}", 0), (5, '{"z":null}', 1)]
    got = reshape.drop_sensitive(df, "id", "m", ["a"])
    assert sorted(((r.id, r.cleaned, r.dropped) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.bytes_before, r.bytes_after) for r in got.where("id = 1").collect()} == {(17, 9)}
    # a table of a million names, with repeated and null ones, of which one occurs
    names = spark.range(1_000_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name")).union(spark.createDataFrame([("a",), ("a",), (None,)], "name string"))
    assert sorted(((r.id, r.cleaned, r.dropped) for r in reshape.drop_sensitive(df, "id", "m", names).collect()), key=repr) == sorted(want, key=repr)
    assert reshape.drop_sensitive(df, "id", "m", []).where("dropped > 0").count() == 0 and reshape.drop_sensitive(df.where("false"), "id", "m", ["a"]).count() == 0
