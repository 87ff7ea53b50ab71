"""Documents: coercions, paths, templates, numbers, dates, deltas, keys, stores and streams."""

import json
import math
import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varidoc.functions import canonical, collections, dates, numbers, text, values
from varidoc.operators import delta, keys, store, walk
from varidoc.plans import paths
from varidoc.plans.paths import KeyPath, doc_get, doc_pointer
from varidoc.plans.templates import doc_build, doc_put
from varidoc.sources import json as source
from varidoc.streaming import log

col, lit = F.col, F.lit


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def doc(text):
    return F.parse_json(lit(text))


@pytest.mark.parametrize("text,want", [("null", "null"), ("true", "boolean"), ("1", "number"), ("1.5", "number"), ('"x"', "string"), ("[]", "array"), ("{}", "dict")])
def test_types(spark, text, want):
    assert one(spark, values.doc_type(doc(text))) == want
    assert one(spark, values.doc_type(lit(None).cast("variant"))) == "undefined"


@pytest.mark.parametrize("text,b,i", [("null", False, 0), ("0.5", False, 0), ('""', True, 0), ("[]", True, 0), ("-1.9", True, -1), ("true", True, 1), ('"12"', True, 0), ("18446744073709551615", True, -1)])
def test_coercions(spark, text, b, i):
    assert one(spark, values.as_bool(doc(text))) is b
    assert one(spark, values.as_int(doc(text))) == i


def test_unsigned(spark):
    assert one(spark, values.is_unsigned(doc("18446744073709551615"))) and not one(spark, values.is_unsigned(doc("5")))
    assert not one(spark, values.is_integer(doc("123.0"))) and one(spark, values.is_double(doc("123.0")))
    assert one(spark, values.as_unsigned(doc("-1"))) == 18446744073709551615


@pytest.mark.parametrize("x,want", [(123.0, "123.0"), (1.25e-5, "1.25e-05"), (9007199254740992.0, "9007199254740992.0"), (9007199254740994.0, "9.007199254740994e+15"), (0.0001, "0.0001"), (-0.5, "-0.5"),
                                    (1e300, "1e+300"), (123456789.125, "123456789.125"), (0.0, "0.0"), (5e-324, "5e-324"), (2.0**-44, "5.684341886080802e-14"), (1e23, "1e+23"), (1e15, "1000000000000000.0"), (0.001, "0.001"), (0.00123, "0.00123")])
def test_number_text(spark, x, want):
    assert one(spark, numbers.format_double(lit(x))) == want
    assert canonical.number_text(x) == want


def test_one_number_text(spark):
    """Both formatters agree on any number."""
    rng = random.Random(1)
    xs = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [2.0**k for k in range(-1074, 1024, 7)] + [round(rng.uniform(-1e6, 1e6), rng.randint(0, 12)) for _ in range(2000)] + [float(rng.randint(-(10**17), 10**17)) for _ in range(500)]
    xs = [x for x in xs if math.isfinite(x)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numbers.format_double(col("x")).alias("t")).collect()
    off = [(r["x"], r["t"]) for r in got if r["t"] != canonical.number_text(r["x"])]
    # of two texts of the same length either may be given, if it reads back
    assert all(float(t) == x and len(t) <= len(canonical.number_text(x)) for x, t in off) and len(off) < len(xs) / 1000


def test_paths(spark):
    d = doc('{"a":{"b c":[1,2,{"d":"x"}]},"e.f":7}')
    get = lambda p: one(spark, F.to_json(doc_get(d, p)))
    assert get("a.b c[0]") == "1" and get("$.a.b c[-1].d") == '"x"' and get("e\\.f") == "7" and get("a..b c[1]") == "2"
    assert get("a.b c[9]") is None and get("a.b c.d") is None and json.loads(get("$")) == {"a": {"b c": [1, 2, {"d": "x"}]}, "e.f": 7}
    assert one(spark, F.to_json(doc_pointer(d, "/a/b c/2/d"))) == '"x"' and one(spark, F.to_json(doc_pointer(doc('{"a/b":{"0":3}}'), "/a~1b/0"))) == "3"


@pytest.mark.parametrize("bad", ["", "a[", "a[x]", "a[1]b", "$a", "a\\"])
def test_bad_paths(bad):
    with pytest.raises(ValueError):
        KeyPath.parse(bad)


@given(st.lists(st.one_of(st.integers(-5, 5), st.text(st.characters(codec="utf-8"), min_size=1)), min_size=1).filter(lambda p: True))
@settings(max_examples=100, deadline=None)
def test_path_text_round_trip(parts):
    path = KeyPath(tuple(parts))
    assert KeyPath.parse(str(path)) == path


def test_path_parts():
    p = KeyPath.parse("a.b[2]")
    assert len(p) == 3 and p[2] == 2 and str(p.drop(1)) == "b[2]" and str(p + "c" + -1) == "a.b[2].c[-1]"


def test_arrays(spark):
    a = F.try_variant_get(doc("[1,2,3]"), "$", "array<variant>")
    show = lambda c: json.loads(one(spark, F.to_json(F.to_variant_object(c))))
    assert show(collections.array_set(a, 1, doc('"x"'))) == [1, "x", 3]
    assert show(collections.array_insert_nulls(a, 1, 2)) == [1, None, None, 2, 3]
    assert show(collections.array_remove_range(a, 0, 2)) == [3]
    assert show(collections.array_resize(a, 5)) == [1, 2, 3, None, None] and show(collections.array_resize(a, 1)) == [1]
    assert show(collections.array_overlay(a, F.create_map(lit(2), doc("9")))) == [1, 2, 9]
    with pytest.raises(Exception, match="past the end"):
        show(collections.array_insert_nulls(a, 4, 1))


def test_templates(spark):
    got = one(spark, F.to_json(doc_build("{a: %d, 'b': [%s, null, 1.5], c: {d: %-c}, e: %@, f: %s}", lit(7), lit("x"), lit(False), doc("[1]"), lit(None))))
    assert json.loads(got) == {"a": 7, "b": ["x", None, 1.5], "c": {}, "e": [1]}
    for bad in ("{a: %d", "{a %d}", "[%d] x", "{a: %d}"):
        with pytest.raises(ValueError):
            doc_build(bad)


def test_json5(spark):
    got = one(spark, F.to_json(source.parse_json5(lit("{a: +1, 'b': \"x // , ]\", /* c */ d: [1, 2,], // e\n}"))))
    assert json.loads(got) == {"a": 1, "b": "x // , ]", "d": [1, 2]}
    assert one(spark, source.parse_json5(lit("{a: "))) is None
    assert not one(spark, source.is_valid(lit('{"a":1}]'))) and one(spark, source.is_valid(lit(" [1] ")))
    assert not one(spark, source.is_valid(lit('1,"z":2')))


def test_json5_text(spark):
    assert one(spark, source.to_json5(doc('{"a":"\\"b\\":","c\\"d":{"1x":1,"$e":"f:"}}'))) == '{a:"\\"b\\":","c\\"d":{$e:"f:","1x":1}}'


def test_require(spark):
    assert one(spark, F.to_json(source.require(doc("[1]"), "array"))) == "[1]"
    with pytest.raises(Exception, match="no dict"):
        one(spark, F.to_json(source.require(doc("[1]"), "dict")))


def test_numbers(spark):
    assert one(spark, numbers.parse_integer(lit(" -9223372036854775808 "))) == -(1 << 63) and one(spark, numbers.parse_integer(lit("9223372036854775808"))) is None
    assert one(spark, numbers.parse_unsigned(lit("18446744073709551615"))) == (1 << 64) - 1 and one(spark, numbers.parse_unsigned(lit("18446744073709551616"))) is None
    assert one(spark, numbers.parse_double(lit("1e3"))) == 1000.0 and one(spark, numbers.parse_double(lit("x"))) is None


def test_dates(spark):
    p = lambda s: one(spark, dates.parse_iso8601(lit(s)))
    assert p("1970-01-01T00:00:01.5Z") == 1500 and p("2014-01-28T05:37:03 +08:00") == 1390858623000 and p("2024-02-29") == 1709164800000
    assert p("2023-02-29") is None and p("1970-01-01T25:00Z") is None and p("x") is None
    assert one(spark, dates.format_iso8601(lit(1390858623001))) == "2014-01-27T21:37:03.001Z"


def test_text(spark):
    assert one(spark, text.fnv1a(lit("foo"))) == 2851307223
    assert one(spark, text.can_be_shared_key(lit("a-b_9"))) and not one(spark, text.can_be_shared_key(lit("a b")))
    assert one(spark, text.escape_json(lit('a"\n'))) == '"a\\"\\n"' and one(spark, text.find_not_in(lit("aab"), "a")) == 3


def test_walk(spark):
    df = spark.range(1).select("id", doc('{"a":[1,{"b/c":null}],"d e":{}}').alias("v"))
    walked = walk.doc_walk(df, "id", "v").orderBy(col("visit").asc_nulls_first(), "pos").collect()
    assert [r["pointer"] for r in walked] == ["/", "/a", "/d e", "/a/0", "/a/1", "/a/1/b~1c"]
    got = {r["pointer"]: (r["path"], r["depth"], r["type"]) for r in walked}
    assert got == {"/": ("", 0, "dict"), "/a": ("a", 1, "array"), "/d e": ('["d e"]', 1, "dict"), "/a/0": ("a[0]", 2, "number"), "/a/1": ("a[1]", 2, "dict"), "/a/1/b~1c": ('a[1]["b/c"]', 3, "null")}


def test_walk_order(spark):
    df = spark.range(1).select("id", doc('{"f":[{"x":1},{"y":2}],"g":3,"t":["p"]}').alias("v"))
    got = [r["pointer"] for r in walk.doc_walk(df, "id", "v").orderBy(col("visit").asc_nulls_first(), "pos").collect()]
    assert got == ["/", "/f", "/g", "/t", "/t/0", "/f/0", "/f/1", "/f/1/y", "/f/0/x"]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=90),
                    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=4), max_leaves=12)


@given(JSON, JSON)
@settings(max_examples=300, deadline=None)
def test_delta_law(a, b):
    d = json.loads(json.dumps(delta.make_delta(a, b)))
    assert delta.same(delta.apply_delta(a, d), b)
    assert delta.make_delta(a, a) == {}


def test_delta_forms():
    make = delta.make_delta
    assert make({"a": 1, "b": 2}, {"a": 1, "c": [3]}) == {"c": [[3]], "b": []}
    assert make([1, 2, 3], [1, 9]) == {"1": 9, "2-": []} and make(1, 2) == [2] and make([], [1]) == [[1]]
    old = "x" * 70
    assert make({"t": old}, {"t": old + "y"}) == {"t": ["70=1+y|", 0, 2]}
    assert make(1, 1.0) == [1.0]
    with pytest.raises(ValueError):
        delta.apply_delta("abc", ["9=", 0, 2])


def test_null_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, '{"a":1}', None), (3, None, "[1]")], "id int, a string, b string")
    got = {r["id"]: (r["d"], r["c"]) for r in df.select("id", delta.doc_diff(col("a"), col("b")).alias("d"), canonical.canonical_text(col("a")).alias("c")).collect()}
    assert got == {1: (None, None), 2: (None, '{"a":1}'), 3: ("[[1]]", None)}


def test_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("no way",), (None,)], "key string")
    first = keys.learn_keys(df, capacity=2)
    assert sorted(map(tuple, first.collect())) == [(0, "a"), (1, "b")]
    more = keys.learn_keys(spark.createDataFrame([("c",), ("a",)], "key string"), first)
    assert sorted(map(tuple, more.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    assert keys.revert_keys(more, 1).count() == 1 and keys.load_keys(first, more).count() == 3


def test_store(spark):
    kv = lambda *rows: spark.createDataFrame([*rows], "key string, value int")
    s = store.upsert(kv(("a", 1), ("b", 2)), kv(("b", 5), ("c", 6), ("a", None)))
    assert sorted(map(tuple, s.collect())) == [("b", 5), ("c", 6)]
    s = store.upsert(s, kv(("b", 1)), lambda old, new: old + new)
    assert sorted(map(tuple, s.collect())) == [("b", 6), ("c", 6)] and store.get(s, "b").count() == 1
    assert store.get_all(s, kv(("c", 0), ("x", 0))).count() == 1 and store.remove(s, kv(("b", 0))).count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k":"a","n":1,"v":10}\n{"k":"a","n":2,"v":11}\n{"k":"b","n":3,"v":12}\n')
    state = {"rows": []}
    schema = "key string, version long, value long"
    docs = log.read_stream(spark, str(tmp_path / "in"))
    changes = docs.select(values.as_string(doc_get(col("body"), "k")).alias("key"), values.as_int(doc_get(col("body"), "n")).alias("version"), values.as_int(doc_get(col("body"), "v")).alias("value"))

    def save(df, number):
        state["rows"] = [tuple(r) for r in df.collect()]

    log.follow(changes, lambda: spark.createDataFrame(state["rows"], schema), save, str(tmp_path / "check")).awaitTermination(60)
    assert sorted(state["rows"]) == [("a", 2, 11), ("b", 3, 12)]


def test_ndjson(spark, tmp_path):
    df = spark.range(3).select(F.to_variant_object(F.struct("id")).alias("v"))
    source.write_ndjson(df, "v", str(tmp_path / "x"))
    assert sorted(r[0] for r in source.read_documents(spark, str(tmp_path / "x")).select(values.as_int(doc_get(col("body"), "id"))).collect()) == [0, 1, 2]


# keys, nested changes and paths as columns

ODD = "".join(map(chr, range(32, 127)))


def test_keys_of_any_character(spark):
    names = [*ODD, "", "'\"", "a'b\"c", "ключ", "\n", "x" * 300, "$['a']"]
    v = F.parse_json(lit(json.dumps({k: i for i, k in enumerate(names)})))
    got = spark.range(1).select(v.alias("v")).select(F.array(*[values.as_int(collections.dict_get(col("v"), k)) for k in names]).alias("x")).first()["x"]
    assert got == [*range(len(names))]
    assert one(spark, collections.dict_get(doc("[1]"), "a")) is None and one(spark, collections.dict_get(doc("[1]"), "")) is None


def shown(spark, c):
    text = one(spark, F.to_json(c))
    return None if text is None else json.loads(text)


def test_doc_set(spark):
    v = doc('{"a":[1,{"b":2}],"c":{"d":3}}')
    put = lambda p, x: shown(spark, paths.doc_set(v, p, doc(x)))
    assert put("a[1].b", "9") == {"a": [1, {"b": 9}], "c": {"d": 3}} and put("a[-2]", "[]") == {"a": [[], {"b": 2}], "c": {"d": 3}}
    assert put("c.e.f", "null") == {"a": [1, {"b": 2}], "c": {"d": 3, "e": {"f": None}}} and put("$", "5") == 5
    unchanged = {"a": [1, {"b": 2}], "c": {"d": 3}}
    assert put("a[7]", "1") == put("a[-3]", "1") == put("a.x", "1") == put("c[0]", "1") == put("a[0].b", "1") == unchanged
    gone = lambda p: shown(spark, paths.doc_remove(v, p))
    assert gone("a[0]") == {"a": [{"b": 2}], "c": {"d": 3}} and gone("c.d") == {"a": [1, {"b": 2}], "c": {}} and gone("a[1].b") == {"a": [1, {}], "c": {"d": 3}} and gone("x.y") == unchanged
    assert shown(spark, paths.doc_set(lit(None).cast("variant"), "a.b", doc("1"))) == {"a": {"b": 1}}
    assert shown(spark, paths.doc_update(v, "c.d", lambda old: (values.as_int(old) + 1).cast("variant"))) == {"a": [1, {"b": 2}], "c": {"d": 4}}


@pytest.mark.parametrize("spec", ["a.b c[0]", "$.a.b c[-1].d", "e\\.f", "a..b c[1]", "a.b c[9]", "$", "", "a[", "a[x]", "a[1]b", "$a", "a\\", "\\$a", "a.b c", ".a", "a.", "[0]"])
def test_paths_as_columns(spark, spec):
    text = '{"a":{"b c":[1,2,{"d":"x"}]},"e.f":7,"$a":8}'
    got = spark.createDataFrame([(spec,)], "p string").select(F.to_json(paths.doc_get_by(doc(text), col("p"))).alias("x")).first()["x"]
    try:
        want = one(spark, F.to_json(doc_get(doc(text), spec)))
    except ValueError:
        want = None
    assert got == want


@pytest.mark.parametrize("pointer,want", [("", '{"a/b":{"0":3},"l":[1,{"~":2}]}'), ("/a~1b/0", "3"), ("/l/1/~0", "2"), ("/l/0", "1"), ("/l/01", None), ("/l/-", None), ("a", None), ("/x", None), ("/l/7", None)])
def test_pointers_as_columns(spark, pointer, want):
    v = doc('{"a/b":{"0":3},"l":[1,{"~":2}]}')
    assert spark.createDataFrame([(pointer,)], "p string").select(F.to_json(paths.doc_pointer_by(v, col("p"))).alias("x")).first()["x"] == want


def test_template_literals(spark):
    build = lambda t, *c: shown(spark, doc_build(t, *c))
    assert build(" \t{  \n }  ") == {} and build(" [ ]  ") == []
    assert build("[null, false, true, 0, 1, -12, +123, 123.5, -123.5, +123.5, 123e-4, .5]") == [None, False, True, 0, 1, -12, 123, 123.5, -123.5, 123.5, 0.0123, 0.5]
    assert build(r"""{a : 'foo\'', $b : "bar\"rab", _c_ : "", _ : "\r\\", n: "x\ny", u: '\u00e9\ud83d\ude00'}""") == {"a": "foo'", "$b": 'bar"rab', "_c_": "", "_": "\r\\", "n": "x\ny", "u": "é😀"}


def test_template_put(spark):
    put = lambda v, t, *c: shown(spark, doc_put(v, t, *c))
    assert put(doc('{"a":1,"b":2,"c":3}'), "{a: %d, b: %s, d: [%d]}", lit(5), lit(None), lit(6)) == {"a": 5, "c": 3, "d": [6]}
    assert put(doc("[1]"), "[%d, {x: 1}]", lit(2)) == [1, 2, {"x": 1}] and put(doc("[1]"), "{a: 1}") == [1] and put(doc("5"), "[1]") == 5
    assert put(lit(None).cast("variant"), "{a: %-d}", lit(0)) == {} and put(lit(None).cast("variant"), "[7]") == [7]


def test_parse_refuses(spark):
    for bad in ('{"a":1}]', "1 2", '{"a":1', "[1,]", '{"a":1,"a":2}'):
        with pytest.raises(Exception, match="malformed JSON"):
            one(spark, F.to_json(source.parse(lit(bad))))
    assert one(spark, F.to_json(source.parse(lit(" [1] ")))) == "[1]" and one(spark, source.parse(lit(None).cast("string"))) is None
    assert tuple(one(spark, source.parse_error(lit('{"a":1}]')))) == ("Extra data", 7) and one(spark, source.parse_error(lit("[1]"))) is None


@pytest.mark.parametrize("text,want", [("{a: .5, b: 5., c: -.5, d: [+.25,+1]}", {"a": 0.5, "b": 5.0, "c": -0.5, "d": [0.25, 1]}), ("// .5\n[1, /* 2. */ '.5 3.', \".\", 4.]", [1, ".5 3.", ".", 4.0]), (".5", 0.5), ("5.", 5.0)])
def test_json5_points(spark, text, want):
    assert shown(spark, source.parse_json5(lit(text))) == want


def test_control_characters(spark):
    s = "".join(map(chr, range(1, 32))) + "\x7f\"\\\\b\\f/é"
    assert one(spark, text.escape_json(lit(s))) == canonical.string_text(s) and json.loads(canonical.string_text(s)) == s
    assert canonical.string_text("\b\f\x7f\x01\n") == '"\\u0008\\u000c\\u007f\\u0001\\n"'


# deltas

@pytest.mark.parametrize("old,new", [
    ("to wound the autumnal city. So howled out for the world to give him a name.  The in-dark answered with the wind.", "To wound the eternal city. So he howled out for the world to give him its name. The in-dark answered with wind."),
    ("モバイルデータベースは将来のものです。 ある日、私たちのデータが端に集まります。" * 2, "モバイルデータベースがここにあります。 あなたのデータはすべて端にあります。" * 2), ("ABC+DEF-HIJ=KLM|NOP " + "*" * 60, "AbC-def+HIJKLM|NOP= " + "*" * 60)])
def test_text_edits(old, new):
    """Several edits, shorter than the text, that lead to it."""
    d = delta.make_delta(old, new, min_text=20)
    assert len(d) == 3 and d[1:] == [0, 2] and len(d[0].encode()) < len(new.encode()) and d[0].count("=") >= 2 and delta.apply_delta(old, d) == new


def test_one_insertion():
    old = "to wound the autumnal city. The in-dark answered with the wind."
    new = "to wound the autumnal city. So howled out for the world to give him a name. The in-dark answered with the wind."
    assert delta.make_delta(old, new, min_text=36) in (["27=48+ So howled out for the world to give him a name.|36=", 0, 2], ["28=48+So howled out for the world to give him a name. |35=", 0, 2])
    assert delta.make_delta(old, new, min_text=200) == [new] and delta.is_deletion([]) and delta.is_deletion([1, 0, 0]) and not delta.is_deletion(["1=", 0, 2])


@given(JSON, JSON)
@settings(max_examples=200, deadline=None)
def test_compatible_delta_law(a, b):
    d = json.loads(json.dumps(delta.make_delta(a, b, compatible=True, min_text=30)))
    assert delta.same(delta.apply_delta(a, d), b) and delta.make_delta(a, a, compatible=True) == {}


def test_delta_log(spark):
    kv = lambda *rows: spark.createDataFrame([*rows], "key string, value string")
    base = kv(("a", '{"x":1,"y":[1,2]}'), ("b", '{"x":2}'), ("c", '{"x":3}'))
    one_ = store.amend(base, kv(("a", '{"x":5,"y":[1,2]}'), ("b", None), ("c", '{"x":3}'), ("n", '{"z":1}'), ("never", None)), 1)
    assert sorted((r["key"], r["delta"]) for r in one_.collect()) == [("a", '{"x":5}'), ("b", "[]"), ("n", '[{"z":1}]')]
    two = store.amend(store.fold_deltas(base, one_), kv(("a", '{"x":5,"y":[1]}'), ("b", '{"back":true}')), 2)
    want = [("a", '{"x":5,"y":[1]}'), ("b", '{"back":true}'), ("c", '{"x":3}'), ("n", '{"z":1}')]
    log_ = one_.unionByName(two)
    assert sorted(map(tuple, store.fold_deltas(base, log_).collect())) == want
    small, rest = store.compact(base, log_, share=0.5)
    assert sorted(map(tuple, store.fold_deltas(small, rest).collect())) == want and rest.count() < log_.count()


def test_doc_transform(spark):
    change = lambda at, x: None if at == "/secret" else x.upper() if isinstance(x, str) else x
    assert one(spark, delta.doc_transform(lit('{"secret":"x","a":["b",{"c/d":"e"}]}'), change)) == '{"a":["B",{"c/d":"E"}],"secret":null}'
    assert one(spark, delta.doc_transform(lit('{"a~":{"c/d":1}}'), lambda at, x: x if isinstance(x, dict) else at)) == '{"a~":{"c/d":"/a~0/c~1d"}}'


# keys, strings, stores

def test_key_table(spark, tmp_path):
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "key string")
    a, b = keys.KeyTable(spark, str(tmp_path / "keys")), keys.KeyTable(spark, str(tmp_path / "keys"))
    a.add(words("y", "x"))
    assert a.changed and a.commit() == 1 and not a.changed and b.keys.count() == 0
    b.add(words("z"))
    with pytest.raises(Exception, match="(?i)exist"):
        b.commit()
    b.revert()
    assert b.refresh() and not b.refresh() and b.version == 1
    b.add(words("z", "x"))
    b.revert()
    assert not b.changed and b.commit() == 1
    b.add(words("z", "x"))
    assert b.commit() == 2 and a.refresh() and sorted(map(tuple, a.keys.collect())) == [(0, "x"), (1, "y"), (2, "z")]
    assert sorted(map(tuple, keys.could_add(a.keys, words("x", "new", "no way"), capacity=3).collect())) == [("new", False), ("no way", False), ("x", True)]


@pytest.mark.parametrize("prefix", ["", "https://example.org/"])
def test_string_ids(spark, prefix):
    rng = random.Random(2)
    words = [prefix + "".join(rng.choices("abcé漢", k=rng.randint(0, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "s string")
    ids = keys.string_ids(df, "s", ranges=16)
    want = {w: i + 1 for i, w in enumerate(sorted({*words}, key=lambda w: w.encode()))}
    assert {r["key"]: r["key_id"] for r in ids.collect()} == want
    asked = keys.ids_of(spark.createDataFrame([(words[0],), ("none",), (None,)], "s string"), ids, "s")
    assert sorted(r["key_id"] for r in asked.collect()) == [0, 0, want[words[0]]]
    assert {r["key"] for r in keys.strings_of(asked, ids).collect()} == {words[0], None}


def test_late_versions(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([*r], "key string, version long, value string")
    s = log.newest(rows(("a", 5, "five"), ("b", 4, None)))
    s = log.newest(s, rows(("a", 3, "three"), ("b", 2, "two"), ("c", 1, "one")))
    assert sorted(map(tuple, log.state(s).collect())) == [("a", "five"), ("c", "one")]


def test_followed_table(spark, tmp_path):
    """Files that arrive later with older versions change nothing; batches rewrite the buckets of their keys."""
    (tmp_path / "in").mkdir()
    def follow():
        docs = log.read_stream(spark, str(tmp_path / "in"))
        changes = docs.select(values.as_string(doc_get(col("body"), "k")).alias("key"), values.as_int(doc_get(col("body"), "n")).alias("version"), values.as_int(doc_get(col("body"), "v")).cast("string").alias("value"))
        log.follow_table(changes, str(tmp_path / "out"), str(tmp_path / "check"), buckets=4).awaitTermination(60)
        return sorted((r["key"], r["version"], r["value"]) for r in log.read_table(spark, str(tmp_path / "out"), changes).collect())
    (tmp_path / "in/1.json").write_text('{"k":"a","n":5,"v":50}\n{"k":"b","n":1,"v":10}\n{"k":"c","n":1,"v":10}\n')
    assert follow() == [("a", 5, "50"), ("b", 1, "10"), ("c", 1, "10")]
    (tmp_path / "in/2.json").write_text('{"k":"a","n":3,"v":30}\n{"k":"b","n":2,"v":20}\n')
    assert follow() == [("a", 5, "50"), ("b", 2, "20"), ("c", 1, "10")]


def test_walk_depth(spark):
    deep = lambda n: "[" * n + "]" * n
    df = lambda n: spark.range(1).select("id", doc(deep(n)).alias("v"))
    assert walk.doc_walk(df(12), "id", "v").count() == 12
    with pytest.raises(ValueError, match="nested 101 deep"):
        walk.doc_walk(df(101), "id", "v")
    assert one(spark, walk.nesting(doc('{"a":["]}",{"b\\"[":1}]}'))) == 3 and one(spark, walk.nesting(doc('"[["'))) == 0


def test_more_dates(spark):
    p = lambda s: one(spark, dates.parts(lit(s)))
    assert p("12:34:56.5")[3:7] == (12, 34, 56, 500) and p("12:34:56")["has_date"] is False and p("2020-02-30T00:00") is None and p("25:00") is None
    assert p("2020-01-02 03:04 -05:30")["zone"] == -330 and p("2020-01-02 03:04")["separator"] == " " and p("2020-01-02T03:04")["separator"] == "T" and p("2020-01-02")["has_time"] is False
    assert one(spark, dates.parse_iso8601(lit("12:00"))) is None and one(spark, dates.parse_iso8601(lit("1970-01-01T00:00:00.9996Z"))) == 1000
    assert one(spark, dates.format_iso8601(lit(-1))) == "1969-12-31T23:59:59.999Z" and one(spark, dates.format_iso8601(lit(0), offset=-90)) == "1969-12-31T22:30:00-0130"
    assert tuple(one(spark, dates.parts_of_millis(lit(-1))))[:8] == (1969, 12, 31, 23, 59, 59, 999, 0)
    assert abs(one(spark, dates.now()) - time.time() * 1000) < 60_000


def test_more_numbers(spark):
    n = lambda x, k, **kw: one(spark, numbers.narrow(lit(x), k, **kw))
    assert n(127, "int8") == 127 and n(128, "int8") is None and n(-1, "uint64") is None and n(255, "uint8") == 255 and n(1 << 40, "int32") is None
    with pytest.raises(Exception, match="no int8"):
        n(128, "int8", strict=True)
    assert one(spark, numbers.parse_double(lit("1.5e3xyz"), trailing=True)) == 1500.0 and one(spark, numbers.parse_double(lit("1.5e3xyz"))) is None and one(spark, numbers.parse_double(lit("0x10"))) is None
    with pytest.raises(Exception, match="no such number"):
        one(spark, numbers.finite(lit(float("nan"))))


def test_more_text(spark, tmp_path):
    assert one(spark, text.decode_hex(lit("48 65 6c6C 6f"))) == b"Hello" and one(spark, text.decode_hex(lit("4"))) is None and one(spark, text.read_hex(lit("ffz"))) == 255
    assert one(spark, text.read_to(lit("a,b"), ",", or_end=True)) == "a" and one(spark, text.read_to(lit("ab"), ",", or_end=True)) == "ab" and one(spark, text.read_to(lit("ab"), ",")) is None
    assert one(spark, text.decode_base64(lit("!"))) is None and one(spark, text.read_in_set(lit("--a-"), "-")) == "--"
    (tmp_path / "f.json").write_text('{"a":\n1}')
    assert source.read_whole(spark, str(tmp_path / "f.json")).select(F.to_json("body")).first()[0] == '{"a":1}'
    assert bytes(source.read_bytes(spark, str(tmp_path / "f.json")).first()["content"]) == b'{"a":\n1}'


def test_saved_store(spark, tmp_path):
    kv = lambda *rows: spark.createDataFrame([*rows], "key string, value int")
    store.save(kv(("a", 1)), str(tmp_path / "s"))
    store.save(kv(("b", 2)), str(tmp_path / "s"), append=True)
    assert sorted(map(tuple, store.load(spark, str(tmp_path / "s")).collect())) == [("a", 1), ("b", 2)]
