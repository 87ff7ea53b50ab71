"""Queries agree with their SQL on keys and values that only larger tables have."""

import decimal
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from varidoc.functions import canonical, dates, values
from varidoc.operators import delta, walk
from varidoc.plans.paths import doc_pointer
from varidoc.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """A folder of tables with large keys and awkward numbers."""
    folder, con = str(tmp_path_factory.mktemp("large")), duckdb.connect()
    con.execute("create table orders as select k::bigint as o_orderkey, (k % 7)::bigint as o_custkey, case when k % 2 = 0 then 'O' else 'F' end as o_orderstatus, k + 0.25::double as o_totalprice, timestamp '2024-02-29 23:59:01' + to_seconds(k % 90000) as o_orderdate, '1-URGENT' as o_orderpriority "
                "from (values (0), (1), (15), (21), (33), (127), (128), (255), (256), (32768), (65536), (551615), (551616), (900001), (8388609), (8388610), (53999997), (53999998)) t(k)")
    con.execute("create table lineitem as select o_orderkey as l_orderkey, (o_orderkey + i)::bigint as l_partkey, i::bigint as l_suppkey, i::int as l_linenumber, i::double as l_quantity, p as l_extendedprice, 0.05::double as l_discount, 0.01::double as l_tax, 'A' as l_returnflag, 'F' as l_linestatus, o_orderdate as l_shipdate "
                "from orders, (values (1, 3.1553473937498943e+25::double), (2, 6.750851846432404e+17::double), (3, 12345.670000000002::double)) v(i, p) where o_orderkey <> 128")
    con.execute("create table events as select k::bigint as event_id, timestamp '2024-01-01 00:00:00' + to_seconds(k) as ts, k % 5 as user_id, 'click' as event_type, 0.5::double as value, '{\"k\": ' || k % 9 || '}' as props from range(5999990, 6000010) r(k)")
    con.execute("create table customer as select k::bigint as c_custkey, 'Customer#' || k as c_name, 1::int as c_nationkey, 0.5::double as c_acctbal, 'AUTO' as c_mktsegment from range(7) r(k)")
    for t in ("orders", "lineitem", "events", "customer"):
        con.execute(f"copy {t} to '{folder}/{t}.parquet' (format parquet)")
    return folder


def agrees(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    df = QUERIES[name](spark, folder)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    plain = lambda x: int(x) if isinstance(x, decimal.Decimal) else x
    got = sorted(repr([plain(r[c]) for c in want.columns]) for r in df.collect())
    assert got and got == sorted(repr(list(map(plain, r))) for r in want.fetchall())


@pytest.mark.parametrize("name", ["narrow_numbers", "parse_numbers", "number_texts"])
def test_numbers_of_larger_tables(spark, large, name):
    agrees(spark, large, name)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_walk_makes_what_is_asked_for(spark):
    """Pointers and paths that nobody reads are not made."""
    docs = spark.range(1).select("id", F.parse_json(F.lit('{"a": [1]}')).alias("v"))
    asked = plan(walk.doc_walk(docs, "id", "v", max_depth=2).groupBy("depth").count())
    assert "RLIKE" not in asked and "replace(" not in asked


def test_types_of_containers_are_shallow(spark):
    """A container's values are not read for its type, nor for a pointer's step."""
    docs = spark.range(1).select(F.parse_json(F.lit("[1]")).alias("v"))
    assert "SchemaOfVariant" not in plan(docs.select(F.to_json(doc_pointer(F.col("v"), "/0"))))
    assert "SchemaOfVariant" not in plan(docs.select(values.as_dict(F.col("v")).alias("d"), values.as_array(F.col("v")).alias("a")))
    assert plan(docs.select(values.doc_type(F.col("v")))).count("SchemaOfVariant") <= 1


def test_diff_meets_documents_once(spark):
    """Documents are joined, not their values; arrays and dicts in the same place meet by pointer, as do types that have the same text."""
    old = spark.createDataFrame([(1, '{"a": [1, {"x/y": 2}], "b": "eA=="}'), (2, "[]"), (3, "5"), (None, "1"), (4, None)], "id int, t string")
    new = spark.createDataFrame([(1, '{"a": {"0": 1, "2": null}, "b": "eA=="}'), (2, "[]"), (None, "1"), (4, "{}")], "id int, t string")
    docs = lambda df: df.select("id", F.parse_json("t").alias("v"))
    got = walk.diff_rows(docs(old), docs(new), "id", "v")
    want = {(1, "/a", "changed", None, None), (1, "/a/1", "removed", None, None), (1, "/a/1/x~1y", "removed", "2", None), (1, "/a/2", "added", None, "null"),
            (3, "/", "removed", "5", None), (None, "/", "removed", "1", None), (None, "/", "added", None, "1"), (4, "/", "added", None, None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    binary = spark.range(1).select("id", F.to_variant_object(F.array(F.lit("x").cast("binary").cast("variant"), F.lit("eA==").cast("variant"))).alias("v"))
    text = spark.range(1).select("id", F.to_variant_object(F.array(F.lit("eA==").cast("variant"), F.lit("x").cast("binary").cast("variant"))).alias("v"))
    assert {(r["pointer"], r["change"]) for r in walk.diff_rows(binary, text, "id", "v").collect()} == {("/0", "changed"), ("/1", "changed")}
    joins = [line for line in plan(walk.diff_rows(docs(old), docs(new), "id", "v", max_depth=3)).splitlines() if "Join" in line]
    assert len(joins) == 1 and "pointer" not in joins[0]


def test_dates_are_read_once(spark):
    """Each of the two patterns of dates is matched once."""
    assert plan(spark.range(1).select(F.col("id").cast("string").alias("s")).select(dates.parse_iso8601(F.col("s")))).lower().count("regexp") <= 8


def test_quick_canonical_text():
    """json's writer and the one for characters and numbers that it writes otherwise agree."""
    rare = ["\b", "\f", "\x7f", "\\b", "é ", 9007199254740994.0, -9007199254740994.0, 1e16, 0.1, -0.0, 1e-7, 2**63, True, None, {"b": [], "a": {}}]
    for x in rare:
        assert canonical.canonical([x]) == canonical._spelt([x])
    assert canonical.canonical(["\b"]) == '["\\u0008"]' and canonical.canonical([9007199254740994.0]) == "[9.007199254740994e+15]"
    with pytest.raises(ValueError):
        canonical.canonical(float("inf"))
    assert canonical.parsed("[18446744073709551616, 1]") == [18446744073709551616.0, 1] and type(canonical.parsed("18446744073709551616")) is float


@pytest.mark.parametrize("old,new,want", [([1, [2]], [1, [2.0]], {"1": {"0": 2.0}}), ([[True]], [[1]], {"0": {"0": 1}}), ([[0.0]], [[-0.0]], {"0": {"0": -0.0}}), ({"a": [1], "b": [2]}, {"b": [2], "a": [1]}, {})])
def test_deltas_of_equal_parts(old, new, want):
    """Parts that are the same are passed over, those that only compare as equal are not."""
    assert repr(delta.make_delta(old, new)) == repr(want)


@pytest.mark.parametrize("name", ["diff_by_pointer", "deep_walk", "learn_keys", "json_pointer", "order_deltas", "delta_log", "nested_changes", "walk_pointers", "encode_keys", "diff_and_patch", "walk_pruned", "iso_dates", "awkward_keys", "column_pointers", "nesting_depth"])
def test_documents_of_larger_tables(spark, large, name):
    agrees(spark, large, name)


def test_walk_opens_variants_by_explode(spark):
    """Containers are opened without arrays of entries; empty ones give no row of their own, and odd keys stay."""
    docs = spark.createDataFrame([(1, '{"b": [], "a/~": {"": [null, {}]}}'), (2, "[]"), (3, None), (4, '"[{"')], "id int, t string").select("id", F.parse_json("t").alias("v"))
    walked = walk.doc_walk(docs, "id", "v")
    assert "map_entries" not in plan(walked) and "variant_explode" in plan(walked)
    want = {(1, "/", "dict"), (1, "/b", "array"), (1, "/a~1~0", "dict"), (1, "/a~1~0/", "array"), (1, "/a~1~0//0", "null"), (1, "/a~1~0//1", "dict"), (2, "/", "array"), (4, "/", "string")}
    got = [(r["id"], r["pointer"], r["type"]) for r in walked.collect()]
    assert set(got) == want and len(got) == len(want)


def test_nesting_of_long_texts(spark):
    """A text of any length, with characters that are escaped, needs no stack."""
    docs = spark.range(1).select(F.to_variant_object(F.struct(F.repeat(F.lit('a"[\\'), 100_000).alias("x"), F.array(F.array(), F.array(F.array().cast("array<int>"))).alias("y"))).alias("v"))
    assert docs.select(walk.nesting(F.col("v"))).first()[0] == 4


def test_awkward_keys_are_read_behind_the_inline(spark, large):
    """Types are asked for once, not in every place."""
    assert plan(QUERIES["awkward_keys"](spark, large)).count("schema_of_variant") + plan(QUERIES["awkward_keys"](spark, large)).count("SchemaOfVariant") < 10


def test_orders_meet_their_lines_once(spark, large):
    """Lines are collected once, behind their shuffle; both versions of an order come from its row, and logs do without lines."""
    assert "RepartitionByExpression" in plan(QUERIES["nesting_depth"](spark, large))
    assert plan(QUERIES["diff_and_patch"](spark, large)).count("Join ") == 1
    assert "l_orderkey" not in plan(QUERIES["delta_log"](spark, large))
    assert "variant" not in plan(QUERIES["encode_keys"](spark, large))
