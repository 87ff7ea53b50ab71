"""Types and coercions of VARIANT values, as expressions that stay in the JVM.

SQL NULL is `undefined`; a JSON null is a value of its own. Coercions never fail: a value of another type
gives the type's zero (0, 0.0, false) or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MAX = 9223372036854775807
_D = "decimal(38,18)"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_dict(v: Column) -> Column:
    """Whether a document is a dict, without looking into its values."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def is_array(v: Column) -> Column:
    """Whether a document is an array, without looking into its items."""
    return F.try_variant_get(v, "$", "array<boolean>").isNotNull()


#: Types of scalars by Spark's names; all others are numbers.
_SCALARS = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "BINARY": "data"}


def doc_type(v: Column) -> Column:
    """undefined, null, boolean, number, string, data, array or dict."""
    # the schema of a container is that of all it holds, so only scalars are asked for it, once
    scalar = F.try_element_at(F.create_map(*[F.lit(x) for pair in _SCALARS.items() for x in pair]), _kind(v))
    return F.when(v.isNull(), "undefined").when(is_dict(v), "dict").when(is_array(v), "array").otherwise(F.coalesce(scalar, F.lit("number")))


def is_number(v: Column) -> Column:
    return doc_type(v) == "number"


def _wide(v: Column) -> Column:
    """A number as a decimal wide enough for 64-bit integers of either sign."""
    return F.try_variant_get(v, "$", "decimal(20,0)")


def is_unsigned(v: Column) -> Column:
    """An integer above the signed range."""
    k = _kind(v)
    return F.coalesce(k.rlike(r"^DECIMAL\((19|20),0\)$") & (_wide(v) > F.lit(INT64_MAX).cast("decimal(20,0)")) & (_wide(v) < F.expr("18446744073709551616BD")), F.lit(False))


def is_integer(v: Column) -> Column:
    return F.coalesce(_kind(v) == "BIGINT", F.lit(False)) | is_unsigned(v)


def is_double(v: Column) -> Column:
    return is_number(v) & ~is_integer(v)


def as_double(v: Column) -> Column:
    t = doc_type(v)
    return (F.when(t == "number", F.try_variant_get(v, "$", "double"))
            .when(t == "boolean", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(0.0))


def as_int(v: Column) -> Column:
    """Numbers truncate toward zero; unsigned integers wrap; true is 1; anything else is 0."""
    t = doc_type(v)
    wrapped = (_wide(v) - F.expr("18446744073709551616BD")).cast("bigint")
    other = F.when(is_unsigned(v), wrapped).otherwise(F.try_variant_get(v, "$", "double").cast("bigint"))
    return (F.when(~is_dict(v) & ~is_array(v) & (_kind(v) == "BIGINT"), F.try_variant_get(v, "$", "bigint")).when(t == "number", other)
            .when(t == "boolean", F.try_variant_get(v, "$", "boolean").cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def as_unsigned(v: Column) -> Column:
    """as_int read as an unsigned 64-bit integer."""
    i = as_int(v).cast("decimal(20,0)")
    return F.when(i < 0, (i + F.expr("18446744073709551616BD")).cast("decimal(20,0)")).otherwise(i)


def as_bool(v: Column) -> Column:
    """False for undefined, null, false and numbers that truncate to 0; true for all else, empty or not."""
    t = doc_type(v)
    return (F.when(t.isin("undefined", "null"), False).when(t == "boolean", F.try_variant_get(v, "$", "boolean"))
            .when(t == "number", as_int(v) != 0).otherwise(True))


def as_string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_data(v: Column) -> Column:
    return F.when(_kind(v) == "BINARY", F.try_variant_get(v, "$", "binary"))


def as_array(v: Column) -> Column:
    """ARRAY<VARIANT>, NULL unless an array."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_dict(v: Column) -> Column:
    """MAP<STRING, VARIANT> in key order, NULL unless a dict."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_timestamp_ms(v: Column) -> Column:
    """Milliseconds since 1970: of an ISO-8601 string, or the number itself; NULL otherwise."""
    from .dates import parse_iso8601

    t = doc_type(v)
    return F.when(t == "string", parse_iso8601(as_string(v))).when(t == "number", as_int(v))


def to_string(v: Column) -> Column:
    """Scalars as text (`null`, `true`, numbers, strings); NULL for data, arrays and dicts."""
    t = doc_type(v)
    from .numbers import format_double

    number = F.when(is_integer(v), F.try_variant_get(v, "$", "decimal(20,0)").cast("string")).otherwise(format_double(as_double(v)))
    return (F.when(t == "null", "null").when(t == "boolean", F.try_variant_get(v, "$", "boolean").cast("string"))
            .when(t == "number", number).when(t == "string", as_string(v)))


def doc_struct(v: Column, ddl: str) -> Column:
    """A document opened with a known schema."""
    return F.try_variant_get(v, "$", ddl)
