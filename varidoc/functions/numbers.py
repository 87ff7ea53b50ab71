"""Numbers and text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from varidoc.functions.canonical import number_text


def parse_integer(s: Column, trailing: bool = False) -> Column:
    """A signed 64-bit integer, NULL if s is none; with trailing, what follows the digits is ignored."""
    head = F.regexp_extract(s, r"^\s*([+-]?[0-9]+)" if trailing else r"^\s*([+-]?[0-9]+)\s*$", 1)
    return head.try_cast("bigint")


def parse_unsigned(s: Column, wide: bool = False) -> Column:
    """An unsigned 64-bit integer as DECIMAL(20,0), NULL if s is none; wide takes every integer of 20 digits."""
    head = F.regexp_extract(s, r"^\s*\+?([0-9]+)\s*$", 1).try_cast("decimal(38,0)")
    return F.when((head >= 0) & (head < F.expr("100000000000000000000BD" if wide else "18446744073709551616BD")), head.cast("decimal(20,0)"))


def parse_double(s: Column, trailing: bool = False) -> Column:
    """A decimal floating-point number, NULL if s is none; with trailing, what follows the number is ignored."""
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.nullif(F.regexp_extract(s, number + ("" if trailing else r"\s*$"), 1), F.lit("")).try_cast("double")


#: Integer types by name: the least and the greatest value.
RANGES = {f"{u}int{n}": (0, (1 << n) - 1) if u else (-(1 << (n - 1)), (1 << (n - 1)) - 1) for n in (8, 16, 32, 64) for u in ("", "u")}


def narrow(x: Column, kind: str, strict: bool = False) -> Column:
    """An integer as a narrower type (int8 to uint64); out of range it is NULL, or an error if strict."""
    low, high = RANGES[kind]
    wide = x.cast("decimal(38,0)")
    to = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint"}.get(kind, "decimal(20,0)")
    fits = wide.between(F.expr(f"{low}BD"), F.expr(f"{high}BD"))
    if strict:
        return F.when(fits | x.isNull(), wide.cast(to)).otherwise(F.raise_error(F.concat(wide.cast("string"), F.lit(f" is no {kind}"))).cast(to))
    return F.when(fits, wide.cast(to))


def is_float_representable(x: Column) -> Column:
    return x.cast("float").cast("double") == x


def _texts(numbers: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in numbers:
        yield pa.array([None if x is None or not math.isfinite(x) else number_text(x) for x in batch.to_pylist()], pa.string())


def format_double(x: Column) -> Column:
    """Shortest text that reads back as x, of such texts the nearest to x: `.0` on whole numbers, an exponent below
    1e-4 and above 2^53. NULL for what is no number or infinite. Java before 19 knows no such text."""
    return F.arrow_udf(_texts, "string")(x.cast("double"))


def finite(x: Column) -> Column:
    """x, failing where it is no number that JSON has (not a number, or infinite)."""
    return F.when(x.isNull() | ~(F.isnan(x) | (F.abs(x) == float("inf"))), x).otherwise(F.raise_error(F.lit("JSON has no such number")).cast("double"))
