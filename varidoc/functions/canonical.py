"""Canonical JSON: equal documents have equal text, so text serves for equality, grouping and joins."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """Shortest text that reads back as x: `.0` on whole numbers, an exponent below 1e-4 and above 2^53."""
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    text = repr(x)
    if abs(x) > 2**53 and "e" not in text:
        digits = text.split(".")[0].lstrip("-")
        head = digits.rstrip("0") or "0"
        text = f"{'-' if x < 0 else ''}{head[0]}{'.' + head[1:] if len(head) > 1 else ''}e+{len(digits) - 1:02d}"
    return text


#: Control characters without a letter of their own.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_LETTERS = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = str.maketrans(_LETTERS)


def string_text(s: str) -> str:
    """A JSON string literal, as text.escape_json makes it."""
    return f'"{_CONTROL.sub(lambda m: f"\\u{ord(m[0]):04x}", s.translate(_SPECIAL))}"'


#: In json's texts: what canonical text writes otherwise, characters that have letters there and numbers above 2^53.
_OTHERWISE = re.compile(r"\\[bf]|\x7f|\d{16}\.")


def canonical(x) -> str:
    """Canonical text of a parsed document: keys in byte order at every level."""
    text = json.dumps(x, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
    return _spelt(x) if _OTHERWISE.search(text) else text


def _spelt(x) -> str:
    """canonical, value by value."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{string_text(k)}:{_spelt(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_spelt, x)) + "]"
    if isinstance(x, float):
        return number_text(x)
    if isinstance(x, str):
        return string_text(x)
    return json.dumps(x, ensure_ascii=False)


def _integer(s: str):
    i = int(s)
    return i if -(1 << 63) <= i < 1 << 64 else float(i)


def _refuse(s: str):
    raise ValueError(s)


#: Decoders, made once; the second one for texts with integers that may pass 64 bits.
_PLAIN, _WIDE = json.JSONDecoder(parse_constant=_refuse), json.JSONDecoder(parse_int=_integer, parse_constant=_refuse)
_LONG = re.compile(r"[0-9]{19}")


def parsed(text: str):
    """A parsed document: the last of repeated keys wins; integers outside 64 bits are floats."""
    return (_WIDE if _LONG.search(text) else _PLAIN).decode(text)


def _canonical(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        out = []
        for t in batch.to_pylist():
            try:
                out.append(None if t is None else canonical(parsed(t)))
            except (ValueError, RecursionError):
                out.append(None)
        yield pa.array(out, pa.string())


def canonical_text(json_text: Column) -> Column:
    """Canonical form of JSON text, NULL for malformed text. 1 and 1.0 differ."""
    return F.arrow_udf(_canonical, "string")(json_text)


def doc_equal(a: Column, b: Column) -> Column:
    """Deep equality of two documents; NULL equals NULL. to_json writes keys in order at every level."""
    return F.to_json(F.struct(a.alias("x"), F.schema_of_variant(a).alias("t"))).eqNullSafe(F.to_json(F.struct(b.alias("x"), F.schema_of_variant(b).alias("t"))))
