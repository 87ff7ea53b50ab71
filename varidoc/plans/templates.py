"""Documents built from templates such as `{name: %s, size: %d, tags: [%s, 'x']}`.

A template is JSON with bare or single-quoted keys and a % mark for each column. It is read once, when the
query is planned, and becomes an expression of structs and arrays. A mark's NULL drops the key or item;
`%-` marks also drop their type's zero (false, 0, empty). A built template can be merged into a dict or appended
to an array (doc_put); there a dropped key goes from the dict too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from varidoc.functions.binding import bind
from varidoc.functions.collections import dict_update, empty_dict
from varidoc.functions.values import as_array, as_dict

_TOKEN = re.compile(r"""\s*(?:(%-?[a-z@])|([{}\[\]:,])|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?)|([+-]?\d+)|([A-Za-z_$][A-Za-z0-9_$]*))""", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|.))", re.S)
#: Letters that stand for control characters after a backslash; a broken line goes on.
_MEANT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": ""}
#: Spark types of marks: booleans, integers, unsigned integers, numbers, strings, data, documents.
MARKS = {"c": "boolean", "b": "boolean", "d": "bigint", "i": "bigint", "u": "decimal(20,0)", "f": "double", "s": "string", "p": "binary", "@": "variant"}


def unescaped(literal: str) -> str:
    """A string literal's text, with escapes as in JSON5."""
    text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _MEANT.get(m[3], m[3]), literal)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of surrogates


def _tokens(template: str) -> list[tuple[int, str]]:
    tokens = []
    at = 0
    template = template.strip()
    while at < len(template):
        m = _TOKEN.match(template, at)
        if not m:
            raise ValueError(f"template: cannot read {template[at:]!r}")
        tokens.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    return tokens


def _built(template: str, columns: tuple[Column, ...]) -> tuple[Column, Column, bool]:
    """The document; its outermost keys or items as an array, NULL where dropped; and whether it is a dict."""
    tokens, given = _tokens(template), iter(columns)
    outermost: list[Column] = []

    def scalar(kind: int, text: str) -> Column:
        if kind == 1:
            col = next(given, None)
            if col is None:
                raise ValueError("template: more marks than columns")
            mark = text[-1]
            col = col if mark == "@" else col.cast(MARKS[mark])
            if text[1] == "-":
                zero = {"boolean": F.lit(False), "string": F.lit(""), "binary": F.lit(b"")}.get(MARKS[mark], F.lit(0))
                col = F.when(col != zero, col)
            return col if mark == "@" else F.when(col.isNotNull(), col).cast("variant")
        if kind in (3, 4):
            return F.lit(unescaped(text)).cast("variant")
        if kind == 5:
            return F.lit(float(text)).cast("variant")
        if kind == 6:
            return F.lit(int(text)).cast("bigint").cast("variant")
        words = {"null": F.parse_json(F.lit("null")), "true": F.lit(True).cast("variant"), "false": F.lit(False).cast("variant")}
        if text not in words:
            raise ValueError(f"template: {text!r} is no value")
        return words[text]

    def value(i: int) -> tuple[Column, int]:
        kind, text = tokens[i]
        if text == "{" and kind == 2:
            keys, values, i = [], [], i + 1
            while tokens[i] != (2, "}"):
                if tokens[i][0] not in (3, 4, 7):
                    raise ValueError("template: a key must be a name or a string")
                keys.append(unescaped(tokens[i][1]) if tokens[i][0] != 7 else tokens[i][1])
                if tokens[i + 1] != (2, ":"):
                    raise ValueError("template: a colon must follow a key")
                col, i = value(i + 2)
                values.append(col)
                i += tokens[i] == (2, ",")
            pairs = F.map_from_arrays(F.array(*map(F.lit, keys)).cast("array<string>"), F.array(*values).cast("array<variant>"))
            outermost[:] = [pairs]
            return F.to_variant_object(F.map_filter(pairs, lambda k, x: x.isNotNull())), i + 1
        if text == "[" and kind == 2:
            values, i = [], i + 1
            while tokens[i] != (2, "]"):
                col, i = value(i)
                values.append(col)
                i += tokens[i] == (2, ",")
            items = F.filter(F.array(*values).cast("array<variant>"), lambda x: x.isNotNull())
            outermost[:] = [items]
            return F.to_variant_object(items), i + 1
        return scalar(kind, text), i + 1

    try:
        col, end = value(0)
    except IndexError:
        raise ValueError("template: it ends too early") from None
    if end != len(tokens):
        raise ValueError("template: something follows the value")
    return col, outermost[0] if outermost else col, tokens[0] == (2, "{")


def doc_build(template: str, *columns: Column) -> Column:
    """The document that a template and its columns describe."""
    return _built(template, columns)[0]


def doc_put(v: Column, template: str, *columns: Column) -> Column:
    """v with a dict template's keys set, and those that it drops removed; or with an array template's items
    appended. v stays as it is if it is of the other kind; NULL counts as an empty one."""
    _, parts, is_dict = _built(template, columns)

    def put(v: Column, parts: Column) -> Column:
        if is_dict:
            d = F.coalesce(as_dict(v), F.when(v.isNull(), empty_dict()))
            new = dict_update(d, F.map_filter(parts, lambda k, x: x.isNotNull()), F.map_keys(F.map_filter(parts, lambda k, x: x.isNull())))
        else:
            new = F.concat(F.coalesce(as_array(v), F.when(v.isNull(), F.array().cast("array<variant>"))), parts)
        return F.coalesce(F.to_variant_object(new), v)

    return bind(v, lambda v: bind(parts, lambda parts: put(v, parts)))
