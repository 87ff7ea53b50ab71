"""Key paths such as `foo.bar[2][-3].baz`, planned into variant accessors."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from varidoc.functions.binding import bind
from varidoc.functions.collections import array_get, dict_get, empty_dict
from varidoc.functions.values import as_array, as_dict, is_array

_INDEX = re.compile(r"\[(-?\d+)\]")
_NAME = re.compile(r"(?:\\.|[^\\.\[])+", re.S)


@dataclass(frozen=True)
class KeyPath:
    """Names and indexes from the root. Equal paths are equal values."""

    parts: tuple[str | int, ...] = ()

    @classmethod
    def parse(cls, spec: str) -> KeyPath:
        """`.name`, `[int]`, a leading `$`, and `\\` before a special character; empty names are skipped."""
        if not spec:
            raise ValueError("a path must not be empty")
        rest, parts = spec, []
        if rest[0] == "$":
            rest = rest[1:]
            if rest and rest[0] not in ".[":
                raise ValueError(f"{spec!r}: $ must be followed by . or [")
        while rest:
            if rest[0] == ".":
                rest = rest[1:]
            elif rest[0] == "[":
                m = _INDEX.match(rest)
                if not m or not -(1 << 31) <= int(m[1]) < 1 << 31:
                    raise ValueError(f"{spec!r}: bad index")
                parts.append(int(m[1]))
                rest = rest[m.end() :]
                if rest and rest[0] not in ".[":
                    raise ValueError(f"{spec!r}: . or [ must follow ]")
            else:
                m = _NAME.match(rest)
                if not m:
                    raise ValueError(f"{spec!r}: nothing after \\")
                parts.append(re.sub(r"\\(.)", r"\1", m[0], flags=re.S))
                rest = rest[m.end() :]
        return cls(tuple(parts))

    def __str__(self) -> str:
        out = ""
        for p in self.parts:
            if isinstance(p, int):
                out += f"[{p}]"
            else:
                name = re.sub(r"([.\[\\])", r"\\\1", p)
                if not out:
                    out = ("\\" + name) if name.startswith("$") else name
                else:
                    out += "." + name
        return out or "$"

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, i: int) -> str | int:
        return self.parts[i]

    def __add__(self, other: KeyPath | str | int) -> KeyPath:
        more = other.parts if isinstance(other, KeyPath) else (other,) if isinstance(other, int) else KeyPath.parse(other).parts
        return KeyPath(self.parts + more)

    def drop(self, n: int) -> KeyPath:
        return KeyPath(self.parts[n:])


def doc_get(v: Column, path: KeyPath | str) -> Column:
    """The value at path, NULL as soon as something is missing or of another type."""
    for part in (KeyPath.parse(path) if isinstance(path, str) else path).parts:
        v = array_get(v, part) if isinstance(part, int) and part < 0 else F.try_variant_get(v, f"$[{part}]", "variant") if isinstance(part, int) else dict_get(v, part)
    return v


def doc_pointer(v: Column, pointer: str) -> Column:
    """The value at a JSON pointer (RFC 6901). A number is an index in an array and a key in a dict."""
    if pointer in ("", "/"):
        return v
    if pointer[0] != "/":
        raise ValueError(f"{pointer!r} does not begin with /")
    for part in pointer[1:].split("/"):
        key = part.replace("~1", "/").replace("~0", "~")
        # what is an array has no key, what is a dict has no index
        v = F.coalesce(F.try_variant_get(v, f"$[{int(key)}]", "variant"), dict_get(v, key)) if re.fullmatch(r"0|[1-9]\d{0,8}", key) else dict_get(v, key)
    return v


def _step(v: Column, name: Column, index: Column) -> Column:
    """The value under a name in a dict, or at an index (from the end if negative) in an array."""
    items = as_array(v)
    item = F.when(index >= 0, F.get(items, index)).when(index < 0, F.try_element_at(items, index))
    return F.when(index.isNotNull(), item).otherwise(F.try_element_at(as_dict(v), name))


def doc_get_by(v: Column, path: Column) -> Column:
    """The value at a path that is a column; NULL also where the path is malformed."""
    fine = path.rlike(r"^(?:\$(?=[.\[]|$))?(?:\.|\[-?\d+\](?=[.\[]|$)|(?:\\.|[^.\[\\$])(?:\\.|[^.\[\\])*)*$") & (path != "")
    parts = F.regexp_extract_all(F.regexp_replace(path, r"^\$", ""), F.lit(r"(\[-?\d+\]|(?:\\.|[^.\[\\])+)"), F.lit(1))
    index = lambda p: F.when(p.startswith("["), F.regexp_extract(p, r"^\[(-?\d+)\]$", 1).try_cast("int"))
    name = lambda p: F.regexp_replace(p, r"\\(.)", "$1")
    return F.when(fine, F.reduce(parts, v, lambda found, p: _step(found, name(p), index(p))))


def doc_pointer_by(v: Column, pointer: Column) -> Column:
    """The value at a JSON pointer that is a column; NULL also where it does not begin with /."""
    parts = F.transform(F.split(F.substring(pointer, 2, 1 << 30), "/"), lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    index = lambda p: F.when(p.rlike(r"^(?:0|[1-9]\d{0,8})$"), p.try_cast("int"))
    step = lambda found, p: F.when(is_array(found), F.get(as_array(found), index(p))).otherwise(F.try_element_at(as_dict(found), p))
    return F.when(pointer.isin("", "/"), v).when(pointer.startswith("/"), F.reduce(parts, v, step))


def _within(v: Column, parts: tuple[str | int, ...], change) -> Column:
    """v with change(old value) at the end of a path; NULL where the path does not lead anywhere."""
    if not parts:
        return change(v)
    part, last = parts[0], len(parts) == 1

    def in_array(items: Column) -> Column:
        at = F.lit(part) if part >= 0 else F.size(items) + part
        put = lambda new: F.filter(F.transform(items, lambda x, i: F.when(i == at, new).otherwise(x)), lambda x: x.isNotNull())
        there = (at >= 0) & (at < F.size(items))
        return F.when(there, bind(_within(F.get(items, at), parts[1:], change), lambda new: F.when(new.isNotNull() | F.lit(last), F.to_variant_object(put(new)))))

    def in_dict(d: Column) -> Column:
        rest = F.map_filter(d, lambda k, _: k != part)
        removed = F.when(F.lit(last) & F.map_contains_key(d, part), F.to_variant_object(rest))
        return bind(_within(F.try_element_at(d, F.lit(part)), parts[1:], change), lambda new: F.when(new.isNotNull(), F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(part), new)))).otherwise(removed))

    if isinstance(part, int):
        return bind(as_array(v), in_array)
    return bind(F.coalesce(as_dict(v), F.when(v.isNull(), empty_dict())), in_dict)


def doc_update(v: Column, path: KeyPath | str, change) -> Column:
    """v with change(old value) at a path inside it; the old value is NULL if there is none. Missing dicts on the way
    are made; where something of another type is in the way, or an index is out of range, v stays as it is. A change
    to NULL removes the key or item."""
    parts = (KeyPath.parse(path) if isinstance(path, str) else path).parts
    return bind(v, lambda v: F.coalesce(_within(v, parts, change), v))


def doc_set(v: Column, path: KeyPath | str, value: Column) -> Column:
    """doc_update with a value (VARIANT)."""
    return doc_update(v, path, lambda _: value)


def doc_remove(v: Column, path: KeyPath | str) -> Column:
    """v without the key or item at a path."""
    return doc_set(v, path, F.lit(None).cast("variant"))
