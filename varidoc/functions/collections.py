"""Arrays (ARRAY<VARIANT>) and dicts (MAP<STRING, VARIANT>): reading, and copies with changes.

Nothing is changed in place. A dict's deleted keys are an array of names beside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import as_array, as_dict


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def _array(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<variant>"))


def array_count(v: Column) -> Column:
    return F.coalesce(F.size(as_array(v)), F.lit(0))


def array_get(v: Column, i: int) -> Column:
    """Item i from 0, or from the end if negative; NULL when out of range."""
    items = as_array(v)
    return F.get(items, F.lit(i)) if i >= 0 else F.try_element_at(items, F.lit(i))


def array_set(items: Column, i: int, value: Column) -> Column:
    return F.transform(items, lambda x, k: F.when(k == i, value).otherwise(x))


def array_insert_nulls(items: Column, at: int, n: int) -> Column:
    """n JSON nulls before item at; fails if at is past the end."""
    ok = F.when(F.size(items) >= at, items).otherwise(F.raise_error(F.lit(f"insert at {at} is past the end")).cast("array<variant>"))
    return F.concat(F.slice(ok, 1, at), F.array_repeat(json_null(), n), F.slice(ok, at + 1, 1 << 30))


def array_remove_range(items: Column, at: int, n: int) -> Column:
    """Without n items from at; fails if they are past the end."""
    ok = F.when(F.size(items) >= at + n, items).otherwise(F.raise_error(F.lit(f"remove of {n} at {at} is past the end")).cast("array<variant>"))
    return F.concat(F.slice(ok, 1, at), F.slice(ok, at + n + 1, 1 << 30))


def array_resize(items: Column, n: int) -> Column:
    """Cut to n items, or filled up with JSON nulls."""
    return F.concat(F.slice(items, 1, n), F.array_repeat(json_null(), F.greatest(F.lit(n) - F.size(items), F.lit(0))))


def array_overlay(items: Column, changes: Column) -> Column:
    """changes (MAP<INT, VARIANT>) laid over items."""
    return F.transform(items, lambda x, k: F.coalesce(F.try_element_at(changes, k), x))


def array_rest(items: Column, n: int) -> Column:
    """items from n on; fails if n is past the end."""
    ok = F.when(F.size(items) >= n, items).otherwise(F.raise_error(F.lit(f"{n} is past the end")).cast("array<variant>"))
    return F.slice(ok, n + 1, 1 << 30)


def dict_count(v: Column) -> Column:
    return F.coalesce(F.size(as_dict(v)), F.lit(0))


def dict_is_empty(v: Column) -> Column:
    """True for an empty dict and for what is none."""
    return dict_count(v) == 0


def dict_get(v: Column, key: str) -> Column:
    """The value of a key, whatever characters it has; NULL if there is none or v is no dict."""
    # Spark's paths know no escapes, so a key is quoted by what it does not contain, or looked up in a map
    for quote in "'\"":
        if key and quote not in key and "?" not in key:
            return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(as_dict(v), F.lit(key))


def empty_dict() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def dict_set(d: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(d, lambda k, _: k != key), F.create_map(key, value))


def dict_remove(d: Column, key: Column) -> Column:
    return F.map_filter(d, lambda k, _: k != key)


def dict_update(d: Column, changes: Column, removed: Column | None = None) -> Column:
    """d with the values of changes; keys of removed (names) go first."""
    kept = F.map_filter(d, lambda k, _: ~F.map_contains_key(changes, k))
    kept = kept if removed is None else F.map_filter(kept, lambda k, _: ~F.array_contains(removed, k))
    return F.map_concat(kept, changes)


def dict_inherit(parent: Column, child: Column, deleted: Column | None = None) -> Column:
    """child over parent: its values win, its deleted keys are gone."""
    merged = F.map_zip_with(parent, child, lambda k, p, c: F.coalesce(c, p))
    return merged if deleted is None else F.map_filter(merged, lambda k, _: ~F.array_contains(deleted, k))


def to_doc(value: Column) -> Column:
    """An array, map or struct as a document."""
    return F.to_variant_object(value)
