"""Deep walks: a row for every value in a document, level by level, by exploding variants in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varidoc.functions.collections import empty_dict
from varidoc.functions.values import as_array, as_dict, doc_type, is_array, is_dict

#: Nesting that a walk follows at most; deeper documents are an error.
MAX_DEPTH = 100
#: Levels that are opened by Spark's explode of variants; a plan of more such levels overflows the stack.
QUICK_DEPTH = 32


def nesting(v: Column) -> Column:
    """How many containers lie around a document's innermost value: 0 for a scalar."""
    # whole runs at a time and without a step back, so long texts need no stack; what lies side by side counts once
    brackets = F.translate(F.regexp_replace(F.to_json(v), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\[\]{}]++', ""), "{}", "[]")
    steps = F.transform(F.split(F.regexp_replace(brackets, r"(?:\[\])++", "[]"), ""), lambda c: F.when(c == "[", 1).when(c == "]", -1).otherwise(0))
    at = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.reduce(steps, at, lambda d, s: F.struct((d["now"] + s).alias("now"), F.greatest(d["most"], d["now"] + s).alias("most")), lambda d: d["most"])


def _nested(df: DataFrame, v: str) -> int:
    """The greatest nesting of df's documents, which a walk must be able to follow."""
    depth = df.agg(F.max(nesting(F.col(v)))).first()[0] or 0
    if depth > MAX_DEPTH:
        raise ValueError(f"documents are nested {depth} deep, and a walk follows {MAX_DEPTH} levels")
    return depth


def _escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _path(parent: Column, key: Column, index: Column) -> Column:
    bare = key.rlike(r"^[A-Za-z0-9_]+$")
    name = F.when(bare, F.concat(F.when(parent == "", "").otherwise("."), key)).otherwise(F.concat(F.lit('["'), key, F.lit('"]')))
    return F.concat(parent, F.when(index.isNotNull(), F.concat(F.lit("["), index.cast("string"), F.lit("]"))).otherwise(name))


def _opened(rows: DataFrame, open_: Column) -> DataFrame:
    """Rows, and beside them a row for each value in those that open_ is true of: at, name, item. A row that stays has
    itself as item and NULL at. A container comes a second time to be opened, and the kept one is not beside the opened
    one, so values do not repeat for each item."""
    value, opens, others = F.col("value"), F.col("opens"), [c for c in rows.columns if c != "value"]
    rows = rows.select("*", F.explode(F.when(open_, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("opens"))
    rows = rows.select(*others, F.when(~opens, value).alias("kept"), F.when(opens, value).alias("opening"))
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("opening").outer()).toDF("at", "name", "found"))
    return rows.select(*others, "at", "name", F.coalesce("found", "kept").alias("item")).filter("item is not null")


def _opened_in_place(rows: DataFrame, open_: Column) -> DataFrame:
    """_opened by arrays of entries: several times slower, in a plan of few enough nodes a level for the deepest walks."""
    value, none = F.col("value"), F.lit(None)
    entry = lambda name, at, item: F.struct(at.cast("int").alias("at"), name.cast("string").alias("name"), item.alias("item"))
    inside = (F.when(open_ & is_dict(value), F.transform(F.map_entries(as_dict(value)), lambda e, i: entry(e["key"], i, e["value"])))
              .when(open_, F.transform(as_array(value), lambda x, i: entry(none, i, x))))
    found = F.explode(F.concat(F.array(entry(none, none, value)), F.coalesce(inside, F.array()))).alias("found")
    return rows.select("*", found).select(*[c for c in rows.columns if c != "value"], "found.*")


def doc_walk(df: DataFrame, id_col: str, v: str, *, max_depth: int | None = None, prune: tuple[str, ...] = ()) -> DataFrame:
    """id, pointer, path, parent_pointer, key, idx, depth, type, value, visit, pos. The root's pointer is `/`.

    Ordered by (visit, pos), nulls first, a container's values come together, and of its containers the last
    is opened first: the order in which a single thread with a stack of open containers meets them.

    Levels are a chain of explodes in one pass, without a shuffle; with max_depth no job runs before the result
    is used, without it one job asks for the greatest nesting, which must not exceed MAX_DEPTH. Values under pruned
    pointers are skipped.
    """
    if max_depth is None:
        max_depth = _nested(df, v)
    none, n = F.lit(None), F.col
    rows = df.filter(F.col(v).isNotNull()).select(
        F.col(id_col).alias("id"), F.lit("/").alias("pointer"), F.lit("").alias("path"), none.cast("string").alias("parent_pointer"), none.cast("string").alias("key"), none.cast("int").alias("idx"),
        F.lit(0).alias("depth"), F.col(v).alias("value"), none.cast("array<int>").alias("visit"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("opened"))
    for depth in range(1, max_depth + 1):
        open_ = (n("depth") == depth - 1) & (is_dict(n("value")) | is_array(n("value")))
        if prune:
            open_ = open_ & ~n("pointer").isin(*prune)
        rows = (_opened if depth <= QUICK_DEPTH else _opened_in_place)(rows, open_)
        # all else is made of columns behind the explode, so that Spark leaves out those that nobody asks for
        key, pos = n("name"), n("at")
        idx = F.when(key.isNull(), pos)
        made = {
            "pointer": F.concat(F.when(n("pointer") == "/", "").otherwise(n("pointer")), F.lit("/"), F.coalesce(_escaped(key), pos.cast("string"))), "path": _path(n("path"), key, idx), "parent_pointer": n("pointer"),
            "key": key, "idx": idx, "depth": F.lit(depth), "visit": n("opened"), "pos": pos, "opened": F.concat(n("opened"), F.array(-pos))}
        rows = rows.select("id", *[F.when(pos.isNotNull(), x).otherwise(n(c)).alias(c) for c, x in made.items()], n("item").alias("value"))
    return rows.select("id", "pointer", "path", "parent_pointer", "key", "idx", "depth", doc_type(n("value")).alias("type"), "value", "visit", "pos")


def _same(a: Column, b: Column) -> Column:
    """Whether documents show no difference, by their text and types; false also where types within an array are mixed."""
    k = F.schema_of_variant(a)
    return F.coalesce(F.when(F.to_json(a) == F.to_json(b), (k == F.schema_of_variant(b)) & ~k.contains("VARIANT")), F.lit(False))


def _steps(v: Column) -> Column:
    """Values of a container by the last part of their pointers; empty for a scalar."""
    items = as_array(v)
    return F.coalesce(as_dict(v), F.map_from_arrays(F.transform(items, lambda _, i: i.cast("string")), items), empty_dict())


def diff_rows(old: DataFrame, new: DataFrame, id_col: str, v: str, *, max_depth: int | None = None) -> DataFrame:
    """Structural difference by a walk through both documents of an id at once: id, pointer, change (added, removed,
    changed), old_value, new_value (JSON text). Containers show only when their type changes; of an id that is repeated
    each old document is compared with each new one.

    Documents meet once, by id; values that are the same are not opened, so rows come from what differs."""
    if max_depth is None:
        max_depth = max(_nested(old, v), _nested(new, v))
    side = lambda df, name: df.filter(F.col(v).isNotNull()).select(F.col(id_col).alias("id"), F.col(v).alias(name))
    rows = side(old, "old").join(side(new, "new"), "id", "full").filter(~_same(F.col("old"), F.col("new")))
    rows = rows.select("id", F.lit("/").alias("pointer"), F.lit(0).alias("depth"), "old", "new")
    for depth in range(1, max_depth + 1):
        entry = lambda step, a, b: F.struct(step.cast("string").alias("step"), a.alias("old"), b.alias("new"))
        pairs = F.map_entries(F.map_zip_with(_steps(F.col("old")), _steps(F.col("new")), lambda _, x, y: F.struct(x.alias("old"), y.alias("new"))))
        inside = F.when(F.col("depth") == depth - 1, F.transform(pairs, lambda e: entry(e["key"], e["value"]["old"], e["value"]["new"])))
        rows = rows.select("*", F.explode(F.concat(F.array(entry(F.lit(None), F.col("old"), F.col("new"))), F.coalesce(inside, F.array()))).alias("found"))
        step, a, b = (F.col("found")[c] for c in ("step", "old", "new"))
        at = F.concat(F.when(F.col("pointer") == "/", "").otherwise(F.col("pointer")), F.lit("/"), _escaped(step))
        rows = rows.filter(step.isNull() | ~_same(a, b)).select(
            "id", F.coalesce(at, "pointer").alias("pointer"), F.when(step.isNull(), F.col("depth")).otherwise(depth).alias("depth"), a.alias("old"), b.alias("new"))
    shown = rows.select("id", "pointer", *[x for c in ("old", "new") for x in (F.when(F.col(c).isNotNull(), doc_type(F.col(c))).alias(f"{c}_type"), F.col(c).alias(f"{c}_doc"))])
    text = lambda c: F.when(~F.col(f"{c}_type").isin("array", "dict"), F.to_json(f"{c}_doc")).alias(f"{c}_value")
    both = shown.select("id", "pointer", "old_type", "new_type", text("old"), text("new"))
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when((F.col("old_type") != F.col("new_type")) | ~F.col("old_value").eqNullSafe(F.col("new_value")), "changed"))
    return both.withColumn("change", change).filter("change is not null").select("id", "pointer", "change", "old_value", "new_value")
