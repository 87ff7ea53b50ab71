"""A keyed store of documents as a table (key, value), and a log of versions, whole or as deltas.

Stores are DataFrames; every change gives a new one. Keys are whole strings, so hashes never collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varidoc.functions.canonical import canonical_text
from varidoc.operators.delta import doc_diff, doc_patch_all


def get(store: DataFrame, key: str) -> DataFrame:
    return store.filter(F.col("key") == key)


def get_all(store: DataFrame, keys: DataFrame) -> DataFrame:
    """key and value of those keys that are in the store."""
    return keys.select("key").distinct().join(store, "key")


def upsert(store: DataFrame, updates: DataFrame, merge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """store with updates (key, value): a NULL value removes its key. merge gets the old value (NULL if
    there is none) and the new one, and its NULL leaves things as they are."""
    old, new = store.select("key", F.col("value").alias("old")), updates.select("key", F.col("value").alias("new"), F.lit(True).alias("touched"))
    both = old.join(new, "key", "full")
    value = F.col("new") if merge is None else F.coalesce(merge(F.col("old"), F.col("new")), F.col("old"))
    return both.select("key", F.when(F.col("touched"), value).otherwise(F.col("old")).alias("value")).filter("value is not null")


def remove(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key").distinct(), "key", "left_anti")


def fold_newest(log: DataFrame) -> DataFrame:
    """key and value of the newest version of each key of a log (key, version, value), removals as NULL."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value"), "version").alias("last"))
    return newest.select("key", F.col("last")["value"].alias("value"))


def fold_versions(log: DataFrame) -> DataFrame:
    """The state that a log leads to: a NULL value is a removal."""
    return fold_newest(log).filter("value is not null")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change (added, removed, changed) between two states of a store of comparable values."""
    both = old.select("key", F.col("value").alias("a")).join(new.select("key", F.col("value").alias("b")), "key", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("key", change.alias("change")).filter("change is not null")


def history(log: DataFrame) -> DataFrame:
    """log with the previous version's value beside each."""
    return log.withColumn("previous", F.lag("value").over(Window.partitionBy("key").orderBy("version")))


def save(store: DataFrame, path: str, *, append: bool = False) -> None:
    """Writes a store or a log as Parquet, whole or beside what is there."""
    store.write.mode("append" if append else "errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def amend(base: DataFrame, updates: DataFrame, version: int | Column) -> DataFrame:
    """Rows (key, version, delta) that lead from base (key, value: JSON text) to updates (key, value): a delta for
    each document that changes, a deletion for a NULL value, nothing for one that stays the same."""
    both = updates.select("key", F.col("value").alias("new")).join(base.select("key", F.col("value").alias("old")), "key", "left")
    made = doc_diff("old", F.coalesce("new", F.lit("null")))
    gone = F.col("new").isNull()
    rows = both.select("key", (F.lit(version) if isinstance(version, int) else version).cast("long").alias("version"), F.when(gone, F.lit("[]")).otherwise(made).alias("delta"), (gone & F.col("old").isNull()).alias("never"))
    return rows.filter("not never and delta <> '{}'").drop("never")


def fold_deltas(base: DataFrame, log: DataFrame) -> DataFrame:
    """key and value (canonical JSON text) of base with the deltas of a log (key, version, delta) applied in the
    order of versions. A key's deltas meet in one row; compact() keeps them few."""
    steps = log.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("version", "delta"))), lambda s: s["delta"]).alias("deltas"))
    both = base.select("key", F.col("value").alias("old")).join(steps, "key", "full")
    return both.select("key", doc_patch_all("old", F.coalesce("deltas", F.array().cast("array<string>"))).alias("value")).filter("value is not null")


def compact(base: DataFrame, log: DataFrame, *, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """base and log, with the log of every key folded into base whose deltas are longer, together, than a share of
    its document: reading a document then costs about its own length."""
    size = log.groupBy("key").agg(F.sum(F.octet_length("delta")).alias("size"))
    due = size.join(base.select("key", F.octet_length("value").alias("whole")), "key", "left").filter(F.col("size") > share * F.coalesce("whole", F.lit(0))).select("key")
    folded = fold_deltas(base.join(due, "key", "left_semi"), log.join(due, "key", "left_semi"))
    kept = base.join(due, "key", "left_anti").select("key", canonical_text(F.col("value")).alias("value"))
    return kept.unionByName(folded.select("key", "value")), log.join(due, "key", "left_anti")
