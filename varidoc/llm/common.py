"""What several operators share: the shared folder, written tables, bucketed prefix sums."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a bucketed prefix sum should hold.
BUCKET_ROWS = 10_000
#: White space of the word rule: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker turns into Python objects at once, and bytes that a generation of a memo may take.
PART_ROWS, MEMO_BYTES = 256, 16_000_000

_memos: list[Memo] = []


class Memo:
    """What a Python worker remembers from row to row, in two generations: known, and the one before it, from which
    what is asked for again is taken over. Each holds about `room` bytes; unless the memo is lasting it forgets
    everything at its task's end. This bounds memory, not results."""

    def __init__(self, room: int = MEMO_BYTES, *, lasting: bool = False):
        self.known: dict = {}
        self.old: dict = {}
        self.room, self.held, self.each = room, 0, 0
        if not lasting:
            _memos.append(self)

    def tidy(self) -> None:
        """Begins a new generation if this one is full; what is added after this stays until the next call."""
        if self.held > self.room:
            self.each = self.held // max(1, len(self.known))
            self.known, self.old, self.held = {}, self.known, 0

    def add(self, key, value, size: int):
        """Remembers value, which with its key takes about size bytes, and returns it."""
        self.held += size
        self.known[key] = value
        return value

    def get(self, key):
        """The value of a key, None if it is not remembered."""
        value = self.known.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.add(key, value, self.each)
        return value

    def missing(self, keys: set, *, keep: bool = False) -> list:
        """The keys that are not remembered; all others are in known after this. keep: in this generation."""
        if not keep:
            self.tidy()
        new = keys.difference(self.known)
        if not self.old:
            return [*new]
        out, old = [], self.old
        for k in new:
            if k in old:
                self.add(k, old[k], self.each)
            else:
                out.append(k)
        return out

    def clear(self) -> None:
        self.known, self.old, self.held = {}, {}, 0


def forget() -> None:
    """Empties all memos of this worker, which may serve other tasks for long."""
    for memo in _memos:
        memo.clear()
    pa.default_memory_pool().release_unused()


def parts_of(batch):
    """A batch or array in parts of PART_ROWS rows; an empty one as it is."""
    return [batch.slice(i, PART_ROWS) for i in range(0, len(batch), PART_ROWS)] or [batch]


def in_parts(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, on few rows at once, forgetting at the end what it remembered."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(part for batch in batches for part in parts_of(batch))
        finally:
            forget()

    return inner


def each_part(convert: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """convert for an Arrow UDF, on few rows at once, forgetting at the end what it remembered."""

    def inner(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for array in arrays:
                yield pa.concat_arrays([convert(part) for part in parts_of(array)])
        finally:
            forget()

    return inner


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, for a column that goes again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content(df: DataFrame, without: str | None = None) -> Column:
    """A hash of a row's columns, but for one; columns that Spark cannot hash (maps, variants) do not count."""
    kinds = [(c, t) for c, t in df.dtypes if c != without and "map<" not in t and "variant" not in t]
    return F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c, _ in kinds], F.lit(0))


def with_struct(df: DataFrame, struct: Column, names: dict[str, str]) -> DataFrame:
    """df with fields of a struct as columns by other names (fields by names); they take the place of df's own
    columns of these names, compared as Spark compares names."""
    made = fresh(df, "made")
    new = {n.lower() for n in names.values()}
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in new]
    return df.withColumn(made, struct).select(*kept, *[F.col(made)[field].alias(name) for field, name in names.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors must share. Where none is
    named, a session in one process gets a folder of its own, and a cluster is refused."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="varidoc-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder and read again: cuts in the lineage that survive lost executors.
    drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables that write() gave; others are left alone."""
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again."""
    return Scratch(df.sparkSession).write(df, name, compression)


def buckets_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    return max(1, math.ceil(rows / per_bucket))


def slice_of(hex_digest: Column, n: int) -> Column:
    """Slice 0 to n-1 of a hexadecimal digest, rising with the digest's order."""
    head = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(n) / F.lit(1 << 32)).cast("int")


def with_running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds name: the inclusive running total of value in each group of keys, in the order (bucket, *order).

    bucket must rise with the wanted order and split large groups; a hot key is then
    summed in as many tasks as it has buckets. Only the buckets' totals meet per key.
    """
    part = [*keys, bucket]
    local = df.withColumn("_local", F.sum(value).over(
        Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*part).agg(F.sum(value).alias("_sum"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    renamed = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(part)], "_before")
    on = None
    for i, k in enumerate(part):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    joined = local.join(renamed, on)
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", *[f"_k{i}" for i in range(len(part))])
