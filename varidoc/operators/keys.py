"""Key dictionaries: keys of documents and their numbers, as a table (key_id, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varidoc.functions.text import can_be_shared_key

#: Keys in a dictionary at most.
CAPACITY = 2048
#: Ranges of the order in which distinct strings are numbered side by side.
RANGES = 256


def could_add(keys: DataFrame, words: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """words (key) with could_add: whether a key is in the dictionary, or is eligible while there is room."""
    room = keys.count() < capacity
    known = keys.select("key", F.lit(True).alias("_known"))
    return words.join(known, "key", "left").withColumn("could_add", F.coalesce("_known", can_be_shared_key(F.col("key")) & F.lit(room))).drop("_known")


def learn_keys(walked: DataFrame, known: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """known with the eligible new keys of a walk, in byte order, while there is room.

    Keys are made distinct in parallel; only eligible keys beyond those, at most a few of each task by
    the limit that the window's filter pushes down, meet to be numbered."""
    keys = walked.filter("key is not null").select("key").distinct().filter(can_be_shared_key(F.col("key")))
    count = 0
    if known is not None:
        keys = keys.join(known.select("key"), "key", "left_anti")
        count = known.count()
    new = keys.orderBy("key").limit(max(0, capacity - count))
    new = new.select((F.row_number().over(Window.orderBy("key")) - 1 + count).alias("key_id"), "key")
    return new if known is None else known.select("key_id", "key").unionByName(new)


def encode_keys(rows: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """rows with key_id, -1 for a key that is not in the dictionary. Spark broadcasts a small dictionary."""
    names = keys.select("key_id", F.col("key").alias("_key"))
    return rows.join(names, F.col(key_col) == F.col("_key"), "left").drop("_key").withColumn("key_id", F.coalesce("key_id", F.lit(-1)))


def decode_keys(rows: DataFrame, keys: DataFrame, id_col: str = "key_id") -> DataFrame:
    """rows with decoded_key, NULL for an unknown number."""
    names = keys.select(F.col("key_id").alias("_id"), F.col("key").alias("decoded_key"))
    return rows.join(names, F.col(id_col) == F.col("_id"), "left").drop("_id")


def revert_keys(keys: DataFrame, count: int) -> DataFrame:
    return keys.filter(F.col("key_id") < count)


def load_keys(keys: DataFrame, state: DataFrame) -> DataFrame:
    """keys with those of a saved state that are numbered past them."""
    return keys.unionByName(state.filter(F.col("key_id") >= keys.count()).select("key_id", "key"))


class KeyTable:
    """A key dictionary in a folder of a file system that Spark reads: a table for each committed version, so readers
    never see a half-written one. A writer works on the version it began with; if another was committed since, its
    commit fails and it begins again."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        self.version, self.pending = 0, None
        self.refresh()

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version:08d}"

    def _committed(self, version: int) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(version)}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def refresh(self) -> bool:
        """Takes up what others have committed; whether there was anything new."""
        before = self.version
        while self._committed(self.version + 1):
            self.version += 1
        return self.version != before

    @property
    def keys(self) -> DataFrame:
        """The committed keys, or those of the open transaction."""
        if self.pending is not None:
            return self.pending
        if not self.version:
            return self.spark.createDataFrame([], "key_id int, key string")
        return self.spark.read.schema("key_id int, key string").parquet(self._at(self.version))

    @property
    def changed(self) -> bool:
        return self.pending is not None

    def add(self, walked: DataFrame) -> DataFrame:
        """The keys with new ones of a walk; they are numbered for good once committed."""
        self.pending = learn_keys(walked, self.keys, self.capacity).select(F.col("key_id").cast("int").alias("key_id"), "key")
        return self.pending

    def revert(self) -> None:
        """Gives up what was added since the last commit."""
        self.pending = None

    def commit(self) -> int:
        """Writes what was added as the next version, and returns its number. Fails if there is one already."""
        if self.pending is not None:
            self.pending.write.mode("errorifexists").parquet(self._at(self.version + 1))
            self.version, self.pending = self.version + 1, None
        return self.version


def string_ids(strings: DataFrame, col: str, ranges: int = RANGES) -> DataFrame:
    """Dense ids from 1 of distinct strings in byte order. Boundaries of as many ranges come from the strings of
    least hash, a fair sample whatever they begin with; ranges are numbered side by side, each from the count of
    those before it."""
    ordered = strings.select(F.col(col).alias("key")).dropna().distinct()
    sample = [r["key"] for r in ordered.orderBy(F.xxhash64("key"), "key").limit(ranges - 1).collect()]
    ends = F.array(*map(F.lit, sorted(sample, key=lambda s: s.encode("utf-8")))).cast("array<string>")
    ranged = ordered.withColumn("range", F.size(F.filter(ends, lambda e: e < F.col("key"))))
    before = ranged.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return ranged.withColumn("own", own).join(before.select("range", "before"), "range").select("key", (F.col("own") + F.col("before")).cast("long").alias("key_id"))


def ids_of(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """rows with key_id, 0 for a string that has none."""
    return rows.join(ids.select(F.col("key").alias("_key"), "key_id"), F.col(col) == F.col("_key"), "left").drop("_key").withColumn("key_id", F.coalesce("key_id", F.lit(0).cast("long")))


def strings_of(rows: DataFrame, ids: DataFrame, col: str = "key_id") -> DataFrame:
    """rows with key, NULL for an id that there is none of."""
    return rows.join(ids.select(F.col("key_id").alias("_id"), "key"), F.col(col) == F.col("_id"), "left").drop("_id")
