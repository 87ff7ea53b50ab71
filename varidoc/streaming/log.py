"""Streams of newline-delimited documents, and a keyed store that follows a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType

#: Parts of a followed store; a batch rewrites those that its keys fall into.
BUCKETS = 64


def read_stream(spark: SparkSession, path: str, column: str = "body") -> DataFrame:
    """Documents of the files that arrive in a folder."""
    return spark.readStream.option("singleVariantColumn", column).json(path)


def newest(*logs: DataFrame) -> DataFrame:
    """key, version and value of the newest version of each key of some logs (key, version, value); a removal is
    a row of value NULL, which stays, so that an older version that comes later does not bring its key back. Of
    equal versions the earlier log's stays."""
    rows = None
    for i, one in enumerate(logs):
        one = one.select("key", "version", "value", F.lit(-i).alias("_turn"))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy("key").agg(F.max_by(F.struct("version", "value"), F.struct("version", "_turn")).alias("last"))
    return last.select("key", "last.version", "last.value")


def state(store: DataFrame) -> DataFrame:
    """key and value of what a followed store holds."""
    return store.filter("value is not null").select("key", "value")


def follow(changes: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies each batch of changes (key, version, value) to a store (the same columns): the newest change of a key
    wins, whichever batch it comes in. save gets the new store and the batch's number; a repeated batch changes nothing."""
    def apply(batch: DataFrame, number: int) -> None:
        save(newest(load(), batch), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_table(changes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """follow, for a store kept as Parquet under path/store in buckets of keys: a batch reads and rewrites only the
    buckets that its keys fall into. The new buckets are written aside first, since they are made of the old."""
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
        new = newest(batch).withColumn("bucket", bucket)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        old = read_table(spark, path, batch).filter(F.col("bucket").isin(touched))
        aside = f"{path}/batch-{number}"
        newest(old, new).withColumn("bucket", bucket).write.mode("overwrite").parquet(aside)
        made = spark.read.parquet(aside).repartition("bucket")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/store")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows (key, version, value, bucket) of a followed table, whose first three columns are like those of like."""
    schema = like.select("key", "version", "value").schema.add("bucket", IntegerType())
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/store")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/store")
