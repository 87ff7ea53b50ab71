"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a digest of their id and text and played in rounds. A play's virtual finish
time is the tokens its source has played by its end, divided by the source's target: the fluid schedule in
which all sources reach their targets at time 1. Plays in the order of finish times, cut at the total
budget, are the mix. With a play's time a fixed function of the row, the global order is a range partition
by time: a histogram finds the range where the budget runs out, ranges before it are whole, and only the
rows of that one narrow range are put in order.

Sizes are words (runs of characters other than space and tab to carriage return); null texts have none.
Sources are weighted 5, 2, 1 in turn by code point, null last; a target is at most `repeats` times its
source's size, and what that leaves is shared again by weight. Within a source every row with words has finish
times of its own, so plays are in order by time and source alone, and reruns agree however the input is
partitioned, for null and repeated ids too: only rows that agree in id, source and text are told apart by
chance. Rows without words are never taken; an empty table gives an empty mix. Only the id, source and text
are read. Sources, a small row each, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, buckets_for, slice_of, with_running_total

WEIGHTS = (5, 2, 1)
#: Ranges of virtual time in one histogram, and rows that are put in order at most at the cut.
RANGES, CUT_ROWS = 4096, 100_000


def targets(sizes: DataFrame, *, share: float, repeats: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, source_size): `share` of all tokens dealt by weight up to
    the caps. Sources fill up in the order of cap over weight, so a running total finds the water level."""
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("open"))
    # the water level is that of the first source whose cap is not reached; capped sources stand below it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.when(level.isNull() | (F.col("ratio") < level), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def plays(narrow: DataFrame, *, share: float, repeats: int) -> DataFrame:
    """narrow (doc_id, source, size, order, slice) with source_size, target and times: the finish times of
    the document's plays, one for each round."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, share=share, repeats=repeats).withColumnRenamed("source", "_source")
    timed = with_running_total(narrow, ["source"], "slice", ["order", "doc_id"], F.col("size"), "played")
    timed = timed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ends = F.array(*[(F.col("played") + F.col("source_size") * F.lit(r)) / F.col("target") for r in range(repeats)])
    return timed.withColumn("times", F.when(F.col("size") > 0, ends).otherwise(F.array().cast("array<double>")))


def cut_time(timed: DataFrame, budget: float) -> tuple[float, float, int]:
    """Where the budget runs out: (low, high, spent). Plays up to low are taken whole and spend so much, plays
    after high not at all. Between them are CUT_ROWS plays at most, or plays of one and the same time, of which
    a source has one in a round."""
    one = timed.select(F.explode("times").alias("time"), "size")
    low, high, spent = 0.0, timed.agg(F.max(F.array_max("times")).alias("t")).first()["t"] or 0.0, 0
    while True:
        width = (high - low) / RANGES
        at = F.least(F.floor((F.col("time") - F.lit(low)) / F.lit(width)), F.lit(RANGES - 1)) if width > 0 else F.lit(0)
        inside = one.filter((F.col("time") > low) & (F.col("time") <= high))
        sums = inside.groupBy(at.alias("at")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("time").alias("t")).collect()  # RANGES rows at most
        last, found = low, None
        for r in sorted(sums, key=lambda r: r["at"]):
            if spent + r["s"] > budget:
                found = r
                break
            spent, last = spent + r["s"], r["t"]
        if found is None:
            return high, high, spent
        if found["n"] <= CUT_ROWS or (last, found["t"]) == (low, high):
            return last, found["t"], spent
        low, high = last, found["t"]


def mix(docs: DataFrame, *, share: float = 1.5, repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: str | None = None, tie: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, plays (times the mix takes the document), and the column to
    keep as kept. tie (a number or text) is digested with id and text, to tell rows apart that agree in both."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    known = [F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))]
    order = F.md5(F.concat_ws(":", *known, *([] if tie is None else [tie.cast("string")]), F.lit(seed)))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order"), *([] if keep is None else [F.col(keep).alias("kept")]))
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.write(narrow, "mix-sizes")
    sliced = narrow.withColumn("slice", slice_of(F.col("order"), buckets_for(narrow.count())))
    timed = scratch.write(plays(sliced, share=share, repeats=repeats), "mix-times")
    scratch.drop(narrow)
    budget = timed.select("source", "target").distinct().agg(F.sum("target")).first()[0] or 0.0
    low, high, spent = cut_time(timed, budget)
    # The plays of the range where the budget runs out, in their order.
    edge = timed.select("source", "size", F.explode("times").alias("time")).filter((F.col("time") > low) & (F.col("time") <= high))
    queue = Window.partitionBy().orderBy("time", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ok = edge.withColumn("total", F.sum("size").over(queue)).filter(F.col("total") + F.lit(spent) <= F.lit(budget))
    place = lambda time: F.struct(time.alias("time"), F.col("source").isNull().alias("null"), F.coalesce("source", F.lit("")).alias("source"))
    last = ok.agg(F.max(place(F.col("time"))).alias("x")).first()["x"]
    fits = lambda t: t <= low
    if last is not None:  # every play up to the last one that fits, in the same order
        stop = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["null"]).alias("null"), F.lit(last["source"]).alias("source"))
        fits = lambda t: (t <= low) | (place(t) <= stop)
    n = F.size(F.filter("times", fits))
    return timed.select("doc_id", "source", "size", "source_size", "target", n.alias("plays"), *([] if keep is None else ["kept"]))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    got = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("plays")).alias("taken"))
