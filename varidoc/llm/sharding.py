"""Sharding by a k-d tree over metadata of the texts.

Starting from one leaf, a leaf is split at the weighted median of its widest dimension until leaves hold
the target bytes. All leaves of a level are split together: one pass finds each leaf's widest dimension,
and the medians are found by histograms of 2^14 cells, each pass looking 14 bits deeper into the one cell
that holds the median. The cell is chosen where the histogram is; a row for each leaf reaches the driver.

Dimensions are numbers made from the text, scaled to their range; null is the least value. Rows are in order
of coordinate, then of the text's checksum, then of a digest of id and text: equal texts have equal coordinates
and stay together whatever their other columns, unless a group is too large for shards of near equal size; then
it is cut like anything else. Rows that agree in id and text are cut by their place in the input.

Null and empty texts weigh one byte, and equal rows are separate rows. An empty table gives no rows. Null and
repeated ids are told apart by text. Only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, slice_of, with_running_total

BITS = 14
COORDINATE_BITS, CRC_BITS = 24, 32
#: Bits of a row's place in a group: of the digest of its id and text, and of its place in the input.
DIGEST_BITS, SALT_BITS = 42, 14
#: Both keys have as many bits, a multiple of BITS.
KEY_BITS = COORDINATE_BITS + CRC_BITS
#: Miss of a median, in target bytes of a leaf: always allowed, and allowed to keep equal texts together.
MISS, GROUP_MISS = 0.002, 0.02
#: Leaves whose cuts are broadcast at most, a small row each; more are joined as Spark sees fit.
BROADCAST_LEAVES = 100_000
_EVERYTHING = (1 << KEY_BITS) - 1


def text_dimensions(text: Column) -> dict[str, Column]:
    """Length, script, word length, lines and figures of a text."""
    n, chars = F.octet_length(text), F.greatest(F.length(text), F.lit(1))
    spaces = F.length(text) - F.length(F.translate(text, " ", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", ""))
    figures = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return {"bytes": F.log2(n + 1), "script": n / chars, "word_chars": F.log2(chars / (spaces + 1)), "lines": F.log2(lines + 1), "figures": figures / chars}


def _scaled(df: DataFrame, dims: dict[str, str]) -> list[Column]:
    """The dimensions (columns by name) as whole numbers of COORDINATE_BITS bits over each one's range."""
    ends = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(n) for n, c in dims.items()]).first()
    out = []
    for n, c in dims.items():
        a, b = ends[n]["a"], ends[n]["b"]
        span = (b - a) if a is not None and b is not None and b > a else 1.0
        x = (F.col(c) - F.lit(a or 0.0)) / F.lit(span) * F.lit(float((1 << COORDINATE_BITS) - 1))
        out.append(F.coalesce(F.floor(x), F.lit(0)).cast("long"))
    return out


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_LEAVES else table


def _key(dim: str = "dim") -> Column:
    """A row's place along a dimension: its coordinate, then its text's checksum."""
    return F.shiftleft(F.element_at("at", F.col(dim) + 1), CRC_BITS).bitwiseOR(F.col("text_crc32"))


def _medians(rows: DataFrame, goals: dict[int, tuple[int, float]], leaf_bytes: float) -> list[tuple[int, int, int, int]]:
    """For each node (dimension, bytes wanted on the left): (node, dimension, key, row key); a row goes right
    if its (key, row key) is greater."""
    spark = rows.sparkSession
    cuts: list[tuple[int, int, int, int]] = []
    # a node's state: prefix already fixed, bits of it, bytes before it; first in key, then in row key
    state = {n: (0, 0, 0, None) for n in goals}
    while state:
        table = _small(spark, [(n, *goals[n], *s) for n, s in state.items()], "node int, dim int, goal double, prefix long, bits int, before long, fixed long")
        here = rows.select("node", "at", "text_crc32", "row_key", "size").join(table, "node").withColumn("key", _key())
        here = here.filter(F.col("fixed").isNull() | (F.col("key") == F.col("fixed"))).withColumn("value", F.when(F.col("fixed").isNull(), F.col("key")).otherwise(F.col("row_key")))
        here = here.filter(F.expr(f"shiftright(value, {KEY_BITS} - bits) = prefix"))
        cell = F.expr(f"shiftright(value, {KEY_BITS - BITS} - bits) & {(1 << BITS) - 1}")
        sums = here.groupBy("node", "goal", "before", cell.alias("cell")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("node").orderBy("cell"))
        over = sums.withColumn("upto", F.col("before") + upto).filter("upto > goal").groupBy("node").agg(F.min(F.struct("cell", "size", "upto")).alias("x"))
        found = {r["node"]: r["x"] for r in over.collect()}  # a row for each node at most
        for n, (prefix, bits, _, fixed) in [*state.items()]:
            dim, goal = goals[n]
            x = found.get(n)
            if x is None:  # nothing goes right
                cuts.append((n, dim, _EVERYTHING, _EVERYTHING))
                del state[n]
                continue
            lower, width, spent = prefix << BITS | x["cell"], KEY_BITS - bits - BITS, x["upto"] - x["size"]
            sure = fixed is not None or width == 0  # at one text, or at one row of it
            for miss, end in ((goal - spent, (lower << width) - 1), (x["upto"] - goal, ((lower + 1) << width) - 1)):
                if miss <= MISS * leaf_bytes or width == 0 and miss <= (leaf_bytes if fixed is not None else GROUP_MISS * leaf_bytes):
                    cuts.append((n, dim, end, _EVERYTHING) if fixed is None else (n, dim, fixed, end))
                    del state[n]
                    break
            else:
                if width:
                    state[n] = (lower, bits + BITS, spent, fixed)
                elif sure and fixed is None:  # a large group of equal texts: cut it by row
                    state[n] = (0, 0, spent, lower)
                else:  # one row that is larger than a leaf
                    cuts.append((n, dim, fixed, ((lower + 1) << width) - 1))
                    del state[n]
    return cuts


def kd_shards(docs: DataFrame, dims: dict[str, Column], *, target_bytes: int | None = None, leaves: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Leaves: as given, or so many that each holds target_bytes. Equal
    texts stay together if dims are functions of the text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text).cast("string")))
    own = {n: f"d{i}" for i, n in enumerate(dims)}
    read = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       digest.alias("digest"), *[c.cast("double").alias(own[n]) for n, c in dims.items()])
    read = scratch.write(read.withColumn("salt", F.monotonically_increasing_id()), "shard-rows")
    head = F.shiftright(F.conv(F.substring("digest", 1, 11), 16, 10).cast("long"), 44 - DIGEST_BITS)
    row_key = F.shiftleft(head, SALT_BITS).bitwiseOR(F.pmod(F.xxhash64("salt"), F.lit(1 << SALT_BITS)))
    rows = read.select("doc_id", "size", "text_crc32", "digest", "salt", F.array(*_scaled(read, own)).alias("at"), row_key.alias("row_key"), F.lit(0).alias("node"))
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    if leaves is None:
        leaves = max(1, round((total or 0) / target_bytes)) if target_bytes else 1
    leaf_bytes = (total or 0) / leaves
    open_nodes, ready = {0: (0, leaves)}, {}  # node: (first leaf, leaves below it); node: leaf
    top = 0
    while n_rows:
        ready |= {n: first for n, (first, k) in open_nodes.items() if k == 1}
        open_nodes = {n: x for n, x in open_nodes.items() if x[1] > 1}
        if not open_nodes:
            break
        spans = F.array(*[F.max(F.col("at")[i]) - F.min(F.col("at")[i]) for i in range(len(dims))])
        wide = rows.join(_small(spark, [(n,) for n in open_nodes], "node int"), "node", "left_semi").groupBy("node").agg(F.sum("size").alias("s"), spans.alias("spans"))
        goals = {r["node"]: (r["spans"].index(max(r["spans"])), r["s"] * (open_nodes[r["node"]][1] // 2) / open_nodes[r["node"]][1]) for r in wide.collect()}
        cuts = _medians(rows, goals, leaf_bytes)
        children = [(*c, top + 1 + 2 * i) for i, c in enumerate(cuts)]
        cut = rows.join(_small(spark, children, "node int, dim int, cut_key long, cut_row long, child int"), "node", "left")
        right = (_key() > F.col("cut_key")) | ((_key() == F.col("cut_key")) & (F.col("row_key") > F.col("cut_row")))
        node = F.when(F.col("child").isNull(), F.col("node")).when(right, F.col("child") + 1).otherwise(F.col("child"))
        before, rows = rows, scratch.write(cut.select("doc_id", "size", "text_crc32", "digest", "salt", "at", "row_key", node.alias("node")), "shard-level")
        scratch.drop(before if before is not read else None)
        below = {}
        for n, *_, child in children:
            first, k = open_nodes[n]
            below[child], below[child + 1] = (first, k // 2), (first + k // 2, k - k // 2)
        open_nodes, top = below, top + 2 * len(children)
    leaf = _small(spark, [*(ready or {0: 0}).items()], "node int, shard int")
    out = rows.join(leaf, "node").select("doc_id", "size", "text_crc32", "digest", "salt", "shard", slice_of(F.col("digest"), buckets_for(n_rows)).alias("slice"))
    out = with_running_total(out, ["shard"], "slice", ["digest", "doc_id", "text_crc32", "salt"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = kd_shards(docs, text_dimensions(F.coalesce(F.col("text"), F.lit(""))), leaves=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
