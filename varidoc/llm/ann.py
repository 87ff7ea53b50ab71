"""Approximate nearest neighbours by learned partitions of a neighbour graph.

On a bounded sample the exact neighbour graph is built and cut into balanced parts by recursive bisection: a set
of vectors is halved along its longest direction, then vectors whose neighbours lie across the cut change sides
in equal numbers. A small softmax classifier learns each vector's part and its neighbours' parts, with biases
that keep the parts it gives even. It places every row of the table in one part, and routes a query to its most
probable parts, where rows are scored exactly in double precision. The number of parts probed is the least that
finds `recall` of true neighbours, over sample rows that the classifier has not learned from, on both ends.

At most `sample_rows` rows are fitted on (those of smallest hash), a documented bound; every row is indexed.
Parts that lie next to each other in the tree of cuts share a group; a query is sent to the groups of its parts
only. A group's rows and its queries are cut into blocks by a hash, and each block of queries meets each block of
rows in one task, which multiplies a part's rows with the queries that probe it and with no others. So neither
a part that holds a third of the rows nor one that most queries probe makes a task large.

The measure is the inner product. Vectors that are null, zero, hold null or non-finite components, or differ in
length from the most common one take no part. A query's own row is left out, and no other: rows that repeat a
vec_id are candidates of their own, and each query row has its own list (query_row tells them apart). Ties go to
the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

SAMPLE_ROWS = 20_000
#: Rows of a part, about; sample rows of a part at least; and parts at most.
PART_ROWS, PART_SAMPLE, MAX_PARTS = 50, 15, 1024
#: Rows of neighbouring parts that are searched together, about, and rows and queries of a task.
GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS = 50_000, 50_000, 5_000
NEIGHBOURS = 20
RECALL = 0.94
#: One sample row in so many is not learned from, and judges recall.
JUDGES = 5


@dataclass(frozen=True)
class Router:
    """Weights of the classifier (last row: biases), and how many parts a query probes."""

    weights: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """For each row of x and each part whether it is probed."""
        z = self.logits(x)
        out = np.zeros(z.shape, dtype=bool)
        np.put_along_axis(out, np.argsort(-z, axis=1, kind="stable")[:, : self.probes], True, axis=1)
        return out


def _neighbours(x: np.ndarray, own: np.ndarray, k: int, block: int = 250) -> np.ndarray:
    """Exact neighbours by inner product of the rows own of x, in blocks; a vector is not its own neighbour."""
    out = np.empty((len(own), k), dtype=np.int64)
    for a in range(0, len(own), block):
        s = x[own[a : a + block]] @ x.T
        s[np.arange(len(s)), own[a : a + block]] = -np.inf
        out[a : a + block] = np.argpartition(s, len(x) - k, axis=1)[:, len(x) - k :]
    return out


def _halves(x: np.ndarray, start: np.ndarray, end: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Which half each vector is in, as equal as can be; few of the edges (start, end) run between halves."""
    across = x[rng.integers(len(x))]
    for _ in range(4):
        along = x @ across
        middle = np.median(along)
        above = along > middle
        if not above.any():
            break
        across = x[above].mean(axis=0) - x[~above].mean(axis=0)
    side = np.zeros(len(x), dtype=np.int64)
    side[np.argsort(x @ across, kind="stable")[len(x) // 2 :]] = 1
    start, end = np.concatenate([start, end]), np.concatenate([end, start])
    for _ in range(rounds):
        pull = np.bincount(start, weights=2.0 * side[end] - 1, minlength=len(x))  # more neighbours on side 1
        gain = np.where(side == 0, pull, -pull)
        over, back = (np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1))
        n = (min(len(over), len(back)) + 1) // 2
        if not n:
            break
        over, back = (at[np.argsort(-gain[at], kind="stable")[:n]] for at in (over, back))
        side[over], side[back] = 1, 0
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vector, numbered in the order of the tree of cuts; sizes differ by one or so. parts: a power of two."""
    rng = np.random.default_rng(7)
    part, n = np.zeros(len(x), dtype=np.int64), 1
    while n < parts:
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(n + 1))
        side, local = np.zeros(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
        for p in range(n):
            own = order[bounds[p] : bounds[p + 1]]
            local[own] = np.arange(len(own))
            inside = part[graph[own]] == p
            side[own] = _halves(x[own], np.repeat(np.arange(len(own)), inside.sum(axis=1)), local[graph[own][inside]], rng)
        part, n = part * 2 + side, n * 2
    return part


def _blocks(x: np.ndarray, rows: int = 1000) -> list[np.ndarray]:
    """x in blocks of rows, so that the driver holds no large table beside it."""
    return [x[a : a + rows] for a in range(0, len(x), rows)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 4, sharp: float = 10.0) -> np.ndarray:
    """Weights of a softmax classifier of part and neighbours' parts, begun at the parts' means, by Adam; then
    biases are moved until the parts that it gives to x are about even."""
    rng = np.random.default_rng(11)
    means = np.stack([np.bincount(part, weights=x[:, d], minlength=parts) for d in range(x.shape[1])])
    means /= np.maximum(np.linalg.norm(means, axis=0), 1e-12)
    scale = float(np.linalg.norm(x, axis=1).mean()) or 1.0
    w = np.concatenate([sharp * means / scale, np.zeros((1, parts))])
    z = np.column_stack([x, np.ones(len(x))])
    m, v, step, k = np.zeros_like(w), np.zeros_like(w), 0, graph.shape[1]
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 500)):
            step += 1
            off = _softmax(z[batch] @ w)
            np.subtract.at(off, (np.repeat(np.arange(len(batch)), k), part[graph[batch]].ravel()), 0.5 / k)
            off[np.arange(len(batch)), part[batch]] -= 0.5
            g = z[batch].T @ off / len(batch) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.02 / scale * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits, best = (x @ w[:-1]).astype(np.float32), None
    bias = w[-1].copy()
    for i in range(40):
        size = sum(np.bincount((z + bias.astype(np.float32)).argmax(axis=1), minlength=parts) for z in _blocks(logits))
        if best is None or size.max() < best[0]:
            best = size.max(), bias.copy()
        bias -= 0.3 / (1 + i / 10) * np.clip(np.log((size + 0.5) / (len(x) / parts)), -1, 1)
    w[-1] = best[1]
    return w


def fit(vectors: DataFrame, rows: int, *, sample_rows: int = SAMPLE_ROWS, k: int = NEIGHBOURS, recall: float = RECALL) -> Router | None:
    """A router from the sample; None if there is too little to divide."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id", "embedding").limit(sample_rows).select("embedding").toArrow().column(0)
    if len(sample) < 10 * PART_SAMPLE:
        return None
    x = _wide(sample)
    parts = 1 << max(1, int(np.log2(min(rows // PART_ROWS, len(x) // PART_SAMPLE, MAX_PARTS))))
    judge = np.arange(len(x)) % JUDGES == 0
    known, k = x[~judge], min(k, int((~judge).sum()) - 1)
    own = _neighbours(known, np.arange(len(known)), k)
    w = train(known, balanced_parts(known, own, parts), own, parts)
    router = Router(w, parts)
    placed = np.concatenate([*map(router.place, _blocks(x))])
    routes = np.argsort(-router.logits(x[judge]), axis=1, kind="stable")
    turn = np.empty_like(routes)  # when a judge comes to a part
    np.put_along_axis(turn, routes, np.broadcast_to(np.arange(parts), routes.shape), axis=1)
    # the k nearest of all rows are as near as so many of the sample
    near = _neighbours(x, np.flatnonzero(judge), max(1, -(-k * len(x) // max(rows, len(x)))))
    at = np.take_along_axis(turn, placed[near], axis=1)[judge[near]]  # of judges' neighbours that are judges too
    found = np.bincount(at, minlength=parts).cumsum() / max(1, len(at))
    wanted = min(1.0, recall + 2 * np.sqrt(recall * (1 - recall) / max(1, len(at))))
    return Router(w, int(np.argmax(found >= wanted)) + 1 if (found >= wanted).any() else parts)


def usable(col: Column) -> Column:
    x = F.coalesce(F.transform(col, lambda e: e.cast("double")), F.array().cast("array<double>"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(x, lambda e: e != 0), F.lit(False))


def _wide(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def tasks(asked: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked and index, both with group, vec_id and embedding, dealt out by (group, block, query_block): each query of a group
    meets each of its rows in just one of these tasks, which holds about BLOCK_ROWS rows and QUERY_ROWS queries."""
    count = lambda df, n, name: df.groupBy("group").agg(F.ceil(F.count("*") / n).cast("int").alias(name))  # noqa: E731  # a row for each group
    sizes = count(index, BLOCK_ROWS, "blocks").join(count(asked, QUERY_ROWS, "query_blocks"), "group")
    place = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda df, block, query_block: df.join(F.broadcast(sizes), "group").withColumn("block", block).withColumn("query_block", query_block).drop("blocks", "query_blocks")
    return dealt(asked, every("blocks"), place("query_blocks")), dealt(index, place("blocks"), every("query_blocks"))


class _Best:
    """The k best candidates of each of n queries so far; ties go to the smaller id, then to the smaller row."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.found.append((query, row, score))
        self.waiting += len(query)

    def settle(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, row, score = map(np.concatenate, zip(*self.found))
        order = np.lexsort((row, ids[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[query[last]] = score[last]
        self.found, self.waiting = [(query[keep], row[keep], score[keep])], 0
        return self.found[0]


def best_of(router: Router | None, queries: np.ndarray, own: np.ndarray, part: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows in the parts that each query probes, without row own[query] (-1:
    none). Rows are in the order of their parts. Only a part's rows and the queries that probe it are multiplied."""
    best = _Best(len(queries), k)
    # a product of matrices may round by its shape; so it only proposes rows, and these are scored one by one
    slack = 1e-10 * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max()
    probed = None if router is None else router.probed(queries)
    bounds = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
    for a, b in zip(bounds, bounds[1:]):
        asks = np.arange(len(queries)) if probed is None else np.flatnonzero(probed[:, part[a]])
        for lo in range(a, b, 500):
            hi = min(b, lo + 500)
            for some in np.array_split(asks, len(asks) // 2000 + 1):
                s = queries[some] @ x[lo:hi].T
                mine = np.flatnonzero((own[some] >= lo) & (own[some] < hi))
                s[mine, own[some[mine]] - lo] = -np.inf
                i, j = np.nonzero((s >= (best.least - slack)[some, None]) & (s > -np.inf))
                best.add(some[i], j + lo, (queries[some[i]] * x[j + lo]).sum(axis=1))
                if best.waiting > 200_000 + 4 * k * len(queries):
                    best.settle(ids)
    return best.settle(ids)


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: the k best rows found for each query row, itself excluded.

    vectors has vec_id and embedding, and what is_query reads."""
    spark = vectors.sparkSession
    good = vectors.withColumn(asks := fresh(vectors, "asks"), F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col(asks).alias("asks"))
    good = good.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    lengths = good.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    good = good.filter(F.size("embedding") == (lengths["length"] if lengths else 0))
    rows = lengths["count"] if lengths else 0
    router = fit(good, rows, sample_rows=sample_rows, recall=recall)
    known = spark.sparkContext.broadcast(router)
    # parts that are next to each other in the tree of cuts share a group
    per_group = max(1, -(-(router.parts if router else 1) * GROUP_ROWS // max(rows, 1)))

    def place(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.array(known.value.place(_wide(array)) if known.value and len(array) else np.zeros(len(array)), pa.int32())

    def groups_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            if not known.value or not len(array):
                yield pa.array([[0]] * len(array), pa.list_(pa.int32()))
                continue
            probed = known.value.probed(_wide(array))
            probed = np.pad(probed, ((0, 0), (0, -probed.shape[1] % per_group))).reshape(len(array), -1, per_group).any(axis=2)
            yield pa.array([np.flatnonzero(p) for p in probed], pa.list_(pa.int32()))

    index = good.select("vec_id", "embedding", "asks", F.monotonically_increasing_id().alias("row"), F.arrow_udf(place, "int")("embedding").alias("part"))
    index = written(index, "ann-index").withColumn("group", F.floor(F.col("part") / per_group).cast("int"))
    asked = index.filter("asks").withColumn("group", F.explode(F.arrow_udf(groups_of, "array<int>")("embedding")))
    asked, index = tasks(asked, index)

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "query_row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        candidates = candidates.sort_by([("part", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
        part, ids, row = (candidates.column(c).to_numpy() for c in ("part", "vec_id", "row"))
        query_row = queries.column("row").to_numpy()
        by_row = np.argsort(row)
        at = by_row[np.minimum(np.searchsorted(row, query_row, sorter=by_row), len(row) - 1)]
        own = np.where(row[at] == query_row, at, -1)
        q, c, score = best_of(known.value, _wide(queries.column("embedding")), own, part, _wide(candidates.column("embedding")), ids, k)
        return pa.table({"query_id": queries.column("vec_id").to_numpy()[q], "query_row": query_row[q], "vec_id": ids[c], "row": row[c], "score": score})

    keys = ["group", "block", "query_block"]
    wanted = [*keys, "vec_id", "embedding", "row"]
    # both sides come from one table, so the queries' columns get names of their own
    found = asked.select(*wanted).toDF(*wanted).groupBy(*keys).cogroup(
        index.select(*keys, "vec_id", "embedding", "part", "row").groupBy(*keys)).applyInArrow(search, "query_id long, query_row long, vec_id long, row long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0, recall=0.92)
