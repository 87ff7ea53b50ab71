"""Near-duplicate groups by HyperMinHash sketches, banding and exact verification.

A document's set holds 64-bit hashes of its distinct five-word shingles. One pass keeps, for each of 128
buckets of the hash range, the smallest hash as a 16-bit register: its leading zeros and the 10 bits after
the leading one. Documents of equal sets form one class with one representative, so copies cost nothing
further. Bands of four registers give candidates; a pair is dropped only if its collision-corrected
Jaccard estimate is more than 4.5 standard errors below the threshold, and every link is confirmed on full
sets. No bucket is expanded into pairs: first each member is compared with its bucket's leader, then, where
a bucket still holds several components, with its most central members, and only what is still apart after
that is searched, in blocks, for pairs between components. Pairs are
confirmed in rounds, the most similar first, and no longer once their ends have met in a component; no
candidate pair between different components is left unexamined. With 32 bands of four, a
pair at similarity 0.75 shares no band with probability 6e-6.

Documents without words have empty sets and are linked with nothing. Fewer than five words make one
shingle. Ties and repeated rows fall into one class. Null ids stay in their class, which takes the smallest
id that is not null. Texts are found by their sets, never by ids. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, Scratch, content, in_parts

WORDS = 5
REGISTERS, BAND, MANTISSA = 128, 4, 10
PERCENT = 75
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
#: Standard errors by which an estimate may miss the threshold: a pair at it is lost with probability 3e-6.
ERRORS = 4.5
#: Least hashes of a set that a task compares sets by; smaller sets are compared whole.
SAMPLE = 512
#: Characters of texts whose sets a task makes at once.
GROUP_CHARS = 1 << 19
#: Pairs whose sets a task holds at once.
PAIRS = 16
#: Members of a bucket that are all compared with each other at once.
SMALL = 6
#: Central members of a bucket that its others are compared with.
LEADERS = 3
#: Most similar candidates of a node that are confirmed in the first round.
TRIES = 2

_U = np.uint64
_sets = Memo()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in groups of about GROUP_CHARS characters; a longer one is alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def _word_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, end to end, and how many each has. A-Z is lower-cased; words are split at
    space and tab to return."""
    rows = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    count = np.array([*map(len, rows)], dtype=np.int64)
    # hashing a word again costs less than finding it in a memo
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(rows)), dtype=np.uint64, count=int(count.sum())), count


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has."""
    h, count = _word_rows(texts)
    start = np.cumsum(count) - count
    size = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    end = np.cumsum(size)
    all_, first = np.zeros(int(size.sum()), dtype=np.uint64), end - size
    with np.errstate(over="ignore"):
        if len(h) >= WORDS:
            s = np.full(len(h) - WORDS + 1, WORDS, dtype=np.uint64)
            for k in range(WORDS):
                s = _mixed(s * _U(0x9E3779B97F4A7C15) + h[k : k + len(s)])
        for n in range(1, WORDS):  # fewer words make one shingle
            at = np.flatnonzero(count == n)
            if len(at):
                one = np.full(len(at), n, dtype=np.uint64)
                for k in range(n):
                    one = _mixed(one * _U(0x9E3779B97F4A7C15) + h[start[at] + k])
                all_[first[at]] = one
    for i in np.flatnonzero(count >= WORDS).tolist():
        own = all_[first[i] : end[i]]
        own[:] = s[start[i] : start[i] + size[i]]
        own.sort()
    keep = np.ones(len(all_), dtype=bool)
    np.not_equal(all_[1:], all_[:-1], out=keep[1:])
    some = np.flatnonzero(size)
    keep[first[some]] = True
    if len(some):
        size[some] = np.add.reduceat(keep.astype(np.int64), first[some])
    return all_[keep], size


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return shingle_sets([text])[0]


def remembered_sets(texts: list[str]) -> list[np.ndarray]:
    """shingle_set of each text, for texts that come again soon."""
    _sets.tidy()
    got = {text: _sets.get(text) for text in set(texts)}
    for group in _groups([text for text, s in got.items() if s is None]):
        flat, sizes = shingle_sets(group)
        for text, s in zip(group, np.split(flat, np.cumsum(sizes)[:-1])):
            got[text] = _sets.add(text, s.copy(), s.nbytes + 2 * len(text) + 200)
    return [got[text] for text in texts]


def digests(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, as signed integers."""
    some = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((2, len(sizes)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for made, c in zip(out, (0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            if len(some):
                made[some] = np.add.reduceat(_mixed(flat ^ _U(c)), first)
    return out[0].view(np.int64), out[1].view(np.int64)


def register_rows(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sketches of sorted sets, a row each: for each bucket of the hash range its least hash, compressed; 0: empty."""
    shift = 64 - (REGISTERS.bit_length() - 1)
    place = np.repeat(np.arange(len(sizes)) * REGISTERS, sizes) + (flat >> _U(shift)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    low = flat[first] & _U((1 << shift) - 1)
    # the position of the leading one, exactly: by halves, since 64-bit floats would round
    high = np.frexp((low >> _U(28)).astype(np.float64))[1].astype(np.int64)
    small = np.frexp((low & _U((1 << 28) - 1)).astype(np.float64))[1].astype(np.int64)
    length = np.where(high > 0, high + 28, small)
    body = np.where(length > MANTISSA, low >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64), low << np.maximum(MANTISSA + 1 - length, 0).astype(np.uint64))
    out = np.zeros(len(sizes) * REGISTERS, dtype=np.uint16)
    out[place[first]] = ((shift - length + 1) << MANTISSA | (body.astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)
    return out.reshape(len(sizes), REGISTERS)


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set."""
    return register_rows(s, np.array([len(s)]))[0]


def expected_collisions(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Registers that two unrelated sets of these sizes share by chance."""
    i = np.arange(1, 58)
    hit = lambda n: np.exp(-n[:, None] / REGISTERS * 2.0**-i) - np.exp(-n[:, None] / REGISTERS * 2.0 ** (1 - i))
    return REGISTERS * (hit(np.asarray(n_a, float)) * hit(np.asarray(n_b, float))).sum(axis=1) * 2.0**-MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and which pairs may reach the threshold."""
    same = ((a == b) & (a != 0)).sum(axis=1) - expected_collisions(n_a, n_b)
    used = ((a != 0) | (b != 0)).sum(axis=1)
    j = PERCENT / 100
    possible = same >= j * used - ERRORS * np.sqrt(used * j * (1 - j)) - 1
    sized = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return same / np.maximum(used, 1), possible & sized


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def sketches(docs: DataFrame) -> DataFrame:
    """docs without the text, with n_shingles, node and twin (digests of the set), registers."""
    others = [c for c in docs.columns if c != "text"]
    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text").to_pylist()):
                flat, sizes = shingle_sets(group)
                node, twin = digests(flat, sizes)
                regs = [r.tobytes() if n else b"" for r, n in zip(register_rows(flat, sizes).astype("<u2"), sizes.tolist())]
                own = batch.slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([*map(own.column, others), pa.array(sizes), pa.array(node), pa.array(twin), pa.array(regs, pa.binary())],
                                                 [*others, "n_shingles", "node", "twin", "registers"])

    return docs.mapInArrow(in_parts(run), f"{types}n_shingles long, node long, twin long, registers binary")


def _texts(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node and one text of each of the sets (node, twin). A task gives out one text of a set at most, so
    copies, whatever their ids, come to a set's one text as often as there are tasks, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            at, node, twin, i = [], [], [], 0
            for group in _groups(batch.column("text").to_pylist()):
                for made in zip(*[d.tolist() for d in digests(*shingle_sets(group))]):
                    if made not in seen:
                        seen.add(made)
                        at.append(i)
                        node.append(made[0])
                        twin.append(made[1])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(twin, pa.int64()), batch.column("text").take(pa.array(at, pa.int64()))], ["node", "twin", "text"])

    firsts = docs.select("text").mapInArrow(in_parts(run), "node long, twin long, text string")
    return firsts.join(sets, ["node", "twin"]).groupBy("node", "twin").agg(F.first("text").alias("text")).select("node", "text")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, key, node) of every band that is not empty; a key is its four registers side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = _matrix(batch.column("registers")).view("<i8")
            row, band = np.nonzero(keys)
            node = np.asarray(batch.column("node").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int8)), pa.array(keys[row, band]), pa.array(node[row])], ["band", "key", "node"])

    return classes.select("node", "registers").mapInArrow(run, "band byte, key long, node long")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, j) of the pairs whose estimate may reach the threshold."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n_a, n_b = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("n_a", "n_b"))
            j, ok = estimate(_matrix(batch.column("r_a")), _matrix(batch.column("r_b")), n_a, n_b)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(j[ok])], ["a", "b", "j"])

    return both.mapInArrow(run, "a long, b long, j double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose full sets reach the threshold. Sets are made anew from whole texts."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            t_a, t_b = (batch.column(c).to_pylist() for c in ("t_a", "t_b"))
            for i in range(0, len(t_a), PAIRS):
                a, b = t_a[i : i + PAIRS], t_b[i : i + PAIRS]
                sets = remembered_sets([*a, *b])
                for x, y in zip(sets[: len(a)], sets[len(a) :]):
                    z = np.concatenate([x, y])
                    z.sort()
                    both = int(np.count_nonzero(z[1:] == z[:-1]))
                    keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(in_parts(run), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of edges (a, b): the least node reachable, by alternating stars:
    neighbours are hung on the least one, first the greater ones, then the others, until nothing moves."""
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dedup-edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        stars = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, now = now, scratch.write(stars, "dedup-stars")
        scratch.drop(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        seen = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _samples(texts: DataFrame) -> DataFrame:
    """node and the high halves of its SAMPLE least hashes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for group in _groups(batch.column("text").to_pylist()):
                flat, sizes = shingle_sets(group)
                made += [(x[:SAMPLE] >> _U(32)).astype("<u4").tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], ["node", "sample"])

    return texts.mapInArrow(in_parts(run), "node long, sample binary")


def sampled(own: np.ndarray, n: int, others: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which of the others may reach the threshold with a set, by samples: exactly where both sets are whole
    in their samples, else among the hashes that lie in the range of both."""
    if not others:
        return np.zeros(0, bool)
    everything = np.iinfo(np.uint32).max
    top = np.array([o[-1] if k > SAMPLE else everything for o, k in zip(others, sizes)], dtype=np.uint32)
    top = np.minimum(top, own[-1] if n > SAMPLE else everything)
    flat, lengths = np.concatenate(others), np.array([*map(len, others)])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = flat <= np.repeat(top, lengths)
    met = (own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat) & inside
    both = np.add.reduceat(met.astype(np.int64), starts)
    union = np.add.reduceat(inside.astype(np.int64), starts) + np.searchsorted(own, top, side="right") - both
    j = PERCENT / 100
    partial = (sizes > SAMPLE) | (n > SAMPLE)
    return both >= j * union - np.where(partial, ERRORS * np.sqrt(union * j * (1 - j)) + 1, 1e-9)


def _resolve(pairs: DataFrame, texts: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """Confirms pairs (a, b, j) until none that is left lies between two components: in each round the most
    similar few of every node that still lie between components, four times as many each round. Returns the
    labels (node, component) of all nodes that have a link."""
    tries, left, waiting = TRIES, pairs, None
    while True:
        if labels is not None:
            side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
            left = left.join(side("a"), "a", "left").join(side("b"), "b", "left")
            left = left.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "j")
        order = Window.partitionBy("a").orderBy(F.desc("j"), "b")
        before, waiting = waiting, scratch.write(left.withColumn("i", F.row_number().over(order)), "dedup-open")
        scratch.drop(before)
        if waiting.isEmpty():
            return labels
        links = scratch.write(_confirmed(waiting.filter(F.col("i") <= tries), texts), "dedup-links")
        if not links.isEmpty():
            before, labels = labels, _joined(links, labels, scratch)
            scratch.drop(before)
        scratch.drop(links)
        left = waiting.filter(F.col("i") > tries).select("a", "b", "j")
        tries *= 4


def _joined(links: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """labels with new links: components of the graph whose nodes are the components so far."""
    if labels is None:
        return scratch.write(components(links, scratch), "dedup-labels")
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    moved = components(joined.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), scratch)
    moved = scratch.write(moved.select(F.col("node").alias("old"), F.col("component").alias("new")), "dedup-moved")
    kept = labels.join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = moved.join(labels.select("component").distinct(), F.col("old") == F.col("component"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    out = scratch.write(kept.unionByName(fresh), "dedup-labels")
    scratch.drop(moved)
    return out


def _undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (band, key, node, component, n, block) of buckets that hold several components."""
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    mixed = mixed.select("band", "key", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = named.select("band", "key", "node", "component").join(mixed, ["band", "key"])
    return rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _central(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of a bucket of several components with its most central ones: copies of
    a text differ less from it than from each other, so it shares most registers with all others. Blocks
    propose members, a bucket keeps the best LEADERS of them. In a bucket of SMALL members each is compared
    with each. Either way pairs grow with members only."""
    every = _undecided(members, labels)
    few = every.filter(F.col("n") <= SMALL)
    rows = every.filter(F.col("n") > SMALL)
    mates = few.select("band", "key", F.col("node").alias("a"), F.col("component").alias("c_a")).join(few.select("band", "key", F.col("node").alias("b"), F.col("component").alias("c_b")), ["band", "key"])
    mates = mates.filter("a < b and c_a <> c_b").select("a", "b")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        regs = _matrix(table.column("registers"))
        if len(regs) <= 128:  # registers shared with all members, summed
            score = ((regs[:, None] == regs[None]) & (regs[:, None] != 0)).sum(axis=(1, 2))
        else:
            score = sum(np.where(c != 0, np.bincount(c)[c], 0) for c in regs.T)
        at = np.argsort(-score, kind="stable")[:LEADERS]
        return table.select(["band", "key", "node"]).take(pa.array(at)).append_column("score", pa.array(score[at]))

    own = rows.select("band", "key", "block", "node").join(classes.select("node", "registers"), "node")
    proposed = own.groupBy("band", "key", "block").applyInArrow(run, "band byte, key long, node long, score long")
    best = Window.partitionBy("band", "key").orderBy(F.desc("score"), "node")
    leaders = proposed.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= LEADERS).select("band", "key", F.col("node").alias("b"))
    return rows.select("band", "key", F.col("node").alias("a")).join(leaders, ["band", "key"]).filter("a <> b").select("a", "b").unionByName(mates).distinct()


def _between(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, j) of members of one bucket but different components.

    Buckets of one component need no work. A bucket of many members is cut into blocks; every two blocks
    meet in one task, which compares registers, then samples of the sets, and returns pairs that are links or
    very nearly so, each pair in the first band that it shares."""
    rows = _undecided(members, labels).filter(F.col("n") > SMALL).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    rows = rows.select("band", "key", "p", "q", "block", "node", "component").join(classes.select("node", "n_shingles", "registers"), "node").join(_samples(texts), "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_shingles", "ascending"), ("node", "ascending")])
        regs = _matrix(table.column("registers"))
        keys = regs.view("<i8")
        node, comp, n, block = (np.asarray(table.column(c).to_numpy()) for c in ("node", "component", "n_shingles", "block"))
        samples = [np.frombuffer(x, dtype="<u4") for x in table.column("sample").to_pylist()]
        p, q, band = (table.column(c)[0].as_py() for c in ("p", "q", "band"))
        a, b, js = [node[:0]], [node[:0]], [np.zeros(0)]
        for i in range(len(node)):
            end = np.searchsorted(n, n[i] * 100 // PERCENT, side="right")
            at = np.flatnonzero((comp[i + 1 : end] != comp[i]) & ((p == q) | (block[i + 1 : end] != block[i]))) + i + 1
            for part in np.array_split(at, len(at) // 4096 + 1):
                # a pair that shares an earlier band is another task's
                part = part[~((keys[part, :band] == keys[i, :band]) & (keys[i, :band] != 0)).any(axis=1)]
                j, ok = estimate(np.broadcast_to(regs[i], (len(part), REGISTERS)), regs[part], np.full(len(part), n[i]), n[part])
                part, j = part[ok], j[ok]
                ok = sampled(samples[i], n[i], [samples[x] for x in part], n[part])
                b.append(node[part[ok]])
                a.append(np.full(int(ok.sum()), node[i]))
                js.append(j[ok])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "j": np.concatenate(js)})

    return rows.groupBy("band", "key", "p", "q").applyInArrow(run, "a long, b long, j double")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs (doc_id, text and what else is there), and node, twin, doc_id (the least),
    component of every set that is not empty."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sketch = scratch.write(sketches(docs), "dedup-sketches")
    classes = sketch.filter("n_shingles > 0").groupBy("node", "twin").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = scratch.write(classes, "dedup-classes")
    bands = _bands(classes)
    # A bucket's leader is picked by a hash of band and node, so leaders differ between bands.
    leader = F.min(F.struct(F.xxhash64("band", "node").alias("h"), F.col("node").alias("leader")))["leader"]
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("n"), leader.alias("leader")).filter("n > 1").select("band", "key", "leader")
    members = scratch.write(bands.join(shared, ["band", "key"]), "dedup-members")

    sets = members.select("node").distinct().join(classes.select("node", "twin"), "node")
    texts = scratch.write(_texts(docs, sets), "dedup-texts")

    pairs = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    stars = scratch.write(_estimated(pairs, classes), "dedup-stars")
    labels = _resolve(stars, texts, None, scratch)
    named = members.select("band", "key", "node")
    none = spark.createDataFrame([], "node long, component long")
    way = lambda df: df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    untried = lambda df, done: df.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(done, ["lo", "hi"], "left_anti").drop("lo", "hi")
    done = way(stars)
    central = untried(_central(named, none if labels is None else labels, classes), done)  # a: member, b: leader
    central = scratch.write(_estimated(central, classes), "dedup-central")
    labels = _resolve(central, texts, labels, scratch)
    # Pairs with leaders are settled; what may still join components are pairs of other members.
    rest = scratch.write(untried(_between(named, none if labels is None else labels, classes, texts), done.unionByName(way(central))), "dedup-rest")
    scratch.drop(members, stars, central)
    labels = _resolve(rest, texts, labels, scratch)
    scratch.drop(rest, texts)
    if labels is None:
        labels = none

    return sketch, classes.select("node", "twin", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the group), kept, for every row of docs."""
    sketch, grouped = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = grouped.join(least, "component").select("node", "twin", "component_id")
    out = sketch.select("doc_id", "n_shingles", "node", "twin").join(grouped, ["node", "twin"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def survivors(docs: DataFrame, row_col: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_col of one row of each group, and of every row without words. row_col tells the rows of docs apart.

    Of a group the row of least id stays, null last; of equal ids that of the least set digest, then of the
    least hash of its columns, so that row_col decides between equal rows only."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), content(docs, row_col).alias("tie"), F.col(row_col).alias("row"))
    sketch, grouped = _grouped(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "twin", "tie", "row")).alias("best")
    of_sets = sketch.filter("n_shingles > 0").groupBy("node", "twin").agg(best)
    of_groups = of_sets.join(grouped.select("node", "twin", "component"), ["node", "twin"]).groupBy("component").agg(F.min("best").alias("best"))
    return of_groups.select(F.col("best.row").alias(row_col)).unionByName(sketch.filter("n_shingles = 0").select(F.col("row").alias(row_col)))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
