"""Packing token sequences by non-negative least squares over length histograms.

Documents are cut into whole windows and a remainder. Remainder lengths fall into bins; every
combination of at most `depth` bins that fills a window exactly is a column of a matrix, and
non-negative least squares finds how often to repeat each so that together they use up the histogram.
Repeat counts are rounded down, and the residual histogram is packed greedily, longest first. A share of the
documents, picked by digest, is a pool kept out of the plan: its tokens are poured, in order, into the room
that rounding lengths up left at the ends of planned sequences, then into new ones. Only pooled documents
are cut elsewhere than at a multiple of the window, so only their ids need storing and moving.

The histogram and the plan have a fixed size; ranks within a bin, positions in the poured stream and
sequence numbers are bucketed prefix sums, so no task holds a bin, a source or the stream. Null texts
count as empty; an empty text is its end token alone; equal rows are packed once each; empty tables
give no pieces. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, Memo, buckets_for, in_parts, slice_of, with_running_total, written
from .token_counts import chunks_of, settled, tokenizer_path


#: A full stop or comma behind a letter and before white space, which the tokenizer takes as a word of its own. The
#: stop is looked for first: a pattern that begins by looking back is tried at every character.
_STOP = re.compile("[.,](?<=[a-zß-öø-ÿāăąćčďđēėęěğģīįķļľłńņňōőœŕřśşšťţūůűųźżžа-яё][.,])(?=[ \n])")
#: Bytes that a generation of a worker's memo of chunks may take.
MEMO_BYTES = 40_000_000


class Encoder:
    """Ids of whole texts. White space parts the tokenizer's words, so a text's ids are its chunks' ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark gives each core a worker; the library's own threads would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        suffix = spec["model"].get("end_of_word_suffix")
        #: Whether an id ends a word, where the vocabulary says so.
        self.ends = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix) for i in range(self.library.get_vocab_size())])
        #: The library without the steps that leave words of small letters as they are.
        self.small = Tokenizer.from_file(path)
        self.small.normalizer = None
        self.small.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo = Memo(MEMO_BYTES, lasting=True)
        self.sure: set[str] = set()

    def encode_each(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: as one text, where the ends of words can be told in its ids."""
        text = " ".join(words)
        plain = text.isascii() or unicodedata.is_normalized("NFC", text)
        library = self.small if plain and text == text.lower() else self.library
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self.encode_each(words)
        raw, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def sure_classes(self, word: str) -> bool:
        """Whether the tokenizer's classes of all characters are known."""
        if not self.sure.issuperset(word):
            if not all(map(settled, word)):
                return False
            self.sure.update(word)
        return True

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of chunks."""
        words, others = [], []
        for c in chunks:
            (words if c.isalpha() and (c.isascii() or self.sure_classes(c)) else others).append(c)
        for made, ids in ((words, self.encode_words(words) if words else []), (others, self.encode_each(others) if others else [])):
            for c, i in zip(made, ids):
                self.memo.add(c, i, len(c) + len(i) + 150)

    def ids(self, text: str, last: bytes) -> np.ndarray:
        if "<|" not in text and "\u03a3" not in text and "\u0130" not in text:
            text = _STOP.sub(r" \g<0>", text.lower())  # as the tokenizer does; fewer distinct chunks
        chunks = chunks_of(text)
        self.memo.tidy()
        found = [*map(self.memo.known.get, chunks)]
        lost = [at for at, ids in enumerate(found) if ids is None]
        if lost:
            new = self.memo.missing({chunks[at] for at in lost}, keep=True)
            if new:
                self.learn(new)
            known = self.memo.known
            for at in lost:
                found[at] = known[chunks[at]]
        found.append(last)
        return np.frombuffer(b"".join(found), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lengths(docs: DataFrame, window: int, end_id: int, path: str) -> DataFrame:
    """A row for each document: its token count, the checksums of its windows and remainder, and for
    documents of the pool the ids of the remainder."""
    last = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n, full, rest, kept = [], [], [], []
            for text, pooled in zip(batch.column("text").to_pylist(), batch.column("pooled").to_pylist()):
                ids = enc.ids(text, last)
                k = len(ids) // window
                n.append(len(ids))
                full.append([zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(k)])
                rest.append(zlib.crc32(ids[k * window :].tobytes()))
                kept.append(ids[k * window :].tobytes() if pooled else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("order"), batch.column("pooled"), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "order", "pooled", "doc_tokens", "window_crcs", "rest_crc", "rest_ids"])

    return docs.mapInArrow(in_parts(run), f"doc_id {id_type}, order string, pooled boolean, doc_tokens long, window_crcs array<long>, rest_crc long, rest_ids binary")


@lru_cache(4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """Every multiset of at most depth bin sizes 1..bins that adds up to bins, as columns of counts."""
    found: list[list[int]] = []

    def extend(parts: list[int], room: int, most: int) -> None:
        if room == 0:
            found.append(parts)
        elif len(parts) < depth:
            least = -(-room // (depth - len(parts)))
            for p in range(min(room, most), least - 1, -1):
                extend([*parts, p], room - p, p)

    extend([], bins, bins)
    a = np.zeros((bins, len(found)))
    for j, parts in enumerate(found):
        np.add.at(a[:, j], np.array(parts) - 1, 1)
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by an active set: free the column of steepest descent, solve on the
    free columns, and step back to the boundary where a free one would turn negative."""
    x = np.zeros(a.shape[1])
    free: list[int] = []
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).sum())):
            break
        free.append(j)
        while True:
            z = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[free] = z
                break
            now = x[free]
            bad = z <= 0
            step = float(np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300)))
            now = now + step * (z - now)
            x[:] = 0
            x[free] = now
            free = [f for f, v in zip(free, now) if v > 1e-12]
            if not free:
                break
    return x


def plan(counts: np.ndarray, bins: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations (one per row, counts by bin) and how often each is repeated; they seat every document.

    Least squares first, rounded down; then the residual histogram greedily: each sequence takes the
    longest that still fits, and is repeated as often as the residual allows."""
    a = combinations(bins, depth)
    weight = np.arange(1, bins + 1) / bins
    x = nnls(a * weight[:, None], counts * weight)
    used = np.flatnonzero(x >= 1)
    repeat, a = np.floor(x[used] + 1e-9), a[:, used]
    for b in range(bins):  # never more slots of a bin than it has documents
        slots = a[b] @ repeat
        if slots > counts[b]:
            over = a[b] > 0
            repeat[over] = np.floor(repeat[over] * counts[b] / slots)
    rows, times = [*a.T.astype(int)], [*repeat.astype(int)]
    left = (counts - a @ repeat).astype(int)
    while left.any():
        one, room = np.zeros(bins, int), bins
        for b in np.flatnonzero(left)[::-1]:
            one[b] = min(left[b], room // (b + 1))
            room -= one[b] * (b + 1)
        n = int(min(left[one > 0] // one[one > 0]))
        rows.append(one)
        times.append(n)
        left -= n * one
    keep = np.array(times) > 0
    return np.array(rows)[keep], np.array(times)[keep]


def pack(docs: DataFrame, *, window: int = 4096, bins: int = 64, depth: int = 6, pool: float = 0.12, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, kind
    (window, planned, poured). Every token lies in exactly one piece; sequences have window tokens at most."""
    path = path or tokenizer_path()
    unit = window // bins
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text).cast("string")))
    docs = docs.select(F.col(id_col).alias("doc_id"), order.alias("order"), text.alias("text"))
    # the pool is a share of the digests' range; it does not depend on lengths, so one pass is enough
    docs = docs.select("doc_id", "order", (slice_of(F.reverse("order"), 1 << 20) < int(pool * (1 << 20))).alias("pooled"), "text")
    rows = written(_lengths(docs, window, end_id, path), "pack-lengths")
    rest = (F.col("doc_tokens") % window)
    rows = rows.withColumn("rest", rest).withColumn("bin", F.ceil(F.col("rest") / unit).cast("int"))
    nb = buckets_for(rows.count())
    rows = rows.withColumn("slice", slice_of(F.col("order"), nb))

    hist = rows.filter("rest > 0 and not pooled").groupBy("bin").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(bins)
    for r in hist:
        counts[r["bin"] - 1] = r["n"]
    combos, repeat = plan(counts, bins, depth) if hist else (np.zeros((0, bins), int), np.zeros(0, int))
    first = np.concatenate([[0], np.cumsum(repeat)])  # sequence number of each combination's first repeat
    n_planned = int(first[-1])
    per = combos * repeat[:, None]
    taken = np.concatenate([np.zeros((1, bins), int), np.cumsum(per, axis=0)])  # slots of a bin before each combination
    base = np.concatenate([np.zeros((len(combos), 1), int), np.cumsum(combos[:, ::-1], axis=1)[:, :-1]], axis=1)[:, ::-1]

    @F.pandas_udf("sequence_id long, slot int")
    def seat(bin_: pd.Series, rank: pd.Series) -> pd.DataFrame:
        """The slot of the rank-th document of a bin."""
        b, r = bin_.to_numpy() - 1, rank.to_numpy() - 1
        seq, slot = np.zeros(len(b), int), np.zeros(len(b), int)
        for one in np.unique(b):
            at = b == one
            s = np.searchsorted(taken[:, one], r[at], side="right") - 1
            rel, each = r[at] - taken[s, one], combos[s, one]
            seq[at] = first[s] + rel // each
            slot[at] = base[s, one] + rel % each
        return pd.DataFrame({"sequence_id": seq, "slot": slot.astype("int32")})

    ordered = ["order", "doc_id"]
    narrow = rows.filter("rest > 0 and not pooled").select("doc_id", "order", "slice", "bin", "doc_tokens", "rest", "rest_crc")
    seated = with_running_total(narrow, ["bin"], "slice", ordered, F.lit(1), "rank").withColumn("seat", seat("bin", "rank"))
    w = Window.partitionBy("sequence_id").orderBy("slot")
    seated = seated.select("doc_id", "doc_tokens", "rest_crc", "rest", "seat.sequence_id", "seat.slot").withColumn("offset", F.sum("rest").over(w) - F.col("rest"))
    planned = written(seated.select("doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"),
                                    F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.lit("planned").alias("kind")), "pack-planned")

    # Room left in planned sequences, then new sequences: one line of capacity that the pool is poured along.
    used = planned.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    stream = rows.filter("rest > 0 and pooled").select("doc_id", "order", "slice", "doc_tokens", "rest", "rest_ids")
    totals = stream.agg(F.sum("rest")).first()[0] or 0
    room = n_planned * window - (planned.agg(F.sum("length")).first()[0] or 0)
    n_new = max(0, -(-(totals - room) // window))
    new = spark.range(n_planned, n_planned + n_new).select(F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("used"))
    gaps = used.unionByName(new).withColumn("room", F.lit(window) - F.col("used")).withColumn("part", F.floor(F.col("sequence_id") / BUCKET_ROWS))
    gaps = with_running_total(gaps.filter("room > 0"), [], "part", ["sequence_id"], F.col("room"), "to")
    gaps = gaps.select("sequence_id", "used", (F.col("to") - F.col("room")).alias("g0"), F.col("to").alias("g1"))
    poured = with_running_total(stream, [], "slice", ordered, F.col("rest"), "to")
    poured = poured.select("doc_id", "doc_tokens", "rest", (F.col("to") - F.col("rest")).alias("s0"), F.col("to").alias("s1"), "rest_ids")

    def cells(a: str, b: str):
        return F.explode(F.sequence(F.floor(F.col(a) / window), F.floor((F.col(b) - 1) / window)))

    met = poured.withColumn("cell", cells("s0", "s1")).join(gaps.withColumn("cell", cells("g0", "g1")), "cell")
    lo, hi = F.greatest("s0", "g0"), F.least("s1", "g1")
    met = met.filter((lo < hi) & (F.floor(lo / window) == F.col("cell")))
    skip = lo - F.col("s0")
    # ids are four bytes each
    crc = F.crc32(F.substring("rest_ids", (skip * 4 + 1).cast("int"), ((hi - lo) * 4).cast("int")))
    cut = met.select("doc_id", (F.col("doc_tokens") - F.col("rest") + skip).alias("start"), (hi - lo).alias("length"), crc.alias("ids_crc32"),
                     "doc_tokens", "sequence_id", (F.col("used") + lo - F.col("g0")).alias("offset"), F.lit("poured").alias("kind"))

    whole = with_running_total(rows.filter(f"doc_tokens >= {window}").select("doc_id", "order", "slice", "doc_tokens", "window_crcs"), [], "slice", ordered, F.size("window_crcs").cast("long"), "to")
    whole = whole.withColumn("first", F.lit(n_planned + n_new) + F.col("to") - F.size("window_crcs"))
    whole = whole.select("doc_id", "doc_tokens", "first", F.posexplode("window_crcs").alias("i", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit("window").alias("kind"))
    return planned.unionByName(cut).unionByName(whole)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
