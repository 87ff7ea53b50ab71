"""Shards against a k-d tree in Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varidoc.llm import sharding


def brute_shards(rows, dims, leaves):
    """rows: (id, text); dims: functions of a text. Splits at weighted medians of the widest scaled dimension; of rows
    in order of coordinate and checksum, groups of equal texts go to the side that is nearer to what is wanted."""
    scale = (1 << sharding.COORDINATE_BITS) - 1
    values = np.array([[float(f(t)) for f in dims] for _, t in rows])
    low, span = values.min(axis=0), np.ptp(values, axis=0)
    at = np.floor((values - low) / np.where(span > 0, span, 1.0) * scale).astype(np.int64)
    crc = [zlib.crc32(t.encode()) for _, t in rows]
    size = [len(t.encode()) + 1 for _, t in rows]

    def split(members, first, k):
        if k == 1:
            return {i: first for i in members}
        d = int(np.argmax(np.ptp(at[members], axis=0)))
        groups = defaultdict(list)
        for i in members:
            groups[at[i][d], crc[i]].append(i)
        wanted, spent, left = sum(size[i] for i in members) * (k // 2) / k, 0, []
        order = sorted(groups)
        for n, key in enumerate(order):
            own = sum(size[i] for i in groups[key])
            if spent + own > wanted:
                if wanted - spent > spent + own - wanted:
                    left += groups[key]
                    n += 1
                break
            spent += own
            left += groups[key]
        chosen = {*left}
        right = [i for i in members if i not in chosen]
        return {**split(left, first, k // 2), **split(right, first + k // 2, k - k // 2)}

    return split([*range(len(rows))], 0, leaves)


DIMS = [lambda t: len(t.encode()), lambda t: t.count(" ") / max(len(t), 1)]
def columns():
    return {"bytes": F.octet_length("text"), "spaces": (F.length("text") - F.length(F.translate("text", " ", ""))) / F.greatest(F.length("text"), F.lit(1))}


@pytest.mark.parametrize("leaves", [2, 5, 8])
def test_against_brute_force(spark, leaves):
    """Sizes are near equal and leaves are those of the tree but for rows next to a cut."""
    rng = random.Random(leaves)
    rows = [(i, " ".join("ab" * rng.randint(1, 6) for _ in range(rng.randint(1, 40)))) for i in range(600)]
    rows += [(600 + i, t) for i, (_, t) in enumerate(rows[:100])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(docs, columns(), leaves=leaves).collect()}
    want = brute_shards(rows, DIMS, leaves)
    total = Counter()
    for d, t in rows:
        total[got[d]] += len(t) + 1
    assert sorted(total) == [*range(leaves)] and max(total.values()) <= 1.06 * min(total.values())
    assert sum(got[d] == want[i] for i, (d, _) in enumerate(rows)) >= 0.97 * len(rows)


def test_equal_texts_stay_together(spark):
    """Whatever their language or source, also under null and repeated ids."""
    rng = random.Random(3)
    texts = [" ".join("xyz" * rng.randint(1, 5) for _ in range(rng.randint(3, 50))) for _ in range(1000)]
    rows = [(i, t, lang, src) for i, t in enumerate(texts) for lang, src in (("en", "a"), ("de", None))]
    rows += [(None, t, None, "b") for t in texts[:50]] + [(7, t, None, "b") for t in texts[50:100]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = sharding.kd_shards(docs, sharding.text_dimensions(F.col("text")), leaves=16).collect()
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
    assert len(got) == len(rows) and all(len(s) == 1 for s in of.values())
    again = sharding.kd_shards(docs.repartition(7), sharding.text_dimensions(F.col("text")), leaves=16).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_null_ids_of_one_text_can_be_cut(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).repartition(3)
    got = sharding.kd_shards(docs, sharding.text_dimensions(F.col("text")), leaves=4).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert len(got) == 4 and max(r["s"] for r in got) <= 1.1 * min(r["s"] for r in got) and all(r["m"] == r["n"] - 1 for r in got)


def test_many_leaves(spark):
    docs = spark.range(4000).select("id", F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    got = sharding.kd_shards(docs, sharding.text_dimensions(F.col("text")), target_bytes=2000, id_col="id").groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(got) == round(4000 * 38 / 2000) and max(r["s"] for r in got) <= 1.2 * min(r["s"] for r in got)
