"""Plays of the mix against the queue by its definition."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from varidoc.llm import mixing


def rows_of(seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 7, i, i]), rng.choice(["a", "b", "c", None, "d"]) if i % 3 else "a", None if i % 41 == 0 else " ".join(["w"] * rng.randint(0, 30) + [str(i)])) for i in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_plays(spark, monkeypatch, seed):
    """The same plays as by brute force, also if only few rows may be put in order, and on repartitioned input."""
    rows = rows_of(seed)
    want = Counter((d, s, len(brute.WORD.findall(t or "")), n) for (d, s, t), n in zip(rows, brute.mix(rows)))
    for parts, few in ((1, 100_000), (4, 100_000), (3, 2)):
        monkeypatch.setattr(mixing, "CUT_ROWS", few)
        monkeypatch.setattr(mixing, "RANGES", 7 if few == 2 else 4096)
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)).collect()
        assert Counter((r["doc_id"], r["source"], r["size"], r["plays"]) for r in got) == want


def test_many_sources_that_end_at_one_time(spark, monkeypatch):
    """Sources that are played twice all end at the same times; the cut among them is by source."""
    monkeypatch.setattr(mixing, "CUT_ROWS", 3)
    rows = [(i, f"s{i:03}", "one two three") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    want = brute.mix(rows)
    assert {r["doc_id"]: r["plays"] for r in got.collect()} == dict(enumerate(want))


def test_clashing_columns(spark):
    docs = spark.createDataFrame(rows_of(3, 40), "doc_id long, source string, text string").withColumns({c: F.lit(c) for c in ("size", "plays", "order", "slice", "kept", "target")})
    assert mixing.mix(docs).count() == docs.count() and {r["kept"] for r in mixing.mix(docs, keep="size").collect()} == {"size"}
