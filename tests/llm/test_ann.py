"""Routing, recall and repeated rows of the neighbour search."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varidoc.llm import ann


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(np.float32(e)) for e in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_parts_are_even_and_cut_few_edges():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(16, 12))[np.repeat(np.arange(16), 60)] * 4 + rng.normal(size=(960, 12))
    graph = ann._neighbours(x, np.arange(len(x)), 10)
    part = ann.balanced_parts(x, graph, 16)
    size = np.bincount(part, minlength=16)
    assert size.max() - size.min() <= 4
    assert (part[graph] == part[:, None]).mean() > 0.8
    w = ann.train(x, part, graph, 16)
    assert (ann.Router(w, 3).place(x) == part).mean() > 0.8 and ann.Router(w, 3).probed(x).sum(axis=1).tolist() == [3] * len(x)


@pytest.mark.parametrize("kind", ["clusters", "no structure"])
def test_recall_and_share(spark, kind):
    """Recall of 0.9 and more against all rows, with well under half of the rows probed where there is structure."""
    rng = np.random.default_rng(8)
    n = 6000
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 24)) if kind == "clusters" else rng.normal(size=(n, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    df = frame(spark, range(n), x).repartition(3)
    router = ann.fit(df, n)
    part = router.place(x)
    share = (router.probed(x[::20]) @ np.bincount(part, minlength=router.parts)).mean() / n
    found = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, n, 20)] = -9
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    recall = np.mean([len(found[20 * i] & {*map(int, b)}) / 20 for i, b in enumerate(best)])
    assert recall >= 0.9 and share < (0.25 if kind == "clusters" else 0.75)


def test_only_probed_parts_are_searched():
    """best_of gives exactly the best of the rows in the parts that a query probes."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 8)), rng.normal(size=(40, 8))
    router = ann.Router(rng.normal(size=(9, 6)), 2)
    part = router.place(x)
    order = np.lexsort((np.arange(500), part))
    ids = np.arange(1000, 1500)[order]
    a, row, score = ann.best_of(router, q, np.full(40, -1), part[order], x[order], ids, 7)
    for i in range(40):
        open_ = router.probed(q[i : i + 1])[0][part]
        s = np.where(open_, (x * q[i]).sum(axis=1), -np.inf)
        want = [j for j in np.lexsort((np.arange(500), -s))[:7] if s[j] > -np.inf]
        assert [*ids[row[a == i]] - 1000] == want and np.allclose(score[a == i], s[want])


def test_repeated_rows(spark):
    """Rows that share an id are candidates and queries of their own; equal vectors are in the order of ids."""
    x = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.5, 0.5]]
    ids = [0, 0, 3, 2, 1]
    got = ann.nearest(frame(spark, ids, x).repartition(2), F.col("vec_id") == 0, k=4).collect()
    lists = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        assert r["query_id"] == 0
        lists[r["query_row"]].append((r["vec_id"], r["score"]))
    assert sorted(lists.values()) == sorted([[(2, 1.0), (3, 1.0), (1, 0.5), (0, 0.0)], [(1, 0.5), (0, 0.0), (2, 0.0), (3, 0.0)]])


def test_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "GROUP_ROWS", 500)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 8)).astype(np.float32).astype(float)
    x[::3] = x[0]
    got = defaultdict(list)
    for r in ann.nearest(frame(spark, range(1500), x), F.col("vec_id") % 60 == 0, k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 1500, 60):  # every query is one of the copies, which are nearest to each other or all behind others
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        mine = [v for _, v, _ in sorted(got[q])]
        assert len({*mine} & {*map(int, best)}) >= 17 and [sc for *_, sc in sorted(got[q])] == sorted([sc for *_, sc in got[q]], reverse=True)
