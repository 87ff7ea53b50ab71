"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from varidoc.llm import near_dedup as nd


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = [*range(len(rows))]

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def found(df):
    out = nd.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out)


def test_odd_rows(odd, empty):
    assert found(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert nd.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_copies(spark, seed):
    """Groups around a text that its copies resemble more than each other, near the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 150, 400]))]
        for _ in range(25):
            text = [w if rng.random() > 0.02 * g else word() for w in base]
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rng.choices(rows, k=20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)


def test_null_and_repeated_ids(spark):
    """Copies, other texts and empty ones under null ids and one repeated id: ids say nothing of texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(60)]
        for _ in range(9):
            text = [w if rng.random() > 0.02 else word() for w in base]
            rows += [(None, " ".join(text)), (None, ""), (7, " ".join(text).upper()), (7, None), (100 + len(rows), " ".join(text[:-1]))]
    rows += [(None, " ".join(word() for _ in range(40))) for _ in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = nd.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute(rows)


def test_one_text_a_set(spark):
    """Texts are fetched once for each set, however many rows share its null id."""
    rows = [(None, f"{g} a b c d e f") for g in range(5) for _ in range(20)] + [(None, "")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = nd.sketches(df).filter("n_shingles > 0").select("node", "twin").distinct()
    assert sorted(r["text"] for r in nd._texts(df, sets).collect()) == [f"{g} a b c d e f" for g in range(5)]


def test_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_estimates():
    rng = np.random.default_rng(3)
    for size in (200, 2000):
        errors = []
        for share in (0.2, 0.5, 0.75, 0.9):
            for _ in range(40):
                x = rng.integers(0, 1 << 64, size, dtype=np.uint64)
                n = int(round(2 * share / (1 + share) * size))
                y = np.concatenate([x[:n], rng.integers(0, 1 << 64, size - n, dtype=np.uint64)])
                x, y = np.unique(x), np.unique(y)
                j, ok = nd.estimate(nd.registers(x)[None], nd.registers(y)[None], np.array([len(x)]), np.array([len(y)]))
                true = n / (2 * size - n)
                errors.append(j[0] - true)
                assert ok[0] or true < 0.75
                s = [(z[: nd.SAMPLE] >> np.uint64(32)).astype(np.uint32) for z in (x, y)]
                assert nd.sampled(s[0], len(x), [s[1]], np.array([len(y)]))[0] or true < 0.75
        assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)]
    got = {r["node"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {i: i for i in range(400)}
    for a, b in edges:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        for k in group:
            if group[k] == old:
                group[k] = new
    assert got == {n: group[n] for e in edges for n in e if e[0] != e[1]}


def test_sets_of_many_texts():
    """Sets, digests and registers that are made at once are those of each text alone, by the definition."""
    import xxhash

    top = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def plain(text):
        h = [*map(xxhash.xxh3_64_intdigest, (text or "").encode("utf-8", "surrogatepass").lower().split())]
        n, out = min(5, len(h)), set()
        for i in range(len(h) - n + 1 if n else 0):
            s = n
            for w in h[i : i + n]:
                s = mixed((s * 0x9E3779B97F4A7C15 + w) & top)
            out.add(s)
        return sorted(out)

    texts = [None, "", "a", "A\tb", "a b c", "a b c d", "a b c d E", "a b c d e f", "a " * 40, " \n", "É \x1c x\x85y ñ", "\ud800 lone", " ".join(map(str, range(3000))), ""]
    sets = [plain(t) for t in texts]
    flat, sizes = nd.shingle_sets(texts)
    assert sizes.tolist() == [*map(len, sets)] and flat.tolist() == [x for s in sets for x in s]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for got, c in zip(nd.digests(flat, sizes), (0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        assert got.tolist() == [signed(sum(mixed(x ^ c) for x in s) & top) for s in sets]
    rows = nd.register_rows(flat, sizes)
    assert all((row == nd.registers(np.array(s, dtype=np.uint64))).all() for row, s in zip(rows, sets))
    assert [x.tolist() for x in nd.remembered_sets([t or "" for t in texts])] == sets
    assert [t for g in nd._groups(texts) for t in g] == texts and [*nd._groups([])] == []
    assert [len(g) for g in nd._groups(["x" * nd.GROUP_CHARS, "y", "z"])] == [1, 2]


def test_sketching_costs_little_beyond_hashing():
    """Short texts of words that are all new: sketches cost less than three times splitting and hashing words
    (four to five times when each text had its own numpy calls and its words went through a memo)."""
    import time

    import xxhash

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(200)) for _ in range(1500)]

    def words():
        for t in texts:
            np.fromiter(map(xxhash.xxh3_64_intdigest, t.encode().lower().split()), dtype=np.uint64)

    def sketches():
        for group in nd._groups(texts):
            flat, sizes = nd.shingle_sets(group)
            nd.digests(flat, sizes)
            nd.register_rows(flat, sizes)

    def seconds(run):
        began = time.thread_time()
        run()
        return time.thread_time() - began

    assert min(seconds(sketches) for _ in range(5)) < 3 * min(seconds(words) for _ in range(5))
