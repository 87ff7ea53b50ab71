"""Each stage of the pipeline against brute force, on documents with null and repeated ids and near copies."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from varidoc.llm import toxicity
from varidoc.llm.token_counts import tokenizer_path

import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, _row long, plays int, lang_pred string, toxic_score double"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(150)], ["".join(rng.choices("klmnopqrst", k=rng.randint(3, 7))) for _ in range(150)]]
    bad = ["vilest", "nastyhead", "scumbag"]
    rows = []
    for i in range(140):
        text = rng.choices(words[i % 2], k=rng.randint(8, 60))
        if i % 4 == 0:
            text[3:6] = rng.choices(bad, k=3)
        rows.append((i, " ".join(text), "ab"[i % 2] + "x"))
    for i in range(30):  # copies with a word or two changed, under new, null and repeated ids
        text = rows[1 + 2 * i][1].split()
        for _ in range(i % 3):
            text[rng.randrange(len(text))] = "changed"
        rows.append(([200 + i, None, 7][i % 3], " ".join(text), "bx"))
    rows += [(300, None, "ax"), (301, "", "ax"), (302, "12 34 !!", None), (303, rows[1][1], None), (303, rows[1][1], None), (None, None, None)]
    rows = [(d, t, lang, [None, "s", "t", "u"][k % 4], len(t or ""), "own", k, 3, "mine", 0.5) for k, (d, t, lang) in enumerate(rows)]
    rows.append(rows[5])
    labels = [(d, int("vilest" in t or "nastyhead" in t or "scumbag" in t)) for d, t, *_ in rows[:140]]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, labels = corpus
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def run(spark, folder, name, rows, parts=3):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, COLUMNS).repartition(parts), folder)
    return [tuple(r) for r in out.collect()], out.columns


NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def test_language(spark, corpus, folder):
    got, columns = run(spark, folder, "language", corpus[0])
    assert columns == NAMES
    assert Counter(got) == Counter(r for r in corpus[0] if any(c.isalpha() for c in r[1] or ""))


def test_toxicity(spark, corpus, folder):
    rows, labels = corpus
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    marked = {d: y for d, y in labels if not held(d)}
    texts = defaultdict(set)
    for d, t, *_ in rows:
        if t is not None and d in marked:
            texts[d].add(t)
    train = [(t, marked[d]) for d in texts for t in texts[d]]
    assert all(len(t) == 1 for d, t in texts.items() if d != 7)  # id 7 has other texts, of which one teaches
    got, columns = run(spark, folder, "toxicity", [r for r in rows if r[0] != 7])
    train = [(t, marked[d]) for d in texts if d != 7 for t in texts[d]]
    want = brute.toxicity(train, [r[1] for r in rows])
    assert columns == NAMES and Counter(got) == Counter(r for r, (p, _) in zip(rows, want) if p < 0.7 and r[0] != 7)
    assert 0.15 < sum(p >= 0.7 for p, _ in want) / len(want) < 0.35
    docs = spark.createDataFrame([r for r in rows if r[0] != 7], COLUMNS)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {(r["_row"]): r for r in toxicity.with_toxicity(docs, model).collect()}
    for r, (p, spots) in zip(rows, want):
        if r[0] != 7:
            assert scored[r[6]]["toxic_score"] == pytest.approx(p, abs=1e-6)
            assert [(s["first"], s["end"]) for s in scored[r[6]]["toxic_passages"]] == spots


def test_near_dedup(spark, corpus, folder):
    rows = corpus[0]
    group = brute.near_groups([r[1] for r in rows])
    best = {}
    for r, g in zip(rows, group):
        best.setdefault(g, []).append(r)
    got, columns = run(spark, folder, "near_dedup", rows)
    assert columns == NAMES and len(got) == len(best) and not Counter(got) - Counter(rows)
    of = {r[6]: g for r, g in zip(rows, group)}
    kept = {of[r[6]]: r for r in got}
    assert {*kept} == {*best}
    for g, members in best.items():  # the least id stays, null last
        assert kept[g][0] == min((r[0] for r in members), key=lambda d: (d is None, d))
    assert sorted(map(str, run(spark, folder, "near_dedup", rows, 5)[0])) == sorted(map(str, got))


def test_mixing(spark, corpus, folder):
    rows = [r for r in corpus[0]]
    out, columns = run(spark, folder, "mixing", rows)
    got = Counter(out)
    assert columns == NAMES and not {*got} - {*rows} and max(got.values()) <= 2 * max(Counter(rows).values())
    plays = brute.mix([(r[0], r[3], r[1]) for r in rows])
    words = lambda r: len(brute.WORD.findall(r[1] or ""))
    want, have = Counter(), Counter()
    for r, n in zip(rows, plays):
        want[r[3]] += n * words(r)
    for r, n in got.items():
        have[r[3]] += n * words(r)
    largest = max(map(words, rows))
    assert all(abs(want[s] - have[s]) <= 2 * largest for s in want)
    again = Counter(run(spark, folder, "mixing", rows, 6)[0])
    assert again == got


def test_packing(spark, corpus, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = [(k, *r[1:]) for k, r in enumerate(corpus[0])]
    got, columns = run(spark, folder, "packing", rows)
    at = {c: columns.index(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    pieces, room = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r[at["doc_id"]]].append(r)
        room[r[at["sequence_id"]]].append((r[at["offset"]], r[at["length"]]))
    for d, text, *_ in rows:
        ids, done = [*library.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[d], key=lambda r: r[at["start"]]):
            part = ids[done : done + r[at["length"]]]
            assert r[at["start"]] == done and r[at["doc_tokens"]] == len(ids) and r[at["ids_crc32"]] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            done += len(part)
        assert done == len(ids)
    for held in room.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096


def test_whole_pipeline(spark, corpus, folder):
    """run() gives what the stages give one after the other."""
    got = corpus_pipeline.run(spark, folder)
    lettered = {r[0] for r in corpus[0] if any(c.isalpha() for c in r[1] or "")}
    assert {"doc_id", "sequence_id", "ids_crc32"} <= {*got.columns}
    kept = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert kept and kept <= lettered
