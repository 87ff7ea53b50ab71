"""Token counts and packing against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from varidoc.llm import packing, token_counts as tc

PATH = tc.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = tc.PrefixCounter(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.text(st.sampled_from(" \t\n\x1c\x85\xa0abcEÉéñıİΣσ'rtsve.,!<|endoftext>5９漢😀ʼ́"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_every_prefix(text):
    assert [*COUNTER.counts(text)] == [len(ids(text[:i])) for i in range(len(text) + 1)]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_whole_texts(text):
    assert COUNTER.count(text) == len(ids(text))
    assert [*packing.Encoder(PATH).ids(text, b"")] == ids(text)


def test_counts(odd, empty):
    got = tc.token_counts(odd, budget=50).collect()
    want = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        text = want[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(ids(text)))
        assert len(ids(text[: r["fits_chars"]])) <= 50
    assert tc.token_counts(empty).count() == 0


def test_prefix_table(odd):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id in (0, 6, 9)").collect()}
    for r in tc.prefix_table(odd.filter("doc_id in (0, 6, 9)")).collect():
        text = texts[r["doc_id"]]
        assert [*np.cumsum(np.frombuffer(r["steps"], dtype=np.int8))] == [len(ids(text[:i])) for i in range(1, len(text) + 1)]


LONG = {
    "apostrophe": "漢字仮名交じり" * 200 + "'" + "文を書く" * 200,
    "thai": "ภาษาไทยเขียนติดกันไม่เว้นวรรคที่นี่ก็ดีมาก" * 60,
    "decomposed": "Zu\u0308richE\u0301te\u0301" * 200,
    "special": "abc<|endoftext|>x'll<|endoftex" * 90 + "we're'st''s!'re",
    "jamo": "\u1112\u1161\u11ab\u1100\u116e\u11a8" * 400,
}


@pytest.mark.parametrize("name", LONG)
def test_every_prefix_of_long_odd_chunks(name):
    text = LONG[name]
    assert len(text) > 2000 and not any(map(str.isspace, text))
    got = COUNTER.counts(text)
    at = [*range(0, 60), *range(60, len(text), 37), *range(len(text) - 40, len(text) + 1)]
    assert [got[i] for i in at] == [len(ids(text[:i])) for i in at]


def test_longest_prefix_of_long_odd_chunks(spark):
    df = spark.createDataFrame([*LONG.items()], "doc_id string, text string")
    for r in tc.token_counts(df, budget=500).collect():
        text = LONG[r["doc_id"]]
        want = max(i for i in range(len(text) + 1) if (i < 1000 or i % 7 == 0 or abs(i - r["fits_chars"]) < 9) and len(ids(text[:i])) <= 500)
        assert r["fits_chars"] == want
    for r in tc.prefix_table(df).collect():
        counts = np.cumsum(np.frombuffer(r["steps"], dtype=f"<i{r['width']}"))
        assert counts[-1] == len(ids(LONG[r["doc_id"]])) and counts[998] == len(ids(LONG[r["doc_id"]][:999]))


@pytest.mark.parametrize("step", [127, 128, -128, -129, 40_000, 1 << 40])
def test_wide_steps(step):
    steps, width = tc.steps_of(np.array([0, 300_000, 300_000 + step, 300_000]))
    assert [*np.frombuffer(steps, dtype=f"<i{width}")] == [300_000, step, -step]
    assert tc.steps_of(np.array([0, step, step]))[1] == (1 if -128 <= step <= 127 else 2 if abs(step) < 32768 else 4 if abs(step) < 1 << 31 else 8)
    assert tc.steps_of(np.zeros(1, np.int64)) == (b"", 1)


@given(st.text(st.sampled_from("'s'r'evtlmdaé e\u0301\u0323\u0344\u0f73\u0bc6\u0bbe\u1112\u1161\u11ab한İΣ5９!<|endoftext>\x1c\u3000漢ก็ีู่"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_every_prefix_of_odd_chunks(text):
    assert [*COUNTER.counts(text)] == [len(ids(text[:i])) for i in range(len(text) + 1)]


def check_pieces(docs, pieces, window):
    """Every row's ids lie in one piece each; sequences are gapless and not too long."""
    want = defaultdict(int)
    for r in docs:
        own = np.array([*ids(r["text"]), 2], dtype="<u4")
        want[r["doc_id"], len(own)] += len(own)
    got, places = defaultdict(int), defaultdict(list)
    texts = defaultdict(list)
    for r in docs:
        texts[r["doc_id"]].append(np.array([*ids(r["text"]), 2], dtype="<u4"))
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        assert any(zlib.crc32(t[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and len(t) == p["doc_tokens"] for t in texts[p["doc_id"]])
    assert got == want
    for x in places.values():
        x.sort()
        assert [a for a, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1]] and sum(n for _, n in x) <= window
    return sum(n for x in places.values() for _, n in x) / (len(places) * window) if places else 1.0


@pytest.mark.parametrize("window", [256, 4096])
def test_packing(odd, window):
    pieces = packing.pack(odd, window=window, bins=32, depth=4).collect()
    assert check_pieces(odd.collect(), pieces, window) > 0.8


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_packing_of_many(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs).collect()
    assert check_pieces(docs.collect(), pieces, 4096) > 0.98
    assert {p["kind"] for p in pieces} == {"window", "planned", "poured"}


def test_least_squares():
    a = packing.combinations(8, 3)
    assert (np.arange(1, 9) @ a == 8).all() and (a.sum(axis=0) <= 3).all() and len({*map(tuple, a.T)}) == a.shape[1]
    x = packing.nnls(a, a @ np.array([3.0, *[0] * (a.shape[1] - 2), 2.0]))
    assert (x >= 0).all() and np.abs(a @ x - a @ np.array([3.0, *[0] * (a.shape[1] - 2), 2.0])).max() < 1e-6


@given(st.lists(st.integers(0, 200), min_size=8, max_size=8))
@settings(max_examples=50, deadline=None)
def test_plan_seats_every_document(counts):
    combos, repeat = packing.plan(np.array(counts, float), 8, 4)
    assert [*(combos.T @ repeat if len(combos) else np.zeros(8))] == counts
    assert (combos @ np.arange(1, 9) <= 8).all() if len(combos) else True


def test_encoder_starts_no_threads():
    """A worker has one core: the tokenizer's library must not start threads of its own for each of them."""
    import os
    import subprocess
    import sys

    code = """if True:
        import os
        from varidoc.llm import packing
        encoder = packing.Encoder(packing.tokenizer_path())
        before = len(os.listdir("/proc/self/task"))
        encoder.ids(" ".join(f"word{i} x{i}y" for i in range(500)), b"")
        print(len(os.listdir("/proc/self/task")) - before)
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": root}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split() == ["0"]


@given(st.text(st.sampled_from(" \n\tabéя.,!5-'"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_stops(text):
    """Stops are parted from the letters before them where white space follows, and nowhere else."""
    want = "".join(" " + c if c in ".," and i and text[i - 1] in "abéя" and text[i + 1 : i + 2] in (" ", "\n") else c for i, c in enumerate(text))
    assert packing._STOP.sub(r" \g<0>", text) == want
