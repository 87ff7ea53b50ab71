"""Exact BPE token counts at every prefix of a text, by dynamic programming over prefixes.

For byte-pair encoding, the tokens before the last one are the encoding of what they cover. So the
encoding of each prefix is known from one back-pointer, its last token: the one vocabulary entry that
ends there and that the last token of the rest does not merge across. The count at a prefix is the count
at the rest plus one. White space always parts the tokenizer's words, so a text's counts are the running
sum of its chunks' profiles, and a profile is computed once for each distinct chunk a worker meets. Chunks
with contractions, special tokens or characters that combine take the same steps over normalised text, whatever
their length.

Null texts count as empty; an empty text has no tokens; very long texts are handled whole, since the
work is a running sum over chunks.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, in_parts

#: Bytes that a generation of a counter's memos may take: of words and chunks, and of pairs of tokens.
MEMO_BYTES, PAIR_BYTES = 100_000_000, 80_000_000
#: Bits of a token's number in the key of a pair.
PAIR_BITS = 24
#: Separators that Python splits at and the tokenizer does not.
_CONTROL = regex.compile("[\x1c-\x1f]")
_PRETOKEN = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACE, _LETTER, _NUMBER = regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Endings that the tokenizer takes as words where a word begins by the apostrophe.
_CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
_SAFE_SPLIT = regex.compile("[ \t\n\r\x0b\x0c]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks_of(text: str) -> list[str]:
    """Pieces between white space; every encoding of a text is the concatenation of its pieces'."""
    if _CONTROL.search(text):
        return [c for c in _SAFE_SPLIT.split(text) if c]
    return text.split()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _width(c: str) -> int:
    """Bytes of a character in UTF-8."""
    return 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4


def _packed(counts) -> bytes | tuple[int, ...]:
    """Few bytes where that will do, which Python's garbage collector need not visit."""
    return bytes(counts) if max(counts) < 256 else tuple(counts)


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that may compose with the one before them, vowels and finals of Hangul among them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset([chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"] + [*map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))])


@functools.lru_cache(1 << 16)
def settled(c: str) -> bool:
    """Whether every edition of Unicode since 3.2 puts c into the same class, so that the tokenizer's does too."""
    old, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    return old != "Cn" and old[0] == now[0] and (now[0] == "L") == bool(_LETTER.match(c)) and (now[0] == "N") == bool(_NUMBER.match(c))


@functools.lru_cache(1 << 16)
def _joins(c: str) -> bool:
    """Whether c may change how what stands before it is normalised; so may letters and marks that this
    Python does not know yet."""
    if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{M}]", c):
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) != 0 or first in _seconds()


class _OpenWords:
    """Normalised text put character by character, with the count of what is there; the end can be cut off.

    A state holds the tokens before the open word, where that begins, its kind, how far it may be on the way
    to a contraction, the symbols put so far, and the count."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.text: list[str] = []
        self.states: list[tuple[int, int, str, str, int, int]] = [(0, 0, "", "", 0, 0)]
        self.symbols: list[str] = []
        self.last, self.inner = [0], [0]  # as in word_profile, of the open word

    def cut(self, length: int) -> None:
        if length == len(self.text):
            return
        del self.text[length:], self.states[length + 1 :]
        size = self.states[-1][4]
        del self.symbols[size:], self.last[size + 1 :], self.inner[size + 1 :]

    def put(self, c: str) -> None:
        base, start, kind, mark, size, count = self.states[-1]
        self.text.append(c)
        new = self.counter.kind(c)
        if new == "S":
            self.states.append((count, size, new, "", size, count))
            return
        if mark and mark + c in _CONTRACTIONS:
            count = self.states[-len(mark)][0] + self.counter.word_profile(mark + c)[-1]
            self.states.append((count, size, "C", "", size, count))
            return
        mark = mark + c if mark == "'" and c in "rvl" else ""
        if new != kind or new == "N":
            base, start = count, size
            if c == "'":
                mark = c
        closed = 0
        for b in c.encode("utf-8"):
            closed = self._symbol(self.counter.symbols[b], start)
        self.states.append((base, start, new, mark, len(self.symbols), base + closed))

    def _symbol(self, symbol: str, start: int) -> int:
        """Puts one symbol; the count of the open word if it ends here."""
        c, last, inner = self.counter, self.last, self.inner
        self.symbols.append(symbol)
        low = max(start, len(self.symbols) - c.longest)
        tail = "".join(self.symbols[low:])
        here, count, closed = 0, 0, 0
        for j in range(low, low + len(tail)):
            token, ended = c.tokens.get(tail[j - low :], (0, 0))
            if token and not here and (j == start or c.compatible(last[j], token)):
                here, count = token, (inner[j] if j > start else 0) + 1
            if ended and not closed and (j == start or c.compatible(last[j], ended)):
                closed = (inner[j] if j > start else 0) + 1
        last.append(here)
        inner.append(count)
        return closed


class PrefixCounter:
    """Token counts of every prefix of chunks, for a BPE with a word-end suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = frozenset(model["vocab"])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.made = {a + b: (i, a, b) for i, (a, b) in reversed([*enumerate(merges)])}
        #: Tokens by number, from 1; and for every beginning of a token the numbers of the token that it is inside a
        #: word and of the token that it is at a word's end, 0 if it is none.
        self.names = ["", *self.vocab]
        number = {t: i for i, t in enumerate(self.names)}
        beginnings = {t.removesuffix(self.end)[:i] for t in self.vocab for i in range(1, len(t) + 1)}
        self.tokens = {b: (number.get(b, 0), number.get(b + self.end, 0)) for b in beginnings}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        self.longest = max(map(len, self.tokens))
        self.found = ahocorasick.Automaton()
        for b, (token, ended) in self.tokens.items():
            if token or ended:
                self.found.add_word(b, (len(b), token, ended))
        self.found.make_automaton()
        self.symbols = byte_symbols()
        self.shown = dict(enumerate(self.symbols))
        self.kinds: dict[str, str] = {}
        self.together, self.words, self.chunks = Memo(PAIR_BYTES, lasting=True), Memo(MEMO_BYTES, lasting=True), Memo(MEMO_BYTES, lasting=True)

    def kind(self, c: str) -> str:
        """S, L, N or P: space, letter, number or other, as the tokenizer takes it."""
        known = self.kinds.get(c)
        if known is None:
            if settled(c):
                known = "S" if _SPACE.match(c) else "L" if _LETTER.match(c) else "N" if _NUMBER.match(c) else "P"
            else:  # its edition of Unicode may be another than ours
                pieces = lambda t: len(self.library.pre_tokenizer.pre_tokenize_str(t))
                known = "L" if pieces("a" + c) == 1 and pieces(c) else "S" if not pieces(c) else "N" if pieces(c + c) == 2 else "P"
            self.kinds[c] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when they stand side by side.

        Takes the merges that made them back, latest first (of equals the right one), and looks
        whether the two pieces at the seam would have merged before the merge just taken back.
        """
        pair = left << PAIR_BITS | right
        known = self.together.get(pair)
        if known is not None:
            return known
        rank, made, known = self.rank, self.made, True
        l, r = self.names[left], self.names[right]
        limit = 1 << 60  # the seam must have no merge of a rank below this
        while True:
            if rank.get((l, r), 1 << 61) < limit:
                known = False
                break
            from_l, from_r = made.get(l), made.get(r)
            if from_l is None and from_r is None:
                break
            if from_r is None or from_l is not None and from_l[0] > from_r[0]:
                limit, l = from_l[0], from_l[2]
            else:
                limit, r = from_r[0] + 1, from_r[1]
        self.together.tidy()
        return self.together.add(pair, known, 100)

    def word_profile(self, word: str) -> bytes | tuple[int, ...]:
        """Counts of the encodings of word[:1], word[:2], ... each taken as a whole word; by characters."""
        known = self.words.get(word)
        if known is not None:
            return known
        raw = word.encode("utf-8")
        text = raw.decode("latin-1").translate(self.shown)
        n = len(text)
        last = [0] * (n + 1)  # last token of each prefix inside a longer word
        inner = [0] * (n + 1)
        closed = [0] * (n + 1)  # counts of each prefix that ends its word
        together, compatible = self.together.known.get, self.compatible
        for end, (length, token, ended) in self.found.iter(text):  # the tokens that end at each place, places in order
            i = end + 1
            j = i - length
            if token and not last[i]:
                ok = not j or together(last[j] << PAIR_BITS | token)
                if compatible(last[j], token) if ok is None else ok:
                    last[i], inner[i] = token, inner[j] + 1
            if ended and not closed[i]:
                ok = not j or together(last[j] << PAIR_BITS | ended)
                if compatible(last[j], ended) if ok is None else ok:
                    closed[i] = inner[j] + 1
        if len(word) != n:
            known = _packed([closed[e] for e in itertools.accumulate(map(_width, word))])
        else:
            known = _packed(closed[1:])
        self.words.tidy()
        return self.words.add(word, known, 2 * len(word) + 180)

    def profile(self, chunk: str) -> bytes | tuple[int, ...]:
        """Counts of the encodings of chunk[:1], chunk[:2], ..., chunk."""
        known = self.chunks.get(chunk)
        if known is not None:
            return known
        low = chunk.lower()
        plain = "'" not in chunk and "<|" not in chunk and len(low) == len(chunk)
        if plain and not low.isascii():
            # characters that change when read apart, or that combine, are left to the library
            plain = all(map(settled, low)) and low == "".join(c.lower() for c in chunk) and unicodedata.is_normalized("NFC", chunk) and not any(map(unicodedata.combining, chunk)) and not any("ᄀ" <= c <= "ᇿ" for c in chunk)
        if plain:
            if low.isalpha():
                known = self.word_profile(low)
            else:
                known, base = [], 0
                for word in _PRETOKEN.findall(low):
                    known += [base + k for k in self.word_profile(word)] if base else self.word_profile(word)
                    base = known[-1]
            plain = len(known) == len(chunk)
        if not plain:
            known = self.odd_profile(chunk)
        self.chunks.tidy()
        return self.chunks.add(chunk, _packed(known), 2 * len(chunk) + 180)

    def odd_profile(self, chunk: str) -> list[int]:
        """Counts at every prefix of a chunk of any characters. A special token counts from its last character on."""
        out: list[int] = []
        at = base = 0
        for special in self.special.finditer(chunk):
            counts = self.piece_profile(chunk[at : special.end()])
            out += [base + c for c in counts]
            base += (counts[special.start() - at - 1] if special.start() > at else 0) + 1
            out[-1] = base
            at = special.end()
        return out + [base + c for c in self.piece_profile(chunk[at:])]

    def piece_profile(self, piece: str) -> list[int]:
        """Counts at every prefix of a piece without special tokens.

        What a prefix is normalised to differs from the next one's in its last combining sequence only, so
        that sequence is taken back from the open words and put again."""
        words, out = _OpenWords(self), []
        begin = fixed = 0  # of the last combining sequence: in the piece and in the normalised text
        for i, c in enumerate(piece):
            if c < "\x80" or not _joins(c):
                begin, fixed = i, len(words.text)
            if begin == i and c < "\x80":
                words.put(c.lower())
            else:
                put = self.library.normalizer.normalize_str(piece[begin : i + 1])
                same = 0
                for x, y in zip(itertools.islice(words.text, fixed, None), put):
                    if x != y:
                        break
                    same += 1
                words.cut(fixed + same)
                for x in put[same:]:
                    words.put(x)
            out.append(words.states[-1][-1])
        return out

    def count(self, text: str) -> int:
        return sum(self.totals(chunks_of(text)))

    def totals(self, chunks: list[str]) -> list[int]:
        get, profile = self.chunks.known.get, self.profile
        return [(get(c) or profile(c))[-1] for c in chunks]

    def counts(self, text: str) -> np.ndarray:
        """The exact count at every prefix: element i is the count of text[:i]."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at = base = 0
        for chunk in chunks_of(text):
            start = text.index(chunk, at)
            out[at : start + 1] = base
            at = start + len(chunk)
            profile = self.profile(chunk)
            out[start + 1 : at + 1] = base + np.array([*profile])
            base += profile[-1]
        out[at:] = base
        return out

    def fit(self, text: str, chunks: list[str], ends: list[int], budget: int) -> int:
        """Characters of the longest prefix that ends inside or after the last chunk begun within
        budget tokens and itself has at most budget tokens, from counts at every prefix."""
        if not ends or ends[-1] <= budget:
            return len(text)
        k = bisect_right(ends, budget)  # the first chunk whose end is over
        at = 0
        for chunk in chunks[:k]:
            at = text.index(chunk, at) + len(chunk)
        start = text.index(chunks[k], at)
        base = ends[k - 1] if k else 0
        inside = [i + 1 for i, c in enumerate(self.profile(chunks[k])) if base + c <= budget]
        return start + inside[-1] if inside else start


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker and tokenizer file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, *, budget: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, fits_chars (longest prefix of at most budget tokens) for every whole text. No shuffle."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            sizes, tokens, fits = [], [], []
            for text in batch.column("text").to_pylist():
                chunks = chunks_of(text)
                ends = list(itertools.accumulate(c.totals(chunks)))
                sizes.append(len(text.encode("utf-8")))
                tokens.append(ends[-1] if ends else 0)
                fits.append(c.fit(text, chunks, ends, budget))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "fits_chars"])

    return rows.mapInArrow(in_parts(run), f"doc_id {id_type}, n_bytes long, n_tokens long, fits_chars long")


def steps_of(counts: np.ndarray) -> tuple[bytes, int]:
    """The steps between counts, in the least width (bytes) that holds them all, and that width."""
    steps = np.diff(counts)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or max(-1 - steps.min(), steps.max()) < 1 << (8 * w - 1))
    return steps.astype(f"<i{width}").tobytes(), width


def prefix_table(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, steps and width: the increase of the token count at each character (signed, little-endian, width
    bytes each: one, or as many as the document's largest step needs), from which every prefix's exact count is
    a sum. It answers later budget questions without the tokenizer."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            made = [steps_of(c.counts(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in made], pa.binary()), pa.array([w for _, w in made], pa.int32())], ["doc_id", "steps", "width"])

    return rows.mapInArrow(in_parts(run), f"doc_id {id_type}, steps binary, width int")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = token_counts(docs, budget=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fits_chars")
