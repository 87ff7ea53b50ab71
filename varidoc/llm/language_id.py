"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranking of its most frequent 1- to 3-grams over all its training texts; a
document's is its own ranking. The language with the smallest out-of-place distance wins: the sum, over
the document's n-grams, of how far each is from its place in the language's ranking, or the profile's
length where it is missing. N-grams are exact: three code points of 21 bits fill one 64-bit integer.
Runs of characters that are not letters count as one boundary.

Null texts and texts without a letter are `und` with score 0. Ties of frequency go to the smaller n-gram,
ties of distance to the language first by code point. A training row without text or language teaches
nothing; with no training rows at all every document is `und`. Whole texts count, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import each_part, in_parts, with_struct

UNDETERMINED = "und"
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def grams(text: str) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased text as integers; boundaries are spaces."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    a = np.where(_is_letter()[a], a, 32)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    two = a[:-1] << 21 | a[1:]
    return np.concatenate([a[a != 32], two, two[:-1] << 21 | a[2:]])


def ranked(text: str, size: int) -> np.ndarray:
    """The document's most frequent n-grams, most frequent first."""
    keys, n = np.unique(grams(text), return_counts=True)
    return keys[np.argsort(-n, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Languages by code point; for every n-gram of any profile its place in each (size where missing)."""

    languages: tuple[str, ...]
    keys: np.ndarray
    places: np.ndarray
    size: int

    def distances(self, text: str) -> np.ndarray | None:
        """Mean out-of-place distance to each language, 0 to 1; None for a text without letters."""
        own = ranked(text, self.size)
        if not len(self.languages) or not (own < (1 << 21)).any():
            return None
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        place = np.where((self.keys[at] == own)[:, None], self.places[at], self.size)
        off = np.minimum(np.abs(place - np.arange(len(own))[:, None]), self.size)
        off = np.where(place == self.size, self.size, off)
        return off.sum(axis=0) / (len(own) * self.size)


def fit(docs: DataFrame, *, size: int = 400, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows of docs. Each task sums n-grams by language; only sums are shuffled, and
    only size n-grams for each language reach the driver."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def settle(lang: str) -> None:
            keys, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            held[lang] = 0
            if lang in sums:
                both, inverse = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([sums[lang][1], n])).astype(np.int64)
                keys = both
            sums[lang] = keys, n

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                g = grams(text)
                waiting.setdefault(lang, []).append(g)
                held[lang] = held.get(lang, 0) + len(g)
                if held[lang] > 2_000_000:
                    settle(lang)
        for lang in [*waiting]:
            settle(lang)
        for lang, (keys, n) in sums.items():
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(n[i : i + 100_000])], ["lang", "gram", "n"])

    sums = rows.mapInArrow(in_parts(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < size)
    found = top.select("lang", "gram", "place").toArrow().to_pydict()
    languages = tuple(sorted(set(found["lang"]), key=lambda x: [*map(ord, x)]))
    keys = np.unique(np.array(found["gram"], dtype=np.int64))
    places = np.full((len(keys), len(languages)), size)
    column = {x: i for i, x in enumerate(languages)}
    places[np.searchsorted(keys, np.array(found["gram"], dtype=np.int64)), [column[x] for x in found["lang"]]] = found["place"]
    return Profiles(languages, keys, places, size)


def language_of(spark: SparkSession, profiles: Profiles) -> Callable[[Column], Column]:
    """A function of a text column: a struct of lang and score. The score is the share by which the winner's
    distance is below the runner-up's (below 1, where there is one language)."""
    known = spark.sparkContext.broadcast(profiles)

    def predict(texts: pa.Array) -> pa.Array:
        p = known.value
        langs, scores = [], []
        for text in texts.to_pylist():
            d = p.distances(text) if text else None
            if d is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(d))
            rest = np.delete(d, best)
            second = float(rest.min()) if len(rest) else 1.0
            langs.append(p.languages[best])
            scores.append(max(0.0, 1 - float(d[best]) / second) if second > 0 else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_part(predict)(texts)

    return F.arrow_udf(batches, "lang string, score double")


def with_language(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, which take the place of columns of these names."""
    got = language_of(docs.sparkSession, profiles)(F.col(text_col))
    return with_struct(docs, got, {"lang": "lang_pred", "score": "lang_score"})


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    out = with_language(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
