"""Toxicity by maximum-scoring segments over token log-odds.

A token's score is its log-odds between toxic and other training texts under an informative Dirichlet
prior (the corpus' own frequencies); tokens whose log-odds are not significant share one small negative
score. A linear-time scan finds all maximal scoring segments of a text, which are disjoint. A segment's
score follows an extreme-value law under the background, so its bit score `lambda * s - ln(K * n)` is
comparable between texts of any length; a document's evidence is its best segment's and the sum of its
significant ones, which a logistic curve turns into a probability.

Training takes at most `max_rows` labelled ids (those of smallest hash) and one row of each, a documented bound: so the
token table, the rows that the curve is fitted on and the broadcast of labelled ids are bounded. Scoring
is one map over the whole texts. Null and empty texts have no evidence and get the score of none; rows
labelled more than once count as toxic if one label says so; without toxic training rows all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, each_part, in_parts, with_struct, written
from .language_id import held_out

TOKEN = re.compile(r"[^\W_]+")
#: Labelled rows that a model learns from, at most.
MAX_ROWS = 40_000
#: Lengths of word beginnings that count as tokens beside the word, so that inflections share evidence.
STEMS = (4, 5, 6)
#: Log-likelihood ratio and log-odds that a token must exceed to be significant.
LEAST_RATIO, LEAST_ODDS = 25.0, 1.5
#: Expected number of segments as good in a background text of the same length, for a significant one.
E_VALUE = 0.05


def forms(word: str) -> list[str]:
    """The tokens of a word: itself, and its beginnings."""
    return [word, *["^" + word[:k] for k in STEMS if len(word) > k]]


#: Scores of words met so far, of one model at a time.
_words = Memo()


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = -1.0
    scale: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal scoring segments as (first token, end token, score), and the number of tokens."""
        tokens = TOKEN.findall(text.lower())
        if not self.scores:
            return [], len(tokens)
        memo = words_of(self)
        for w in memo.missing(set(tokens)):
            memo.add(w, max([self.scores.get(f, 0.0) for f in forms(w)]), len(w) + 150)
        hits = [(i, s) for i, s in enumerate(map(memo.known.__getitem__, tokens)) if s]
        return maximal_segments(hits, self.drift), len(tokens)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """Bit score of the best segment and the sum over significant ones; 0 without segments."""
        if not segments:
            return 0.0, 0.0
        bits = [max(0.0, self.scale * s - self.log_k - math.log(max(n, 1))) for *_, s in segments]
        return max(bits), sum(b for b in bits if b > -math.log(E_VALUE))

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * math.log1p(total)))))


def words_of(model: ToxicityModel) -> Memo:
    """The memo of word scores (0 for a word without one), empty if it was another model's."""
    if getattr(_words, "model", None) is not model:
        _words.clear()
        _words.model = model
    return _words


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's scan. hits: positions and positive scores in order; every other token scores drift.

    Each candidate keeps the cumulative score before and after it; a new one is joined with the latest
    candidate that begins lower, if that one ends lower too.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, cumulative score before, after
    total, at = 0.0, 0
    for position, score in hits:
        total += drift * (position - at)
        first, end, low, high = position, position + 1, total, total + score
        total, at = high, position + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= high:
                found.append((first, end, low, high))
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, high - low) for a, b, low, high in found]


def _training(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """text and toxic of max_rows labelled ids at most. Of rows that share an id the text of least hash teaches."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marked = marked.filter(~held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> ToxicityModel:
    train = written(_training(docs, labels, max_rows), "toxicity-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {*TOKEN.findall(text.lower())}
                sums[toxic > 0].update({f for w in words for f in forms(w)})  # a document counts once for a token
        words = [*(sums[0] | sums[1])]
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([s[w] for w in part], pa.int64()) for s in sums]], ["token", "other", "toxic"])

    sums = written(train.mapInArrow(in_parts(count), "token string, other long, toxic long").groupBy("token").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t")), "toxicity-tokens")
    n_o, n_t = sums.agg(F.sum("o"), F.sum("t")).first()
    if not n_t or not n_o:
        return ToxicityModel()
    # The prior weighs as much as the toxic texts, and has the frequencies of all.
    o, t, seen = F.col("o"), F.col("t"), F.col("o") + F.col("t")
    prior = seen * n_t / (n_o + n_t)

    def odds(x, n: int):
        return F.log((x + prior) / (n + n_t - x - prior))

    def part(x, n: int):
        return F.when(x > 0, x * F.log(x / (seen * n / (n_o + n_t)))).otherwise(0.0)

    scored = sums.withColumn("d", odds(t, n_t) - odds(o, n_o)).withColumn("ratio", 2 * (part(t, n_t) + part(o, n_o)))
    # Every kept token takes at least LEAST_RATIO of a sum that the bounded sample bounds.
    kept = scored.filter((F.col("d") > LEAST_ODDS) & (F.col("ratio") > LEAST_RATIO)).select("token", "o", "t", "d").collect()
    if not kept:
        return ToxicityModel()
    p_t, p_o = sum(r["t"] for r in kept) / n_t, sum(r["o"] for r in kept) / n_o
    model = ToxicityModel({r["token"]: r["d"] for r in kept}, math.log((1 - p_t) / (1 - p_o)) if p_t > p_o else -1e-3)

    s = np.array([r["d"] for r in kept] + [model.drift])
    p = np.array([(r["o"] + 0.5) / n_o for r in kept] + [1 - p_o])
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    model.scale = low

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(max((x[2] for x in seg), default=0.0), n, model.evidence(seg, n)) for seg, n in map(model.segments, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2][0] for g in got], pa.float64()),
                 pa.array([g[2][1] for g in got], pa.float64()), batch.column("toxic")], ["top", "n", "best", "total", "toxic"])

    schema = "top double, n long, best double, total double, toxic int"
    seen = train.mapInArrow(in_parts(features), schema).toArrow().to_pydict()  # max_rows rows at most
    top, n, y = np.array(seen["top"]), np.maximum(np.array(seen["n"]), 1), np.array(seen["toxic"]) > 0
    back = ~y & (top > 0)
    if back.any():  # the mean of the extreme-value law is (ln(K n) + Euler's constant) / lambda
        model.log_k = float(np.mean(model.scale * top[back] - np.log(n[back])) - np.euler_gamma)
    bits = np.maximum(0.0, model.scale * top - model.log_k - np.log(n)) * (top > 0)
    seen = train.mapInArrow(in_parts(features), schema).toArrow().to_pydict()
    x = np.column_stack([np.ones(len(seen["best"])), seen["best"], np.log1p(seen["total"])])
    y = np.array(seen["toxic"]) > 0
    model.curve = tuple(_logistic(x, y))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_of(spark: SparkSession, model: ToxicityModel) -> Callable[[Column], Column]:
    """A function of a text column: a struct of score and passages (first token, end token, bit score of
    every significant one)."""
    known = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def score(texts: pa.Array) -> pa.Array:
        m = known.value
        scores, passages = [], []
        for text in texts.to_pylist():
            segments, n = m.segments(text or "")
            scores.append(m.probability(*m.evidence(segments, n)))
            least = m.log_k + math.log(max(n, 1)) - math.log(E_VALUE)
            passages.append([{"first": a, "end": b, "bits": m.scale * s - m.log_k - math.log(max(n, 1))} for a, b, s in segments if m.scale * s > least])
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, kind)], ["score", "passages"])

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return each_part(score)(texts)

    return F.arrow_udf(batches, "score double, passages array<struct<first: long, end: long, bits: double>>")


def with_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """docs with toxic_score and toxic_passages, which take the place of columns of these names."""
    got = toxicity_of(docs.sparkSession, model)(F.col(text_col))
    return with_struct(docs, got, {"score": "toxic_score", "passages": "toxic_passages"})


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = with_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"),
                      (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.size("toxic_passages").alias("n_passages"))
