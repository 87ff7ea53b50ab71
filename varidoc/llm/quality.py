"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (lower-cased, white space collapsed, code points above 16 bits as one), so it
knows every language's spelling and never meets an unknown word. Four characters of 16 bits are one 64-bit
key. Only the counts of 4-grams are gathered from the texts; lower orders count distinct left neighbours, and
contexts their followers, by grouping keys: joins of sharded tables give each gram's discounted probability
and each context's back-off weight. Documents are dealt into blocks by a hash; a block asks for the distinct
grams of all its texts, the request is joined with the model's shards, and the answers meet the block again; a
task has one block.
No task and no driver holds the model, and a gram that all documents have is asked for once a block.

A language's threshold is a quantile of its trusted documents' perplexity, taken on the trusted rows that
were left out of training (of all those, where it has none); documents above it are not kept. Null and empty texts have no characters, null perplexity and
are not kept; a null language is a language of its own; without trusted text nothing is scored or kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, written
from .language_id import held_out

ORDER = 4
#: Text of a block, about.
BLOCK_BYTES = 12_000_000
#: Blocks that are dealt to a task of their own at most; more are dealt to as many tasks by a hash.
TASKS = 20_000
#: Trusted ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
QUANTILE = 0.995
#: One trusted row in so many is left out of training, and sets thresholds.
JUDGES = 4
_SPACE = re.compile(r"\s+")
_MASKS = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


def fourgrams(text: str) -> np.ndarray:
    """Sorted distinct 4-grams of the text behind three start marks, with their counts."""
    s = "\x01\x01\x01" + _SPACE.sub(" ", text.lower()).strip()
    a = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.clip(a, 1, 0xFFFF).astype(np.uint64)
    if len(a) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = a[:-3] << np.uint64(48) | a[1:-2] << np.uint64(32) | a[2:-1] << np.uint64(16) | a[3:]
    return np.unique(k, return_counts=True)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return both, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def count_fourgrams(texts: DataFrame) -> DataFrame:
    """gram and n over all rows of texts (column text). Tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                k, n = fourgrams(text or "")
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 2_000_000:
                    k, n = _summed(keys, counts)
                    keys, counts, held = [k], [n], 0
        if keys:
            k, n = _summed(keys, counts)
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 200_000].astype(np.int64)), pa.array(n[i : i + 200_000])], ["gram", "n"])

    return texts.mapInArrow(in_parts(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame) -> tuple[DataFrame, float] | None:
    """The model: gram (1 to 4 characters), alpha (its discounted probability), gamma (its back-off weight as
    a context), and the probability of a character that was never seen. None without text."""
    counts = {ORDER: written(count_fourgrams(texts), "quality-counts")}
    for k in range(ORDER - 1, 0, -1):  # distinct left neighbours
        counts[k] = counts[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    grams = None
    for k, c in counts.items():
        c = c.withColumn("k", F.lit(k))
        grams = c if grams is None else grams.unionByName(c)
    grams = written(grams, "quality-grams")
    many = {(r["k"], r["n"]): r["many"] for r in grams.filter("n <= 4").groupBy("k", "n").agg(F.count("*").alias("many")).collect()}
    total, kinds = grams.filter("k = 1").agg(F.sum("n"), F.count("*")).first()
    if not total:
        return None
    discounts = {}
    for k in counts:
        n1, n2, n3, n4 = (max(1, many.get((k, i), 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[k] = [min(max(d, 0.0), i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    by_order = F.create_map(*[F.lit(x) for k, d in discounts.items() for x in (k, d)])
    discount = F.element_at(F.element_at(by_order, F.col("k")), F.least("n", F.lit(3)).cast("int"))
    rows = grams.withColumn("d", discount).withColumn("context", F.shiftrightunsigned("gram", 16))
    contexts = rows.groupBy("context", "k").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
    alpha = rows.join(contexts.select("context", "k", "total"), ["context", "k"]).select("gram", "k", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"))
    gamma = contexts.filter("k > 1").select(F.col("context").alias("gram"), (F.col("k") - 1).alias("k"), "gamma")
    model = alpha.join(gamma, ["gram", "k"], "full").select("gram", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    rest = contexts.filter("k = 1").select("gamma").first()["gamma"]
    return written(model, "quality-model"), rest / (kinds + 1)


def _log_probabilities(grams: np.ndarray, keys: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, unseen: float) -> np.ndarray:
    """Natural log of the interpolated probability of each 4-gram's last character."""

    def look(values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)

    p = look(alpha, grams & _MASKS[1], 0.0) + unseen
    for k in range(2, ORDER + 1):
        own = grams & _MASKS[k]
        p = look(alpha, own, 0.0) + look(gamma, own >> np.uint64(16), 1.0) * p
    return np.log(p)


def _distinct(texts: list[str | None]) -> np.ndarray:
    """Sorted distinct 4-grams of some texts."""
    out, waiting, held = np.zeros(0, np.uint64), [], 0
    for t in texts:
        k = fourgrams(t or "")[0]
        waiting.append(k)
        held += len(k)
        if held > 2_000_000:
            out, waiting, held = np.unique(np.concatenate([out, *waiting])), [], 0
    return np.unique(np.concatenate([out, *waiting]))


def perplexities(docs: DataFrame, model: DataFrame, unseen: float, *, blocks: int) -> DataFrame:
    """doc_id, lang, n_chars, perplexity for docs (doc_id, lang, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    deal = lambda df: df.repartitionById(blocks, "block") if blocks <= TASKS else df.repartition(TASKS, "block")
    # rows that agree in id and text are spread by their place in the input
    spread = F.xxhash64("doc_id", "text", F.monotonically_increasing_id() % 1024)
    dealt = deal(docs.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block = np.asarray(batch.column("block").to_numpy(zero_copy_only=False))
            texts = batch.column("text").to_pylist()
            for b in np.unique(block):
                new = _distinct([texts[i] for i in np.flatnonzero(block == b)])
                held[b] = np.union1d(held[b], new) if b in held else new
        for b, g in held.items():
            wanted = np.unique(np.concatenate([g, *[g & _MASKS[k] for k in range(1, ORDER)], *[(g & _MASKS[k]) >> np.uint64(16) for k in range(2, ORDER + 1)]]))
            for i in range(0, len(wanted), 200_000):
                part = wanted[i : i + 200_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, dtype=np.int32)), pa.array(part)], ["block", "gram"])

    answers = deal(dealt.mapInArrow(in_parts(ask), "block int, gram long").join(model, "gram").select("block", "gram", "alpha", "gamma"))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys = answers.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        keys, alpha, gamma = keys[order], answers.column("alpha").to_numpy()[order], answers.column("gamma").to_numpy()[order]
        n, perplexity = [], []
        texts_list = texts.column("text").to_pylist()
        grams = _distinct(texts_list)
        logs = _log_probabilities(grams, keys, alpha, gamma, unseen)
        for text in texts_list:
            g, c = fourgrams(text or "")
            total = int(c.sum())
            n.append(total)
            perplexity.append(float(np.exp(-(logs[np.searchsorted(grams, g)] @ c) / total)) if total else None)
        return pa.table({"doc_id": texts.column("doc_id"), "lang": texts.column("lang"), "n_chars": pa.array(n, pa.int64()), "perplexity": pa.array(perplexity, pa.float64())})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, lang string, n_chars long, perplexity double")


def quality(docs: DataFrame, trusted_ids: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept for docs (doc_id, lang, text); trusted_ids: _id."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    trusted_ids = trusted_ids.select("_id").dropna().distinct()
    small = trusted_ids.count() <= BROADCAST_IDS
    mark = F.broadcast(trusted_ids) if small else trusted_ids
    judge = F.pmod(F.xxhash64("doc_id"), F.lit(JUDGES)) == 0  # trusted rows that set thresholds and train nothing
    got = train(docs.filter(~judge).join(mark, F.col("doc_id") == F.col("_id"), "left_semi").select("text"))
    if got is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.lit(0).cast("long").alias("n_chars"), none.alias("perplexity"), none.alias("threshold"), F.lit(False).alias("kept"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scored = written(perplexities(docs, *got, blocks=max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))), "quality-scores")
    sure = scored.join(mark, F.col("doc_id") == F.col("_id"), "left_semi").filter(judge & F.col("perplexity").isNotNull())
    q = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    by_lang = sure.groupBy(F.col("lang").alias("_lang")).agg(q.alias("threshold"))
    overall = sure.agg(q).first()[0]
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall)))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").filter(~held_out("doc_id"))
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.select(F.col("doc_id").alias("_id")))
