"""Quality classifier: supervised subword embeddings.

Each document is the mean of learned vectors of its hashed features (words, marks of repeated words, character 3- and 4-grams; each
kind weighs the same), followed by a softmax; vectors and output are trained together by stochastic gradient descent in
numpy on the driver, over a bounded sample of labelled rows.  As the output is linear in the mean, scoring needs one number
per feature bucket, the vector's product with the output weights: executors get that table (``BUCKETS`` * 3 floats) and read
every whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, column, table, whole_row

BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 8, 5, 4.0
#: Bounds of the training sample; whole texts only, none longer than ``1 / SHARE`` of the bytes.
MAX_ROWS, MAX_BYTES, SHARE = 4000, 12 << 20, 32
FOLDS, THRESHOLD = 5, 0.3
#: Bytes of a text whose features are formed at a time.
STEP = 1 << 17
#: Feature buckets of marks: a word that equals the one before it, or the one before that.
MARKS = 2


def features(data: bytes, hasher: WordHasher, step: int = STEP) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, bucket numbers) of the text's features, in parts: a text of any length takes bounded room."""
    b, shift = np.frombuffer(data, np.uint8), np.uint32(32 - (BUCKETS.bit_length() - 1))
    for at in range(0, len(b), step):
        part = b[at : at + step + 3].astype(np.uint32)
        for n in (3, 4):
            m = min(step, len(b) - at - n + 1)  # n-grams that begin here
            if m > 0:
                x = part[:m].copy()
                for i in range(1, n):
                    x |= part[i : m + i] << np.uint32(8 * i)
                x *= np.uint32(0x9E3779B1)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x85EBCA77)
                yield n - 3, (x >> shift) + np.uint32(BUCKETS * (n - 3))
    w = hasher(data)
    if len(w):
        words = MARKS + (w >> np.uint64(33)) % np.uint64(BUCKETS - MARKS)
        marks = [np.full(np.count_nonzero(w[k:] == w[:-k]), k - 1, np.uint64) for k in (1, 2) if len(w) > k]
        yield 2, (np.concatenate([words, *marks]) + np.uint64(2 * BUCKETS)).astype(np.uint32)


def bag(data: bytes, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their weights, which sum to 1; none for a text without features."""
    parts: dict[int, list] = {}
    for kind, ids in features(data, hasher):
        parts.setdefault(kind, []).append(ids)
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    kinds = [np.concatenate(x) for x in parts.values()]
    weight = np.concatenate([np.full(len(k), 1 / (len(k) * len(kinds))) for k in kinds])
    ids, back = np.unique(np.concatenate(kinds), return_inverse=True)
    return ids.astype(np.int32), np.bincount(back, weight).astype(np.float32)


def mean_logit(data: bytes, logit: np.ndarray, hasher: WordHasher) -> float:
    """The mean over the kinds of the mean of their features' logits; 0 for a text without features."""
    sums, n = np.zeros(3), np.zeros(3)
    for kind, ids in features(data, hasher):
        sums[kind] += logit[ids].sum(dtype=np.float64)
        n[kind] += len(ids)
    some = n > 0
    return float((sums[some] / n[some]).mean()) if some.any() else 0.0


def train(texts: list[bytes], labels: list[int], seed: int = 11) -> tuple[np.ndarray, float]:
    """(logit per bucket, bias): the score of a document is the logistic function of its features' mean plus the bias."""
    rng = np.random.default_rng(seed)
    hasher = WordHasher()
    bags = [bag(t, hasher) for t in texts]
    del texts
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (3 * BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (DIM, 2)), np.zeros(2)
    steps, total = 0, EPOCHS * max(1, len(bags))
    for _ in range(EPOCHS if len(set(labels)) > 1 else 0):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - steps / total)
            steps += 1
            ids, weight = bags[i]
            mean = weight @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            down = out @ p
            out -= rate * 0.05 * np.outer(mean, p)
            bias -= rate * 0.01 * p
            # The gradient of a bucket is its weight's share; weights are tiny, so the step is scaled by their number.
            vectors[ids] -= rate * min(len(ids), 400) * 0.05 * weight[:, None] * down
    if len(set(labels)) < 2:  # nothing to tell apart: the share of good rows, smoothed
        good = (sum(labels) + 1) / (len(labels) + 2)
        return np.zeros(3 * BUCKETS, np.float32), float(np.log(good / (1 - good)))
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    """The score of a binary column of texts; only this column goes through Python, each text once."""
    shared, hasher = spark.sparkContext.broadcast(model), WordHasher()  # a fixed size

    def score(body: pa.Array) -> pa.Array:
        logit, bias = shared.value
        scores = []
        for text in body:
            z = bias + mean_logit(text.as_py() or b"", logit, hasher)
            scores.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        return pa.array(scores, pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()  # so that Spark never evaluates it twice


def held_out(doc_id: Column) -> Column:
    """The rows never learned from: crc32 of doc_id as text, modulo 5, is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Learns from the first ``max_rows`` labelled rows in the order of a hash of doc_id, as far as ``max_bytes`` of text go.

    Rows of the held-out fold, null doc_ids, labels other than 0 and 1 and ids with contradicting labels are left out, and so
    are texts longer than ``max_bytes`` / ``SHARE``: the others go on.  Of rows that repeat a doc_id, one of
    each length counts.  If the bytes leave no row of a label, that is an error; without labels, all scores are 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    body = F.coalesce(column(text), F.lit(""))
    # The sample is chosen by sizes alone; only the texts that it holds are fetched then.
    sizes = docs.select(column(doc_id).cast("long").alias("id"), F.octet_length(body).alias("n")).join(F.broadcast(known), "id").distinct()  # at most max_rows rows are broadcast
    seen = sizes.orderBy(F.xxhash64("id"), "id", "n").limit(max_rows).select("id", "n", "y").collect()
    short = [r for r in seen if r["n"] <= max_bytes // SHARE]
    chosen = [tuple(r) for r, total in zip(short, accumulate(r["n"] for r in short)) if total <= max_bytes]
    lost = {r["y"] for r in seen} - {y for *_, y in chosen}
    if lost:
        raise ValueError(f"no text of label {min(lost)} fits the training sample: {max_bytes} bytes in all, {max_bytes // SHARE} for one text")
    chosen = docs.sparkSession.createDataFrame(chosen, "id long, n int, y int")
    rows = docs.select(column(doc_id).cast("long").alias("id"), body.cast("binary").alias("body")).withColumn("n", F.length("body")).join(F.broadcast(chosen), ["id", "n"])
    got = rows.groupBy("id", "n", "y").agg(F.min_by("body", F.xxhash64("body")).alias("body")).orderBy(F.xxhash64("id"), "id", "n").select("body", "y").toArrow()
    return train(got.column(0).to_pylist(), got.column(1).to_pylist())


def classify(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """(row, score): every row as a struct with its score from its text alone; null counts as empty."""
    body = F.coalesce(column(text), F.lit("")).cast("binary")
    return docs.select(whole_row(docs).alias("row"), scorer(docs.sparkSession, model)(body).alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels"))).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, with all their columns as they are.

    Every row is judged by its own text, repeated rows alike, a null text as an empty one; an empty table gives one.  Without any
    labels nothing is rejected.
    """
    return classify(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")
