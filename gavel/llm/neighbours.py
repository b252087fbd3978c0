"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Fit (driver, numpy, a bounded sample of ``SAMPLE`` rows): coarse centroids by k-means, then a codebook for each
subspace of the residuals; then the number of cells to probe: the fewest that hold ``COVER`` of the true neighbours of a few
of the sample's rows within the sample, so that it follows how clustered the vectors are.  Index (every row): the nearest centroid's cell, the residual's codes, the vector itself.
Search: a query visits its best cells; there, asymmetric distance tables (query against codewords) rank all
codes, and the best ``rerank`` of each block, with all that tie with the last, are scored exactly in double precision; blocks'
best are merged per query.

Equal vectors are one row of the index, with their k + 1 smallest distinct ids: no others can be among the k nearest (one
may be the query's own).  So copies, however many and wherever they lie, take one place of the rerank and tie by id.

Skew: cells are cut into blocks of at most about ``CELL_ROWS`` rows and their visitors into blocks of ``VISITORS``; copies are
thinned in each batch before they meet in one task.  Vectors null, zero, of another dimension than most, or holding null or
non-finite components take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, column, table

SAMPLE, SUBSPACES, CODEWORDS, RERANK = 32768, 32, 256, 512
#: Cells: about the square root of the rows, at most MAX_CELLS; blocks have about CELL_ROWS rows and VISITORS queries.
CELL_ROWS, VISITORS, MAX_CELLS, COVER = 4096, 1024, 4096, 0.95


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            sums = np.bincount(near, x[:, j], k)
            centres[:, j] = np.where(count > 0, sums / np.maximum(count, 1), centres[:, j])
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Model:
    """Coarse centroids, and codewords by subspace (padded with zero columns to a multiple of the subspaces)."""

    def __init__(self, sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres = kmeans(sample, cells, 12, rng)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.dim, self.m = sample.shape[1], min(subspaces, sample.shape[1])
        self.width = -(-self.dim // self.m)
        few = residual[rng.permutation(len(residual))[:8192]]
        self.words = [kmeans(s, codewords, 8, rng) for s in self.split(few)]
        self.probes = self.calibrate(sample, rng)

    def calibrate(self, sample: np.ndarray, rng: np.random.Generator, queries: int = 256, k: int = 20) -> int:
        asked = rng.permutation(len(sample))[:queries]
        score = sample[asked] @ sample.T
        score[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return len(self.centres)
        true = nearest(sample, self.centres)[np.argpartition(-score, k - 1, axis=1)[:, :k]]
        rank = np.argsort(np.argsort(-(sample[asked] @ self.centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, true, 1).ravel())
        return int(needed[int(np.ceil(COVER * len(needed))) - 1]) + 1

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        padded = np.pad(x, ((0, 0), (0, self.m * self.width - x.shape[1])))
        return [padded[:, i * self.width : (i + 1) * self.width] for i in range(self.m)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        parts = self.split(x - self.centres[cell])
        return cell, np.stack([nearest(p, w) for p, w in zip(parts, self.words)], 1).astype(np.uint8)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _thinner(dim: int, keep: int):
    """Each distinct vector of a batch, as bytes, with its ``keep`` smallest distinct ids; a negative zero counts as zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = np.ascontiguousarray(_matrix(batch.column(1), dim) + 0.0), batch.column(0).to_numpy()
            _, first, same = np.unique(x.view([("", np.void, dim * 8)]).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([same.ravel(), ids], 1), axis=0)  # sorted by vector, then id
            start = np.searchsorted(pairs[:, 0], np.arange(len(first)))
            pairs = pairs[np.arange(len(pairs)) - start[pairs[:, 0]] < keep]
            offsets = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs[:, 1])), pa.array([v.tobytes() for v in x[first]], pa.binary())], names=["vec_ids", "vector"])

    return run


def _indexer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, codes = m.encode(np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, m.dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "vec_ids", "vector", "code"])

    return run


def _visitor(model, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _matrix(batch.column(1), m.dim) @ m.centres.T
            p = min(probes, score.shape[1])
            cells = np.argpartition(-score, p - 1, axis=1)[:, :p]
            row = np.repeat(np.arange(len(score)), p)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["cell", "query_id", "query"])

    return run


def _searcher(model, k: int, rerank: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return empty
        m = model.value
        count = rows["vec_ids"].map(len).to_numpy()
        ids, start = np.concatenate(rows["vec_ids"].to_numpy()), np.cumsum(count) - count
        alone = np.where(count == 1, ids[start], -1)
        most = int(np.unique(ids, return_counts=True)[1].max())  # vectors of one id
        x = np.frombuffer(b"".join(rows["vector"])).reshape(len(rows), m.dim)
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), m.m)
        q_ids, q = queries["query_id"].to_numpy(), np.stack(queries["query"].to_numpy()).astype(np.float64)
        centre = m.centres[int(rows["cell"].iloc[0])]
        out = []
        for i in range(0, len(q), 64):
            part = q[i : i + 64]
            approx = np.repeat((part @ centre)[:, None], len(x), 1).astype(np.float32)
            for s, (piece, words) in enumerate(zip(m.split(part), m.words)):
                approx += (piece @ words.T).astype(np.float32)[:, codes[:, s]]  # the asymmetric distance table of a subspace
            approx[(q_ids[i : i + 64, None] == alone[None, :]) & (count == 1)] = -np.inf
            r = min(rerank * most, len(x))  # so that ``rerank`` ids are scored
            cut = np.partition(approx, len(x) - r, axis=1)[:, len(x) - r]
            for j in range(len(part)):
                best = np.flatnonzero(approx[j] >= cut[j])  # with all that tie at the cut
                n = count[best]
                near = ids[np.repeat(start[best] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.repeat(np.einsum("rd,d->r", x[best], part[j]), n)
                other = near != q_ids[i + j]
                near, score = near[other], score[other]
                top = np.lexsort((near, -score))
                if most > 1:  # an id counts once, by its best score
                    top = top[np.sort(np.unique(near[top], return_index=True)[1])]
                top = top[:k]
                out.append((np.full(len(top), q_ids[i + j]), near[top], score[top]))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", probes: int | None = None, rerank: int = RERANK, cells: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (a Column of ``vec_id``) holds.

    A row is no candidate of a query with its own id.  Rows without an id take no part; rows that repeat an id count
    once for each query, by their best score.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession, "neighbours")
    rows = vectors.select(column(vec_id).cast("long").alias("vec_id"), column(embedding).cast("array<double>").alias("vector"))
    fit = "vec_id is not null and vector is not null and size(vector) > 0 and exists(vector, v -> v != 0) and forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('inf'))"
    rows = rows.where(F.coalesce(F.expr(fit), F.lit(False)))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, n = dims[0]["d"], dims[0]["count"]
    rows = rows.where(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    cells = cells or int(np.clip(round(n**0.5), 1, MAX_CELLS))
    model = Model(np.unique(_matrix(sample.column(0).combine_chunks(), dim), axis=0), cells)  # copies would crowd the calibration
    probes = probes or model.probes
    model = spark.sparkContext.broadcast(model)  # MAX_CELLS centroids, CODEWORDS codewords
    distinct = rows.mapInArrow(_thinner(dim, k + 1), "vec_ids array<long>, vector binary").groupBy("vector").agg(F.collect_list("vec_ids").alias("vec_ids"))
    distinct = distinct.select(F.expr(f"slice(array_sort(array_distinct(flatten(vec_ids))), 1, {k + 1})").alias("vec_ids"), "vector")
    index = work.write(distinct.mapInArrow(_indexer(model), "cell int, vec_ids array<long>, vector binary, code binary"))
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "vector"])
    visits = work.write(queries.mapInArrow(_visitor(model, probes), "cell int, query_id long, query array<double>"))
    # Blocks of each cell and of its visitors: at most MAX_CELLS rows.
    counts = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("v")), "cell")
    counts = F.broadcast(counts.select("cell", F.expr(f"cast(ceil(n / {CELL_ROWS}) as int)").alias("row_blocks"), F.expr(f"cast(ceil(v / {VISITORS}) as int)").alias("visit_blocks")))
    left = visits.join(counts, "cell").withColumn("vb", F.expr("cast(pmod(xxhash64(query_id), visit_blocks) as int)")).withColumn("rb", F.explode(F.expr("sequence(0, row_blocks - 1)")))
    right = index.join(counts, "cell").withColumn("rb", F.expr("cast(pmod(xxhash64(vector), row_blocks) as int)")).withColumn("vb", F.explode(F.expr("sequence(0, visit_blocks - 1)")))
    keys = ["cell", "rb", "vb"]
    found = left.select(*keys, "query_id", "query").groupBy(*keys).cogroup(right.select(*keys, "vec_ids", "vector", "code").groupBy(*keys)).applyInPandas(_searcher(model, k, rerank), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
