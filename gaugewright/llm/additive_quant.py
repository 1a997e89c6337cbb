"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one full-dimensional codeword from each codebook. Codebooks are fitted to the
residuals of a bounded sample; encoding keeps a beam of the best partial sums, not only the best one. What is stored per
vector is one byte per codebook and the norm of its approximation. A query makes one table of its products with all
codewords; a vector's score is the sum of the looked-up entries by the stored norm. The best of these are ranked again by
the exact cosine of the original vectors.

The queries are a stated set against all rows: they are taken in blocks of bounded size, each block is sent to the tasks
that hold the codes, and every task hands on the best few of each query, so what moves is (queries x tasks x few) rows.
These are merged in a tree of steps, so no task gets more than FAN tasks' best of a query.

A row is told by its id and a hash of its vector: a query leaves out its own row only. Defined results: vectors that are
null, zero, or hold null or non-finite components take no part, nor do those whose length differs from that of the most;
ties in the exact cosine go to the smaller id; equal vectors under different ids are each a row; exact repeats of a row
(id and vector) count once; rows with one id and different vectors are each a row, and as queries each has its own ranks;
fewer candidates than asked for are all returned; an empty table gives no rows; other columns, also ones named like the
result's, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

CODEBOOKS = 32
CODEWORDS = 256
BEAM = 4
#: Vectors that the codebooks are fitted to, at most.
SAMPLE = 8192
#: Candidates per query that are ranked exactly.
RERANK = 200
#: Queries that are sent to the tasks together.
BLOCK = 2048
_ROWS = 8192
#: Tasks whose best of a query are merged in one step.
FAN = 64


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Codebooks (codebooks, codewords, dimensions) by k-means on what the ones before leave of the sample."""
    rng = np.random.default_rng(seed)
    k = max(1, min(codewords, len(x)))
    books = np.zeros((codebooks, k, x.shape[1]), np.float32)
    rest = x.astype(np.float32)
    for m in range(codebooks):
        centers = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = ((centers**2).sum(1)[None] - 2 * rest @ centers.T).argmin(1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(centers)
            np.add.at(total, near, rest)
            centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), k)])
        books[m] = centers
        rest = rest - centers[((centers**2).sum(1)[None] - 2 * rest @ centers.T).argmin(1)]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, codebooks) of the best sums that a beam search finds, and the norms of these sums."""
    m, k, d = books.shape
    n = len(x)
    width = 1
    sums, codes = np.zeros((n, 1, d), np.float32), np.zeros((n, 1, 0), np.uint8)
    for book in books:
        rest = x[:, None, :] - sums
        error = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)[None, None]
        flat = error.reshape(n, -1)
        now = min(beam, flat.shape[1])
        best = np.argpartition(flat, now - 1, axis=1)[:, :now]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        parent, word = best // k, best % k
        sums = np.take_along_axis(sums, parent[:, :, None], 1) + book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        width = now
    del width
    return codes[:, 0], np.sqrt((sums[:, 0] ** 2).sum(1))


def looked_up(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Approximate cosines (queries, vectors): sums of table entries by the stored norms."""
    table = np.einsum("qd,mkd->mkq", queries.astype(np.float32), books)
    out = np.zeros((len(codes), len(queries)), np.float32)
    for m in range(len(books)):
        out += table[m][codes[:, m]]
    return (out / np.maximum(norms, 1e-12)[:, None]).T


def valid(vector: Column, size: int) -> Column:
    """Vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def dot(a: Column, b: Column) -> Column:
    """Inner product, components added in their order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very small or large components stay finite
    return (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)


def _encoder(box, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = box.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                codes, norms = encode(_unit(_matrix(part.column(1), size)), books)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))], ["vec_id", "mark", "codes", "norm"])

    return run


def _scorer(books_box, block_box, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (ids, marks, queries) = books_box.value, block_box.value
        best_score = np.full((len(ids), 0), 0, np.float32)
        best_id = best_mark = np.zeros((len(ids), 0), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                vec, mark = part.column(0).to_numpy(), part.column(1).to_numpy()
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)
                score = looked_up(queries, books, codes, part.column(3).to_numpy())
                score[(ids[:, None] == vec[None, :]) & (marks[:, None] == mark[None, :])] = -np.inf
                score = np.concatenate([best_score, score], 1)
                every = np.concatenate([best_id, np.broadcast_to(vec, (len(ids), len(vec)))], 1)
                marked = np.concatenate([best_mark, np.broadcast_to(mark, (len(ids), len(vec)))], 1)
                if score.shape[1] > keep:
                    order = np.lexsort((every, -score), axis=1)[:, :keep] if score.shape[1] <= 4 * keep else _best(score, every, keep)
                    score, every, marked = (np.take_along_axis(x, order, 1) for x in (score, every, marked))
                best_score, best_id, best_mark = score, every, marked
        ok = np.isfinite(best_score)
        rows = np.nonzero(ok)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(marks[rows]), pa.array(best_id[ok]), pa.array(best_mark[ok]), pa.array(best_score[ok])], ["query_id", "query_mark", "vec_id", "mark", "approx"])

    return run


def _merged(near: DataFrame, keep: int, parts: int) -> DataFrame:
    """The ``keep`` best candidates of each query, from those of ``parts`` tasks (column part)."""
    while True:
        parts = -(-parts // FAN)
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("approx")).alias("a"), "vec_id", "mark"))), 1, keep)
        near = near.groupBy("query_id", "query_mark", F.pmod("part", F.lit(parts)).alias("part")).agg(best.alias("c"))
        near = near.select("query_id", "query_mark", "part", F.explode("c").alias("c")).select("query_id", "query_mark", "part", "c.vec_id", "c.mark", (-F.col("c.a")).alias("approx"))
        if parts == 1:
            return near.select("query_id", "query_mark", "vec_id", "mark")


def _best(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest scores of each row, ties to the smaller id."""
    out = np.empty((len(score), keep), np.int64)
    for r in range(len(score)):
        cut = np.partition(score[r], -keep)[-keep]
        at = np.flatnonzero(score[r] >= cut)
        out[r] = at[np.lexsort((ids[r, at], -score[r, at]))[:keep]]
    return out


def search(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows of each query row by cosine: query_id, rank (from 1), vec_id, score."""
    spark = df.sparkSession
    slim = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("is_query")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    sizes = slim.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes or not sizes[0]:
        return empty
    size = sizes[0]
    rows = slim.where(valid(F.col("v"), size)).withColumn("mark", F.xxhash64("v"))
    n = rows.count()
    if n < 2:
        return empty
    some = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n)) + 1).select("v").limit(2 * sample)
    fitted_on = np.asarray(some.toArrow()["v"].combine_chunks().flatten()).reshape(-1, size)
    if len(fitted_on) == 0:
        return empty
    books = fit(_unit(fitted_on))
    box = spark.sparkContext.broadcast(books)  # codebooks of fixed size
    coded = mapped(rows.select("vec_id", "v", "mark"), _encoder(box, size), "vec_id long, mark long, codes binary, norm float")
    codes, _ = written(coded.dropDuplicates(["vec_id", "mark"]), "codes")
    parts = codes.rdd.getNumPartitions()
    asked = rows.where("is_query").select("vec_id", "mark", "v").dropDuplicates(["vec_id", "mark"])
    blocks = max(1, -(-asked.count() // block))
    number = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks))
    found = []
    for i in range(blocks):  # about ``block`` queries each, so what is sent stays bounded
        part = asked.where(number == i).toArrow()
        if not part.num_rows:
            continue
        ids, marks = part["vec_id"].combine_chunks().to_numpy(), part["mark"].combine_chunks().to_numpy()
        query = _unit(np.asarray(part["v"].combine_chunks().flatten()).reshape(-1, size))
        near = mapped(codes, _scorer(box, spark.sparkContext.broadcast((ids, marks, query)), rerank), "query_id long, query_mark long, vec_id long, mark long, approx float")
        near = _merged(near.withColumn("part", F.spark_partition_id()), rerank, parts)
        found.append(written(near, "near")[0] if blocks > 1 else near)
    if not found:
        return empty
    pairs = reduce(DataFrame.union, found)
    vectors = rows.select("vec_id", "mark", "v")
    joined = pairs.join(vectors, ["vec_id", "mark"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("mark").alias("query_mark"), F.col("v").alias("q")), ["query_id", "query_mark"])
    cosine = dot(F.col("v"), F.col("q")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    scored = joined.select("query_id", "query_mark", "vec_id", "mark", cosine.alias("score"))
    # exact repeats of a row come once: sets, not lists (at most ``rerank`` different ones)
    best = scored.groupBy("query_id", "query_mark").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id", "mark", "score"))), 1, k).alias("c"))
    out = best.select("query_id", F.posexplode("c").alias("rank", "c"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "c.vec_id", "c.score")
