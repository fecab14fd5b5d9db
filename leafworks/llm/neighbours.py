"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, small_batches, table, written

#: Rows that rotations and the number of substrings are fitted on at most: those with the least hashed ids. Sample rows used as queries for it.
SAMPLE_ROWS, FIT_QUERIES = 10_000, 200
#: Most substrings of an index, and the share of near rows that they are to reach.
MOST_TABLES, REACHED = 600, 0.95
#: Rows of a shard of the index, about, queries that are put to it at once, and bytes of the vectors of a broadcast block of queries, about.
SHARD_ROWS, QUERY_BLOCK, BLOCK_BYTES = 16_000, 1_000, 32 << 20


@dataclass
class CodeModel:
    """Signs of (x - mean) under learned rotations are a vector's bits; each run of `bits` of them is one substring of its code."""

    mean: np.ndarray
    rotations: np.ndarray
    bits: int
    tables: int

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """One row of numbers, a number for each substring, for every vector."""
        out = np.empty((len(x), self.tables), dtype=np.int32)
        weight, whole = (1 << np.arange(self.bits)).astype(np.float32), self.tables * self.bits
        for a in range(0, len(x), 1024):
            signs = np.concatenate([(x[a : a + 1024] - self.mean) @ r > 0 for r in self.rotations], axis=1)[:, :whole]
            out[a : a + 1024] = (signs.reshape(len(signs), self.tables, self.bits) @ weight).astype(np.int32)
        return out


def _iterative_quantisation(x: np.ndarray, rng: np.random.Generator, rounds: int = 2) -> np.ndarray:
    """The rotation that brings principal components closest to their signs, from a random start."""
    _, _, axes = np.linalg.svd(x.T @ x)
    v = x @ axes.T
    r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return axes.T @ r


def probes(bits: int, reach: int) -> np.ndarray:
    """The masks that flip up to reach of the bits."""
    return np.array([sum(1 << b for b in flipped) for n in range(reach + 1) for flipped in itertools.combinations(range(bits), n)], dtype=np.int32)


#: Bits by which a substring may differ from the query's to be probed.
REACH = 2


def fit(x: np.ndarray, k: int = 10, seed: int = 7) -> CodeModel:
    """Substrings of about 6 bits more than it takes to number the rows (8 to 20), and so many of them that REACHED of the sample's
    near rows share one with the query but for REACH bits. Where MOST_TABLES of them don't reach so many, they have two bits less, down to 4. The whole table's neighbours are nearer than the sample's, so their number errs to the larger side.
    """
    rng = np.random.default_rng(seed)
    mean, size = x.mean(axis=0), x.shape[1]
    learn = x[rng.permutation(len(x))[:1000]] - mean
    asked = rng.permutation(len(x))[:FIT_QUERIES]
    near = []
    for q in asked.tolist():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near.append(np.argsort(d, kind="stable")[: min(k, len(x) - 1)])
    kept = np.unique(np.concatenate([asked, *near])) if len(x) else asked
    bits = int(np.clip(math.ceil(math.log2(max(len(x), 2))) + 6, 8, 20))
    rotations = np.stack([_iterative_quantisation(learn, rng) for _ in range(math.ceil(MOST_TABLES * bits / size))])
    while True:
        model = CodeModel(mean, rotations[: math.ceil(MOST_TABLES * bits / size)], bits, MOST_TABLES)
        if len(x) < 2:
            return model
        codes = model.substrings(x[kept])
        first = []
        for q, found in zip(np.searchsorted(kept, asked).tolist(), near, strict=True):
            hit = np.bitwise_count(codes[np.searchsorted(kept, found)] ^ codes[q]) <= REACH
            first.append(np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_TABLES))
        wanted = int(np.quantile(np.concatenate(first), REACHED, method="higher")) + 1
        if wanted <= MOST_TABLES or bits <= 4:
            model.tables = min(wanted, MOST_TABLES)
            model.rotations = rotations[: math.ceil(model.tables * bits / size)]
            return model
        bits -= 2


class MultiIndex:
    """One shard's index: for each substring the rows in the order of their value there, and where each value begins."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)

    def retrieved(self, queries: np.ndarray, reach: int) -> np.ndarray:
        """Which rows each query retrieves: those in any bucket that its own value leads to by flipping up to reach bits.

        By the pigeonhole principle these hold every row whose code, of m substrings, is within m * (reach + 1) - 1 bits of the query's.
        """
        found = np.zeros((len(queries), len(self.codes)), dtype=bool)
        masks = probes(self.bits, reach)
        for j in range(self.codes.shape[1]):
            begins = np.concatenate([[0], np.cumsum(np.bincount(self.codes[:, j], minlength=1 << self.bits), dtype=np.int32)])
            value = queries[:, j, None] ^ masks
            lo, n = begins[value], begins[value + 1] - begins[value]
            query, probe = np.nonzero(n)
            at, size = lo[query, probe], n[query, probe]
            found[np.repeat(query, size), self.order[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum()), j]] = True
        return found


def search(model: CodeModel, rows: tuple[np.ndarray, np.ndarray], queries: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's number, ids, distances) of the k nearest rows that each query retrieves. rows, queries: ids and vectors.

    Only retrieved rows are measured. A query that retrieves fewer than k rows of other ids probes further bits, and in the end every bucket.
    """
    (ids, x), (own, q) = rows, queries
    index, codes = MultiIndex(model.substrings(x), model.bits), model.substrings(q)
    open_, reach = np.arange(len(q)), REACH
    while len(open_):
        found = index.retrieved(codes[open_], reach) if reach <= REACH + 1 else np.ones((len(open_), len(x)), dtype=bool)
        left = []
        for i, hit in zip(open_.tolist(), found, strict=True):
            at = np.flatnonzero(hit)
            at = at[ids[at] != own[i]]
            if len(at) < k and reach <= REACH + 1:
                left.append(i)
                continue
            d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], d))[:k]
            yield i, ids[at][best], d[best]
        open_, reach = np.array(left, dtype=np.int64), reach + 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


SHARD = "length int, n int, ids binary, vectors binary"


def _packed(rows: pa.Table) -> pa.Table:
    """One row of a shard's ids and vectors."""
    ids, x = rows.column("id").to_numpy(), _matrix(rows.column("vector"))
    return pa.table([pa.array([x.shape[1]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["length", "n", "ids", "vectors"])


class Nearest:
    """The k nearest rows seen of each of a block's queries: distances and ids, nearest first, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.d, self.ids = [np.zeros(0)] * queries, [np.zeros(0, dtype=np.int64)] * queries

    def add(self, i: int, ids: np.ndarray, d: np.ndarray) -> None:
        ids, d = np.concatenate([self.ids[i], ids]), np.concatenate([self.d[i], d])
        best = np.lexsort((ids, d))[: self.k]
        self.ids[i], self.d[i] = ids[best], d[best]


def _search(model: CodeModel, asked, k: int):
    """Puts a broadcast block of queries (row, id, vector) of one length to each shard that a task gets: an index is built once a shard, and what was found in one is carried on to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own, q = asked.value
        best = Nearest(len(row), k)
        for batch in batches:
            for n, ids, vectors in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                held = np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=np.float64).reshape(n, -1)
                for a in range(0, len(row), QUERY_BLOCK):
                    for i, near, d in search(model, held, (own[a : a + QUERY_BLOCK], q[a : a + QUERY_BLOCK]), k):
                        best.add(a + i, near, d)
        size = [len(x) for x in best.ids]
        columns = [np.repeat(row, size), np.repeat(own, size), *(np.concatenate([np.zeros(0, dtype=t), *x]) for t, x in ((np.int64, best.ids), (np.float64, best.d)))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector and length of the rows that take part: an id, and a vector of finite components that aren't all zero."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    rows = rows.where("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    return rows.withColumn("length", F.size("vector"))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query row, by Euclidean distance on the original vectors.

    is_query: a condition on the column id. Rotations and the number of substrings are fitted on at most SAMPLE_ROWS rows; every row is indexed. Rows are dealt once, by hash, into shards of about SHARD_ROWS, a row each of a written
    table. Queries go to them in blocks of BLOCK_BYTES, broadcast; for each block a shard's index is built once, and a task answers the k best of all its shards, so what is shuffled for a block is the rows once in all, and k rows a
    query and task. A hash deals equal vectors evenly, however many there are.

    Null, zero or non-finite vectors and null ids take no part. Vectors of other lengths are other spaces: each length is
    searched by itself. Rows with equal ids are all candidates of other ids' queries, none of their own, and each such query row is answered. Ties go to the
    smaller id. Fewer than k candidates: all of them. No rows: no rows. Returns query_id, rank (from 1), vec_id, score.
    """
    small_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    sample = rows.orderBy(F.xxhash64("id"), "vector").limit(SAMPLE_ROWS).toArrow()
    known = sample.column("length").to_numpy()
    found = None
    with Scratch(vectors.sparkSession) as keep:
        queries = keep.write(rows.where(is_query).withColumn("row", F.monotonically_increasing_id()))
        sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
        wanted = {r["length"]: r["n"] for r in queries.groupBy("length").agg(F.count("*").alias("n")).collect()}
        counts = F.create_map(*[F.lit(x) for length, n in sizes.items() for x in (length, max(1, math.ceil(n / SHARD_ROWS)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), counts[F.col("length")]))
        shards = keep.write(dealt.groupBy("length", "shard").applyInArrow(_packed, SHARD))
        spread = vectors.sparkSession.sparkContext.defaultParallelism
        for length in sorted(wanted):
            own = sample.filter(pa.array(known == length)) if (known == length).any() else rows.where(F.col("length") == length).orderBy(F.xxhash64("id"), "vector").limit(SAMPLE_ROWS).toArrow()
            model = fit(_matrix(own.column("vector")), k)
            mine = shards.where(F.col("length") == length)
            # a task's shards come in turn; more tasks than there are places at once would only repeat answers
            mine = mine.repartition(max(1, min(math.ceil(sizes[length] / SHARD_ROWS), 4 * spread)))
            blocks = max(1, math.ceil(wanted[length] * length * 8 / BLOCK_BYTES))
            for b in range(blocks):
                block = queries.where((F.col("length") == length) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "vector").toArrow()
                if len(block):
                    asked = vectors.sparkSession.sparkContext.broadcast((block.column("row").to_numpy(), block.column("id").to_numpy(), _matrix(block.column("vector"))))
                    part = written(mine.mapInArrow(_search(model, asked, k), "row long, query_id long, vec_id long, score double"))
                    found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select(F.col("id").alias("row"), F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
