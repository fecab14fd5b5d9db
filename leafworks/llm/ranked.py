"""Ranked lexical search: exact inner products by ball trees over sparse document vectors."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, small_batches, table, written
from .words import NOT_ALNUM, Words, utf8

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Results of an item.
TOP = 50
#: Items and different terms of a block of queries; numbers of a tree's matrix, documents of a leaf, terms of a ball, leaves scored together, dimensions that a split looks at.
ITEMS, VOCABULARY = 1000, 8192
CELLS, LEAF, BALL, TOGETHER, SHADOW = 1 << 23, 8, 8, 8, 32


def terms(text: str | None) -> list[str]:
    return TERMS.findall((text or "").encode().lower().decode())


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """The items with terms, so many at a time that a block has ITEMS items and VOCABULARY different terms at most (a longer item is a block alone). The driver holds one block."""
    block, known = [], set()
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).distinct().toLocalIterator():
        if own := sorted(set(terms(row.text))):
            if block and (len(block) == ITEMS or len(known | set(own)) > VOCABULARY):
                yield block
                block, known = [], set()
            block.append((row.item_id, own))
            known |= set(own)
    if block:
        yield block


class Vocabulary:
    """Numbers of the words of a batch that are among the terms, found by one hash and confirmed by another."""

    def __init__(self, names: list[str]):
        w = Words(*utf8(pa.array(names, pa.string())), NOT_ALNUM)
        h = w.hashes()
        self.number = np.argsort(h)
        self.first, self.second = h[self.number], w.hashes(seed=1)[self.number]
        self.small = np.zeros(1 << 20, dtype=bool)
        self.small[(self.first & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which terms."""
        h = w.hashes(lower=True)
        perhaps = np.flatnonzero(self.small[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.first, h[perhaps]), len(self.first) - 1)
        same = self.first[at] == h[perhaps]
        perhaps, at = perhaps[same], at[same]
        same = w.only(perhaps).hashes(lower=True, seed=1) == self.second[at]
        return perhaps[same], self.number[at[same]]


def _vectors(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, n (all terms with repeats), term and tf (lists of the terms among names) of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(names)
        for batch in batches:
            w = Words(*utf8(batch.column(1)), NOT_ALNUM)
            word, number = vocabulary.find(w)
            kinds, tf = np.unique(w.text_of()[word] * len(names) + number, return_counts=True)
            ends = np.searchsorted(kinds, np.arange(len(w.count) + 1) * len(names)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (kinds % len(names), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.count, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"]).filter(pa.array(w.count > 0))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class BallTree:
    """A tree over the rows of a matrix of documents and terms. A node keeps its rows' centroid, of each BALL consecutive terms the radius around it, each term's largest value and the least doc_id.

    Splits look at SHADOW random directions only; what bounds rest on is computed from all terms.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        shadow = rows @ np.random.default_rng(11).standard_normal((rows.shape[1], SHADOW)).astype(np.float32)
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        order: list[np.ndarray] = []
        self._split(np.arange(len(rows)), shadow, order, 0)
        perm = np.concatenate(order)
        self.rows, self.ids = rows[perm], ids[perm]
        self._bounds()

    def _split(self, idx: np.ndarray, shadow: np.ndarray, order: list[np.ndarray], start: int) -> int:
        me = len(self.children)
        self.children.append(None)
        self.span.append((start, start + len(idx)))
        if len(idx) <= LEAF:
            order.append(idx)
            return me
        x = shadow[idx]
        a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        by, half = np.argsort(x @ (b - a), kind="stable"), len(idx) // 2
        left = self._split(idx[by[:half]], shadow, order, start)
        self.children[me] = (left, self._split(idx[by[half:]], shadow, order, start + half))
        return me

    def _bounds(self) -> None:
        n, wide = len(self.children), self.rows.shape[1]
        edges = np.arange(0, wide, BALL)
        self.centroid, self.most = np.zeros((n, wide)), np.zeros((n, wide))
        self.radius, self.least = np.zeros((n, len(edges))), np.zeros(n, dtype=np.int64)
        apart = lambda x, c: np.sqrt(np.add.reduceat((x - c) ** 2, edges, axis=1))
        for i in range(n - 1, -1, -1):  # children have larger numbers than their parents
            a, b = self.span[i]
            self.least[i] = self.ids[a:b].min()
            if (pair := self.children[i]) is None:
                x = self.rows[a:b].astype(np.float64)
                self.centroid[i], self.most[i] = x.mean(axis=0), x.max(axis=0)
                self.radius[i] = apart(x, self.centroid[i]).max(axis=0)
            else:
                p = list(pair)
                size = np.array([self.span[j][1] - self.span[j][0] for j in p], dtype=np.float64)
                self.centroid[i], self.most[i] = size @ self.centroid[p] / size.sum(), self.most[p].max(axis=0)
                self.radius[i] = (apart(self.centroid[p], self.centroid[i]) + self.radius[p]).max(axis=0)

    def limits(self, weights: np.ndarray) -> np.ndarray:
        """No row of a node has a larger inner product with a query (its whole part): that of the centroid and, for each ball, radius times the query's norm there, or that of the largest values, if less. Rounded up by more than sums of so many doubles can be off."""
        edges = np.arange(0, weights.shape[1], BALL)
        norm = np.sqrt(np.add.reduceat(weights * weights, edges, axis=1))
        balls = self.centroid @ weights.T + self.radius @ norm.T
        up = 1 + (4 * weights.shape[1] + 64) * 2.0**-52
        return np.floor(np.minimum(balls, self.most @ weights.T) * up).astype(np.int64)


class Best:
    """The TOP rows seen of one query: scores, highest first, and doc_ids, least first among equals."""

    def __init__(self):
        self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def hopeless(self, limit: int, least: int) -> bool:
        if limit <= 0:
            return True
        if len(self.score) < TOP:
            return False
        return limit < self.score[-1] or (limit == self.score[-1] and least > self.ids[-1])

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:TOP]
        order = order[score[order] > 0]
        self.score, self.ids = score[order], ids[order]


def search(tree: BallTree, queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> int:
    """Adds each query's best rows of the tree; queries are terms and their weights. Nodes are taken by their limit, highest first, until none can matter; leaves are scored in whole numbers. Returns how many rows were scored."""
    weights = np.zeros((len(queries), tree.rows.shape[1]))
    for i, (term, w) in enumerate(queries):
        weights[i, term] = w
    limits, scored = tree.limits(weights), 0
    for i, (term, w) in enumerate(queries):
        mine, limit = best[i], limits[:, i]
        heap = [(-int(limit[0]), 0)]
        while heap:
            rows: list[int] = []
            while heap and len(rows) < TOGETHER * LEAF:
                top, node = heapq.heappop(heap)
                if mine.hopeless(-top, tree.least[node]):
                    continue
                if (pair := tree.children[node]) is None:
                    rows.extend(range(*tree.span[node]))
                else:
                    for j in pair:
                        heapq.heappush(heap, (-int(limit[j]), j))
            if rows:
                mine.add(tree.rows[np.ix_(rows, term)].astype(np.int64) @ w, tree.ids[rows])
                scored += len(rows)
    return scored


def _impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


#: Stands for a null doc_id: after all others.
NO_ID = np.iinfo(np.int64).max


def _searched(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, documents: int, length: int) -> DataFrame:
    """query, doc_id, score of each task's best documents. A task makes one tree after another of as many documents as CELLS allows, and carries on what it has found."""
    wide = len(place)
    most = max(LEAF, CELLS // wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in queries]
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                size = part.column(2).value_lengths().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), size)
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                rows = np.zeros((part.num_rows, wide), dtype=np.float32)  # values are under 2^20: exact
                rows[owner, place[part.column(2).flatten().to_numpy()]] = _impacts(tf, part.column(1).to_numpy()[owner], documents, length)
                search(BallTree(rows, part.column(0).fill_null(int(NO_ID)).to_numpy()), queries, best)
        number = np.repeat(np.arange(len(queries)), [len(b.score) for b in best])
        ids, score = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in ([b.ids for b in best], [b.score for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long")


def _first(found: DataFrame) -> DataFrame:
    """The TOP of each query, first of each of 64 parts, then of these."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= TOP)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= TOP)


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of each item by the sum over its different terms of weight times impact, in whole numbers.

    Documents become vectors of the terms that a block of items has (other terms add nothing), written once a block. Every task builds ball trees of its documents and searches them for all items of the block.

    Null or empty text, or one without terms: not a document, no item. Rows with equal doc_id are ranked apart, a null doc_id after others of its score. Equal items (id and text) are searched once; items of one id with
    different texts each get their ranks. Fewer documents above 0 than TOP: all. Extra columns are ignored. doc_id is a whole number.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items):
        small_batches(spark)
        names = sorted({t for _, own in block for t in own})
        with Scratch(spark) as keep:
            vectors = keep.write(_vectors(docs, names))
            documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
            if not documents:
                continue
            df = np.zeros(len(names), dtype=np.int64)
            for r in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # a row for each term of the block at most
                df[r["t"]] = r["count"]
            place = np.empty(len(names), dtype=np.int64)
            place[np.argsort(-df, kind="stable")] = np.arange(len(names))  # terms of one ball are about as frequent
            weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
            number = {t: i for i, t in enumerate(names)}
            at = [np.array([number[t] for t in own]) for _, own in block]
            small_batches(spark, max(LEAF, CELLS // len(names)))
            best = written(_first(_searched(vectors, [(place[x], weight[x]) for x in at], place, documents, length)))
        kind = items.schema["item_id"].dataType.simpleString()
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query long, item_id {kind}")
        rows = best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    small_batches(spark)
    if out is None:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
q AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
v AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS s FROM f JOIN q USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM i JOIN v USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
