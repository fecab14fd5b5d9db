"""Toxicity by class-conditional Kneser-Ney models of words' letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import small_batches, table, written
from .words import LOWER, NOT_ALNUM, U64, Words, counting, utf8

#: Bytes of a gram: one predicted byte after up to five of the same word.
ORDER = 6
#: Marks of a word's start and end inside grams; letters never have these bytes.
START, END = 2, 1
#: Words of a passage; a text is as toxic as its most toxic passage.
PASSAGE = 5
#: Where the scale starts from: evidence is a mean of log-likelihood ratios a gram, some tenths in toxic passages.
SLOPE, BIAS = 28.0, -7.5
#: What a count loses to the shared counts below it, and how many counts more the shared ones weigh in each context of a class.
DISCOUNT, STRENGTH = 0.75, 10.0


def grams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of each word, its end mark's too, as numbers of ORDER bytes, newest byte lowest; and each gram's word."""
    size = end - start + 1
    word = np.repeat(np.arange(len(start)), size)
    off = counting(size)
    sym = np.full(len(word), END, dtype=U64)
    inner = off < size[word] - 1
    sym[inner] = raw[(start[word] + off)[inner]]
    key = sym.copy()
    for back in range(1, ORDER):
        past = np.zeros(len(word), dtype=U64)
        known = np.flatnonzero(off >= back)
        past[known] = sym[known - back]
        past[off == back - 1] = START
        key |= past << U64(8 * back)
    return key, word


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, at = np.unique(keys, return_inverse=True)
    return kept, np.bincount(at, weights=values, minlength=len(kept))


def lookup(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted table; 0 where missing."""
    if not len(table_[0]):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table_[0], keys), len(table_[0]) - 1)
    return np.where(table_[0][at] == keys, table_[1][at], 0.0)


def passage_evidence(ratio: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's largest mean of log-likelihood ratios a gram over its passages of PASSAGE words (all words, if fewer; 0 without any).

    ratio, size: sum of the ratios and number of grams of every word, texts end to end; first[i]:first[i+1] are those of text i.
    """
    count = np.diff(first)
    out = np.zeros(len(count))
    if len(ratio):
        last = np.repeat(first[1:], count)
        end = np.minimum(np.arange(len(ratio)) + PASSAGE, last)
        start = np.maximum(end - PASSAGE, np.repeat(first[:-1], count))
        sums, grams_ = np.concatenate([[0.0], np.cumsum(ratio)]), np.concatenate([[0.0], np.cumsum(size)])
        mean = (sums[end] - sums[start]) / (grams_[end] - grams_[start])
        some = np.flatnonzero(count)
        out[some] = np.maximum.reduceat(mean, first[some])
    return out


@dataclass
class ToxicityModel:
    """log P(toxic) - log P(ordinary) of a gram: known grams' own, others' by their context alone (0 if that is unknown too).

    A gram in neither class has, in both, the context's backoff weight times the same shared probability, which
    cancels; so these two tables are the whole model.
    """

    known: tuple[np.ndarray, np.ndarray]
    context: tuple[np.ndarray, np.ndarray]
    slope: float = SLOPE
    bias: float = BIAS

    def word_scores(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of each word's ratios, and the number of its grams."""
        key, word = grams(raw, start, end)
        at = np.minimum(np.searchsorted(self.known[0], key), max(len(self.known[0]) - 1, 0))
        ratio = lookup(self.context, key >> U64(8))
        if len(self.known[0]):
            hit = self.known[0][at] == key
            ratio[hit] = self.known[1][at[hit]]
        return np.bincount(word, weights=ratio, minlength=len(start)), end - start + 1

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Each text's length-normalised evidence, see passage_evidence()."""
        raw, at = utf8(texts)
        words = Words(LOWER[raw], at, NOT_ALNUM)
        if not len(words.start):
            return np.zeros(len(texts))
        _, where, kind = np.unique(words.hashes(), return_index=True, return_inverse=True)
        ratio, size = self.word_scores(words.raw, words.start[where], words.end[where])
        return passage_evidence(ratio[kind], size[kind], words.first)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -500, 500)))


@dataclass
class JoinedModel:
    """The same two tables, gram and ratio, as DataFrames: for more grams than a broadcast should hold."""

    known: DataFrame
    context: DataFrame
    slope: float = SLOPE
    bias: float = BIAS


def kneser_ney(key: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> ToxicityModel:
    """Interpolated Kneser-Ney models of both classes over the same counts of lower orders.

    key, toxic, ordinary: grams and the documents of each class that hold them (by different words). The shared model counts, at the
    highest order, both classes together, and below it the different bytes before a gram; each class's own discounted counts
    are put before it. So rare words meet one and the same backoff, and few counts say little.
    """
    shared = np.full(len(key), 1 / 256)
    for k in range(1, ORDER):
        longer = np.unique(key & U64((1 << (8 * (k + 1))) - 1))
        cont = _sums(longer & U64((1 << (8 * k)) - 1), np.ones(len(longer)))
        context = cont[0] >> U64(8)
        own = key & U64((1 << (8 * k)) - 1)
        total = lookup(_sums(context, cont[1]), own >> U64(8))
        freed = lookup(_sums(context, np.minimum(cont[1], DISCOUNT)), own >> U64(8))
        shared = (np.maximum(lookup(cont, own) - DISCOUNT, 0) + freed * shared) / total
    context, both = key >> U64(8), toxic + ordinary
    total, freed = lookup(_sums(context, both), context), lookup(_sums(context, np.minimum(both, DISCOUNT)), context)
    shared = (np.maximum(both - DISCOUNT, 0) + freed * shared) / total
    contexts = np.unique(context)
    logs, backoff = zip(*(class_logs(key, count, shared, contexts) for count in (toxic, ordinary)), strict=True)
    return ToxicityModel((key, (logs[0] - logs[1]).astype(np.float32)), (contexts, (backoff[0] - backoff[1]).astype(np.float32)))


def class_logs(key: np.ndarray, count: np.ndarray, shared: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One class's log probability of each gram, and the log weight that each context gives to the shared probability of its other grams."""
    context = key >> U64(8)
    total, freed = _sums(context, count), _sums(context, np.minimum(count, DISCOUNT))
    logs = np.log((np.maximum(count - DISCOUNT, 0) + (lookup(freed, context) + STRENGTH) * shared) / (lookup(total, context) + STRENGTH))
    return logs, np.log((lookup(freed, contexts) + STRENGTH) / (lookup(total, contexts) + STRENGTH))


def kneser_ney_joined(counts: DataFrame) -> JoinedModel:
    """kneser_ney by Spark. counts: gram, toxic, ordinary. A context has 256 grams at most, and so has a gram longer ones, so no window or join is skewed."""
    both = F.col("toxic") + F.col("ordinary")
    shared = None
    for k in range(1, ORDER + 1):
        if k < ORDER:
            longer = counts.select(F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("longer")).distinct()
            level = longer.groupBy(F.col("longer").bitwiseAND((1 << (8 * k)) - 1).alias("gram")).agg(F.count("*").cast("double").alias("n"))
        else:
            level = counts.withColumn("n", both)
        inside = Window.partitionBy(F.shiftright("gram", 8))
        level = level.withColumn("total", F.sum("n").over(inside)).withColumn("freed", F.sum(F.least("n", F.lit(DISCOUNT))).over(inside))
        if shared is None:
            level = level.withColumn("below", F.lit(1 / 256))
        else:
            level = level.withColumn("shorter", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(shared.select(F.col("gram").alias("shorter"), F.col("shared").alias("below")), "shorter")
        shared = level.withColumn("shared", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + F.col("freed") * F.col("below")) / F.col("total"))
    part, logs, backoff = Window.partitionBy("context"), [], []
    known = shared.select("gram", "toxic", "ordinary", "shared", F.shiftright("gram", 8).alias("context"))
    for c in ("toxic", "ordinary"):
        total, freed = F.sum(c).over(part) + STRENGTH, F.sum(F.least(c, F.lit(DISCOUNT))).over(part) + STRENGTH
        logs.append(F.log((F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + freed * F.col("shared")) / total))
        backoff.append(F.log(freed / total))
    both_tables = written(known.select("gram", "context", (logs[0] - logs[1]).alias("ratio"), (backoff[0] - backoff[1]).alias("back")))
    context = both_tables.groupBy(F.col("context").alias("gram")).agg(F.first("back").alias("ratio"))
    return JoinedModel(both_tables.select("gram", "ratio"), context)


def _fit_scale(x: np.ndarray, y: np.ndarray, slope: float = SLOPE, bias: float = BIAS) -> tuple[float, float]:
    """Logistic regression of y on x where some rows are labelled 1 by mistake, at a rate found along with it (EM).

    The weights are drawn towards the given start, as by a normal distribution of a third of their size around it. If evidence then speaks against label 1, the start stays.
    """
    w, start, wrong = np.array([slope, bias]), np.array([slope, bias]), 0.05
    pull = np.diag(9 / start**2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        true = y * p / np.maximum(p + wrong * (1 - p), 1e-300)
        wrong = float(np.clip((y - true).sum() / max((1 - p).sum(), 1e-9), 0, 0.3))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (p - true) + pull @ (w - start))
        w = w - np.clip(step, -abs(start) / 4, abs(start) / 4)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (slope, bias)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def _sample(labels: DataFrame, most: int) -> DataFrame:
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, scale_rows: int = 8_000, label_rows: int = 1_000_000, gram_rows: int = 1_500_000) -> ToxicityModel | JoinedModel:
    """Learns from labelled rows whose remainder isn't 0: all with 1-3 give the counts, at most scale_rows with 4, those with the
    least hashed ids, set the scale. A doc_id with several labels counts as toxic if one says so, and so does a text. Null ids and labels are left
    out. Without rows of both classes no gram is known. Up to label_rows labels are broadcast and up to gram_rows grams
    fitted on the driver; beyond, Spark joins and fits them, with the same results.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", remainder()).where("part <> 0")
    known = written(known)
    learn = known.where("part < 4").select("doc_id", "toxic")
    if learn.count() <= label_rows:
        learn = F.broadcast(learn)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # at most scale_rows rows: small enough to be broadcast
    scale = texts.join(F.broadcast(_sample(known.where("part = 4"), scale_rows).select("doc_id", "toxic")), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(0))
            words = Words(LOWER[raw], at, NOT_ALNUM)
            if not len(words.start):
                continue
            h, text = words.hashes(), words.text_of()
            order = np.lexsort((h, text))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            once = order[new]
            key, word = grams(words.raw, words.start[once], words.end[once])
            is_toxic = np.asarray(batch.column(1)).astype(np.float64)[text[once]][word]
            keys, toxic = _sums(key, is_toxic)
            _, both = _sums(key, np.ones(len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], names=["gram", "toxic", "ordinary"])

    small_batches(docs.sparkSession)
    counted = texts.join(learn, "doc_id").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).mapInArrow(count, "gram long, toxic double, ordinary double")
    counts = written(counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    rows, toxic, ordinary = counts.agg(F.count("*"), F.sum("toxic"), F.sum("ordinary")).first()
    if not (toxic and ordinary):
        return ToxicityModel((np.zeros(0, dtype=U64), np.zeros(0)), (np.zeros(0, dtype=U64), np.zeros(0)))
    if rows <= gram_rows:
        found = counts.toArrow()
        gram, of_toxic, of_ordinary = (found.column(c).to_numpy() for c in ("gram", "toxic", "ordinary"))
        order = np.argsort(gram, kind="stable")
        model = kneser_ney(gram[order].view(U64), of_toxic[order], of_ordinary[order])
    else:
        model = kneser_ney_joined(counts)
    scaled = evidence(scale, model).select("evidence", "toxic").toPandas()
    model.slope, model.bias = _fit_scale(scaled["evidence"].to_numpy(), scaled["toxic"].to_numpy(dtype=np.float64))
    return model


def _joined(docs: DataFrame, model: JoinedModel, name: str) -> DataFrame:
    """evidence() by joins: texts meet their words, words their grams. Equal texts, words and grams are looked up once; a text gets the list of its own words' scores."""
    ids = [F.xxhash64("text").alias("_tx_a"), F.xxhash64(F.lit(1), "text").alias("_tx_b")]

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            words = Words(LOWER[raw], at, NOT_ALNUM)
            if not len(words.start):
                continue
            _, where = np.unique(np.stack([words.text_of().astype(U64), words.hashes()]), axis=1, return_index=True)
            text, data = pa.array(words.text_of()[where]), words.raw.tobytes()
            spelt_ = pa.array([data[words.start[i] : words.end[i]] for i in where.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(1).take(text), spelt_], names=["_tx_a", "_tx_b", "word"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            ends = np.cumsum([len(w) for w in words])
            key, word = grams(np.frombuffer(b"".join(words), dtype=np.uint8), ends - [len(w) for w in words], ends)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(word)), pa.array(key.view(np.int64))], names=["word", "gram"])

    small_batches(docs.sparkSession)
    pairs = written(docs.select(*ids, "text").mapInArrow(parted, "_tx_a long, _tx_b long, word binary").distinct())
    found = pairs.select("word").distinct().mapInArrow(spelt, "word binary, gram long").withColumn("context", F.shiftright("gram", 8))
    found = found.join(model.known.withColumnRenamed("ratio", "own"), "gram", "left")
    found = found.join(model.context.select(F.col("gram").alias("context"), F.col("ratio").alias("back")), "context", "left")
    scores = found.groupBy("word").agg(F.sum(F.coalesce("own", "back", F.lit(0.0))).alias("ratio"))
    lists = written(pairs.join(scores, "word").groupBy("_tx_a", "_tx_b").agg(F.collect_list(F.struct("word", "ratio")).alias("_tx_words")))
    keyed = docs.select("*", *ids).join(lists, ["_tx_a", "_tx_b"], "left").drop("_tx_a", "_tx_b")
    schema = docs.withColumn(name, F.lit(0.0)).schema
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch))
            for i, (text, own) in enumerate(zip(batch.column(at), batch.column("_tx_words").to_pylist(), strict=True)):
                if own:
                    raw, ends = utf8(pa.array([text.as_py()], pa.string()))
                    words = Words(LOWER[raw], ends, NOT_ALNUM)
                    data, known = words.raw.tobytes(), {w["word"]: w["ratio"] for w in own}
                    ratio = np.array([known[data[a:b]] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)])
                    out[i] = passage_evidence(ratio, words.end - words.start + 1, words.first)[0]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(out)], names=[*names, name])

    return keyed.mapInArrow(run, schema)


def evidence(docs: DataFrame, model: ToxicityModel | JoinedModel, name: str = "evidence") -> DataFrame:
    """docs with the column name (double), computed from text alone; an input column of this name is replaced."""
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    if isinstance(model, JoinedModel):
        return _joined(docs, model, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(name, F.lit(0.0)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.evidence(batch.column(at)), pa.float64())], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel | JoinedModel) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (0 to 1), predicted (1 from 0.5), n_evidence (the length-normalised ratio).

    Null and empty texts, and texts without letters, get the score of no evidence. Null doc_id: held out. Repeated
    rows are scored alike. Empty input: no rows. Extra columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = evidence(rows, model)
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.bias))))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), F.col("evidence").alias("n_evidence"))


def ordinary(docs: DataFrame, model: ToxicityModel | JoinedModel) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns."""
    scored = evidence(docs, model, "_tx_evidence")
    return scored.where(F.lit(model.slope) * F.col("_tx_evidence") + F.lit(model.bias) < 0).drop("_tx_evidence")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
