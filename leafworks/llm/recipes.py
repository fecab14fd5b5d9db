"""Exact dedup by recipes: ordered lists of verified content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import _bitmap, _may_have
from .storage import Scratch, small_batches, table, written
from .words import utf8

#: Bytes of a chunk: at least, at most; between them a cut stands in one of 2^SPACING_BITS places.
LEAST, MOST, SPACING_BITS = 256, 16384, 11
#: Bytes of a chunk's identifier, and bytes that the rolling hash looks at together.
DIGEST, LOOK = 16, 4 << 20
GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)


def _candidates(raw: np.ndarray) -> np.ndarray:
    """Ends of chunks that the content asks for: the hash of the 32 bytes before has its high bits 0."""
    found = []
    for start in range(0, len(raw), LOOK):
        low = max(0, start - 31)
        h = GEAR[raw[low : start + LOOK]]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        at = np.flatnonzero(h >> np.uint32(32 - SPACING_BITS) == 0) + low
        found.append(at[at >= start] + 1)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def cuts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all texts, and of each text the number of its chunks. Ends depend on the text's own bytes only; an empty text has none."""
    asked, ends, sizes = _candidates(raw), [], []
    first = np.searchsorted(asked, at)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        before = len(ends)
        last = a
        for x in [*asked[first[i] : first[i + 1]].tolist(), b]:
            while x - last > MOST:
                last += MOST
                ends.append(last)
            if x - last >= LEAST and x < b:
                ends.append(x)
                last = x
        if b > last:
            ends.append(b)
        sizes.append(len(ends) - before)
    return np.array(ends, dtype=np.int64), np.array(sizes, dtype=np.int64)


def identifier(chunk: bytes, salt: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST, salt=salt.to_bytes(8, "little")).digest()


def _chunks(texts: pa.Array, salt: int, identify) -> tuple[bytes, np.ndarray, list[int], np.ndarray, list[bytes]]:
    """The batch's bytes, texts' offsets, chunks' ends, numbers of chunks and identifiers."""
    raw, at = utf8(texts)
    ends, sizes = cuts(raw, at)
    data, first = raw.tobytes(), 0
    # chunks of a batch lie end to end, as its texts do
    names, ends = [], ends.tolist()
    for e in ends:
        names.append(identify(data[first:e], salt))
        first = e
    return data, at, ends, sizes, names


def _heads(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), dtype=np.uint8).reshape(len(names), -1)[:, :8].copy().view(np.int64).ravel() if names else np.zeros(0, dtype=np.int64)


def _recipes(docs: DataFrame, salt: int, identify) -> DataFrame:
    """doc_id, row, recipe (the identifiers end to end), heads (eight bytes of each) and the SHA-256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at, _, sizes, names = _chunks(batch.column(2), salt, identify)
            stops = np.concatenate([[0], np.cumsum(sizes)])
            made = [b"".join(names[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            heads = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(_heads(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), heads, pa.array(sha, pa.binary())], names=["doc_id", "row", "recipe", "heads", "sha"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, row long, recipe binary, heads array<long>, sha binary")


def _unsafe(docs: DataFrame, recipes: DataFrame, salt: int, identify) -> bool:
    """Whether an identifier stands for chunks with different bytes. Chunks whose identifier occurs once need no look; of the others each task sends one copy, and the least and the largest of an identifier's copies are compared."""
    spark = docs.sparkSession
    with Scratch(spark) as keep:
        again = keep.write(recipes.select(F.explode("heads").alias("k")).groupBy("k").count().where("count > 1").select("k"))
        shared = spark.sparkContext.broadcast(_bitmap(again, "k"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: dict[bytes, bytes] = {}  # of each identifier a second hash of the bytes that this task sent: other bytes are sent too
            for batch in batches:
                data, _, ends, _, names = _chunks(batch.column(0), salt, identify)
                out: list[tuple[bytes, bytes]] = []
                for i in np.flatnonzero(_may_have(shared.value, _heads(names))).tolist():
                    chunk = data[ends[i - 1] if i else 0 : ends[i]]
                    other = hashlib.blake2s(chunk, digest_size=8).digest()
                    if sent.get(names[i]) != other:
                        sent[names[i]] = other
                        out.append((names[i], chunk))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["name", "chunk"])

        chunks = docs.select(F.col("text").cast("string")).mapInArrow(run, "name binary, chunk binary")
        return not chunks.groupBy("name").agg(F.min("chunk").alias("least"), F.max("chunk").alias("largest")).where("least <> largest").isEmpty()


def exact_duplicates(docs: DataFrame, identify=identifier) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row: of rows with equal texts that with the largest doc_id stays.

    Texts are cut where their own bytes say so; a chunk's identifier is a salted 128-bit hash whose equals are compared byte by byte (should two chunks ever share one, all is done
    again with the next salt). Two texts are equal when their lists of identifiers are, so what is grouped and joined is 16 bytes a chunk; a chunk's bytes move once a task at most, and only if
    its identifier occurs again (by a filter of 16 MB). Groups of a thousandth of all rows or more, a thousand groups at most, are joined by broadcast; smaller ones by their recipe.

    Null text counts as empty; all empty texts are one group. Of rows with equal text and doc_id just one stays. A null doc_id counts as smaller than any other. Empty input: no rows. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    for salt in count():
        recipes = written(_recipes(docs, salt, identify))
        if not _unsafe(docs, recipes, salt, identify):
            break
    last = F.max(F.struct("doc_id", "row")).alias("last")
    groups = written(recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), last).where("group_size > 1"))
    hot = max(1000, recipes.count() // 1000)
    # rows of hot groups and others part here, so that no join gathers a hot group
    marked = recipes.drop("heads").join(F.broadcast(groups.where(F.col("group_size") >= hot)), "recipe", "left")
    rest = marked.where("group_size IS NULL").drop("group_size", "last").join(groups.where(F.col("group_size") < hot), "recipe", "left")
    out = marked.where("group_size IS NOT NULL").unionByName(rest)
    return out.select(
        "doc_id", F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), (F.octet_length("recipe") / DIGEST).cast("long").alias("n_chunks"),
    )


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
