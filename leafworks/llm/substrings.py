"""Substring dedup by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches, table
from .words import Words, counting, covered, sequence_hashes, utf8

#: Words of a window, and of the m-mers of which the least hash is a window's minimiser.
WINDOW, M = 13, 3
#: Stands for a null doc_id: larger than any other.
NO_ID = np.iinfo(np.int64).max
#: A minimiser is frequent when its super-k-mers fill so many buckets, and at least this share of all bytes, so there are at most a million.
CROWD, SHARE = 4, 1e-6
#: Minimisers that a task counts before it passes on those with a 4096th of a bucket and begins anew.
COUNTED = 1 << 21
#: No hashes.
NONE = np.zeros(0, dtype=np.uint64)


def pack_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack_bytes(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive values."""
    out, span = values, 1
    while span < size:
        step = min(span, size - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def _runs(w: Words, h: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each run of consecutive windows with one minimiser.

    The 3-word grams in frequent (sorted hashes, halved) come after all others, so they are minimisers only of windows that hold nothing else.
    """
    start = w.windows(WINDOW)
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = sequence_hashes(h, np.arange(len(h) - M + 1), M) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        grams = grams | ((frequent[at] == grams).astype(np.uint64) << np.uint64(63))
    least = _sliding_min(grams, WINDOW - M + 1)[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    runs = np.flatnonzero(new)
    return start[runs], start[np.append(runs[1:], len(start)) - 1], least[runs]


def _crowds(floor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bytes of the different super-k-mers of each batch, by minimiser, where a task finds floor or more of them."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, number = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(number, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)

    def heavy(grams: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        many = sizes >= floor
        return pa.record_batch([pa.array(grams[many].astype(np.int64)), pa.array(sizes[many])], names=["gram", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            w = Words(*utf8(batch.column("text")))
            h = w.hashes()
            first, last, least = _runs(w, h, NONE)
            # copies within the batch count once, as they do in a chunk
            _, once = np.unique(sequence_hashes(h, first, WINDOW) + (last - first).astype(np.uint64), return_index=True)
            parts.append((least[once], w.end[last[once] + WINDOW - 1] - w.start[first[once]]))
            held += len(once)
            if held > COUNTED:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if 2 * held > COUNTED:
                    yield heavy(*parts[0])
                    parts, held = [], 0
        if parts:
            yield heavy(*merged(parts))

    return run


def frequent_minimisers(docs: DataFrame, size: int, bucket_bytes: int) -> np.ndarray:
    """Sorted, halved hashes of the grams whose super-k-mers would crowd a bucket: at most 1 / SHARE, 8 MB. size: bytes of all super-k-mers. They only order grams, so results don't depend on them."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_crowds(bucket_bytes >> 12), "gram long, bytes long").groupBy("gram").agg(F.sum("bytes").alias("_n"))
    found = sums.where(F.col("_n") > max(CROWD * bucket_bytes, SHARE * size)).select("gram").collect()
    return np.sort(np.array([r.gram for r in found], dtype=np.int64).astype(np.uint64))


class SuperKmers:
    """The super-k-mers of a chunk: runs of consecutive windows with one minimiser, each kept once by its bytes.

    The chunk's texts come in order of doc_id, so the first place of a super-k-mer is that of the chunk's smallest
    doc_id. first, last: a run's first and last window; text: its text's number; number: that of its bytes;
    kind_*: of each different one.
    """

    def __init__(self, chunk: pa.Table, frequent: np.ndarray):
        order = np.lexsort((np.arange(len(chunk)), ids := _ids(chunk.column("doc_id"))))
        self.chunk, self.ids = chunk.take(pa.array(order)), ids[order]
        raw, at = utf8(self.chunk.column("text"))
        self.words = w = Words(raw, at)
        self.first, self.last, minimiser = _runs(w, w.hashes(), frequent)
        self.text = np.searchsorted(w.first, self.first, side="right") - 1
        data = raw.tobytes()
        kinds: dict[bytes, int] = {}
        self.number = np.fromiter((kinds.setdefault(data[a:b], len(kinds)) for a, b in zip(w.start[self.first].tolist(), w.end[self.last + WINDOW - 1].tolist(), strict=True)), dtype=np.int64, count=len(self.first))
        _, self.kind_at = np.unique(self.number, return_index=True)
        self.kinds, self.kind_minimiser, self.kind_id = list(kinds), minimiser[self.kind_at], self.ids[self.text[self.kind_at]]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _deal(buckets: int, frequent: np.ndarray):
    """Packs each chunk's super-k-mers for the buckets of their minimisers."""

    def run(chunk: pa.Table) -> pa.Table:
        s = SuperKmers(chunk, frequent)
        bucket = (s.kind_minimiser % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = []
        for part in np.split(order, cuts) if len(order) else []:
            texts = [s.kinds[i] for i in part.tolist()]
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            rows.append((int(bucket[part[0]]), np.stack([part, sizes, s.kind_id[part]]).tobytes(), b"".join(texts)))
        number = chunk.column("chunk")[0].as_py()
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int32()), pa.array([pack_bytes(r[1]) for r in rows], pa.binary()), pa.array([pack_bytes(r[2]) for r in rows], pa.binary())],
            names=["bucket", "chunk", "about", "packed"],
        )

    return run


def _owners(h: np.ndarray, ids: np.ndarray, words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The smallest of the ids of each window's equals: sorted by hash, neighbours compared word by word."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    a, b = start[order[1:][same]], start[order[:-1][same]]
    if any((words[a + i] != words[b + i]).any() for i in range(WINDOW)):  # different windows of one hash: sort by the words
        _, h = np.unique(words[start[:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
    group = np.concatenate([[0], np.cumsum(~same)])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(np.concatenate([[True], ~same])))
    out = np.empty(len(h), dtype=np.int64)
    out[order] = least[group]
    return out


def _count(rows: pa.Table) -> pa.Table:
    """Finds, in one bucket, the windows that also start in a document with a smaller doc_id, and answers each chunk."""
    about = [np.frombuffer(unpack_bytes(x), dtype=np.int64).reshape(3, -1) for x in rows.column("about").to_pylist()]
    chunk = np.repeat(rows.column("chunk").to_numpy(), [a.shape[1] for a in about])
    number, sizes, ids = np.concatenate(about, axis=1)
    raw = np.frombuffer(b"".join(map(unpack_bytes, rows.column("packed").to_pylist())), dtype=np.uint8)
    words = Words(raw, np.concatenate([[0], np.cumsum(sizes)]))
    start, of = words.windows(WINDOW), words.text_of()
    run, h = of[start], words.hashes()
    hit = np.flatnonzero(_owners(sequence_hashes(h, start, WINDOW), ids[run], h, start) < ids[run])
    hit = hit[np.argsort(chunk[run[hit]], kind="stable")]
    cuts = np.flatnonzero(np.diff(chunk[run[hit]])) + 1
    parts = np.split(hit, cuts) if len(hit) else []
    found = [np.stack([number[run[p]], start[p] - words.first[run[p]]]).astype(np.int64).tobytes() for p in parts]
    return pa.table([pa.array([chunk[run[p[0]]] for p in parts], pa.int32()), pa.array([pack_bytes(x) for x in found], pa.binary())], names=["chunk", "found"])


def _remove(frequent: np.ndarray):
    """Removes the words of the windows that a chunk's answers name, and of those that its own smaller doc_ids hold."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s = SuperKmers(chunk, frequent)
        w = s.words
        found = np.concatenate([np.zeros((2, 0), dtype=np.int64), *(np.frombuffer(unpack_bytes(x), dtype=np.int64).reshape(2, -1) for x in answers.column("found").to_pylist())], axis=1)
        kind, at = found[:, np.argsort(found[0], kind="stable")]
        copy = s.ids[s.text] > s.kind_id[s.number]  # the chunk itself has these bytes in a smaller doc_id
        size = s.last - s.first + 1
        whole = np.repeat(s.first[copy], size[copy]) + counting(size[copy])
        low, high = np.searchsorted(kind, s.number[~copy]), np.searchsorted(kind, s.number[~copy], side="right")
        some = np.repeat(s.first[~copy], high - low) + at[np.repeat(low, high - low) + counting(high - low)]
        gone = covered(len(w.start), np.concatenate([whole, some]), WINDOW)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (w.count > 0) if len(w.count) else w.count
        data, kept = w.raw.tobytes(), []
        for i, n in enumerate(removed.tolist()):
            if n:
                own = np.flatnonzero(~gone[w.first[i] : w.first[i + 1]]) + w.first[i]
                kept.append(b" ".join([data[a:b] for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]))
            else:
                kept.append(b" ".join(data[w.at[i] : w.at[i + 1]].split()))
        return pa.table(
            [s.chunk.column("doc_id"), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
            names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True, chunk_rows: int = 1000, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Removes each word covered by a window of 13 words whose word sequence also starts in a document with a smaller doc_id.

    Documents are dealt into chunks by hash. A chunk sends each different super-k-mer once, with its smallest doc_id, to the bucket
    of its minimiser; a bucket sorts all its windows, finds those owned by a smaller doc_id, and answers the chunks that
    asked; so a passage in very many documents comes to its bucket once a chunk. The dealing reads the texts
    once more for the answers rather than keeping them. A first pass finds the grams that would be minimisers of
    more text than CROWD buckets take: they come last in the order of grams, so the windows around such a gram go to the
    buckets of their other grams. Windows of frequent grams only share theirs.

    Null or empty text: no words. A null doc_id counts as larger than any other. Rows with equal doc_id don't
    remove each other's words. Fewer than 13 words: nothing goes. Empty input: no rows. Extra columns are ignored.
    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space; only with_text) and kept_sha256.
    """
    small_batches(docs.sparkSession)
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    chunks, buckets = max(1, -(-n // chunk_rows)), max(1, -(-3 * (size or 0) // bucket_bytes))
    frequent = frequent_minimisers(docs, 3 * (size or 0), bucket_bytes)
    own = docs.select("doc_id", F.col("text").cast("string"))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).groupBy("chunk")
    packed = own.applyInArrow(_deal(buckets, frequent), "bucket int, chunk int, about binary, packed binary")
    answers = packed.groupBy("bucket").applyInArrow(_count, "chunk int, found binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = own.cogroup(answers.groupBy("chunk")).applyInArrow(_remove(frequent), f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out if with_text else out.drop("kept_text")


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) > 12),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM s),
o AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM o WHERE owner < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY 1),
k AS (SELECT w.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
