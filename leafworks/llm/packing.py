"""Vector best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small_batches, table, written
from .words import BLANK, LOWER, U64, Words, counting, utf8

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_le binary"
PLACES = "_pk_row long, sequence_id long, offset long"


#: 1: ASCII letters and digits, 2: ASCII signs but the apostrophe. The tokenizer's own first split parts 1 from 2 always.
KIND = np.array([(1 if chr(b).isalnum() else 2 if b > 32 and b != 39 else 0) if b < 127 else 0 for b in range(256)], dtype=np.int8)


def chunks(texts: pa.Array) -> Words:
    """What can be tokenised alone: words, parted between letters and signs; A-Z lower-cased, as the tokenizer does itself."""
    raw, at = utf8(texts)
    kind = KIND[raw]
    cuts = np.zeros(len(raw), dtype=bool)
    cuts[1:] = (kind[1:] * kind[:-1]) == 2
    return Words(LOWER[raw], at, BLANK, cuts)


class IdCache:
    """Token ids of chunks of texts, kept by the chunk's hash; a text's ids are its chunks' ids in turn.

    A chunk's key is its length, a 64-bit hash that tells apart all chunks of up to 8 bytes, and for longer ones another such hash. Keys lie in a table
    with open addressing, so a batch is looked up by array operations alone. New chunks are encoded many to a call,
    with a control character between them whose own id parts the answer; chunks that hold it are encoded alone.
    """

    MARK = "\x07"

    def __init__(self, path: str, most: int = 400_000, a_call: int = 4000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.a_call = Tokenizer.from_file(path), most, a_call
        self.mark = self._encode(self.MARK)
        self.clear()

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def clear(self) -> None:
        self.keys = np.zeros((3, 0), dtype=U64)
        self.slots = np.full(1 << 20, -1, dtype=np.int32)
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for new ones."""
        out, todo, mask = np.full(keys.shape[1], -1, dtype=np.int64), np.arange(keys.shape[1]), len(self.slots) - 1
        at = (keys[0] & U64(mask)).astype(np.int64)
        while len(todo):
            number = self.slots[at]
            used = np.flatnonzero(number >= 0)
            same = (self.keys[:, number[used]] == keys[:, todo[used]]).all(axis=0)
            out[todo[used[same]]] = number[used[same]]
            others = used[~same]
            todo, at = todo[others], (at[others] + 1) & mask
        return out

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.keys[0, numbers] & U64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            left = self.slots[at] != numbers
            numbers, at = numbers[left], (at[left] + 1) & mask

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encodes new chunks, all different."""
        odd = np.array([len(self.mark) != 1 or self.MARK.encode() in w for w in words], dtype=bool)
        order = [*np.flatnonzero(~odd).tolist(), *np.flatnonzero(odd).tolist()]
        plain, made, sizes = len(order) - int(odd.sum()), [self.flat], []
        for i in range(0, plain, self.a_call):
            ids = self._encode(f" {self.MARK} ".join(words[j].decode() for j in order[i : min(i + self.a_call, plain)]))
            marks = np.flatnonzero(ids == self.mark)
            made.append(np.delete(ids, marks))
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
        for j in order[plain:]:
            made.append(self._encode(words[j].decode()))
            sizes.append(np.array([len(made[-1])]))
        before = self.keys.shape[1]
        self.flat, self.keys = np.concatenate(made), np.concatenate([self.keys, keys[:, order]], axis=1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])
        total = self.keys.shape[1]
        if 2 * total > len(self.slots):
            self.slots, before = np.full(1 << (4 * total - 1).bit_length(), -1, dtype=np.int32), 0
        self._place(np.arange(before, total, dtype=np.int32))

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All chunks' ids end to end, and the number of ids of each."""
        if self.keys.shape[1] > self.most:
            self.clear()
        size = words.end - words.start
        keys = np.zeros((3, len(size)), dtype=U64)
        keys[0], keys[1] = words.hashes(), size
        if len(long := np.flatnonzero(size > 8)):
            keys[2, long] = words.only(long).hashes(seed=1)
        number = self._find(keys)
        while len(new := np.flatnonzero(number < 0)):
            _, first = np.unique(keys[0, new], return_index=True)
            first = new[first]
            self._learn(keys[:, first], [words.raw[a:b].tobytes() for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])
            number[new] = self._find(keys[:, new])
        size = self.ends[number + 1] - self.ends[number]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.ends[number] - before, size) + np.arange(size.sum())], size


@functools.cache
def cached_ids(path: str) -> IdCache:
    """One cache for a Python worker, whichever tasks it runs."""
    return IdCache(path)


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """One row for each piece of each document: its place in the document's ids, and its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached_ids(tokenizer_path)
        for batch in batches:
            words = chunks(batch.column(1))
            flat, size = cache.ids(words)
            ends = np.concatenate([[0], np.cumsum(size)])[words.first]
            flat = np.insert(flat, ends[1:], END_ID)
            total = np.diff(ends) + 1
            pieces = -(-total // capacity)
            doc, piece = np.repeat(np.arange(len(batch)), pieces), counting(pieces)
            start = piece * capacity
            length = np.minimum(total[doc] - start, capacity)
            at = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), ids], names=["doc_id", "piece", "start", "length", "ids_le"])

    small_batches(docs.sparkSession, 2000)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def with_ids(packed: DataFrame) -> DataFrame:
    """packed with ids, an array of numbers, in the place of ids_le: the same bytes, read anew."""
    at = packed.columns.index("ids_le")
    names = [*packed.columns[:at], "ids", *packed.columns[at + 1 :]]
    schema = packed.withColumn("ids", F.expr("cast(null AS array<int>)")).select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
            ids = pa.array(np.frombuffer(data, dtype="<i4", count=(ends[-1] - ends[0]) // 4, offset=ends[0]) if data is not None and len(column) else np.zeros(0, dtype=np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), ids), *batch.columns[at + 1 :]], names=names)

    small_batches(packed.sparkSession, 2000)
    return packed.mapInArrow(run, schema)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weight: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, int]:
    """Bins of items with several demands each, largest first demand first.

    Every open bin that holds the item under all constraints is weighed: 'norm' takes the least weighted norm of what would
    be left, 'dot' the largest weighted dot product of item and residual; ties go to the oldest bin. Without
    such a bin a new one is opened. Bins with the same first residual differ only in the other demands, so bins
    too full for the smallest item leave the list.
    """
    order = np.lexsort((np.arange(len(demand)), -demand[:, 0]))
    share = weight / capacity**2
    bins, n = np.empty(len(demand), dtype=np.int64), 0
    left, number = np.empty((16, demand.shape[1])), np.empty(16, dtype=np.int64)
    live, least = 0, demand.min(axis=0) if len(demand) else capacity
    for item in order.tolist():
        need = demand[item]
        open_ = left[:live]
        fits = np.flatnonzero((open_ >= need).all(axis=1))
        if len(fits):
            rest = open_[fits]
            value = (((rest - need) ** 2) @ share) if rule == "norm" else -(rest @ (need * share))
            at = fits[value.argmin()]
        else:
            if live == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            left[live], number[live], at = capacity, n, live
            live, n = live + 1, n + 1
        left[at] -= need
        bins[item] = number[at]
        if (left[at] < least).any():
            left[at:live - 1], number[at:live - 1] = left[at + 1 : live].copy(), number[at + 1 : live].copy()
            live -= 1
    return bins, n


#: Bounds that are tried, as multiples of what a sequence holds on average.
BOUNDS = (5.0, 10.0, 20.0, 40.0)


def tightest(demand: np.ndarray, capacity: int, weight: np.ndarray, rule: str, max_pieces: int | None, max_attention: float | None) -> tuple[np.ndarray, np.ndarray]:
    """best_fit under the tightest bounds of pieces and attention among those tried that cost no sequence, and the limits taken.

    A bound that is given stays as it is. One that isn't is a multiple of the mean, at least what one item needs; if no multiple does with as many bins as
    the other bounds alone, it is what the token bound implies.
    """
    loose = np.array([capacity, max_pieces or capacity, max_attention or float(capacity) ** 2], dtype=np.float64)
    bins, n = best_fit(demand, loose, weight, rule)
    if not (max_pieces and max_attention):
        for times in BOUNDS:
            tight = np.minimum(loose, np.maximum(np.ceil(times * demand.sum(axis=0) / max(n, 1)), demand.max(axis=0)))
            limit = np.array([capacity, max_pieces or tight[1], max_attention or tight[2]])
            tried, m = best_fit(demand, limit, weight, rule)
            if m <= n:
                return tried, limit
    return bins, loose


def pack_bytes(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    max_pieces: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    group_rows: int = 8_000,
) -> DataFrame:
    """Packs documents into sequences of at most capacity tokens, max_pieces pieces and max_attention sum of squared lengths.

    Where the last two aren't given, each group of pieces takes the tightest multiples of its means that cost no sequence more than the first bound alone,
    so that documents and attention are spread over sequences. A document's ids end with id 1; longer ones than capacity are cut into full pieces and a rest. Pieces that fill
    a sequence alone get it at once. The others are dealt by a hash of their place into groups of about group_rows, which pack
    independently: each group can leave one sequence part empty, one in some thousand, and no task gets more than a group.

    Null or empty text: the one id 1. Null doc_id: packed like any other. Repeated rows: pieces of their own. Empty
    input: no rows. Extra columns are ignored. Returns doc_id, piece, start, length, ids_le (the ids as little-endian 32-bit numbers),
    sequence_id, offset; a sequence is the ids of its pieces by offset.
    """
    pieces = written(tokenised(docs, tokenizer_path, capacity).withColumn("_pk_row", F.monotonically_increasing_id()))
    n = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_rows))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "_pk_row"), F.lit(groups))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "_pk_row"], kind="stable", ignore_index=True)
        size = rows["length"].to_numpy(dtype=np.float64)
        bins, _ = tightest(np.stack([size, np.ones_like(size), size**2], axis=1), capacity, np.array(weights), rule, max_pieces, max_attention)
        rows["sequence_id"] = bins * groups + key[0]
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows[["_pk_row", "sequence_id", "offset"]]

    rest = pieces.where(F.col("length") < capacity)
    # only lengths are packed; the places, small rows, are hashed to meet the ids, which so need no sort
    places = rest.select("_pk_row", "doc_id", "piece", "length", spread.alias("_pk_group")).groupBy("_pk_group").applyInPandas(run, PLACES)
    part = rest.join(places.hint("shuffle_hash"), "_pk_row").drop("_pk_row")
    # a full piece is a sequence by itself: negative numbers, which the groups don't use
    whole = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("_pk_row")).withColumn("offset", F.lit(0).cast("long")).drop("_pk_row")
    return part.unionByName(whole)


def pack(docs: DataFrame, tokenizer_path: str, **bounds) -> DataFrame:
    """pack_bytes() with ids (array<int>) in the place of ids_le, and ids_crc32, their digest."""
    packed = pack_bytes(docs, tokenizer_path, **bounds).withColumn("ids_crc32", F.crc32("ids_le"))
    return with_ids(packed.select("doc_id", "piece", "start", "length", "ids_le", "ids_crc32", "sequence_id", "offset"))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_bytes(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "sequence_id", "offset")
