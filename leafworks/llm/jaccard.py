"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch, small_batches, table, written
from .words import LOWER, U64, Words, sequence_hashes, utf8

#: Words of a shingle; links need 100 * intersection >= 80 * union.
SHINGLE = 5
#: The order table holds so many of the most repeated shingles at most, by half of their hash (8 bytes each). It only orders; results are the same with any.
ORDER_ROWS = 1 << 21
#: A task counts repetitions among so many shingles at a time (4 bytes each).
COUNTED = 4_000_000
#: Longest match number, and how many posting entries one verification costs.
MOST_MATCHES, VERIFY_COST = 16, 16.0
#: Members of a hub's group that one salt, and one side of a block, takes; and pairs or texts that a task takes.
SPREAD, BLOCK, A_TASK = 1000, 1000, 250
#: Up to so many hubs with several salts are broadcast.
HOT_HUBS = 100_000
#: At most so many bits tell apart keys that are surely absent.
FILTER_BITS = 27


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set of hashed shingles, sorted. Fewer than SHINGLE words: their whole sequence; no words: empty."""
    raw, at = utf8(texts)
    words = Words(LOWER[raw], at)
    h, start = words.hashes(), words.windows(SHINGLE)
    grams, first = sequence_hashes(h, start, SHINGLE), np.searchsorted(start, words.first)
    out = []
    for i, n in enumerate(words.count.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        elif n:
            out.append(sequence_hashes(h, words.first[i : i + 1], n))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def half(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(32)).astype(np.uint32)


def repeated_shingles(docs: DataFrame, most: int = ORDER_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that meet again among the documents that a task counts together, with how often, as a sorted table: an estimate of which are frequent."""

    def counted(halves: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *halves]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held += [half(s) for s in shingle_sets(batch.column(1))]
            n += sum(map(len, held[-len(batch) :]))
            if n >= COUNTED:
                yield counted(held)
                held, n = [], 0
        yield counted(held)

    found = _texts(docs).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = found.column("token").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order].astype(np.int32)


def prefix_of(tokens: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The document's prefix, rarest shingles first, and its match number.

    Sets that link share at least c = ceil(0.8 n) shingles of each, so among the first n - c + m of either, in
    one common order, they share m or more. Larger m costs longer posting lists and spares candidates: a
    document sharing m of the prefix's entries counts m times among them. The cheapest m is taken.
    """
    n = len(tokens)
    if not n:
        return tokens, 1
    often = np.zeros(n, dtype=np.int64)
    if len(known[0]):
        key = half(tokens)
        at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
        hit = known[0][at] == key
        often[hit] = known[1][at[hit]]
    order = np.lexsort((tokens, often))
    c = (4 * n + 4) // 5
    m = np.arange(1, min(MOST_MATCHES, c) + 1)
    entries = np.cumsum(often[order])[n - c + m - 1]
    best = int((entries * (1 + VERIFY_COST / m)).argmin())
    return tokens[order[: n - c + m[best]]], int(m[best])


def sketch(tokens: np.ndarray) -> bytes:
    """For each of b places the parity of how many tokens fall there; b is the least power of two that is n or more, 64 at least.

    Places where two sketches differ are at most as many as the sets' symmetric difference has shingles, so
    sets that link, with S shingles together, differ in S / 9 places at most. Halves put together by exclusive or make the sketch of half as many places.
    """
    places = 1 << max(6, int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each of 64-bit words, brought to as many words."""
    while rows.shape[1] > words:
        half_ = rows.shape[1] // 2
        rows = rows[:, :half_] ^ rows[:, half_:]
    return rows


def may_link(left: list[bytes], right: list[bytes], n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Which of all pairs of two lists of sketches, of sets of these sizes, can't be ruled out as links."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for p in np.unique(size_l):
        for q in np.unique(size_r):
            at, to = np.flatnonzero(size_l == p), np.flatnonzero(size_r == q)
            words = min(p, q) // 8
            x, y = (folded(np.frombuffer(b"".join(side[i] for i in which), dtype=np.uint64).reshape(len(which), -1), words) for side, which in ((left, at), (right, to)))
            differ = np.zeros((len(at), len(to)), dtype=np.int32)
            for w in range(words):
                differ += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
            out[np.ix_(at, to)] = 9 * differ <= n_left[at][:, None] + n_right[to]
    return out


def prefixes(docs: DataFrame) -> DataFrame:
    """id, n (set size), key (128-bit hash of the set), matches (m), prefix and sketch of every document.

    Of rows with equal sets that a task reads, all but the first have that one's id as twin, and neither prefix nor sketch: copies,
    however many, put one document a task behind a shingle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, {}
        for batch in batches:
            sets, ids = shingle_sets(batch.column(1)), batch.column(0).to_pylist()
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            twin = []
            for i, k, s in zip(ids, keys, sets, strict=True):
                twin.append(seen.get(k) if i is not None and len(s) else None)
                if twin[-1] is None and i is not None:
                    seen[k] = i
            made = [prefix_of(s, known) if t is None else (s[:0], 1) for s, t in zip(sets, twin, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in made])]).astype(np.int32)
            flat = np.concatenate([p for p, _ in made]) if made else np.zeros(0, dtype=U64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([m for _, m in made], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                 pa.array([sketch(s) if t is None else None for s, t in zip(sets, twin, strict=True)], pa.binary()), pa.array(twin, pa.int64())],
                names=["id", "n", "key", "matches", "prefix", "sketch", "twin"],
            )

    return _texts(docs).mapInArrow(run, "id long, n long, key binary, matches int, prefix array<long>, sketch binary, twin long")


def _bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of one hash over a column of numbers: bits in words of 64."""
    bits = 1 << min(FILTER_BITS, max(10, (32 * keys.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("b")).toArrow()
    filled = np.zeros(bits // 64, dtype=np.int64)
    filled[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return filled


def _may_have(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (64 * len(filled) - 1)
    return (filled[at >> 6] >> (at & 63)) & 1 == 1


def _perhaps(ids: DataFrame, column: str = "id"):
    """A test of a column that is true for values among ids and few others."""
    shared = ids.sparkSession.sparkContext.broadcast(_bitmap(ids.select(F.xxhash64("id").alias("p")), "p"))

    @F.pandas_udf("boolean")
    def may_have(p: pd.Series) -> pd.Series:
        return pd.Series(_may_have(shared.value, p.to_numpy()))

    return may_have(F.xxhash64(F.col(column).cast("long")))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id is, by a filter, perhaps among ids: spares shuffling the others."""
    return rows.where(_perhaps(ids))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't among ids (id, long). Only rows that the filter doesn't clear are shuffled for it, so not the texts of all documents."""
    flagged = docs.withColumn("_jc_perhaps", _perhaps(ids, "doc_id"))
    gone = ids.select(F.col("id").alias("_jc_gone"))
    rest = flagged.where("_jc_perhaps").join(gone, F.col("doc_id").cast("long") == F.col("_jc_gone"), "left_anti")
    return flagged.where("NOT _jc_perhaps").unionByName(rest).select(*docs.columns)


def first_of_components(docs: DataFrame, kept: list[str]) -> DataFrame:
    """docs (columns kept: doc_id, text and others) without those in a component with a smaller doc_id. Rows without doc_id stay; of rows with equal doc_id and text the least stays, such with different texts all stay."""
    found = written(jaccard_components(docs))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    left = without(docs, written(gone))
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    rest = [c for c in kept if c not in ("doc_id", "text")]
    once = left.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_jc_rest"))
    return once.select("doc_id", "text", "_jc_rest.*").select(*kept).unionByName(left.where("doc_id IS NULL"))


def entries(sizes: DataFrame, tokens: DataFrame) -> DataFrame:
    """id and token of the prefix entries that are, by a filter, perhaps among tokens."""
    shared = sizes.sparkSession.sparkContext.broadcast(_bitmap(tokens, "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = batch.column(1).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            keep = _may_have(shared.value, flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)[keep]), pa.array(flat[keep])], names=["id", "token"])

    return sizes.where("id IS NOT NULL AND twin IS NULL").select("id", "prefix").mapInArrow(run, "id long, token long")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Intersection sizes of the sets numbered left with those numbered right, by products of membership matrices, some tokens at a time."""
    both = np.union1d(left, right)
    token = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    kinds, column, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column, n = owner[keep], shared[column[keep]], int((times > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    rows, cols = np.searchsorted(both, left), np.searchsorted(both, right)
    for a in range(0, n, width):
        part = slice(*np.searchsorted(column, [a, a + width]))
        m = np.zeros((len(both), min(width, n - a)), dtype=np.float32)
        m[owner[part], column[part] - a] = 1
        out += m[rows] @ m[cols].T
    return out.astype(np.int64)


def linked(common: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    return (100 * common >= 80 * (n_left[:, None] + n_right - common)) & (common > 0)


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of documents and hubs that their sketches don't rule out, without these."""
    for batch in batches:
        at = {name: batch.column(name) for name in batch.schema.names}
        n, n_h = at["n"].to_numpy(), at["n_h"].to_numpy()
        keep = np.array([bool(may_link([x], [y], n[i : i + 1], n_h[i : i + 1])[0, 0]) for i, (x, y) in enumerate(zip(at["sketch"].to_pylist(), at["sketch_h"].to_pylist(), strict=True))], dtype=bool)
        names = ["id", "hub", "salt", "alike"]
        yield pa.RecordBatch.from_arrays([at[c].filter(pa.array(keep)) for c in names], names=names)


def _verify(rows: pa.Table) -> pa.Table:
    """Links of members with their hubs, from whole texts."""
    sets = shingle_sets(rows.column("text"))
    n = np.array([len(s) for s in sets])
    ids, hub, salt, is_hub = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hub", "salt", "is_hub"))
    order, found = np.lexsort((salt, hub)), []
    for at in np.split(order, np.flatnonzero((np.diff(hub[order]) != 0) | (np.diff(salt[order]) != 0)) + 1) if len(order) else []:
        for h in at[is_hub[at]].tolist():
            found += [(int(ids[i]), int(hub[i])) for i in at[~is_hub[at]].tolist() if linked(np.array([[len(np.intersect1d(sets[h], sets[i], assume_unique=True))]]), n[[h]], n[[i]])[0, 0]]
    return _pairs(found)


def _blocks(rows: pa.Table, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of a task: row numbers left and right, and which of their pairs have sizes that may link and aren't in one component."""
    ids, hub, component, side = (rows.column(c).to_numpy() for c in ("id", "hub", "component", "side"))
    _, block = np.unique(rows.column("block").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    order = np.lexsort((ids, block, hub))
    for at in np.split(order, np.flatnonzero((np.diff(hub[order]) != 0) | (np.diff(block[order]) != 0)) + 1) if len(order) else []:
        left, right = at[side[at] <= 0], at[side[at] >= 0]
        if not len(left) or not len(right):
            continue
        small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
        fit = (5 * small >= 4 * large) & (component[left][:, None] != component[right])
        if side[at[0]] == 0:  # a block with itself: each pair once
            fit &= ids[left][:, None] < ids[right]
        if fit.any():
            yield left, right, fit


def _likely(rows: pa.Table) -> pa.Table:
    """The rows that are in a pair which sizes, components and sketches leave open."""
    keep, sketches, n = np.zeros(len(rows), dtype=bool), rows.column("sketch").to_pylist(), rows.column("n").to_numpy()
    for left, right, fit in _blocks(rows, n):
        fit = fit & may_link([sketches[i] for i in left], [sketches[i] for i in right], n[left], n[right])
        keep[left[fit.any(axis=1)]] = keep[right[fit.any(axis=0)]] = True
    return rows.select(["id", "hub", "component", "block", "side"]).filter(pa.array(keep))


def _matched(rows: pa.Table) -> pa.Table:
    """The rows that are in a pair with as many prefix entries in common as the smaller of their match numbers."""
    keep, n, matches = np.zeros(len(rows), dtype=bool), rows.column("n").to_numpy(), rows.column("matches").to_numpy()
    flat = rows.column("prefix").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())])
    tokens = flat.flatten().to_numpy()
    prefix = [np.unique(tokens[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for left, right, fit in _blocks(rows, n):
        fit = fit & (common_counts(prefix, left, right) >= np.minimum(matches[left][:, None], matches[right]))
        keep[left[fit.any(axis=1)]] = keep[right[fit.any(axis=0)]] = True
    return rows.select(["id", "hub", "component", "block", "side"]).filter(pa.array(keep))


def _compare(rows: pa.Table) -> pa.Table:
    """Links within blocks, from whole texts; of links that close a circle within a block, one is left out."""
    sets = shingle_sets(rows.column("text"))
    ids, n, found = rows.column("id").to_numpy(), np.array([len(s) for s in sets]), []
    for left, right, fit in _blocks(rows, n):
        fit &= linked(common_counts(sets, left, right), n[left], n[right])
        found += _spanning([(int(ids[left[x]]), int(ids[right[y]])) for x, y in zip(*np.nonzero(fit), strict=True)])
    return _pairs(found)


def _spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for a, b in links:
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            kept.append((a, b))
    return kept


def _in_tasks(rows: DataFrame, keys: list[str], n: int, function, schema: str) -> DataFrame:
    """function on groups of rows of about A_TASK out of n; rows with equal keys stay together."""
    task = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n // A_TASK))))
    return rows.withColumn("task", task).groupBy("task").applyInArrow(lambda t: function(t.drop_columns("task")), schema)


def _groups(sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """members: id, hub, k (shared prefix entries of that hub) and salt of each document and hub; hubs: hub and how many salts.

    A shingle's hub is the least id with it in its prefix. Entries are counted before they are shuffled; those of shingles that no other document
    has are filtered out before the second shuffle, whose hot shingles Spark's skew join can split.
    """
    rows = sizes.where("id IS NOT NULL AND twin IS NULL").select("id", F.explode("prefix").alias("token"))
    tokens = scratch.write(rows.groupBy("token").agg(F.count("*").alias("k"), F.min("id").alias("hub")).where("k > 1").drop("k"))
    first = entries(sizes, tokens).join(tokens, "token").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("k"))
    first = scratch.write(first)
    scratch.drop(tokens)
    hot = scratch.write(first.groupBy("hub").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("salts")).where("salts > 1"))
    if hot.count() <= HOT_HUBS:  # else Spark joins by hub, parting the hot ones
        hot = F.broadcast(hot)
    members = first.join(hot, "hub", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    members = scratch.write(members)
    scratch.drop(first)
    return members.drop("salts"), scratch.write(members.select("hub", "salts").distinct())


def _salted(hubs: DataFrame, facts: DataFrame) -> DataFrame:
    """facts of ids, for each hub and each of its salts."""
    return hubs.join(facts.withColumnRenamed("id", "hub"), "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _hub_links(docs: DataFrame, sizes: DataFrame, members: DataFrame, hubs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of documents with hubs: candidates share as many prefix entries as the smaller of the match numbers; sketches, then whole texts decide."""
    narrow = sizes.where("id IS NOT NULL AND twin IS NULL").select("id", "n", "key", "matches", "sketch")
    hub = narrow.select("id", *(F.col(c).alias(f"{c}_h") for c in ("n", "key", "matches", "sketch")))
    fit = (5 * F.least("n", "n_h") >= 4 * F.greatest("n", "n_h")) & (F.col("k") >= F.least("matches", "matches_h"))
    pairs = members.join(narrow, "id").join(_salted(hubs, hub), ["hub", "salt"]).where(fit).withColumn("alike", F.col("key") == F.col("key_h"))
    found = scratch.write(pairs.select("id", "hub", "salt", "alike", "n", "n_h", "sketch", "sketch_h").mapInArrow(_sketched, "id long, hub long, salt int, alike boolean"))
    open_ = found.where("NOT alike").select("id", "hub", "salt").distinct()
    asked = open_.withColumn("is_hub", F.lit(False)).unionByName(open_.select(F.col("hub").alias("id"), "hub", "salt").distinct().withColumn("is_hub", F.lit(True)))
    asked = scratch.write(asked)
    texts = among(_texts(docs).where("id IS NOT NULL"), asked.select("id").distinct())
    checked = _in_tasks(asked.join(texts, "id"), ["hub", "salt"], asked.count(), _verify, "a long, b long")
    return scratch.write(found.where("alike").select(F.col("id").alias("a"), F.col("hub").alias("b")).unionByName(checked))


def _open_links(docs: DataFrame, sizes: DataFrame, members: DataFrame, hubs: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between members of one hub's group that known, the components so far, doesn't join yet.

    Members in their hub's component are home, others away; two that are home need no comparison. Sizes fall into classes of
    ratio 1.25, so links are within a class or between neighbouring ones. Classes are dealt into blocks of BLOCK, and a block meets those
    of its own and the neighbouring classes, one side being away: sketches first, then the prefixes, of which a pair must share as many entries as the smaller of its match numbers, then the whole texts of what these leave open.
    """
    narrow = sizes.where("id IS NOT NULL AND twin IS NULL").select("id", "n", "sketch")
    of_hub = _salted(hubs, known.withColumnRenamed("component", "hub_component"))
    rows = members.join(known, "id", "left").join(of_hub, ["hub", "salt"], "left")
    rows = scratch.write(rows.select("id", "hub", "salt", F.coalesce("component", "id").alias("component"), F.coalesce("hub_component", "hub").alias("hub_component")))
    away = F.col("component") != F.col("hub_component")
    open_ = rows.groupBy("hub").agg(F.count_if(away).alias("n_away"), F.count("*").alias("n_all")).where("n_away > 0 AND n_all > 1").select(F.col("hub").alias("id"))
    part = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    rows = rows.join(_salted(hubs, open_), ["hub", "salt"]).join(narrow, "id").select("id", "hub", "salt", "component", away.alias("away"), part.alias("part"), "n", "sketch")
    rows = scratch.write(rows)
    counted = rows.groupBy("hub", "away", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of_kind = [F.map_from_entries(F.collect_list(F.when(F.col("away") == kind, F.struct("part", "blocks")))).alias(name) for kind, name in ((True, "aways"), (False, "homes"))]
    rows = rows.join(_salted(hubs, counted.groupBy(F.col("hub").alias("id")).agg(*of_kind)), ["hub", "salt"])

    def blocks(kind: str, of: str) -> str:
        near = (f"transform(filter(sequence(0, coalesce({of}[part + {d}], 0)), o -> o < coalesce({of}[part + {d}], 0)), o -> struct('{kind}' AS kind, part + {d} AS part, o AS i))" for d in (-1, 0, 1))
        return f"flatten(array({', '.join(near)}))"

    mine = F.expr("struct(if(away, 'a', 'h') AS kind, part AS part, cast(pmod(xxhash64(id), if(away, aways, homes)[part]) AS int) AS i)")
    others = F.expr(f"if(away, concat({blocks('a', 'aways')}, {blocks('h', 'homes')}), {blocks('a', 'aways')})")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), -1).otherwise(1)
    label = F.concat_ws("|", F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string"))
    dealt = scratch.write(dealt.select("id", "hub", "component", "n", "sketch", label.alias("block"), side.cast("int").alias("side")))
    scratch.drop(rows)
    n = dealt.count()
    likely = scratch.write(_in_tasks(dealt, ["hub", "block"], n, _likely, "id long, hub long, component long, block string, side int").distinct())
    held = likely.join(sizes.where("id IS NOT NULL AND twin IS NULL").select("id", "n", "matches", "prefix"), "id")
    likely = scratch.write(_in_tasks(held, ["hub", "block"], likely.count(), _matched, "id long, hub long, component long, block string, side int").distinct())
    texts = among(_texts(docs).where("id IS NOT NULL"), likely.select("id").distinct())
    return _in_tasks(likely.join(texts, "id"), ["hub", "block"], likely.count(), _compare, "a long, b long")


def similar_links(docs: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) whose components are those of all links. sizes: prefixes(docs), written.

    Any two documents that share a prefix shingle are in the group of its hub. First documents are held against hubs with which they share as many
    prefix shingles as the smaller of the match numbers; if a pair shares more under another hub, that hub's group has both. So a
    group of near copies gives a pair a document and hub, not all pairs. What is then in one component needs no more looks; the pairs left inside
    groups are compared in blocks.
    """
    twins = sizes.where("twin IS NOT NULL").select(F.col("id").alias("a"), F.col("twin").alias("b"))
    members, hubs = _groups(sizes, scratch)
    links = scratch.write(_hub_links(docs, sizes, members, hubs, scratch).unionByName(twins))
    known = components(links, scratch)
    return links.unionByName(_open_links(docs, sizes, members, hubs, known, scratch))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable over links of Jaccard 0.8 or more.

    Words are parted by space and \\x09-\\x0D, A-Z lower-cased. Null or empty texts have no shingles and no links. A null doc_id has no
    component (null) and takes part in no link. Rows with equal doc_id are one node with all their links. Empty input: no rows. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        sizes = scratch.write(prefixes(docs))
        own = written(sizes.select("id", "n"))
        found = components(similar_links(docs, sizes, scratch)).select(F.col("id").alias("_jc_id"), "component")
    return own.join(found, F.col("id") == F.col("_jc_id"), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op1_adaptive_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
