"""Quality rules: cross-document line frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import _bitmap, _may_have
from .storage import small_batches, table, written
from .words import BLANK, Words, covered, mix, sequence_hashes, span_sums, utf8

SIGNS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
NEWLINE = np.arange(256) == 10

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "array<struct<key: long, line: long, words: long>>"


def _repeats(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (text, hash) pairs occur twice or more, and which are not the first of their kind; input order is kept."""
    order = np.lexsort((np.arange(len(h)), h, text))
    t, v = text[order], h[order]
    same = (t[1:] == t[:-1]) & (v[1:] == v[:-1])
    again, later = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    later[order[1:][same]] = True
    return again, later


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The measures of each text, and its lines with words: (text's number, hash of the normalised line, words)."""
    raw, at = utf8(texts)
    words = Words(raw, at, BLANK)
    n, text = len(texts), words.text_of()
    new_char = (raw & 0xC0) != 0x80
    chars = span_sums(new_char, words.start, words.end)
    out = {
        "n_words": words.count,
        "word_chars": np.bincount(text, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": span_sums(SIGNS[raw], at[:-1], at[1:]),
    }
    # lines by their exact bytes, and normalised: lower-cased words in turn, whatever the space between them
    lines = Words(raw, at, NEWLINE)
    line_text = lines.text_of()
    first, last = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    worded = last > first
    _, later = _repeats(line_text[worded], lines.hashes()[worded])
    out["n_dup_lines"] = np.bincount(line_text[worded], weights=later, minlength=n).astype(np.int64)
    h = words.hashes(lower=True)
    place = np.arange(len(h)) - np.repeat(first[worded], (last - first)[worded]) if len(h) else np.zeros(0, dtype=np.int64)
    signed = mix(h ^ mix(place.astype(np.uint64) + np.uint64(1)))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(signed, dtype=np.uint64)])
    line_hash = mix(total[last[worded]] - total[first[worded]]).view(np.int64)
    # repeated 3-word windows, by the words as they are
    start = words.windows(3)
    again, _ = _repeats(text[start], sequence_hashes(words.hashes(), start, 3))
    out["n_repeat_words"] = np.bincount(text, weights=covered(len(text), start[again], 3), minlength=n).astype(np.int64)
    return out, (line_text[worded], line_hash, (last - first)[worded])


def _host_keys(hosts: pa.Array, text: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of each line with its text's host; a null host is one of its own."""
    w = Words(*utf8(hosts), np.zeros(256, dtype=bool))
    own = np.zeros(len(hosts), dtype=np.uint64)
    own[w.text_of()] = w.hashes(seed=3)
    own[~hosts.is_valid().to_numpy(zero_copy_only=False)] = 1
    return mix(mix(own)[text] ^ line.view(np.uint64)).view(np.int64)


def _distinct(text: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by text and line, where each different one starts in it, and the texts' bounds among these need no more than text[order][starts]."""
    order = np.lexsort((line, text))
    t, v = text[order], line[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return order, np.flatnonzero(new), t


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """key (of host and line) and line of each different normalised line with a word of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, (text, line, _) = measure(batch.column(1))
            order, starts, t = _distinct(text, line)
            own = line[order][starts]
            yield pa.RecordBatch.from_arrays([pa.array(_host_keys(batch.column(0), t[starts], own)), pa.array(own)], names=["key", "line"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(run, "key long, line long")


def measured(docs: DataFrame, host: str, common: np.ndarray) -> DataFrame:
    """doc_id, text, the measures, lines (the distinct normalised lines with a word that are, by a filter, perhaps common on the host, each with its key and its words in all its places), and whether there are any."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, (text, line, size) = measure(batch.column(2))
            order, starts, t = _distinct(text, line)
            size = np.add.reduceat(size[order], starts) if len(starts) else size[:0]
            t, line = t[starts], line[order][starts]
            key = _host_keys(batch.column(1), t, line)
            some = np.flatnonzero(_may_have(shared.value, key))
            items = pa.StructArray.from_arrays([pa.array(key[some]), pa.array(line[some]), pa.array(size[some].astype(np.int64))], names=["key", "line", "words"])
            ends = np.searchsorted(t[some], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(out[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(np.diff(ends) > 0)],
                names=["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "perhaps"],
            )

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {MEASURES}, lines {LINES}, perhaps boolean")


def cleaned(rows: DataFrame) -> DataFrame:
    """rows with text cleaned: without the lines whose normalised hashes are in gone (null: none), the others as they are; gone is left out."""
    kept = [c for c in rows.columns if c not in ("text", "gone")]
    rows = rows.select(*kept, "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, gone = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1)
            which = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            _, (text, line, _) = measure(batch.column(len(kept)).take(pa.array(which)))
            ends = np.searchsorted(text, np.arange(len(which) + 1))
            for n, i in enumerate(which.tolist()):
                drop, hashes = set(gone[i].as_py()), iter(line[ends[n] : ends[n + 1]].tolist())
                out[i] = "\n".join(x for x in out[i].split("\n") if not (x.strip(" \t\x0b\x0c\r") and next(hashes) in drop))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string())], names=[*kept, "cleaned"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, rows.select(*kept, F.col("text").alias("cleaned")).schema)


def line_quality(docs: DataFrame, host: str = "source", max_docs: int = 20, least_left: float = 0.5, least_words: int = 50, most_repeated: float = 0.5, with_text: bool = True) -> DataFrame:
    """Judges every document by itself and by how common its lines are on its host.

    A line is normalised to its lower-cased words; lines found in more than max_docs documents of one host are
    removed from the text. base_failed: fewer than least_words words, or a share of words above most_repeated in repeated 3-word windows. kept:
    not base_failed, and at least least_left of the words lie in lines that stay.

    Only hashes of lines travel for the counts, counted in the tasks first. The texts are read once more for the measures: a document none of whose lines is, by a filter of 16 MB, perhaps common needs no
    join; only the others' texts are written and shuffled, to meet the lines that are to go. A null host is a host of its own; null or empty texts have no words
    and fail; rows with equal doc_id count as documents of their own. Empty input: no rows. Extra columns are ignored.
    Returns doc_id, the five measures, base_failed, kept, n_removed_lines and n_removed_words (distinct lines, and words in all their places),
    and, with_text, cleaned, the text without these lines (of documents that aren't kept too; a null text stays null).
    """
    common = written(host_lines(docs, host).groupBy("key", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).drop("n"))
    rows = measured(docs, host, _bitmap(common, "key"))
    rows = rows if with_text else rows.withColumn("text", F.lit(None).cast("string"))
    zero = F.lit(0).cast("long")
    clear = rows.where("NOT perhaps").drop("lines", "perhaps").withColumns({"n_removed_lines": zero, "n_removed_words": zero}).withColumnRenamed("text", "cleaned")
    some = written(rows.where("perhaps").drop("perhaps").withColumn("_lq_row", F.expr("uuid()")))
    seen = some.select("_lq_row", F.explode("lines").alias("l")).select("_lq_row", "l.key", "l.line", "l.words")
    gone = seen.join(common, ["key", "line"], "left_semi").groupBy("_lq_row").agg(F.count("*").alias("n_removed_lines"), F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("gone"))
    both = some.drop("lines").join(gone.hint("shuffle_hash"), "_lq_row", "left").drop("_lq_row")
    both = cleaned(both) if with_text else both.withColumnRenamed("text", "cleaned").drop("gone")
    out = clear.unionByName(both.na.fill(0, ["n_removed_lines", "n_removed_words"]).select(*clear.columns))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    stays = F.col("n_words") - F.col("n_removed_words") >= least_left * F.col("n_words")
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & stays)
    return out if with_text else out.drop("cleaned")


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents")).withColumn("cleaned_sha256", F.sha2(F.coalesce("cleaned", F.lit("")).cast("binary"), 256)).drop("cleaned")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM d),
lw AS (SELECT doc_id, source, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
ln AS (SELECT doc_id, source, line, i, len(w) AS words, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM lw WHERE len(w) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY 1),
dl AS (SELECT doc_id, source, norm, sum(words) AS words FROM ln GROUP BY 1, 2, 3),
common AS (SELECT source, norm FROM dl GROUP BY 1, 2 HAVING count(*) > 20),
gone AS (SELECT doc_id, count(*) AS lines, sum(words) AS words FROM dl SEMI JOIN common ON dl.norm = common.norm AND dl.source IS NOT DISTINCT FROM common.source GROUP BY 1),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
tg AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM tri),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tg) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY 1),
cl AS (SELECT l.doc_id, sha256(string_agg(l.line, chr(10) ORDER BY l.i)) AS cleaned_sha256 FROM (SELECT lw.doc_id, lw.source, lw.line, lw.i, translate(array_to_string(lw.w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM lw) l
  ANTI JOIN (SELECT source, norm FROM common) c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.lines, 0) AS n_removed_lines, coalesce(gone.words, 0)::BIGINT AS n_removed_words, coalesce(cl.cleaned_sha256, sha256('')) AS cleaned_sha256
  FROM w LEFT JOIN cl USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM m
"""
