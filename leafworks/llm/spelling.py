"""Spelling variants: pairs one edit apart by composing the vocabulary's acceptor with a one-edit transducer and itself."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, small_batches, table, written
from .words import U64, counting, mix

#: Code points and occurrences of a word at least; a form occurs so many times as often as its variant.
LETTERS, TIMES, RATIO = 7, 2, 10
#: A run loses a letter where this divides its hash.
DROP = 31
#: Words of a group of initial states at most, unless all its words differ in their last free letters only; letters of a bucket.
GROUP, BUCKET = 20_000, 1 << 20
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LETTERS},}}")


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, some with a letter dropped by the hash of doc_id and run. Tasks count before anything is shuffled; words too short or too rare go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in Counter(RUNS.findall((text or "").encode().lower().decode())).items():
                    if (h := zlib.crc32(w.encode(), start)) % DROP == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < LETTERS:
                            continue
                    total[w] += n
            if len(total) > 200_000:
                yield out()
                total.clear()
        yield out()

    parts = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


class Acceptor:
    """The minimal deterministic acceptor of sorted different strings of two lengths, each after its group's number.

    nodes are the different prefixes: depth, state (prefixes with the same continuations share one), word (the number of the first word below) and group. Transitions of a state lie
    together by label: first[s]:first[s + 1]; skip is how many of the state's words come before those of the label, so that a path's skips add up to its word's number.
    """

    def __init__(self, group: np.ndarray, letters: np.ndarray, size: np.ndarray):
        n, wide = letters.shape
        same = np.concatenate([[False], group[1:] == group[:-1]])
        common = np.zeros(n, dtype=np.int64)  # letters shared with the word before
        if n > 1:
            differ = letters[1:] != letters[:-1]
            common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        new = np.where(same, size - np.minimum(common, size), size + 1)  # prefixes first seen with this word, the empty one included
        word = np.repeat(np.arange(n), new)
        depth = size[word] - (np.repeat(new, new) - 1 - counting(new))
        self.depth, self.word = depth, word
        # the parent of a node is the last one made before it at the depth above
        order = np.lexsort((np.arange(len(depth)), depth))
        bounds = np.searchsorted(depth[order], np.arange(wide + 2))
        parent = np.full(len(depth), -1)
        for d in range(1, wide + 1):
            mine, above = order[bounds[d] : bounds[d + 1]], order[bounds[d - 1] : bounds[d]]
            if len(mine):
                parent[mine] = above[np.searchsorted(above, mine) - 1]
        label = np.where(depth > 0, letters[word, np.maximum(depth, 1) - 1], 0).astype(np.int64)
        final = np.zeros(len(depth), dtype=bool)
        ends = np.cumsum(new) - 1  # a word's own node is the last that it makes, as no word comes twice
        final[ends] = True
        h, seed = final.astype(U64) + U64(1), 0
        words = final.astype(np.int64)
        for d in range(wide, 0, -1):
            mine = order[bounds[d] : bounds[d + 1]]
            np.add.at(h, parent[mine], mix(mix(h[mine]) ^ (label[mine].astype(U64) * U64(0x9E3779B97F4A7C15))))
            np.add.at(words, parent[mine], words[mine])
        _, rep, self.state = np.unique(h, return_index=True, return_inverse=True)
        inner = np.flatnonzero(depth > 0)
        # transitions of the representatives, in order of state and label
        chosen = np.zeros(len(depth), dtype=bool)
        chosen[rep] = True
        arcs = inner[chosen[parent[inner]]]
        arcs = arcs[np.lexsort((label[arcs], self.state[parent[arcs]]))]
        source = self.state[parent[arcs]]
        self.label, self.target = label[arcs], self.state[arcs]
        self.first = np.searchsorted(source, np.arange(len(rep) + 1))
        self.degree = np.diff(self.first)
        self.final = final[rep]
        below = np.concatenate([[0], np.cumsum(words[arcs])])
        self.skip = below[:-1] - below[self.first[source]] + self.final[source]
        self.key = source * 512 + self.label
        # prefixes that were given one state by their hash must have the same ends and transitions
        all_arcs = inner[np.lexsort((label[inner], parent[inner]))]
        place = np.searchsorted(self.key, self.state[parent[all_arcs]] * 512 + label[all_arcs])
        fine = (final == self.final[self.state]).all() and (np.bincount(parent[inner], minlength=len(depth)) == self.degree[self.state]).all()
        if not fine or (self.target[np.minimum(place, len(self.key) - 1)] != self.state[all_arcs]).any():
            raise ArithmeticError("two states share a hash")

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All transitions of the states: which of them, and the transition's number."""
        deg = self.degree[states]
        return np.repeat(np.arange(len(states)), deg), np.repeat(self.first[states], deg) + counting(deg)

    def find(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The number of each state's transition with a label, or -1."""
        if not len(self.key):
            return np.full(len(states), -1)
        at = np.minimum(np.searchsorted(self.key, states * 512 + labels), len(self.key) - 1)
        return np.where(self.key[at] == states * 512 + labels, at, -1)


def near_pairs(a: Acceptor, size: np.ndarray, longest: int, low: np.ndarray, cap: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words one edit apart, each pair once: paths of acceptor, one-edit transducer and acceptor.

    Before the edit both sides are in the state of one prefix, of low to cap - 1 letters; there the first side replaces its letter (both of the longest size) or has one more, and the second goes on with
    another one than that, so the edit stands where the words first differ. After it both read the same letters.
    """
    left, right = [], []
    ready = np.flatnonzero((a.depth >= low[a.word]) & (a.depth < cap[a.word]))
    for part in range(0, len(ready), block):
        at = ready[part : part + block]
        state, base = a.state[at], a.word[at]
        who, arc = a.arcs(state)
        # one letter more on the first side
        p, q, i, j, ban = a.target[arc], state[who], base[who] + a.skip[arc], base[who], a.label[arc]
        # a letter replaced: transitions of one state in pairs
        later = np.repeat(a.first[state + 1], a.degree[state]) - arc - 1
        x, y = np.repeat(arc, later), np.repeat(arc, later) + 1 + counting(later)
        owner = np.repeat(who, later)
        p, q = np.concatenate([p, a.target[x]]), np.concatenate([q, a.target[y]])
        i, j = np.concatenate([i, base[owner] + a.skip[x]]), np.concatenate([j, base[owner] + a.skip[y]])
        ban = np.concatenate([ban, np.full(len(x), -1)])
        swap = np.concatenate([np.zeros(len(arc), dtype=bool), np.ones(len(x), dtype=bool)])
        while len(p):
            done = np.flatnonzero(a.final[p] & a.final[q])
            done = done[~swap[done] | (size[i[done]] == longest)]
            left.append(i[done])
            right.append(j[done])
            who, arc = a.arcs(p)
            go = np.flatnonzero(a.label[arc] != ban[who])
            who, arc = who[go], arc[go]
            other = a.find(q[who], a.label[arc])
            go = np.flatnonzero(other >= 0)
            who, arc, other = who[go], arc[go], other[go]
            p, q, i, j, swap = a.target[arc], a.target[other], i[who] + a.skip[arc], j[who] + a.skip[other], swap[who]
            ban = np.full(len(p), -1)
    return np.concatenate([*left, np.zeros(0, dtype=np.int64)]), np.concatenate([*right, np.zeros(0, dtype=np.int64)])


def _near(rows: pa.Table) -> pa.Table:
    """Of each word of the bucket's groups that has near words there: their number, and of the most frequent ones the first. Rows come by the length of a group's longer words."""
    words, counts, best, shown = [], [], [], []
    longest = rows.column("longest").to_numpy()
    for m in np.unique(longest).tolist():
        some = rows.filter(pa.array(longest == m))
        text = some.column("word").to_pylist()
        size = np.array([len(w) for w in text])
        flat = np.frombuffer("".join(text).encode("latin-1"), dtype=np.uint8)  # all letters are below U+0100
        letters = np.zeros((len(text), m), dtype=np.uint8)
        letters[np.repeat(np.arange(len(text)), size), counting(size)] = flat
        _, group = np.unique(np.array(some.column("key").to_pylist()), return_inverse=True)
        order = np.lexsort((letters.view(f"S{m}").ravel(), group))
        size, letters, group = size[order], letters[order], group[order]
        low, cap, n = (some.column(c).to_numpy()[order] for c in ("low", "cap", "n"))
        i, j = near_pairs(Acceptor(group, letters, size), size, m, low, cap)
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        first = np.lexsort((j, -n[j], i))
        own, head, times = np.unique(i[first], return_index=True, return_counts=True)
        words += [text[k] for k in order[own].tolist()]
        counts.append(times)
        best.append(n[j[first[head]]])
        shown += [text[k] for k in order[j[first[head]]].tolist()]
    whole = lambda x: pa.array(np.concatenate([*x, np.zeros(0, dtype=np.int64)]), pa.int64())
    return pa.table([pa.array(words, pa.string()), whole(counts), whole(best), pa.array(shown, pa.string())], names=["word", "n_near", "form_n", "form"])


def _halves(rows: DataFrame) -> DataFrame:
    """Both groups of each row whose words may be near inside its group: words that share the first half of what is free, and words that share the second and differ before."""
    free = F.col("longest") - 1 - F.col("low") - F.col("high")
    half = F.floor(free / 2).cast("int")
    first = F.struct((F.col("low") + half).alias("low"), F.col("high").alias("high"), F.col("cap").alias("cap"))
    second = F.struct(F.col("low").alias("low"), (F.col("high") + free - half).alias("high"), F.least("cap", F.col("low") + half).alias("cap"))
    parts = rows.select("word", "n", "longest", F.explode(F.array(first, second)).alias("p")).select("word", "n", "longest", "p.*").where("low < cap")
    ends = F.concat_ws("|", "longest", "low", "high", "cap", F.substring(F.col("word"), F.lit(1), F.col("low")), F.expr("right(word, high)"))
    return parts.withColumn("key", ends)


def near_words(words: DataFrame, group: int | None = None) -> DataFrame:
    """word, n_near and the near word that is most frequent (form, form_n; of equal ones the first in code-point order), of words (word, n) that have near words.

    Near words of at most m letters share the first half of m - 1 letters or the last: a group's words start from one state of the acceptor (the second time with a common end). Groups of more than GROUP
    words are halved again, down to one free letter, so no group holds more words than some 8,000 or GROUP. Buckets of whole groups are composed apart; each pair is found in one group only.
    """
    group = group or GROUP
    small_batches(words.sparkSession)
    with Scratch(words.sparkSession) as keep:
        start = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longest"))
        todo = start.select("*", F.lit(0).alias("low"), F.lit(0).alias("high"), F.col("longest").alias("cap"))
        ready = None
        while True:
            parts = keep.write(_halves(todo))
            can = F.col("longest") - 1 - F.col("low") - F.col("high") > 1
            big = keep.write(parts.where(can).groupBy("key").count().where(F.col("count") > group).select("key"))
            # as many keys as there are groups of that size at most
            large = big.count()
            if not large:
                ready = parts if ready is None else ready.unionByName(parts)
                break
            big = F.broadcast(big) if large < 1_000_000 else big
            some = parts.join(big, "key", "left_anti")
            ready = some if ready is None else ready.unionByName(some)
            todo = parts.join(big, "key", "left_semi").drop("key")
        size = ready.agg(F.sum("longest")).first()[0] or 0
        buckets = max(1, -(-size // BUCKET))
        found = ready.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_near, "word string, n_near long, form_n long, form string")
        best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
        return written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following form from word to word ends. The distance covered doubles in each round; a form is at least RATIO times as frequent as its word, so rounds are few."""
    with Scratch(forms.sparkSession) as keep:
        now = keep.write(forms.select("word", F.col("form").alias("root")))
        while True:
            onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
            step = keep.write(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            if step.where("moved").isEmpty():
                return written(step.select("word", "root"))
            last, now = now, step.drop("moved")
            keep.drop(last)


def spelling_variants(docs: DataFrame, group: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of 7 letters and 2 occurrences at least in all texts.

    Null or empty text: no words. A null doc_id is hashed as no text. Rows with equal doc_id count each. A run may be of any length. No words: no rows. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    words = written(occurrences(docs))
    near = near_words(words, group)
    both = words.join(near, "word", "left")
    is_form = F.col("form_n") >= RATIO * F.col("n")
    both = both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    ends = roots(both.where("form IS NOT NULL"))
    return both.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")
