"""Exact dedup by recipes, spelling variants and ranked search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from leafworks.functions.folders import shared_dir
from leafworks.llm import licenses, ranked, recipes, spelling
from leafworks.llm.storage import Stage, written


def brute_copies(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    return Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)


def copies_of(out):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out)


def long_texts():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "Größe", "delta"]) + str(rng.randrange(1000)) for _ in range(60))
    a = "\n".join(line() for _ in range(300))
    b = a[:50_000] + "!" + a[50_000:]
    return [(1, a), (2, b), (3, a), (4, a[1:]), (5, b), (6, a + a), (7, "x" * 100_000), (8, "x" * 100_000), (9, "x" * 99_999)]


def test_equal_texts_are_found(make, corpus):
    texts = corpus + [(1000 + i, t) for i, t in long_texts()]
    out = recipes.exact_duplicates(make(texts)).collect()
    assert copies_of(out) == brute_copies(texts)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert max(r.n_chunks for r in out) > 20 and any(r.group_size > 1 and r.n_chunks > 20 for r in out)


def test_copies_odd_rows(make, odd_texts, spark):
    out = recipes.exact_duplicates(make(odd_texts, clashing=True)).collect()
    assert copies_of(out) == brute_copies(odd_texts)
    kept = defaultdict(int)
    for r in out:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert recipes.exact_duplicates(make([])).collect() == []


def test_chunks_move_with_their_content():
    a = long_texts()[0][1].encode()
    ends = lambda x: recipes.cuts(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]))[0]
    one, two = ends(a), ends(b"!" + a) - 1
    assert len(set(one) & set(two)) > 0.9 * len(one)
    sizes = np.diff(np.concatenate([[0], one]))
    assert sizes.max() <= recipes.MOST and (sizes[:-1] >= recipes.LEAST).all()


def test_chunks_that_share_an_identifier_are_told_apart(make, corpus):
    salts = []

    def weak(chunk, salt):
        return bytes(16) if salt == 0 else hashlib.blake2b(chunk, digest_size=16).digest()

    texts = corpus + [(1000 + i, t) for i, t in long_texts()]
    assert copies_of(recipes.exact_duplicates(make(texts), weak).collect()) == brute_copies(texts)
    docs = make(texts)
    for salt in (0, 1):
        found = recipes._recipes(docs, salt, weak)
        salts.append(recipes._unsafe(docs, found, salt, weak))
    assert salts == [True, False]


def test_copies_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = Counter(con.sql(recipes.OP12_SQL).fetchall())
    got = Counter(tuple(r) for r in recipes.op12_chunk_recipes(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def brute_spelling(texts):
    count = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    mates = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {}
    for w, found in mates.items():
        top = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(mates[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def variants(seed, n=1500, letters="abé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    texts = []
    for i in range(n):
        row = []
        for _ in range(20):
            w = base[min(int(rng.expovariate(0.15)), 59)]
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters + "cÀ") + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            row.append(w.capitalize() if rng.random() < 0.2 else w)
        texts.append((i, ", ".join(row)))
    return texts


@pytest.mark.parametrize("group", [None, 5])
def test_spelling_variants_are_those_of_all_pairs(make, group):
    texts = variants(1)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(make(texts), group).collect()}
    want = brute_spelling(texts)
    assert got == want
    assert sum(x[2] is not None for x in want.values()) > 20 and max(x[1] for x in want.values()) > 10


def test_forms_are_followed_to_their_root(make):
    # each rarer by ten times: a chain of forms
    texts = [(i, " ".join(["abcdefg"] * 100 + ["abcdefh"] * 1)) for i in range(40)] + [(100 + i, "abcdefhx " * 1) for i in range(3)]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(make(texts)).collect()}
    assert got == brute_spelling(texts)
    assert any(x[2] and x[4] != x[2] for x in got.values())


def test_spelling_odd_rows(make, odd_texts):
    odd = [*odd_texts, (50, "a" * 30_000), (51, "a" * 30_001), (50, "a" * 30_000), (51, "a" * 30_001), (None, "Repeated repeated"), (None, "repeateD × ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷")]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(make(odd, clashing=True)).collect()}
    assert got == brute_spelling(odd)
    assert spelling.spelling_variants(make([])).collect() == []
    assert spelling.spelling_variants(make([(1, None), (2, "")])).collect() == []


def brute_ranks(texts, items):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    docs = [(i, Counter(words(t))) for i, t in texts if words(t)]
    big_n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * big_n) // total
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(words(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:50])]
    return Counter(out)


def ranks(spark, docs, items):
    return Counter(tuple(r) for r in ranked.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string")).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize(("cells", "vocabulary"), [(1 << 23, 8192), (2000, 40)])
def test_ranks_are_those_of_all_documents(spark, make, corpus, monkeypatch, cells, vocabulary):
    monkeypatch.setattr(ranked, "CELLS", cells)
    monkeypatch.setattr(ranked, "VOCABULARY", vocabulary)
    texts = corpus + [(1000 + i, corpus[5][1]) for i in range(80)] + [(2000 + i, t.upper()) for i, t in corpus[:30]]
    items = [(i, " ".join(t.split()[:25])) for i, t in corpus[::12]] + [(900, corpus[5][1]), (901, "nothing here"), (902, None), (903, ""), (904, "ban Ban BAN ban-q!"), (904, "ban Ban BAN ban-q!")]
    assert ranks(spark, make(texts), items) == brute_ranks(texts, items)


def test_ranks_odd_rows(spark, make, odd_texts):
    items = [(1, "One two SIX id"), (2, "w5x5 w6x6 dup ünï"), (None, "word here x"), (3, None)]
    assert ranks(spark, make(odd_texts, clashing=True), items) == brute_ranks(odd_texts, items)
    assert not ranks(spark, make([]), items) and not ranks(spark, make(odd_texts), [])


def test_limits_hold_and_prune():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 900_000, (8, 300)) * (rng.random((8, 300)) < 0.1)
    rows = (centre[rng.integers(0, 8, 2000)] * (rng.random((2000, 300)) < 0.9)).astype(np.float32)
    tree = ranked.BallTree(rows, np.arange(2000))
    queries = [(np.sort(rng.permutation(300)[:20]), rng.integers(1, 9000, 20)) for _ in range(10)]
    weights = np.zeros((10, 300))
    for i, (t, w) in enumerate(queries):
        weights[i, t] = w
    limits, exact = tree.limits(weights), tree.rows.astype(np.int64) @ weights.astype(np.int64).T
    for node, (a, b) in enumerate(tree.span):
        assert (exact[a:b].max(axis=0) <= limits[node]).all()
    best = [ranked.Best() for _ in queries]
    assert ranked.search(tree, queries, best) < 0.6 * 10 * 2000
    for i in range(10):
        want = np.lexsort((tree.ids, -exact[:, i]))[:50]
        assert best[i].ids.tolist() == tree.ids[want].tolist() and best[i].score.tolist() == exact[want, i].tolist()


def test_ranks_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert Counter(tuple(r) for r in ranked.op11_ball_tree(spark, "/root/testdata/sf0.001").collect()) == Counter(con.sql(ranked.OP11_SQL).fetchall())


def test_long_phrases_are_compared_whole(make):
    texts = [(1, "the quick brown fox sleeps now"), (2, "the quick brown fox runs"), (3, "quick brown"), (4, "the quick brown fox sleep")]
    docs, _ = licenses.scan_licenses(make(texts), phrases={"the quick brown fox sleeps": "long", "quick brown": "short"})
    assert sorted((r.doc_id, r.n_base, r.base_labels) for r in docs.collect()) == [(1, 2, "long,short"), (2, 1, "short"), (3, 1, "short"), (4, 1, "short")]


def test_stages_leave_only_their_results(spark, make):
    import os

    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    with Stage(spark) as one:
        kept = one.keep(written(make([(1, "a")])))
    assert kept.count() == 1 and len(set(os.listdir(folder)) - before) == 1
    one.drop()
    assert set(os.listdir(folder)) == before
