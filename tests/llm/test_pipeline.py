"""The pipeline's stages against brute force on a small table."""

import random
import re

import pytest

import corpus_pipeline as pipeline
from leafworks.llm import mixing, packing
from tests.llm.test_operators import brute_components, brute_spans


@pytest.fixture(scope="module")
def sf_dir(spark, make, corpus, tmp_path_factory):
    rng = random.Random(8)
    root = tmp_path_factory.mktemp("sf")
    texts, labels = list(corpus), [(i, 1, 0) for i, _ in corpus]
    for i in range(300, 420):
        texts.append((i, " ".join(rng.choice(["idiot", "scum", "ban", "ker"]) for _ in range(30))))
        labels.append((i, 0, 1))
    texts += [(500, 'keep this token = "abcdef0123456789abcdef0123456789" and go on'), (501, None), (502, "")]
    make(texts).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), texts


def test_stages(spark, sf_dir):
    root, texts = sf_dir
    docs, given = spark.read.parquet(f"{root}/documents.parquet"), dict(texts)
    kept = pipeline.toxicity(spark, docs, root)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == pipeline.COLUMNS and not ids & set(range(300, 420)) and ids >= set(range(120)) | {500, 501, 502}

    once = pipeline.near_duplicates(spark, kept, root)
    comp, _ = brute_components([(i, given[i]) for i in ids])
    assert {r.doc_id for r in once.collect()} == {i for i in ids if comp[i] == i}

    clean = pipeline.secret_scan(spark, once, root)
    out = {r.doc_id: r for r in clean.collect()}
    assert out[500].text == "keep this [SECRET]\" and go on" and out[501].text is None
    assert all(not brute_spans(r.text or "") and r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())

    mixed = pipeline.mix_sources(spark, clean, root)
    assert mixed.columns == pipeline.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(out)

    packed = pipeline.pack_sequences(spark, mixed, root).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()


def test_run_is_the_stages_in_turn(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir[0])
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "mixing_sources", "best_fit_packing"]


@pytest.fixture(scope="module")
def odd(spark, make, odd_texts):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names; two rows of one id with different texts."""
    return make([*odd_texts, (40, "one text"), (40, "another text altogether")], clashing=True)


def key(r):
    return (-1 if r.doc_id is None else r.doc_id, r.text or "")


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES[:4]], ids=[n for n, _ in pipeline.STAGES[:4]])
def test_stages_on_odd_rows(spark, sf_dir, odd, make, stage):
    kept = stage(spark, odd, sf_dir[0])
    assert kept.columns == pipeline.COLUMNS
    rows = kept.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in odd.collect()}
    assert stage(spark, make([]), sf_dir[0]).count() == 0
    if stage is pipeline.near_duplicates:
        # of the copies 0 and 4 and the repeated row 7 one stays each; both texts of id 40, the null id and empty texts stay
        assert sorted(map(key, rows)) == sorted({key(r) for r in odd.collect()} - {(4, "One two three four five six.")})
    if stage is pipeline.secret_scan:
        assert sorted(map(key, rows)) == sorted(map(key, odd.collect()))
    if stage is pipeline.toxicity:
        assert {1, 2, 3} <= {r.doc_id for r in rows}


def test_last_stage_on_odd_rows(spark, sf_dir, odd, make):
    packed = pipeline.pack_sequences(spark, odd, sf_dir[0]).collect()
    assert sum(r.piece == 0 for r in packed) == odd.count() and all(len(r.ids) == r.length for r in packed)
    assert pipeline.pack_sequences(spark, make([]), sf_dir[0]).count() == 0


def test_mixing_stage_is_the_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    want = sorted(key(r) for r in mixing.poisson_mix(docs, mixing.WEIGHTS).collect())
    assert sorted(key(r) for r in pipeline.mix_sources(spark, docs, sf_dir[0]).collect()) == want


def test_public_path():
    assert re.search(r"word_bpe_49k\.json$", packing.public_path("word_bpe_49k.json"))
