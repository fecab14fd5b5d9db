"""The corpus pipeline: each stage applies one operator to all that its predecessor kept, and its decisions take effect.

Every stage but the last returns the columns of documents. Null, empty and repeated rows pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafworks.llm import jaccard, mixing, packing, secrets
from leafworks.llm import toxicity as toxic
from leafworks.llm.storage import Stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[SECRET]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the models learn from the labelled ones among docs."""
    docs = docs.select(*COLUMNS)
    return toxic.ordinary(docs, toxic.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by shingle Jaccard 0.8 or more, that with the smallest doc_id stays. Rows without a doc_id stay; of rows with equal doc_id and text, the least stays, and such with different texts all do."""
    return jaccard.first_of_components(docs.select(*COLUMNS), COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in the text is replaced by MARK, and n_chars counted anew."""
    docs = docs.select(*COLUMNS)
    found = secrets.scan(docs, secrets.train(docs), MARK)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights, and shuffled."""
    return mixing.poisson_mix(docs.select(*COLUMNS), mixing.WEIGHTS).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of token sequences of 4096, with their ids."""
    return packing.pack(docs, packing.public_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scan),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language models, a random field and tokenisers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; of the packed ids their digest. A stage's own tables go when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with Stage(spark) as step:
            docs = step.keep(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = step
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")
