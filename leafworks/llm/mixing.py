"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import table, written

SEED = 20240
#: A table of sources up to this many rows is broadcast.
MOST_BROADCAST = 10_000


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, drawn from the md5 of the parts (nulls are left out)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, for any k from 0: exact to double precision from 8 places up, from where it steps down."""
    x = k + 8.0
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    steps = F.lit(1.0)
    for i in range(1, 9):
        steps = steps * (k + float(i))
    return series - F.ln(steps)


def poisson_table(rates: DataFrame, key: str) -> DataFrame:
    """Adds the Poisson distribution function of each row's rate: lowest (the first count it is kept for), blocks (its values in turn, in blocks of about
    the root of their number) and tops (the last value of each block).

    Values are kept within 10 standard deviations and 40 of the mean, outside of which no draw of 52 bits falls, so a rate of 10 million has
    63,000 values in blocks of 250. Terms are computed in logarithms, each by itself, so large rates neither underflow nor overflow, and summed by a window.
    """
    reach = 10 * F.sqrt("rate") + 40
    ends = rates.withColumn("lowest", F.greatest(F.floor(F.col("rate") - reach), F.lit(0)).cast("long")).withColumn("highest", F.ceil(F.col("rate") + reach).cast("long"))
    terms = ends.withColumn("k", F.explode(F.sequence("lowest", "highest"))).withColumn("size", F.ceil(F.sqrt(F.col("highest") - F.col("lowest") + 1)))
    k = F.col("k").cast("double")
    so_far = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms = terms.withColumn("cdf", F.sum(F.exp(k * F.ln("rate") - F.col("rate") - log_factorial(k))).over(so_far))
    blocks = terms.groupBy(key, "rate", "lowest", F.floor((F.col("k") - F.col("lowest")) / F.col("size")).alias("block")).agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))
    whole = blocks.groupBy(key, "rate", "lowest").agg(F.sort_array(F.collect_list(F.struct("block", "cdf"))).alias("parts"))
    return whole.select(key, "rate", "lowest", F.col("parts")["cdf"].alias("blocks"), F.transform("parts", lambda p: F.element_at(p["cdf"], -1)).alias("tops"))


def inverted(lowest: Column, blocks: Column, tops: Column, u: Column) -> Column:
    """The least count whose distribution function exceeds u: the block is sought among tops, the value inside the block."""
    passed = F.size(F.filter(tops, lambda t: t <= u))
    before = lowest + passed * F.size(blocks[0])
    return (before + F.when(passed < F.size(tops), F.size(F.filter(F.get(blocks, passed), lambda c: c <= u))).otherwise(0)).cast("long")


#: Copies that one row is exploded into at a time.
COPIES = 10_000


def poisson_mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, seed: int = SEED) -> DataFrame:
    """Repeats or leaves out documents so that each source's expected share of the bytes is its weight's share.

    A source's rate is (all bytes * weight / sum of weights) / its bytes; a document's count inverts the Poisson
    distribution with that mean at a number hashed from seed and doc_id, so it is the same in every run and
    on every machine. The copies are then dealt to partitions, and ordered inside them, by a hash of
    (doc_id, copy): a global shuffle. Size is the UTF-8 bytes of the text plus 1.

    Nulls: a null text has size 1; a null source is a source of its own with the default weight; rows with a null doc_id
    share one draw. Repeated rows (equal doc_id) are each repeated the same number of times. A source with weight 0 goes. Empty input: no rows.
    Returns docs' columns and copy_no (int, from 1), rate (double) and shuffle_key (string); input columns with
    these names are replaced.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    known = [F.when(F.col("_mx_source") == s, F.lit(float(w))) for s, w in weights.items()]
    weight = F.coalesce(*known, F.lit(float(default_weight)))
    sizes = docs.groupBy(F.col("source").alias("_mx_source")).agg(F.sum(size).alias("_mx_bytes")).withColumn("_mx_weight", weight)
    total = sizes.agg(F.sum("_mx_bytes").alias("_mx_all"), F.sum("_mx_weight").alias("_mx_sum"))
    rate = F.col("_mx_all") * F.col("_mx_weight") / F.col("_mx_sum") / F.col("_mx_bytes")
    rates = poisson_table(sizes.crossJoin(F.broadcast(total)).where("_mx_weight > 0").select("_mx_source", rate.alias("rate")), "_mx_source")
    rates = written(rates.select("_mx_source", *(F.col(c).alias(f"_mx_{c}") for c in ("rate", "lowest", "blocks", "tops"))))
    if rates.count() <= MOST_BROADCAST:  # else Spark joins by source, parting the hot ones
        rates = F.broadcast(rates)
    draw = hash_uniform(F.lit(str(seed)), F.col("doc_id").cast("string"))
    own = [c for c in docs.columns if c not in ("copy_no", "rate", "shuffle_key")]
    counted = (
        docs.select(*own)
        .withColumn("_mx_u", draw)
        .join(rates, F.col("source").eqNullSafe(F.col("_mx_source")))
        .withColumn("_mx_count", inverted(F.col("_mx_lowest"), F.col("_mx_blocks"), F.col("_mx_tops"), F.col("_mx_u")))
        .where("_mx_count > 0")
    )
    # in two steps, so that no array has more than COPIES numbers or the root's worth of them
    parts = counted.select(*own, "_mx_rate", "_mx_count", F.explode(F.sequence(F.lit(0), F.floor((F.col("_mx_count") - 1) / COPIES))).alias("_mx_part"))
    copies = F.sequence(F.col("_mx_part") * COPIES + 1, F.least((F.col("_mx_part") + 1) * COPIES, F.col("_mx_count")))
    return (
        parts.select(*own, F.col("_mx_rate").alias("rate"), F.explode(copies).alias("copy_no"))
        .withColumn("copy_no", F.col("copy_no").cast("int"))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col("doc_id").cast("string"), F.col("copy_no").cast("string"))))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


#: Production weights: src0 is to have twice the weight of any other source.
WEIGHTS = {"src0": 2.0}


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return poisson_mix(docs, WEIGHTS).select("doc_id", "source", "text", "rate", "copy_no", "shuffle_key").withColumn("rate", F.round("rate", 9))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, text, coalesce(strlen(text), 0) + 1 AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS bytes, CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT source, (SELECT sum(bytes) FROM s) * weight / (SELECT sum(weight) FROM s) / bytes AS rate FROM s),
t AS (SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
c AS (SELECT source, rate, list(cdf ORDER BY k) AS cdfs FROM p GROUP BY source, rate),
u AS (SELECT d.*, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.doc_id, u.source, u.text, c.rate, len(list_filter(cdfs, lambda x: x <= u.u)) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source),
e AS (SELECT doc_id, source, text, rate, unnest(range(1, n + 1))::INTEGER AS copy_no FROM n WHERE n > 0)
SELECT doc_id, source, text, round(rate, 9) AS rate, copy_no, md5('{SEED}:order:' || doc_id || ':' || copy_no) AS shuffle_key FROM e
"""
