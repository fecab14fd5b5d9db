"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mixing import hash_uniform
from .storage import table

#: region -> rack -> shard -> weight. Shards keep their numbers when others come or go.
TREE = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}}, "r1": {"k2": {4: 1.0, 5: 1.0}, "k3": {6: 1.0, 7: 1.0}}}
#: The same tree with one shard more, number 8, in a region of its own: no other subtree's weight changes.
GROWN = {**TREE, "r2": {"k4": {8: 1.0}}}


def weight_of(tree: dict | float) -> float:
    return sum(map(weight_of, tree.values())) if isinstance(tree, dict) else float(tree)


def tree_shard(df: DataFrame, key: Column, tree: dict, out: str, seed: str = "tree") -> DataFrame:
    """Adds the column out (int): the shard that key reaches by descending tree level by level.

    Every node draws -ln(u) / weight for itself, u hashed from seed, key and the node's path; its weight is the sum of its shards'. Each level
    takes the child with the least draw, so with probability weight / sum of weights. Which draws a level compares depends on
    that level's children alone: when weights change inside a subtree and its sum stays, rows move only inside it. Where a sum changes
    too, rows move from or to that child alone, since the other draws stay; a new region draws rows to itself from everywhere, and none
    move between the old ones. A new shard in an old region changes that region's sum, and so lets rows move into that region's old
    shards as well: to keep moves to the new shard alone, add it as a region.

    Draws of 52 bits tie about never; ties go to the child that comes first. Children of weight 0 are never taken. A null key is hashed as
    an empty one. Work a row: one hash for each node.
    """

    def descend(at: dict | float, path: tuple) -> Column:
        if not isinstance(at, dict):
            return F.lit(int(path[-1]))
        children = {name: sub for name, sub in at.items() if weight_of(sub) > 0}
        under = {name: descend(sub, (*path, name)) for name, sub in children.items()}
        if len(under) == 1:
            return next(iter(under.values()))
        best = F.least(*(F.col(draws[(*path, name)]) for name in under))
        picked = None
        for name, below in under.items():
            hit = F.col(draws[(*path, name)]) == best
            picked = F.when(hit, below) if picked is None else picked.when(hit, below)
        return picked

    def nodes(at: dict | float, path: tuple = ()) -> dict[tuple, float]:
        below = {p: w for name, sub in at.items() for p, w in nodes(sub, (*path, name)).items()} if isinstance(at, dict) else {}
        return ({path: weight_of(at)} if path and weight_of(at) > 0 else {}) | below

    found = nodes(tree)
    draws = {path: f"_sh_{i}" for i, path in enumerate(found)}
    made = df.withColumns({draws[p]: -F.ln(1 - hash_uniform(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.lit("/".join(map(str, p))))) / w for p, w in found.items()})
    return made.withColumn(out, descend(tree, ())).drop(*draws.values())


def with_slots(df: DataFrame, group: str, keys: list[str], out: str, rows_a_bucket: int = 20_000) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, whatever the groups' sizes: by a hash of keys, then by these.

    The hashes' range is cut into buckets; these are counted, the counts before a bucket are its
    rows' start, and rows are numbered inside (group, bucket) only. No task gets a whole group, unless all its rows are alike; the
    count table has groups * rows / rows_a_bucket lines at most. Rows with equal keys have different slots, in any order.
    """
    n = df.select(group).count()
    buckets = max(1, -(-n // rows_a_bucket))
    dealt = df.withColumn("_sl_u", hash_uniform(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit("slot")))
    dealt = dealt.withColumn("_sl_b", F.floor(F.col("_sl_u") * buckets))
    counts = dealt.groupBy(group, "_sl_b").agg(F.count("*").alias("_sl_n"))
    before = Window.partitionBy(group).orderBy("_sl_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_sl_g"), F.col("_sl_b").alias("_sl_at"), F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).alias("_sl_start"))
    inside = Window.partitionBy(group, "_sl_b").orderBy("_sl_u", *keys)
    numbered = dealt.withColumn("_sl_i", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, (F.col(group) == F.col("_sl_g")) & (F.col("_sl_b") == F.col("_sl_at")))
    return joined.withColumn(out, (F.col("_sl_start") + F.col("_sl_i")).cast("long")).drop("_sl_u", "_sl_b", "_sl_i", "_sl_g", "_sl_at", "_sl_start")


def shard_documents(docs: DataFrame, tree: dict = TREE, grown: dict | None = GROWN) -> DataFrame:
    """Places every document by doc_id: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (null text: of no bytes), law
    'key', shard, slot (gapless from 0 in each shard) and grown_shard (the shard under the tree grown; null without one).

    doc_id and the tree alone decide; equal texts are not kept together. Rows with equal or null doc_id share a shard
    and have slots of their own. Extra columns are ignored. Empty input: no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = tree_shard(rows, F.col("doc_id"), tree, "shard")
    placed = tree_shard(placed, F.col("doc_id"), grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw_sql(path: str, weight: float) -> str:
    return f"(-ln(1 - ('0x' || substr(md5('tree:' || k || ':{path}'), 1, 13))::BIGINT / 4503599627370496.0) / {weight})"


def _tree_sql(tree: dict | float, path: tuple = ()) -> str:
    """The same descent in DuckDB: the first child whose draw is least."""
    if not isinstance(tree, dict):
        return str(path[-1])
    names = list(tree)
    if len(names) == 1:
        return _tree_sql(tree[names[0]], (*path, names[0]))
    draws = [_draw_sql("/".join(map(str, (*path, n))), weight_of(tree[n])) for n in names]
    cases = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {_tree_sql(tree[n], (*path, n))}" for n, d in zip(names, draws, strict=True))
    return f"CASE {cases} END"


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
    return c


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(encode(coalesce(text, ''))) AS hexed, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
r AS (SELECT doc_id, size, k, xor(4294967295::BIGINT, list_reduce([('0x' || h)::BIGINT FOR h IN regexp_extract_all(hexed, '..')], lambda a, x: xor(a >> 8, list_extract({[_crc_step(c) for c in range(256)]}::BIGINT[], xor(a & 255, x) + 1)), 4294967295::BIGINT)) AS text_crc32 FROM d),
p AS (SELECT *, ({_tree_sql(TREE)})::INTEGER AS shard, ({_tree_sql(GROWN)})::INTEGER AS grown_shard FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || ':' || size || ':' || text_crc32 || ':slot'), 1, 13))::BIGINT, doc_id, size, text_crc32) - 1 AS slot FROM p
"""


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
