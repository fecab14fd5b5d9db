"""License scans by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import table, written

# The base phrases with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Openings and notices of public licenses, as their authors ask to put them into works.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution",
    ],
    "cc-by": [
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
        "at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ],
}

#: Words of a gram; how far diagonals may lie apart to be merged; matched grams and share of a template's span for a verified one.
K, NEAR, LEAST_GRAMS, LEAST_SHARE = 4, 3, 6, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, letters and non-ASCII characters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def gram_hash(grams: list[Column]) -> Column:
    return F.xxhash64(*grams)


def zipped(w: Column, n: int = K) -> Column:
    """Each word of an array with the n - 1 after it, null past the end."""
    return F.arrays_zip(w.alias("g0"), *[F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0))).alias(f"g{i}") for i in range(1, n)])


def template_grams(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """label, template (number), place, grams (number of the template's) and h, the hash of each gram of K words t0, t1 ...; a few hundred rows, fixed by the templates."""
    texts = [(label, text) for label, several in templates.items() for text in several]
    listed = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i).alias("template"), F.lit(text).alias("text")) for i, (label, text) in enumerate(texts)])
    rows = spark.range(1).select(F.explode(listed).alias("t")).select("t.label", "t.template", words(F.col("t.text")).alias("w"))
    rows = rows.select("label", "template", (F.size("w") - K + 1).alias("grams"), F.posexplode(zipped(F.col("w"))).alias("place", "g")).where("place < grams")
    parts = [F.col(f"g.g{i}").alias(f"t{i}") for i in range(K)]
    return rows.select("label", "template", "place", "grams", gram_hash(parts).alias("h"), *parts)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, near: int = NEAR, least_grams: int = LEAST_GRAMS, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of a scan of every whole text.

    Every document's word grams, with their places, meet the templates' grams by hash; equal words confirm a match. Matches of one template with the
    same difference of places lie on one diagonal; each votes for it. Diagonals at most near apart are merged: insertions and
    deletions move a copy from one to the next. A merged diagonal is verified as a span if it has least_grams
    different template grams and these are least_share of the template's stretch from the first to the last of them.

    documents: doc_id, n_words, n_base (places of the phrases), first_word and last_word (their least and largest start; else null), base_labels and
    labels (sorted, comma-joined; labels adds the verified templates'), score (1 with a base place, else the largest share of a template's grams in a verified span).
    spans: doc_id, label, first_word, last_word (of the span), votes, share. Every row has a result of its own, also
    where doc_ids are equal or null.
    Null or empty text: no words, empty labels, score 0. Empty input: no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    size = F.size("w")
    longest = max([K, *(len(text.split()) for text in phrases)])
    grams = own.select("doc_id", "row", size.alias("n_words"), F.posexplode_outer(zipped(F.col("w"), longest)).alias("at", "g"))
    every = [F.col(f"g.g{i}") for i in range(longest)]
    parts = every[:K]
    hits = []
    for text, label in phrases.items():
        w = text.split()
        at = every[0] == w[0]
        for part, word in zip(every[1 : len(w)], w[1:], strict=True):
            at = at & (part == word)
        hits.append((at, label))
    base = F.lit(None).cast("string")
    for at, label in hits:
        base = F.when(at, F.lit(label)).otherwise(base)
    known = template_grams(spark, templates)
    full = parts[-1].isNotNull()
    same = F.col("h") == F.when(full, gram_hash(parts))
    for i, part in enumerate(parts):
        same = same & (part == F.col(f"t{i}"))
    # one row a document is kept beside the hits, for the counts
    met = grams.withColumn("base", base).join(F.broadcast(known), same, "left").where("at IS NULL OR at = 0 OR base IS NOT NULL OR label IS NOT NULL")
    met = written(met.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), F.col("at").cast("long").alias("at"), "base", "label", "template", "place", "grams"))

    votes = met.where("label IS NOT NULL").groupBy("doc_id", "row", "label", "template", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first_word"), F.max("at").alias("last_word"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > near, F.lit(True))
    merged = votes.withColumn("new", apart.cast("int")).withColumn("band", F.sum("new").over(along))
    bands = merged.groupBy("doc_id", "row", "label", "template", "grams", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first_word").alias("first_word"), (F.max("last_word") + K - 1).alias("last_word"))
    n = F.size("places")
    stretch = F.array_max("places") - F.array_min("places") + 1
    spans = bands.where((n >= least_grams) & (n >= least_share * stretch)).select("doc_id", "row", "label", "first_word", "last_word", n.cast("long").alias("votes"), (n / F.col("grams")).alias("share"))

    # base places and the counts need no diagonal: each place once, whatever templates it met
    places = met.where("base IS NOT NULL OR at IS NULL OR at = 0").groupBy("doc_id", "row", "at").agg(F.first("n_words").alias("n_words"), F.first("base").alias("base"))
    whole = places.select("doc_id", "row", "n_words", "base", F.when(F.col("base").isNotNull(), F.col("at")).alias("at"), F.lit(None).cast("string").alias("found"), F.lit(0.0).alias("share"))
    whole = whole.unionByName(spans.select("doc_id", "row", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("string").alias("base"), F.lit(None).cast("long").alias("at"), F.col("label").alias("found"), "share"))

    def listed(*cols: str) -> Column:
        sets = [F.collect_set(c) for c in cols]
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*sets))), ",")

    out = whole.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"), F.count("base").alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"),
        listed("base").alias("base_labels"), listed("base", "found").alias("labels"), F.when(F.count("base") > 0, 1.0).otherwise(F.max("share")).alias("score"))
    return out.drop("row"), spans.drop("row")


def op5_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))[0]
