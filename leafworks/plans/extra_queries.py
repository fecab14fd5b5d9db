"""Queries of the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import catalog as C
from leafworks.operators import extras as X
from leafworks.operators import reporting as P

from .catalog_queries import FACETED, GATE, VISIBLE, faceted, visible
from .registry import query

UNITS = "u AS (SELECT book_id * 100 + page_number AS unit_id, * FROM translation_pairs)"


@query("A2_manifest_units", "SELECT conv_id AS doc_id, turn::INTEGER AS page_number, conv_id || ':' || turn AS unit_id, text, role FROM conversations")
def _(t):
    item = F.struct(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", "role")
    region = F.struct(F.lit("r").alias("id"), F.lit("translate").alias("policy"), F.array(item).alias("items"))
    page = F.struct(F.col("turn").alias("page_number"), F.lit("story").alias("page_type"), F.array(region).alias("regions"))
    made = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("manifest"))
    return X.manifest_units(made).select("doc_id", "page_number", "unit_id", "text", "role")


@query("A4_expected_strings", "SELECT source, text, min(k) AS first FROM (SELECT source, trim(extracted_text, ' ') AS text, book_id * 1000 + page_number AS k FROM book_pages JOIN documents ON doc_id = book_id) WHERE text <> '' GROUP BY 1, 2", ("book_pages",))
def _(t):
    lines = t.book_pages.join(t.documents.select(F.col("doc_id").alias("book_id"), "source"), "book_id").withColumn("k", F.col("book_id") * 1000 + F.col("page_number"))
    return X.expected_strings(lines.withColumn("none", F.lit(" ")), "source", "k", ["none", "extracted_text"])


@query("B6_unknown_slug_keeps_all", "SELECT book_id FROM books", ("books",))
def _(t):
    links = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("slug"))
    return X.filtered_by_slug(t.books, links, links.select("slug").distinct(), "no-such-slug").select("book_id")


@query("B7_advisory_filter", "SELECT book_id FROM books WHERE book_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')", ("books",))
def _(t):
    links = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("slug"))
    return X.filtered_by_slug(t.books, links, links.select("slug").distinct(), "A").select("book_id")


@query("B14_rule_matches", """SELECT 1 AS collection_id, book_id FROM pub WHERE EXISTS (SELECT 1 FROM ed e WHERE e.book_id = pub.book_id AND publication_status = 'published' AND language_code = 'l3' AND EXISTS (SELECT 1 FROM ef WHERE ef.edition_id = e.edition_id AND feature IN ('narrated', 'read_along')))
 UNION ALL SELECT 2, book_id FROM pub WHERE book_type = (SELECT min(book_type) FROM books) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = book_id AND l_returnflag = 'A')
 UNION ALL SELECT 3, book_id FROM pub WHERE EXISTS (SELECT 1 FROM ed e WHERE e.book_id = pub.book_id AND publication_status = 'published' AND language_code = 'l4' AND reading_level = 'r2') UNION ALL SELECT 4, book_id FROM pub
 UNION ALL SELECT 5, book_id FROM pub WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = book_id AND l_returnflag = 'R')""", GATE, VISIBLE + ", " + FACETED)  # fmt: skip
def _(t):
    rules = [(1, '{"language":["l3","l4"],"features":["word_highlighting"],"sort":"x"}'), (3, '{"language":"l4","reading_level":"r2","features":["large_print"]}'), (4, '{"language":[],"category":"","age":5}'), (5, '{"category":"R"}')]
    typed = t.books.agg(F.min("book_type").alias("b")).select(F.lit(2).alias("collection_id"), F.concat(F.lit('{"category":"A","book_type":"'), F.col("b"), F.lit('"}')).alias("rules"))
    links = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("slug"))
    return X.rule_matches(t.spark.createDataFrame(rules, "collection_id int, rules string").unionByName(typed), visible(t), *faceted(t), links)


@query("B23_label_fallback", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'naam ' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'name ' || n_nationkey ELSE 'Nation Key' END AS label FROM nation")
def _(t):
    key = F.col("n_nationkey")
    labels = F.map_filter(F.create_map(F.lit("af"), F.when(key % 3 == 0, F.concat(F.lit("naam "), key)), F.lit("en"), F.when(key % 3 != 2, F.concat(F.lit("name "), key))), lambda _, v: v.isNotNull())
    return t.nation.select("n_nationkey", C.label_for(labels, "af", F.lit("nation-key")).alias("label"))


@query("D19_locked_terms", "SELECT DISTINCT p_partkey AS book_id, unnest(string_split(p_name, ' ')) AS term, 10.0::DOUBLE AS confidence FROM part")
def _(t):
    return X.locked_terms(t.part.withColumnRenamed("p_partkey", "book_id"), F.split("p_name", " ")).select("book_id", "term", "confidence")


@query("D30_component_ids", """SELECT book_id, source_id, problem FROM (SELECT coalesce(e.b, g.b) AS book_id, coalesce(e.s, g.s) AS source_id, CASE WHEN g.n IS NULL THEN 'missing' WHEN e.b IS NULL THEN 'unknown' WHEN g.n > 1 THEN 'duplicate' END AS problem
 FROM (SELECT DISTINCT user_id AS b, event_id % 6 AS s FROM events WHERE event_type <> 'click') e FULL JOIN (SELECT user_id AS b, event_id % 7 AS s, count(*) AS n FROM events GROUP BY 1, 2) g ON e.b = g.b AND e.s = g.s) WHERE problem IS NOT NULL""")  # fmt: skip
def _(t):
    of = lambda df, k: df.select(F.col("user_id").alias("book_id"), (F.col("event_id") % k).alias("source_id"))
    return X.component_ids(of(t.events.where("event_type <> 'click'"), 6), of(t.events, 7), "book_id")


@query("P2_edition_costs", r"""SELECT book_id, words, chars, round(chars / 4 * (2 * 0.15::DOUBLE + 0.60::DOUBLE) / 1000000 * 18.5::DOUBLE, 6) AS cost, round(chars / 1000 * 0.30::DOUBLE * 18.5::DOUBLE, 6) AS narration_cost, narratable FROM (SELECT book_id, sum(len(regexp_extract_all(extracted_text, '[^ \t\n\r\x0B\f]+')))::BIGINT AS words,
 greatest(sum(length(extracted_text)) + count(*) FILTER (extracted_text <> '') - 1, 0)::BIGINT AS chars, greatest(0, count(*) - 4) AS narratable FROM book_pages GROUP BY 1)""", ("book_pages",))  # fmt: skip
def _(t):
    return P.edition_costs(t.book_pages, "book_id", "extracted_text")


@query("K31_role_policy", "SELECT event_id AS unit_id, CASE WHEN event_id % 9 = 0 THEN 'review' WHEN event_type = 'view' THEN 'preserve' WHEN event_type = 'error' THEN 'skip' ELSE 'translate' END AS policy FROM events")
def _(t):
    units = t.events.select(F.col("event_id").alias("unit_id"), F.col("event_type").alias("role"))
    return X.role_policy(units, {"view": "preserve", "error": "skip"}, units.where("unit_id % 9 = 0").select("unit_id", F.lit("review").alias("policy")))


@query("K28_integrity_verdict", """SELECT page_id AS edition_id, bool_or(font_name IN ('F2', 'F5')) AS failed, coalesce(array_to_string(list_sort(list_distinct(list(font_name) FILTER (font_name IN ('F2', 'F5')))), ','), '') AS families FROM spans GROUP BY 1""", ("spans",))
def _(t):
    faults = t.spark.createDataFrame([("F2",), ("F5",)], "family string")
    return X.integrity_verdict(t.spans.select(F.col("page_id").alias("edition_id"), F.col("font_name").alias("family")), faults)


