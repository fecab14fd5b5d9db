"""Titles, leaks, fingerprints and exercises: queries over conversations, documents and text boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import reconcile as R

from .language_queries import doc_spans
from .registry import query


@query("D3_page_map", """SELECT conv_id AS doc_id, turn % 3 AS page_number, 'story' AS page_type, string_agg(turn || '=' || t, chr(10) ORDER BY turn) AS items FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')
 JOIN (SELECT conv_id, turn - turn % 2 AS turn, arg_max(text, turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) USING (conv_id, turn) GROUP BY 1, 2""")
def _(t):
    turn = F.col("turn").cast("int")
    units = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), (turn % 3).alias("page_number"), F.lit("story").alias("page_type"), turn.alias("unit_id"))
    response = t.conversations.select(F.col("conv_id").alias("doc_id"), (turn - turn % 2).alias("unit_id"), F.col("text").alias("translation"), turn.alias("seq"))
    found = R.page_map(response, units)
    return found.withColumn("items", F.array_join(F.transform(F.map_entries("items"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), "\n"))


@query("D10_title_candidates", """SELECT page_id, span_no, font_size, title FROM (SELECT book_id AS page_id, page_number AS span_no, 8 + (page_number * 11 + book_id) % 37 AS font_size, extracted_text AS title, row_number() OVER (PARTITION BY book_id ORDER BY 8 + (page_number * 11 + book_id) % 37 DESC, page_number) AS r
 FROM book_pages WHERE length(regexp_replace(extracted_text, '[^A-Za-z]', '', 'g')) > 2 AND NOT contains(lower(extracted_text), 'studio')) WHERE r = 1""", ("book_pages",))  # fmt: skip
def _(t):
    return R.title_candidates(doc_spans(t))


def titled(t):
    """Turns as pages: the title is the conversation's first word, which any page's source may hold; a page's first line, of two words here, renders it."""
    first = t.translation_pairs.groupBy("book_id").agg(F.min_by("source_text", "page_number").alias("s"))
    titles = first.select("book_id", F.regexp_extract(F.trim("s"), r"^\S+", 0).alias("title"))
    head = F.regexp_extract(F.trim("translated_text"), r"^(\S+\s+\S+)", 1)
    return t.translation_pairs.withColumn("translated_text", F.concat(head, F.lit("\n"), "translated_text")), titles


@query("D11_title_variants")
def _(t):
    return R.title_variants(*titled(t))


@query("D12_canonical_groups")
def _(t):
    return R.canonical_groups(R.title_variants(*titled(t)))


@query("D13_reconciled_titles")
def _(t):
    pages, titles = titled(t)
    return R.reconciled_titles(R.title_variants(pages, titles), pages)


LEAK = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
NOT_EXEMPT = " AND ".join(f"NOT contains(lower(p), '{m}')" for m in R.EXEMPT)


@query("D14_source_leaks", f"""SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, {LEAK.format('text')} AS p FROM benchmark UNION ALL SELECT 100000 + item_id, array_to_string(string_split({LEAK.format('text')}, ' ')[2:4], ' ') FROM benchmark) JOIN (SELECT doc_id, lower({LEAK.format('text')}) AS d FROM documents) ON contains(d, lower(p))
 WHERE len(string_split(p, ' ')) >= 3 AND length(regexp_replace(p, '[^A-Za-z]', '', 'g')) >= 6 AND {NOT_EXEMPT}""")
def _(t):
    # whole passages, and three words of each
    short = t.benchmark.select((F.col("item_id") + 100000).alias("item_id"), F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 2, 3), " ").alias("text"))
    return R.source_leaks(t.benchmark.select("item_id", "text").unionByName(short), t.documents)


@query("D25_render_fingerprint", """SELECT event_id, sha256('{"a":{"c":' || user_id || ',"d":[1,{"x":1,"y":2}]},"b":"' || event_type || '"}') AS text_hash, sha256('source_version=' || user_id || chr(10) || 'manifest_version=' || chr(10) || 'engine_version=v8' || chr(10) || 'item_translations=' || sha256('{"a":{"c":' || user_id || ',"d":[1,{"x":1,"y":2}]},"b":"' || event_type || '"}')
 || chr(10) || 'typography_policy=' || sha256('[]') || chr(10) || 'fit_policies=' || sha256('{"k":' || regexp_extract(props, '-?[0-9]+') || '}') || chr(10) || 'repair_revisions=' || sha256('[]')) AS fingerprint FROM events""")
def _(t):
    user = F.col("user_id").cast("string")
    one = F.concat(F.lit('{"a": {"c": '), user, F.lit(', "d": [1, {"y": 2, "x": 1}]}, "b": "'), "event_type", F.lit('"}'))
    two = F.concat(F.lit('{"b":"'), "event_type", F.lit('","a":{"d":[1,{"x":1,"y":2}],"c":'), user, F.lit("}}"))
    rows = t.events.select("event_id", user.alias("source_version"), F.lit(None).cast("string").alias("manifest_version"), F.lit("v8").alias("engine_version"), F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("item_translations"), F.when(F.col("event_id") % 3 == 0, "not json").alias("typography_policy"), F.col("props").alias("fit_policies"), F.lit("[]").alias("repair_revisions"))
    return R.render_fingerprint(rows, "event_id")


@query("D26_page_content_hash", """SELECT page_id, substr(sha256('500.0x' || (100 + page_id % 3) || '.0x90|' || string_agg(round_even(x0, 0)::BIGINT || ',' || round_even(y0, 0)::BIGINT || ':' || role || span_no, chr(10) ORDER BY round_even(x0, 0)::BIGINT || ',' || round_even(y0, 0)::BIGINT || ':' || role || span_no)
 || '|' || coalesce(string_agg(span_no || ':' || font_size || ':7', chr(10) ORDER BY span_no, font_size) FILTER (role = 'N'), '') || '|' || CASE WHEN count(*) FILTER (role = 'A') = 0 THEN '0' ELSE count(*) FILTER (role = 'A') || ':b' || min(span_no) FILTER (role = 'A') || ':b' || max(span_no) FILTER (role = 'A') END), 1, 16) AS content_hash FROM spans GROUP BY 1""", ("spans",))  # fmt: skip
def _(t):
    pages = t.spans.select("page_id").distinct().select("page_id", F.lit(500.04).alias("width"), (F.col("page_id") % 3 + 100.0).alias("height"), F.lit(90).alias("rotation"))
    spans = t.spans.select("page_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.concat(F.col("role"), F.col("span_no").cast("string")).alias("text"))
    images = t.spans.where("role = 'N'").select("page_id", F.col("span_no").alias("image_id"), F.col("font_size").alias("width"), F.lit(7).alias("height"))
    drawings = t.spans.where("role = 'A'").select("page_id", F.col("span_no").alias("drawing_no"), F.concat(F.lit("b"), F.col("span_no").cast("string")).alias("box"))
    return R.page_content_hash(pages, spans, images, drawings)


@query("D31_educational_issues", """SELECT user_id AS edition_id, CASE WHEN s IS NULL THEN 'UNKNOWN_OR_INVALID_COMPONENT_ID' ELSE 'DUPLICATE_COMPONENT_ID' END AS code, x AS exercise_id, s AS source_id FROM (SELECT user_id, event_type AS x, CASE WHEN event_id % 11 > 0 THEN 'c' || event_id % 7 END AS s, row_number() OVER (PARTITION BY user_id, event_type, event_id % 7, event_id % 11 = 0 ORDER BY event_id) AS r
 FROM events WHERE user_id % 5 > 1 AND event_type <> 'view') WHERE s IS NULL OR r > 1 UNION ALL SELECT DISTINCT user_id, 'EMPTY_EXERCISE', NULL, NULL FROM events WHERE user_id % 5 = 1 UNION ALL SELECT DISTINCT user_id, 'EMPTY_EXERCISE', 'none', NULL FROM events WHERE user_id % 5 > 1
 UNION ALL SELECT DISTINCT user_id, 'UNSUPPORTED_EDUCATIONAL_VALIDATOR', NULL, NULL FROM events WHERE user_id % 5 > 1 AND user_id % 2 = 1""")  # fmt: skip
def _(t):
    # every edition with exercises has one without components besides
    part = F.struct(F.col("event_id").alias("at"), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).alias("source_id"))
    made = t.events.where("event_type <> 'view'").groupBy("user_id", F.col("event_type").alias("id")).agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: F.struct(p["source_id"].alias("source_id"))).alias("components"))
    listed = made.groupBy("user_id").agg(F.collect_list(F.struct("id", "components")).alias("e"))
    users = t.events.select("user_id").distinct().join(listed, "user_id", "left")
    bare = F.array(F.struct(F.lit("none").alias("id"), F.array().cast("array<struct<source_id: string>>").alias("components")))
    contract = F.when(F.col("user_id") % 5 == 1, F.lit('{"exercises":[]}')).when(F.col("user_id") % 5 > 1, F.to_json(F.struct(F.concat(F.coalesce("e", F.array().cast("array<struct<id: string, components: array<struct<source_id: string>>>>")), bare).alias("exercises"))))
    return R.educational_issues(users.select(F.col("user_id").alias("edition_id"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("af").alias("language"), contract.alias("exercise_contract")))


@query("D1_unit_requests", """SELECT unit_id, source_text AS text, CAST(page_number AS VARCHAR) AS page, 'story' AS page_type, CASE WHEN unit_id % 3 = 0 THEN 'unknown' ELSE 'body' END AS semantic_role, CASE WHEN unit_id % 4 = 1 THEN 'educational_adaptation' ELSE 'translate' END AS policy, CASE WHEN unit_id % 4 = 1
 THEN 'This is educational content (' || CASE WHEN unit_id % 3 = 0 THEN 'unknown' ELSE 'body' END || '). Create an equivalent Afrikaans exercise at the same difficulty level. Do not translate literally.' END AS instruction, CASE WHEN unit_id % 2 = 0 THEN 'left' END AS align_h,
 CASE WHEN unit_id % 5 <> 1 THEN CAST(unit_id % 5 AS VARCHAR) END AS column_span FROM (SELECT book_id * 100 + page_number AS unit_id, * FROM translation_pairs) WHERE unit_id % 4 <> 0""", ("translation_pairs",))  # fmt: skip
def _(t):
    i = F.col("unit_id")
    pairs = t.translation_pairs.withColumn("unit_id", F.col("book_id") * 100 + F.col("page_number"))
    units = pairs.select(i, F.col("source_text").alias("text"), "page_number", F.lit("story").alias("page_type"), F.when(i % 3 != 0, "body").alias("role"), F.when(i % 4 == 1, "educational_adaptation").when(i % 4 > 1, "translate").alias("policy"), F.when(i % 2 == 0, "left").alias("align_h"), (i % 5).alias("column_span"))
    of = lambda field: F.get_json_object("request", f"$.{field}")
    return R.unit_requests(units, "Afrikaans").select("unit_id", of("source_text").alias("text"), of("page_number").alias("page"), of("page_type").alias("page_type"), of("semantic_role").alias("semantic_role"), of("translation_policy").alias("policy"), *[of(f).alias(f) for f in ("instruction", "align_h", "column_span")])
