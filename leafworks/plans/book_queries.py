"""Dashboards, requirements, badges, audits, reports of programs, fonts and wrapped lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafworks.functions.folders import shared_dir
from leafworks.operators import catalog as C
from leafworks.operators import extras as X
from leafworks.operators import reporting as P
from leafworks.sources import ingest as I
from leafworks.sources import views as V
from leafworks.streaming import feeds as S

from .registry import query
from .report_queries import streamed


@query("A1_catalog_types", """SELECT count(*) AS tables, sum(n)::BIGINT AS rows, bool_and(ok) AS typed FROM (SELECT count(*) AS n, bool_and(typeof(price) = 'DECIMAL(8,2)') AS ok FROM (SELECT o_totalprice::DECIMAL(8,2) AS price FROM orders) UNION ALL SELECT count(*), true FROM part UNION ALL SELECT count(*), true FROM lineitem)""")
def _(t):
    catalog = V.load_catalog(t.spark, t.sf_dir, {"orders": "o_orderkey long, o_totalprice decimal(8,2)", "part": "p_partkey long, p_name string", "lineitem": "l_orderkey long, l_shipdate date"})
    parts = [df.agg(F.count("*").alias("n")).withColumn("ok", F.lit(dict(df.dtypes).get("o_totalprice", "decimal(8,2)") == "decimal(8,2)")) for df in catalog.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count("*").alias("tables"), F.sum("n").alias("rows"), F.bool_and("ok").alias("typed"))


@query("A9_append_audit", "SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(t):
    folder = f"{shared_dir(t.spark)}/audit-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", F.col("event_type").alias("kind"))
    P.append_audit(rows.where("event_id % 2 = 0"), folder)
    return P.append_audit(rows.where("event_id % 2 <> 0"), folder).groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("A9_stream_append", "SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(t):
    run = f"{shared_dir(t.spark)}/audit-{uuid.uuid4().hex}"
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{t.sf_dir}/events.parquet*")
    rows = source.select("event_id", F.col("event_type").alias("kind"))
    for _ in range(2):  # the second run finds nothing new
        S.append_audit(rows, f"{run}/trail", f"{run}/checkpoint").awaitTermination()
    return S.audit_trail(t.spark, f"{run}/trail", rows.schema).groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("A11_last_report", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"k":' || regexp_extract(props, '-?[0-9]+') || '}' END AS report FROM events""")
def _(t):
    noisy = F.concat(F.lit('start {"x": {bad}} then {"k":0} and '), "props", F.lit(" done } tail"))
    log = F.when(F.col("event_id") % 5 == 0, "no {report here").when(F.col("event_id") % 2 == 0, F.concat(F.lit("﻿ "), "props")).otherwise(noisy)
    return t.events.select("event_id", I.last_report(log).alias("report"))


@query("B25_category_rollup", """SELECT r_regionkey AS parent_id, n_nationkey + 100 AS category_id, CASE WHEN n_nationkey IS NOT NULL THEN max(place) END AS place, sum(n)::BIGINT AS books FROM (SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey % 3, n_nationkey) AS place, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n
 FROM region JOIN nation ON r_regionkey = n_regionkey) GROUP BY ROLLUP (r_regionkey, n_nationkey)""")
def _(t):
    key = F.col("n_nationkey")
    top = t.region.select(F.col("r_regionkey").alias("category_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("sort_order"))
    categories = t.nation.select((key + 100).alias("category_id"), F.col("n_regionkey").cast("int").alias("parent_id"), (key % 3).cast("int").alias("sort_order")).unionByName(top)
    return C.category_rollup(categories, t.supplier.select(F.col("s_suppkey").alias("book_id"), (F.col("s_nationkey") + 100).alias("category_id")))


BOOK = """k AS (SELECT book_id, title, 'SKU-' || book_id AS sku, CASE WHEN book_id % 3 = 0 THEN NULL ELSE series END AS author, CASE book_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'processing' ELSE 'published' END AS status, book_id % 100 AS created_at FROM books),
v AS (SELECT edition_id AS narration_id, book_id, language_code, CASE WHEN edition_id % 3 = 0 THEN 'completed' ELSE 'queued' END AS status, edition_id % 2 = 0 AS is_outdated FROM editions)"""


def books(t):
    b = F.col("book_id")
    return t.books.select(b, "title", F.concat(F.lit("SKU-"), b.cast("string")).alias("sku"), F.when(b % 3 != 0, F.col("series")).alias("author"), F.when(b % 4 == 0, "ready").when(b % 4 == 1, "processing").otherwise("published").alias("status"), (b % 100).alias("created_at"))


def narrations(t):
    e = F.col("edition_id")
    return t.editions.select(e.alias("narration_id"), "book_id", "language_code", F.when(e % 3 == 0, "completed").otherwise("queued").alias("status"), (e % 2 == 0).alias("is_outdated"))


@query("B28_dashboard_list", """SELECT book_id, title, 'ready' AS shown FROM (SELECT * FROM k WHERE status = 'ready' AND (lower(title) LIKE '%a%' OR lower(sku) LIKE '%a%' OR lower(author) LIKE '%a%') ORDER BY created_at DESC, book_id DESC LIMIT 50)
 UNION ALL SELECT book_id, title, 'narrated' FROM (SELECT * FROM k WHERE book_id IN (SELECT book_id FROM v WHERE status = 'completed') AND (lower(title) LIKE '%sku-1%' OR lower(sku) LIKE '%sku-1%' OR lower(author) LIKE '%sku-1%') ORDER BY created_at DESC, book_id DESC LIMIT 50)""", ("books", "editions"), BOOK)  # fmt: skip
def _(t):
    shown = lambda term, only: C.dashboard_list(books(t), t.editions, narrations(t), term, only).select("book_id", "title", F.lit(only).alias("shown"))
    return shown("a", "ready").unionByName(shown("SKU-1", "narrated"))


@query("B29_dashboard_counts", """SELECT (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k WHERE status = 'ready') AS ready, (SELECT count(*) FROM k WHERE status = 'processing') AS processing, (SELECT count(DISTINCT book_id) FROM editions) AS translated,
 (SELECT count(DISTINCT book_id) FROM v WHERE status = 'completed') AS narrated, (SELECT count(*) FROM v WHERE status IN ('queued', 'processing')) AS active_jobs""", ("books", "editions"), BOOK)
def _(t):
    return C.dashboard_counts(books(t), t.editions, narrations(t), narrations(t))


@query("B30_missing_requirements", """SELECT book_id, array_to_string(list_filter([CASE WHEN c IS NULL THEN 'primary_category' END, CASE WHEN book_id % 5 = 0 AND e IS NULL THEN 'language' END, CASE WHEN book_id % 11 = 0 THEN 'book_type' END, CASE WHEN book_id % 13 = 0 THEN 'age_range' END, CASE WHEN d IS NULL THEN 'description' END,
 CASE WHEN NOT e THEN 'publishable_edition' END], lambda x: x IS NOT NULL), ',') AS missing FROM books LEFT JOIN (SELECT DISTINCT l_partkey AS book_id, 1 AS c FROM lineitem WHERE l_linenumber = 1) USING (book_id) LEFT JOIN (SELECT DISTINCT l_partkey AS book_id, 1 AS d FROM lineitem WHERE l_returnflag = 'A') USING (book_id)
 LEFT JOIN (SELECT book_id, bool_or(publication_status = 'published') AS e FROM editions GROUP BY 1) USING (book_id)""", ("books", "editions"))  # fmt: skip
def _(t):
    b, line = F.col("book_id"), F.col("l_partkey").alias("book_id")
    rows = t.books.select(b, F.when(b % 5 != 0, "en").alias("original_language"), F.when(b % 11 != 0, F.col("book_type")).otherwise("").alias("book_type"), F.when(b % 13 != 0, F.col("age_min")).alias("age_min"), "age_max")
    categories = t.lineitem.select(line, (F.col("l_linenumber") == 1).alias("is_primary"))
    descriptions = t.lineitem.select(line, F.when(F.col("l_returnflag") == "A", "approved").otherwise("draft").alias("status"))
    return C.missing_requirements(rows, categories, descriptions, t.editions.select("book_id", (F.col("publication_status") == "published").alias("store_visible"))).withColumn("missing", F.array_join("missing", ","))


@query("B31_single_primary", "SELECT l_partkey AS book_id, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS category FROM lineitem WHERE l_linenumber = 1 GROUP BY 1")
def _(t):
    links = t.lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.single_primary(links, "seq")


@query("B33_store_badges", "SELECT book_id, coalesce(a, false) AS audio, n + 1 AS languages FROM books LEFT JOIN (SELECT book_id, count(*) AS n FROM editions GROUP BY 1) USING (book_id) LEFT JOIN (SELECT book_id, bool_or(status = 'completed') AS a FROM v GROUP BY 1) USING (book_id)", ("books", "editions"), BOOK)
def _(t):
    return C.store_badges(t.books, t.editions, narrations(t))


@query("B34_serving_narration", "SELECT book_id, min(narration_id) AS narration_id FROM v WHERE status = 'completed' AND language_code = 'l5' AND NOT is_outdated GROUP BY 1", ("books", "editions"), BOOK)
def _(t):
    return C.serving_narration(narrations(t), "l5")


ALIASES, HINTS, LIKED = {"green": "Aliased Green"}, {"serif": ["ivory"], "display": ["blue", "red"]}, {"display": ["no such", "Almond"]}


@query("K18_font_match", r"""WITH f AS (SELECT font, CASE min(p_partkey) % 3 WHEN 0 THEN 'serif' WHEN 1 THEN 'display' ELSE 'handwriting' END AS category, min(p_partkey) AS place, lower(font) AS name FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS font FROM part WHERE p_partkey % 10 = 0) GROUP BY font),
r AS (SELECT DISTINCT p_name AS family, trim(replace(regexp_replace(lower(p_name), '^[a-z]{6}\+', ''), '-', ' ')) AS clean FROM part), s AS (SELECT family, clean, font, name, place, coalesce(list_sum(list_transform(list_distinct(list_filter(string_split_regex(clean, '\s+'), lambda w: w <> '')), lambda w: CASE WHEN contains(name, w) THEN length(w) ELSE 0 END)), 0) AS score FROM r, f),
n AS (SELECT family, max(score) AS top, arg_min(font, -score * 1000000 + place) AS near, arg_min(font, place) FILTER (name = replace(clean, ' ', '')) AS exact FROM s GROUP BY 1),
c AS (SELECT category, arg_min(font, place) AS of_kind FROM f GROUP BY 1)
SELECT r.family, CASE WHEN contains(clean, 'green') OR contains('green', clean) THEN 'Aliased Green' WHEN exact IS NOT NULL THEN exact WHEN top < 3 THEN coalesce(of_kind, CASE WHEN top > 0 THEN near END) ELSE near END AS font FROM r LEFT JOIN n USING (family)
LEFT JOIN c ON category = CASE WHEN contains(replace(clean, ' ', ''), 'ivory') THEN 'serif' WHEN contains(replace(clean, ' ', ''), 'blue') OR contains(replace(clean, ' ', ''), 'red') THEN 'display' ELSE 'handwriting' END""")
def _(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    fonts = t.part.where("p_partkey % 10 = 0").groupBy(first.alias("font")).agg(F.min("p_partkey").alias("place"))
    kind = F.when(F.col("place") % 3 == 0, "serif").when(F.col("place") % 3 == 1, "display").otherwise("handwriting")
    return X.font_match(t.part.select(F.col("p_name").alias("family")), fonts.withColumn("category", kind), ALIASES, HINTS, LIKED)


@query("K20_page_fonts", "SELECT page_id, array_to_string(list(font_name ORDER BY f, font_name), ',') AS families FROM (SELECT page_id, font_name, min(span_no) AS f FROM spans GROUP BY 1, 2) GROUP BY 1", ("spans",))
def _(t):
    return X.page_fonts(t.spans)


@query("K21_link_risks", """SELECT page_id, len(l) AS links, len(list_filter(l, lambda x: regexp_matches(lower(x), '^(javascript|file|data|vbscript):'))) AS risky FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def _(t):
    return I.link_risks(t.pages)


@query("K21_file_risks", """SELECT o_orderkey AS file_id, CASE WHEN o_totalprice * 500 > 104857600 THEN 'oversized_file' END AS threat, CASE WHEN o_totalprice * 500 <= 104857600 AND o_custkey % 1000 > 500 THEN 'many_pages' END AS warning, o_totalprice * 500 <= 104857600 AS safe FROM orders""")
def _(t):
    return P.file_risks(t.orders.select(F.col("o_orderkey").alias("file_id"), (F.col("o_totalprice") * 500).alias("bytes"), (F.col("o_custkey") % 1000).alias("pages")))


# Lines of a book in two columns, 2 points apart, most of them open and in lower case; the fold is a recursion down each column.
LINES = r""" r AS (SELECT book_id AS page_id, page_number AS span_no, text, trim(coalesce(text, '')) AS t, page_number % 2 * 200.0::DOUBLE AS x0, page_number * 6.0::DOUBLE AS y0, page_number % 2 * 200.0::DOUBLE + 150 AS x1,
 page_number * 6.0::DOUBLE + 10 AS y1, regexp_replace(coalesce(text, ''), '\P{L}', '', 'g') AS le FROM (SELECT *, CASE WHEN page_number % 5 <> 0 THEN lower(rtrim(extracted_text, '.')) ELSE extracted_text END AS text FROM book_pages)),
b AS (SELECT *, t <> '' AND NOT (le <> '' AND upper(le) = le AND NOT regexp_matches(le, '\p{Ll}') AND length(text) < 30) AS body, list_filter(regexp_split_to_array(t, '[,\s]+'), lambda w: w <> '') AS ws FROM r),
f AS (SELECT page_id, span_no, t, x0, y0, x1, y1, CASE WHEN regexp_full_match(t, '[-–—]\s*\p{L}{1,4}') THEN 2 WHEN regexp_full_match(t, '\p{L}{1,3}') THEN 1 ELSE 0 END AS sound,
 CASE WHEN len(ws) BETWEEN 1 AND 3 AND len(list_filter(ws, lambda w: NOT regexp_full_match(w, '\p{L}+'))) = 0 THEN CASE WHEN contains(t, ',') THEN 2 ELSE 1 END ELSE 0 END AS example, regexp_matches(t, '\S\s+\S') AS several, regexp_matches(t, '[.!?,:;\-–—]$') AS closed,
 regexp_matches(t, '\s[-–—]\s') AS entry, regexp_matches(t, '^\p{Ll}') AS lower, row_number() OVER (PARTITION BY page_id, x0 ORDER BY y0) AS k FROM b WHERE body),
u AS (SELECT page_id, x0, k, 1 AS no, t, y0, y1, sound, several AND NOT closed AS open, entry, 1 AS lines, span_no FROM f WHERE k = 1 UNION ALL
 SELECT page_id, x0, k, CASE WHEN j THEN no ELSE no + 1 END, CASE WHEN j THEN t || ' ' || t2 ELSE t2 END, CASE WHEN j THEN y0 ELSE y02 END, y12, CASE WHEN j THEN 0 ELSE sound2 END, CASE WHEN j THEN NOT closed ELSE several AND NOT closed END, CASE WHEN j THEN entry OR entry2 ELSE entry2 END, CASE WHEN j THEN lines + 1 ELSE 1 END, CASE WHEN j THEN span_no ELSE span2 END
 FROM (SELECT u.page_id, u.x0, f.k, u.no, u.t, u.y0, u.y1, u.sound, u.open, u.entry, u.lines, u.span_no, f.t AS t2, f.y0 AS y02, f.y1 AS y12, f.sound AS sound2, f.several, f.closed, f.entry AS entry2, f.span_no AS span2,
 f.y0 - u.y1 BETWEEN -0.3 * greatest(1, u.y1 - u.y0, 10) AND 0.9 * greatest(1, u.y1 - u.y0, 10) AND ((u.sound = 2 AND example > 0) OR (u.sound = 1 AND example = 2) OR (u.open AND f.several AND f.lower AND NOT u.entry AND NOT f.entry)) AS j FROM u JOIN f ON f.page_id = u.page_id AND f.x0 = u.x0 AND f.k = u.k + 1)),
o AS (SELECT page_id, span_no, t AS text, x0, y0, x0 + 150 AS x1, y1, lines FROM u QUALIFY row_number() OVER (PARTITION BY page_id, x0, no ORDER BY k DESC) = 1 UNION ALL SELECT page_id, span_no, coalesce(text, ''), x0, y0, x1, y1, 1 FROM b WHERE NOT body)"""


@query("C30_continuation_lines", "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY round_even(y0 / 2, 0), x0, span_no) AS place, text, x0, y0, x1, y1, lines FROM o", ("book_pages",), LINES, recursive=True)
def _(t):
    n = F.col("page_number")
    lines = t.book_pages.select(F.col("book_id").alias("page_id"), n.alias("span_no"), F.when(n % 5 != 0, F.lower(F.rtrim("extracted_text", F.lit(".")))).otherwise(F.col("extracted_text")).alias("text"), F.lit(False).alias("is_page_number"), (n % 2 * 200.0).alias("x0"), (n * 6.0).alias("y0"), (n % 2 * 200.0 + 150).alias("x1"), (n * 6.0 + 10).alias("y1"))
    return X.continuation_lines(lines)


@query("P8_action_audit", "SELECT event_type AS action, count(*) AS n, round(sum(value), 4) AS spent FROM events GROUP BY 1")
def _(t):
    return P.action_audit(t.events, "event_type", "value")


@query("T3_page_changes", "SELECT page_id, page_hash, seq FROM (SELECT user_id AS page_id, event_id AS seq, substr(md5(event_type), 1, 12) AS page_hash, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, event_type AS e FROM events) WHERE b IS DISTINCT FROM e")
def _(t):
    return streamed(t, "changes", lambda rows: S.page_changes(rows.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))), "append")
