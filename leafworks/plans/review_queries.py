"""Readiness, coverage, typography, structure and comparison queries over events, text boxes and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import gates as G

from .gate_queries import MERGED
from .registry import query

CANDIDATES = f"""{MERGED}, c AS (SELECT DISTINCT candidate_id, CASE WHEN candidate_id % 13 = 0 THEN '' ELSE 'f' || candidate_id % 7 END AS fingerprint, CASE WHEN candidate_id % 17 = 0 THEN NULL ELSE 'h' || candidate_id % 3 END AS output_sha256, candidate_id % 19 <> 0 AS asks FROM checks),
k AS (SELECT candidate_id, check_name AS key, status, CASE WHEN candidate_id % 5 = 0 THEN 'f9' ELSE 'f' || candidate_id % 7 END AS cf, 'h' || candidate_id % 3 AS oh FROM m),
a AS (SELECT candidate_id, CASE WHEN check_name = 'visual' THEN 'artwork' ELSE 'language' END AS key, 'approved' AS status, CASE WHEN candidate_id % 6 = 0 THEN NULL ELSE 'f' || candidate_id % 7 END AS cf, 'h' || candidate_id % 3 AS oh FROM m WHERE check_name IN ('visual', 'fit')),
q AS (SELECT candidate_id, fingerprint, output_sha256, unnest(['structure', 'fit']) AS key, 'passed' AS want, 'CHECK_UNRESOLVED_OR_STALE' AS code FROM c UNION ALL SELECT candidate_id, fingerprint, output_sha256, unnest(['artwork', 'language']), 'approved', 'APPROVAL_PENDING_OR_STALE' FROM c),
i AS (SELECT q.candidate_id, code || ':' || q.key AS code FROM q JOIN c USING (candidate_id) LEFT JOIN (SELECT *, 'passed' AS want FROM k UNION ALL SELECT *, 'approved' FROM a) r ON r.candidate_id = q.candidate_id AND r.key = q.key AND r.want = q.want
 WHERE c.fingerprint <> '' AND c.output_sha256 IS NOT NULL AND asks AND NOT coalesce(r.status = q.want AND r.cf = q.fingerprint AND r.oh = q.output_sha256, false)
 UNION ALL SELECT candidate_id, 'INVALID_GATE_INPUT' FROM c WHERE fingerprint = '' OR output_sha256 IS NULL OR NOT asks),
e3 AS (SELECT c.candidate_id, count(i.code) = 0 AS ready, coalesce(array_to_string(list_sort(list(i.code) FILTER (i.code IS NOT NULL)), ','), '') AS codes FROM c LEFT JOIN i ON c.candidate_id = i.candidate_id GROUP BY 1)"""


def readiness(t):
    id_ = F.col("candidate_id")
    present = F.concat(F.lit("f"), (id_ % 7).cast("string"))
    hash_ = F.concat(F.lit("h"), (id_ % 3).cast("string"))
    asks = F.when(id_ % 19 != 0, F.array(F.lit("structure"), F.lit("fit"), F.lit("fit"))).otherwise(F.array().cast("array<string>"))
    candidates = t.checks.select("candidate_id").distinct().select(id_, F.when(id_ % 13 == 0, "").otherwise(present).alias("fingerprint"), F.when(id_ % 17 != 0, hash_).alias("output_sha256"), asks.alias("required_checks"), F.array(F.lit("artwork"), F.lit("language")).alias("required_approvals"))
    merged = G.merge_checks(t.checks)
    checks = merged.select(id_, F.col("check_name").alias("key"), "status", F.when(id_ % 5 == 0, "f9").otherwise(present).alias("candidate_fingerprint"), hash_.alias("output_sha256"))
    approvals = merged.where("check_name IN ('visual', 'fit')").select(id_, F.when(F.col("check_name") == "visual", "artwork").otherwise("language").alias("key"), F.lit("approved").alias("status"), F.when(id_ % 6 != 0, present).alias("candidate_fingerprint"), hash_.alias("output_sha256"))
    return G.candidate_readiness(candidates, checks, approvals)


@query("E3_readiness", "SELECT * FROM e3", ("checks",), CANDIDATES)
def _(t):
    return readiness(t).withColumn("codes", F.array_join("codes", ","))


@query("E7_state_guards", f"""SELECT candidate_id, coalesce(al, false) AND ready AS may_approve, candidate_id % 4 = 0 OR ready AS may_publish, candidate_id % 4 = 0 OR candidate_id % 3 = 1 AS may_narrate, candidate_id % 4 = 0 OR ready AS store_visible
 FROM e3 LEFT JOIN (SELECT user_id AS candidate_id, bool_and(value > 0.05) AS al FROM events WHERE event_type <> 'view' GROUP BY 1) USING (candidate_id)""", ("checks",), CANDIDATES)  # fmt: skip
def _(t):
    ready = readiness(t)
    id_ = F.col("candidate_id")
    editions = ready.select(id_, F.when(id_ % 4 == 0, "en").otherwise("af").alias("language_code"), F.when(id_ % 3 == 1, "approved").otherwise("ready").alias("render_status"))
    pages = t.events.where("event_type <> 'view'").select(F.col("user_id").alias("candidate_id"), (F.col("value") > 0.05).alias("approved"))
    return G.state_guards(editions, pages, ready)


@query("E8_coverage", """SELECT book_id, page_number, code FROM (SELECT coalesce(e.book_id, r.book_id) AS book_id, coalesce(e.page_number, r.page_number) AS page_number, CASE WHEN e.book_id IS NULL OR r.n > 1 THEN 'UNEXPECTED_OR_DUPLICATE_PAGE' WHEN r.n IS NULL THEN 'PAGE_NOT_CHECKED' WHEN r.f <> e.f THEN 'STALE_VISUAL_RESULT'
 WHEN r.status <> 'passed' THEN 'VISUAL_CHECK_UNRESOLVED' END AS code FROM (SELECT DISTINCT user_id AS book_id, event_id % 4 AS page_number, user_id % 2 AS f FROM events WHERE event_type = 'purchase') e
 FULL JOIN (SELECT user_id AS book_id, event_id % 5 AS page_number, event_id % 9 % 2 AS f, CASE WHEN value < 1 THEN 'failed' ELSE 'passed' END AS status, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) AS n FROM events WHERE event_type = 'click'
 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')) r ON e.book_id = r.book_id AND e.page_number = r.page_number) WHERE code IS NOT NULL
 UNION ALL SELECT DISTINCT user_id, NULL, 'EMPTY_EXPECTED_PAGE_SET' FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")  # fmt: skip
def _(t):
    book = F.col("user_id").alias("book_id")
    books = t.events.select(book).distinct().withColumn("fingerprint", F.col("book_id") % 2)
    expected = t.events.where("event_type = 'purchase'").select(book, (F.col("event_id") % 4).alias("page_number"))
    records = t.events.where("event_type = 'click'").select(book, (F.col("event_id") % 5).alias("page_number"), F.col("event_id").alias("seq"), F.when(F.col("value") < 1, "failed").otherwise("passed").alias("status"), (F.col("event_id") % 9 % 2).alias("candidate_fingerprint"))
    return G.coverage(books, expected, records)


ROLES = ["heading", "paragraph", "table_header", "table_cell", "word_item", "list_item", "caption"]
ROLE_SQL = "CASE (page_id + span_no) % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END"


def roles(t):
    n = (F.col("page_id") + F.col("span_no")) % 7
    role = F.lit(None).cast("string")
    for i, r in enumerate(ROLES):
        role = F.when(n == i, r).otherwise(role)
    return t.spans.withColumn("role", role)


BODY = "'paragraph', 'table_cell', 'list_item', 'caption', 'word_item'"


@query("E14_typography", f"""SELECT page_id, 'minReadableSize' AS failure, role FROM u GROUP BY 1, 3 HAVING min(font_size) + 0.05 < 12 UNION ALL SELECT page_id, 'peerRegionVariance', role FROM u WHERE role IN ('table_cell', 'table_header', 'word_item', 'list_item') GROUP BY 1, 3 HAVING count(*) > 1 AND (max(font_size) - min(font_size)) / min(font_size)::DOUBLE > 0.15
 UNION ALL SELECT page_id, 'typographyHierarchy', NULL FROM u GROUP BY 1 HAVING avg(font_size) FILTER (role IN ('heading', 'table_header')) <= avg(font_size) FILTER (role IN ({BODY})) UNION ALL SELECT page_id, 'tableHeaderHierarchy', NULL FROM u GROUP BY 1
 HAVING avg(font_size) FILTER (role = 'table_header') + 0.05 < coalesce(avg(font_size) FILTER (role = 'table_cell'), avg(font_size) FILTER (role = 'word_item'))""", ("spans",), f"u AS (SELECT page_id, font_size, {ROLE_SQL} AS role FROM spans)")  # fmt: skip
def _(t):
    return G.typography(roles(t), 12.0)


@query("E16_size_consistency", """SELECT page_id, count(*) AS clusters, count(*) FILTER (n >= 2) >= 2 OR bool_or(n >= 2 AND hi / lo::DOUBLE > 1.18) AS uneven FROM (SELECT page_id, c, count(*) AS n, min(size) AS lo, max(size) AS hi FROM (SELECT *, sum(g) OVER (PARTITION BY page_id ORDER BY size, line_no ROWS UNBOUNDED PRECEDING) AS c FROM
 (SELECT *, CASE WHEN (size - lag(size) OVER w) / lag(size) OVER w::DOUBLE <= 0.18 THEN 0 ELSE 1 END AS g FROM (SELECT page_id, span_no // 2 AS line_no, max(font_size) AS size FROM spans WHERE page_id % 3 > 0 AND font_name <> 'F5' GROUP BY 1, 2) WINDOW w AS (PARTITION BY page_id ORDER BY size, line_no))) GROUP BY 1, 2) GROUP BY 1""", ("spans",))  # fmt: skip
def _(t):
    spans = t.spans.withColumn("line_no", F.expr("span_no div 2")).withColumn("text", F.when(F.col("font_name") != "F5", "x").otherwise(" "))
    pages = t.spans.select("page_id", F.when(F.col("page_id") % 3 == 0, "story").when(F.col("page_id") % 3 == 1, "cover").otherwise("back_cover").alias("page_type"))
    return G.size_consistency(spans, pages)


NAMES = {"F0": "CharisSIL-Bold", "F1": "Nimbus Sans L", "F2": "Playpen Sans", "F3": "Helvetica-House", "F4": "Times New Roman", "F5": "Arial"}
NAME_SQL = "CASE font_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"


def drawn(t):
    known = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return t.spans.withColumn("font_name", known[F.col("font_name")]).withColumn("text", F.concat(F.lit(" "), F.repeat(F.col("role"), F.col("span_no").cast("int")), F.lit(" ")))


@query("E17_font_fidelity", f"SELECT page_id, {NAME_SQL} AS font_name, sum(span_no)::BIGINT AS drawn FROM spans WHERE font_name IN ('F0', 'F1', 'F4') GROUP BY 1, 2 HAVING sum(span_no) >= 8", ("spans",))
def _(t):
    return G.font_fidelity(drawn(t), ["playpensans", "helveticahouse"])


@query("E20_semantics", r"""SELECT x.book_id AS page_id, 'missingUnit' AS failure, x.page_number AS unit_no FROM (SELECT book_id + 1 AS book_id, page_number, lower(regexp_extract(trim(extracted_text), '^\S+')) AS f FROM book_pages WHERE page_number <= 3) x JOIN documents ON doc_id = x.book_id
 WHERE f <> '' AND NOT contains(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), f)
 UNION ALL SELECT DISTINCT page_id, 'listOrder', NULL FROM (SELECT page_id, n < lag(n) OVER (PARTITION BY page_id ORDER BY y, i) AS b FROM (SELECT book_id AS page_id, page_number AS i, page_number // 2 AS y, (book_id * 7 + page_number * page_number) % 25 AS n FROM book_pages WHERE book_id % 2 = 0
 AND book_id IN (SELECT book_id + 1 FROM book_pages)) WHERE n BETWEEN 1 AND 20) WHERE b""", ("book_pages",))  # fmt: skip
def _(t):
    line, page = F.col("page_number"), F.col("book_id")
    expected = t.book_pages.where("page_number <= 3").select((page + 1).alias("page_id"), line.alias("unit_no"), F.col("extracted_text").alias("text")).join(t.documents.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    words_ = t.book_pages.select(page.alias("page_id"), (line * 2).alias("word_no"), F.expr("page_number div 2").alias("y0"), F.col("extracted_text").alias("text"))
    numbers = t.book_pages.select(page.alias("page_id"), (line * 2 + 1).alias("word_no"), F.expr("page_number div 2").alias("y0"), ((page * 7 + line * line) % 25).cast("string").alias("text"))
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 2 == 0, "back_cover").otherwise("story").alias("page_type"))
    shown = G.semantics(expected, words_, pages).where("failure = 'missingUnit'")
    return shown.unionByName(G.semantics(expected, numbers, pages).where("failure = 'listOrder'"))


@query("E21_missing_content", "SELECT DISTINCT book_id AS page_id FROM translation_pairs WHERE trim(source_text) <> '' AND book_id NOT IN (SELECT book_id FROM translation_pairs WHERE translated_text IS NOT NULL)", ("translation_pairs",))
def _(t):
    return G.missing_content(t.translation_pairs.select(F.col("book_id").alias("page_id"), F.col("source_text").alias("text")), t.translation_pairs.where("translated_text IS NOT NULL").select(F.col("book_id").alias("page_id")))


@query("E22_source_vs_output", """SELECT doc_id, same_pages, CASE WHEN same_pages THEN resized END AS resized, CASE WHEN same_pages THEN turned END AS turned, CASE WHEN same_pages THEN images_lost END AS images_lost, CASE WHEN same_pages THEN CASE WHEN o / greatest(s, 1) > 5 THEN 'larger' WHEN o / greatest(s, 1) < 0.1 THEN 'smaller' ELSE 'ok' END END AS size_verdict
 FROM (SELECT l_orderkey AS doc_id, count(*) FILTER (l_orderkey % 10 = 0 AND l_linenumber = 3) = 0 AS same_pages, count(*) FILTER (l_partkey % 9 = 0) AS resized, count(*) FILTER (l_suppkey % 5 = 0) AS turned, count(*) FILTER (l_linenumber <= 5 AND l_partkey % 4 = 0) AS images_lost FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) GROUP BY 1)
 JOIN (SELECT o_orderkey, o_totalprice AS s, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice * 6 WHEN 1 THEN o_totalprice / 20 ELSE o_totalprice END AS o FROM orders) ON doc_id = o_orderkey""")  # fmt: skip
def _(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    base = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.col("l_quantity").alias("width"), F.lit(100.0).alias("height"), (F.col("l_linenumber") % 4 * 90).alias("rotation"), F.lit(2).alias("images"), "l_partkey", "l_suppkey")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    output = base.where("NOT (doc_id % 10 = 0 AND page_number = 3)").withColumn("width", F.when(part % 9 == 0, F.col("width") + 0.5).otherwise(F.col("width") + 0.05)).withColumn("rotation", F.when(supp % 5 == 0, F.col("rotation") + 90).otherwise(F.col("rotation"))).withColumn("images", F.when(part % 4 == 0, 1).otherwise(3))
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    files = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(key.alias("doc_id"), price.alias("source_bytes"), F.when(key % 3 == 0, price * 6).when(key % 3 == 1, price / 20).otherwise(price).alias("output_bytes"))
    return G.source_vs_output(base.drop("l_partkey", "l_suppkey"), output.drop("l_partkey", "l_suppkey"), files)


@query("E23_sample_difference", """SELECT label AS page, n AS samples, k AS changed, round_even(100.0 * k / greatest(n, 1), 2)::DOUBLE AS percent, h AS threshold, 100.0 * k / greatest(n, 1) < h AS passed FROM (SELECT label, CASE WHEN label % 2 = 0 THEN 5 ELSE 40 END AS h, count(*) FILTER (o) AS n, count(*) FILTER (o AND vec_id % 48 = 0) AS k
 FROM (SELECT *, vec_id % 4 = 0 AND NOT (label % 2 = 0 AND vec_id BETWEEN 10 * label AND 10 * label + 300) AS o FROM embeddings) GROUP BY 1)""")  # fmt: skip
def _(t):
    rows = t.embeddings.select(F.col("label").alias("page"), F.col("vec_id").alias("x"), F.lit(0).alias("y"), *[F.lit(100.0).alias(c) for c in "rgb"])
    label = F.col("label")
    masks = t.embeddings.select("label").distinct().where("label % 2 = 0").select(label.alias("page"), (10 * label).alias("x0"), F.lit(-1).alias("y0"), (10 * label + 300).alias("x1"), F.lit(1).alias("y1"))
    return G.sample_difference(rows, rows.withColumn("r", F.when(F.col("x") % 48 == 0, 140.0).otherwise(F.col("r"))), masks)


KIND = "CASE span_no % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'word_list_item' ELSE 'table_header' END"
ELEMENTS = f"""d AS (SELECT page_id, span_no, x0 + CASE WHEN span_no % 5 = 0 THEN 40 ELSE 0 END AS x0, y0, x1 + CASE WHEN span_no % 5 = 0 THEN 40 ELSE 0 END AS x1, y1, font_size, {NAME_SQL} AS font_name, span_no AS len FROM spans WHERE span_no <> 6),
e AS (SELECT page_id, 'e' || span_no AS element_id, {KIND} AS role, CASE WHEN span_no % 4 = 0 THEN 'body' WHEN span_no % 4 = 3 THEN 'header' END AS peer_group, x0, y0, x1, y1 FROM spans WHERE span_no <> 7),
j AS (SELECT e.page_id, element_id, role, peer_group, (d.y0 + d.y1) / 2 BETWEEN e.y0 - 3 AND e.y1 + 3 AS high, (d.x0 + d.x1) / 2 BETWEEN e.x0 - 3 AND e.x1 + 3 AS wide, d.x1 > e.x0 - 200 AND d.x0 < e.x1 + 200 AS near, d.x0 < e.x0 - greatest(3, (e.x1 - e.x0) * 0.06) OR d.x1 > e.x1 + greatest(3, (e.x1 - e.x0) * 0.06) AS spill,
 d.x0 < e.x0 - 3 OR d.x1 > e.x1 + 3 OR d.y0 < e.y0 - 3 - (e.y1 - e.y0) * 0.35 OR d.y1 > e.y1 + 3 + (e.y1 - e.y0) * 0.35 AS out, d.font_size, font_name IN ('{NAMES["F0"]}', '{NAMES["F1"]}', '{NAMES["F4"]}') AND len >= 4 AS font FROM e LEFT JOIN d ON e.page_id = d.page_id),
f AS (SELECT page_id, element_id, role, peer_group, coalesce(bool_or(high AND wide), false) AS met, coalesce(bool_or(high AND near AND spill), false) AS spilled, coalesce(bool_or(high AND wide AND out), false) AS out, coalesce(bool_or(high AND wide AND spill), false) AS aside, coalesce(bool_or(high AND wide AND font), false) AS font, max(font_size) FILTER (high AND wide) AS size FROM j GROUP BY ALL),
b AS (SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM e WHERE role IN ('heading', 'table_header') GROUP BY 1)"""


@query("E28_structure", """SELECT page_id, CASE WHEN role = 'paragraph' AND spilled THEN 'elementOutOfColumn' ELSE 'elementMissing' END AS failure, element_id FROM f WHERE NOT met UNION ALL SELECT page_id, 'elementOutOfBox', element_id FROM f WHERE met AND out AND role IN ('heading', 'table_header')
 UNION ALL SELECT page_id, 'elementOutOfColumn', element_id FROM f WHERE met AND aside AND role = 'paragraph' UNION ALL SELECT page_id, 'elementFont', element_id FROM f WHERE met AND font
 UNION ALL SELECT page_id, 'peerSizeMismatch', peer_group FROM f WHERE met AND peer_group IS NOT NULL GROUP BY 1, 3 HAVING count(*) > 1 AND max(size) / min(size)::DOUBLE > CASE peer_group WHEN 'header' THEN 2.1 ELSE 1.18 END
 UNION ALL SELECT DISTINCT d.page_id, 'elementInvented', NULL FROM d JOIN b ON d.page_id = b.page_id AND (d.x0 + d.x1) / 2 BETWEEN b.x0 - 3 AND b.x1 + 3 AND (d.y0 + d.y1) / 2 BETWEEN b.y0 - 3 AND b.y1 + 3 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = d.page_id AND e.role IN ('heading', 'table_header')
 AND (d.x0 + d.x1) / 2 BETWEEN e.x0 - 3 AND e.x1 + 3 AND (d.y0 + d.y1) / 2 BETWEEN e.y0 - 3 AND e.y1 + 3)""", ("spans",), ELEMENTS)  # fmt: skip
def _(t):
    n = F.col("span_no") % 4
    kind = F.when(n == 0, "heading").when(n == 1, "paragraph").when(n == 2, "word_list_item").otherwise("table_header")
    elements = t.spans.where("span_no <> 7").select("page_id", F.concat(F.lit("e"), F.col("span_no").cast("string")).alias("element_id"), kind.alias("role"), F.when(n == 0, "body").when(n == 3, "header").alias("peer_group"), "x0", "y0", "x1", "y1")
    moved = F.when(F.col("span_no") % 5 == 0, 40).otherwise(0)
    return G.structure(elements, drawn(t).where("span_no <> 6").withColumn("x0", F.col("x0") + moved).withColumn("x1", F.col("x1") + moved), ["playpensans", "helveticahouse"])
