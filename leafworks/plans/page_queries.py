"""Tables, marks, roles, regions, captions and fonts: queries over text boxes and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafworks.operators import layout as L

from .layout_queries import CLUSTERS
from .registry import query

ASSIGNED = CLUSTERS + """, xv AS (SELECT DISTINCT page_id, round_even(x0, 1) AS v FROM spans), xg AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY page_id ORDER BY v) <= 12 THEN 0 ELSE 1 END AS n FROM xv),
xk AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM xg), xc AS (SELECT page_id, cluster, avg(v) AS centre FROM xk GROUP BY 1, 2),
ok AS (SELECT page_id FROM spans GROUP BY 1 HAVING count(*) >= 6 INTERSECT SELECT page_id FROM xc GROUP BY 1 HAVING count(*) >= 2 INTERSECT SELECT page_id FROM c GROUP BY 1 HAVING count(*) >= 3),
sp AS (SELECT *, row_number() OVER () AS id FROM spans WHERE page_id IN (SELECT page_id FROM ok)), pa AS (SELECT sp.page_id, sp.id, any_value(sp.x0) AS x0, any_value(sp.x1) AS x1, any_value(sp.y0) AS y0, any_value(sp.y1) AS y1, arg_min(xc.cluster, abs(sp.x0 - xc.centre) + xc.cluster * 1e-9) AS col FROM sp JOIN xc USING (page_id) GROUP BY 1, 2),
pb AS (SELECT sp.page_id, sp.id, arg_min(c.cluster, abs(sp.y0 - c.centre) + c.cluster * 1e-9) AS rw FROM sp JOIN c USING (page_id) GROUP BY 1, 2), pc AS (SELECT * FROM pa JOIN pb USING (page_id, id)),
cc AS (SELECT page_id, col, count(*) AS items, min(x0) AS lo, max(x1) AS hi FROM pc GROUP BY 1, 2), ev AS (SELECT page_id FROM cc GROUP BY 1 HAVING min(items) >= 0.3 * max(items) OR count(*) FILTER (items >= 3) >= 2),
nx AS (SELECT page_id, cluster AS col, (centre + lead(centre) OVER w) / 2 AS r, (centre + lag(centre) OVER w) / 2 AS l FROM xc WINDOW w AS (PARTITION BY page_id ORDER BY cluster)),
rr AS (SELECT page_id, rw, lead(min(y0)) OVER (PARTITION BY page_id ORDER BY rw) - max(y1) AS gap FROM pc WHERE page_id IN (SELECT page_id FROM ev) GROUP BY 1, 2)"""


@query("K4_inferred_tables", """SELECT page_id, columns, table_rows, round((least(1, columns / 3.0::DOUBLE) + s) / 2, 6) AS confidence FROM (SELECT page_id, count(*) AS columns FROM cc WHERE page_id IN (SELECT page_id FROM ev) GROUP BY 1)
 JOIN (SELECT page_id, count(*) AS table_rows, coalesce(greatest(0, 1 - var_pop(gap) / 100), 0.5) AS s FROM rr GROUP BY 1) USING (page_id)""", ("spans",), ASSIGNED)
def _(t):
    return L.inferred_tables(t.spans, 600.0)[0].withColumn("confidence", F.round(F.col("confidence") * 1_000_000) / 1_000_000)


@query("K4_table_columns", """SELECT page_id, col::BIGINT AS "column", round(CASE WHEN l IS NOT NULL THEN least(lo, l + 2) ELSE greatest(lo - 10, 20) END, 6) AS x_start, round(CASE WHEN r IS NOT NULL THEN greatest(hi, r - 2) ELSE least(hi + 20, 580) END, 6) AS x_end, items, round(least(1, items / k::DOUBLE), 6) AS column_confidence
 FROM cc JOIN nx USING (page_id, col) JOIN (SELECT page_id, count(*) AS k FROM c GROUP BY 1) USING (page_id) WHERE page_id IN (SELECT page_id FROM ev)""", ("spans",), ASSIGNED)
def _(t):
    found = L.inferred_tables(t.spans, 600.0)[1]
    return found.select("page_id", "column", *[F.round(c, 6).alias(c) for c in ("x_start", "x_end", "column_confidence")], "items")


@query("K5_column_bounds", """SELECT page_id, (c - 1)::INTEGER AS "column", round(avg(v), 6) AS centre, min(v) AS "left", round(coalesce((max(v) + lead(min(v)) OVER (PARTITION BY page_id ORDER BY c)) / 2, avg(v) + 120), 6) AS "right" FROM (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS c FROM
 (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY page_id ORDER BY v) < 15 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT page_id, round_even(x0, 0) AS v FROM spans))) GROUP BY page_id, c""", ("spans",))
def _(t):
    return L.column_bounds(t.spans).select("page_id", "column", F.round("centre", 6).alias("centre"), "left", F.round("right", 6).alias("right"))


def words(spans):
    """Boxes with a text by rule: capitals, a bare sign, or a word of their own."""
    n = F.col("span_no") % 4
    return spans.withColumn("text", F.when(n == 0, F.upper(F.concat(F.col("font_name"), F.col("role"), F.lit("x")))).when(n == 1, "12").otherwise(F.concat(F.lit("w"), F.col("font_name")))).withColumn("is_bold", F.col("font_size") > 30)


WORDED = "CASE span_no % 4 WHEN 0 THEN upper(font_name || role || 'x') WHEN 1 THEN '12' ELSE 'w' || font_name END"


@query("K5_header_spans", "SELECT page_id, span_no, y0 < min(y0) OVER (PARTITION BY page_id) + 35 AND (span_no % 4 = 0 OR font_size > 30) AS is_header FROM spans", ("spans",))
def _(t):
    return L.header_spans(words(t.spans))


TRIMMED = """m AS (SELECT page_id, side, list_sort(list(v))[count(*) // 2 + 1] AS v FROM (SELECT page_id, CASE WHEN span_no % 2 = 0 THEN CASE WHEN (x0 + x1) / 2 < 300 THEN 'left' ELSE 'right' END ELSE CASE WHEN (y0 + y1) / 2 < 250 THEN 'top' ELSE 'bottom' END END AS side,
 CASE WHEN span_no % 2 = 0 THEN (x0 + x1) / 2 ELSE (y0 + y1) / 2 END AS v FROM spans WHERE role <> 'N') GROUP BY 1, 2), e AS (SELECT page_id, max(v) FILTER (side = 'left') AS l, max(v) FILTER (side = 'top') AS t, max(v) FILTER (side = 'right') AS r, max(v) FILTER (side = 'bottom') AS b, count(v) AS n
 FROM (SELECT DISTINCT page_id FROM spans) LEFT JOIN m USING (page_id) GROUP BY 1),
z AS (SELECT page_id, coalesce(round_even(l, 1), 0)::DOUBLE AS "left", coalesce(round_even(t, 1), 0)::DOUBLE AS top, coalesce(round_even(r, 1), 600)::DOUBLE AS "right", coalesce(round_even(b, 1), 500)::DOUBLE AS bottom, n::INTEGER AS boundaries,
 round_even(n / 4.0::DOUBLE * CASE WHEN r - l < 300 THEN 0.5 ELSE 1 END * CASE WHEN b - t < 250 THEN 0.5 ELSE 1 END, 3)::DOUBLE AS confidence FROM e)"""


def trimmed(t):
    marks = t.spans.where("role <> 'N'").withColumn("orientation", F.when(F.col("span_no") % 2 == 0, "vertical").otherwise("horizontal"))
    return L.trim_box(marks, t.spans.select("page_id", F.lit(600.0).alias("width"), F.lit(500.0).alias("height")).distinct())


@query("K9_trim_box", "SELECT * FROM z", ("spans",), TRIMMED)
def _(t):
    return trimmed(t)


@query("K10_book_trim", """SELECT page_id // 20 AS book_id, count(*) FILTER (boundaries >= 3) / count(*)::DOUBLE > 0.5 AS has_marks, count(*) FILTER (boundaries >= 3) AS with_marks, count(*) FILTER (boundaries < 3) AS without_marks,
 list_sort(list("left") FILTER (boundaries >= 3))[count(*) FILTER (boundaries >= 3) // 2 + 1] AS "left", list_sort(list(top) FILTER (boundaries >= 3))[count(*) FILTER (boundaries >= 3) // 2 + 1] AS top, list_sort(list("right") FILTER (boundaries >= 3))[count(*) FILTER (boundaries >= 3) // 2 + 1] AS "right",
 list_sort(list(bottom) FILTER (boundaries >= 3))[count(*) FILTER (boundaries >= 3) // 2 + 1] AS bottom, CASE WHEN count(*) FILTER (boundaries >= 3) / count(*)::DOUBLE > 0.5 THEN round_even(avg(confidence) FILTER (boundaries >= 3), 3) ELSE 1 END::DOUBLE AS confidence, count(*) FILTER (boundaries >= 3) AS vector_pages FROM z GROUP BY 1""", ("spans",), TRIMMED)  # fmt: skip
def _(t):
    has = F.col("boundaries") >= 3
    pages = trimmed(t).select(F.expr("page_id div 20").alias("book_id"), has.alias("has_marks"), F.when(has, "vector_crop_marks").otherwise("none").alias("source"), "confidence", *[F.when(has, F.col(c)).alias(c) for c in L.SIDES])
    return L.book_trim(pages)


COUNTS = "i AS (SELECT *, round_even(least(images / 5.0::DOUBLE, 1) * 0.2 + least(paths / 100.0::DOUBLE, 1) * 0.3 + least(spans / 50.0::DOUBLE, 1) * 0.2 + ((images > 0)::INTEGER + (paths > 0)::INTEGER + (spans > 0)::INTEGER + (curves > 0)::INTEGER + (rotated > 0)::INTEGER) / 5.0::DOUBLE * 0.3, 3)::DOUBLE AS complexity FROM (SELECT page_id, page_id // 20 AS book_id, count(*) FILTER (role = 'N') AS images, count(*) FILTER (role = 'N' AND font_size > 30) AS full_page_images, sum(font_size)::BIGINT AS paths, count(*) FILTER (role = 'A') AS curves, sum(span_no)::BIGINT AS rects, max(font_size)::BIGINT AS fills, sum(CASE WHEN role = 'R' THEN span_no * 2 ELSE 0 END)::BIGINT AS spans, count(*) FILTER (font_name = 'F2') AS rotated FROM spans GROUP BY 1))"


def inventory(t):
    role = lambda r: F.col("role") == r
    counts = t.spans.groupBy("page_id").agg(F.count_if(role("N")).alias("images"), F.count_if(role("N") & (F.col("font_size") > 30)).alias("full_page_images"), F.sum("font_size").alias("paths"), F.count_if(role("A")).alias("curves"), F.sum("span_no").alias("rects"), F.max("font_size").alias("fills"), F.sum(F.when(role("R"), F.col("span_no") * 2).otherwise(0)).alias("spans"), F.count_if(F.col("font_name") == "F2").alias("rotated"))
    return L.page_inventory(counts.withColumn("book_id", F.expr("page_id div 20")))


@query("K11_page_inventory", "SELECT page_id, complexity, array_to_string(list_filter([CASE WHEN full_page_images > 0 THEN 'full_page_image' END, CASE WHEN paths > 50 THEN 'heavy_vector_graphics' END, CASE WHEN rects > 10 THEN 'table_structure' END, CASE WHEN rotated > 0 THEN 'rotated_text' END, CASE WHEN spans > 30 THEN 'text_heavy' END, CASE WHEN images > 3 THEN 'multi_image' END, CASE WHEN spans = 0 AND images > 0 THEN 'image_only' END, CASE WHEN fills > 20 THEN 'colored_fills' END], lambda x: x IS NOT NULL), ',') AS traits FROM i", ("spans",), COUNTS)
def _(t):
    return inventory(t).select("page_id", "complexity", F.array_join("traits", ",").alias("traits"))


@query("K11_inventory_summary", "SELECT book_id, count(*) AS pages, round_even(sum(round(complexity * 1000)::BIGINT)::DOUBLE / count(*), 0) / 1000 AS mean_complexity, count(*) FILTER (complexity > 0.6) AS complex_pages, count(*) FILTER (complexity < 0.2) AS simple_pages FROM i GROUP BY 1", ("spans",), COUNTS)
def _(t):
    return L.inventory_summary(inventory(t))


@query("K13_scanned_pages", """SELECT page_id, n AS spans, i AS images, round_even(c, 3)::DOUBLE AS coverage, n < 3 AND (c > 0.5 OR i > 0) AS scanned, round_even(CASE WHEN n < 3 AND c > 0.5 THEN least(1, c + (1 - n / 3.0::DOUBLE) * 0.3) WHEN n < 3 AND i > 0 THEN 0.6 ELSE 1 - c * 0.3 END, 3)::DOUBLE AS confidence
 FROM (SELECT page_id, count(*) FILTER (role = 'A') AS n, count(*) FILTER (role = 'N') AS i, coalesce(max(font_size / 40.0::DOUBLE) FILTER (role = 'N'), 0) AS c FROM spans GROUP BY 1)""", ("spans",))
def _(t):
    images = t.spans.where("role = 'N'").select("page_id", (F.col("font_size") / 40.0).alias("coverage"))
    return L.scanned_pages(t.spans.select("page_id").distinct(), t.spans.withColumn("text", F.when(F.col("role") == "A", "x").otherwise(" ")), images)


@query("K14_rotation", "SELECT page_id, span_no, CASE WHEN a BETWEEN 0 AND 2 OR a >= 358 THEN 'horizontal' WHEN a BETWEEN 265 AND 275 THEN 'vertical_down' WHEN a BETWEEN 85 AND 95 THEN 'vertical_up' WHEN a BETWEEN 40 AND 50 THEN 'diagonal_45' WHEN a BETWEEN 310 AND 320 THEN 'diagonal_neg45' WHEN a BETWEEN 175 AND 185 THEN 'upside_down' ELSE 'rotated_' || CAST(trunc(a) AS INTEGER) END AS rotation FROM (SELECT *, (x0 + y0 * 7) % 360 AS a FROM spans)", ("spans",))
def _(t):
    return t.spans.select("page_id", "span_no", L.rotation_class((F.col("x0") + F.col("y0") * 7) % 360).alias("rotation"))


FONTS = "f AS (SELECT vec_id AS font_id, embedding[1]::DOUBLE AS xh, embedding[2]::DOUBLE AS wr, vec_id % 9 * 100 AS wc, ['serif', 'sans', 'unknown'][label % 3 + 1] AS sc, vec_id % 2 AS wi, abs(embedding[3])::DOUBLE AS cd FROM embeddings WHERE embedding IS NOT NULL)"
FAR = "sqrt(pow(q.xh - f.xh, 2) * 10 + pow(q.wr - f.wr, 2) * 5 + pow((q.wc - f.wc) / 100.0, 2) * 3 + CASE WHEN q.sc <> f.sc AND q.sc <> 'unknown' AND f.sc <> 'unknown' THEN 5 ELSE 0 END + CASE WHEN q.wi <> f.wi THEN 1 ELSE 0 END + CASE WHEN q.cd > 0 AND f.cd > 0 THEN pow((q.cd - f.cd) / greatest(q.cd, 1), 2) * 2 ELSE 0 END)"


@query("K17_nearest_fonts", f"SELECT query_id, font_id, rank FROM (SELECT q.font_id AS query_id, f.font_id, row_number() OVER (PARTITION BY q.font_id ORDER BY {FAR}, f.font_id)::INTEGER AS rank FROM f q JOIN f ON q.font_id % 50 = 0 AND q.font_id <> f.font_id WHERE {FAR} <= 2.5) WHERE rank <= 5", (), FONTS)
def _(t):
    e, i = F.col("embedding"), F.col("vec_id")
    serif = F.element_at(F.array(F.lit("serif"), F.lit("sans"), F.lit("unknown")), (F.col("label") % 3 + 1).cast("int"))
    fonts = t.embeddings.where("embedding IS NOT NULL").select(i.alias("font_id"), e[0].cast("double").alias("x_height_ratio"), e[1].cast("double").alias("width_ratio"), (i % 9 * 100).alias("weight_class"), serif.alias("serif_class"), (i % 2).alias("width_class"), F.abs(e[2]).cast("double").alias("char_density"))
    return L.nearest_fonts(fonts.where("font_id % 50 = 0"), fonts, 2.5, 5).select("query_id", "font_id", "rank")


# the spans of 64 orders on a page, so that boxes meet
CONTENT = """o AS (SELECT page_id // 64 AS page_id, page_id * 10 + span_no AS id, span_no, role, x0, y0, x1, y1, greatest(1e-6, (x1 - x0) * (y1 - y0)) AS area FROM spans),
h AS (SELECT r.page_id, r.id, o.role, greatest(least(r.x1, o.x1) - greatest(r.x0, o.x0), 0) * greatest(least(r.y1, o.y1) - greatest(r.y0, o.y0), 0) AS inter, r.area AS ra, o.area AS oa
FROM o r JOIN o ON r.page_id = o.page_id AND r.role = 'R' AND o.role <> 'R' WHERE r.span_no % 4 > 0)"""


@query("K24_content_class", """SELECT page_id, id AS region_id, CASE WHEN coalesce(n, false) THEN 'native' WHEN coalesce(v, 0) >= 3 THEN 'outlined_vector' ELSE 'raster_text' END AS content FROM (SELECT DISTINCT page_id, id FROM o WHERE role = 'R') LEFT JOIN (SELECT page_id, id, bool_or(role = 'N' AND (inter / ra > 0.3 OR inter / oa > 0.5)) AS n,
 count(*) FILTER (role = 'A' AND (inter / ra > 0.05 OR inter / oa > 0.2)) AS v FROM h GROUP BY 1, 2) USING (page_id, id)""", ("spans",), CONTENT)  # fmt: skip
def _(t):
    spans = t.spans.select("role", "span_no", "x0", "y0", "x1", "y1", F.expr("page_id div 64").alias("page_id"), (F.col("page_id") * 10 + F.col("span_no")).alias("region_id"))
    regions = spans.where("role = 'R'").withColumn("x1", F.when(F.col("span_no") % 4 > 0, F.col("x1")))
    return L.content_class(regions, spans.where("role = 'N'"), spans.where("role = 'A'"))


@query("K29_placed_in_grid", """SELECT page_id, unit_id, "column", cell_y0, cell_y1, CASE WHEN a + b <= 1 OR abs(a - b) / 150 < 0.12 THEN 'center' WHEN a < b THEN 'left' ELSE 'right' END AS align_h, CASE WHEN cell_y1 - cell_y0 <= y1 - y0 + 2 THEN 'top' WHEN c + d <= 1 OR abs(c - d) / 100 < 0.15 THEN 'middle' WHEN c < d THEN 'top' ELSE 'bottom' END AS align_v,
 'p' || page_id || '-col' || "column" AS peer_group FROM (SELECT *, greatest(0, x0 - c0) AS a, greatest(0, c0 + 150 - x1) AS b, greatest(0, y0 - cell_y0) AS c, greatest(0, cell_y1 - y1) AS d FROM (SELECT page_id, id AS unit_id, x0, x1, y0, y1, col AS "column", col * 150.0 AS c0, coalesce(rw * 100.0, y0) AS cell_y0, coalesce(rw * 100.0 + 100, y1) AS cell_y1
 FROM (SELECT *, greatest(0, ceil(((x0 + x1) / 2 - 152) / 150))::INTEGER AS col, CASE WHEN (y0 + y1) / 2 <= 302 THEN greatest(0, ceil(((y0 + y1) / 2 - 102) / 100))::INTEGER END AS rw FROM (SELECT page_id, span_no * 100 + font_size AS id, min(x0) AS x0, min(x1) AS x1, min(y0) AS y0, min(y1) AS y1 FROM spans GROUP BY 1, 2)) WHERE (x0 + x1) / 2 <= 602))""", ("spans",))  # fmt: skip
def _(t):
    units = t.spans.groupBy("page_id", (F.col("span_no") * 100 + F.col("font_size")).alias("unit_id")).agg(*[F.min(c).alias(c) for c in ("x0", "x1", "y0", "y1")])
    pages = t.spans.select("page_id").distinct()
    columns = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("column")).select("page_id", "column", (F.col("column") * 150.0).alias("c0"), (F.col("column") * 150.0 + 150).alias("c1"))
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select("page_id", "row", (F.col("row") * 100.0).alias("r0"), (F.col("row") * 100.0 + 100).alias("r1"))
    return L.placed_in_grid(units, columns, rows)


PAGED = "ARRAY['cover', 'copyright', 'vocabulary', 'back_cover', 'story']"
TEXTS = ["WORDS", "ai - rain, tail", "- nd hand, land", "mother-in-law", "Recognise wh- at the beginning of words", "plain", "AB"]


def typed(t):
    kinds = F.array(*[F.lit(k) for k in ("cover", "copyright", "vocabulary", "back_cover", "story")])
    texts = F.array(*[F.lit(x) for x in TEXTS])
    return t.spans.withColumn("page_type", kinds[(F.col("page_id") % 5).cast("int")]).withColumn("text", texts[((F.col("page_id") + F.col("span_no")) % 7).cast("int")]).withColumn("is_page_number", F.col("span_no") == 7).withColumn("is_end_marker", (F.col("span_no") == 6) & (F.col("page_id") % 3 == 0))


RULED = f"u AS (SELECT *, CASE WHEN span_no = 7 THEN -1 ELSE page_id % 5 END AS k, (page_id + span_no) % 7 AS w, span_no = 6 AND page_id % 3 = 0 AS e FROM spans)"


@query("C29_span_roles", """SELECT page_id, span_no, CASE WHEN k = -1 THEN 'page_number' WHEN e THEN 'end_marker' WHEN k = 0 THEN CASE WHEN font_size >= 40 THEN 'subtitle' WHEN font_size >= 20 THEN 'book_title' ELSE 'publisher' END WHEN k = 1 THEN CASE WHEN font_size >= 40 THEN 'subtitle' ELSE 'copyright' END
 WHEN k = 2 THEN CASE WHEN w = 0 THEN 'heading' WHEN w IN (1, 2, 4) THEN 'phonics' ELSE 'word_list_item' END WHEN k = 3 THEN 'list_item' ELSE 'paragraph' END AS semantic_role FROM u""", ("spans",), RULED)
def _(t):
    c = F.col
    return typed(t).select("page_id", "span_no", L.span_role(c("page_type"), c("font_size"), c("text"), c("is_page_number"), c("is_end_marker")).alias("semantic_role"))


@query("K30_regions", """SELECT page_id, key AS region_key, CASE key WHEN 'page-number' THEN 'page_number' WHEN 'subtitle' THEN 'cover_subtitle' WHEN 'publisher' THEN 'publisher_info' WHEN 'title' THEN 'cover_title' WHEN 'info-left' THEN 'publisher_info' WHEN 'info-right' THEN 'character_bio' WHEN 'headers' THEN 'table_header' WHEN 'title-list' THEN 'title_list'
 WHEN 'prose' THEN 'story_prose' WHEN 'phonics' THEN 'phonics' ELSE 'word_list' END AS region_type, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM (SELECT *, CASE WHEN k = -1 THEN 'page-number' WHEN k = 0 THEN CASE WHEN font_size >= 40 THEN 'subtitle' ELSE 'publisher' END
 WHEN k = 1 THEN CASE WHEN font_size >= 40 THEN 'title' WHEN x0 < 300 THEN 'info-left' ELSE 'info-right' END WHEN k = 2 THEN CASE WHEN w = 0 THEN 'headers' WHEN w IN (1, 2, 4) THEN 'phonics' ELSE 'col-' || CAST(trunc(x0 / 120) AS INTEGER) END WHEN k = 3 THEN 'title-list' ELSE 'prose' END AS key FROM u) GROUP BY 1, 2""", ("spans",), RULED)  # fmt: skip
def _(t):
    return L.regions_of(typed(t))


LINES = "b AS (SELECT book_id AS page_id, page_number AS span_no, trim(extracted_text) AS t, page_number * 14.0 + CASE WHEN book_id % 3 = 0 THEN page_number * page_number ELSE 0 END AS y0 FROM book_pages WHERE trim(extracted_text) <> '' AND book_id % 4 > 0)"


@query("C31_end_markers", r"""SELECT page_id, span_no FROM (SELECT *, length(t) - length(replace(t, ' ', '')) + 1 AS n, lag(t) OVER w AS p, y0 - lag(y0 + 12) OVER w AS gap, row_number() OVER (PARTITION BY page_id ORDER BY y0 DESC, span_no DESC) AS r, count(*) OVER (PARTITION BY page_id) AS c FROM b WINDOW w AS (PARTITION BY page_id ORDER BY y0, span_no))
 JOIN (SELECT page_id, list_sort(list(g))[count(*) // 2 + 1] AS usual FROM (SELECT page_id, y0 - lag(y0 + 12) OVER (PARTITION BY page_id ORDER BY y0, span_no) AS g FROM b) WHERE g > -50 GROUP BY 1) USING (page_id) WHERE r = 1 AND c >= 2 AND n <= 4 AND regexp_matches(p, '[.!?]$') AND (gap > usual + 3 OR n <= 3)""", ("book_pages",), LINES)
def _(t):
    n, b = F.col("page_number"), F.col("book_id")
    y = n * 14.0 + F.when(b % 3 == 0, n * n).otherwise(0)
    spans = t.book_pages.select(b.alias("page_id"), n.alias("span_no"), F.col("extracted_text").alias("text"), y.alias("y0"), (y + 12).alias("y1"), F.when(b % 4 > 0, "story").otherwise("cover").alias("page_type"), F.lit(False).alias("is_page_number"))
    return L.end_markers(spans)


CAPTIONED = """w AS (SELECT page_id, span_no * 100 + font_size AS unit_id, CASE span_no % 5 WHEN 0 THEN 'Photo: someone' WHEN 1 THEN 'figure 2' WHEN 2 THEN 'small note' WHEN 3 THEN 'A title' ELSE '12' END AS text, font_size, min(x0) AS x0, min(y0) AS y0, min(x1) AS x1, min(y1) AS y1, span_no FROM spans WHERE role <> 'N' GROUP BY ALL),
g AS (SELECT page_id, span_no AS image_no, min(x0) AS ix0, min(y0) AS iy0, min(x1) AS ix1, min(y1) AS iy1 FROM spans WHERE role = 'N' GROUP BY ALL),
n AS (SELECT w.page_id, unit_id, arg_min(y0 > iy1, image_no) AS below FROM w JOIN g ON w.page_id = g.page_id AND font_size <= 24 AND x0 < ix1 AND x1 > ix0 AND ((y0 > iy1 AND y0 - iy1 < 30) OR (y1 < iy0 AND iy0 - y1 < 20)) GROUP BY 1, 2)"""


@query("C32_captions", """SELECT page_id, unit_id, kind, CASE rule WHEN 1 THEN CASE WHEN below THEN 'below' ELSE 'above' END WHEN 2 THEN 'inline' ELSE 'bottom' END AS position, CASE rule WHEN 1 THEN CASE WHEN below THEN 0.85 ELSE 0.8 END WHEN 2 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM (SELECT page_id, unit_id, below,
 CASE WHEN below IS NOT NULL THEN 1 WHEN font_size < 12 AND span_no % 5 < 3 THEN 2 WHEN font_size < 12 AND span_no % 5 = 4 THEN 2 WHEN y0 > 450 AND font_size < 16 AND span_no % 5 < 4 THEN 3 END AS rule, CASE WHEN below THEN 'image_caption' WHEN NOT below THEN 'figure_label' WHEN font_size < 12 AND span_no % 5 <> 3
 THEN ['credit', 'figure_label', 'annotation', '', 'annotation'][span_no % 5 + 1] ELSE 'credit' END AS kind FROM w LEFT JOIN n USING (page_id, unit_id)) WHERE rule IS NOT NULL""", ("spans",), CAPTIONED)  # fmt: skip
def _(t):
    box = ("x0", "y0", "x1", "y1")
    texts = F.array(*[F.lit(x) for x in ("Photo: someone", "figure 2", "small note", "A title", "12")])
    rows = t.spans.withColumn("text", texts[(F.col("span_no") % 5).cast("int")]).withColumn("unit_id", F.col("span_no") * 100 + F.col("font_size"))
    units = rows.where("role <> 'N'").groupBy("page_id", "unit_id", "text", "font_size").agg(*[F.min(c).alias(c) for c in box])
    images = rows.where("role = 'N'").groupBy("page_id", F.col("span_no").alias("image_no")).agg(*[F.min(c).alias(c) for c in box])
    return L.captions(units, images, t.spans.select("page_id", F.lit(500.0).alias("height"), F.lit(20.0).alias("body_size")).distinct())


# Islands of the boxes by their left ends.
@query("K26_header_labels", """SELECT page_id, label_no, string_agg(word, ' ' ORDER BY round_even(y0 / 4, 0), x0, span_no) AS label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY x0, y0, span_no)::INT AS label_no FROM
 (SELECT *, CASE WHEN (x0 + x1) / 2 > max(x1) OVER (PARTITION BY page_id ORDER BY x0, y0, span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 AND x0 > lag((x0 + x1) / 2) OVER (PARTITION BY page_id ORDER BY x0, y0, span_no) THEN 1
 WHEN row_number() OVER (PARTITION BY page_id ORDER BY x0, y0, span_no) = 1 THEN 1 ELSE 0 END AS n FROM (SELECT page_id, span_no, 'w' || span_no AS word, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM spans))) GROUP BY 1, 2""", ("spans",))  # fmt: skip
def _(t):
    return L.header_labels(t.spans.withColumn("text", F.concat(F.lit(" w"), F.col("span_no").cast("string"))))


@query("K26_header_cells")
def _(t):
    n, boxes = F.col("span_no"), L.spread(t.spans, "page_id")
    columns = L.column_bounds(boxes, dealt=True).select("page_id", "column", F.col("left").alias("c0"), F.col("right").alias("c1"))
    bands = boxes.groupBy("page_id").agg(F.min("y0").alias("y0"), (F.min("y0") + 20).alias("y1"))
    top = F.min("y0").over(Window.partitionBy("page_id"))
    lines = boxes.select("page_id", F.col("x0").alias("x"), top.alias("y0"), n).where(n % 2 == 0).select("page_id", "x", "y0", (F.col("y0") + F.when(n % 4 == 0, 30).otherwise(10)).alias("y1"))
    # boxes of one number are headers together
    headed = L.with_header(words(boxes)).withColumn("is_header", F.max("is_header").over(Window.partitionBy("page_id", "span_no")))
    return L.header_cells(columns, bands, lines, headed.where("is_header"))
