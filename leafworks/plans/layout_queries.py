"""Layout queries over text boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import layout as L

from .registry import query

CLUSTERS = """v AS (SELECT DISTINCT page_id, round_even(y0, 1) AS v FROM spans), g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY page_id ORDER BY v) <= 12 THEN 0 ELSE 1 END AS n FROM v),
k AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM g), c AS (SELECT page_id, cluster, avg(v) AS centre, count(*) AS n FROM k GROUP BY 1, 2)"""


@query("K1_clusters", "SELECT page_id, cluster::BIGINT AS cluster, round(centre, 6) AS centre, n FROM c", ("spans",), CLUSTERS)
def _(t):
    return L.clusters(t.spans, "page_id", "y0", 12.0).withColumn("centre", F.round("centre", 6))


@query("K2_upper_median", "SELECT page_id, list_sort(list(y0))[count(*) // 2 + 1] AS median FROM spans GROUP BY 1", ("spans",))
def _(t):
    return L.upper_median(t.spans, "page_id", "y0")


@query("K3_nearest_centre", "SELECT DISTINCT page_id, span_no, first_value(cluster) OVER (PARTITION BY page_id, span_no ORDER BY abs(y0 - centre), cluster)::BIGINT AS cluster FROM spans JOIN c USING (page_id)", ("spans",), CLUSTERS)
def _(t):
    return L.nearest_centre(t.spans, L.clusters(t.spans, "page_id", "y0", 12.0), "page_id", "y0")


# A document has ten pages of boxes; the type of a page is cover, story_page or its role; a page's styles are its fonts.
PAGES = """p AS (SELECT page_id // 10 AS doc_id, page_id AS page_number, CASE WHEN max(role) = 'R' THEN 'story_page' ELSE max(role) END AS page_type, count(*) AS regions, max(font_size) > 30 AS has_images FROM spans GROUP BY page_id),
g AS (SELECT doc_id, page_type, regions, has_images, 'family-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY min(page_number), page_type, regions, has_images) - 1)::VARCHAR, 2, '0') || '-' || split_part(page_type, '_', 1) AS family FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
f AS (SELECT doc_id, page_number, family FROM p JOIN g USING (doc_id, page_type, regions, has_images))"""
STYLED = """s AS (SELECT page_id // 10 AS doc_id, page_id AS page_number, font_name AS style_id, round_even(max(font_size) + 0.26, 1) AS size, min(role) AS font, 'c' || min(span_no) AS color, (count(*) * 100)::INT AS weight, min(span_no) % 2 = 0 AS italic FROM spans GROUP BY page_id, font_name),
j AS (SELECT * FROM s JOIN f USING (doc_id, page_number)), n AS (SELECT doc_id, family, style_id, count(*) AS samples, arg_min(italic, page_number) AS italic FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
BEST = lambda c: f"(SELECT doc_id, family, style_id, arg_min({c}, (-k * 1000000000 + f)) AS {c} FROM (SELECT doc_id, family, style_id, {c}, count(*) AS k, min(page_number) AS f FROM j GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"


def family_pages(t):
    kind = F.when(F.max("role") == "R", "story_page").otherwise(F.max("role"))
    return t.spans.groupBy((F.expr("page_id div 10")).alias("doc_id"), F.col("page_id").alias("page_number")).agg(kind.alias("page_type"), F.count("*").alias("regions"), (F.max("font_size") > 30).alias("has_images"))


@query("K6_page_families", "SELECT * FROM f", ("spans",), PAGES)
def _(t):
    return L.page_families(family_pages(t))


@query("K7_style_families", f"SELECT * FROM n JOIN {BEST('size')} USING (doc_id, family, style_id) JOIN {BEST('font')} USING (doc_id, family, style_id) JOIN {BEST('color')} USING (doc_id, family, style_id) JOIN {BEST('weight')} USING (doc_id, family, style_id)", ("spans",), PAGES + ", " + STYLED)
def _(t):
    page = t.spans.groupBy(F.expr("page_id div 10").alias("doc_id"), F.col("page_id").alias("page_number"), F.col("font_name").alias("style_id"))
    styles = page.agg((F.max("font_size") + 0.26).alias("size"), F.min("role").alias("font"), F.concat(F.lit("c"), F.min("span_no").cast("string")).alias("color"), (F.count("*") * 100).cast("int").alias("weight"), (F.min("span_no") % 2 == 0).alias("italic"))
    return L.style_families(styles, L.page_families(family_pages(t)))


@query("K7_style_mode", """SELECT role, font_size, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY role) AS a FROM
 (SELECT role, font_size, count(*) AS n, min(page_id * 10 + span_no) AS f FROM spans GROUP BY 1, 2)) WHERE r = 1 AND a > 1""", ("spans",))  # fmt: skip
def _(t):
    return L.style_mode(t.spans.withColumn("seen", F.col("page_id") * 10 + F.col("span_no")), "role", "font_size", "seen")


@query("K8_consensus_box", "SELECT page_id, role, min(x0) - 2 AS x0, min(y0) - 2 AS y0, max(x1) + 2 AS x1, max(y1) + 2 AS y1, count(*) AS n FROM spans GROUP BY 1, 2 HAVING count(*) >= 2", ("spans",))
def _(t):
    return L.consensus_box(t.spans, ["page_id", "role"], 2.0)


@query("K8_consensus_containers", """SELECT page_id AS page_number, span_no AS region_id, CASE WHEN own THEN x0 ELSE ux END AS x0, CASE WHEN own THEN y1 ELSE uy END AS y1, CASE WHEN own THEN 'own' WHEN ux IS NOT NULL THEN 'page_family' END AS container_source FROM (SELECT page_id, span_no, role, x0::DOUBLE AS x0, y1::DOUBLE AS y1, span_no % 5 = 0 AS own, f.doc_id, f.family FROM spans LEFT JOIN f ON page_number = page_id)
 LEFT JOIN (SELECT f.doc_id, f.family, role, min(x0)::DOUBLE - 10 AS ux, max(y1)::DOUBLE + 10 AS uy FROM spans JOIN f ON page_number = page_id WHERE span_no % 3 <> 1 GROUP BY 1, 2, 3 HAVING count(*) >= 2) USING (doc_id, family, role)""", ("spans",), PAGES)  # fmt: skip
def _(t):
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    n = F.col("span_no")
    regions = t.spans.select(F.expr("page_id div 10").alias("doc_id"), F.col("page_id").alias("page_number"), n.alias("region_id"), F.col("role").alias("region_type"), F.when(n % 3 != 1, box).alias("box"), F.when(n % 5 == 0, box).alias("container"))
    out = L.consensus_containers(regions, L.page_families(family_pages(t)))
    return out.select("page_number", "region_id", "container.x0", "container.y1", "container_source")


@query("K15_reading_order", "SELECT page_id, span_no, row_number() OVER (PARTITION BY page_id ORDER BY font_size <= 20, y0, x0, span_no) AS place FROM spans", ("spans",))
def _(t):
    return L.reading_order(t.spans)


@query("K16_not_owned", """SELECT page_id, span_no FROM spans WHERE role <> 'R' AND (page_id, span_no) NOT IN (SELECT (s.page_id, s.span_no) FROM spans s JOIN spans o ON o.page_id = s.page_id AND o.role = 'R' AND s.role <> 'R' AND
 greatest(least(s.x1, o.x1) - greatest(s.x0, o.x0), 0) * greatest(least(s.y1, o.y1) - greatest(s.y0, o.y0), 0) > 0.5 * least((s.x1 - s.x0) * (s.y1 - s.y0), (o.x1 - o.x0) * (o.y1 - o.y0)))""", ("spans",))  # fmt: skip
def _(t):
    return L.not_owned(t.spans.where("role <> 'R'"), t.spans.where("role = 'R'")).select("page_id", "span_no")


