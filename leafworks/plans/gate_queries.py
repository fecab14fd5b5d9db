"""Quality-gate queries over events, orders and text boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import gates as G

from .registry import query

MERGED = "m AS (SELECT candidate_id, check_name, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE arg_max(status, seq) END AS status FROM checks GROUP BY 1, 2)"
SEVERITY = "CASE check_name WHEN 'structure' THEN 'critical' WHEN 'fit' THEN 'error' WHEN 'visual' THEN 'warning' ELSE 'info' END"
PAIRS = "p AS (SELECT book_id, page_number, translated_text IS NOT NULL AS approved FROM translation_pairs)"


@query("E1_merge_checks", "SELECT * FROM m", ("checks",), MERGED)
def _(t):
    return G.merge_checks(t.checks)


# Issues and artwork flags come with some of the events.
TOLD = "n AS (SELECT user_id AS candidate_id, event_id FROM events WHERE event_type = 'view' AND event_id % 97 = 0), w AS (SELECT user_id AS candidate_id, bool_or(event_id % 89 = 0) AS w FROM events WHERE event_type = 'click' GROUP BY 1)"


@query("E2_publishable", """SELECT candidate_id, coalesce(ok, false) AND n IS NULL AND NOT coalesce(w, false) AS publishable FROM (SELECT candidate_id, NOT bool_or(status = 'failed') AND bool_or(check_name = 'structure' AND status = 'passed') AND bool_or(check_name = 'fit' AND status = 'passed')
 AND bool_or(check_name = 'target_mapping' AND status = 'passed') AS ok FROM m GROUP BY 1) FULL JOIN (SELECT candidate_id, count(*) AS n FROM n GROUP BY 1) USING (candidate_id) FULL JOIN w USING (candidate_id)""", ("checks",), MERGED + ", " + TOLD)  # fmt: skip
def _(t):
    issues = t.events.where("event_type = 'view' AND event_id % 97 = 0").select(F.col("user_id").alias("candidate_id"))
    artwork = t.events.where("event_type = 'click'").select(F.col("user_id").alias("candidate_id"), (F.col("event_id") % 89 == 0).alias("requires_artwork_approval"))
    return G.publishable(G.merge_checks(t.checks), issues, artwork)


@query("E1_merged_reports", """SELECT candidate_id, checks, coalesce(issues, '') AS issues, requires_artwork_approval, NOT failed AND ok AND issues IS NULL AND NOT requires_artwork_approval AS publishable FROM (SELECT candidate_id, string_agg(check_name || '=' || status, ',' ORDER BY check_name) AS checks, bool_or(status = 'failed') AS failed,
 bool_or(check_name = 'structure' AND status = 'passed') AND bool_or(check_name = 'fit' AND status = 'passed') AND bool_or(check_name = 'target_mapping' AND status = 'passed') AS ok FROM m GROUP BY 1)
 JOIN (SELECT user_id AS candidate_id, string_agg('c' || event_id, ',' ORDER BY event_id) FILTER (event_id % 53 = 0) AS issues, bool_or(event_id % 61 = 0) AS requires_artwork_approval FROM events GROUP BY 1) USING (candidate_id)""", ("checks",), MERGED)  # fmt: skip
def _(t):
    seq = F.col("seq")
    none = F.lit(None)
    issue = F.array(F.struct(F.concat(F.lit("c"), seq.cast("string")).alias("code"), F.lit("render").alias("stage"), none.cast("int").alias("page"), none.cast("string").alias("region_id")))
    report = F.struct(F.create_map("check_name", "status").alias("checks"), F.when(seq % 53 == 0, issue).alias("issues"), F.when(seq % 61 == 0, True).alias("requires_artwork_approval"))
    out = G.merged_reports(t.checks.select("candidate_id", "seq", report.alias("report")))
    shown = F.array_join(F.transform(F.map_entries("checks"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.withColumn("checks", shown).withColumn("issues", F.array_join(F.transform("issues", lambda i: i["code"]), ","))


@query("E5_fresh_approvals", """SELECT event_id FROM events e JOIN (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1) c USING (user_id)
 WHERE CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE e.event_id % 4 END IS NOT DISTINCT FROM CASE WHEN c.last % 3 = 0 THEN NULL ELSE c.last % 4 END AND e.event_type IS NOT DISTINCT FROM (SELECT event_type FROM events x WHERE x.event_id = c.last)""")  # fmt: skip
def _(t):
    finger = lambda c: F.when(F.col(c) % 3 != 0, F.col(c) % 4)
    rows = t.events.select(F.col("user_id").alias("candidate_id"), "event_id", finger("event_id").alias("fingerprint"), F.col("event_type").alias("output_hash"))
    now = t.events.groupBy(F.col("user_id").alias("candidate_id")).agg(F.max(F.struct("event_id", "event_type")).alias("l"))
    return G.fresh_approvals(rows, now.select("candidate_id", finger("l.event_id").alias("fingerprint"), F.col("l.event_type").alias("output_hash"))).select("event_id")


@query("E6_approval_progress", """SELECT edition_id, least(k, n) AS approved, n AS total, n > 0 AND k >= n AS complete FROM (SELECT coalesce(a.edition_id, b.edition_id) AS edition_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM (SELECT conv_id AS edition_id, count(*) AS n FROM conversations WHERE role = 'user' AND conv_id % 11 <> 0 GROUP BY 1) a
 FULL JOIN (SELECT conv_id AS edition_id, count(*) FILTER (turn % 5 <> 2 OR conv_id % 3 = 0) AS k FROM conversations GROUP BY 1) b ON a.edition_id = b.edition_id)""")  # fmt: skip
def _(t):
    # approvals of pages that a later rendering no longer has
    pages = t.conversations.where("role = 'user' AND conv_id % 11 <> 0").select(F.col("conv_id").alias("edition_id"), F.col("turn").alias("page_number"))
    return G.approval_progress(pages, t.conversations.select(F.col("conv_id").alias("edition_id"), F.col("turn").alias("page_number"), ((F.col("turn") % 5 != 2) | (F.col("conv_id") % 3 == 0)).alias("approved")))


@query("E10_gate_report", f"""SELECT candidate_id, count(*) AS total, count(*) FILTER (status = 'passed') AS passed_checks, NOT bool_or(status = 'failed' AND s IN ('error', 'critical')) AS passed,
 bool_or(status = 'failed' AND s = 'warning') AS needs_review, round_even(count(*) FILTER (status = 'passed') * 100.0::DOUBLE / count(*), 3) AS score FROM (SELECT *, {SEVERITY} AS s FROM checks) GROUP BY 1""", ("checks",))  # fmt: skip
def _(t):
    return G.gate_report(t.checks, F.expr(SEVERITY))


@query("E11_scorecard", """SELECT o_orderkey, round(((CASE WHEN o_orderstatus <> 'P' THEN 100 ELSE 0 END) + o_totalprice % 100 + (CASE WHEN o_custkey % 2 = 0 THEN 100 ELSE 50 END) + greatest(0, 100 - 10.0 * (o_orderkey % 12))) / 4, 6) AS release_score,
 o_orderstatus = 'P' AS blocked FROM orders""")  # fmt: skip
def _(t):
    out = G.scorecard(t.orders, F.col("o_orderstatus") != "P", F.col("o_totalprice") % 100, F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 12)
    return out.select("o_orderkey", F.round("release_score", 6).alias("release_score"), "blocked")


SCORED = {"extraction": "0.7511 + l_discount * 2", "semantic_role": "0.68 + l_tax", "translation": "1 - l_discount * 2.9837", "font_match": "0.5 + l_quantity / 60", "removal": "1 - l_tax * 2.0137", "layout_fit": "NULL", "visual_similarity": "1 - l_discount * l_tax * 40"}
LIMITS = {"extraction": 0.8, "semantic_role": 0.7, "translation": 0.8, "font_match": 0.6, "removal": 0.9, "layout_fit": 0.85, "visual_similarity": 0.8}
WEIGHTS = {"extraction": 0.1, "semantic_role": 0.1, "translation": 0.25, "font_match": 0.1, "removal": 0.15, "layout_fit": 0.15, "visual_similarity": 0.15}


@query("E12_confidence", f"""SELECT l_orderkey, l_linenumber, round_even(({' + '.join(f'coalesce({k}, 1) * {w}::DOUBLE' for k, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())}::DOUBLE, 3) AS overall, {' || '.join(f"CASE WHEN coalesce({k}, 1) < {LIMITS[k]}::DOUBLE THEN '{k},' ELSE '' END" for k in SCORED)} AS below,
 {' OR '.join(f'coalesce({k}, 1) < {LIMITS[k]}::DOUBLE' for k in SCORED)} AS review_required FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in SCORED.items())} FROM (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_quantity::DOUBLE AS l_quantity FROM lineitem))""")  # fmt: skip
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_discount", "l_tax", "l_quantity")])
    rows = lines.select("l_orderkey", "l_linenumber", *[F.expr(f"cast({v} AS double)").alias(k) for k, v in SCORED.items()])
    return G.confidence(rows).select("l_orderkey", "l_linenumber", "overall", F.array_join(F.transform(F.map_keys("below"), lambda k: F.concat(k, F.lit(","))), "").alias("below"), "review_required")


@query("E13_regressions", """SELECT book_id, run_id, coalesce(render_time_sec > 1.5 * a, false) AS slower, coalesce(coverage_pct < b - 5, false) AS less_covered, coalesce(abs(file_size_kb - c) > 0.2 * c, false) AS resized
 FROM (SELECT *, avg(render_time_sec) OVER w AS a, avg(coverage_pct) OVER w AS b, avg(file_size_kb) OVER w AS c FROM runs WINDOW w AS (PARTITION BY book_id ORDER BY ts, run_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""", ("runs",))  # fmt: skip
def _(t):
    return G.regressions(t.runs)


@query("E18_overflow", "SELECT page_id, min(span_no) AS span_no FROM spans WHERE x0 < 2 OR y0 < 2 OR x1 > 498 OR y1 > 598 GROUP BY 1", ("spans",))
def _(t):
    return G.overflow(t.spans, 500.0, 600.0)


@query("E19_overprints", """SELECT DISTINCT a.page_id FROM spans a JOIN spans b ON a.page_id = b.page_id AND a.span_no < b.span_no
 WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.5 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.45 * least(a.y1 - a.y0, b.y1 - b.y0)""", ("spans",))  # fmt: skip
def _(t):
    return G.overprints(t.spans)


# Editions are conversations; their reports name pages in one of four forms, some encoded twice.
REVIEWED = """pg AS (SELECT conv_id AS edition_id, turn AS page_number, text AS translated_text, CASE turn % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' END AS quality_flag, CASE turn % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'unreviewed' WHEN 3 THEN 'needs_edit' END AS review_status,
 CASE WHEN turn % 6 <> 5 THEN turn % 10 + conv_id % 3 / 4.0::DOUBLE END AS confidence_score FROM conversations), dv AS (SELECT DISTINCT conv_id AS edition_id, unnest(CASE conv_id % 4 WHEN 0 THEN [2, 5] WHEN 1 THEN [3] WHEN 2 THEN [4, 1] ELSE [] END) AS page_number FROM conversations),
q AS (SELECT pg.* REPLACE (coalesce(quality_flag, 'gray') AS quality_flag, coalesce(review_status, 'unreviewed') AS review_status), dv.edition_id IS NOT NULL AS has_deviation FROM pg LEFT JOIN dv ON dv.edition_id = pg.edition_id AND dv.page_number = pg.page_number)"""


def reviewed(t):
    n = F.col("turn")
    flags = F.when(n % 4 == 0, "green").when(n % 4 == 1, "yellow").when(n % 4 == 2, "red")
    status = F.when(n % 5 == 0, "approved").when(n % 5 == 1, "rejected").when(n % 5 == 2, "unreviewed").when(n % 5 == 3, "needs_edit")
    return t.conversations.select(F.col("conv_id").alias("edition_id"), n.alias("page_number"), F.col("text").alias("translated_text"), flags.alias("quality_flag"), status.alias("review_status"), F.when(n % 6 != 5, n % 10 + F.col("conv_id") % 3 / 4.0).alias("confidence_score"))


def reports(t):
    k = F.col("conv_id") % 4
    text = F.when(k == 0, '{"structureDeviations":[2,5,0]}').when(k == 1, '"{\\"structureDeviations\\":null,\\"review_pages\\":{\\"3\\":\\"why\\"}}"').when(k == 2, '{"structureDeviations":{"a":"4x","b":1}}').otherwise('{"review_pages":[]}')
    return t.conversations.select("conv_id").distinct().select(F.col("conv_id").alias("edition_id"), text.alias("qa_report"))


@query("E24_review_queue", "SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY page_number)::INT AS place FROM q WHERE quality_flag IN ('yellow', 'red')", (), REVIEWED)
def _(t):
    return G.review_queue(reviewed(t), reports(t), "flagged")


@query("E24_review_queue_all", "SELECT *, row_number() OVER (PARTITION BY edition_id ORDER BY page_number)::INT AS place FROM q", (), REVIEWED)
def _(t):
    return G.review_queue(reviewed(t), reports(t))


@query("E25_reviewer_list", "SELECT pg.*, coalesce(extracted_text, '') AS original_text FROM pg LEFT JOIN book_pages b ON b.book_id = pg.edition_id AND b.page_number = pg.page_number WHERE review_status = 'needs_edit'", ("book_pages",), REVIEWED)
def _(t):
    pages = reviewed(t)
    return G.reviewer_list(pages, t.book_pages, pages.select("edition_id", F.col("edition_id").alias("book_id")).distinct(), "needs_edit")


@query("E25_review_stats", "SELECT edition_id, count(*) AS total, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'unreviewed') AS unreviewed, count(*) FILTER (review_status = 'needs_edit') AS needs_edit, round(coalesce(avg(confidence_score), 0), 1) AS avg_score FROM pg GROUP BY 1", (), REVIEWED)
def _(t):
    return G.review_stats(reviewed(t))


@query("E26_review_status", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(t):
    return G.status_by_events(t.events, "user_id", "event_id", "event_type")


# Approvals and edits of an edition are events: the track and the kind of edit come from the event's number.
EDITED = """a AS (SELECT user_id AS edition_id, ['page', 'layout', 'artwork', 'language', 'narration'][event_id % 5 + 1] AS track, CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS page_number, event_id AS given_at FROM events WHERE event_type IN ('signup', 'purchase')),
d AS (SELECT user_id AS edition_id, event_id % 3 AS page_number, event_id % 4 AS kind, event_id AS edited_at FROM events WHERE event_type = 'click')"""


@query("E27_invalidated", """SELECT edition_id, track, page_number, given_at, EXISTS (SELECT 1 FROM d WHERE d.edition_id = a.edition_id AND edited_at > given_at AND CASE track WHEN 'page' THEN kind = 0 AND d.page_number = a.page_number WHEN 'narration' THEN kind IN (0, 1) WHEN 'language' THEN kind = 1 ELSE kind IN (1, 2) END) AS stale FROM a""", (), EDITED)
def _(t):
    n = F.col("event_id")
    track = F.element_at(F.array(*[F.lit(x) for x in ("page", "layout", "artwork", "language", "narration")]), (n % 5 + 1).cast("int"))
    approvals = t.events.where("event_type IN ('signup', 'purchase')").select(F.col("user_id").alias("edition_id"), track.alias("track"), F.when(n % 5 == 0, n % 3).alias("page_number"), n.alias("given_at"))
    fields = F.when(n % 4 == 1, F.array(F.lit("translation"), F.lit("container"))).when(n % 4 == 2, F.array(F.lit("font_role"))).when(n % 4 == 3, F.array(F.lit("colour")))
    return G.invalidated(approvals, t.events.where("event_type = 'click'").select(F.col("user_id").alias("edition_id"), (n % 3).alias("page_number"), fields.alias("fields"), n.alias("edited_at")))
