"""Reports and ingestion queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafworks.functions.folders import shared_dir
from leafworks.operators import reporting as P
from leafworks.sources import ingest as I
from leafworks.streaming import feeds as S

from .registry import query


@query("P1_translation_cost", "SELECT lang, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 4.0::DOUBLE * 0.9 / 1e6 * 18.5, 6) AS cost FROM documents GROUP BY 1")
def _(t):
    return P.translation_cost(t.documents, "lang", "text")


@query("P1_narration_cost", "SELECT sum(n)::BIGINT AS chars, round(sum(n) / 1000.0::DOUBLE * 0.3 * 18.5, 6) AS cost FROM labels JOIN (SELECT book_id, sum(length(extracted_text)) AS n FROM book_pages GROUP BY 1) ON book_id = doc_id", ("book_pages",))
def _(t):
    return P.narration_cost(t.labels.select(F.col("doc_id").alias("book_id")), t.book_pages)


@query("P3_narration_pages", "SELECT book_id, page_number FROM (SELECT *, max(page_number) OVER (PARTITION BY book_id) AS m FROM book_pages) WHERE page_number BETWEEN 3 AND greatest(3, m - 2)", ("book_pages",))
def _(t):
    return P.page_range(t.book_pages).select("book_id", "page_number")


# Every book is asked for in two languages, one of them its own; every second line is translated.
@query("P3_narration_texts", """SELECT a.book_id, a.l AS language_code, p.page_number, CASE WHEN a.l = b.lang THEN p.extracted_text ELSE 't ' || p.extracted_text END AS text FROM (SELECT doc_id AS book_id, unnest(['en', 'fr']) AS l FROM documents) a JOIN documents b ON b.doc_id = a.book_id
 JOIN (SELECT *, max(page_number) OVER (PARTITION BY book_id) AS m FROM book_pages) p USING (book_id) WHERE page_number BETWEEN 1 + a.book_id % 4 AND CASE WHEN a.book_id % 5 = 0 THEN 6 ELSE greatest(1 + a.book_id % 4, m - 2) END AND CASE WHEN a.l = b.lang THEN extracted_text <> '' ELSE page_number % 2 = 0 END""", ("book_pages",))  # fmt: skip
def _(t):
    k = F.col("doc_id")
    books = t.documents.select(k.alias("book_id"), F.col("lang").alias("original_language"), (1 + k % 4).alias("narration_start_page"), F.when(k % 5 == 0, 6).alias("narration_end_page"))
    asked = t.documents.select(k.alias("book_id"), F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("language_code"))
    translated = t.book_pages.where("page_number % 2 = 0").select("book_id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("language_code"), "page_number", F.concat(F.lit("t "), "extracted_text").alias("translated_text"))
    return P.narration_texts(asked, books, t.book_pages, translated)


AUDIT = "CASE event_type WHEN 'view' THEN 'translation' WHEN 'click' THEN 'render' WHEN 'purchase' THEN 'review' ELSE 'glossary' END"


@query("P4_audit_summary", f"""SELECT book_id, coalesce(array_to_string(list_sort(list_distinct(list(l) FILTER (kind = 'translation'))), ','), '') AS languages, count(*) FILTER (kind = 'translation') AS versions, count(*) FILTER (kind = 'render') AS renders, count(*) FILTER (kind = 'review') AS reviews,
 strftime(max(ts) FILTER (kind = 'render'), '%Y-%m-%d %H:%M:%S') AS last_render, strftime(max(ts) FILTER (kind = 'review'), '%Y-%m-%d %H:%M:%S') AS last_review FROM (SELECT user_id AS book_id, {AUDIT} AS kind, 'l' || event_id % 3 AS l, ts FROM events) GROUP BY 1""")  # fmt: skip
def _(t):
    events = t.events.select(F.col("user_id").alias("book_id"), F.expr(AUDIT).alias("kind"), F.concat(F.lit("l"), (F.col("event_id") % 3).cast("string")).alias("language_code"), "ts")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return P.audit_summary(events).select("book_id", F.array_join("languages", ",").alias("languages"), "versions", "renders", "reviews", shown("last_render"), shown("last_review"))


JOB = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query("P5_job_states", f"""SELECT job_id, status, status IN ('queued', 'processing') AS active, CASE WHEN status IN ('completed', 'failed') THEN (epoch_us(e) - epoch_us(s)) // 1000000 END AS seconds FROM (SELECT job_id, arg_max(status, seq) AS status, arg_max(ts, seq) FILTER (status = 'processing') AS s,
 arg_max(ts, seq) FILTER (status IN ('completed', 'failed')) AS e FROM (SELECT user_id * 10 + event_id % 10 AS job_id, event_id AS seq, {JOB} AS status, ts FROM events) GROUP BY 1)""")  # fmt: skip
def _(t):
    changes = t.events.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("job_id"), F.col("event_id").alias("seq"), F.expr(JOB).alias("status"), "ts")
    return P.job_states(changes).select("job_id", "status", "active", "seconds")


@query("P7_search_terms", """SELECT term, count(*) AS searches, count(*) FILTER (r % 3 = 0) AS without_result, max(day)::VARCHAR AS last_day FROM (SELECT 'k' || json_extract_string(props, '$.k') AS term, event_id % 9 AS r, ts::DATE AS day FROM events WHERE event_type = 'view' AND json_extract_string(props, '$.k') IS NOT NULL) GROUP BY 1""")
def _(t):
    k, r = F.get_json_object("props", "$.k"), F.col("event_id") % 9
    payload = F.to_json(F.struct(F.concat(F.lit(" K"), k).alias("term"), F.when(r % 3 != 0, r).when(r == 3, 0).alias("results")))
    rows = t.events.select(F.when(F.col("event_type") == "view", "search").otherwise("filter").alias("type"), payload.alias("payload"), F.to_date("ts").alias("day"), F.lit(1).alias("count"))
    return P.search_terms(rows).withColumn("last_day", F.col("last_day").cast("string"))


@query("P4_audit_versions", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, substr(md5(props), 1, 12) AS content_hash FROM events")
def _(t):
    return P.audit_versions(t.events, "user_id", "event_id", "props").select("event_id", "user_id", "version", "content_hash")


@query("P5_job_monitor", "SELECT user_id, arg_max(event_type, event_id) AS last_type, count(*) AS events, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM events GROUP BY 1")
def _(t):
    return P.job_monitor(t.events, "user_id")


@query("P6_discovery_rollup", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return P.discovery_rollup(t.events)


@query("P7_payload_report", "SELECT json_extract_string(props, '$.k') AS term, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def _(t):
    return P.payload_report(t.events, "k")


@query("P9_crop_fraction", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN greatest(0, least(0.45, l_discount * 8 - 0.1)) ELSE 0 END::DOUBLE AS crop FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", P.crop_fraction(F.col("l_discount") * 8 - 0.1, F.col("l_linenumber") % 2 == 0).alias("crop"))


@query("A3_targets_by_page", "SELECT conv_id AS doc_id, turn::INTEGER AS page_number, trim(string_agg(text, chr(10) ORDER BY k)) AS text FROM (SELECT conv_id, turn - turn % 2 AS turn, turn AS k, text FROM conversations) GROUP BY 1, 2")
def _(t):
    page = (F.col("turn") - F.col("turn") % 2).cast("int")
    items = F.array_sort(F.collect_list(F.struct("turn", page.alias("page_number"), F.col("text").alias("translation"))))
    made = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.struct(items.alias("items"))).alias("payload"))
    return I.targets_by_page(made)


@query("A5_decoded_report", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def _(t):
    kind = F.col("event_id") % 3
    stored = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.lit("no report"))
    return t.events.select("event_id", F.get_json_object(I.decoded_report(stored), "$.k").alias("k"))


@query("A7_html_lines", r"""SELECT page_id, line, trim(t) AS text FROM (SELECT page_id, generate_subscripts(l, 1)::INTEGER - 1 AS line, unnest(l) AS t FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
 '(?i)</(p|div|h[1-6]|li|tr|title)>|<br */?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS l FROM pages)) WHERE trim(t) <> ''""")
def _(t):
    return I.html_lines(t.pages)


@query("A8_wordlist", r"""SELECT DISTINCT word FROM (SELECT replace(replace(lower(split_part(w, '/', 1)), ' ', ''), '.', '') AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) WHERE regexp_matches(word, '^[\pL''-]{2,}$')""")
def _(t):
    return I.build_wordlist(t.documents.select(F.explode(F.split("text", " ")).alias("line")))


@query("A10_clean_title", "SELECT p_partkey, trim(replace(replace(p_name || '_x', '_', ' '), '  ', ' ')) AS title FROM part")
def _(t):
    return t.part.select("p_partkey", I.clean_title(F.concat("p_name", F.lit("_x"))).alias("title"))


@query("K22_declared_language", """SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang="([^"]+)"', 1), '') AS language FROM pages""")
def _(t):
    return I.declared_language(t.pages)


@query("K22_language_gate", """SELECT page_id, declared, requested, coalesce(lower(declared) = requested, false) AS passed, CASE WHEN NOT coalesce(lower(declared) = requested, false) THEN 'ACCESSIBILITY_LANG_UNSET' END AS code
 FROM (SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang="([^"]+)"', 1), '') AS declared, CASE WHEN page_id % 3 = 0 THEN 'fr' ELSE 'en' END AS requested FROM pages)""")  # fmt: skip
def _(t):
    return I.language_gate(t.pages, t.pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "fr").otherwise("en").alias("language_code")))


def streamed(t, name: str, build, mode: str):
    # a file source reads a folder: the one table's files are picked by name, so the path may be a folder or a file
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    rows = source.parquet(f"{t.sf_dir}/events.parquet*").withColumn("ets", F.col("ts").cast("timestamp"))
    run = uuid.uuid4().hex
    return S.run_once(build(rows), f"{name}_{run}", f"{shared_dir(t.spark)}/stream-{run}", mode)


@query("T1_daily_counts", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return streamed(t, "daily", S.daily_counts, "complete")


@query("T2_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS events FROM events GROUP BY 1")
def _(t):
    return streamed(t, "latest", S.latest_state, "complete")


CHECKS = """SELECT user_id AS candidate_id, CASE event_type WHEN 'view' THEN 'structure' WHEN 'click' THEN 'fit' ELSE 'other' END AS check_name, event_id AS seq, CASE WHEN value < 0.2 THEN 'failed' WHEN value < 1 THEN 'not_run' ELSE 'passed' END AS status FROM {e}"""


@query("T4_merged_checks", f"SELECT candidate_id, check_name, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE arg_max(status, seq) END AS status FROM ({CHECKS.format(e='events')}) GROUP BY 1, 2")
def _(t):
    return streamed(t, "merged", lambda rows: S.merged_checks(t.spark.sql(CHECKS, e=rows)), "complete")


