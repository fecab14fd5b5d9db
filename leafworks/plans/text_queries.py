"""Text-signal and reconciliation queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.functions import text as X
from leafworks.operators import reconcile as R
from leafworks.operators import textsig as T

from .registry import query

N = "len(regexp_extract_all(coalesce(extracted_text, ''), '[^ \\t\\n\\r\\x0B\\f]+'))"
WORDED = f"w AS (SELECT book_id, page_number, extracted_text, {N} AS n FROM book_pages)"
SIGNALS = f"""{WORDED}, s AS (SELECT book_id, count(*) AS pages, round(coalesce(avg(n) FILTER (n > 0), 0)::DOUBLE, 1) AS words_per_page, round(avg(CASE WHEN n <= 12 THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS image_share FROM w GROUP BY 1)"""


@query("C1_page_words", "SELECT book_id, page_number, n FROM w", ("book_pages",), WORDED)
def _(t):
    return t.book_pages.select("book_id", "page_number", X.word_count(F.col("extracted_text")).alias("n"))


@query("C2_C3_book_signals", "SELECT * FROM s", ("book_pages",), SIGNALS)
def _(t):
    return T.book_signals(t.book_pages)


@query("C3_flagged_pages", """SELECT book_id, round(avg(CASE WHEN page_number % 4 = 0 OR n <= 12 THEN 1.0 ELSE 0.0 END)::DOUBLE, 3) AS image_share FROM w GROUP BY 1""", ("book_pages",), WORDED)
def _(t):
    return T.book_signals(t.book_pages.withColumn("is_image_only", F.when(F.col("page_number") % 4 == 0, True))).select("book_id", "image_share")


@query("C9_full_text", "SELECT book_id, substr(string_agg(extracted_text, chr(10) ORDER BY page_number), 1, 4000) AS sample FROM book_pages GROUP BY 1", ("book_pages",))
def _(t):
    return T.full_text(t.book_pages)


@query("C10_scrub", r"""SELECT doc_id, substr(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '', 'g'), '[0-9][0-9 -]{6,}[0-9]', '', 'g'), 1, 300) AS short_text FROM documents""")
def _(t):
    return t.documents.select("doc_id", X.scrub(F.col("text"), 300).alias("short_text"))


@query("C33_encoding_check", r"SELECT doc_id, len(regexp_extract_all(text, '\x{FFFD}')) AS replaced, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS controls, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]')) = 0 AS clean FROM documents")
def _(t):
    return T.encoding_check(t.documents)


ANSWERS = """e AS (SELECT DISTINCT conv_id AS r, turn AS u FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id AS r, CASE WHEN turn % 7 <> 5 THEN turn - turn % 3 END AS u, turn AS seq, trim(CASE WHEN turn % 4 = 0 THEN ' ' ELSE coalesce(text, '') END) = '' AS blank FROM conversations),
g AS (SELECT r, u, count(*) AS n, arg_max(blank, seq) AS last, bool_or(blank) AS blanked FROM a WHERE u IS NOT NULL GROUP BY 1, 2),
b AS (SELECT coalesce(e.r, g.r) AS request_id, coalesce(e.u, g.u) AS unit_id, e.u IS NOT NULL AS asked, n, last, blanked FROM e FULL JOIN g ON e.r = g.r AND e.u = g.u),
p AS (SELECT request_id, unit_id, 'missing' AS problem, 'error' AS level FROM b WHERE n IS NULL UNION ALL SELECT request_id, unit_id, 'extra', 'error' FROM b WHERE NOT asked
 UNION ALL SELECT request_id, unit_id, 'duplicate', 'error' FROM b WHERE n > 1 UNION ALL SELECT request_id, unit_id, 'empty', 'warning' FROM b WHERE asked AND last
 UNION ALL SELECT r, NULL, 'no_id', 'error' FROM a WHERE u IS NULL),
w AS (SELECT request_id, unit_id, problem, CASE problem WHEN 'extra' THEN 'warning' ELSE level END AS level FROM p WHERE problem <> 'empty' UNION ALL SELECT request_id, unit_id, 'empty', 'warning' FROM b WHERE blanked)"""


def answers(t):
    unit = F.when(F.col("turn") % 7 != 5, F.col("turn") - F.col("turn") % 3).alias("unit_id")
    expected = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("unit_id"))
    return expected, t.conversations.select(F.col("conv_id").alias("request_id"), unit, F.col("turn").alias("seq"), F.when(F.col("turn") % 4 == 0, " ").otherwise(F.col("text")).alias("text"))


@query("D2_response_errors", "SELECT * FROM p", (), ANSWERS)
def _(t):
    return R.response_errors(*answers(t))


@query("D2_request_warnings", "SELECT * FROM w", (), ANSWERS)
def _(t):
    return R.response_errors(*answers(t), extra_is_error=False)


@query("D2_response_verdicts", """SELECT r AS request_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'error') = 0 AS valid
 FROM (SELECT DISTINCT r FROM e) LEFT JOIN p ON request_id = r GROUP BY 1""", (), ANSWERS)  # fmt: skip
def _(t):
    expected, received = answers(t)
    return R.response_verdicts(expected, R.response_errors(expected, received))


# An edition a document; its pages hold five lines each, every fourth of them without translated text; the translation lacks a line of most pages; pages where it is blank are there too.
CONTRACTS = """k AS (SELECT book_id AS edition_id, book_id * 1000 + page_number AS unit_id, (page_number - 1) // 5 AS page_number, -page_number AS reading_order, extracted_text AS source_text, page_number AS no FROM book_pages WHERE page_number < 1000),
g AS (SELECT edition_id, page_number, CASE WHEN page_number % 5 = 4 THEN ' ' ELSE coalesce(string_agg(' t ' || source_text || chr(13), chr(10) ORDER BY no) FILTER (no % 3 <> 1 OR edition_id % 2 = 0), '') END AS text FROM k WHERE page_number % 4 <> 3 GROUP BY 1, 2),
c AS (SELECT k.*, row_number() OVER (PARTITION BY edition_id, page_number ORDER BY reading_order, unit_id) - 1 AS slot, count(*) OVER (PARTITION BY edition_id, page_number) AS n FROM k),
f AS (SELECT c.*, g.text, list_filter(list_transform(string_split(replace(replace(g.text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM c LEFT JOIN g USING (edition_id, page_number)),
h AS (SELECT *, CASE WHEN coalesce(len(ls), 0) = 0 OR (n = 1 AND len(ls) <> 1) THEN NULL WHEN len(ls) <= n THEN coalesce(ls[slot + 1], '')
 ELSE array_to_string(CASE WHEN slot = n - 1 THEN ls[slot * ceil(len(ls) / n)::INT + 1 :] ELSE ls[slot * ceil(len(ls) / n)::INT + 1 : (slot + 1) * ceil(len(ls) / n)::INT] END, chr(10)) END AS seg FROM f),
z AS (SELECT edition_id, unit_id, CASE WHEN unit_id % 11 = 0 THEN 'override' WHEN unit_id % 7 = 0 THEN 'item' WHEN seg <> '' THEN 'segment' WHEN len(ls) > 0 AND n = 1 THEN 'page' WHEN len(ls) > 0 THEN 'unresolved' ELSE 'source' END AS resolved_by,
 CASE WHEN unit_id % 11 = 0 THEN '' WHEN unit_id % 7 = 0 THEN 'item ' || unit_id WHEN seg <> '' THEN seg WHEN len(ls) > 0 AND n = 1 THEN text WHEN len(ls) > 0 THEN '' ELSE coalesce(source_text, '') END AS target FROM h)"""


def contracts(t):
    no = F.col("page_number")
    units = t.book_pages.where("page_number < 1000").select(F.col("book_id").alias("edition_id"), (F.col("book_id") * 1000 + no).alias("unit_id"), F.expr("(page_number - 1) div 5").alias("page_number"), (-no).alias("reading_order"), F.col("extracted_text").alias("source_text"))
    line = F.when((-F.col("reading_order") % 3 != 1) | (F.col("edition_id") % 2 == 0), F.struct((-F.col("reading_order")).alias("no"), F.concat(F.lit(" t "), F.col("source_text"), F.lit("\r")).alias("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    pages = units.where("page_number % 4 <> 3").groupBy("edition_id", "page_number").agg(F.when(F.col("page_number") % 5 == 4, " ").otherwise(text).alias("text"))
    overrides = units.where("unit_id % 11 = 0").select("edition_id", "unit_id", F.lit("").alias("text"))
    items = units.select("edition_id", "unit_id", F.when(F.col("unit_id") % 7 == 0, F.concat(F.lit("item "), F.col("unit_id").cast("string"))).otherwise(" ").alias("text"))
    return R.resolve_targets(units, pages, overrides, items)


@query("D4_resolve_targets", "SELECT * FROM z", ("book_pages",), CONTRACTS)
def _(t):
    return contracts(t)


@query("D4_unresolved_units", "SELECT edition_id, unit_id FROM z WHERE resolved_by = 'unresolved'", ("book_pages",), CONTRACTS)
def _(t):
    return R.unresolved_units(contracts(t))


@query("D5_segments", """SELECT book_id, i::INT AS slot, CASE WHEN len(ls) <= 4 THEN coalesce(ls[i + 1], '') WHEN i = 3 THEN coalesce(array_to_string(ls[3 * p + 1 :], chr(10)), '') ELSE coalesce(array_to_string(ls[i * p + 1 : (i + 1) * p], chr(10)), '') END AS segment
 FROM (SELECT book_id, ls, ceil(len(ls) / 4.0)::INT AS p, unnest(range(0, 4)) AS i FROM (SELECT doc_id AS book_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents) WHERE len(ls) > 0)""")  # fmt: skip
def _(t):
    return R.segments(t.documents.select(F.col("doc_id").alias("book_id"), "text"), F.lit(4))


@query("D7_page_coverage", """SELECT book_id, count(*) AS requested, count(translated_text) AS translated, round(count(translated_text) / count(*)::DOUBLE * 10, 6) AS score,
 CASE WHEN count(translated_text) / count(*)::DOUBLE >= 0.95 THEN 'green' WHEN count(translated_text) / count(*)::DOUBLE >= 0.7 THEN 'yellow' ELSE 'red' END AS flag FROM translation_pairs GROUP BY 1""", ("translation_pairs",))  # fmt: skip
def _(t):
    return R.page_coverage(t.translation_pairs)


WC = lambda c: f"len(regexp_extract_all(coalesce({c}, ''), '[^ \\t\\n\\r\\x0B\\f]+'))"


# Every tenth target is blank, every ninth source too.
BLANKED = "q AS (SELECT book_id, page_number, CASE WHEN (book_id + page_number) % 9 = 0 THEN ' ' ELSE source_text END AS source_text, CASE WHEN (book_id + page_number) % 10 = 0 THEN '' ELSE translated_text END AS translated_text FROM translation_pairs)"


def blanked(t):
    k = F.col("book_id") + F.col("page_number")
    return t.translation_pairs.select("book_id", "page_number", F.when(k % 9 == 0, " ").otherwise(F.col("source_text")).alias("source_text"), F.when(k % 10 == 0, "").otherwise(F.col("translated_text")).alias("translated_text"))


@query("D9_completeness", f"""SELECT book_id, page_number, CASE WHEN m = 0 THEN 'missing_page' ELSE 'short_page' END AS problem FROM (SELECT *, {WC('source_text')} AS n, {WC('translated_text')} AS m FROM q)
 WHERE n > 0 AND (m = 0 OR (n >= 8 AND m < greatest(3, floor(0.4 * n))))""", ("translation_pairs",), BLANKED)  # fmt: skip
def _(t):
    return R.completeness(blanked(t))


@query("D15_text_match", """SELECT book_id, page_number, len(a) AS expected, len(list_intersect(a, b)) AS found, round_even(CASE WHEN len(a) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 3) AS match_rate, length(translated_text) > 0 AS searchable,
 array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x)))[1:10], ',') AS missing_sample, CASE WHEN len(a) = 0 THEN true ELSE len(list_intersect(a, b)) / len(a)::DOUBLE > 0.5 END AS passed
 FROM (SELECT *, list_distinct(list_transform(regexp_extract_all(source_text, '[\\p{L}\\p{N}_]{3,}'), lambda x: lower(x))) AS a, list_distinct(list_transform(regexp_extract_all(translated_text, '[\\p{L}\\p{N}_]{3,}'), lambda x: lower(x))) AS b
 FROM q WHERE translated_text IS NOT NULL AND trim(coalesce(source_text, '')) <> '')""", ("translation_pairs",), BLANKED)  # fmt: skip
def _(t):
    return R.text_match(blanked(t)).withColumn("missing_sample", F.array_join("missing_sample", ","))


# Every fifth page is blank.
STORY = "y AS (SELECT book_id, page_number, CASE WHEN page_number % 5 = 2 THEN ' ' ELSE extracted_text END AS t FROM book_pages), x AS (SELECT *, count(*) FILTER (trim(t) <> '') OVER (PARTITION BY book_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM y)"


@query("D20_previous_context", """SELECT a.book_id, a.page_number, coalesce(string_agg('[Previous page]: ' || substr(trim(b.t), 1, 200) || chr(10), '' ORDER BY b.page_number), '(This is near the beginning of the book)') AS context
 FROM x a LEFT JOIN x b ON a.book_id = b.book_id AND trim(b.t) <> '' AND b.page_number < a.page_number AND b.k >= a.k - 2 GROUP BY 1, 2""", ("book_pages",), STORY)  # fmt: skip
def _(t):
    return R.previous_context(t.book_pages.withColumn("extracted_text", F.when(F.col("page_number") % 5 == 2, " ").otherwise(F.col("extracted_text"))))


@query("D22_latest_corrections", "SELECT u.event_id AS unit_id, coalesce(c.t, u.event_type) AS text FROM events u LEFT JOIN (SELECT event_id // 7 AS unit_id, arg_max(event_type || event_id, event_id) AS t FROM events WHERE event_type = 'click' GROUP BY 1) c ON u.event_id = c.unit_id")
def _(t):
    fixes = t.events.where("event_type = 'click'").select(F.expr("event_id div 7").alias("unit_id"), F.concat("event_type", F.col("event_id").cast("string")).alias("corrected"), F.col("event_id").alias("seq"))
    return R.latest_corrections(t.events.select(F.col("event_id").alias("unit_id"), F.col("event_type").alias("text")), fixes)


@query("D23_changed_pages", """SELECT doc_id, substr(md5(text), 1, 12) AS page_hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 1""")
def _(t):
    old = t.documents.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return R.changed_pages(t.documents, old, ["doc_id"], "text")


LETTERED = """n AS (SELECT lang AS edition_id, doc_id, char, count(*) AS n FROM (SELECT lang, doc_id, unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents) WHERE char NOT IN (' ', chr(10), chr(9), chr(13)) GROUP BY 1, 2, 3),
m AS (SELECT edition_id, char, ord(char) AS codepoint, sum(n)::BIGINT AS occurrences, count(*) AS docs, list_sort(list(doc_id))[1:10] AS units FROM n WHERE NOT regexp_matches(char, '^[a-zA-Z0-9.,]$') GROUP BY 1, 2)"""


def lettered(t):
    letters = [chr(c) for c in [*range(97, 123), *range(65, 91), *range(48, 58)]] + [".", ","]
    return t.documents.select(F.col("lang").alias("edition_id"), F.col("doc_id").alias("unit_id"), "text"), t.spark.createDataFrame([(c,) for c in letters], "char string")


@query("D27_missing_glyphs", "SELECT * REPLACE (array_to_string(units, ',') AS units) FROM m", (), LETTERED)
def _(t):
    return R.missing_glyphs(*lettered(t)).withColumn("units", F.array_join("units", ","))


@query("D27_glyph_verdicts", """SELECT edition_id, count(*) AS characters, count(*) - count(m) AS covered, count(m) AS missing, any_value(u) AS affected_units, CASE WHEN count(m) = 0 THEN 'ok' WHEN count(m) <= 2 THEN 'warning' ELSE 'critical' END AS severity
 FROM (SELECT DISTINCT edition_id, char, CASE WHEN NOT regexp_matches(char, '^[a-zA-Z0-9.,]$') THEN 1 END AS m FROM n) JOIN (SELECT edition_id, count(DISTINCT u) AS u FROM (SELECT edition_id, unnest(units) AS u FROM m) GROUP BY 1) USING (edition_id) GROUP BY 1""", (), LETTERED)  # fmt: skip
def _(t):
    texts, letters = lettered(t)
    return R.glyph_verdicts(texts, letters, R.missing_glyphs(texts, letters))


@query("A6_upsert_latest", """SELECT coalesce(b.c_custkey, l.k) AS custkey, coalesce(l.price, b.c_acctbal) AS balance FROM customer b FULL JOIN (SELECT o_custkey + 100 AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) l ON b.c_custkey = l.k""")
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    changes = t.orders.select((F.col("o_custkey") + 100).alias("custkey"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return R.upsert_latest(base, changes, ["custkey"], "o_orderkey", ["balance"])
