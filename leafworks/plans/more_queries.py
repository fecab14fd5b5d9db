"""Further reconciliation, gate and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import gates as G
from leafworks.operators import layout as L
from leafworks.operators import reconcile as R

from .gate_queries import MERGED
from .layout_queries import CLUSTERS, PAGES, family_pages
from .registry import query

UNITS = "u AS (SELECT book_id * 100 + page_number AS unit_id, source_text, translated_text, book_id, page_number FROM translation_pairs)"


def units(t):
    return t.translation_pairs.withColumn("unit_id", F.col("book_id") * 100 + F.col("page_number"))


@query("D6_region_targets", "SELECT unit_id AS region_id, CASE WHEN unit_id % 5 = 1 THEN 'o' ELSE nullif(trim(translated_text), '') END AS target, CASE WHEN unit_id % 5 <> 1 AND nullif(trim(translated_text), '') IS NULL THEN 'MISSING_TARGET' END AS issue FROM u WHERE unit_id % 4 <> 0", ("translation_pairs",), UNITS)
def _(t):
    rows = units(t).select(F.col("unit_id").alias("region_id"), F.col("translated_text").alias("target"), F.when(F.col("unit_id") % 4 == 0, "preserve").otherwise("translate").alias("policy"))
    o = rows.where("region_id % 5 = 1").select("region_id", F.lit(" o ").alias("text"))
    return R.region_targets(rows, o, rows.where("false").select("region_id", F.lit("").alias("text")))


@query("D8_score_flags", """SELECT book_id, page_number, score, CASE WHEN score >= 8 THEN 'green' WHEN score >= 6 THEN 'yellow' ELSE 'red' END AS flag, score < 7 AND k = 0 AS refine FROM
 (SELECT book_id, page_number, CASE page_number % 5 WHEN 1 THEN 9.0 WHEN 2 THEN 7.5 ELSE length(source_text) % 11 END::DOUBLE AS score, CASE WHEN page_number % 5 IN (1, 2) THEN 1 ELSE 0 END AS k FROM u)""", ("translation_pairs",), UNITS)  # fmt: skip
def _(t):
    kind = F.when(F.col("page_number") % 5 == 1, "copyright").when(F.col("page_number") % 5 == 2, "vocabulary").otherwise("story")
    return R.score_flags(t.translation_pairs.select("book_id", "page_number", kind.alias("page_type"), (F.length("source_text") % 11).cast("double").alias("raw_score")))


@query("D12_canonical_variants", """SELECT source, canonical, pages FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pages DESC, f) AS r FROM (SELECT source, trim(regexp_replace(lower(line), '[ \\t]+', ' ', 'g')) AS n, count(*) AS pages, min(k) AS f, arg_min(line, k) AS canonical
 FROM (SELECT source, extracted_text AS line, book_id * 1000 + page_number AS k FROM book_pages JOIN documents ON doc_id = book_id WHERE length(extracted_text) > 20) GROUP BY 1, 2)) WHERE r = 1""", ("book_pages",))  # fmt: skip
def _(t):
    lines = t.book_pages.where("length(extracted_text) > 20").join(t.documents.select(F.col("doc_id").alias("book_id"), "source"), "book_id")
    return R.canonical_variants(lines.withColumn("k", F.col("book_id") * 1000 + F.col("page_number")), "source", "extracted_text", "k")


@query("D16_document_match", r"""SELECT conv_id, expected, found, round_even(CASE WHEN expected > 0 THEN found / expected::DOUBLE ELSE s::INT END, 3) AS match_rate, s AS searchable, NOT bad AS encoding_ok, reason IS NULL AS passed, reason FROM
 (SELECT *, CASE WHEN NOT s THEN 'no_text_layer' WHEN bad THEN 'garbled' WHEN expected > 0 AND found < 0.6 * expected THEN 'low_match' END AS reason FROM
 (SELECT conv_id, count(DISTINCT a.w) AS expected, count(DISTINCT b.w) AS found FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{3,}'))) AS w FROM conversations WHERE role = 'user') a USING (conv_id)
  LEFT JOIN (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{3,}'))) AS w FROM conversations WHERE role = 'assistant' AND conv_id % 10 <> 3) b ON b.conv_id = a.conv_id AND b.w = a.w GROUP BY 1)
 JOIN (SELECT conv_id, coalesce(bool_or(trim(text) <> '') FILTER (role = 'assistant' AND conv_id % 10 <> 3), false) AS s, conv_id % 10 = 7 AND count(*) FILTER (role = 'assistant') > 0 AS bad FROM conversations GROUP BY conv_id) USING (conv_id))""")  # fmt: skip
def _(t):
    # some documents lose their text layer, of some it is garbled
    found = t.conversations.where("role = 'assistant'").withColumn("text", F.when(F.col("conv_id") % 10 == 3, "").when(F.col("conv_id") % 10 == 7, F.concat("text", F.lit("\x01"))).otherwise(F.col("text")))
    return R.document_match(t.conversations.where("role = 'user'").unionByName(t.conversations.where("role <> 'user'").withColumn("text", F.lit(None).cast("string"))), found, "conv_id")


@query("D17_compact_variants", """SELECT count(*) AS total, count(translated_text) AS with_variant, count(*) FILTER (v) AS valid, round_even(100.0::DOUBLE * count(translated_text) / count(*), 1) AS coverage,
 round_even(100.0::DOUBLE * sum(n - m) FILTER (v) / sum(n) FILTER (v), 1) AS savings FROM (SELECT *, coalesce(m < n AND m >= 0.5 * n, false) AS v FROM (SELECT *, length(source_text) AS n, length(translated_text) AS m FROM u))""", ("translation_pairs",), UNITS)  # fmt: skip
def _(t):
    return R.compact_variants(t.translation_pairs)


# Every third term is of another language.
TERMS = "tm AS (SELECT book_id, CASE WHEN page_number % 3 = 0 THEN 'zu' ELSE 'af' END AS language_code, source_text AS source_term, translated_text AS translated_term, 'p' || page_number AS context FROM translation_pairs WHERE translated_text IS NOT NULL)"


def memory(t):
    n = F.col("page_number")
    return t.translation_pairs.where("translated_text IS NOT NULL").select("book_id", F.when(n % 3 == 0, "zu").otherwise("af").alias("language_code"), F.col("source_text").alias("source_term"), F.col("translated_text").alias("translated_term"), F.concat(F.lit("p"), n.cast("string")).alias("context"))


@query("D18_memory_block", "SELECT book_id, language_code, string_agg(source_term || ' = ' || translated_term, chr(10) ORDER BY source_term, translated_term) AS block, count(*) AS terms FROM tm GROUP BY 1, 2", ("translation_pairs",), TERMS)
def _(t):
    return R.memory_block(memory(t)).withColumn("terms", F.size("terms").cast("long"))


@query("D18_memory_lookup", "SELECT a.book_id, a.page_number, a.source_term, min(tm.translated_term) AS translated_term FROM (SELECT book_id, page_number, 'af' AS language_code, source_text AS source_term FROM translation_pairs) a LEFT JOIN tm ON tm.book_id = a.book_id AND tm.language_code = a.language_code AND tm.source_term = a.source_term GROUP BY 1, 2, 3", ("translation_pairs",), TERMS)
def _(t):
    asked = t.translation_pairs.select("book_id", "page_number", F.lit("af").alias("language_code"), F.col("source_text").alias("source_term"))
    return R.memory_lookup(asked, memory(t)).drop("language_code")


@query("D21_page_texts", """SELECT conv_id AS book_id, turn // 2 AS page_number, CASE WHEN conv_id % 2 = 0 THEN string_agg(text, ' ' ORDER BY turn) ELSE string_agg(text, chr(10) ORDER BY turn) END AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2, conv_id % 2""")
def _(t):
    kind = F.when(F.col("conv_id") % 2 == 0, "story").otherwise("other")
    return R.page_texts(t.conversations.select(F.col("conv_id").alias("book_id"), F.expr("turn div 2").alias("page_number"), F.col("turn").alias("reading_order"), "text", kind.alias("page_type")))


@query("D24_cache_split", "SELECT doc_id, h, doc_id % 3 = 0 AS cached FROM (SELECT doc_id, md5(text) AS h FROM documents)")
def _(t):
    now = t.documents.select("doc_id", F.md5("text").alias("h"))
    return R.cache_split(now, now.where("doc_id % 3 = 0"), ["doc_id", "h"])


@query("D24_hit_rate", "SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS hits, count(*) FILTER (doc_id % 3 <> 0) AS misses, round_even(count(*) FILTER (doc_id % 3 = 0) / count(*)::DOUBLE, 3) AS rate FROM documents")
def _(t):
    now = t.documents.select("doc_id", F.md5("text").alias("h"))
    return R.hit_rate(R.cache_split(now, now.where("doc_id % 3 = 0"), ["doc_id", "h"]))


FONTS = "f AS (SELECT DISTINCT 'wide' AS font, c AS char FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents WHERE lang = 'fr') UNION SELECT DISTINCT 'plain', c FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) WHERE ord(c) < 128)"


def fonts(t):
    chars = t.documents.select("lang", F.explode(F.split("text", "")).alias("char")).where("char <> ''")
    wide = chars.where("lang = 'fr'").select(F.lit("wide").alias("font"), "char")
    return wide.unionByName(chars.where(F.ascii("char") < 128).select(F.lit("plain").alias("font"), "char")).distinct()


@query("D28_font_coverage", """SELECT lang, font, required, covered, covered >= 0.95 * required AS suitable FROM (SELECT lang, font, count(*) AS covered FROM n JOIN f USING (char) GROUP BY 1, 2) JOIN (SELECT lang, count(*) AS required FROM n GROUP BY 1) USING (lang)""",
 (), FONTS + ", n AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents)")
def _(t):
    return R.font_coverage(t.documents, fonts(t))


@query("D29_exercise_contracts", """SELECT CASE WHEN i > 0 THEN page_number || ':vocabulary:' || i END AS source_id, book_id, page_number, CASE WHEN i = 0 THEN 'instruction' ELSE 'question' END AS kind, text FROM
 (SELECT doc_id AS book_id, doc_id % 9 AS page_number, unnest(ls) AS text, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents))""")  # fmt: skip
def _(t):
    return R.exercise_contracts(t.documents.select(F.col("doc_id").alias("book_id"), (F.col("doc_id") % 9).alias("page_number"), "text"))


# Reports are written as text, of every third candidate inside another one, of every seventh encoded twice; every eleventh candidate has none.
EDITIONS = f"""{MERGED}, e AS (SELECT candidate_id, CASE WHEN candidate_id % 10 = 3 THEN 'RENDERING' WHEN candidate_id % 10 = 4 THEN 'NEEDS_LANGUAGE_REVIEW' ELSE 'READY_FOR_REVIEW' END AS st, CASE WHEN candidate_id % 13 <> 0 THEN 'f' || candidate_id % 7 ELSE '' END AS fp, candidate_id % 11 <> 0 AS has FROM m GROUP BY 1),
i AS (SELECT e.candidate_id, 'CHECK_UNRESOLVED_OR_STALE:' || r.key AS code FROM e, (VALUES ('structure'), ('fit'), ('target_mapping')) r(key) WHERE fp <> '' AND st = 'READY_FOR_REVIEW' AND NOT (has AND EXISTS (SELECT 1 FROM m WHERE m.candidate_id = e.candidate_id AND check_name = r.key AND status = 'passed'))
 UNION ALL SELECT candidate_id, 'APPROVAL_PENDING_OR_STALE:layout' FROM e WHERE fp <> '' AND st = 'READY_FOR_REVIEW' AND (candidate_id % 5 = 0 OR candidate_id % 6 = 1) UNION ALL SELECT candidate_id, 'INVALID_GATE_INPUT' FROM e WHERE fp = '' AND st = 'READY_FOR_REVIEW' UNION ALL SELECT candidate_id, 'BLOCKING_RENDER_STATE:' || st FROM e WHERE st <> 'READY_FOR_REVIEW')"""


@query("E4_edition_readiness", "SELECT e.candidate_id, count(code) = 0 AS ready, coalesce(string_agg(code, ',' ORDER BY code), '') AS codes FROM e LEFT JOIN i ON i.candidate_id = e.candidate_id GROUP BY 1", ("checks",), EDITIONS)
def _(t):
    id_ = F.col("candidate_id")
    finger, hash_ = F.concat(F.lit("f"), (id_ % 7).cast("string")), F.concat(F.lit("h"), (id_ % 3).cast("string"))
    plain = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("check_name", "status"))).alias("checks")))
    report = F.when(id_ % 3 == 0, F.concat(F.lit('{"publishable":false,"checks":{"fit":"passed"},"qa":'), plain, F.lit("}"))).otherwise(plain)
    report = F.when(id_ % 7 == 0, F.concat(F.lit('"'), F.replace(report, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(report)
    tracks = F.to_json(F.create_map(F.lit("layout"), F.struct((id_ % 5 != 0).alias("approved"), F.when(id_ % 6 != 1, finger).otherwise("old").alias("fingerprint"), hash_.alias("output_sha256"))))
    editions = G.merge_checks(t.checks).groupBy("candidate_id").agg(F.when(id_ % 11 != 0, report).alias("qa_report")).select(
        "candidate_id", "qa_report", F.when(id_ % 10 == 3, "RENDERING").when(id_ % 10 == 4, "NEEDS_LANGUAGE_REVIEW").otherwise("READY_FOR_REVIEW").alias("render_status"), F.when(id_ % 13 != 0, finger).alias("render_fingerprint"),
        hash_.alias("output_sha256"), tracks.alias("approval_tracks"))
    return G.edition_readiness(editions, ("layout",)).withColumn("codes", F.array_join("codes", ","))


@query("E9_flagged_pages", """SELECT edition_id, page_number, s AS status, s <> 'passed' AS flagged FROM (SELECT conv_id AS edition_id, p.turn AS page_number, CASE WHEN conv_id % 9 = 0 THEN 'not_run' ELSE coalesce(r.s, 'not_run') END AS s FROM (SELECT DISTINCT conv_id, turn FROM conversations) p
 LEFT JOIN (SELECT conv_id, turn - turn % 3 AS turn, CASE arg_max(turn, turn) % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'passed' END AS s FROM conversations GROUP BY 1, 2) r USING (conv_id, turn))""")  # fmt: skip
def _(t):
    n, of = F.col("turn"), F.col("conv_id").alias("edition_id")
    records = t.conversations.select(of, (n - n % 3).alias("page_number"), n.alias("seq"), F.when(n % 3 == 1, "failed").otherwise("passed").alias("status"))
    inputs = t.conversations.select(of, (F.col("conv_id") % 9 != 0).alias("complete")).distinct()
    return G.flagged_pages(t.conversations.select(of, n.alias("page_number")), records, inputs)


@query("E15_least_sizes", "SELECT page_id, span_no, greatest(9.0, CASE role WHEN 'A' THEN 12.0 ELSE 0 END, CASE font_name WHEN 'F3' THEN 14.0 ELSE 0 END)::DOUBLE AS least_size FROM spans", ("spans",))
def _(t):
    role = t.spark.createDataFrame([("A", 12.0)], "role string, floor double")
    font = t.spark.createDataFrame([("F3", 14.0)], "font_name string, floor double")
    return G.least_sizes(t.spans, 9.0, [("role", role), ("font_name", font)]).select("page_id", "span_no", "least_size")


@query("E29_contained_lines", """SELECT r.page_id, r.role AS region, count(DISTINCT round_even(s.y0, 0)) AS lines, count(s.page_id) AS boxes, count(*) FILTER (s.x0 < r.x0 - 1 OR s.x1 > r.x1 + 1 OR s.y0 < r.y0 - 1 OR s.y1 > r.y1 + 1) AS clipped, round_even(min(s.x0), 1) AS bx0, round_even(min(s.y0), 1) AS by0, round_even(max(s.x1), 1) AS bx1, round_even(max(s.y1), 1) AS by1
 FROM (SELECT page_id, role, min(x0)::DOUBLE + 5 AS x0, min(y0)::DOUBLE + 200 AS y0, max(x1)::DOUBLE - 40 AS x1, max(y1)::DOUBLE AS y1 FROM spans GROUP BY 1, 2) r LEFT JOIN (SELECT page_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM spans) s ON s.page_id = r.page_id
 AND (s.x0 + s.x1) / 2 BETWEEN r.x0 - 2 AND r.x1 + 2 AND (s.y0 + s.y1) / 2 BETWEEN r.y0 - 2 AND r.y1 + 2 GROUP BY 1, 2""", ("spans",))  # fmt: skip
def _(t):
    boxes = t.spans.select("page_id", "role", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    regions = boxes.groupBy("page_id", F.col("role").alias("region")).agg((F.min("x0") + 5).alias("x0"), (F.min("y0") + 200).alias("y0"), (F.max("x1") - 40).alias("x1"), F.max("y1").alias("y1"))
    return G.contained_lines(boxes, regions)


@query("K12_text_summary", """SELECT page_id, count(*) FILTER (font_size % 5 <> 0) AS spans, coalesce(sum(1 + floor(font_size / 10)) FILTER (font_size % 5 <> 0), 0)::BIGINT AS chars, coalesce(len(list_distinct(list(round_even(font_size + 0.26, 1)) FILTER (font_size % 5 <> 0))), 0) AS sizes, coalesce(round_even(min(font_size + 0.26) FILTER (font_size % 5 <> 0), 1), 0) AS smallest,
 coalesce(array_to_string(list_sort(list_distinct(list(font_name) FILTER (font_size % 5 <> 0))), ','), '') AS fonts, bool_or(font_size % 7 = 3) AS rotated FROM (SELECT page_id, font_size::DOUBLE AS font_size, font_name FROM spans) GROUP BY 1""", ("spans",))  # fmt: skip
def _(t):
    size = F.col("font_size").cast("double")
    text = F.when(size % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.repeat(F.lit("x"), (1 + F.floor(size / 10)).cast("int"))))
    prefix = F.when(F.col("span_no") % 2 == 0, "ABCDEF+").otherwise("")
    return L.text_summary(t.spans.select("page_id", text.alias("text"), (size + 0.26).alias("font_size"), F.concat(prefix, "font_name").alias("font_name"), F.when(size % 7 == 3, 0.9).otherwise(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))).select(
        "page_id", "spans", "chars", F.size("sizes").alias("sizes"), F.coalesce(F.get("sizes", F.lit(0)), F.lit(0.0)).alias("smallest"), F.array_join("fonts", ",").alias("fonts"), "rotated")


IMAGES = "i AS (SELECT l_orderkey AS page_id, l_discount * 8 AS coverage FROM lineitem WHERE l_linenumber < 3)"


def images(t):
    return t.lineitem.where("l_linenumber < 3").select(F.col("l_orderkey").alias("page_id"), (F.col("l_discount").cast("double") * 8).alias("coverage"))


@query("K19_policy_cascade", "SELECT page_id, span_no, CASE WHEN span_no % 4 = 0 THEN 'u' WHEN page_id % 3 = 0 THEN 'l' ELSE 'none' END AS policy, CASE WHEN span_no % 4 = 0 THEN 'unit' WHEN page_id % 3 = 0 THEN 'language' ELSE 'default' END AS decided_by FROM spans", ("spans",))
def _(t):
    rows = t.spans.select("page_id", "span_no", F.when(F.col("span_no") % 4 == 0, "u").alias("unit"), F.when(F.col("page_id") % 3 == 0, "l").alias("language"))
    return L.policy_cascade(rows, ["unit", "language"], "none").drop("unit", "language")


POLICY = ('{"publisher_default":{"body":"F', '","head":""},"roles":{"font_asset_id":"F', '","weight":4},"language_overrides":{"af":{"body":{"font_asset_id":"F', '"},"x":{"size":3}}},"unit_overrides":{"u2":{"font_asset_id":"F', '"},"u1":["F', '"]}}')


@query("K20_requested_families", """SELECT book_id, CASE WHEN book_id % 13 = 0 THEN '' ELSE array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') END AS families FROM (SELECT o_orderkey AS book_id, ['F' || o_orderkey % 4, 'F' || o_orderkey % 5, 'F' || o_orderkey % 3, 'F' || o_orderkey % 7, 'F' || o_orderkey % 2] AS f FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    policy = F.concat(F.lit(POLICY[0]), (k % 4).cast("string"), F.lit(POLICY[1]), (k % 5).cast("string"), F.lit(POLICY[2]), (k % 3).cast("string"), F.lit(POLICY[3]), (k % 7).cast("string"), F.lit(POLICY[4]), (k % 2).cast("string"), F.lit(POLICY[5]))
    return L.requested_families(t.orders.select(k.alias("book_id"), F.when(k % 13 != 0, policy).alias("policy"))).withColumn("families", F.array_join("families", ","))


@query("K23_document_summary", """SELECT p.doc_id, count(*) AS pages, any_value(u.units) AS units, any_value(u.t) AS translate, any_value(u.p) AS preserve, any_value(u.o) AS other, string_agg(page_number || '=' || page_type, ',' ORDER BY page_number) AS page_types, any_value(fam) AS families FROM p
 JOIN (SELECT page_id // 10 AS doc_id, count(*) AS units, count(*) FILTER (role = 'N') AS t, count(*) FILTER (role = 'R') AS p, count(*) FILTER (role NOT IN ('N', 'R')) AS o FROM spans GROUP BY 1) u USING (doc_id)
 LEFT JOIN (SELECT doc_id, string_agg(family || '=' || n, ',' ORDER BY family) AS fam FROM (SELECT doc_id, family, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1) USING (doc_id) GROUP BY 1""", ("spans",), PAGES)  # fmt: skip
def _(t):
    units = t.spans.select(F.expr("page_id div 10").alias("doc_id"), F.when(F.col("role") == "N", "translate").when(F.col("role") == "R", "preserve").otherwise("review").alias("policy"))
    pages = family_pages(t)
    out = L.document_summary(pages, units, L.page_families(pages))
    shown = lambda c, v: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit("="), v(e["value"]))), ",").alias(c)
    return out.select("doc_id", "pages", "units", "translate", "preserve", "other", shown("page_types", lambda x: x), shown("families", lambda x: F.size(x).cast("string")))


@query("K25_artwork_candidates", """SELECT page_id, round_even(a, 3) AS share, coalesce(n, 0)::BIGINT AS chars FROM (SELECT page_id, least(1.0, sum(coverage)) AS a FROM i GROUP BY 1) LEFT JOIN (SELECT page_id, sum(font_size * 5) AS n FROM spans GROUP BY 1) USING (page_id) WHERE a >= 0.25 AND coalesce(n, 0) < 400 AND page_id % 5 <> 2 AND page_id % 7 <> 3""", ("spans",), IMAGES.replace("l_discount * 8", "l_discount::DOUBLE * 8"))
def _(t):
    k = F.col("page_id")
    pages = t.spans.select(k, F.when(k % 5 == 2, "Cover").when(k % 7 == 3, "back_cover").otherwise("story").alias("page_type"))
    return L.artwork_candidates(images(t), t.spans.select("page_id", (F.col("font_size") * 5).alias("chars")), pages)


@query("K27_font_report", "SELECT font_name AS family, font_name IN ('F1', 'F2') AS approved, font_name IN ('F1', 'F2', 'F3') AS resolved FROM (SELECT DISTINCT font_name FROM spans)", ("spans",))
def _(t):
    known = t.spark.createDataFrame([("F1", True), ("F2", True), ("F3", False)], "family string, approved boolean")
    return L.font_report(t.spans.select(F.col("font_name").alias("family")), known)


@query("K27_replacement_fonts", """SELECT unit_id, min(font) FILTER (h = n) AS font FROM (SELECT unit_id, count(*) AS n FROM q GROUP BY 1) LEFT JOIN (SELECT unit_id, font, count(*) AS h FROM q JOIN f USING (char) GROUP BY 1, 2) USING (unit_id) GROUP BY 1""", (),
 FONTS + ", q AS (SELECT DISTINCT doc_id AS unit_id, char FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS char FROM documents))")
def _(t):
    missing = t.documents.select(F.col("doc_id").alias("unit_id"), F.explode(F.array_distinct(F.split("text", ""))).alias("char")).where("char <> ''")
    return L.replacement_fonts(missing, fonts(t))
