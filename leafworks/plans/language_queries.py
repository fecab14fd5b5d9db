"""Signals of books and pages, scripts, directions and phonics: queries over documents and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.functions.text import LABELS, RTL, SCRIPTS, SHAPED, ranges
from leafworks.operators import pagetypes as G
from leafworks.operators import phonics as H
from leafworks.operators import scripts as S
from leafworks.operators import textsig as T

from .registry import query
from .text_queries import SIGNALS, WORDED

KIND = "CASE WHEN image_share >= 0.6 AND words_per_page <= 30 THEN 'picture_book' WHEN words_per_page <= 60 AND pages <= 32 THEN 'early_reader' WHEN words_per_page <= 150 THEN 'storybook' ELSE 'chapter_book' END"
SURE = "CASE WHEN image_share >= 0.6 AND words_per_page <= 30 THEN 0.9 WHEN words_per_page <= 60 AND pages <= 32 THEN 0.75 WHEN words_per_page <= 150 THEN 0.7 ELSE 0.65 END::DOUBLE"
LEVELED = r"""r AS (SELECT *, CASE WHEN words > 0 THEN 0.6 * words / sentences + 1.4 * c / words END AS raw FROM (SELECT book_id, sum(n)::BIGINT AS words, greatest(1, sum(len(regexp_extract_all(extracted_text, '[.!?]+'))))::BIGINT AS sentences,
 sum(length(regexp_replace(extracted_text, '[ \t\n\r\x0B\f]+', '', 'g')))::DOUBLE AS c FROM w GROUP BY 1)),
l AS (SELECT *, CASE WHEN words = 0 OR raw < 6 THEN 'pre_reader' WHEN raw < 9 THEN 'beginner' WHEN raw < 12 THEN 'developing' WHEN raw < 16 THEN 'independent' ELSE 'advanced' END AS level,
 CASE WHEN words = 0 THEN 0.6 WHEN raw < 6 THEN 0.7 WHEN raw < 12 THEN 0.75 WHEN raw < 16 THEN 0.7 ELSE 0.65 END::DOUBLE AS level_confidence FROM r)"""
HINTED = f"""{SIGNALS}, {LEVELED}, k AS (SELECT book_id, {KIND} AS book_kind, {SURE} AS kind_confidence, level, level_confidence, level IN ('independent', 'advanced') AS hard FROM s JOIN l USING (book_id)),
h AS (SELECT *, CASE book_kind WHEN 'picture_book' THEN 3 WHEN 'early_reader' THEN 5 WHEN 'storybook' THEN 6 ELSE 9 END + CASE WHEN hard THEN 2 ELSE 0 END AS hint_min,
 CASE book_kind WHEN 'picture_book' THEN 6 WHEN 'early_reader' THEN 8 WHEN 'storybook' THEN 10 ELSE 12 END + CASE WHEN hard THEN 3 ELSE 0 END AS hint_max FROM k)"""
#: Two of the three categories exist: made from the regions' names, so that one kind has none.
SLUGS = "SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN 'early-readers' ELSE 'childrens-fiction' END AS slug FROM region"


def hinted(t):
    typed = T.book_type(T.book_signals(t.book_pages)).join(T.reading_level(t.book_pages), "book_id")
    return T.age_hint(typed)


def slugs(t):
    return t.region.select(F.when(F.col("r_regionkey") % 2 == 0, "early-readers").otherwise("childrens-fiction").alias("slug"))


@query("C4_book_type", f"SELECT *, {KIND} AS book_kind, {SURE} AS kind_confidence FROM s", ("book_pages",), SIGNALS)
def _(t):
    return T.book_type(T.book_signals(t.book_pages))


@query("C5_reading_level", "SELECT book_id, words, sentences, round(raw, 6) AS score, level, level_confidence FROM l", ("book_pages",), f"{WORDED}, {LEVELED}")
def _(t):
    return T.reading_level(t.book_pages)


@query("C6_age_hint", "SELECT book_id, book_kind, level, hint_min, hint_max, 0.5::DOUBLE AS hint_confidence FROM h", ("book_pages",), HINTED)
def _(t):
    return hinted(t).select("book_id", "book_kind", "level", "hint_min", "hint_max", "hint_confidence")


CATEGORY = "CASE book_kind WHEN 'picture_book' THEN 'picture-books' WHEN 'early_reader' THEN 'early-readers' ELSE 'childrens-fiction' END"


@query("C7_suggestions", f"""SELECT book_id, 'book_type' AS field, book_kind AS value, kind_confidence AS confidence, false AS requires_confirmation FROM h UNION ALL SELECT book_id, 'reading_level', level, level_confidence, false FROM h
 UNION ALL SELECT book_id, 'age_range', hint_min || '-' || hint_max, 0.5, true FROM h UNION ALL SELECT book_id, 'primary_category', {CATEGORY}, round(kind_confidence * 0.9, 3), false FROM h WHERE {CATEGORY} IN ({SLUGS})""", ("book_pages",), HINTED)  # fmt: skip
def _(t):
    return T.long_suggestions(hinted(t), slugs(t))


@query("C8_primary_category", f"SELECT book_id, {CATEGORY} AS slug, kind_confidence * 0.9 AS category_confidence FROM h WHERE {CATEGORY} IN ({SLUGS})", ("book_pages",), HINTED)
def _(t):
    return T.primary_category(hinted(t), slugs(t))


COUNT = lambda words: " + ".join(f"CAST(contains(lower(extracted_text), '{w.lower()}') AS INTEGER)" for w in words)
SHORT = lambda text: rf"len(list_filter(list_filter(list_transform(string_split(trim({text}), chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: len(regexp_extract_all(x, '[A-Za-z][A-Za-z''-]*')) <= 2))"
MARKS, VOCAB = ["license", "apache", "all rights", ".com"], ["the the", "ing ", "und"]
TYPED = f"""y AS (SELECT *, CASE WHEN page_number = 1 THEN 'cover' WHEN page_number = max(page_number) OVER (PARTITION BY book_id) THEN 'back_cover'
 WHEN {COUNT(MARKS)} >= 2 THEN 'copyright' WHEN {COUNT(VOCAB)} >= 2 OR {SHORT('extracted_text')} > 20 THEN 'vocabulary' ELSE 'story' END AS page_type FROM book_pages)"""


@query("C11_page_types", "SELECT book_id, page_number, page_type, page_type = 'vocabulary' AS needs_review FROM y", ("book_pages",), TYPED)
def _(t):
    return G.page_types(t.book_pages, MARKS, VOCAB)


@query("C12_C13_document_marks", f"""SELECT doc_id, {COUNT(MARKS).replace('extracted_text', 'text')} >= 2 AS imprint, {COUNT(G.IMPRINT).replace('extracted_text', 'text')} >= 2 AS usual_imprint, {SHORT('text')}::INTEGER AS short_lines,
 {COUNT(G.VOCABULARY).replace('extracted_text', 'text')} >= 2 OR {SHORT('text')} > 20 AS vocabulary FROM documents""")
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", G.is_imprint(text, MARKS).alias("imprint"), G.is_imprint(text).alias("usual_imprint"), G.short_lines(text).alias("short_lines"), G.is_vocabulary(text).alias("vocabulary"))


HEADED = ["(?i)^(the|de|die|el|la) ", "(?i)high frequency"]


@query("C14_header_regions", r"""SELECT doc_id, region, coalesce(max(t) FILTER (head), '') AS heading, CASE WHEN max(t) FILTER (head) IS NULL THEN 'word_list' WHEN contains(lower(max(t) FILTER (head)), 'phonic') THEN 'phonics_exercise' WHEN contains(lower(max(t) FILTER (head)), 'frequency')
 THEN 'high_frequency_words' ELSE 'multi_column_word_list' END AS region_type, array_to_string(list(t ORDER BY i) FILTER (NOT head), chr(10)) AS items, coalesce(contains(lower(max(t) FILTER (head)), 'phonic'), false) AS needs_review FROM (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i)::INTEGER AS region
 FROM (SELECT doc_id, i, t, regexp_matches(t, '(?i)^(the|de|die|el|la) ') OR regexp_matches(t, '(?i)high frequency') AS head FROM (SELECT book_id AS doc_id, page_number AS i, trim(extracted_text) AS t FROM book_pages) WHERE t <> '')) GROUP BY 1, 2 HAVING count(*) FILTER (NOT head) > 0""", ("book_pages",))  # fmt: skip
def _(t):
    lines = t.book_pages.select(F.col("book_id").alias("doc_id"), F.col("page_number").alias("line_no"), F.col("extracted_text").alias("text"))
    return G.vocabulary_regions(lines, HEADED).withColumn("items", F.array_join("items", "\n"))


@query("C15_manifest_types", """SELECT book_id, page_number, CASE WHEN page_number % 3 = 0 THEN g ELSE page_type END AS page_type, CASE WHEN page_number % 3 = 0 THEN g IN ('vocabulary', 'phonics') ELSE page_type = 'vocabulary' END AS needs_review,
 CASE WHEN page_number % 3 = 0 THEN 'scene_graph' ELSE 'heuristic_fallback' END AS source FROM (SELECT *, CASE (book_id + page_number) % 3 WHEN 0 THEN 'phonics' WHEN 1 THEN 'cover' ELSE 'story' END AS g FROM y)""", ("book_pages",), TYPED)  # fmt: skip
def _(t):
    kind = F.col("book_id") + F.col("page_number")
    manifest = t.book_pages.where("page_number % 3 = 0").select("book_id", "page_number", F.when(kind % 3 == 0, "phonics").when(kind % 3 == 1, "cover").alias("page_type"))
    return G.manifest_page_types(t.book_pages, manifest, MARKS, VOCAB)


def doc_spans(t):
    """Lines of documents as boxes: a size and a column by rule."""
    n, b = F.col("page_number"), F.col("book_id")
    return t.book_pages.select(b.alias("page_id"), n.alias("span_no"), F.col("extracted_text").alias("text"), (8 + (n * 11 + b) % 37).alias("font_size"), ((n * n) % 5 * 40).cast("double").alias("x0"), (n % 17 == 0).alias("is_page_number"))


def doc_positions(t):
    return t.documents.select(F.col("doc_id").alias("page_id"), (F.col("doc_id") % 12 + 1).alias("page_number"), F.lit(12).alias("total_pages"))


LISTED = "', '".join(w.replace("'", "''") for w in G.FUNCTION_WORDS)
BOXES = rf"""b AS (SELECT book_id AS page_id, page_number AS span_no, trim(extracted_text) AS t, 8 + (page_number * 11 + book_id) % 37 AS font_size, (page_number * page_number) % 5 * 40.0 AS x0 FROM book_pages WHERE page_number % 17 <> 0),
c AS (SELECT *, len(list_filter(string_split_regex(t, '[ \t\n\r\x0B\f]+'), lambda x: x <> '')) AS n FROM b),
f AS (SELECT page_id, string_agg(t, ' ' ORDER BY span_no) AS joined, count(*) AS n, count(*) FILTER (font_size < 15) AS small, count(*) FILTER (font_size >= 15) AS large, count(*) FILTER (font_size >= 40) AS very_large, count(*) FILTER (n BETWEEN 1 AND 2) / count(*)::DOUBLE AS short_share,
 count(*) FILTER (regexp_matches(t, '[.!?]')) / count(*)::DOUBLE AS end_share, count(DISTINCT round_even(x0 / 24, 0)) AS columns, bool_or(length(t) >= 3 AND n <= 3 AND regexp_matches(t, '\pL') AND NOT regexp_matches(t, '[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]')) AS caps FROM c GROUP BY 1),
w1 AS (SELECT *, list_filter(string_split_regex(joined, '[ \t\n\r\x0B\f]+'), lambda x: x <> '') AS ws, len(regexp_extract_all(joined, '(?:^|\s)\d{{1,2}}\s*[-–—]\s+\S')) >= 2 AS title_list, regexp_matches(joined, '[.!?]') AS ends FROM f),
w2 AS (SELECT *, len(list_filter(list_transform(ws, lambda x: lower(trim(x, '.,!?;:'))), lambda x: x IN ('{LISTED}'))) AS known, list_filter(list_transform(ws[2:], lambda x: trim(x, '.,!?;:''"')), lambda x: length(x) >= 2) AS others FROM w1),
w3 AS (SELECT *, len(list_filter(others, lambda x: regexp_matches(x, '^\p{{Ll}}'))) AS low FROM w2),
w4 AS (SELECT *, len(ws) >= 3 AND NOT title_list AND ((len(ws) >= 8 AND ends) OR (ends AND known > 0) OR (len(ws) >= 4 AND known >= 2) OR (len(others) > 0 AND low >= greatest(2, floor(0.5 * len(others))))) AS prose,
 n >= 12 AND ((short_share >= 0.6 AND columns >= 2 AND end_share <= 0.25) OR (caps AND short_share >= 0.5 AND columns >= 3 AND end_share <= 0.3)) AS word_grid FROM w3),
w5 AS (SELECT doc_id AS page_id, doc_id % 12 + 1 AS pn, coalesce(n, 0) AS n, coalesce(small, 0) AS small, coalesce(large, 0) AS large, coalesce(very_large, 0) AS very_large, coalesce(joined, '') AS joined, coalesce(prose, false) AS prose, coalesce(word_grid, false) AS word_grid,
 coalesce(title_list, false) AS title_list FROM documents LEFT JOIN w4 ON doc_id = page_id)"""
PRINTED = " OR ".join(f"contains(lower(joined), '{m}')" for m in G.SPAN_IMPRINT)


@query("C16_C17_C18_span_page_types", f"""SELECT page_id, CASE WHEN n = 0 THEN 'story' WHEN small > 30 AND large < 5 THEN 'vocabulary' WHEN word_grid THEN 'vocabulary' WHEN pn = 1 AND very_large > 0 AND n <= 6 THEN 'cover' WHEN title_list AND NOT prose THEN 'back_cover' WHEN ({PRINTED}) AND small >= large THEN 'copyright'
 WHEN very_large > 0 AND n <= 6 AND NOT prose THEN 'cover' WHEN small >= 10 AND n > 15 AND NOT prose THEN 'copyright' WHEN prose THEN 'story' WHEN pn = 1 AND very_large > 0 THEN 'cover' WHEN pn >= 12 AND n > 2 THEN 'back_cover' ELSE 'story' END AS page_type,
 prose, word_grid, title_list FROM w5""", ("book_pages",), BOXES)  # fmt: skip
def _(t):
    return G.span_page_types(doc_spans(t), doc_positions(t))


@query("C19_title_entries", """SELECT doc_id, w[1] || ' titles:' AS header, '1 - ' || w[2] || chr(10) || '2 - ' || w[3] || ' ' || w[4] AS entries FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) WHERE len(w) >= 4""")
def _(t):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    made = t.documents.select("doc_id", w.alias("w")).where("size(w) >= 4").select("doc_id", F.expr("w[0] || ' titles:  1 - ' || w[1] || ' 2 – ' || w[2] || ' ' || w[3]").alias("text"))
    return made.select("doc_id", G.title_entries(F.col("text")).alias("e")).select("doc_id", "e.header", F.array_join("e.entries", "\n").alias("entries"))


def counted_sql(source: str, keys: str, classes: dict, usual: str, rest: str) -> str:
    """Every script's characters and place, for all texts alike."""
    known = ranges([r for parts in classes.values() for r in parts])
    plain = f"SELECT {keys}, regexp_replace(coalesce(text, ''), '[\\s\\pP\\x1C-\\x1F\\x{{85}}\\pZ]+', '', 'g') AS plain FROM {source}"
    rows = [f"{{'s': '{k}', 'n': length(plain) - length(regexp_replace(plain, '[{ranges(p)}]+', '', 'g')), 'f': length(regexp_extract(plain, '^[^{ranges(p)}]*'))}}" for k, p in classes.items() if k != rest]
    loose = f"regexp_replace(plain, '[{known}]+', '', 'g')"
    others = f"length(regexp_replace({loose}, '\\PL+', '', 'g'))" if rest == usual else f"length({loose})"
    own = f"length(plain) - length(regexp_replace(plain, '[{ranges(classes[usual])}]+', '', 'g')) + " if rest == usual else ""
    rows.append(f"{{'s': '{rest}', 'n': {own}{others}, 'f': 0}}")
    return f"SELECT {keys}, list_filter([{', '.join(rows)}], lambda x: x.n > 0) AS c FROM ({plain})"


IN = lambda names: "('" + "', '".join(names) + "')"
TOTALS = f"coalesce(list_sum(list_transform(c, lambda x: x.n)), 0)::BIGINT AS letters, coalesce(list_sum(list_transform(c, lambda x: CASE WHEN x.s IN {IN(RTL)} THEN x.n ELSE 0 END)), 0) AS r, coalesce(list_sum(list_transform(c, lambda x: CASE WHEN x.s IN {IN(SHAPED)} THEN x.n ELSE 0 END)), 0) > 0 AS is_complex"
TOP = "coalesce(list_sort(list_transform(c, lambda x: {'n': x.n, 'f': -x.f, 's': x.s}), 'DESC')[1].s, 'Latin')"
BIDI = "r > 0 AND letters > r AND least(r, letters - r) > letters * 0.1"
PROFILE = f"{TOP} AS dominant, letters, list_sort(list_transform(c, lambda x: x.s || '=' || round_even(100.0 * x.n / letters, 1)::DOUBLE)) AS shares, r > letters - r AS is_rtl, {BIDI} AS is_bidi, is_complex, CASE WHEN {BIDI} THEN 'mixed' WHEN r > letters - r THEN 'rtl' ELSE 'ltr' END AS direction"


@query("C20_script_profile", f"SELECT doc_id, {PROFILE.replace('list_sort(list_transform(c, lambda x: x.s', 'array_to_string(list_sort(list_transform(c, lambda x: x.s', 1).replace('::DOUBLE)) AS shares', '::DOUBLE)), chr(44)) AS shares', 1)} FROM (SELECT *, {TOTALS} FROM ({counted_sql('documents', 'doc_id', SCRIPTS, 'Latin', 'Latin')}))")
def _(t):
    shares = F.transform(F.map_entries("shares"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return S.script_profile(t.documents).withColumn("shares", F.array_join(F.array_sort(shares), ","))


C21 = counted_sql("book_pages", "book_id, page_number", SCRIPTS, "Latin", "Latin").replace("coalesce(text, '')", "coalesce(extracted_text, '')")


@query("C21_page_and_book_profile", f"""SELECT book_id, page_number, {PROFILE.split(', list_sort(')[0]}, {PROFILE.split('AS shares, ')[1]} FROM (SELECT *, {TOTALS} FROM (SELECT book_id, page_number, c FROM g UNION ALL SELECT book_id, NULL, list_filter(list_transform(range(0, 1), lambda z: {{'s': 'Latin', 'n': n, 'f': 0}}), lambda x: x.n > 0)
 FROM (SELECT book_id, sum(coalesce(list_sum(list_transform(c, lambda x: x.n)), 0))::BIGINT AS n FROM g GROUP BY 1)))""", ("book_pages",), f"g AS ({C21})")  # fmt: skip
def _(t):
    # the tables' texts are Latin, so the SQL sums that alone; tests hold mixed books
    return S.page_and_book_profile(t.book_pages).drop("shares")


@query("C22_script_label", f"SELECT doc_id, {TOP.replace('Latin', 'Latn')} AS label FROM ({counted_sql('documents', 'doc_id', LABELS, 'Latn', 'Zyyy')})")
def _(t):
    return S.script_label(t.documents)


@query("C23_directional_runs", r"""SELECT doc_id, 'ltr' AS paragraph, 0 AS run_no, 'ltr' AS direction, s::INTEGER AS start_index, length(text)::INTEGER AS end_index, substr(text, s + 1) AS run FROM (SELECT doc_id, text, CASE WHEN regexp_matches(text, '\pL') THEN length(regexp_extract(text, '^\PL*')) ELSE 0 END AS s FROM documents) WHERE text <> ''""")
def _(t):
    return S.directional_runs(t.documents)


WORD = r"(?:[^\pZ\p{Cc}\pP]|[''\x{2019}-])+|(?s:.)"


@query("C24_segments", rf"""SELECT doc_id, len(tk)::INTEGER AS n_tokens, md5(array_to_string(tk, '|')) AS tokens, len(ss)::INTEGER AS n_sentences, md5(array_to_string(ss, '|')) AS sentences, len(gs)::INTEGER AS n_graphemes FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS tk,
 string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss, regexp_extract_all(text, '(?s:.)\pM*') AS gs FROM documents)""")
def _(t):
    return S.segments_of(t.documents).select("doc_id", *[F.size(c).alias(f"n_{c}") for c in ("tokens", "sentences", "graphemes")], *[F.md5(F.array_join(c, "|")).alias(c) for c in ("tokens", "sentences")])


LOOKS = r"""SELECT *, regexp_replace(regexp_replace(t, '^\s*[-–—]\s*', ''), '\s*[-–—]\s*', ' ', 'g') AS norm FROM (SELECT *, trim(extracted_text) AS t FROM book_pages)"""


@query("C25_phonics_lines", rf"""SELECT book_id, page_number, pattern FROM (SELECT *, lower(regexp_extract(norm, '^(\pL{{1,4}})\s+.+$', 1)) AS pattern, list_transform(string_split_regex(lower(regexp_extract(norm, '^\pL{{1,4}}\s+(.+)$', 1)), '[,\s]+'), lambda x: regexp_replace(x, '\PL', '', 'g')) AS ws FROM ({LOOKS}))
 WHERE length(t) <= 60 AND NOT regexp_matches(t, '[.!?]\s') AND pattern <> '' AND len(list_filter(ws, lambda x: x <> pattern AND contains(x, pattern))) > 0""", ("book_pages",))  # fmt: skip
def _(t):
    return H.phonics_lines(t.book_pages)


@query("C26_phonics_problems", r"""SELECT row_id, nullif(pattern, '') AS pattern, len(lacks) = 0 AND len(odd) = 0 AS valid, CASE WHEN len(lacks) > 0 OR len(odd) > 0 THEN concat_ws('; ', CASE WHEN len(lacks) > 0 THEN array_to_string(lacks, ', ') || ' do not contain the pattern "' || pattern || '"' END, CASE WHEN len(odd) > 0 THEN array_to_string(odd, ', ') || ' are not real words' END) END AS problem
 FROM (SELECT row_id, pattern, list_filter(ws, lambda x: NOT contains(x, pattern)) AS lacks, list_filter(ws, lambda x: lang = 'en' AND contains(x, pattern) AND NOT list_contains(known, x)) AS odd
 FROM (SELECT row_id, lang, lower(regexp_extract(t, '^(\S{1,5})\s+.+$', 1)) AS pattern, list_filter(list_transform(string_split_regex(lower(regexp_extract(t, '^\S{1,5}\s+(.+)$', 1)), '[,\s]+'), lambda x: regexp_replace(x, '\PL', '', 'g')), lambda x: x <> '') AS ws
 FROM (SELECT book_id * 1000 + page_number AS row_id, lang, regexp_replace(trim(extracted_text), '^\s*[-–—]\s*', '') AS t FROM book_pages JOIN documents ON doc_id = book_id WHERE length(extracted_text) BETWEEN 3 AND 60)), (SELECT list(DISTINCT w) AS known FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)))""", ("book_pages",))  # fmt: skip
def _(t):
    rows = t.book_pages.where("length(extracted_text) BETWEEN 3 AND 60").join(t.documents.select(F.col("doc_id").alias("book_id"), "lang"), "book_id")
    return H.phonics_problems(rows.select((F.col("book_id") * 1000 + F.col("page_number")).alias("row_id"), "lang", F.col("extracted_text").alias("text")), benchmark_words(t))


def benchmark_words(t):
    return t.benchmark.select(F.lit("en").alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))


@query("C27_known_words", """SELECT lang, word, lang <> 'en' OR word IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) AS valid FROM (SELECT DISTINCT lang, unnest(string_split(text, ' ')) AS word FROM documents)""")
def _(t):
    return H.known_words(t.documents.select("lang", F.explode(F.split("text", " ")).alias("word")), benchmark_words(t))


KNOWN = "words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"


@query("C28_invalid_phonics_lines", """SELECT doc_id AS page_id, '- ' || p || ' ' || w[1] || ', ' || w[2] || p AS line, p AS pattern, array_to_string(bad, ',') AS bad_words FROM (SELECT *, list_filter([w[1], w[2] || p], lambda x: NOT contains(x, p) OR (lang = 'en' AND NOT list_contains(known, x))) AS bad FROM (SELECT doc_id, lang, w, w[3][1:2] AS p
 FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents) WHERE len(w) >= 3), (SELECT list(word) AS known FROM words)) WHERE len(bad) > 0""", (), KNOWN)  # fmt: skip
def _(t):
    w = t.documents.select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0).alias("w")).where("size(w) >= 3").withColumn("p", F.expr("substr(w[2], 1, 2)"))
    pages = w.select(F.col("doc_id").alias("page_id"), "lang", F.expr(r"'WOORDE\n- ' || p || '\n' || w[0] || ', ' || w[1] || p || '\n' || 'a sentence.'").alias("text"))
    return H.invalid_phonics_lines(pages, benchmark_words(t)).withColumn("bad_words", F.array_join("bad_words", ","))


PAUSED = "regexp_replace(regexp_replace(regexp_replace({0}, '\\.\\s+', '... ', 'g'), ',\\s+', ',... ', 'g'), '!\\s+', '!... ', 'g')"
SPOKEN = r"trim(regexp_replace(regexp_replace(trim(text), '^\d+\s*\n?', ''), '\n\d+\s*$', ''))"


@query("C34_narration_text", f"SELECT doc_id, nullif(substr({SPOKEN}, 1, 2000), '') AS narration, nullif(substr({PAUSED.format(SPOKEN)}, 1, 2000), '') AS slow FROM documents")
def _(t):
    return t.documents.select("doc_id", T.narration_text(F.col("text")).alias("narration"), T.narration_text(F.col("text"), 40).alias("slow"))
