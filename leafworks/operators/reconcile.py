"""Translation reconciliation: contracts, coverage, leaks, changes and glyphs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafworks.functions.shipping import ship
from leafworks.functions.text import word_count


def response_errors(expected: DataFrame, received: DataFrame, extra_is_error: bool = True) -> DataFrame:
    """request_id, unit_id, problem, level of everything wrong with the answers to requests; a unit may have several problems.

    expected: request_id, unit_id; received: request_id, unit_id, seq, text. missing and duplicate are errors, answers without a unit's id too (no_id, once for each); an id nobody asked for is extra, an
    error or, with extra_is_error False, a warning. empty is a warning: of units asked for whose last answer (by seq) is blank or, with extra_is_error False, of any id with a blank answer.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    named = received.where("coalesce(cast(unit_id AS string), '') <> ''")
    got = named.groupBy("request_id", "unit_id").agg(F.count("*").alias("_n"), F.max_by(blank, "seq").alias("_last"), F.bool_or(blank).alias("_any"))
    both = expected.select("request_id", "unit_id").distinct().withColumn("_e", F.lit(True)).join(got, ["request_id", "unit_id"], "full_outer")
    asked = F.col("_e").isNotNull()
    empty = asked & F.col("_last") if extra_is_error else F.col("_any")
    told = lambda when, problem, level: F.when(when, F.struct(F.lit(problem).alias("problem"), F.lit(level).alias("level")))
    problems = F.array_compact(F.array(
        told(F.col("_n").isNull(), "missing", "error"), told(~asked, "extra", "error" if extra_is_error else "warning"), told(F.col("_n") > 1, "duplicate", "error"), told(empty, "empty", "warning"),
    ))
    found = both.select("request_id", "unit_id", F.explode(problems).alias("p")).select("request_id", "unit_id", "p.problem", "p.level")
    nameless = received.where("coalesce(cast(unit_id AS string), '') = ''").select("request_id", F.lit(None).cast(expected.schema["unit_id"].dataType).alias("unit_id"), F.lit("no_id").alias("problem"), F.lit("error").alias("level"))
    return found.unionByName(nameless)


def response_verdicts(requests: DataFrame, problems: DataFrame) -> DataFrame:
    """request_id, errors, warnings, valid (no error) of every request. problems as of response_errors()."""
    n = problems.groupBy("request_id").agg(F.count_if(F.col("level") == "error").alias("_e"), F.count_if(F.col("level") == "warning").alias("_w"))
    known = requests.select("request_id").distinct().join(n, "request_id", "left")
    zero = F.lit(0).cast("long")
    return known.select("request_id", F.coalesce("_e", zero).alias("errors"), F.coalesce("_w", zero).alias("warnings"), (F.coalesce("_e", zero) == 0).alias("valid"))


#: White space that is trimmed from lines and pages, besides the end of a line.
_BLANKS = " \t\n\r\x0b\0"


def _lines(text: Column) -> Column:
    """The trimmed lines of a text that aren't blank; any kind of line end."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")


def page_segments(text: Column, slots: Column) -> Column:
    """An array of as many texts as slots: one line each; of more lines ceil(lines / slots) to each, joined by newlines, the last takes the rest; of fewer the last slots are blank. Null without lines, and for one slot with several."""
    slots = slots.cast("int")

    def deal(lines: Column) -> Column:
        n = F.size(lines)
        per = F.ceil(n / slots).cast("int")
        group = lambda i: F.slice(lines, i * per + 1, F.when(i == slots - 1, n).otherwise(per))
        dealt = F.transform(F.sequence(F.lit(0), slots - 1), lambda i: F.when(n <= slots, F.coalesce(F.get(lines, i), F.lit(""))).otherwise(F.array_join(group(i), "\n")))
        return F.when((slots >= 1) & (n > 0) & ((slots > 1) | (n == 1)), dealt)

    # as an argument of a function the lines are made once, not for each slot
    return F.get(F.transform(F.array(_lines(text)), deal), F.lit(0))


def segments(pages: DataFrame, slots: Column) -> DataFrame:
    """book_id, slot, segment of every slot of pages (book_id, text) whose text can be dealt."""
    return pages.select("book_id", F.posexplode(page_segments(F.col("text"), slots)).alias("slot", "segment"))


def resolve_targets(units: DataFrame, pages: DataFrame, overrides: DataFrame, items: DataFrame) -> DataFrame:
    """edition_id, unit_id, target, resolved_by of every unit with an id: its override, even a blank one, else its item's text that isn't blank, else its own segment of the page's text, else the whole page where it is the
    page's only unit, else, where the page has text, nothing (unresolved: the source would leak), else its source (no text at all: not translated yet).

    units: edition_id, unit_id, page_number, reading_order, source_text; a page's units take its segments in reading order, equal ones by unit_id. pages: edition_id, page_number, text; overrides, items:
    edition_id, unit_id, text; null texts are none. Windows are a page's units.
    """
    page = ["edition_id", "page_number"]
    order = Window.partitionBy(*page).orderBy("reading_order", "unit_id")
    units = units.where("unit_id IS NOT NULL")
    placed = units.select("edition_id", "unit_id", "page_number", "source_text", (F.row_number().over(order) - 1).alias("_slot"))
    texts = pages.where("text IS NOT NULL").groupBy(*page).agg(F.max("text").alias("_text"))
    # a page's text is dealt once; its units take a segment each, and no unit carries the page unless it is the only one
    met = texts.join(units.groupBy(*page).agg(F.count("*").alias("_n")), page)
    has_text, blank = F.btrim(F.col("_text"), F.lit(_BLANKS)) != "", F.array_repeat(F.lit(None).cast("string"), F.col("_n").cast("int"))
    dealt = F.posexplode(F.coalesce(page_segments(F.col("_text"), F.col("_n")), blank)).alias("_slot", "_segment")
    slots = met.select(*page, has_text.alias("_has"), F.when(F.col("_n") == 1, F.col("_text")).alias("_page"), dealt).withColumn("_segment", F.nullif("_segment", F.lit("")))
    o = overrides.where("text IS NOT NULL").groupBy("edition_id", "unit_id").agg(F.max("text").alias("_o"))
    i = items.where("trim(text) <> ''").groupBy("edition_id", "unit_id").agg(F.max("text").alias("_i"))
    joined = placed.join(slots, [*page, "_slot"], "left").join(o, ["edition_id", "unit_id"], "left").join(i, ["edition_id", "unit_id"], "left")
    steps = [("override", F.col("_o"), F.col("_o").isNotNull()), ("item", F.col("_i"), F.col("_i").isNotNull()), ("segment", F.col("_segment"), F.col("_segment").isNotNull()), ("page", F.col("_page"), F.col("_has") & F.col("_page").isNotNull()),
             ("unresolved", F.lit(""), F.col("_has")), ("source", F.coalesce("source_text", F.lit("")), F.lit(True))]
    return joined.select("edition_id", "unit_id", F.coalesce(*[F.when(holds, text) for _, text, holds in steps]).alias("target"), F.coalesce(*[F.when(holds, F.lit(name)) for name, _, holds in steps]).alias("resolved_by"))


def unresolved_units(resolved: DataFrame) -> DataFrame:
    """edition_id, unit_id of units left blank although their page has text: such an edition goes to layout review."""
    return resolved.where("resolved_by = 'unresolved'").select("edition_id", "unit_id")


def flag(ratio: Column, green: float, yellow: float) -> Column:
    return F.when(ratio >= green, "green").when(ratio >= yellow, "yellow").otherwise("red")


def page_coverage(pairs: DataFrame) -> DataFrame:
    """book_id, requested, translated, score (tenfold share) and flag."""
    out = pairs.groupBy("book_id").agg(F.count("*").alias("requested"), F.count("translated_text").alias("translated"))
    ratio = F.col("translated") / F.greatest(F.lit(1), F.col("requested"))
    return out.withColumn("score", F.round(ratio * 10, 6)).withColumn("flag", flag(ratio, 0.95, 0.7))


def completeness(pairs: DataFrame) -> DataFrame:
    """book_id, page_number, problem: missing_page (no target, or a blank one), or short_page where a source of 8 words or more has fewer than max(3, 40 %) of them. Pages without source text aren't looked at."""
    n, m = word_count(F.col("source_text")), word_count(F.col("translated_text"))
    problem = F.when(n == 0, None).when(m == 0, "missing_page").when((n >= 8) & (m < F.greatest(F.lit(3), F.floor(0.4 * n))), "short_page")
    return pairs.select("book_id", "page_number", problem.alias("problem")).where("problem IS NOT NULL")


def significant_words(text: Column) -> Column:
    """The different words of three letters, digits or underscores at least, of any script, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)), F.lower))


def text_match(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """book_id, page_number, expected, found (different words), match_rate (3 digits; 1 where nothing is expected), searchable (the output has characters), missing_sample (the first ten), passed (above least).

    pages: book_id, page_number, source_text (expected), translated_text (found). Pages with nothing expected (blank), or not in the output (null), aren't looked at.
    """
    rows = pages.where("translated_text IS NOT NULL AND trim(coalesce(source_text, '')) <> ''")
    rows = rows.select("book_id", "page_number", significant_words(F.col("source_text")).alias("_want"), significant_words(F.col("translated_text")).alias("_have"), (F.length("translated_text") > 0).alias("searchable"))
    found = F.size(F.array_intersect("_want", "_have"))
    rate = F.when(F.size("_want") == 0, 1.0).otherwise(found / F.size("_want"))
    return rows.select("book_id", "page_number", F.size("_want").alias("expected"), found.alias("found"), F.bround(rate, 3).alias("match_rate"), "searchable",
                       F.slice(F.array_sort(F.array_except("_want", "_have")), 1, 10).alias("missing_sample"), (rate > least).alias("passed"))


# What a page before is introduced with, and what stands for none.
PREVIOUS, NO_PREVIOUS = "[Previous page]: ", "(This is near the beginning of the book)"


def previous_context(pages: DataFrame, back: int = 2, most: int = 200) -> DataFrame:
    """book_id, page_number, context: up to back pages of those before that have text, each cut to most characters and introduced; a fixed sentence for none. A page without text has the context of its place."""
    told = F.when(F.trim(F.coalesce("extracted_text", F.lit(""))) != "", F.concat(F.lit(PREVIOUS), F.substring(F.trim("extracted_text"), 1, most), F.lit("\n")))
    # how many pages with text come before; a page with text looks back at the last of them
    filled = pages.select("book_id", "page_number", told.alias("_t"))
    before = Window.partitionBy("book_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    ranked = filled.withColumn("_k", F.count("_t").over(before))
    texts = ranked.where("_t IS NOT NULL").select("book_id", "_k", "_t")
    asked = ranked.select("book_id", "page_number", F.explode(F.sequence(F.col("_k") - back, F.col("_k") - 1)).alias("_k"))
    joined = asked.join(texts, ["book_id", "_k"], "left").groupBy("book_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_k", "_t")))), lambda x: x["_t"]), "").alias("_c"))
    return joined.select("book_id", "page_number", F.when(F.col("_c") == "", NO_PREVIOUS).otherwise(F.col("_c")).alias("context"))


def latest_corrections(units: DataFrame, corrections: DataFrame) -> DataFrame:
    """unit_id and its last correction, else its own text."""
    last = corrections.groupBy("unit_id").agg(F.max_by("corrected", "seq").alias("_c"))
    return units.join(last, "unit_id", "left").select("unit_id", F.coalesce("_c", "text").alias("text"))


def changed_pages(now: DataFrame, state: DataFrame, key: list[str], text: str) -> DataFrame:
    """Keys of now that are new or whose text's hash differs from state's."""
    h = lambda: F.substring(F.md5(F.coalesce(F.col(text), F.lit(""))), 1, 12)
    old = state.select(*key, h().alias("_old"))
    return now.select(*key, h().alias("page_hash")).join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("page_hash"))).drop("_old")


#: Units named of a missing character, and missing characters that are a warning only.
NAMED, TOLERABLE = 10, 2


def _characters(texts: DataFrame, charset: DataFrame) -> DataFrame:
    """edition_id, unit_id, text, char, covered of every different character of a text; blanks and line ends need no glyph. A charset has a row for each code point at most."""
    known = F.broadcast(charset.select("char").distinct().withColumn("_c", F.lit(True)))
    chars = texts.select("edition_id", "unit_id", "text", F.explode(F.array_distinct(F.split("text", ""))).alias("char")).where(~F.col("char").isin("", " ", "\n", "\t", "\r"))
    return chars.join(known, "char", "left").withColumn("covered", F.col("_c").isNotNull()).drop("_c")


def missing_glyphs(texts: DataFrame, charset: DataFrame) -> DataFrame:
    """edition_id, char, codepoint, occurrences, docs and units (the NAMED least unit_ids) of characters of an edition's texts (edition_id, unit_id, text) that the charset lacks.

    A text gives a row for each different character; occurrences are told by what the text loses without it. The ids of a character are cut to NAMED in each task, then in each of 64 parts, then in all, so
    nothing gathers a character's texts.
    """
    lost = _characters(texts, charset).where("NOT covered")
    n = F.length("text") - F.length(F.replace("text", "char", F.lit("")))
    counts = lost.groupBy("edition_id", "char").agg(F.sum(n).cast("long").alias("occurrences"), F.count("*").alias("docs"))
    part = Window.partitionBy("edition_id", "char", F.pmod(F.xxhash64("unit_id"), F.lit(64))).orderBy("unit_id")
    some = lost.select("edition_id", "char", "unit_id").withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= NAMED)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("edition_id", "char").orderBy("unit_id"))).where(F.col("_r") <= NAMED)
    named = some.groupBy("edition_id", "char").agg(F.array_sort(F.collect_list("unit_id")).alias("units"))
    return counts.join(named, ["edition_id", "char"]).select("edition_id", "char", F.ascii("char").alias("codepoint"), "occurrences", "docs", "units")


def glyph_verdicts(texts: DataFrame, charset: DataFrame, missing: DataFrame) -> DataFrame:
    """edition_id, characters, covered, missing (different ones), affected_units (different ones named), severity (ok, warning up to TOLERABLE missing, critical) of every edition; missing as of missing_glyphs()."""
    seen = _characters(texts, charset).groupBy("edition_id", "char").agg(F.first("covered").alias("covered"))
    counts = seen.groupBy("edition_id").agg(F.count("*").alias("characters"), F.count_if("covered").alias("covered"))
    named = missing.select("edition_id", F.explode("units").alias("u")).groupBy("edition_id").agg(F.count_distinct("u").alias("_u"))
    lost = F.col("characters") - F.col("covered")
    severity = F.when(lost == 0, "ok").when(lost <= TOLERABLE, "warning").otherwise("critical")
    return counts.join(named, "edition_id", "left").select("edition_id", "characters", "covered", lost.alias("missing"), F.coalesce("_u", F.lit(0).cast("long")).alias("affected_units"), severity.alias("severity"))


def upsert_latest(base: DataFrame, changes: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """base with each key's last change: changed columns that aren't null replace base's, others are kept, new keys are added."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(f"_{c}") for c in columns])
    return base.join(last, keys, "full_outer").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


# What an educational unit's request asks for.
INSTRUCTION = ("This is educational content (", "). Create an equivalent ", " exercise at the same difficulty level. Do not translate literally.")


def unit_requests(units: DataFrame, language: str) -> DataFrame:
    """unit_id, request (JSON) of every unit that isn't preserved (no policy counts as preserve): id, page_number, page_type, semantic_role (unknown for none), translation_policy, source_text; an instruction for
    educational_adaptation; and of the structure, where the units have the columns and they are set: cell_box, align_h, align_v, peer_group_id, a column_span other than 1, is_merged where true.
    """
    c = F.col
    policy = F.coalesce("policy", F.lit("preserve"))
    role = F.coalesce("role", F.lit("unknown"))
    fields = [c("unit_id").alias("id"), c("page_number"), F.coalesce("page_type", F.lit("unknown")).alias("page_type"), role.alias("semantic_role"), policy.alias("translation_policy"), c("text").alias("source_text"),
              F.when(policy == "educational_adaptation", F.concat(F.lit(INSTRUCTION[0]), role, F.lit(INSTRUCTION[1] + language + INSTRUCTION[2]))).alias("instruction")]
    fields += [c(k) for k in ("cell_box", "align_h", "align_v", "peer_group_id") if k in units.columns]
    fields += [F.when(c("column_span") != 1, c("column_span")).alias("column_span")] if "column_span" in units.columns else []
    fields += [F.when(c("is_merged"), c("is_merged")).alias("is_merged")] if "is_merged" in units.columns else []
    return units.where(policy != "preserve").select("unit_id", F.to_json(F.struct(*fields)).alias("request"))


def page_texts(items: DataFrame) -> DataFrame:
    """book_id, page_number, text: items in reading order; story pages are joined by spaces, others by newlines; blank items are left out."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"])
    kept = items.where(F.trim("text") != "").groupBy("book_id", "page_number").agg(ordered.alias("t"), F.max("page_type").alias("k"))
    return kept.select("book_id", "page_number", F.array_join("t", " ").alias("s"), F.array_join("t", "\n").alias("o"), "k").select("book_id", "page_number", F.when(F.col("k") == "story", F.col("s")).otherwise(F.col("o")).alias("text"))


def region_targets(regions: DataFrame, overrides: DataFrame, items: DataFrame) -> DataFrame:
    """region_id, target, issue: override, then item, then own target; MISSING_TARGET for none. Preserved regions are skipped."""
    o = overrides.select("region_id", F.col("text").alias("_o"))
    i = items.select("region_id", F.col("text").alias("_i"))
    joined = regions.where("policy <> 'preserve'").join(o, "region_id", "left").join(i, "region_id", "left")
    target = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("_o", "_i", "target")])
    return joined.select("region_id", target.alias("target"), F.when(target.isNull(), "MISSING_TARGET").alias("issue"))


def score_flags(pages: DataFrame) -> DataFrame:
    """book_id, page_number, score, flag, refine: imprint pages have 9 and vocabulary pages 7.5; stories under 7 are refined."""
    score = F.when(F.col("page_type") == "copyright", 9.0).when(F.col("page_type") == "vocabulary", 7.5).otherwise(F.col("raw_score"))
    out = pages.select("book_id", "page_number", score.alias("score"), F.col("page_type"))
    return out.withColumn("flag", flag(F.col("score"), 8.0, 6.0)).withColumn("refine", (F.col("score") < 7) & ~F.col("page_type").isin("copyright", "vocabulary")).drop("page_type")


def document_match(expected: DataFrame, found: DataFrame, key: str, least: float = 0.6) -> DataFrame:
    """key, expected, found (different significant words), match_rate (3 digits), searchable (some page has text), encoding_ok (no replacement or control character), passed, reason of every document with a page in either table.

    expected: key, text; found: key, text (a row a page). Nothing expected counts as matched if there is text. The reason is the first that holds: no_text_layer, garbled, low_match; null for none.
    """
    words_ = lambda df: df.select(key, F.explode(significant_words(F.col("text"))).alias("w")).distinct()
    have = words_(found).withColumn("_h", F.lit(1))
    hits = words_(expected).join(have, [key, "w"], "left").groupBy(key).agg(F.count("*").alias("_e"), F.count("_h").alias("_f"))
    pages = found.groupBy(key).agg(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("_s"), F.bool_or(F.coalesce("text", F.lit("")).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]")).alias("_bad"))
    both = expected.select(key).unionByName(found.select(key)).distinct().join(hits, key, "left").join(pages, key, "left")
    zero = F.lit(0).cast("long")
    both = both.select(key, F.coalesce("_e", zero).alias("expected"), F.coalesce("_f", zero).alias("found"), F.coalesce("_s", F.lit(False)).alias("searchable"), (~F.coalesce("_bad", F.lit(False))).alias("encoding_ok"))
    rate = F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(F.col("searchable").cast("double"))
    reason = F.when(~F.col("searchable"), "no_text_layer").when(~F.col("encoding_ok"), "garbled").when((F.col("expected") > 0) & (rate < least), "low_match")
    return both.select(key, "expected", "found", F.bround(rate, 3).alias("match_rate"), "searchable", "encoding_ok", reason.isNull().alias("passed"), reason.alias("reason"))


def compact_variants(pairs: DataFrame) -> DataFrame:
    """One row: pairs with a compact variant, valid ones (shorter, at least half as long), coverage and savings in percent (half-even, 1 digit)."""
    n, m = F.length("source_text"), F.length("translated_text")
    valid = F.coalesce((m < n) & (m >= 0.5 * n), F.lit(False))
    out = pairs.agg(F.count("*").alias("total"), F.count("translated_text").alias("with_variant"), F.count_if(valid).alias("valid"), F.sum(F.when(valid, n - m)).alias("_s"), F.sum(F.when(valid, n)).alias("_n"))
    return out.select("total", "with_variant", "valid", F.bround(100.0 * F.col("with_variant") / F.col("total"), 1).alias("coverage"), F.bround(100.0 * F.col("_s") / F.col("_n"), 1).alias("savings"))


def cache_split(now: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """keys and cached: whether the content key is in the cache."""
    known = cache.select(*keys).distinct().withColumn("_c", F.lit(True))
    return now.join(known, keys, "left").select(*keys, F.coalesce("_c", F.lit(False)).alias("cached"))


def hit_rate(split_: DataFrame) -> DataFrame:
    """One row: total, hits, misses, rate (3 digits; 0 for nothing asked) of what cache_split() gives."""
    n, k = F.count("*"), F.count_if("cached")
    return split_.agg(n.alias("total"), k.alias("hits"), (n - k).alias("misses"), F.bround(F.coalesce(k / F.nullif(n, F.lit(0).cast("long")), F.lit(0.0)), 3).alias("rate"))


def font_coverage(texts: DataFrame, fonts: DataFrame) -> DataFrame:
    """lang, font, required, covered, suitable (95 % at least): characters that a language's texts need and a font (font, char) has."""
    need = texts.select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("char")).where("char <> ''").distinct()
    total = need.groupBy("lang").agg(F.count("*").alias("required"))
    have = need.join(fonts, "char").groupBy("lang", "font").agg(F.count("*").alias("covered"))
    return have.join(total, "lang").withColumn("suitable", F.col("covered") >= 0.95 * F.col("required"))


def exercise_contracts(pages: DataFrame, role: str = "vocabulary") -> DataFrame:
    """source_id, book_id, page_number, kind, text: the first line of a page is its instruction, the others are questions with ids page:role:i; a page without lines keeps a row without a component."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select("book_id", "page_number", F.posexplode_outer(lines).alias("i", "text"))
    kind = F.when(F.col("i") == 0, "instruction").when(F.col("i") > 0, "question")
    return rows.select(F.when(F.col("i") > 0, F.concat_ws(":", "page_number", F.lit(role), "i")).alias("source_id"), "book_id", "page_number", kind.alias("kind"), "text")


def memory_block(terms: DataFrame) -> DataFrame:
    """book_id, language_code, terms (an ordered list of source, translation, context), block ('source = translation' lines): the glossary of each book and language, in order of the source term. terms: book_id, language_code, source_term, translated_term, context."""
    rows = terms.groupBy("book_id", "language_code").agg(F.array_sort(F.collect_list(F.struct(F.col("source_term").alias("source"), F.col("translated_term").alias("translation"), "context"))).alias("terms"))
    return rows.withColumn("block", F.array_join(F.transform("terms", lambda x: F.concat_ws(" = ", x["source"], x["translation"])), "\n"))


def memory_lookup(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """asked (book_id, language_code, source_term and others) with the term's translated_term in that book and language, exactly as written; null for none."""
    keys = ["book_id", "language_code", "source_term"]
    return asked.join(terms.groupBy(*keys).agg(F.min("translated_term").alias("translated_term")), keys, "left")


# Parts of phrases that stay as they are in any language. Names of publishers are the caller's to add.
EXEMPT = ["studio", "isbn", "www.", "http", "@", "(pty)", "printed by", "published by", "copyright", "all rights"]
#: Up to so many keys are broadcast, with their phrases; more are joined by shuffles.
KEY_ROWS = 200_000


def _norm(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))


def _contexts(text: Column) -> Column:
    """Each word of a text with single spaces but the first and last, between the last letter of the one before and the first of the one after; once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?=(\S \S+ \S))"), F.lit(1)))


def _held(texts: DataFrame, keys: DataFrame, few: bool) -> DataFrame:
    """The columns of texts and keys (key and others) for each key that a text has among its contexts. Few keys come to the texts, whose words are tried in passing: no row is made for a word that is no key. Of many, ids meet keys first."""
    found = F.explode(_contexts(F.col("body"))).alias("key")
    if few:
        return texts.select("doc_id", "body", found).join(F.broadcast(keys), "key")
    return texts.select("doc_id", found).join(keys, "key").join(texts.select("doc_id", "body"), "doc_id")


def source_leaks(phrases: DataFrame, texts: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """item_id, doc_id of phrases that stand verbatim, lower-cased and with collapsed space, in texts: of three words and six ASCII letters or more, without an exempt part.

    The first and last word may be parts of longer words in a text, the words between are whole. A phrase is looked for by one of these, with the letters that stand before and after it: the one that the fewest texts have, counted
    over all texts, so a phrase of common words meets few. Containment confirms. doc_id tells texts apart.
    """
    p = phrases.select("item_id", _norm("text").alias("shown")).withColumn("phrase", F.lower("shown")).withColumn("parts", F.split("phrase", " "))
    for mark in EXEMPT if exempt is None else exempt:
        p = p.where(~F.col("phrase").contains(mark))
    p = p.where((F.size("parts") >= 3) & (F.length(F.regexp_replace("shown", "[^A-Za-z]", "")) >= 6)).select("item_id", "phrase", _contexts(F.col("phrase")).alias("keys")).distinct()
    # exploding a list of one keeps an expression from being worked out again wherever it is used
    d = texts.select("doc_id", F.explode(F.array(F.lower(_norm("text")))).alias("body"))
    keys = p.select("item_id", "phrase", F.explode("keys").alias("key")).distinct()
    few = keys.count() <= KEY_ROWS
    counts = _held(d, keys.select("key").distinct(), few).groupBy("key").agg(F.count("*").alias("n"))
    rare = keys.join(counts, "key").groupBy("item_id", "phrase").agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.count("*").alias("_met"))
    # a phrase with a context that no text has stands nowhere
    whole = keys.groupBy("item_id", "phrase").agg(F.count("*").alias("_all"))
    rare = rare.join(whole, ["item_id", "phrase"]).where("_met = _all").select("item_id", "phrase", "key")
    return _held(d, rare, few).where(F.col("body").contains(F.col("phrase"))).select("item_id", "doc_id").distinct()


def title_candidates(spans: DataFrame, text: str = "text") -> DataFrame:
    """page_id, span_no, font_size, title: its largest text with more than two ASCII letters that credits no studio; the first of equal ones."""
    usable = (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) > 2) & ~F.lower(text).contains("studio")
    order = Window.partitionBy("page_id").orderBy(F.desc("font_size"), "span_no")
    return spans.where(usable).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("page_id", "span_no", "font_size", F.col(text).alias("title"))


def candidate_title(text: Column, credits: list[str] | None = None) -> Column:
    """The first line with an ASCII letter that holds no credit; null for none."""
    def usable(line: Column) -> Column:
        out = line.rlike("[A-Za-z]")
        for mark in credits if credits is not None else ["studio"]:
            out = out & ~F.lower(line).contains(mark)
        return out

    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), usable)
    return F.get(lines, F.lit(0))


LIKE = 0.92


def _grouped(rows: pd.DataFrame, least: float) -> list[int]:
    """Greedy groups in page order: a variant joins the first group whose first variant is like it."""
    firsts: list[str] = []
    seen: dict[str, int] = {}
    for key in rows["key"]:
        if key not in seen:
            at = next((i for i, f in enumerate(firsts) if difflib.SequenceMatcher(None, key, f).ratio() >= least), len(firsts))
            if at == len(firsts):
                firsts.append(key)
            seen[key] = at
    return [seen[k] for k in rows["key"]]


def title_variants(pages: DataFrame, titles: DataFrame, least: float = LIKE, credits: list[str] | None = None) -> DataFrame:
    """book_id, page_number, variant, variant_group (0 for the first in page order): how the pages whose source text holds the book's title render it.

    pages: book_id, page_number, source_text, translated_text; titles: book_id, title. Variants are a page's first usable line; they are alike from a difflib ratio of least
    on, in lower case with collapsed space. A book with more than one group is inconsistent. A task gets one book's title lines, a row a page.
    """
    key = lambda c: F.lower(_norm(c))
    named = titles.select("book_id", key("title").alias("_title")).where("_title <> ''")
    held = pages.join(named, "book_id").where(F.lower(_norm("source_text")).contains(F.col("_title")))
    rows = held.select("book_id", "page_number", candidate_title(F.col("translated_text"), credits).alias("variant")).where("variant IS NOT NULL").withColumn("key", key("variant"))

    def run(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["page_number", "key"], kind="stable")
        found["variant_group"] = _grouped(found, least)
        return found[["book_id", "page_number", "variant", "variant_group"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ship(rows.sparkSession)
    return rows.groupBy("book_id").applyInPandas(run, f"book_id {kinds['book_id']}, page_number {kinds['page_number']}, variant string, variant_group int")


def canonical_groups(variants: DataFrame) -> DataFrame:
    """book_id, canonical, pages: the group on most pages, of equal ones the earliest; shown as on its first page."""
    groups = variants.groupBy("book_id", "variant_group").agg(F.count("*").alias("pages"), F.min("page_number").alias("_f"), F.min_by("variant", F.struct("page_number", "variant")).alias("canonical"))
    best = Window.partitionBy("book_id").orderBy(F.desc("pages"), "_f", "variant_group")
    return groups.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("book_id", "canonical", "pages")


def canonical_variants(lines: DataFrame, key: str, variant: str, order: str) -> DataFrame:
    """key, canonical, pages: the variant on most pages, by lower-cased text with collapsed space; of equal ones the earliest; shown as first seen. The exact form of canonical_groups()."""
    norm = F.trim(F.regexp_replace(F.lower(F.col(variant)), r"[ \t]+", " "))
    groups = lines.groupBy(key, norm.alias("_n")).agg(F.count("*").alias("pages"), F.min(order).alias("_f"), F.min_by(variant, order).alias("canonical"))
    best = Window.partitionBy(key).orderBy(F.desc("pages"), "_f")
    return groups.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "canonical", "pages")


def _title_like(c: str) -> Column:
    return (F.size(F.filter(F.split(_norm(c), " "), lambda x: x != "")) <= 6) & ~F.col(c).rlike(r"\d+\s*[-–]\s*\S")


def _literal(c: Column) -> Column:
    """A pattern that finds the text c in any case."""
    return F.concat(F.lit("(?iu)"), F.regexp_replace(c, r"([\\\^$.|?*+()\[\]{}])", r"\\$1"))


def reconciled_titles(variants: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, page_number, text, changed_from, changed_to of pages whose title differs from the book's canonical one, with it in its place.

    A variant of six words at most and no list is replaced, as it stands or else in any case in the text with collapsed space. In longer ones the longest short variant of the book, by any case, is replaced.
    Pages where neither is found, and books with one titled page, stay out.
    """
    chosen = canonical_groups(variants)
    several = variants.groupBy("book_id").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = variants.join(several.select("book_id"), "book_id", "left_semi").join(chosen.select("book_id", "canonical"), "book_id").where(F.lower(_norm("variant")) != F.lower(_norm("canonical")))
    short = rows.where(_title_like("variant")).groupBy("book_id").agg(F.array_sort(F.collect_set(F.struct((-F.length(_norm("variant"))).alias("n"), _norm("variant").alias("v")))).alias("_short"))
    both = rows.join(short, "book_id", "left").join(pages.select("book_id", "page_number", F.col("translated_text").alias("_text")), ["book_id", "page_number"])
    put = F.regexp_replace("canonical", r"([\\$])", r"\\$1")
    whole = F.col("_text").contains(F.col("variant"))
    loose = F.regexp_like(_norm("_text"), _literal(_norm("variant")))
    simple = F.when(whole, F.replace("_text", "variant", "canonical")).when(loose, F.regexp_replace(_norm("_text"), _literal(_norm("variant")), put))
    hit = F.get(F.filter("_short", lambda x: F.regexp_like(F.col("_text"), _literal(x["v"]))), F.lit(0))["v"]
    like = _title_like("variant")
    text = F.when(like, simple).otherwise(F.regexp_replace("_text", _literal(hit), put))
    out = both.select("book_id", "page_number", text.alias("text"), F.when(like, F.col("variant")).otherwise(hit).alias("changed_from"), F.col("canonical").alias("changed_to"))
    return out.where("text IS NOT NULL")


def page_map(response: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, page_number, page_type, items (unit_id to translation): pages with a translated unit; of several answers to one id the last (by seq) counts. Answers without translation are none; ids that no unit has are left out."""
    last = response.where("unit_id IS NOT NULL AND translation IS NOT NULL").groupBy("doc_id", "unit_id").agg(F.max_by("translation", "seq").alias("translation"))
    both = units.select("doc_id", "page_number", "page_type", "unit_id").distinct().join(last, ["doc_id", "unit_id"])
    return both.groupBy("doc_id", "page_number").agg(F.min("page_type").alias("page_type"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit_id", "translation")))).alias("items"))


def _canonical(c: str) -> Column:
    """The hash of a JSON text's value: keys sorted at every depth; null and broken ones as empty."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(F.coalesce(F.col(c), F.lit("[]")))), F.lit("[]")), 256)


def render_fingerprint(candidates: DataFrame, key: str) -> DataFrame:
    """key, text_hash, fingerprint of source_version, manifest_version, engine_version and the JSON texts item_translations, typography_policy, fit_policies and repair_revisions; the order of keys inside doesn't matter.

    text_hash is that of item_translations alone: where it changes, narration is out of date. The form is our own; equal inputs give equal hashes, others different ones.
    """
    versions = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("source_version", "manifest_version", "engine_version")]
    parts = [F.concat(F.lit(f"{c}="), _canonical(c)) for c in ("item_translations", "typography_policy", "fit_policies", "repair_revisions")]
    return candidates.select(key, _canonical("item_translations").alias("text_hash"), F.sha2(F.concat_ws("\n", *versions, *parts), 256).alias("fingerprint"))


def page_content_hash(pages: DataFrame, spans: DataFrame, images: DataFrame, drawings: DataFrame) -> DataFrame:
    """page_id, content_hash (16 hex digits) of a page's size and rotation, its texts at their rounded places, images by number and size, and the number of drawings with the first and last one's box.

    pages: page_id, width, height, rotation; spans: page_id, x, y, text; images: page_id, image_id, width, height; drawings: page_id, drawing_no, box. The order of rows doesn't matter.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    at = lambda c: F.bround(c, 0).cast("long").cast("string")
    texts = spans.where("trim(text) <> ''").groupBy("page_id").agg(joined(F.concat(at("x"), F.lit(","), at("y"), F.lit(":"), F.trim("text"))).alias("_t"))
    shown = images.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_id", "width", "height"))), lambda i: F.concat_ws(":", i["image_id"], i["width"], i["height"])), "\n").alias("_i"))
    drawn = drawings.groupBy("page_id").agg(F.concat_ws(":", F.count("*"), F.min_by("box", "drawing_no"), F.max_by("box", "drawing_no")).alias("_d"))
    both = pages.join(texts, "page_id", "left").join(shown, "page_id", "left").join(drawn, "page_id", "left")
    size = F.concat_ws("x", F.bround("width", 1).cast("string"), F.bround("height", 1).cast("string"), F.col("rotation").cast("string"))
    return both.select("page_id", F.substring(F.sha2(F.concat_ws("|", size, F.coalesce("_t", F.lit("")), F.coalesce("_i", F.lit("")), F.coalesce("_d", F.lit("0"))), 256), 1, 16).alias("content_hash"))


CONTRACT = "exercises array<struct<id: string, components: array<struct<source_id: string, role: string>>>>"
#: Languages whose exercises a validator knows.
VALIDATORS = ["en"]


def educational_issues(editions: DataFrame) -> DataFrame:
    """edition_id, code, exercise_id, source_id of every issue. editions: edition_id, language, exercise_contract (JSON).

    No contract: no issue. No exercises, or an exercise without components: EMPTY_EXERCISE. A component without id: UNKNOWN_OR_INVALID_COMPONENT_ID; each repetition of one: DUPLICATE_COMPONENT_ID.
    Exercises in a language without validator: UNSUPPORTED_EDUCATIONAL_VALIDATOR; they go to a specialist, never to another language's rules.
    """
    rows = editions.where("exercise_contract IS NOT NULL").select("edition_id", "language", F.from_json("exercise_contract", CONTRACT)["exercises"].alias("e"))
    none = F.lit(None).cast("string")
    filled = rows.where("size(e) > 0")
    empty = rows.where("coalesce(size(e), 0) <= 0").select("edition_id", F.lit("EMPTY_EXERCISE").alias("code"), none.alias("exercise_id"), none.alias("source_id"))
    each = filled.select("edition_id", F.posexplode("e").alias("no", "x")).select("edition_id", "no", F.col("x.id").alias("exercise_id"), F.col("x.components").alias("c"))
    bare = each.where("coalesce(size(c), 0) <= 0").select("edition_id", F.lit("EMPTY_EXERCISE").alias("code"), "exercise_id", none.alias("source_id"))
    parts = each.where("size(c) > 0").select("edition_id", "no", "exercise_id", F.posexplode("c").alias("at", "p")).select("edition_id", "no", "exercise_id", "at", F.col("p.source_id").alias("source_id"))
    order = Window.partitionBy("edition_id", "no", "source_id").orderBy("at")
    code = F.when(F.col("source_id").isNull(), "UNKNOWN_OR_INVALID_COMPONENT_ID").when(F.row_number().over(order) > 1, "DUPLICATE_COMPONENT_ID")
    wrong = parts.select("edition_id", code.alias("code"), "exercise_id", "source_id").where("code IS NOT NULL")
    unknown = filled.where(~F.coalesce(F.col("language").isin(*VALIDATORS), F.lit(False))).select("edition_id", F.lit("UNSUPPORTED_EDUCATIONAL_VALIDATOR").alias("code"), none.alias("exercise_id"), none.alias("source_id"))
    return empty.unionByName(bare).unionByName(wrong).unionByName(unknown)
