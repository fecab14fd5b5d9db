"""Kinds of pages, by their text and by their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafworks.functions.text import contains_count, words

# What marks imprint and vocabulary pages, and the headers of a vocabulary page's parts.
IMPRINT = ["ISBN", "Copyright", "Published by", "Printed by", "©", "www.", ".net", ".com"]
VOCABULARY = ["WORDS", "HIGH FREQUENCY", "PHONICS", "WOORDE", "FREKWENSIE", "FONIES"]
HEADERS = [r"(?i)^WORDS$", r"(?i)^WOORDE$", r"(?i)HIGH\s*FREQUENCY", r"(?iu)HO[ËE]\s*FREKWENSIE", r"(?i)^PHONICS$", r"(?i)^FONIES$"]


def short_lines(text: Column) -> Column:
    """Lines with text of at most two words; a word is a run of ASCII letters, apostrophes and hyphens that begins with a letter."""
    lines = F.filter(F.transform(F.split(F.trim(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit("[A-Za-z][A-Za-z'-]*")) <= 2))


def is_imprint(text: Column, marks: list[str] | None = None) -> Column:
    return contains_count(text, marks or IMPRINT) >= 2


def is_vocabulary(text: Column, marks: list[str] | None = None) -> Column:
    """Two marks or more, or more than 20 short lines."""
    return (contains_count(text, marks or VOCABULARY) >= 2) | (short_lines(F.coalesce(text, F.lit(""))) > 20)


def page_types(pages: DataFrame, imprint: list[str] | None = None, vocabulary: list[str] | None = None) -> DataFrame:
    """book_id, page_number, page_type, needs_review: the first page is a cover, the last a back_cover, else copyright, vocabulary or story; vocabulary pages need review."""
    last = F.max("page_number").over(Window.partitionBy("book_id"))
    text = F.col("extracted_text")
    kind = F.when(F.col("page_number") == 1, "cover").when(F.col("page_number") == last, "back_cover").when(is_imprint(text, imprint), "copyright").when(is_vocabulary(text, vocabulary), "vocabulary").otherwise("story")
    return pages.select("book_id", "page_number", kind.alias("page_type")).withColumn("needs_review", F.col("page_type") == "vocabulary")


def manifest_page_types(pages: DataFrame, manifest: DataFrame, imprint: list[str] | None = None, vocabulary: list[str] | None = None) -> DataFrame:
    """The manifest's page_type where it has the page (story where it names none; vocabulary and phonics need review), else page_types(); source says which. Of rows of one page the least type."""
    given = manifest.groupBy("book_id", "page_number").agg(F.coalesce(F.min("page_type"), F.lit("story")).alias("_given"), F.lit(True).alias("_has"))
    both = page_types(pages, imprint, vocabulary).join(given, ["book_id", "page_number"], "left")
    kind = F.coalesce("_given", "page_type")
    review = F.when(F.col("_has"), F.col("_given").isin("vocabulary", "phonics")).otherwise(F.col("needs_review"))
    return both.select("book_id", "page_number", kind.alias("page_type"), review.alias("needs_review"), F.when(F.col("_has"), "scene_graph").otherwise("heuristic_fallback").alias("source"))


def vocabulary_regions(lines: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """doc_id, region (0 before the first header), heading, region_type, items (lines with text, in order), needs_review (phonics). lines: doc_id, line_no, text. Headers without items give none."""
    text = F.trim("text")
    rows = lines.select("doc_id", "line_no", text.alias("t")).where("t <> ''")
    header = F.lit(False)
    for h in headers or HEADERS:
        header = header | F.col("t").rlike(h)
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", header).withColumn("region", F.sum(F.col("head").cast("int")).over(so_far).cast("int"))
    found = rows.groupBy("doc_id", "region").agg(F.max(F.when(F.col("head"), F.col("t"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "t")))).alias("i")).where("size(i) > 0")
    low = F.lower("heading")
    kind = F.when(F.col("heading").isNull(), "word_list").when(low.contains("phonic") | low.contains("fonies"), "phonics_exercise").when(low.contains("frequency") | low.contains("frekwensie"), "high_frequency_words").otherwise("multi_column_word_list")
    return found.select("doc_id", "region", F.coalesce("heading", F.lit("")).alias("heading"), kind.alias("region_type"), F.transform("i", lambda x: x["t"]).alias("items"), (kind == "phonics_exercise").alias("needs_review"))


# Function words of English and Afrikaans, imprint marks of span texts, numbered titles.
FUNCTION_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "and", "of", "to", "with", "under", "over", "near", "nearby", "they", "he", "she", "it", "while", "when", "who", "that", "this", "these",
    "those", "there", "here", "for", "from", "by", "as", "so", "but", "or", "up", "out", "die", "n", "en", "op", "onder", "oor", "naby", "hulle", "met", "van", "'n", "sy", "hy", "dit", "terwyl", "wat", "daar",
]
SPAN_IMPRINT = ["published by", "copyright", "isbn", "all rights reserved", "(pty) ltd", "po box", "first edition", "printed"]
NUMBERED = r"(?:^|\s)\d{1,2}\s*[-–—]\s+\S"
ENTRY = r"(\d{1,2})\s*[-–—]\s+(.+?)(?=\s+\d{1,2}\s*[-–—]\s+|$)"


def is_title_list(text: Column) -> Column:
    """Two numbered titles or more."""
    return F.regexp_count(text, F.lit(NUMBERED)) >= 2


def is_prose(text: Column) -> Column:
    """Running text by its sentences: three words or more and no title list, and one of: eight words and a sentence's end; an end and a function word; four words and two function words; half of the
    other words but the first, two at least, in lower case (words of two letters or more count).
    """
    w = words(text)
    low = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"^[.,!?;:]+|[.,!?;:]+$", "")))
    known = F.size(F.filter(low, lambda x: x.isin(*FUNCTION_WORDS)))
    others = F.filter(F.transform(F.slice(w, 2, 1_000_000), lambda x: F.regexp_replace(x, r"""^[.,!?;:'"]+|[.,!?;:'"]+$""", "")), lambda x: F.length(x) >= 2)
    small = F.size(F.filter(others, lambda x: x.rlike(r"^\p{Ll}")))
    ends, n = text.rlike("[.!?]"), F.size(w)
    running = ((n >= 8) & ends) | (ends & (known > 0)) | ((n >= 4) & (known >= 2)) | ((F.size(others) > 0) & (small >= F.greatest(F.lit(2), F.floor(0.5 * F.size(others)))))
    return (n >= 3) & ~is_title_list(text) & running


def page_facts(spans: DataFrame) -> DataFrame:
    """Of every page: its joined text and the counts that its kind is told by. spans: page_id, span_no, text, font_size, x0, is_page_number (left out)."""
    text = F.coalesce(F.trim("text"), F.lit(""))
    n = F.size(words(text))
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    caps = (F.length(text) >= 3) & (n <= 3) & (letters != "") & ~text.rlike(r"[\p{Ll}\p{Lo}\p{Lt}\p{Lm}]")
    rows = spans.where("NOT coalesce(is_page_number, false)")
    share = lambda c: F.count_if(c) / F.count("*")
    return rows.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", text.alias("t")))), lambda x: x["t"]), " ").alias("joined"),
        F.count("*").alias("n"), F.count_if(F.col("font_size") < 15).alias("small"), F.count_if(F.col("font_size") >= 15).alias("large"), F.count_if(F.col("font_size") >= 40).alias("very_large"),
        share(n.between(1, 2)).alias("short_share"), share(text.rlike("[.!?]")).alias("end_share"), F.countDistinct(F.bround(F.col("x0") / 24.0, 0)).alias("columns"), F.coalesce(F.bool_or(caps), F.lit(False)).alias("caps"),
    )


def is_word_grid() -> Column:
    """12 boxes or more, mostly of one or two words, in two columns of 24 points, hardly any sentences; three columns under a heading in capitals."""
    plain = (F.col("short_share") >= 0.6) & (F.col("columns") >= 2) & (F.col("end_share") <= 0.25)
    headed = F.col("caps") & (F.col("short_share") >= 0.5) & (F.col("columns") >= 3) & (F.col("end_share") <= 0.3)
    return (F.col("n") >= 12) & (plain | headed)


def span_page_types(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, page_type, prose, word_grid, title_list; the first rule that fits wins. pages: page_id, page_number, total_pages; a page without boxes is a story."""
    facts = pages.select("page_id", "page_number", "total_pages").join(page_facts(spans), "page_id", "left").withColumn("joined", F.coalesce("joined", F.lit("")))
    for c in ("n", "small", "large", "very_large"):
        facts = facts.withColumn(c, F.coalesce(c, F.lit(0)))
    facts = facts.withColumn("prose", is_prose(F.col("joined"))).withColumn("title_list", is_title_list(F.col("joined"))).withColumn("word_grid", F.coalesce(is_word_grid(), F.lit(False)))
    first, big, few = F.col("page_number") == 1, F.col("very_large") > 0, F.col("n") <= 6
    kind = (
        F.when(F.col("n") == 0, "story").when((F.col("small") > 30) & (F.col("large") < 5), "vocabulary").when(F.col("word_grid"), "vocabulary").when(first & big & few, "cover")
        .when(F.col("title_list") & ~F.col("prose"), "back_cover").when((contains_count(F.col("joined"), SPAN_IMPRINT) > 0) & (F.col("small") >= F.col("large")), "copyright")
        .when(big & few & ~F.col("prose"), "cover").when((F.col("small") >= 10) & (F.col("n") > 15) & ~F.col("prose"), "copyright").when(F.col("prose"), "story")
        .when(first & big, "cover").when((F.col("page_number") >= F.col("total_pages")) & (F.col("n") > 2), "back_cover").otherwise("story")
    )
    return facts.select("page_id", kind.alias("page_type"), "prose", "word_grid", "title_list")


def title_entries(text: Column) -> Column:
    """header and entries of a list of titles: by lines where three or more survived, else by its numbers, else all is header."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*\\\\\s*", " ")), r"\s{2,}", " ")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbers, titles = F.regexp_extract_all(clean, F.lit(ENTRY), 1), F.regexp_extract_all(clean, F.lit(ENTRY), 2)
    head = F.trim(F.regexp_extract(clean, r"^(.*?)(?=\d{1,2}\s*[-–—]\s+\S)", 1))
    by_number = F.struct(head.alias("header"), F.zip_with(numbers, titles, lambda a, b: F.concat(a, F.lit(" - "), F.trim(b))).alias("entries"))
    by_line = F.struct(lines[0].alias("header"), F.slice(lines, 2, 1_000_000).alias("entries"))
    return F.when(F.size(lines) >= 3, by_line).when(F.size(numbers) >= 2, by_number).otherwise(F.struct(clean.alias("header"), F.array().cast("array<string>").alias("entries")))
