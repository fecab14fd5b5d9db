"""Deterministic text signals of books and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafworks.functions.text import word_count, words


def book_signals(pages: DataFrame) -> DataFrame:
    """book_id, pages, words_per_page (over pages with words, half-up to 1 digit), image_share (pages flagged is_image_only, where pages have that column, or of 12 words at most, to 3 digits)."""
    flagged = F.coalesce("is_image_only", F.lit(False)) if "is_image_only" in pages.columns else F.lit(False)
    n = pages.select("book_id", word_count(F.col("extracted_text")).alias("n"), flagged.alias("flagged"))
    return n.groupBy("book_id").agg(
        F.count("*").alias("pages"),
        F.round(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.lit(0.0)), 1).alias("words_per_page"),
        F.round(F.avg(F.when(F.col("flagged") | (F.col("n") <= 12), 1.0).otherwise(0.0)), 3).alias("image_share"))


def book_type(signals: DataFrame) -> DataFrame:
    """Adds book_kind and kind_confidence by the rounded signals."""
    picture = (F.col("image_share") >= 0.6) & (F.col("words_per_page") <= 30)
    early = (F.col("words_per_page") <= 60) & (F.col("pages") <= 32)
    story = F.col("words_per_page") <= 150
    kind = F.when(picture, "picture_book").when(early, "early_reader").when(story, "storybook").otherwise("chapter_book")
    sure = F.when(picture, 0.9).when(early, 0.75).when(story, 0.7).otherwise(0.65)
    return signals.withColumn("book_kind", kind).withColumn("kind_confidence", sure)


# Reading levels, the scores below which they hold, and how sure they are; age spans and categories by kind of book.
LEVELS = [("pre_reader", 6.0, 0.7), ("beginner", 9.0, 0.75), ("developing", 12.0, 0.75), ("independent", 16.0, 0.7), ("advanced", None, 0.65)]
AGES = {"picture_book": (3, 6), "early_reader": (5, 8), "storybook": (6, 10), "chapter_book": (9, 12)}
CATEGORIES = {"picture_book": "picture-books", "early_reader": "early-readers", "storybook": "childrens-fiction", "chapter_book": "childrens-fiction"}


def reading_level(pages: DataFrame) -> DataFrame:
    """book_id, words, sentences (runs of . ! ?, one at least), score, level, level_confidence; without words pre_reader, 0.6."""
    text = F.coalesce("extracted_text", F.lit(""))
    per = pages.select("book_id", word_count(text).alias("w"), F.aggregate(words(text), F.lit(0), lambda a, x: a + F.length(x)).alias("c"), F.regexp_count(text, F.lit("[.!?]+")).alias("s"))
    out = per.groupBy("book_id").agg(F.sum("w").alias("words"), F.greatest(F.lit(1), F.sum("s")).alias("sentences"), F.sum("c").alias("_c"))
    # 0.6 a word, divided last: sums of tenths stay exact, so that levels hold at their bounds
    score = 6 * F.col("words") / F.lit(10.0) / F.col("sentences") + 1.4 * F.col("_c") / F.nullif("words", F.lit(0))
    level, sure = F.when(F.col("words") == 0, "pre_reader"), F.when(F.col("words") == 0, 0.6)
    for name, top, confidence in LEVELS[:-1]:
        level, sure = level.when(score < top, name), sure.when(score < top, confidence)
    return out.select("book_id", "words", "sentences", (F.round(score * 1_000_000) / 1_000_000).alias("score"), level.otherwise(LEVELS[-1][0]).alias("level"), sure.otherwise(LEVELS[-1][2]).alias("level_confidence"))


def age_hint(typed: DataFrame) -> DataFrame:
    """Adds hint_min, hint_max, hint_confidence by book_kind, 2 and 3 years more for independent and advanced levels; other kinds 4 to 9."""
    low, high = F.lit(4), F.lit(9)
    for kind, (a, b) in AGES.items():
        low, high = F.when(F.col("book_kind") == kind, a).otherwise(low), F.when(F.col("book_kind") == kind, b).otherwise(high)
    hard = F.coalesce(F.col("level").isin("independent", "advanced"), F.lit(False))
    return typed.withColumns({"hint_min": low + F.when(hard, 2).otherwise(0), "hint_max": high + F.when(hard, 3).otherwise(0), "hint_confidence": F.lit(0.5)})


def primary_category(typed: DataFrame, categories: DataFrame) -> DataFrame:
    """book_id, slug, category_confidence (0.9 of the kind's): the category of the kind of book, for slugs that exist only."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return typed.select("book_id", known[F.col("book_kind")].alias("slug"), (F.col("kind_confidence") * 0.9).alias("category_confidence")).join(F.broadcast(categories.where(F.col("slug").isin(*set(CATEGORIES.values()))).select("slug").distinct()), "slug", "left_semi").select("book_id", "slug", "category_confidence")


def long_suggestions(hinted: DataFrame, categories: DataFrame) -> DataFrame:
    """book_id, field, value, confidence (3 digits), requires_confirmation: a row for kind, level, ages and, where it exists, category; only ages ask."""
    fields = [("book_type", F.col("book_kind"), F.col("kind_confidence")), ("reading_level", F.col("level"), F.col("level_confidence")), ("age_range", F.concat_ws("-", "hint_min", "hint_max"), F.col("hint_confidence"))]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.round(c, 3).alias("confidence")) for f, v, c in fields])
    long = hinted.select("book_id", F.explode(rows).alias("s")).select("book_id", "s.*")
    category = primary_category(hinted, categories).select("book_id", F.lit("primary_category").alias("field"), F.col("slug").alias("value"), F.round("category_confidence", 3).alias("confidence"))
    return long.unionByName(category).withColumn("requires_confirmation", F.col("field") == "age_range")


def full_text(pages: DataFrame, separator: str = "\n", most: int = 4000) -> DataFrame:
    """book_id and its pages' texts in order, cut to most characters. Pages whose separator stands beyond the cut are left out before a book's pages meet."""
    own = pages.where("extracted_text IS NOT NULL").select("book_id", "page_number", "extracted_text")
    before = Window.partitionBy("book_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.length("extracted_text") + len(separator)).over(before), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.substring("extracted_text", 1, most).alias("t"))))
    return own.withColumn("_b", begins).where(F.col("_b") - len(separator) < most).groupBy("book_id").agg(F.substring(F.array_join(F.transform(ordered, lambda p: p["t"]), separator), 1, most).alias("sample"))


def encoding_check(docs: DataFrame) -> DataFrame:
    """doc_id, replacement characters, control characters but tab, newline and return, and whether there are none."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", F.regexp_count(text, F.lit(r"\x{FFFD}")).alias("replaced"), F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).alias("controls"))
    return out.withColumn("clean", (F.col("replaced") == 0) & (F.col("controls") == 0))


def narration_text(text: Column, speed: int = 100, most: int = 2000) -> Column:
    """Text without a page number at its head or on its last line, with pauses after . , and ! below speed 50, cut to most characters; null where nothing is left."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\d+\s*\n?", ""), r"\n\d+\s*$", ""))
    if speed < 50:
        for found, pause in ((r"\.\s+", "... "), (r",\s+", ",... "), (r"!\s+", "!... ")):
            out = F.regexp_replace(out, found, pause)
    return F.nullif(F.substring(out, 1, most), F.lit(""))
