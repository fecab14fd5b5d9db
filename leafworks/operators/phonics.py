"""Rows of a phonics exercise: a pattern and example words that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = r"[^\p{L}]"


def looks_like_phonics(text: Column) -> Column:
    """60 characters at most, no sentence's end inside, a first word of 1 to 4 letters that another word holds."""
    t = F.trim(text)
    norm = F.regexp_replace(F.regexp_replace(t, r"^\s*[-–—]\s*", ""), r"\s*[-–—]\s*", " ")
    pattern = F.lower(F.regexp_extract(norm, r"^(\p{L}{1,4})\s+.+$", 1))
    others = F.transform(F.split(F.lower(F.regexp_extract(norm, r"^\p{L}{1,4}\s+(.+)$", 1)), r"[,\s]+"), lambda w: F.regexp_replace(w, _LETTERS, ""))
    ok = (F.length(t) <= 60) & ~t.rlike(r"[.!?]\s") & (pattern != "") & F.exists(others, lambda w: (w != pattern) & w.contains(pattern))
    return F.coalesce(ok, F.lit(False))


def phonics_lines(pages: DataFrame) -> DataFrame:
    """book_id, page_number and pattern of the pages (of one line each) that look like a phonics row."""
    norm = F.regexp_replace(F.trim("extracted_text"), r"^\s*[-–—]\s*", "")
    return pages.where(looks_like_phonics(F.col("extracted_text"))).select("book_id", "page_number", F.lower(F.regexp_extract(norm, r"^(\p{L}{1,4})", 1)).alias("pattern"))


def known_words(words_: DataFrame, wordlist: DataFrame) -> DataFrame:
    """lang, word, valid: in the language's list, or the language has none."""
    has = wordlist.select("lang").distinct().withColumn("_has", F.lit(True))
    listed = wordlist.select("lang", "word").distinct().withColumn("_in", F.lit(True))
    out = words_.select("lang", "word").distinct().join(has, "lang", "left").join(listed, ["lang", "word"], "left")
    return out.select("lang", "word", (F.col("_in").isNotNull() | F.col("_has").isNull()).alias("valid"))


def phonics_problems(rows: DataFrame, wordlist: DataFrame) -> DataFrame:
    """row_id, pattern, valid, problem of every row: its example words must hold the pattern and, where the language has a list, be in it. A row without pattern and examples is valid, problem null.

    rows: row_id, lang, text. problem names the words without the pattern, then those not in the list, in order.
    """
    t = F.regexp_replace(F.trim("text"), r"^\s*[-–—]\s*", "")
    parts = rows.select("row_id", "lang", F.lower(F.regexp_extract(t, r"^(\S{1,5})\s+.+$", 1)).alias("pattern"), F.split(F.lower(F.regexp_extract(t, r"^\S{1,5}\s+(.+)$", 1)), r"[,\s]+").alias("w"))
    each = parts.where("pattern <> ''").select("row_id", "lang", "pattern", F.posexplode(F.transform("w", lambda x: F.regexp_replace(x, _LETTERS, ""))).alias("at", "word")).where("word <> ''")
    checked = each.join(known_words(each, wordlist), ["lang", "word"])
    lacks = ~F.col("word").contains(F.col("pattern"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "word")))), lambda x: x["word"]), ", ")
    found = checked.groupBy("row_id").agg(F.bool_and(~lacks & F.col("valid")).alias("ok"), ordered(lacks).alias("without"), ordered(~lacks & ~F.col("valid")).alias("unknown"))
    problem = F.concat_ws("; ", F.when(F.col("without") != "", F.concat("without", F.lit(' do not contain the pattern "'), "pattern", F.lit('"'))), F.when(F.col("unknown") != "", F.concat("unknown", F.lit(" are not real words"))))
    out = parts.join(found, "row_id", "left")
    return out.select("row_id", F.nullif("pattern", F.lit("")).alias("pattern"), F.coalesce("ok", F.lit(True)).alias("valid"), F.when(~F.col("ok"), problem).alias("problem"))


# Words that make a line a header.
HEADER_WORDS = r"(?iu)\b(WOORDE|FREKWENSIE|FONIES|KLANKLEER|WORDS|PHONICS|FREQUENCY)\b"
ENTRY = "struct<line: string, pattern: string, examples: string>"


def phonics_entries(lines: Column) -> Column:
    """Array of line, pattern and examples. 'br - broek, breek' and '- kk lekker' stand on one line; a lone '- kk' takes the next line, which then begins no entry; headers begin none."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")

    def header(x: Column) -> Column:
        letters = F.regexp_replace(x, _LETTERS, "")
        return ((letters != "") & (F.upper(letters) == letters)) | x.rlike(HEADER_WORDS)

    def entry(line: Column, pattern: Column, examples: Column) -> Column:
        return F.array(F.struct(line.alias("line"), pattern.alias("pattern"), examples.alias("examples")))

    # each line with its next, so that the walk needs no index
    pairs = F.zip_with(kept, F.slice(F.concat(kept, F.array(F.lit(""))), 2, 1_000_000), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    dashed, lone, spaced = r"^[-–—•]?\s*(\p{L}{1,4}(?:\s\p{L})?)\s*[-–—]\s+(.+)$", r"^[-–—•]\s*(\p{L}{1,4})\s*$", r"^[-–—•]\s*(\p{L}{1,4})\s+(\p{L}.+)$"
    start = F.struct(F.lit(False).alias("skip"), F.array().cast(f"array<{ENTRY}>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        a, b = p["a"], p["b"]
        takes = (b != "") & ~header(b) & b.rlike(r"\p{L}") & ~b.rlike(r"^[-–—•]")
        none = F.array().cast(f"array<{ENTRY}>")
        new = (
            F.when(acc["skip"] | header(a), none).when(a.rlike(dashed), entry(a, F.regexp_extract(a, dashed, 1), F.regexp_extract(a, dashed, 2)))
            .when(a.rlike(lone), F.when(takes, entry(F.concat(a, F.lit(" "), b), F.regexp_extract(a, lone, 1), b)).otherwise(none))
            .when(a.rlike(spaced), entry(a, F.regexp_extract(a, spaced, 1), F.regexp_extract(a, spaced, 2))).otherwise(none)
        )
        skips = ~acc["skip"] & ~header(a) & ~a.rlike(dashed) & a.rlike(lone) & takes
        return F.struct(F.coalesce(skips, F.lit(False)).alias("skip"), F.concat(acc["found"], new).alias("found"))

    return F.aggregate(pairs, start, step)["found"]


def invalid_phonics_lines(pages: DataFrame, wordlist: DataFrame) -> DataFrame:
    """page_id, line, pattern, bad_words (in order) of entries with example words, parted by commas and slashes, that lack the pattern or, where the language has a list, aren't in it. pages: page_id, lang, text."""
    rows = pages.select("page_id", "lang", F.posexplode(phonics_entries(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"))).alias("entry_no", "e"))
    each = rows.select("page_id", "lang", "entry_no", "e.line", F.col("e.pattern").alias("shown"), F.lower(F.replace("e.pattern", F.lit(" "), F.lit(""))).alias("pattern"), F.posexplode(F.split("e.examples", "[,/]")).alias("at", "raw"))
    each = each.where("length(pattern) BETWEEN 1 AND 4").withColumn("word", F.regexp_replace(F.lower(F.trim("raw")), _LETTERS, "")).where("word <> ''")
    checked = each.join(known_words(each, wordlist), ["lang", "word"])
    bad = checked.where(~F.col("word").contains(F.col("pattern")) | ~F.col("valid"))
    found = bad.groupBy("page_id", "entry_no", "line", F.col("shown").alias("pattern")).agg(F.array_sort(F.collect_list(F.struct("at", F.trim("raw").alias("w")))).alias("b"))
    return found.select("page_id", "line", "pattern", F.transform("b", lambda x: x["w"]).alias("bad_words"))
