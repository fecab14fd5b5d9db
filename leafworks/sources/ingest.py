"""Readers that turn raw pages, payloads and lists into rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafworks.functions.shipping import ship


def html_lines(pages: DataFrame) -> DataFrame:
    """page_id, line, text: the visible lines of raw pages; scripts, styles and tags go, blank lines are null-free gone."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    plain = F.regexp_replace(F.regexp_replace(body, r"(?i)</(p|div|h[1-6]|li|tr|title)>|<br */?>", "\n"), r"<[^>]*>", " ")
    rows = pages.select("page_id", F.posexplode(F.split(plain, "\n")).alias("line", "text"))
    return rows.select("page_id", "line", F.nullif(F.trim("text"), F.lit("")).alias("text")).where("text IS NOT NULL")


def targets_by_page(payloads: DataFrame) -> DataFrame:
    """doc_id, page_number, text of both payload shapes: pages carry whole texts, items are joined by newlines in their order; then stripped."""
    schema = "pages array<struct<page_number: int, translated_text: string>>, items array<struct<id: string, page_number: int, translation: string>>"
    p = payloads.select("doc_id", F.from_json("payload", schema).alias("p"))
    whole = p.select("doc_id", F.posexplode("p.pages").alias("i", "x")).select("doc_id", "i", "x.page_number", F.col("x.translated_text").alias("t"))
    parts = p.select("doc_id", F.posexplode("p.items").alias("i", "x")).select("doc_id", "i", "x.page_number", F.col("x.translation").alias("t"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n")
    return whole.unionByName(parts).groupBy("doc_id", "page_number").agg(F.trim(ordered).alias("text"))


def decoded_report(col: Column) -> Column:
    """A JSON object from text that was encoded once or twice; null for anything else."""
    once = F.try_parse_json(col)
    inner = F.try_variant_get(once, "$", "string")
    text = F.when(inner.startswith("{"), inner).otherwise(col)
    return F.when(text.startswith("{"), F.to_json(F.try_parse_json(text)))


def build_wordlist(lines: DataFrame) -> DataFrame:
    """word: lower-cased NFC words of two letters or more of a word list's lines; flags after / and lines with other signs go."""

    def nfc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"].str.normalize("NFC")})

    ship(lines.sparkSession)
    raw = lines.select(F.split_part("line", F.lit("/"), F.lit(1)).alias("word"))
    words = raw.mapInPandas(nfc, "word string").select(F.regexp_replace(F.lower("word"), r"[ .]", "").alias("word"))
    return words.where(F.col("word").rlike(r"^[\p{L}'-]{2,}$")).distinct()


def clean_title(name: Column) -> Column:
    """Underscores to spaces, double spaces to one, once each, then trimmed."""
    return F.trim(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def link_risks(pages: DataFrame) -> DataFrame:
    """page_id, links, risky: links of each page and those with a scheme that runs or reads something local."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    risky = F.filter(links, lambda x: F.lower(x).rlike("^(javascript|file|data|vbscript):"))
    return pages.select("page_id", F.size(links).alias("links"), F.size(risky).alias("risky"))


def declared_language(pages: DataFrame) -> DataFrame:
    """page_id and the language of its html tag; null without one."""
    return pages.select("page_id", F.nullif(F.regexp_extract("html", r'<html[^>]*lang="([^"]+)"', 1), F.lit("")).alias("language"))


def language_gate(pages: DataFrame, editions: DataFrame) -> DataFrame:
    """page_id, declared, requested, passed, code: whether a document declares the language of its edition, in any case; ACCESSIBILITY_LANG_UNSET where not (null where it does). pages: page_id, html; editions: page_id, language_code."""
    both = declared_language(pages).join(editions.select("page_id", F.col("language_code").alias("requested")), "page_id")
    ok = F.coalesce(F.lower("language") == F.lower("requested"), F.lit(False))
    return both.select("page_id", F.col("language").alias("declared"), "requested", ok.alias("passed"), F.when(~ok, "ACCESSIBILITY_LANG_UNSET").alias("code"))


def _blocks_of(log: Column) -> Column:
    """The outermost balanced {...} of a text, in order; braces inside strings count too."""
    pieces = F.regexp_extract_all(log, F.lit(r"[{}]|[^{}]+"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        up, down = piece == "{", (piece == "}") & (acc["depth"] > 0)
        depth = acc["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
        held = F.when(up | (acc["depth"] > 0), F.concat(acc["open"], piece)).otherwise("")
        done = down & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(done, "").otherwise(held).alias("open"), F.when(done, F.concat(acc["found"], F.array(held))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, start, step)["found"]


def last_report(log: Column) -> Column:
    """The JSON report of a program's output: the whole text if it is an object or list, else the last balanced {...} that parses; null for none. A leading byte order mark goes."""
    text = F.trim(F.regexp_replace(F.coalesce(log, F.lit("")), r"^\x{FEFF}", ""))
    whole = F.when(text.rlike(r"^[{\[]"), F.to_json(F.try_parse_json(text)))
    parsed = F.filter(F.transform(_blocks_of(text), lambda b: F.to_json(F.try_parse_json(b))), lambda j: j.isNotNull())
    return F.coalesce(whole, F.try_element_at(parsed, F.lit(-1)))
