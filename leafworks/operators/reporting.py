"""Operational reports: costs, audit versions, jobs, discovery events, page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices a million tokens (in, out), a thousand narrated characters, and the exchange rate.
PRICE_IN, PRICE_OUT, PRICE_NARRATED, RATE = 0.15, 0.60, 0.30, 18.5


def translation_cost(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, chars, cost: four characters a token, two readings and one writing of each."""
    out = rows.groupBy(key).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    return out.withColumn("cost", F.round(F.col("chars") / 4 * (2 * PRICE_IN + PRICE_OUT) / 1e6 * RATE, 6))


def narration_cost(narrations: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: characters and cost of all narrations; a book narrated twice is paid twice."""
    size = pages.groupBy("book_id").agg(F.sum(F.length("extracted_text")).alias("n"))
    out = narrations.join(size, "book_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
    return out.withColumn("cost", F.round(F.col("chars") / 1000 * PRICE_NARRATED * RATE, 6))


def edition_costs(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, words, chars (with the spaces that join pages with text), cost (to translate, 6 digits), narration_cost, narratable (pages but four, none below 0)."""
    filled = F.coalesce(F.col(text), F.lit("")) != ""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r\x0B\f]+"), lambda w: w != ""))
    chars = F.greatest(F.coalesce(F.sum(F.length(text)), F.lit(0)) + F.count_if(filled) - 1, F.lit(0))
    out = pages.groupBy(key).agg(F.sum(n).alias("words"), chars.alias("chars"), F.greatest(F.lit(0), F.count("*") - 4).alias("narratable"))
    cost = F.round(F.col("chars") / 4 * (2 * PRICE_IN + PRICE_OUT) / 1e6 * RATE, 6)
    return out.select(key, "words", "chars", cost.alias("cost"), F.round(F.col("chars") / 1000 * PRICE_NARRATED * RATE, 6).alias("narration_cost"), "narratable")


def page_range(pages: DataFrame, start: int = 3, end: int | None = None) -> DataFrame:
    """Pages from start to end, or to max(start, last - 2) without one."""
    last = F.max("page_number").over(Window.partitionBy("book_id"))
    top = F.lit(end) if end is not None else F.greatest(F.lit(start), last - 2)
    return pages.withColumn("_top", top).where(F.col("page_number").between(F.lit(start), F.col("_top"))).drop("_top")


def narration_texts(asked: DataFrame, books: DataFrame, pages: DataFrame, translated: DataFrame) -> DataFrame:
    """book_id, language_code, page_number, text to narrate: in a book's own language the extracted texts that aren't empty, in others the edition's translated ones, from narration_start_page (3 for none) to narration_end_page, or where that
    isn't set to two pages before the last of all its pages (the first one at least).

    asked: book_id, language_code; books: book_id, original_language, narration_start_page, narration_end_page; pages: book_id, page_number, extracted_text; translated: book_id, language_code, page_number, translated_text.
    """
    last = pages.groupBy("book_id").agg(F.max("page_number").alias("_last"))
    start = F.coalesce("narration_start_page", F.lit(3))
    bounds = asked.join(books, "book_id").join(last, "book_id", "left").select("book_id", "language_code", (F.col("language_code") == F.col("original_language")).alias("_own"), start.alias("_a"), F.coalesce("narration_end_page", F.greatest(start, F.col("_last") - 2)).alias("_b"))
    own = bounds.where("_own").join(pages.where("coalesce(extracted_text, '') <> ''").select("book_id", "page_number", F.col("extracted_text").alias("text")), "book_id")
    other = bounds.where("NOT coalesce(_own, false)").join(translated.select("book_id", "language_code", "page_number", F.col("translated_text").alias("text")), ["book_id", "language_code"])
    inside = F.col("page_number").between(F.col("_a"), F.col("_b"))
    columns = ["book_id", "language_code", "page_number", "text"]
    return own.where(inside).select(*columns).unionByName(other.where(inside).select(*columns))


def audit_summary(events: DataFrame) -> DataFrame:
    """book_id, languages (sorted), versions, renders, reviews, last_render, last_review: events are book_id, kind (translation, render, review, others), language_code, ts."""
    n = lambda k: F.count_if(F.col("kind") == k)
    when = lambda k: F.max(F.when(F.col("kind") == k, F.col("ts")))
    languages = F.array_sort(F.collect_set(F.when(F.col("kind") == "translation", F.col("language_code"))))
    return events.groupBy("book_id").agg(languages.alias("languages"), n("translation").alias("versions"), n("render").alias("renders"), n("review").alias("reviews"), when("render").alias("last_render"), when("review").alias("last_review"))


def job_states(changes: DataFrame) -> DataFrame:
    """job_id, status (of its last change; queued for none), active (queued or processing), started_at (of the last start), completed_at (of the last end, if it isn't started again since), seconds between (null while it runs). changes: job_id, seq, status, ts."""
    last = lambda *s: F.max_by(F.when(F.col("status").isin(*s), F.col("ts")), F.when(F.col("status").isin(*s), F.col("seq")))
    out = changes.groupBy("job_id").agg(F.coalesce(F.max_by("status", "seq"), F.lit("queued")).alias("status"), last("processing").alias("started_at"), last("completed", "failed").alias("_end"))
    ended = F.when(F.col("status").isin("completed", "failed"), F.col("_end"))
    out = out.select("job_id", "status", F.col("status").isin("queued", "processing").alias("active"), "started_at", ended.alias("completed_at"))
    return out.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started_at"), F.col("completed_at")))


def search_terms(events: DataFrame) -> DataFrame:
    """term, searches, without_result, last_day: each lower-cased, trimmed term of search events' payload (JSON: term, results), most searches first. A search without results, or with none counted as 0, had no result. events: type, payload, day, count."""
    term = F.lower(F.trim(F.get_json_object("payload", "$.term")))
    none = F.coalesce(F.get_json_object("payload", "$.results").cast("long"), F.lit(0)) == 0
    rows = events.where("type = 'search'").select(term.alias("term"), F.coalesce("count", F.lit(1)).alias("n"), none.alias("none"), "day").where("coalesce(term, '') <> ''")
    return rows.groupBy("term").agg(F.sum("n").cast("long").alias("searches"), F.coalesce(F.sum(F.when(F.col("none"), F.col("n"))), F.lit(0)).cast("long").alias("without_result"), F.max("day").alias("last_day"))


def audit_versions(events: DataFrame, group: str, order: str, content: str) -> DataFrame:
    """Adds version (from 1 in each group, by order) and content_hash (12 hex digits)."""
    w = Window.partitionBy(group).orderBy(order)
    return events.withColumn("version", F.row_number().over(w)).withColumn("content_hash", F.substring(F.md5(F.coalesce(F.col(content), F.lit(""))), 1, 12))


def job_monitor(events: DataFrame, key: str) -> DataFrame:
    """key, last_type, events, seconds between its first and last event."""
    seconds = F.expr("timestampdiff(SECOND, min(ts), max(ts))")
    return events.groupBy(key).agg(F.max_by("event_type", "event_id").alias("last_type"), F.count("*").alias("events"), seconds.alias("seconds"))


def discovery_rollup(events: DataFrame) -> DataFrame:
    """event_type, day (text), n."""
    return events.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


def payload_report(events: DataFrame, field: str) -> DataFrame:
    """term, n: how often each value of a payload field occurs."""
    return events.select(F.get_json_object("props", f"$.{field}").alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


def crop_fraction(value: Column, enabled: Column) -> Column:
    """Clamped to 0..0.45; 0 where disabled or unset."""
    return F.when(enabled & value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.45), value))).otherwise(0.0)


def action_audit(events: DataFrame, action: str, value: str) -> DataFrame:
    """action, n, spent: how often each action was taken, and what it cost in all (4 digits)."""
    return events.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("spent"))


def append_audit(events: DataFrame, folder: str, kind: str = "kind") -> DataFrame:
    """Appends events to an audit folder, a subfolder for each kind, and returns all that it holds; rows are never changed. A null kind has a subfolder of its own."""
    events.write.mode("append").partitionBy(kind).parquet(folder)
    return events.sparkSession.read.schema(events.schema).parquet(folder).select(*events.columns)


#: The most bytes and pages of a file.
MOST_BYTES, MOST_PAGES = 100 * 1024 * 1024, 500


def file_risks(files: DataFrame) -> DataFrame:
    """file_id, threat (oversized_file), warning (many_pages, which an oversized file isn't looked at for) and safe. files: file_id, bytes, pages."""
    large = F.col("bytes") > MOST_BYTES
    return files.select("file_id", F.when(large, "oversized_file").alias("threat"), F.when(~F.coalesce(large, F.lit(False)) & (F.col("pages") > MOST_PAGES), "many_pages").alias("warning"), (~F.coalesce(large, F.lit(False))).alias("safe"))
