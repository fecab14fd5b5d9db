"""Quality gates: monotone check merges, readiness, coverage, scorecards and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_checks(checks: DataFrame) -> DataFrame:
    """candidate_id, check_name, status: once failed a check stays failed; else the status with the largest seq."""
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise(F.max_by("status", "seq"))
    return checks.groupBy("candidate_id", "check_name").agg(status.alias("status"))


#: Checks that must have passed before anything is published.
REQUIRED = ("structure", "fit", "target_mapping")


def publishable(merged: DataFrame, issues: DataFrame, artwork: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """candidate_id, publishable of every candidate with a check, an issue or an artwork flag: some check, none failed, no issue at all, every required check passed, and no artwork that waits for approval.

    merged as of merge_checks(); issues: candidate_id; artwork: candidate_id, requires_artwork_approval (once required it stays so). Issues and flags of reports that are merged are put one after another.
    """
    every = F.lit(True)
    for c in required:
        every = every & F.coalesce(F.bool_or((F.col("check_name") == c) & (F.col("status") == "passed")), F.lit(False))
    checked = merged.groupBy("candidate_id").agg((~F.bool_or(F.col("status") == "failed") & every).alias("_ok"))
    told = issues.groupBy("candidate_id").agg(F.lit(True).alias("_issue"))
    waits = artwork.groupBy("candidate_id").agg(F.coalesce(F.bool_or("requires_artwork_approval"), F.lit(False)).alias("_waits"))
    both = checked.join(told, "candidate_id", "full_outer").join(waits, "candidate_id", "full_outer")
    no = F.lit(False)
    return both.select("candidate_id", (F.coalesce("_ok", no) & ~F.coalesce("_issue", no) & ~F.coalesce("_waits", no)).alias("publishable"))


REPORT = "checks map<string,string>, issues array<struct<code: string, stage: string, page: int, region_id: string>>, requires_artwork_approval boolean"


def merged_reports(reports: DataFrame) -> DataFrame:
    """candidate_id, checks (map, by name), issues (in order of their reports), requires_artwork_approval, publishable: the reports of a candidate merged. reports: candidate_id, seq, report (a struct as of REPORT; null parts are empty).

    A check that failed once stays failed, else its last status counts; issues are put together; the flag stays once set. Merging in parts gives the same. A candidate's issues are one array.
    """
    rows = reports.select("candidate_id", "seq", "report.*")
    merged = merge_checks(rows.select("candidate_id", "seq", F.explode("checks").alias("check_name", "status")))
    checks = merged.groupBy("candidate_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check_name", "status")))).alias("checks"))
    rest = rows.groupBy("candidate_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("issues", F.array().cast(rows.schema["issues"].dataType)).alias("i")))), lambda x: x["i"])).alias("issues"), F.coalesce(F.bool_or("requires_artwork_approval"), F.lit(False)).alias("requires_artwork_approval"))
    able = publishable(merged, rows.where("size(issues) > 0").select("candidate_id"), rows.select("candidate_id", "requires_artwork_approval"))
    both = rest.join(checks, "candidate_id", "left").join(able, "candidate_id", "left")
    return both.select("candidate_id", F.coalesce("checks", F.create_map().cast("map<string,string>")).alias("checks"), "issues", "requires_artwork_approval", F.coalesce("publishable", F.lit(False)).alias("publishable"))


def fresh_approvals(approvals: DataFrame, current: DataFrame) -> DataFrame:
    """Approvals with the current fingerprint and hash of their candidate; two nulls agree."""
    now = current.select(F.col("candidate_id").alias("_c"), F.col("fingerprint").alias("_f"), F.col("output_hash").alias("_h"))
    return approvals.join(now, (F.col("candidate_id") == F.col("_c")) & F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("output_hash").eqNullSafe(F.col("_h")), "left_semi")


def approval_progress(pages: DataFrame, approvals: DataFrame) -> DataFrame:
    """edition_id, approved, total, complete of every edition with a page or an approval: approvals of pages that are gone never make approved more than the pages there are; complete needs a page.

    pages: edition_id, page_number; approvals: edition_id, page_number, approved (a page's one entry).
    """
    n = pages.groupBy("edition_id").agg(F.count("*").alias("_n"))
    k = approvals.groupBy("edition_id").agg(F.count_if(F.coalesce("approved", F.lit(False))).alias("_k"))
    both = n.join(k, "edition_id", "full_outer")
    zero = F.lit(0).cast("long")
    total = F.coalesce("_n", zero)
    out = both.select("edition_id", F.least(F.coalesce("_k", zero), total).alias("approved"), total.alias("total"))
    return out.withColumn("complete", (F.col("total") > 0) & (F.col("approved") == F.col("total")))


def gate_report(checks: DataFrame, severity: Column) -> DataFrame:
    """candidate_id, total, passed_checks, passed, needs_review, score: error or critical failures fail, warnings ask for review."""
    failed = F.col("status") == "failed"
    rows = checks.withColumn("_s", severity)
    out = rows.groupBy("candidate_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed_checks"),
        (~F.coalesce(F.bool_or(failed & F.col("_s").isin("error", "critical")), F.lit(False))).alias("passed"),
        F.coalesce(F.bool_or(failed & (F.col("_s") == "warning")), F.lit(False)).alias("needs_review"))
    return out.withColumn("score", F.bround(F.col("passed_checks") * 100.0 / F.col("total"), 3))


def scorecard(rows: DataFrame, valid: Column, cover: Column, visual: Column, overflow: Column) -> DataFrame:
    """Adds release_score, the mean of validation (100 or 0), coverage, visual check (100 or 50) and 100 - 10 * overflow (0 at least), and blocked."""
    parts = [F.when(valid, 100.0).otherwise(0.0), cover.cast("double"), F.when(visual, 100.0).otherwise(50.0), F.greatest(F.lit(0.0), 100 - 10.0 * overflow)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return rows.withColumn("release_score", total / 4).withColumn("blocked", ~valid)


def regressions(runs: DataFrame, last: int = 5) -> DataFrame:
    """book_id, run_id and the alarms against the mean of at most last runs before: slower than 1.5 times, coverage over 5 points less, size off by over a fifth. First runs raise none."""
    before = Window.partitionBy("book_id").orderBy("ts", "run_id").rowsBetween(-last, -1)
    mean = {c: F.avg(c).over(before) for c in ("render_time_sec", "coverage_pct", "file_size_kb")}
    return runs.select(
        "book_id", "run_id",
        F.coalesce(F.col("render_time_sec") > 1.5 * mean["render_time_sec"], F.lit(False)).alias("slower"),
        F.coalesce(F.col("coverage_pct") < mean["coverage_pct"] - 5, F.lit(False)).alias("less_covered"),
        F.coalesce(F.abs(F.col("file_size_kb") - mean["file_size_kb"]) > 0.2 * mean["file_size_kb"], F.lit(False)).alias("resized"))


# The scores of a region, with their weights in the overall score and the thresholds under which a person looks.
SCORES = {
    "extraction": (0.1, 0.8), "semantic_role": (0.1, 0.7), "translation": (0.25, 0.8), "font_match": (0.1, 0.6), "removal": (0.15, 0.9), "layout_fit": (0.15, 0.85), "visual_similarity": (0.15, 0.8),
}


def confidence(rows: DataFrame, scores: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds overall (weighted mean, half-even to 3 digits), below (a map of the scores under their threshold) and review_required (some are). Scores are columns of rows; those that are missing or null count as 1. scores: name -> (weight, threshold)."""
    scores = scores or SCORES
    value = {c: F.coalesce(F.col(c), F.lit(1.0)) if c in rows.columns else F.lit(1.0) for c in scores}
    mean = sum((value[c] * w for c, (w, _) in scores.items()), F.lit(0.0)) / sum(w for w, _ in scores.values())
    low = F.array_compact(F.array(*[F.when(value[c] < t, F.struct(F.lit(c), value[c])) for c, (_, t) in scores.items()]))
    return rows.withColumn("overall", F.bround(mean, 3)).withColumn("below", F.map_from_entries(low)).withColumn("review_required", F.size(low) > 0)


def status_by_events(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """key and the state of its last event."""
    return events.groupBy(key).agg(F.max_by(state, order).alias(state))


# Fields of a region that a reviewer may change, and what each kind of edit undoes.
REGION_FIELDS = ["translation", "font_role", "translation_policy", "container"]
LAYOUT_TRACKS, TEXT_TRACKS = ["layout", "artwork"], ["language", "narration"]


def invalidated(approvals: DataFrame, edits: DataFrame) -> DataFrame:
    """approvals and whether a later edit undoes each (stale).

    approvals: edition_id, track (page, layout, artwork, language, or narration for a completed one), page_number (of a page's; else null), given_at. edits: edition_id, page_number, fields, edited_at: a page's new text (fields
    null) undoes that page's approval and the edition's narration; an edit of a region's fields undoes layout and artwork, and language and narration too where its translation changed. Other fields undo nothing.
    """
    region = F.col("fields").isNotNull()
    known = region & F.arrays_overlap("fields", F.array(*[F.lit(x) for x in REGION_FIELDS]))
    told = lambda when, tracks: F.when(when, F.array(*[F.lit(x) for x in tracks])).otherwise(F.array().cast("array<string>"))
    hit = F.concat(told(~region, ["page", "narration"]), told(known, LAYOUT_TRACKS), told(region & F.array_contains(F.coalesce("fields", F.array().cast("array<string>")), "translation"), TEXT_TRACKS))
    undone = edits.select("edition_id", F.explode(hit).alias("track"), "page_number", "edited_at").withColumn("_p", F.when(F.col("track") == "page", F.col("page_number"))).groupBy("edition_id", "track", "_p").agg(F.max("edited_at").alias("_e"))
    a = approvals.withColumn("_p", F.when(F.col("track") == "page", F.col("page_number")))
    undone = undone.select(F.col("edition_id").alias("_i"), F.col("track").alias("_t"), F.col("_p").alias("_q"), "_e")
    both = a.join(undone, (F.col("edition_id") == F.col("_i")) & (F.col("track") == F.col("_t")) & F.col("_p").eqNullSafe(F.col("_q")), "left")
    return both.select(*approvals.columns, F.coalesce(F.col("_e") > F.col("given_at"), F.lit(False)).alias("stale"))


def decoded_report(report: Column) -> Column:
    """A stored report (JSON text) as VARIANT; one that was encoded twice is decoded again; null for anything but an object or a list."""
    once = F.try_parse_json(report)
    text = F.try_variant_get(once, "$", "string")
    twice = F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(text)).otherwise(once)
    return F.when(F.schema_of_variant(twice).rlike("^(OBJECT|ARRAY)"), twice)


# States in which nothing is published.
BLOCKING = ["NEEDS_LAYOUT_REVIEW", "NEEDS_LANGUAGE_REVIEW", "RENDERING", "AUTOMATED_QA"]
TRACKS = "map<string,struct<approved: boolean, fingerprint: string, output_sha256: string>>"


def edition_readiness(editions: DataFrame, approvals: tuple[str, ...] = ()) -> DataFrame:
    """candidate_id, ready, codes: BLOCKING_RENDER_STATE:<state> alone in a blocking state, else what candidate_readiness() says of the stored report and approval tracks.

    editions: candidate_id, render_status, render_fingerprint, output_sha256, qa_report and approval_tracks (JSON). A required check counts if the report (its part qa, where that has checks, else itself) says passed; it is bound to
    the edition's present fingerprint and output. An approved track is bound to those it was given for. approvals: tracks that must be approved.
    """
    v = decoded_report(F.col("qa_report"))
    checks = F.coalesce(F.try_variant_get(v, "$.qa.checks", "map<string,string>"), F.try_variant_get(v, "$.checks", "map<string,string>"))
    known = editions.select("candidate_id", "render_status", F.coalesce("render_fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("output_sha256", F.lit("")).alias("output_sha256"), checks.alias("_checks"), F.from_json("approval_tracks", TRACKS).alias("_tracks"))
    blocked = F.coalesce(F.col("render_status").isin(*BLOCKING), F.lit(False))
    open_ = known.where(~blocked)
    asked = lambda keys: F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    candidates = open_.select("candidate_id", "fingerprint", "output_sha256", asked(REQUIRED).alias("required_checks"), asked(approvals).alias("required_approvals"))
    passed = open_.select("candidate_id", "fingerprint", "output_sha256", F.explode("_checks").alias("key", "status")).where(F.col("key").isin(*REQUIRED) & (F.col("status") == "passed"))
    given = open_.select("candidate_id", F.explode("_tracks").alias("key", "t")).where("t.approved").select("candidate_id", "key", F.lit("approved").alias("status"), F.col("t.fingerprint").alias("candidate_fingerprint"), F.col("t.output_sha256").alias("output_sha256"))
    found = candidate_readiness(candidates, passed.withColumnRenamed("fingerprint", "candidate_fingerprint"), given)
    held = known.where(blocked).select("candidate_id", F.lit(False).alias("ready"), F.array(F.concat(F.lit("BLOCKING_RENDER_STATE:"), "render_status")).alias("codes"))
    return found.unionByName(held)


def deviation_pages(editions: DataFrame) -> DataFrame:
    """edition_id, page_number of pages that a stored report (qa_report) tells of: the entries of structureDeviations, else of review_pages. An entry that is a whole number is a page, else a numeric key is one, else the entry's number; 0 is none."""
    v = decoded_report(F.col("qa_report"))
    first = F.try_variant_get(v, "$.structureDeviations", "variant")
    there = first.isNotNull() & ~F.is_variant_null(first)
    at = lambda kind: F.when(there, F.try_variant_get(v, "$.structureDeviations", kind)).otherwise(F.try_variant_get(v, "$.review_pages", kind))
    rows = editions.select("edition_id", at("array<variant>").alias("_a"), at("map<string,variant>").alias("_m"))
    entries = rows.select("edition_id", F.posexplode("_a").alias("k", "x")).select("edition_id", F.col("k").cast("string").alias("k"), "x").unionByName(rows.select("edition_id", F.explode("_m").alias("k", "x")))
    whole = F.when(F.schema_of_variant("x") == "BIGINT", F.try_variant_get("x", "$", "long"))
    keyed = F.when(F.col("k").rlike(r"^\s*[+-]?\d+(\.\d*)?$"), F.expr("try_cast(k AS double)").cast("long"))
    loose = F.coalesce(F.expr("try_cast(regexp_extract(try_variant_get(x, '$', 'string'), '^[ \t]*[+-]?[0-9]+', 0) AS long)"), F.lit(0).cast("long"))
    return entries.select("edition_id", F.coalesce(whole, keyed, loose).alias("page_number")).where("page_number <> 0").distinct()


def review_queue(pages: DataFrame, editions: DataFrame, only: str = "all") -> DataFrame:
    """The pages to review, with place (from 1, by page_number), quality_flag (gray for none), review_status (unreviewed for none) and has_deviation (the stored report tells of the page): flagged ones (yellow, red), approved or rejected ones, or all.

    pages: edition_id, page_number, quality_flag, review_status and others; editions: edition_id, qa_report.
    """
    kept = pages
    if only == "flagged":
        kept = pages.where(F.col("quality_flag").isin("yellow", "red"))
    elif only in ("approved", "rejected"):
        kept = pages.where(F.col("review_status") == only)
    told = deviation_pages(editions).withColumn("has_deviation", F.lit(True))
    out = kept.join(told, ["edition_id", "page_number"], "left").withColumns({"has_deviation": F.coalesce("has_deviation", F.lit(False)), "quality_flag": F.coalesce("quality_flag", F.lit("gray")), "review_status": F.coalesce("review_status", F.lit("unreviewed"))})
    return out.withColumn("place", F.row_number().over(Window.partitionBy("edition_id").orderBy("page_number")))


def reviewer_list(pages: DataFrame, originals: DataFrame, editions: DataFrame, only: str = "all") -> DataFrame:
    """The translated pages of all statuses, or of one, each with original_text ('' where the book has no such page). pages: edition_id, page_number, review_status and others; originals: book_id, page_number, extracted_text; editions: edition_id, book_id."""
    kept = pages if only == "all" else pages.where(F.col("review_status") == only)
    texts = originals.groupBy("book_id", "page_number").agg(F.min("extracted_text").alias("_t"))
    return kept.join(editions.select("edition_id", "book_id"), "edition_id").join(texts, ["book_id", "page_number"], "left").select(*pages.columns, F.coalesce("_t", F.lit("")).alias("original_text"))


def review_stats(pages: DataFrame) -> DataFrame:
    """edition_id, total, approved, unreviewed, needs_edit, avg_score (of the scores there are, 1 digit, 0 for none). pages: edition_id, review_status, confidence_score."""
    n = lambda s: F.count_if(F.col("review_status") == s).alias(s)
    return pages.groupBy("edition_id").agg(F.count("*").alias("total"), n("approved"), n("unreviewed"), n("needs_edit"), F.round(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 1).alias("avg_score"))


def flagged_pages(pages: DataFrame, records: DataFrame, inputs: DataFrame) -> DataFrame:
    """edition_id, page_number, status, flagged of every page to be looked at: the status of its last record (by seq), not_run without one, or where the edition's source or output is missing; whatever isn't passed is flagged.

    pages: edition_id, page_number; records: edition_id, page_number, seq, status; inputs: edition_id, complete (both files are there; not listed: no).
    """
    last = records.groupBy("edition_id", "page_number").agg(F.max_by("status", "seq").alias("_s"))
    there = inputs.groupBy("edition_id").agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("_c"))
    both = pages.distinct().join(last, ["edition_id", "page_number"], "left").join(there, "edition_id", "left")
    status = F.when(F.coalesce("_c", F.lit(False)), F.coalesce("_s", F.lit("not_run"))).otherwise("not_run")
    return both.select("edition_id", "page_number", status.alias("status"), (status != "passed").alias("flagged"))


def overflow(spans: DataFrame, width: float, height: float, margin: float = 2.0) -> DataFrame:
    """page_id and the first span_no that leaves the trim box less margin."""
    out = (F.col("x0") < margin) | (F.col("y0") < margin) | (F.col("x1") > width - margin) | (F.col("y1") > height - margin)
    return spans.where(out).groupBy("page_id").agg(F.min("span_no").alias("span_no"))


def overprints(spans: DataFrame, least: float = 0.5, share: float = 0.45, bucket: float = 40.0) -> DataFrame:
    """page_id of pages where two boxes overlap by more than least both ways and by share of the lower one's height.

    Boxes meet by page and band of height bucket, in every band that they touch, so no page is joined with all of itself;
    bucket only shapes the work.
    """
    bands = F.sequence(F.floor(F.col("y0") / bucket), F.floor(F.col("y1") / bucket))
    rows = spans.select("page_id", "span_no", "x0", "y0", "x1", "y1", F.explode(bands).alias("band"))
    other = rows.select("page_id", "band", *[F.col(c).alias(f"{c}_o") for c in ("span_no", "x0", "y0", "x1", "y1")])
    across = F.least("x1", "x1_o") - F.greatest("x0", "x0_o")
    down = F.least("y1", "y1_o") - F.greatest("y0", "y0_o")
    shorter = F.least(F.col("y1") - F.col("y0"), F.col("y1_o") - F.col("y0_o"))
    pairs = rows.join(other, ["page_id", "band"]).where((F.col("span_no") < F.col("span_no_o")) & (across > least) & (down > least) & (down >= share * shorter))
    return pairs.select("page_id").distinct()


def least_sizes(rows: DataFrame, default: float, floors: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds least_size: the largest of the default and the floors (column, table with it and floor) that apply."""
    out, cols = rows, []
    for i, (col, floor) in enumerate(floors):
        out = out.join(floor.select(col, F.col("floor").alias(f"_f{i}")), col, "left")
        cols.append(F.col(f"_f{i}"))
    return out.withColumn("least_size", F.greatest(F.lit(default), *[F.coalesce(c, F.lit(0.0)) for c in cols])).drop(*[f"_f{i}" for i in range(len(floors))])


def contained_lines(words_: DataFrame, regions: DataFrame, slack: float = 2.0, margin: float = 1.0) -> DataFrame:
    """page_id, region, lines, boxes, clipped, and the bounds bx0, by0, bx1, by1 (1 digit) of the boxes whose centre lies in a region (widened by slack) of their page: lines are their different rounded tops, clipped those that leave the
    region by over margin. A region without boxes has no lines, no clipped ones and null bounds.
    """
    box = ("x0", "y0", "x1", "y1")
    r = regions.select("page_id", "region", *[F.col(c).alias(f"{c}_r") for c in box])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("x0_r") - slack, F.col("x1_r") + slack) & cy.between(F.col("y0_r") - slack, F.col("y1_r") + slack)
    out = (F.col("x0") < F.col("x0_r") - margin) | (F.col("x1") > F.col("x1_r") + margin) | (F.col("y0") < F.col("y0_r") - margin) | (F.col("y1") > F.col("y1_r") + margin)
    bounds = [F.bround(f(c), 1).alias(f"b{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    found = words_.join(r, "page_id").where(inside).groupBy("page_id", "region").agg(F.count_distinct(F.bround("y0")).alias("lines"), F.count("*").alias("boxes"), F.count_if(out).alias("clipped"), *bounds)
    zero = F.lit(0).cast("long")
    return regions.select("page_id", "region").join(found, ["page_id", "region"], "left").select("page_id", "region", *[F.coalesce(c, zero).alias(c) for c in ("lines", "boxes", "clipped")], *[f"b{c}" for c in box])


def candidate_readiness(candidates: DataFrame, checks: DataFrame, approvals: DataFrame) -> DataFrame:
    """candidate_id, ready, codes (sorted, as CODE:key): every required check must have passed, and every required approval be given, for the candidate's present fingerprint and output.

    candidates: candidate_id, fingerprint, output_sha256, required_checks and required_approvals (arrays; repeated keys count once). checks, approvals: candidate_id, key, status,
    candidate_fingerprint, output_sha256; of several records of one key all must do. No fingerprint, no hash or no required check: INVALID_GATE_INPUT alone.
    """
    invalid = (F.coalesce("fingerprint", F.lit("")) == "") | (F.coalesce("output_sha256", F.lit("")) == "") | (F.size(F.coalesce("required_checks", F.array().cast("array<string>"))) == 0)
    now = candidates.select("candidate_id", "fingerprint", "output_sha256", "required_checks", "required_approvals", invalid.alias("_invalid"))

    def stale(records: DataFrame, required: str, status: str, code: str) -> DataFrame:
        asked = now.where("NOT _invalid").select("candidate_id", "fingerprint", F.col("output_sha256").alias("_hash"), F.explode(F.array_distinct(required)).alias("key"))
        both = asked.join(records.select("candidate_id", "key", "status", "candidate_fingerprint", "output_sha256"), ["candidate_id", "key"], "left")
        met = F.coalesce((F.col("status") == status) & (F.col("candidate_fingerprint") == F.col("fingerprint")) & (F.col("output_sha256") == F.col("_hash")), F.lit(False))
        open_ = both.groupBy("candidate_id", "key").agg(F.bool_and(met).alias("_met")).where("NOT _met")
        return open_.select("candidate_id", F.concat(F.lit(f"{code}:"), "key").alias("code"))

    issues = stale(checks, "required_checks", "passed", "CHECK_UNRESOLVED_OR_STALE").unionByName(stale(approvals, "required_approvals", "approved", "APPROVAL_PENDING_OR_STALE"))
    issues = issues.unionByName(now.where("_invalid").select("candidate_id", F.lit("INVALID_GATE_INPUT").alias("code")))
    codes = issues.groupBy("candidate_id").agg(F.array_sort(F.collect_list("code")).alias("_codes"))
    return now.select("candidate_id").join(codes, "candidate_id", "left").select("candidate_id", F.col("_codes").isNull().alias("ready"), F.coalesce("_codes", F.array().cast("array<string>")).alias("codes"))


def state_guards(editions: DataFrame, pages: DataFrame, ready: DataFrame, source: str = "en") -> DataFrame:
    """candidate_id, may_approve (all pages approved, one at least, and ready), may_publish, may_narrate (once approved) and store_visible; the last three always hold for the source language.

    editions: candidate_id, language_code, render_status; pages: candidate_id, approved; ready: candidate_id, ready. What isn't known counts as no.
    """
    progress = pages.groupBy("candidate_id").agg(F.bool_and(F.coalesce("approved", F.lit(False))).alias("_all"))
    both = editions.join(progress, "candidate_id", "left").join(ready.select("candidate_id", F.col("ready").alias("_ready")), "candidate_id", "left")
    ok, own = F.coalesce("_ready", F.lit(False)), F.coalesce(F.col("language_code") == source, F.lit(False))
    return both.select("candidate_id", (F.coalesce("_all", F.lit(False)) & ok).alias("may_approve"), (own | ok).alias("may_publish"), (own | F.coalesce(F.col("render_status") == "approved", F.lit(False))).alias("may_narrate"), (own | ok).alias("store_visible"))


def coverage(books: DataFrame, expected: DataFrame, records: DataFrame) -> DataFrame:
    """book_id, page_number, code of every issue: a page's first record (by seq) counts, further ones and those of unexpected pages are UNEXPECTED_OR_DUPLICATE_PAGE each.

    books: book_id, fingerprint. records: book_id, page_number, seq, status, candidate_fingerprint. A book without expected pages has EMPTY_EXPECTED_PAGE_SET alone.
    """
    pages = expected.join(books, "book_id").select("book_id", "page_number", "fingerprint").distinct()
    order = Window.partitionBy("book_id", "page_number").orderBy("seq")
    known = books.select("book_id").join(pages.select("book_id").distinct(), "book_id", "left_semi")
    seen = records.join(known, "book_id", "left_semi").withColumn("_r", F.row_number().over(order))
    both = pages.join(seen, ["book_id", "page_number"], "full_outer")
    code = (
        F.when(F.col("fingerprint").isNull() | (F.col("_r") > 1), "UNEXPECTED_OR_DUPLICATE_PAGE").when(F.col("_r").isNull(), "PAGE_NOT_CHECKED")
        .when(~F.col("candidate_fingerprint").eqNullSafe(F.col("fingerprint")), "STALE_VISUAL_RESULT").when(~F.col("status").eqNullSafe(F.lit("passed")), "VISUAL_CHECK_UNRESOLVED")
    )
    found = both.select("book_id", "page_number", code.alias("code")).where("code IS NOT NULL")
    empty = books.join(known, "book_id", "left_anti").select("book_id", F.lit(None).cast(expected.schema["page_number"].dataType).alias("page_number"), F.lit("EMPTY_EXPECTED_PAGE_SET").alias("code"))
    return found.unionByName(empty)


# Roles that are headings, body, or alike in size on a page, and how far peers may vary.
HEADINGS = ["heading", "table_header", "book_title", "subtitle", "list_heading", "cover_title", "cover_subtitle"]
BODIES = ["paragraph", "word_list_item", "table_cell", "list_item", "caption", "word_item", "copyright", "imprint"]
PEERS = ["table_cell", "table_header", "word_item", "word_list_item", "list_item"]
PEER_SPREAD, SIZE_SLACK = 0.15, 0.05


def typography(units: DataFrame, least: float = 9.0) -> DataFrame:
    """page_id, failure, role (null for failures of the page): text under least, headings not larger on average than body, table headers smaller than cells, peers' sizes apart by over a seventh.

    units: page_id, role, font_size; sizes that are null or 0 don't count. Cells are table_cell, else word_item, else word_list_item.
    """
    rows = units.where("font_size > 0")
    role = rows.groupBy("page_id", "role").agg(F.min("font_size").alias("lo"), F.max("font_size").alias("hi"), F.count("*").alias("n"))
    small = role.where(F.col("lo") + SIZE_SLACK < least).select("page_id", F.lit("minReadableSize").alias("failure"), "role")
    uneven = role.where(F.col("role").isin(*PEERS) & (F.col("n") >= 2) & ((F.col("hi") - F.col("lo")) / F.col("lo") > PEER_SPREAD)).select("page_id", F.lit("peerRegionVariance").alias("failure"), "role")
    mean = lambda *roles: F.avg(F.when(F.col("role").isin(*roles), F.col("font_size")))
    page = rows.groupBy("page_id").agg(mean(*HEADINGS).alias("heading"), mean(*BODIES).alias("body"), mean("table_header").alias("header"), F.coalesce(mean("table_cell"), mean("word_item"), mean("word_list_item")).alias("cell"))
    none = F.lit(None).cast("string").alias("role")
    low = page.where("heading <= body").select("page_id", F.lit("typographyHierarchy").alias("failure"), none)
    header = page.where(F.col("header") + SIZE_SLACK < F.col("cell")).select("page_id", F.lit("tableHeaderHierarchy").alias("failure"), none)
    return small.unionByName(uneven).unionByName(low).unionByName(header)


def size_consistency(spans: DataFrame, pages: DataFrame, gap: float = 0.18) -> DataFrame:
    """page_id, clusters, uneven for cover and back_cover pages: lines' sizes (a line's largest box, 1 digit) fall into clusters where the next is over gap larger. Two clusters of two lines
    or more are uneven, else a cluster of two or more whose largest is over 1 + gap times its smallest.
    """
    wanted = pages.where(F.col("page_type").isin("cover", "back_cover")).select("page_id").distinct()
    lines = spans.where("trim(text) <> ''").join(wanted, "page_id", "left_semi").groupBy("page_id", "line_no").agg(F.max(F.bround("font_size", 1)).alias("size")).where("size > 0")
    order = Window.partitionBy("page_id").orderBy("size", "line_no")
    new = F.coalesce((F.col("size") - F.lag("size").over(order)) / F.lag("size").over(order) > gap, F.lit(True))
    numbered = lines.withColumn("_new", new.cast("int")).withColumn("_c", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sized = numbered.groupBy("page_id", "_c").agg(F.count("*").alias("_n"), F.min("size").alias("_lo"), F.max("size").alias("_hi"))
    several = F.col("_n") >= 2
    return sized.groupBy("page_id").agg(F.count("*").alias("clusters"), ((F.count_if(several) >= 2) | F.bool_or(several & (F.col("_hi") / F.col("_lo") > 1 + gap))).alias("uneven"))


# Parts of the names of fonts that stand in for missing ones.
FALLBACKS = ["charissil", "charis", "nimbussans", "nimbus", "helvetica", "helv", "timesnewroman", "times", "courier", "sans-serif"]


def is_fallback(font: Column, approved: list[str]) -> Column:
    """Whether a font's name, letters and digits alone, holds a fallback's, and neither holds an approved one's nor is held by one."""
    name = F.regexp_replace(F.lower(F.coalesce(font, F.lit(""))), "[^a-z0-9]", "")

    def judged(plain: Column) -> Column:
        stands_in, known = F.lit(False), F.lit(False)
        for m in FALLBACKS:
            stands_in = stands_in | plain.contains(m)
        for stem in approved:
            known = known | plain.contains(stem) | F.lit(stem).contains(plain)
        return stands_in & ~known

    # a list of one, so that the name is made plain once and not for each comparison
    return F.transform(F.array(name), judged)[0]


def font_fidelity(spans: DataFrame, approved: list[str], least: int = 8) -> DataFrame:
    """page_id, font_name, drawn (characters) of fallback fonts that draw least characters or more; without approved fonts there is nothing to say."""
    drawn = spans.where("trim(text) <> ''").groupBy("page_id", "font_name").agg(F.sum(F.length(F.trim("text"))).alias("drawn"))
    return drawn.where((F.col("drawn") >= least) & (is_fallback(F.col("font_name"), approved) if approved else F.lit(False)))


def semantics(expected: DataFrame, words_: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, failure, unit_no: missingUnit where a unit's first word isn't in its page's text, listOrder (unit_no null) where numbers from 1 to 20 don't grow from top to bottom of a back_cover.

    expected: page_id, unit_no, text; words_: page_id, word_no, y0, text; pages: page_id, page_type. Pages without expected units aren't looked at.
    """
    norm = F.trim(F.regexp_replace(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")), r"\s+", " "))
    shown = words_.groupBy("page_id").agg(norm.alias("_norm"))
    first = F.lower(F.coalesce(F.regexp_extract(F.trim("text"), r"^\S+", 0), F.lit("")))
    units = expected.select("page_id", "unit_no", first.alias("_first")).join(shown, "page_id", "left")
    missing = units.where((F.col("_first") != "") & ~F.coalesce(F.col("_norm").contains(F.col("_first")), F.lit(False))).select("page_id", F.lit("missingUnit").alias("failure"), "unit_no")
    asked = pages.where("page_type = 'back_cover'").join(expected.select("page_id").distinct(), "page_id", "left_semi")
    numbers = words_.where(F.col("text").rlike("^[0-9]{1,9}$")).withColumn("_n", F.col("text").cast("int")).where("_n BETWEEN 1 AND 20").join(asked, "page_id", "left_semi")
    back = numbers.withColumn("_b", F.col("_n") < F.lag("_n").over(Window.partitionBy("page_id").orderBy("y0", "word_no"))).where("_b")
    none = F.lit(None).cast(expected.schema["unit_no"].dataType)
    return missing.unionByName(back.select("page_id").distinct().select("page_id", F.lit("listOrder").alias("failure"), none.alias("unit_no")))


def missing_content(expected: DataFrame, drawn: DataFrame) -> DataFrame:
    """page_id of pages with expected text that isn't blank and no word drawn."""
    return expected.where("trim(coalesce(text, '')) <> ''").select("page_id").distinct().join(drawn.select("page_id").distinct(), "page_id", "left_anti")


def source_vs_output(source: DataFrame, output: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id, same_pages, resized, turned, images_lost, size_verdict of every document in files; the three counts and the verdict are null where the numbers of pages differ.

    source, output: doc_id, page_number, width, height, rotation, images; files: doc_id, source_bytes, output_bytes. Sizes may differ by 0.1; images are counted on the first five pages; an output
    over 5 times larger is larger, under a tenth smaller.
    """
    out = output.select("doc_id", "page_number", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "rotation", "images")], F.lit(True).alias("_o"))
    both = source.withColumn("_s", F.lit(True)).join(out, ["doc_id", "page_number"], "full_outer")
    found = both.groupBy("doc_id").agg(
        (F.count("_s") == F.count("_o")).alias("same_pages"), F.count_if((F.abs(F.col("width") - F.col("_width")) > 0.1) | (F.abs(F.col("height") - F.col("_height")) > 0.1)).alias("resized"),
        F.count_if(F.col("rotation") != F.col("_rotation")).alias("turned"), F.count_if((F.col("page_number") <= 5) & (F.col("images") > F.col("_images"))).alias("images_lost"),
    )
    ratio = F.col("output_bytes") / F.greatest("source_bytes", F.lit(1))
    joined = files.join(found, "doc_id", "left").withColumn("same_pages", F.coalesce("same_pages", F.lit(True)))
    only = lambda c: F.when(F.col("same_pages"), c)
    return joined.select("doc_id", "same_pages", *[only(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("resized", "turned", "images_lost")], only(F.when(ratio > 5, "larger").when(ratio < 0.1, "smaller").otherwise("ok")).alias("size_verdict"))


def sample_difference(a: DataFrame, b: DataFrame, masks: DataFrame, step: int = 4, most: float = 10.0) -> DataFrame:
    """page, samples, changed, percent (2 digits), threshold, passed: samples on a grid of step, outside the page's text boxes, whose mean channel difference is above most. Pages with boxes pass under 5 %, others under 40 %.

    a, b: page, x, y, r, g, b; masks: page, x0, y0, x1, y1 (edges count as inside).
    """
    on = (F.col("x") % step == 0) & (F.col("y") % step == 0)
    other = b.select("page", "x", "y", *[F.col(c).alias(f"{c}_b") for c in "rgb"])
    inside = (F.col("s.page") == F.col("m.page")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    seen = a.where(on).alias("s").join(masks.alias("m"), inside, "left_anti").join(other, ["page", "x", "y"])
    diff = (F.abs(F.col("r") - F.col("r_b")) + F.abs(F.col("g") - F.col("g_b")) + F.abs(F.col("b") - F.col("b_b"))) / 3
    counted = seen.groupBy("page").agg(F.count("*").alias("samples"), F.count_if(diff > most).alias("changed"))
    pages = a.select("page").distinct().join(counted, "page", "left").join(masks.select("page").distinct().withColumn("_m", F.lit(True)), "page", "left")
    n, k = F.coalesce("samples", F.lit(0).cast("long")), F.coalesce("changed", F.lit(0).cast("long"))
    out = pages.select("page", n.alias("samples"), k.alias("changed"), (100.0 * k / F.greatest(n, F.lit(1))).alias("_p"), F.when(F.col("_m"), 5).otherwise(40).alias("threshold"))
    return out.select("page", "samples", "changed", F.bround("_p", 2).alias("percent"), "threshold", (F.col("_p") < F.col("threshold")).alias("passed"))


# Roles whose boxes are exact, and those whose words may leave their column.
STRICT, LOOSE = ["heading", "table_header", "merged_header", "end_marker"], ["word_list_item", "phonics", "list_item"]


def structure(elements: DataFrame, spans: DataFrame, approved: list[str] | None = None, slack: float = 3.0) -> DataFrame:
    """page_id, failure, element_id of every expected element that the drawn page lacks or breaks, of peer groups (their id) of uneven sizes, and of pages (null) with invented text.

    elements: page_id, element_id, role, peer_group, x0, y0, x1, y1; spans: page_id, span_no, x0, y0, x1, y1, font_size, font_name, text. A box belongs to an element that holds its centre, slack more on each side.
    elementMissing: none does (elementOutOfColumn where text at its height leaves the column, for prose). elementOutOfBox: a strict role's text leaves the box by slack, a third of its height more up and down.
    elementOutOfColumn: prose leaves it sideways by slack or 6 % of its width. elementFont: a fallback font with four characters. peerSizeMismatch: strict peers apart by over 1.18, headers 2.1. elementInvented:
    text in the strict elements' common envelope and in none of them.
    """
    box = ["x0", "y0", "x1", "y1"]
    drawn = spans.where("trim(text) <> ''")
    e = elements.where("x0 IS NOT NULL").withColumn("role", F.lower(F.coalesce("role", F.lit(""))))
    s = drawn.select("page_id", "span_no", *[F.col(c).alias(f"s_{c}") for c in box], F.col("font_size").alias("s_size"), F.col("font_name").alias("s_font"), F.length(F.trim("text")).alias("s_len"))
    strict, loose = F.col("role").isin(*STRICT), F.col("role").isin(*LOOSE)
    cx, cy = (F.col("s_x0") + F.col("s_x1")) / 2, (F.col("s_y0") + F.col("s_y1")) / 2
    high = cy.between(F.col("y0") - slack, F.col("y1") + slack)
    inside = high & cx.between(F.col("x0") - slack, F.col("x1") + slack)
    near = high & (F.col("s_x1") > F.col("x0") - 200) & (F.col("s_x0") < F.col("x1") + 200)
    side = F.greatest(F.lit(slack), (F.col("x1") - F.col("x0")) * 0.06)
    spill = (F.col("s_x0") < F.col("x0") - side) | (F.col("s_x1") > F.col("x1") + side)
    tall = slack + (F.col("y1") - F.col("y0")) * 0.35
    out = (F.col("s_x0") < F.col("x0") - slack) | (F.col("s_x1") > F.col("x1") + slack) | (F.col("s_y0") < F.col("y0") - tall) | (F.col("s_y1") > F.col("y1") + tall)
    no = F.lit(False)
    font = is_fallback(F.col("s_font"), approved) & (F.col("s_len") >= 4) if approved else no
    any_ = lambda c: F.coalesce(F.bool_or(c), no)
    facts = e.join(s, "page_id", "left").groupBy("page_id", "element_id", "role", "peer_group").agg(
        any_(inside).alias("met"), any_(near & spill).alias("spilled"), any_(inside & out).alias("out"), any_(inside & spill).alias("aside"), any_(inside & font).alias("font"), F.max(F.when(inside, F.bround("s_size", 1))).alias("size"))
    column = ~strict & ~loose
    codes = F.array_compact(F.array(
        F.when(~F.col("met"), F.when(column & F.col("spilled"), "elementOutOfColumn").otherwise("elementMissing")),
        F.when(F.col("met") & strict & F.col("out"), "elementOutOfBox"), F.when(F.col("met") & column & F.col("aside"), "elementOutOfColumn"), F.when(F.col("met") & F.col("font"), "elementFont")))
    broken = facts.select("page_id", F.explode(codes).alias("failure"), "element_id")
    peers = facts.where(strict & F.col("met") & (F.coalesce("peer_group", F.lit("")) != "") & (F.col("size") > 0)).groupBy("page_id", "peer_group").agg(F.count("*").alias("n"), (F.max("size") / F.min("size")).alias("ratio"))
    uneven = peers.where((F.col("n") >= 2) & (F.col("ratio") > F.when(F.col("peer_group").contains("header"), 2.1).otherwise(1.18))).select("page_id", F.lit("peerSizeMismatch").alias("failure"), F.col("peer_group").alias("element_id"))
    bands = e.where(strict)
    band = bands.groupBy("page_id").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    within = s.join(band, "page_id").where(inside).drop(*box)
    place = ["page_id", "span_no", *(f"s_{c}" for c in box)]
    held = within.join(bands.select("page_id", *box), "page_id").where(inside).select(*place).distinct()
    invented = within.join(held, place, "left_anti").select("page_id").distinct().select("page_id", F.lit("elementInvented").alias("failure"), F.lit(None).cast("string").alias("element_id"))
    return broken.withColumn("element_id", F.col("element_id").cast("string")).unionByName(uneven).unionByName(invented)
