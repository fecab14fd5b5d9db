"""Rules of catalogue, reconciliation, gates and layout on inline rows, also odd ones."""

import math
import random
import time

from pyspark.sql import functions as F

from leafworks.operators import catalog, extras, gates, layout, reconcile, reporting
from leafworks.sources import ingest, views
from leafworks.streaming import feeds

from .test_operators import rows

EDITIONS = "edition_id int, book_id int, language_code string, reading_level string, education_phase string, price double, publication_status string"


def shop(spark):
    books = spark.createDataFrame([(1, "picture"), (2, "picture"), (3, "reader")], "book_id int, book_type string")
    editions = spark.createDataFrame([(10, 1, "af", "r1", "foundation", None, "published"), (11, 1, "en", "r2", None, 5.0, "published"), (20, 2, "af", "r2", "senior", 0.0, "published"), (21, 2, "en", "r1", None, 9.0, "draft"),
                                      (30, 3, "en", "r1", "foundation", 3.0, "published")], EDITIONS)
    features = spark.createDataFrame([(11, "narrated"), (20, "large_print"), (21, "narrated"), (30, "read_along"), (30, "read_along")], "edition_id int, feature string")
    return books, editions, features


def test_all_facets_hold_on_one_published_edition(spark):
    books, editions, features = shop(spark)
    cases = [
        (dict(language="af", narrated=True), []), (dict(language="en", narrated=True), [1, 3]), (dict(narrated=True, feature="narrated"), [1]), (dict(feature="large_print"), [2]), (dict(education_phase="foundation", narrated=True), [3]),
        (dict(reading_level="r1", price="free"), [1]), (dict(price="free"), [1, 2]), (dict(), [1, 2, 3]), (dict(language=""), [1, 2, 3]), (dict(narrated=True, feature="large_print"), []),
    ]
    asked = None
    for i, (facets, want) in enumerate(cases):
        assert rows(catalog.with_edition(books, editions, features, catalog.EditionFacets(**facets)), "book_id") == [(b,) for b in want]
        row = spark.range(1).select(F.lit(i).alias("ask_id"), catalog.EditionFacets(**facets).row().alias("facets"))
        asked = row if asked is None else asked.unionByName(row)
    assert rows(catalog.edition_matches(asked, editions, features), "ask_id", "book_id") == sorted([(i, b) for i, (_, want) in enumerate(cases) for b in want], key=str)


def test_rules_of_collections(spark):
    books, editions, features = shop(spark)
    links = spark.createDataFrame([(1, "animals"), (3, "animals"), (3, "animals"), (9, "animals")], "book_id int, slug string")
    rules = spark.createDataFrame([
        (1, '{"features":["narrated"]}'), (2, '{"features":["word_highlighting"],"language":["en","af"]}'), (3, '{"features":["large_print"]}'), (4, '{"language":"af","reading_level":"r2"}'), (5, '{"language":[],"other":1}'), (6, None),
        (7, '{"category":"animals"}'), (8, '{"category":"animals","book_type":"reader"}'), (9, '{"book_type":"picture","language":"en"}'), (10, '{"category":"none","language":"en"}'),
    ], "collection_id int, rules string")
    got = rows(extras.rule_matches(rules, books, editions, features, links), "collection_id", "book_id")
    want = {1: [1, 3], 2: [1, 3], 3: [1, 2, 3], 4: [2], 5: [1, 2, 3], 6: [1, 2, 3], 7: [1, 3], 8: [3], 9: [1], 10: []}
    assert got == sorted([(c, b) for c, found in want.items() for b in found], key=str)


def test_tags_follow_merges_and_new_ones_come_once(spark):
    tags = spark.createDataFrame([(1, "kind-ness", "Kindness", "active", None), (2, "old", "Old Name", "archived", 1), (3, "lost", "Lost", "active", 99), (4, "wait", "Waiting", "pending", None), (5, "far", "Far", "active", 2)],
                                 "tag_id int, slug string, canonical_name string, status string, merged_into int")
    labels = spark.createDataFrame([(1, "Vriendelik"), (4, "Dup"), (1, "dup")], "tag_id int, name string")
    aliases = spark.createDataFrame([(5, "afar"), (4, "vriendelik")], "tag_id int, name string")
    strings = spark.createDataFrame([(7, t) for t in (" KIND  NESS ", "old name", "vriendelik", "Dup", "AFAR", "lost", "wait", "New Tag!", "new_tag", "  ", None, "a@b")] + [(8, "new tag")], "book_id int, tag string")
    resolved, made = catalog.resolve_tags(strings, tags, labels, aliases)
    assert rows(resolved, "book_id", "tag_id", "slug", "group") == sorted([(7, 1, "kind-ness", "matched"), (7, 3, "lost", "matched"), (7, 4, "wait", "pending"), (7, None, "new-tag", "pending"), (7, None, "a-at-b", "pending"), (8, None, "new-tag", "pending")], key=str)
    assert rows(made, "slug") == [("a-at-b",), ("new-tag",)]


def test_merge_chains_stop_after_twenty_hops(spark):
    n = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(50, None), (70, 71), (71, 70), (80, 80), (90, 999)], "id long, merged_into long")
    want = {**{i: min(i + 20, 50) for i in range(51)}, 70: 70, 71: 71, 80: 80, 90: 90}
    assert {r.id: r.effective_id for r in catalog.effective_ids(n).collect()} == want
    for hops in (0, 1, 5, 7):
        got = {r.id: r.effective_id for r in catalog.effective_ids(n, "last", hops).collect()}
        assert [got[i] for i in range(40)] == [i + hops for i in range(40)] and got[70] == 70 + hops % 2


def test_collections_are_ranked_in_stretches(spark, monkeypatch):
    m = spark.createDataFrame([("c", i, i % 5 == 0, None if i % 7 == 0 else i % 3) for i in range(60)] + [("d", 1, False, 1)], "collection_id string, book_id int, pinned boolean, sort_order int")
    want = rows(catalog.collection_order(m), "collection_id", "book_id", "position")
    order = sorted(range(60), key=lambda i: (i % 5 != 0, -1 if i % 7 == 0 else i % 3, i))
    assert want == sorted([("c", b, k + 1) for k, b in enumerate(order)] + [("d", 1, 1)], key=str)
    monkeypatch.setattr(catalog, "STRETCH", 7)
    assert rows(catalog.collection_order(m), "collection_id", "book_id", "position") == want


def test_scope_options_chips_and_ticked_tags(spark):
    books = spark.createDataFrame([(1,), (2,)], "book_id int")
    collections = spark.createDataFrame([(5, "set"), (6, "empty")], "collection_id int, slug string")
    members = spark.createDataFrame([(5, 1), (5, 1), (5, 3)], "collection_id int, book_id int")
    for slug, want in (("set", [(1,)]), ("empty", []), ("unknown", [(1,), (2,)]), ("", [(1,), (2,)])):
        assert rows(catalog.collection_scope(books, collections, members, slug), "book_id") == want
    chips = spark.createDataFrame([("category", "big-cats"), ("tag", "a-b_c"), ("feature", "read_along"), ("age", "5"), ("language", "af"), ("price", "free"), ("narrated", "1"), ("series", None)], "facet string, value string")
    assert [c for _, c in rows(catalog.filter_chips(chips), "facet", "chip")] == ["Age 5", "Big Cats", "Read Along", "af", "Narrated", "Free", "A B_c"]
    ticked = catalog.preselected_tags(spark.createDataFrame([(1, "z", 2, False), (1, "y", 1, None), (1, "p", 0, True), (1, "m", 3, False)], "book_id int, tag string, seq int, pending boolean"), spark.createDataFrame([(1, "m"), (1, "b"), (2, "c")], "book_id int, tag string"))
    assert rows(ticked, "book_id", "tags") == [(1, ["b", "m", "y", "z"]), (2, ["c"])]


def test_every_problem_of_an_answer_is_told(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a")], "request_id int, unit_id string")
    received = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, " "), (1, "z", 3, "q"), (1, "z", 4, "q"), (1, "b", 5, None), (1, "b", 6, "y"), (1, None, 7, "t"), (1, "", 8, "t"), (2, "a", 1, "ok"), (3, "a", 1, "")], "request_id int, unit_id string, seq int, text string")
    strict = reconcile.response_errors(expected, received)
    assert rows(strict, "request_id", "unit_id", "problem", "level") == sorted([
        (1, "a", "duplicate", "error"), (1, "a", "empty", "warning"), (1, "b", "duplicate", "error"), (1, "c", "missing", "error"), (1, "z", "extra", "error"), (1, "z", "duplicate", "error"), (1, None, "no_id", "error"), (1, None, "no_id", "error"),
        (3, "a", "empty", "warning")], key=str)
    assert rows(reconcile.response_verdicts(expected, strict), "request_id", "errors", "warnings", "valid") == [(1, 7, 1, False), (2, 0, 0, True), (3, 0, 1, True)]
    loose = rows(reconcile.response_errors(expected, received, extra_is_error=False), "unit_id", "problem", "level")
    assert ("z", "extra", "warning") in loose and ("b", "empty", "warning") in loose and ("z", "duplicate", "error") in loose


def targets(spark, units, pages=(), overrides=(), items=()):
    made = lambda data, schema: spark.createDataFrame(list(data), schema)
    out = reconcile.resolve_targets(made([(1, u, p, o, s) for u, p, o, s in units], "edition_id int, unit_id string, page_number int, reading_order int, source_text string"), made([(1, *x) for x in pages], "edition_id int, page_number int, text string"),
                                    made([(1, *x) for x in overrides], "edition_id int, unit_id string, text string"), made([(1, *x) for x in items], "edition_id int, unit_id string, text string"))
    return {r.unit_id: (r.target, r.resolved_by) for r in out.collect()}, [u for _, u in rows(reconcile.unresolved_units(out), "edition_id", "unit_id")]


def spans(page, n):
    return [(f"p{page}_s{i}", page, i, f"English {i}") for i in range(n)]


def test_units_of_translated_pages_never_show_their_source(spark):
    # seven units, two lines of text: the others stay blank and are told
    got, left = targets(spark, spans(16, 7), [(16, "reël een\nreël twee")])
    assert got["p16_s0"] == ("reël een", "segment") and got["p16_s1"] == ("reël twee", "segment")
    assert left == [f"p16_s{i}" for i in range(2, 7)] and all(got[u] == ("", "unresolved") for u in left)
    # no text at all: the source, and nothing to tell
    got, left = targets(spark, spans(5, 3) + spans(6, 1), [(6, "  \n ")])
    assert got["p5_s2"] == ("English 2", "source") and got["p6_s0"] == ("English 0", "source") and left == []
    # an override wins, a blank one too, and is never unresolved; a null one is none
    got, left = targets(spark, spans(16, 3), [(16, "reël een")], [("p16_s1", "Titel"), ("p16_s2", ""), ("p16_s0", None)], [("p16_s1", "masjien")])
    assert got == {"p16_s0": ("reël een", "segment"), "p16_s1": ("Titel", "override"), "p16_s2": ("", "override")} and left == []
    # a line each; items before segments, blank items are none
    got, left = targets(spark, spans(2, 3), [(2, "een\r\ntwee\rdrie")], [], [("p2_s0", "eerste"), ("p2_s1", "  ")])
    assert [got[f"p2_s{i}"] for i in range(3)] == [("eerste", "item"), ("twee", "segment"), ("drie", "segment")] and left == []
    got, left = targets(spark, spans(16, 3), [(16, "AF een")], [], [("p16_s0", "AF een")])
    assert got["p16_s0"] == ("AF een", "item") and left == ["p16_s1", "p16_s2"]
    # a page's only unit has all of it; reading order, not the id, deals the lines
    got, _ = targets(spark, [("u", 1, 0, "E"), ("b", 2, 1, "E"), ("a", 2, 2, "E")], [(1, "reël een\nreël twee"), (2, "first\nsecond")])
    assert got == {"u": ("reël een\nreël twee", "page"), "b": ("first", "segment"), "a": ("second", "segment")}


def test_pages_are_dealt_to_slots(spark):
    def dealt(text, n):
        out = reconcile.segments(spark.createDataFrame([(1, text)], "book_id int, text string"), F.lit(n)).collect()
        return [r.segment for r in sorted(out, key=lambda r: r.slot)] or None

    assert dealt("STUDIOS\n'n Plek Vol Pret", 2) == ["STUDIOS", "'n Plek Vol Pret"]
    assert dealt("een", 1) == ["een"] and dealt("een\ntwee", 1) is None
    assert dealt("een\ntwee", 4) == ["een", "twee", "", ""]
    assert dealt("\n".join(f"woord{i}" for i in range(12)), 4) == ["\n".join(f"woord{i}" for i in range(k, k + 3)) for k in (0, 3, 6, 9)]
    assert dealt("a\nb\nc\nd\ne", 4) == ["a\nb", "c\nd", "e", ""]
    assert dealt(None, 3) is None and dealt("  \n  ", 3) is None and dealt("a", 0) is None


def test_blank_pages_and_words_of_any_script(spark):
    pairs = spark.createDataFrame([(1, 1, "a b c d e f g h i j", " "), (1, 2, " ", None), (1, 3, "x", None), (1, 4, "a b c d e f g h i j", "a b c"), (1, 5, "a b c d e f g h i j", "a b c d"), (1, 6, "a b c", "a"), (1, 7, None, "x")], "book_id int, page_number int, source_text string, translated_text string")
    assert rows(reconcile.completeness(pairs), "page_number", "problem") == [(1, "missing_page"), (3, "missing_page"), (4, "short_page")]
    text = spark.createDataFrame([(1, 1, "naïve été 2024 übergröße a_b", "NAÏVE Été x"), (1, 2, "ab", "zz"), (1, 3, "abc", ""), (1, 4, "abc", None), (1, 5, " ", "abc")], "book_id int, page_number int, source_text string, translated_text string")
    got = rows(reconcile.text_match(text), "page_number", "expected", "found", "match_rate", "searchable", "missing_sample", "passed")
    assert got == [(1, 5, 2, 0.4, True, ["2024", "a_b", "übergröße"], False), (2, 0, 0, 1.0, True, [], True), (3, 1, 0, 0.0, False, ["abc"], False)]


def test_text_layers(spark):
    want = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "alpha"), (4, "alpha beta gamma"), (5, ""), (6, "")], "k int, text string")
    have = spark.createDataFrame([(1, "Alpha"), (1, "beta"), (2, " "), (3, "alpha \x01"), (4, "alpha"), (5, "x"), (7, "y")], "k int, text string")
    got = rows(reconcile.document_match(want, have, "k"), "k", "passed", "reason", "match_rate")
    assert got == [(1, True, None, 1.0), (2, False, "no_text_layer", 0.0), (3, False, "garbled", 1.0), (4, False, "low_match", 0.333), (5, True, None, 1.0), (6, False, "no_text_layer", 0.0), (7, True, None, 1.0)]


def test_pages_before(spark):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, "  "), (1, 3, " two "), (1, 4, "x" * 300), (1, 5, None), (1, 6, "last"), (2, 1, None)], "book_id int, page_number int, extracted_text string")
    got = {(r.book_id, r.page_number): r.context for r in reconcile.previous_context(pages).collect()}
    none, p = "(This is near the beginning of the book)", "[Previous page]: "
    assert got[1, 1] == got[2, 1] == none and got[1, 2] == got[1, 3] == f"{p}one\n"
    assert got[1, 4] == f"{p}one\n{p}two\n" and got[1, 6] == got[1, 5] == f"{p}two\n{p}{'x' * 200}\n"


def test_glyphs_missing(spark):
    texts = spark.createDataFrame([(1, i, "aß ß\n") for i in range(30)] + [(1, 99, "é\t"), (2, 1, "a a"), (3, 1, "ßéü"), (4, 1, None)], "edition_id int, unit_id int, text string")
    charset = spark.createDataFrame([("a",), ("a",)], "char string")
    lost = reconcile.missing_glyphs(texts, charset)
    assert rows(lost, "edition_id", "char", "codepoint", "occurrences", "docs", "units")[0] == (1, "ß", 223, 60, 30, list(range(10)))
    got = rows(reconcile.glyph_verdicts(texts, charset, lost), "edition_id", "characters", "covered", "missing", "affected_units", "severity")
    assert got == [(1, 3, 1, 2, 11, "warning"), (2, 1, 1, 0, 0, "ok"), (3, 3, 0, 3, 1, "critical")]


def checked(spark, *rows_):
    return spark.createDataFrame(list(rows_), "candidate_id int, check_name string, status string")


ALL = [(c, "passed") for c in ("structure", "fit", "target_mapping")]


def test_issues_and_artwork_hold_publishing_back(spark):
    merged = checked(spark, *[(i, *x) for i in (1, 2, 3, 4) for x in ALL], (4, "visual", "failed"), (5, "structure", "passed"), (6, "structure", "passed"), (6, "fit", "passed"), (6, "target_mapping", "not_run"))
    issues = spark.createDataFrame([(2,), (2,), (8,)], "candidate_id int")
    artwork = spark.createDataFrame([(1, False), (3, True), (3, False), (9, None)], "candidate_id int, requires_artwork_approval boolean")
    assert rows(gates.publishable(merged, issues, artwork), "candidate_id", "publishable") == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (8, False), (9, False)]


def test_reports_merge_in_any_grouping(spark):
    issue = lambda code: [(code, "fit", 2, None)]
    made = [(1, 1, (dict(ALL), None, False)), (1, 2, ({"fit": "failed"}, issue("OVERFLOW"), False)), (1, 3, ({"fit": "passed"}, issue("B"), True)), (2, 1, (dict(ALL), None, None)), (2, 2, ({"fit": "not_run"}, [], None)), (2, 3, ({"fit": "passed"}, None, None)), (3, 1, (None, None, None))]
    reports = spark.createDataFrame(made, f"candidate_id int, seq int, report struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in ('checks map<string,string>', 'issues array<struct<code:string,stage:string,page:int,region_id:string>>', 'requires_artwork_approval boolean'))}>")
    got = {r.candidate_id: r for r in gates.merged_reports(reports).collect()}
    assert got[1].checks["fit"] == "failed" and [i.code for i in got[1].issues] == ["OVERFLOW", "B"] and got[1].requires_artwork_approval and not got[1].publishable
    assert got[2].checks == dict(ALL) and got[2].publishable and got[2].issues == []
    assert got[3].checks == {} and not got[3].publishable


def test_readiness_of_stored_reports(spark):
    import json

    good = json.dumps({"checks": dict(ALL)})
    nested = json.dumps({"checks": {"fit": "failed"}, "qa": {"checks": dict(ALL)}})
    tracks = lambda **k: json.dumps({n: dict(approved=a, fingerprint=f, output_sha256="h") for n, (a, f) in k.items()})
    made = [(1, "READY_FOR_REVIEW", "f", "h", good, tracks(layout=(True, "f"))), (2, "RENDERING", "f", "h", good, tracks(layout=(True, "f"))), (3, None, "f", "h", json.dumps(good), tracks(layout=(True, "f"))), (4, "X", "f", "h", nested, tracks(layout=(True, "old"))),
            (5, "X", "f", None, good, None), (6, "X", "f", "h", None, None), (7, "X", "f", "h", "[1]", tracks(layout=(False, "f"))), (8, "NEEDS_LAYOUT_REVIEW", None, None, "{broken", None), (9, "X", "f", "h", json.dumps({"qa": {"checks": None}, "checks": dict(ALL)}), tracks(layout=(True, "f"), artwork=(True, None)))]
    e = spark.createDataFrame(made, "candidate_id int, render_status string, render_fingerprint string, output_sha256 string, qa_report string, approval_tracks string")
    got = {r.candidate_id: (r.ready, r.codes) for r in gates.edition_readiness(e, ("layout",)).collect()}
    stale = [f"CHECK_UNRESOLVED_OR_STALE:{c}" for c in ("fit", "structure", "target_mapping")]
    pending = ["APPROVAL_PENDING_OR_STALE:layout"]
    assert got == {1: (True, []), 2: (False, ["BLOCKING_RENDER_STATE:RENDERING"]), 3: (True, []), 4: (False, pending), 5: (False, ["INVALID_GATE_INPUT"]), 6: (False, pending + stale), 7: (False, pending + stale), 8: (False, ["BLOCKING_RENDER_STATE:NEEDS_LAYOUT_REVIEW"]), 9: (True, [])}
    assert {r.candidate_id for r in gates.edition_readiness(e).where("ready").collect()} == {1, 3, 4, 9}


def test_approvals_of_pages_that_are_gone(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "edition_id int, page_number int")
    approvals = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 9, True), (1, 8, True), (3, 1, True), (2, 1, None)], "edition_id int, page_number int, approved boolean")
    assert rows(gates.approval_progress(pages, approvals), "edition_id", "approved", "total", "complete") == [(1, 2, 2, True), (2, 0, 1, False), (3, 0, 0, False)]


def test_scores_of_a_region(spark):
    r = spark.createDataFrame([(1, None, 0.5), (2, 0.8, 0.9)], "region int, extraction double, removal double")
    got = {x.region: (x.overall, x.below, x.review_required) for x in gates.confidence(r).collect()}
    assert got == {1: (0.925, {"removal": 0.5}, True), 2: (0.965, {}, False)}


def test_edits_undo_what_they_touch(spark):
    approvals = spark.createDataFrame([(1, t, p, 5) for t, p in (("page", 1), ("page", 2), ("layout", None), ("artwork", None), ("language", None), ("narration", None))], "edition_id int, track string, page_number int, given_at int")

    def stale(*edits):
        out = gates.invalidated(approvals, spark.createDataFrame(list(edits), "edition_id int, page_number int, fields array<string>, edited_at int"))
        assert out.columns == [*approvals.columns, "stale"]
        return sorted(f"{r.track}{r.page_number or ''}" for r in out.where("stale").collect())

    assert stale((1, 1, None, 6)) == ["narration", "page1"]
    assert stale((1, 1, ["font_role"], 6)) == ["artwork", "layout"]
    assert stale((1, 1, ["translation"], 6)) == ["artwork", "language", "layout", "narration"]
    assert stale((1, 1, ["colour"], 6)) == stale((1, 1, ["translation"], 5)) == stale((2, 1, ["translation"], 9)) == []


def test_deviations_and_queues(spark):
    texts = ['{"structureDeviations":[3,"7",0]}', '{"structureDeviations":{"4":"x","5":9,"a":"6b","c":"d"}}', '{"structureDeviations":null,"review_pages":[2]}', '"{\\"review_pages\\":[8]}"', "[]", None, '{"review_pages":{}}', "broken"]
    e = spark.createDataFrame(list(enumerate(texts)), "edition_id int, qa_report string")
    # of a list's texts the place counts
    assert rows(gates.deviation_pages(e), "edition_id", "page_number") == [(0, 1), (0, 3), (1, 4), (1, 6), (1, 9), (2, 2), (3, 8)]
    pages = spark.createDataFrame([(2, 2, "red", "approved"), (2, 1, None, None), (3, 1, "yellow", "rejected")], "edition_id int, page_number int, quality_flag string, review_status string")
    assert rows(gates.review_queue(pages, e), "edition_id", "page_number", "quality_flag", "review_status", "has_deviation", "place") == [(2, 1, "gray", "unreviewed", False, 1), (2, 2, "red", "approved", True, 2), (3, 1, "yellow", "rejected", False, 1)]
    assert rows(gates.review_queue(pages, e, "flagged"), "edition_id", "place") == [(2, 1), (3, 1)] and rows(gates.review_queue(pages, e, "rejected"), "edition_id") == [(3,)]
    stats = gates.review_stats(pages.withColumn("confidence_score", F.when(F.col("page_number") == 2, 7.25)))
    assert rows(stats, "edition_id", "total", "approved", "unreviewed", "avg_score") == [(2, 2, 1, 0, 7.3), (3, 1, 0, 0, 0.0)]


def test_words_of_a_region(spark):
    words = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 8.0, 0.4, 23.04, 10.0), (1, 50.0, 50.0, 60.0, 60.0)], "page_id int, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, "a", 0.0, 0.0, 20.0, 10.0), (1, "b", 200.0, 0.0, 220.0, 10.0), (2, "a", 0.0, 0.0, 1.0, 1.0)], "page_id int, region string, x0 double, y0 double, x1 double, y1 double")
    assert rows(gates.contained_lines(words, regions), "page_id", "region", "lines", "boxes", "clipped", "bx0", "bx1") == [(1, "a", 1, 2, 1, 0.0, 23.0), (1, "b", 0, 0, 0, None, None), (2, "a", 0, 0, 0, None, None)]


def test_families_of_a_policy(spark):
    texts = ['{"publisher_default":{"body":"Play","head":""},"roles":{"font_asset_id":"Pat","weight":4},"language_overrides":{"zu":{"body":{"font_asset_id":"Zed"}},"af":{"font_asset_id":"Play"}},"unit_overrides":{"u":{"font_asset_id":"Uni"},"v":["L1","L2"]}}', None, "{}", '{"roles":{"b":{"size":3},"a":{"font_asset_id":"A"}}}', "[]"]
    out = layout.requested_families(spark.createDataFrame(list(enumerate(texts)), "book_id int, policy string"))
    assert rows(out, "book_id", "families") == [(0, ["Play", "Pat", "Zed", "Uni", "L1", "L2"]), (1, []), (2, []), (3, ["A"]), (4, [])]


def test_page_families_stay_in_their_document(spark):
    pages = spark.createDataFrame([(1, 1, "cover", 2, True), (1, 2, "story_page", 3, True), (1, 3, "back_cover", 1, None), (1, 4, "story_page", 3, True), (1, 5, "back_cover", 1, None), (2, 1, "story_page", 3, True), (1, 6, "story_page", 3, False)], "doc_id int, page_number int, page_type string, regions int, has_images boolean")
    families = layout.page_families(pages)
    assert rows(families, "doc_id", "page_number", "family") == [(1, 2, "family-00-story"), (1, 3, "family-01-back"), (1, 4, "family-00-story"), (1, 5, "family-01-back")]
    styles = spark.createDataFrame([(1, 2, "prose", 24.04, "A", "red", 400, True), (1, 4, "prose", 26.0, "B", "red", 700, False), (1, 3, "x", 9.0, None, "k", 1, False), (1, 5, "x", 9.04, None, "k", 1, False), (1, 2, "once", 1.0, "A", "k", 1, False), (2, 1, "prose", 26.0, "B", "red", 700, False)],
                                   "doc_id int, page_number int, style_id string, size double, font string, color string, weight int, italic boolean")
    got = rows(layout.style_families(styles, families), "family", "style_id", "size", "font", "color", "weight", "italic", "samples")
    assert got == [("family-00-story", "prose", 24.0, "A", "red", 400, True, 2), ("family-01-back", "x", 9.0, None, "k", 1, False, 2)]
    box = lambda a: (a, a, a + 5.0, a + 5.0)
    regions = spark.createDataFrame([(1, 2, 1, "text", box(10.0), None), (1, 4, 2, "text", box(50.0), None), (1, 4, 3, "title", box(0.0), None), (1, 4, 4, "text", None, box(1.0)), (2, 1, 5, "text", box(90.0), None)],
                                    "doc_id int, page_number int, region_id int, region_type string, box struct<x0:double,y0:double,x1:double,y1:double>, container struct<x0:double,y0:double,x1:double,y1:double>")
    out = {r.region_id: (tuple(r.container) if r.container else None, r.container_source) for r in layout.consensus_containers(regions, families).collect()}
    assert out == {1: ((0.0, 0.0, 65.0, 65.0), "page_family"), 2: ((0.0, 0.0, 65.0, 65.0), "page_family"), 3: (None, None), 4: ((1.0, 1.0, 6.0, 6.0), "own"), 5: (None, None)}
    units = spark.createDataFrame([(1, "translate"), (1, "preserve"), (1, None), (1, "x")], "doc_id int, policy string")
    summary = {r.doc_id: r for r in layout.document_summary(pages, units, families).collect()}
    assert (summary[1].units, summary[1].translate, summary[1].preserve, summary[1].other, summary[1].families) == (4, 1, 1, 2, {"family-00-story": [2, 4], "family-01-back": [3, 5]}) and summary[2].families is None and summary[1].page_types[1] == "cover"


def test_text_of_a_page_and_artwork(spark):
    spans = spark.createDataFrame([(1, " ab ", 9.04, "ABCDEF+Play", 1.0, 0.0), (1, "c", 9.0, "Play", 1.0, 0.0), (1, " ", 30.0, "Other", 0.0, 1.0), (2, None, 1.0, "ABCDEF+", 1.0, 0.0), (3, "x", 1.0, "ABCDEF+", 1.0, 0.0)], "page_id int, text string, font_size double, font_name string, dir_x double, dir_y double")
    assert rows(layout.text_summary(spans), "page_id", "spans", "chars", "sizes", "fonts", "rotated") == [(1, 2, 3, [9.0], ["Play"], True), (2, 0, 0, [], [], False), (3, 1, 1, [1.0], ["ABCDEF+"], False)]
    images = spark.createDataFrame([(1, 0.2), (1, 0.1), (2, 9.0), (3, 0.1), (4, 0.9), (5, 1.0)], "page_id int, coverage double")
    texts = spark.createDataFrame([(1, 399), (5, 400)], "page_id int, chars int")
    pages = spark.createDataFrame([(2, "Back_Cover"), (1, "story")], "page_id int, page_type string")
    assert rows(layout.artwork_candidates(images, texts, pages), "page_id", "share", "chars") == [(1, 0.3, 399), (4, 0.9, 0)]


def test_reports(spark):
    pages = spark.createDataFrame([(1, "ab cd"), (1, None), (1, ""), (1, "e"), (1, "f")], "b int, t string")
    assert rows(reporting.edition_costs(pages, "b", "t"), "words", "chars", "narratable") == [(4, 9, 1)]
    books = spark.createDataFrame([(1, "en", None, None), (2, "en", 1, 2)], "book_id int, original_language string, narration_start_page int, narration_end_page int")
    text = spark.createDataFrame([(1, i, "" if i == 4 else f"o{i}") for i in range(1, 8)] + [(2, 1, "x"), (2, 2, "y"), (2, 3, "z")], "book_id int, page_number int, extracted_text string")
    other = spark.createDataFrame([(1, "af", i, f"a{i}") for i in (2, 3, 5, 6)], "book_id int, language_code string, page_number int, translated_text string")
    asked = spark.createDataFrame([(1, "en"), (1, "af"), (2, "en"), (2, "zu")], "book_id int, language_code string")
    got = rows(reporting.narration_texts(asked, books, text, other), "book_id", "language_code", "text")
    assert got == [(1, "af", "a3"), (1, "af", "a5"), (1, "en", "o3"), (1, "en", "o5"), (2, "en", "x"), (2, "en", "y")]
    jobs = spark.sql("SELECT * FROM VALUES (1, 1, 'queued', TIMESTAMP'2024-01-01 00:00:00'), (1, 2, 'processing', TIMESTAMP'2024-01-01 00:01:00'), (1, 3, 'failed', TIMESTAMP'2024-01-01 00:03:00'), (2, 1, 'completed', TIMESTAMP'2024-01-01 00:00:00'), (2, 2, 'processing', TIMESTAMP'2024-01-01 00:00:00'), (3, 1, NULL, NULL) AS t(job_id, seq, status, ts)")
    assert rows(reporting.job_states(jobs), "job_id", "status", "active", "seconds") == [(1, "failed", False, 120), (2, "processing", True, None), (3, "queued", True, None)]
    searches = spark.createDataFrame([("search", '{"term":" Cat","results":0}', 2), ("search", '{"term":"cat","results":3}', None), ("filter", '{"term":"cat"}', 1), ("search", '{"term":" "}', 1), ("search", "broken", 1), ("search", '{"term":"dog"}', 1)], "type string, payload string, count int")
    assert rows(reporting.search_terms(searches.withColumn("day", F.lit("2024-01-01"))), "term", "searches", "without_result") == [("cat", 3, 2), ("dog", 1, 1)]
    trail = spark.createDataFrame([(1, "translation", "zu", 1), (1, "translation", "af", 2), (1, "translation", "af", 3), (1, "render", "af", 4), (2, "review", None, 9)], "book_id int, kind string, language_code string, ts int")
    assert rows(reporting.audit_summary(trail), "book_id", "languages", "versions", "renders", "reviews", "last_render", "last_review") == [(1, ["af", "zu"], 3, 1, 0, 4, None), (2, [], 0, 0, 1, None, 9)]


def test_glossary_by_book_and_language(spark):
    terms = spark.createDataFrame([(1, "af", "b", "B", None), (1, "af", "a", "A", "c"), (1, "zu", "a", "Z", None)], "book_id int, language_code string, source_term string, translated_term string, context string")
    assert rows(reconcile.memory_block(terms), "book_id", "language_code", "block") == [(1, "af", "a = A\nb = B"), (1, "zu", "a = Z")]
    asked = spark.createDataFrame([(1, "af", "a"), (1, "af", "A"), (2, "af", "a")], "book_id int, language_code string, source_term string")
    assert rows(reconcile.memory_lookup(asked, terms), "book_id", "source_term", "translated_term") == [(1, "A", None), (1, "a", "A"), (2, "a", None)]
    split = reconcile.cache_split(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    assert rows(reconcile.hit_rate(split), "total", "hits", "misses", "rate") == [(3, 1, 2, 0.333)] and rows(reconcile.hit_rate(split.where("false")), "rate") == [(0.0,)]


def test_language_gate(spark):
    pages = spark.createDataFrame([(1, '<html lang="AF">'), (2, '<html lang="en">'), (3, "<html>"), (4, None)], "page_id int, html string")
    editions = spark.createDataFrame([(i, "af") for i in range(1, 5)], "page_id int, language_code string")
    assert rows(ingest.language_gate(pages, editions), "page_id", "passed", "code") == [(1, True, None), *((i, False, "ACCESSIBILITY_LANG_UNSET") for i in (2, 3, 4))]


def test_restarted_audit_stream_leaves_each_event_once(spark, tmp_path):
    schema = "event_id long, kind string"

    def come(*ids):
        spark.createDataFrame([(i, f"k{i % 2}") for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        feeds.append_audit(events, f"{tmp_path}/trail", f"{tmp_path}/cp").awaitTermination()
        return sorted(r.event_id for r in feeds.audit_trail(spark, f"{tmp_path}/trail", events.schema).collect())

    from pyspark.sql.types import StructType

    assert feeds.audit_trail(spark, f"{tmp_path}/none", StructType.fromDDL(schema)).count() == 0
    come(1, 2)
    come(3)
    assert run() == [1, 2, 3] == run()
    # the last batch's commit is lost, as when a driver dies after writing: it is done again
    last = max((p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == [1, 2, 3]
    come(4)
    assert run() == [1, 2, 3, 4]


def test_tables_of_a_database_in_parts(spark):
    url = {"url": "jdbc:derby:memory:shop;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(1000).select(F.col("id").alias("ID"), (F.col("id") * 1.005).cast("decimal(12,3)").alias("PRICE"), F.lit("x").alias("TITLE")).write.format("jdbc").options(**url, dbtable="EDITIONS").mode("overwrite").save()
    spark.range(0).select(F.col("id").alias("ID")).write.format("jdbc").options(**url, dbtable="EMPTY_ONE").mode("overwrite").save()
    tables = views.load_jdbc(spark, [views.JdbcTable("EDITIONS", "id long, price decimal(8,2), missing string", "ID", 5), views.JdbcTable("EMPTY_ONE", "id long", "ID")], url)
    editions = tables["EDITIONS"]
    assert editions.rdd.getNumPartitions() == 5 and dict(editions.dtypes) == {"id": "bigint", "price": "decimal(8,2)", "missing": "string"}
    assert editions.count() == 1000 and str(editions.where("id = 100").first().price) == "100.50" and editions.where("missing IS NOT NULL").count() == 0
    assert tables["EMPTY_ONE"].count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_page_of_many_units_is_dealt_once(spark):
    # the lines were made anew for each slot of each unit: minutes
    lines, began = [f"line {i}" for i in range(3000)], time.time()
    got, left = targets(spark, spans(1, 1000) + spans(2, 1) + spans(3, 1), [(1, "\r\n".join(lines)), (2, " one\ntwo "), (3, " ")])
    assert all(got[f"p1_s{i}"] == ("\n".join(lines[3 * i : 3 * i + 3]), "segment") for i in range(1000)) and left == []
    assert got["p2_s0"] == (" one\ntwo ", "page") and got["p3_s0"] == ("English 0", "source")
    assert time.time() - began < 60


def test_nearest_fonts_meet_in_blocks(spark):
    rng = random.Random(7)
    made = [(i, rng.random(), rng.choice([0.1, 0.2, rng.random()]), rng.randrange(1, 10) * 100, rng.choice(["serif", "sans", "unknown", None]), rng.choice([0, 1, None]), rng.choice([0.0, -1.0, None, rng.random() * 3])) for i in range(400)]
    made += [(400, None, 0.1, 100, "sans", 1, 1.0), (401, float("nan"), 0.1, 100, "sans", 1, 1.0), (402, 0.1, 0.1, None, "sans", 1, 1.0), (None, 0.1, 0.1, 100, "sans", 1, 1.0), (403, 0.1, 0.1, 100, "sans", 1, float("nan")), (404, 0.1, 0.1, 9000, "sans", 1, 1.0)]
    fonts = spark.createDataFrame(made, "font_id int, x_height_ratio double, width_ratio double, weight_class int, serif_class string, width_class int, char_density double")

    def far(a, b):
        known = lambda i: a[i] is not None and b[i] is not None and "unknown" not in (a[i], b[i])
        serif, width = 5.0 * (known(4) and a[4] != b[4]), 1.0 * (known(5) and a[5] != b[5])
        dense = known(6) and not a[6] <= 0 and not b[6] <= 0
        return math.sqrt((a[1] - b[1]) ** 2 * 10 + (a[2] - b[2]) ** 2 * 5 + ((a[3] - b[3]) / 100.0) ** 2 * 3 + serif + width + (((a[6] - b[6]) / max(a[6], 1.0)) ** 2 * 2 if dense else 0.0))

    whole, want = [f for f in made if None not in f[:4]], []
    for q in whole:
        if q[0] % 5 == 0:
            near = sorted((d, f[0]) for f in whole if f[0] != q[0] and (d := far(q, f)) <= 2.5)
            want += [(q[0], i, r + 1) for r, (_, i) in enumerate(near[:4])]
    out = layout.nearest_fonts(fonts.where("font_id % 5 = 0"), fonts, 2.5, 4, block=60)
    assert rows(out, "query_id", "font_id", "rank") == sorted(want, key=str)
    # pairs aren't sorted in one task of a join that was made small
    assert "BroadcastExchange" not in plan_of(out) and "REPARTITION_BY_NUM" in plan_of(out)
    assert layout.nearest_fonts(fonts.limit(0), fonts, 2.5, 4).count() == 0


def test_tags_and_chains_are_not_broadcast(spark):
    # inline rows of a known small size
    tags = spark.sql("SELECT * FROM VALUES (1L, 'a', 'A', 'active', NULL), (2L, 'b', 'B', 'active', 1L), (3L, 'c', 'C', 'archived', 9L) AS t(tag_id, slug, canonical_name, status, merged_into)")
    none = spark.sql("SELECT 0L AS tag_id, '' AS name WHERE false")
    resolved, _ = catalog.resolve_tags(spark.createDataFrame([(7, " B "), (7, "a"), (8, "c"), (8, "new")], "book_id int, tag string"), tags, none, none)
    assert "Broadcast" not in plan_of(resolved)
    assert rows(resolved, "book_id", "tag_id", "slug", "group") == [(7, 1, "a", "matched"), (8, 3, "c", "pending"), (8, None, "new", "pending")]


def test_styles_are_shuffled_once(spark):
    styles = spark.createDataFrame([(1, 1, "a", 9.0, "A", "k", 1, True), (1, 2, "a", 9.0, "B", "r", 1, False), (1, 3, "a", -0.0, "B", None, 2, False), (1, 4, "a", 0.0, "A", None, 2, True)], "doc_id int, page_number int, style_id string, size double, font string, color string, weight int, italic boolean")
    families = spark.createDataFrame([(1, i, "f") for i in range(1, 5)], "doc_id int, page_number int, family string")
    out = layout.style_families(styles, families)
    plan = plan_of(out)
    assert rows(out, "size", "font", "color", "weight", "italic", "samples") == [(9.0, "A", None, 1, True, 4)]
    # the rows by style, and the two sides of the join at most
    assert plan.count("Exchange hashpartitioning") <= 3 and "Generate" not in plan


def test_links_and_books_of_rules_stand_in_the_plan_once(spark):
    books, editions, features = shop(spark)
    links = spark.createDataFrame([(1, "animals"), (3, "animals")], "book_id int, slug string")
    marked = books.where("length(book_type) <> 987654321")
    rules = spark.createDataFrame([(1, '{"category":"animals"}'), (2, '{"book_type":"picture","category":"animals"}'), (3, None), (4, '{"book_type":"reader"}')], "collection_id int, rules string")
    out = extras.rule_matches(rules, marked, editions, features, links)
    assert rows(out, "collection_id", "book_id") == [(1, 1), (1, 3), (2, 1), (3, 1), (3, 2), (3, 3), (4, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("987654321") <= 2
