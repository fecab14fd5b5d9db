"""Edge cases of the library's operators on inline rows."""

import itertools
import random

from pyspark.sql import functions as F

from leafworks.functions.text import words
from leafworks.operators import catalog, extras, gates, layout, pagetypes, phonics, reconcile, scripts, textsig
from leafworks.sources import ingest, views
from leafworks.streaming import feeds


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_rights_bounds_and_null_territories(spark):
    r = spark.sql("""SELECT * FROM VALUES (1, true, DATE'2024-01-01', DATE'2024-01-31', 'ZA'), (2, true, NULL, NULL, '*'), (3, true, NULL, NULL, NULL), (4, false, NULL, NULL, 'ZA'),
      (5, true, DATE'2024-02-01', NULL, 'ZA'), (6, true, NULL, NULL, 'US') AS t(edition_id, digital_rights, licence_start, licence_end, territory)""")
    assert rows(catalog.rights_pass(r, "ZA", "2024-01-31"), "edition_id") == [(1,), (2,)]
    assert rows(catalog.rights_pass(r, "ZA", "2024-02-01", "allow"), "edition_id") == [(2,), (3,), (5,)]


def test_one_edition_must_hold_all_facets(spark):
    books = spark.createDataFrame([(1,), (2,)], "book_id int")
    editions = spark.createDataFrame([(1, "af", "published", 5.0), (1, "en", "published", None), (2, "af", "published", 0.0), (2, "af", "draft", 9.0)], "book_id int, language_code string, publication_status string, price double")
    editions = editions.withColumn("edition_id", F.monotonically_increasing_id())
    features = spark.createDataFrame([], "edition_id long, feature string")
    assert rows(catalog.with_edition(books, editions, features, catalog.EditionFacets(language="af", price="free")), "book_id") == [(2,)]
    assert rows(catalog.with_edition(books, editions, features, catalog.EditionFacets(language="en", price="free")), "book_id") == [(1,)]
    assert rows(catalog.with_edition(books, editions, features, catalog.EditionFacets(language="af", price="paid")), "book_id") == [(1,)]


def test_search_wildcards_names_and_blank(spark):
    books = spark.createDataFrame([(1, "Red Fox"), (2, None), (3, "blue")], "book_id int, title string")
    named = spark.createDataFrame([(2, "Foxes"), (2, "fox cubs")], "book_id int, name string")
    assert rows(catalog.search(books, " FOX ", ["title"], named), "book_id") == [(1,), (2,)]
    assert rows(catalog.search(books, "r_d", ["title"]), "book_id") == [(1,)]
    assert catalog.search(books, "  ", ["title"]).count() == 3


def test_effective_id_of_broken_chains_and_circles(spark):
    n = spark.createDataFrame([(1, 2), (2, 3), (3, 99), (4, None), (5, 6), (6, 5), (7, 4)], "id long, merged_into long")
    assert rows(catalog.effective_ids(n), "id", "effective_id") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 4)]
    assert rows(catalog.effective_ids(n, "last"), "id", "effective_id")[:3] == [(1, 3), (2, 3), (3, 3)]


def test_next_in_series_by_rank(spark):
    books = spark.createDataFrame([(10, "s", 1), (11, "s", 2), (12, "s", 3), (13, "s", 4), (20, None, 1)], "book_id int, series string, series_volume int")
    ranks = spark.createDataFrame([(10, 1), (11, 4), (12, 2)], "book_id int, rank int")
    assert rows(catalog.next_in_series(books, ranks), "book_id", "next_id") == [(10, 12), (11, 12), (12, 13), (13, None)]
    assert rows(catalog.next_in_series(books), "book_id", "next_id") == [(10, 11), (11, 12), (12, 13), (13, None)]
    # stretches of any length give the same
    rng = random.Random(2)
    many = spark.createDataFrame([(i, f"s{i % 2}", rng.randrange(60)) for i in range(120)], "book_id int, series string, series_volume int")
    levels = spark.createDataFrame([(i, rng.randrange(1, 6)) for i in range(120) if i % 7], "book_id int, rank int")
    for by in (None, levels):
        assert rows(catalog.next_in_series(many, by, 3), "book_id", "next_id") == rows(catalog.next_in_series(many, by), "book_id", "next_id")


def test_merge_is_the_same_in_any_order_of_parts(spark):
    rng = random.Random(1)
    checks = [(1, s, "fit", rng.choice(["failed", "passed", "not_run"]) if s > 3 else "passed") for s in range(8)]
    want = None
    for part in itertools.islice(itertools.permutations(checks), 0, 40000, 8000):
        df = spark.createDataFrame(part, "candidate_id int, seq int, check_name string, status string")
        got = rows(gates.merge_checks(df.repartition(3)), "candidate_id", "status")
        want = want or got
        assert got == want
    failed = any(c[3] == "failed" for c in checks)
    assert want == [(1, "failed" if failed else checks[-1][3])]


def test_publishable_fails_closed(spark):
    m = spark.createDataFrame([(1, "structure", "passed"), (1, "fit", "passed"), (1, "target_mapping", "passed"), (2, "structure", "passed"), (3, "structure", "passed"), (3, "fit", "passed"), (3, "target_mapping", "passed"), (3, "visual", "failed")], "candidate_id int, check_name string, status string")
    assert rows(gates.publishable(m, m.where("false"), spark.createDataFrame([], "candidate_id int, requires_artwork_approval boolean")), "candidate_id", "publishable") == [(1, True), (2, False), (3, False)]


def test_candidate_readiness_is_bound_and_fails_closed(spark):
    c = spark.createDataFrame([(1, "f", "h", ["a", "a", "b"], ["art"]), (2, "", "h", ["a"], []), (3, "f", None, ["a"], []), (4, "f", "h", [], []), (5, "f", "h", ["a"], []), (6, "f", "h", ["a"], ["art"]), (7, "f", "h", ["a"], None)], "candidate_id int, fingerprint string, output_sha256 string, required_checks array<string>, required_approvals array<string>")
    record = "candidate_id int, key string, status string, candidate_fingerprint string, output_sha256 string"
    checks = spark.createDataFrame([(1, "a", "passed", "f", "h"), (1, "b", "passed", "old", "h"), (2, "a", "passed", "", "h"), (3, "a", "passed", "f", None), (5, "a", "failed", "f", "h"), (6, "a", "passed", "f", "h"), (7, "a", "passed", "f", "h")], record)
    approvals = spark.createDataFrame([(1, "art", "approved", "f", "stale"), (6, "art", "approved", "f", "h")], record)
    got = rows(gates.candidate_readiness(c, checks, approvals), "candidate_id", "ready", "codes")
    assert got == [(1, False, ["APPROVAL_PENDING_OR_STALE:art", "CHECK_UNRESOLVED_OR_STALE:b"]), (2, False, ["INVALID_GATE_INPUT"]), (3, False, ["INVALID_GATE_INPUT"]), (4, False, ["INVALID_GATE_INPUT"]), (5, False, ["CHECK_UNRESOLVED_OR_STALE:a"]), (6, True, []), (7, True, [])]
    editions = spark.createDataFrame([(5, "en", None), (6, "af", "approved"), (7, "af", "ready"), (8, None, None)], "candidate_id int, language_code string, render_status string")
    pages = spark.createDataFrame([(5, True), (6, True), (6, True), (7, True), (7, None)], "candidate_id int, approved boolean")
    guards = gates.state_guards(editions, pages, gates.candidate_readiness(c, checks, approvals))
    assert rows(guards, "candidate_id", "may_approve", "may_publish", "may_narrate", "store_visible") == [(5, False, True, True, True), (6, True, True, True, True), (7, False, True, False, True), (8, False, False, False, False)]


def test_coverage_issues(spark):
    books = spark.createDataFrame([(1, "f"), (2, "f")], "book_id int, fingerprint string")
    expected = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4, 5)], "book_id int, page_number int")
    records = spark.createDataFrame([(1, 1, 1, "passed", "f"), (1, 2, 2, "failed", "f"), (1, 3, 3, "passed", "f"), (1, 3, 4, "passed", "f"), (1, 9, 5, "passed", "f"), (1, 5, 6, "passed", "old"), (2, 1, 1, "passed", "f")], "book_id int, page_number int, seq int, status string, candidate_fingerprint string")
    assert rows(gates.coverage(books, expected, records), "book_id", "page_number", "code") == [
        (1, 2, "VISUAL_CHECK_UNRESOLVED"), (1, 3, "UNEXPECTED_OR_DUPLICATE_PAGE"), (1, 4, "PAGE_NOT_CHECKED"), (1, 5, "STALE_VISUAL_RESULT"), (1, 9, "UNEXPECTED_OR_DUPLICATE_PAGE"), (2, None, "EMPTY_EXPECTED_PAGE_SET")]


def test_overprints_across_bands(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 35.0, 50.0, 45.0), (1, 2, 10.0, 38.0, 60.0, 48.0), (2, 1, 0.0, 0.0, 10.0, 10.0), (2, 2, 0.0, 9.0, 10.0, 20.0)], "page_id int, span_no int, x0 double, y0 double, x1 double, y1 double")
    assert rows(gates.overprints(s), "page_id") == [(1,)]


def test_upper_median_and_clusters(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0), ("b", None)], "k string, v double")
    assert rows(layout.upper_median(df, "k", "v"), "k", "median") == [("a", 3.0), ("b", 5.0)]
    c = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 5.0), (1, 20.0)], "k int, v double")
    assert rows(layout.clusters(c, "k", "v", 5.0), "cluster", "centre", "n") == [(1, 2.5, 2), (2, 20.0, 1)]
    assert rows(layout.clusters(c, "k", "v", 5.0, strict=True), "cluster", "n") == [(1, 1), (2, 1), (3, 1)]


def test_scripts_and_words(spark):
    texts = [(1, "Привет мир a"), (2, "שלום"), (3, ""), (4, None), (5, "漢字かな kana!"), (6, "مرحبا 1"), (7, "ab กข"), (8, "กข ab"), (9, "Ⴀ ʰ ⱡ 😀"), (10, "שלום abcd")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r.doc_id: r for r in scripts.script_profile(df).collect()}
    assert {i: got[i].dominant for i in got} == {1: "Cyrillic", 2: "Hebrew", 3: "Latin", 4: "Latin", 5: "CJK", 6: "Arabic", 7: "Latin", 8: "Thai", 9: "Latin", 10: "Hebrew"}
    assert got[2].is_rtl and got[2].direction == "rtl" and got[4].letters == 0 and got[4].shares == {} and not got[5].is_complex and got[7].is_complex
    assert got[5].shares == {"CJK": 50.0, "Latin": 50.0} and got[6].shares == {"Arabic": 83.3, "Latin": 16.7} and got[6].is_bidi and got[6].direction == "mixed"
    assert got[9].letters == 3 and got[9].shares == {"Latin": 66.7, "Georgian": 33.3}
    pages = spark.createDataFrame([(1, 1, "ab"), (1, 2, "กขค"), (1, 3, None), (2, 1, "")], "book_id int, page_number int, extracted_text string")
    whole = {(r.book_id, r.page_number): (r.dominant, r.letters, r.shares) for r in scripts.page_and_book_profile(pages).collect()}
    assert whole[1, None] == ("Thai", 5, {"Latin": 40.0, "Thai": 60.0}) and whole[1, 1] == ("Latin", 2, {"Latin": 100.0}) and whole[2, None] == ("Latin", 0, {}) and len(whole) == 6
    assert {r.doc_id: r.label for r in scripts.script_label(df).collect()} == {1: "Cyrl", 2: "Hebr", 3: "Latn", 4: "Latn", 5: "Latn", 6: "Arab", 7: "Latn", 8: "Thai", 9: "Zyyy", 10: "Hebr"}
    spaced = spark.createDataFrame([(" a b \n",), (None,)], "t string").select(words(F.col("t")).alias("w")).collect()
    assert [r.w for r in spaced] == [["a", "b"], []]


def test_directional_runs(spark):
    df = spark.createDataFrame([(1, "12 abc שלום, ok"), (2, "123"), (3, ""), (4, None), (5, "! éa")], "doc_id int, text string")
    assert rows(scripts.directional_runs(df), "doc_id", "paragraph", "run_no", "direction", "start_index", "end_index", "run") == [
        (1, "ltr", 0, "ltr", 3, 7, "abc "), (1, "ltr", 1, "rtl", 7, 13, "שלום, "), (1, "ltr", 2, "ltr", 13, 15, "ok"), (2, "ltr", 0, "ltr", 0, 3, "123"), (5, "ltr", 0, "ltr", 2, 4, "éa")]


def test_segments_of(spark):
    df = spark.createDataFrame([(1, "Don't stop. Now! it’s e\u0301-x")], "doc_id int, text string")
    r = scripts.segments_of(df).first()
    assert r.tokens == ["Don't", " ", "stop", ".", " ", "Now", "!", " ", "it’s", " ", "e\u0301-x"] and r.sentences == ["Don't stop.", "Now! it’s e\u0301-x"]
    assert len(r.graphemes) == len("Don't stop. Now! it’s e-x")


def test_book_signals_of_published_cases(spark):
    picture = [(1, i, t) for i, t in enumerate(["The cat sat.", "A big red ball.", "", "We ran fast.", "The end."], 1)]
    chapter = [(2, i, "word " * 299 + "end. ") for i in range(1, 41)]
    blank = [(3, 1, None), (3, 2, "  ")]
    pages = spark.createDataFrame(picture + chapter + blank, "book_id int, page_number int, extracted_text string")
    typed = textsig.age_hint(textsig.book_type(textsig.book_signals(pages)).join(textsig.reading_level(pages), "book_id"))
    assert rows(typed, "book_id", "book_kind", "level", "level_confidence", "hint_min", "hint_max") == [(1, "picture_book", "beginner", 0.75, 3, 6), (2, "chapter_book", "advanced", 0.65, 11, 15), (3, "picture_book", "pre_reader", 0.6, 3, 6)]
    slugs = spark.createDataFrame([("childrens-fiction",)], "slug string")
    assert rows(textsig.long_suggestions(typed.where("book_id = 2"), slugs), "field", "value", "confidence", "requires_confirmation") == [("age_range", "11-15", 0.5, True), ("book_type", "chapter_book", 0.65, False), ("primary_category", "childrens-fiction", 0.585, False), ("reading_level", "advanced", 0.65, False)]
    assert textsig.primary_category(typed.where("book_id = 1"), slugs).count() == 0


def test_page_kinds(spark):
    listed = "\n".join(["cat", "big dog", ""] * 11)
    pages = spark.createDataFrame([(1, 1, "ISBN copyright"), (1, 2, "isbn 1 Copyright 2020"), (1, 3, "words and PHONICS"), (1, 4, listed), (1, 5, "a story"), (1, 6, None), (1, 7, "end")], "book_id int, page_number int, extracted_text string")
    assert [k for _, k in rows(pagetypes.page_types(pages), "page_number", "page_type")] == ["cover", "copyright", "vocabulary", "vocabulary", "story", "story", "back_cover"]
    manifest = spark.createDataFrame([(1, 5, "phonics"), (1, 6, None)], "book_id int, page_number int, page_type string")
    got = rows(pagetypes.manifest_page_types(pages, manifest), "page_number", "page_type", "needs_review", "source")
    assert got[4:] == [(5, "phonics", True, "scene_graph"), (6, "story", False, "scene_graph"), (7, "back_cover", False, "heuristic_fallback")]
    text = "intro\nWORDS\ncat\n dog \nHOË FREKWENSIE WOORDE\nen\nPHONICS\nai rain\nWOORDE"
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split("\n"))], "doc_id int, line_no int, text string")
    assert rows(pagetypes.vocabulary_regions(lines), "region", "heading", "region_type", "items", "needs_review") == [
        (0, "", "word_list", ["intro"], False), (1, "WORDS", "multi_column_word_list", ["cat", "dog"], False), (2, "HOË FREKWENSIE WOORDE", "high_frequency_words", ["en"], False), (3, "PHONICS", "phonics_exercise", ["ai rain"], True)]


def test_span_page_kinds(spark):
    def page(i, spans):
        return [(i, n, t, size, x, False) for n, (t, size, x) in enumerate(spans)]

    made = page(1, [("My Big Book", 48.0, 0.0), ("Studio", 10.0, 0.0)]) + page(2, [("Five monkeys are screaming.", 30.0, 0.0)]) + page(3, [(w, 23.0, 24.0 * (n % 3)) for n, w in enumerate(["the", "and", "for", "you"] * 4)])
    made += page(4, [("Published by X, ISBN 1. All rights reserved.", 9.0, 0.0)]) + page(5, [("Titles: 1 - First 2 - Second", 30.0, 0.0)]) + page(7, [("while four cubs play nearby", 30.0, 0.0)])
    spans = spark.createDataFrame(made, "page_id int, span_no int, text string, font_size double, x0 double, is_page_number boolean")
    pages = spark.createDataFrame([(i, i, 9) for i in range(1, 8)], "page_id int, page_number int, total_pages int")
    assert [k for _, k in rows(pagetypes.span_page_types(spans, pages), "page_id", "page_type")] == ["cover", "story", "vocabulary", "copyright", "back_cover", "story", "story"]
    texts = spark.createDataFrame([(1, "Titles in the series 3: 1 - First Title 2 – Second Title"), (2, "Head\nOne\nTwo"), (3, "none")], "doc_id int, text string").select("doc_id", pagetypes.title_entries(F.col("text")).alias("e")).select("doc_id", "e.*")
    assert rows(texts, "doc_id", "header", "entries")[1:] == [(2, "Head", ["One", "Two"]), (3, "none", [])]
    assert rows(texts, "header", "entries")[0] != () and texts.where("doc_id = 1").first().entries == ["1 - First Title", "2 - Second Title"]


def test_phonics_rows(spark):
    lists = spark.createDataFrame([("af", w) for w in ("lekker", "bakker", "rain")], "lang string, word string")
    given = [(1, "af", "- kk lekker, bakker"), (2, "af", "kk lekker, klipfisk"), (3, "af", "kk krakke, lekker"), (4, "en", "ai xaiq, rain"), (5, "en", "ai cat"), (6, "af", "heading"), (7, "af", None)]
    got = {r.row_id: (r.valid, r.problem) for r in phonics.phonics_problems(spark.createDataFrame(given, "row_id int, lang string, text string"), lists).collect()}
    assert got == {1: (True, None), 2: (False, 'klipfisk do not contain the pattern "kk"'), 3: (False, "krakke are not real words"), 4: (True, None), 5: (False, 'cat do not contain the pattern "ai"'), 6: (True, None), 7: (True, None)}
    page = "FONIES\nbr - broek, breek\n- kk\n lekker, klap\n- ft\n- iek siek, rain\nA line."
    pages = spark.createDataFrame([(1, "nl", page), (2, "af", "- kk lekker, krakke"), (3, "af", None)], "page_id int, lang string, text string")
    assert rows(phonics.invalid_phonics_lines(pages, lists), "page_id", "line", "pattern", "bad_words") == [(1, "- iek siek, rain", "iek", ["rain"]), (1, "- kk lekker, klap", "kk", ["klap"]), (2, "- kk lekker, krakke", "kk", ["krakke"])]


def test_narration_text(spark):
    df = spark.createDataFrame([(1, "12\nHello. World, yes! ok\n7"), (2, "5"), (3, None)], "i int, t string")
    assert rows(df.select("i", textsig.narration_text(F.col("t")).alias("a"), textsig.narration_text(F.col("t"), 40).alias("b")), "i", "a", "b") == [(1, "Hello. World, yes! ok", "Hello... World,... yes!... ok"), (2, None, None), (3, None, None)]


def test_encoding_check(spark):
    df = spark.createDataFrame([(1, "ok\n\t"), (2, "bad ��"), (3, "ctl \x07"), (4, None)], "doc_id int, text string")
    assert rows(textsig.encoding_check(df), "doc_id", "replaced", "controls", "clean") == [(1, 0, 0, True), (2, 2, 0, False), (3, 0, 1, False), (4, 0, 0, True)]


def test_phonics_lines(spark):
    df = spark.createDataFrame([(1, 1, "ai rain tail"), (1, 2, "The end."), (1, 3, "sh cat dog"), (1, 4, None), (1, 5, "- kk - lekker, bakker"), (1, 6, "cat, dog")], "book_id int, page_number int, extracted_text string")
    assert rows(phonics.phonics_lines(df), "page_number", "pattern") == [(1, "ai"), (5, "kk")]


def test_source_leaks_inside_longer_words(spark):
    p = spark.createDataFrame([(1, "ead the big red dog ran"), (2, "one two"), (3, "the red dog"), (4, "a big red bus"), (5, "a b c"), (6, "see www.example.org now"), (7, None)], "item_id int, text string")
    d = spark.createDataFrame([(1, "we Read  the big\nred dog ranch"), (2, "the big red dog"), (3, None), (4, "see The red dog run"), (5, "xa big red busy a b c see www.example.org now")], "doc_id int, text string")
    assert rows(reconcile.source_leaks(p, d), "item_id", "doc_id") == [(1, 1), (3, 4), (4, 5)]
    assert rows(reconcile.source_leaks(p, d, exempt=[]), "item_id", "doc_id")[-1] == (6, 5)
    assert reconcile.source_leaks(p.where("item_id = 2"), d).count() == 0


def test_titles_are_found_and_reconciled(spark):
    spans = spark.createDataFrame([(1, 1, "12", 60.0), (1, 2, "Big Studio", 50.0), (1, 3, "A Place", 40.0), (1, 4, "Of Fun", 40.0)], "page_id int, span_no int, text string, font_size double")
    assert rows(reconcile.title_candidates(spans), "page_id", "span_no", "title") == [(1, 3, "A Place")]
    pages = spark.createDataFrame([
        (1, 1, "A place  full of fun", "'n Plek Vol Pret"), (1, 2, "x A Place Full of Fun y", "Studio line\n'n Plek van Pret"), (1, 3, "a place full of fun", "'n  plek vol pret"), (1, 4, "series: A place full of fun", "Titels 1 - Ander 2 - 'n PLEK VAN PRET 3 - Slot"),
        (1, 5, "nothing", "'n Plek van Pret"), (1, 6, "A place full of fun", None), (2, 1, "Solo", "Alleen")], "book_id int, page_number int, source_text string, translated_text string")
    titles = spark.createDataFrame([(1, "A Place Full of Fun"), (2, "Solo")], "book_id int, title string")
    found = reconcile.title_variants(pages, titles)
    assert rows(found, "book_id", "page_number", "variant", "variant_group") == [(1, 1, "'n Plek Vol Pret", 0), (1, 2, "'n Plek van Pret", 1), (1, 3, "'n  plek vol pret", 0), (1, 4, "Titels 1 - Ander 2 - 'n PLEK VAN PRET 3 - Slot", 2), (2, 1, "Alleen", 0)]
    assert rows(reconcile.canonical_groups(found), "book_id", "canonical", "pages") == [(1, "'n Plek Vol Pret", 2), (2, "Alleen", 1)]
    assert rows(reconcile.reconciled_titles(found, pages), "page_number", "text", "changed_from") == [(2, "Studio line\n'n Plek Vol Pret", "'n Plek van Pret"), (4, "Titels 1 - Ander 2 - 'n Plek Vol Pret 3 - Slot", "'n Plek van Pret")]


def test_fingerprints_and_exercises(spark):
    base = {"source_version": "1", "manifest_version": "2", "engine_version": "3", "item_translations": '{"a":"x","b":{"c":1,"d":2}}', "typography_policy": None, "fit_policies": "[]", "repair_revisions": "[]"}
    same = {**base, "item_translations": '{ "b": {"d":2, "c":1}, "a":"x" }', "typography_policy": "[]"}
    other, moved = {**base, "item_translations": '{"a":"y","b":{"c":1,"d":2}}'}, {**base, "fit_policies": "[1]"}
    df = spark.createDataFrame([(i, *d.values()) for i, d in enumerate((base, same, other, moved))], "i int, " + ", ".join(f"{k} string" for k in base))
    got = {r.i: r for r in reconcile.render_fingerprint(df, "i").collect()}
    assert got[0] .fingerprint == got[1].fingerprint and len({r.fingerprint for r in got.values()}) == 3 and got[0].text_hash == got[3].text_hash != got[2].text_hash
    contract = '{"exercises":[{"id":"e1","components":[{"source_id":"a"},{"source_id":"a"},{"role":"x"}]},{"id":"e2","components":[]}]}'
    editions = spark.createDataFrame([(1, "en", None), (2, "en", '{"exercises":[]}'), (3, "en", contract), (4, "af", '{"exercises":[{"id":"e","components":[{"source_id":"a"}]}]}'), (5, None, "junk")], "edition_id int, language string, exercise_contract string")
    assert rows(reconcile.educational_issues(editions), "edition_id", "code", "exercise_id", "source_id") == [
        (2, "EMPTY_EXERCISE", None, None), (3, "DUPLICATE_COMPONENT_ID", "e1", "a"), (3, "EMPTY_EXERCISE", "e2", None), (3, "UNKNOWN_OR_INVALID_COMPONENT_ID", "e1", None), (4, "UNSUPPORTED_EDUCATIONAL_VALIDATOR", None, None), (5, "EMPTY_EXERCISE", None, None)]


def test_payloads_and_reports(spark):
    both = spark.createDataFrame([(1, '{"pages":[{"page_number":1,"translated_text":" a "}]}'), (2, '{"items":[{"id":"x","page_number":1,"translation":"a"},{"id":"y","page_number":1,"translation":"b"}]}'), (3, "junk"), (4, None)], "doc_id int, payload string")
    assert rows(ingest.targets_by_page(both), "doc_id", "page_number", "text") == [(1, 1, "a"), (2, 1, "a\nb")]
    reports = spark.createDataFrame([('{"a":1}',), ('"{\\"a\\":1}"',), ("no",), ("[1]",), (None,)], "r string").select(ingest.decoded_report(F.col("r")).alias("d"))
    assert [r.d for r in reports.collect()] == ['{"a":1}', '{"a":1}', None, None, None]


def test_merged_header_cells(spark):
    columns = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(65.0, 137.0), (137.0, 208.0), (208.0, 280.0), (280.0, 400.0)])], "page_id int, column int, c0 double, c1 double")
    bands = spark.createDataFrame([(1, 100.0, 120.0)], "page_id int, y0 double, y1 double")
    lines = spark.createDataFrame([(1, 65.0, 100.0, 300.0), (1, 137.0, 119.0, 300.0), (1, 208.0, 120.0, 300.0), (1, 280.0, 99.0, 300.0), (1, 281.0, 100.0, 120.0)], "page_id int, x double, y0 double, y1 double")
    spans = spark.createDataFrame([(1, 1, "WORDS", 150.0, 105.0, 190.0, 115.0), (1, 2, "HIGH FREQUENCY", 300.0, 101.0, 380.0, 109.0), (1, 3, "WORDS", 325.0, 111.0, 360.0, 119.0)], "page_id int, span_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.header_cells(columns, bands, lines, spans), "cell", "x0", "x1", "text", "column_start", "column_end", "column_span") == [(0, 65.0, 280.5, "WORDS", 0, 2, 3), (1, 280.5, 400.0, "HIGH FREQUENCY WORDS", 2, 3, 2)]


def test_last_report_of_a_log(spark):
    logs = ['\ufeff {"a":1}', 'x {"a":1} y {"b":{"c":2}} z', "{bad} {", "", None, '[1,2]', 'n {"a":"}"}', '{"a":1} {broken}']
    got = [r.j for r in spark.createDataFrame([(i, t) for i, t in enumerate(logs)], "i int, t string").orderBy("i").select(ingest.last_report(F.col("t")).alias("j")).collect()]
    assert got == ['{"a":1}', '{"b":{"c":2}}', None, None, None, "[1,2]", None, '{"a":1}']


def test_wrapped_lines_are_joined(spark):
    lines = ["3 letter consonant blends at the", "beginning of words:", "cat", "dog", "- gg", "eier", "oe", "boek, koek", "ai - plain, rain", "more here", "THE END"]
    spans = spark.createDataFrame([(1, i, t, False, 10.0, 12.0 * i, 90.0, 12.0 * i + 10) for i, t in enumerate(lines)] + [(1, 50, "other column text", False, 300.0, 0.0, 390.0, 10.0), (1, 51, "goes on here", False, 301.0, 12.0, 390.0, 22.0), (1, 60, "7", True, 10.0, 200.0, 20.0, 210.0)], "page_id int, span_no int, text string, is_page_number boolean, x0 double, y0 double, x1 double, y1 double")
    got = [(r.text, r.lines) for r in extras.continuation_lines(spans).orderBy("place").collect()]
    assert got == [("3 letter consonant blends at the beginning of words:", 2), ("other column text goes on here", 2), ("cat", 1), ("dog", 1), ("- gg eier", 2), ("oe boek, koek", 2), ("ai - plain, rain", 1), ("more here", 1), ("THE END", 1), ("7", 1)]


def test_page_changes_over_batches(spark, tmp_path):
    made = [(1, 1, "a"), (1, 2, "a"), (2, 3, None), (1, 4, "b"), (1, 5, "a"), (2, 6, ""), (2, 7, "x")]
    for i in range(0, len(made), 3):
        spark.createDataFrame(made[i : i + 3], "page_id long, seq long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pages = spark.readStream.schema("page_id long, seq long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = feeds.run_once(feeds.page_changes(pages), "page_changes", f"{tmp_path}/cp", "append")
    assert rows(out, "page_id", "seq") == [(1, 1), (1, 4), (1, 5), (2, 3), (2, 7)]


def test_catalog_types(spark, tmp_path):
    spark.createDataFrame([(1, 2.345), (2, None)], "id int, price double").write.parquet(f"{tmp_path}/editions.parquet")
    got = views.load_catalog(spark, str(tmp_path), {"editions": "id long, price decimal(8,2), note string"})["editions"]
    assert got.dtypes == [("id", "bigint"), ("price", "decimal(8,2)"), ("note", "string")] and sorted(str(r.price) for r in got.collect()) == ["2.35", "None"]


def test_html_and_links(spark):
    html = '<html lang="af"><script>x<y</script><p>One</p>\n<p> </p><a href="javascript:1">b</a><a href="http://x">c</a></html>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert [r.text for r in ingest.html_lines(df).orderBy("line").collect()] == ["One", "b  c"]
    assert rows(ingest.link_risks(df.where("page_id = 1")), "links", "risky") == [(2, 1)]
    assert rows(ingest.declared_language(df), "page_id", "language") == [(1, "af"), (2, None)]


def test_wordlist_composes(spark):
    df = spark.createDataFrame([("12",), ("café/AB",), ("A",), ("Don't/M",), ("x1y",), ("i.e.",)], "line string")
    assert sorted(r.word for r in ingest.build_wordlist(df).collect()) == ["café", "don't", "ie"]


def test_stream_appends_closed_days(spark, tmp_path):
    rows_ = spark.sql("SELECT 'view' AS event_type, make_timestamp_ntz(2024, 1, cast(id % 4 + 1 AS int), 1, 0, 0) AS ts FROM range(20)")
    rows_.repartition(1).write.parquet(f"{tmp_path}/in")
    out = feeds.run_once(feeds.daily_counts(feeds.event_stream(spark, f"{tmp_path}/in", rows_)), "closed_days", f"{tmp_path}/cp", "append")
    assert rows(out, "day", "n") == [(f"2024-01-0{d}", 5) for d in (1, 2, 3)]


def test_streamed_results_are_files(spark, tmp_path):
    rows_ = spark.range(40).selectExpr("id AS event_id", "id % 7 AS user_id", "CAST(id % 3 AS STRING) AS event_type", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts")
    rows_.repartition(3).write.parquet(f"{tmp_path}/in")
    states = feeds.latest_state(spark.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    out = feeds.run_once(states, "states_in_files", f"{tmp_path}/cp", "complete")
    assert out.inputFiles() and sorted(map(tuple, out.collect())) == sorted(map(tuple, feeds.latest_state(rows_).collect()))


def test_full_text_keeps_the_separator_at_the_cut(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, "def"), (2, 1, "abcd"), (2, 2, "e")], "book_id int, page_number int, extracted_text string")
    assert rows(textsig.full_text(pages, "\n", 4), "book_id", "sample") == [(1, "abc\n"), (2, "abcd")]
    assert rows(textsig.full_text(pages, "--", 4), "sample") == [("abc-",), ("abcd",)]


def test_script_label_ties_with_other_characters(spark):
    docs = spark.createDataFrame([(1, "ab\u2200\u2203"), (2, "\u2200\u2203ab"), (3, "abc\u2200\u2203"), (4, "ab\u05d0\u05d1")], "doc_id int, text string")
    assert rows(scripts.script_label(docs), "doc_id", "label") == [(1, "Zyyy"), (2, "Zyyy"), (3, "Latn"), (4, "Latn")]


def test_reading_level_is_exact_at_bounds(spark):
    def text(n, ends, letters):
        sizes = [letters // n + (i < letters % n) for i in range(n)]
        return " ".join("a" * (k - (i < ends)) + "." * (i < ends) for i, k in enumerate(sizes))

    pages = spark.createDataFrame([(i, 1, text(*x)) for i, x in enumerate([(18, 4, 171), (48, 9, 96), (77, 11, 429), (128, 3, 589)])], "book_id int, page_number int, extracted_text string")
    assert rows(textsig.reading_level(pages), "book_id", "words", "sentences", "score", "level") == [(0, 18, 4, 16.0, "advanced"), (1, 48, 9, 6.0, "beginner"), (2, 77, 11, 12.0, "independent"), (3, 128, 3, 32.042187, "advanced")]


def test_header_labels_of_tied_boxes(spark):
    spans = [(1, 1, "a", 0.0, 0.0, 10.0, 5.0), (1, 2, "b", 30.0, 0.0, 31.0, 5.0), (1, 2, "b", 30.0, 0.0, 90.0, 5.0)]
    schema = "page_id int, span_no int, text string, x0 double, y0 double, x1 double, y1 double"
    want = [(1, "a"), (2, "b b")]
    for order in itertools.permutations(spans):
        assert rows(layout.header_labels(spark.createDataFrame(list(order), schema)), "label_no", "label") == want


def test_inferred_tables_when_pages_are_shuffled(spark):
    # pages of three columns and four rows: boxes of both axes must meet however the joins are dealt
    spans = spark.range(6000).selectExpr("id % 500 AS page_id", "cast(100 * (id div 500 % 3) AS double) AS x0", "cast(40 * (id div 1500) AS double) AS y0").selectExpr("*", "x0 + 50 AS x1", "y0 + 10 AS y1").repartition(7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables, columns = layout.inferred_tables(spans, 600.0)
        assert rows(tables.groupBy("columns", "table_rows").count(), "columns", "table_rows", "count") == [(3, 4, 500)]
        assert rows(columns.groupBy("column", "x_start", "x_end", "items").count(), "column", "x_start", "x_end", "items", "count") == [(1, 20.0, 50.0, 4, 500), (2, 52.0, 150.0, 4, 500), (3, 152.0, 270.0, 4, 500)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_of_layout_grow_with_the_table(spark, monkeypatch):
    spans = spark.range(100).selectExpr("id % 20 AS page_id", "id AS span_no", "cast(id AS double) AS x0", "cast(id AS double) AS y0")
    monkeypatch.setattr(layout, "TASK_ROWS", 10)
    found = layout.clusters(spans, "page_id", "y0", 12.0)
    for out in (found, layout.nearest_centre(spans, found, "page_id", "y0"), layout.column_bounds(spans)):
        assert out.rdd.getNumPartitions() == 10


def test_fallback_fonts_make_a_name_plain_once(spark):
    fonts = spark.createDataFrame([("Times New-Roman",), ("Playpen Sans",), (None,)], "font string").withColumn("f", gates.is_fallback(F.col("font"), ["playpensans"]))
    assert rows(fonts, "f") == [(False,), (False,), (True,)]
    assert fonts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
