"""Discovery queries over the catalogue views."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafworks.operators import catalog as C

from .registry import Inputs, query

PLACE, DAY = "ASIA", "1997-01-01"
GATE = ("books", "editions", "edition_rights")
PASSES = f"digital_rights AND (licence_start IS NULL OR licence_start <= DATE '{DAY}') AND (licence_end IS NULL OR licence_end >= DATE '{DAY}') AND territory IN ('*', '{PLACE}')"
VISIBLE = f"""vis AS (SELECT * FROM editions e WHERE publication_status = 'published' AND (NOT EXISTS (SELECT 1 FROM edition_rights r WHERE r.edition_id = e.edition_id)
 OR EXISTS (SELECT 1 FROM edition_rights r WHERE r.edition_id = e.edition_id AND {PASSES}))),
pub AS (SELECT * FROM books b WHERE status = 'published' AND EXISTS (SELECT 1 FROM vis WHERE vis.book_id = b.book_id))"""


def visible(t: Inputs):
    return C.published_books(t.books, t.editions, t.edition_rights, PLACE, DAY)


@query("B1_published_books", "SELECT book_id, title, series FROM pub", GATE, VISIBLE)
def _(t):
    return visible(t).select("book_id", "title", "series")


@query("B2_rights_pass", f"SELECT edition_id, territory FROM edition_rights WHERE {PASSES}", ("edition_rights",))
def _(t):
    return C.rights_pass(t.edition_rights, PLACE, DAY).select("edition_id", "territory")


@query("B2b_null_territories", f"SELECT edition_id, nulled FROM (SELECT *, CASE WHEN territory = 'EUROPE' THEN NULL ELSE territory END AS nulled FROM edition_rights) WHERE {PASSES.replace('territory IN', 'coalesce(nulled, ' + chr(39) + '*' + chr(39) + ') IN')}", ("edition_rights",))
def _(t):
    rights = t.edition_rights.withColumn("territory", F.when(F.col("territory") != "EUROPE", F.col("territory")))
    return C.rights_pass(rights, PLACE, DAY, null_territories="allow").select("edition_id", F.col("territory").alias("nulled"))


@query("B3_type_and_series", "SELECT book_id FROM pub WHERE book_type LIKE 'standard%' AND series = 'Brand#13'", GATE, VISIBLE)
def _(t):
    return visible(t).where("book_type LIKE 'standard%' AND series = 'Brand#13'").select("book_id")


@query("B4_age_contains", "SELECT book_id, age_min, age_max FROM pub WHERE age_min <= 5 AND age_max >= 5", GATE, VISIBLE)
def _(t):
    return visible(t).where(C.age_contains(5)).select("book_id", "age_min", "age_max")


@query("B5_category_filter", "SELECT book_id FROM books WHERE book_id IN (SELECT ps FROM (SELECT l_partkey AS ps, l_returnflag AS slug FROM lineitem) WHERE slug = 'A')", ("books",))
def _(t):
    links = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("slug"))
    return C.in_category(t.books, links, "A").select("book_id")


# Levels, phases and features of the editions.
FACETED = """ed AS (SELECT *, 'r' || reading_rank AS reading_level, CASE edition_id % 3 WHEN 0 THEN 'foundation' WHEN 1 THEN 'senior' END AS education_phase FROM editions),
ef AS (SELECT DISTINCT l_partkey * 10000 + l_suppkey AS edition_id, CASE l_returnflag WHEN 'A' THEN 'narrated' WHEN 'R' THEN 'read_along' ELSE 'word_highlighting' END AS feature FROM lineitem)"""


def faceted(t: Inputs):
    phase = F.when(F.col("edition_id") % 3 == 0, "foundation").when(F.col("edition_id") % 3 == 1, "senior")
    feature = F.when(F.col("l_returnflag") == "A", "narrated").when(F.col("l_returnflag") == "R", "read_along").otherwise("word_highlighting")
    editions = t.editions.withColumn("reading_level", F.concat(F.lit("r"), F.col("reading_rank").cast("string"))).withColumn("education_phase", phase)
    return editions, t.lineitem.select((F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("edition_id"), feature.alias("feature")).distinct()


@query("B8_same_edition_facets", """SELECT book_id FROM pub WHERE EXISTS (SELECT 1 FROM ed e WHERE e.book_id = pub.book_id AND publication_status = 'published' AND language_code IN ('l3', 'l8') AND coalesce(price, 0) > 0 AND education_phase = 'senior'
 AND EXISTS (SELECT 1 FROM ef WHERE ef.edition_id = e.edition_id AND feature IN ('narrated', 'read_along')) AND EXISTS (SELECT 1 FROM ef WHERE ef.edition_id = e.edition_id AND feature = 'read_along') AND language_code = 'l3')""", GATE, VISIBLE + ", " + FACETED)  # fmt: skip
def _(t):
    return C.with_edition(visible(t), *faceted(t), C.EditionFacets(language="l3", price="paid", education_phase="senior", narrated=True, feature="read_along")).select("book_id")


@query("B8_asked_facets", """SELECT DISTINCT a.ask_id, e.book_id FROM (VALUES (1, 'l3', 'r2', NULL, NULL, 'free', false), (2, NULL, NULL, 'foundation', 'word_highlighting', NULL, true), (3, 'l5', NULL, NULL, NULL, 'paid', true)) a(ask_id, l, r, p, f, c, n), ed e
 WHERE publication_status = 'published' AND coalesce(l = language_code, true) AND coalesce(r = reading_level, true) AND (p IS NULL OR coalesce(p = education_phase, false)) AND (c IS NULL OR (c = 'free') = (coalesce(price, 0) = 0))
 AND (f IS NULL OR EXISTS (SELECT 1 FROM ef WHERE ef.edition_id = e.edition_id AND feature = f)) AND (NOT n OR EXISTS (SELECT 1 FROM ef WHERE ef.edition_id = e.edition_id AND feature IN ('narrated', 'read_along')))""", ("editions",), FACETED)  # fmt: skip
def _(t):
    asks = {1: C.EditionFacets(language="l3", reading_level="r2", price="free"), 2: C.EditionFacets(education_phase="foundation", feature="word_highlighting", narrated=True), 3: C.EditionFacets(language="l5", price="paid", narrated=True)}
    asked = None
    for i, f in asks.items():
        row = t.spark.range(1).select(F.lit(i).alias("ask_id"), f.row().alias("facets"))
        asked = row if asked is None else asked.unionByName(row)
    return C.edition_matches(asked, *faceted(t))


@query("B9_narrated", "SELECT book_id FROM pub WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = pub.book_id AND l_returnflag IN ('A', 'R'))", GATE, VISIBLE)
def _(t):
    features = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("feature"))
    return C.narrated(visible(t), features, ["A", "R"]).select("book_id")


@query("B10_price", "SELECT edition_id, price, CASE WHEN coalesce(price, 0) = 0 THEN 'free' ELSE 'paid' END AS price_kind FROM editions", ("editions",))
def _(t):
    return t.editions.select("edition_id", "price", F.when(C.price_is("free"), "free").otherwise("paid").alias("price_kind"))


@query("B11_search", """SELECT book_id, title FROM pub WHERE lower(title) LIKE '%af%' OR lower(series) LIKE '%af%' OR book_id IN
 (SELECT l_partkey FROM lineitem WHERE lower(l_returnflag || l_linestatus) LIKE '%af%')""", GATE, VISIBLE)  # fmt: skip
def _(t):
    named = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.concat("l_returnflag", "l_linestatus").alias("name"))
    return C.search(visible(t), " AF ", ["title", "series"], named).select("book_id", "title")


@query("B12_facet_counts", """SELECT 'book_type' AS facet, book_type AS value, count(*) AS n FROM pub WHERE book_type IS NOT NULL GROUP BY book_type
 UNION ALL SELECT 'series', series, count(*) FROM pub WHERE series IS NOT NULL GROUP BY series""", GATE, VISIBLE)  # fmt: skip
def _(t):
    return C.facet_counts(visible(t), ["book_type", "series"])


@query("B12_category_counts", "SELECT l_returnflag AS category, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey IN (SELECT book_id FROM pub) GROUP BY 1", GATE, VISIBLE)
def _(t):
    links = t.lineitem.select(F.col("l_partkey").alias("book_id"), F.col("l_returnflag").alias("category"))
    modes = links.select("category").distinct().withColumn("active", F.col("category") != "N")
    return C.category_counts(links.join(visible(t).select("book_id"), "book_id", "left_semi"), modes)


MEMBERS = "m AS (SELECT book_id, series AS collection_id, book_id % 7 = 0 AS pinned, age_min AS sort_order FROM books)"


@query("B13_collection_order", "SELECT collection_id, book_id, row_number() OVER (PARTITION BY collection_id ORDER BY pinned DESC, sort_order, book_id) AS position FROM m", ("books",), MEMBERS)
def _(t):
    m = t.books.select("book_id", F.col("series").alias("collection_id"), (F.col("book_id") % 7 == 0).alias("pinned"), F.col("age_min").alias("sort_order"))
    return C.collection_order(m).select("collection_id", "book_id", "position")


@query("B15_rule_collection", """SELECT book_id, 0 AS tier FROM books WHERE book_id % 50 = 0 UNION ALL
 SELECT book_id, 1 FROM pub WHERE age_min <= 3 AND age_max >= 3 AND book_id % 50 <> 0""", GATE, VISIBLE)  # fmt: skip
def _(t):
    return C.rule_collection(visible(t).where(C.age_contains(3)), t.books.where("book_id % 50 = 0").select("book_id"))


@query("B16_collection_scope", """SELECT 'full' AS asked, book_id FROM pub WHERE series = 'Brand#22' AND age_min <= 5 AND age_max >= 5 UNION ALL SELECT 'unknown', book_id FROM pub WHERE age_min <= 5 AND age_max >= 5""", GATE, VISIBLE)
def _(t):
    members = t.books.select(F.col("series").alias("collection_id"), "book_id")
    collections = members.select("collection_id", F.lower("collection_id").alias("slug")).distinct().unionByName(t.spark.createDataFrame([("none", "empty")], "collection_id string, slug string"))
    found = visible(t).where(C.age_contains(5))
    scoped = lambda slug: C.collection_scope(found, collections, members, slug)
    return scoped("brand#22").select(F.lit("full").alias("asked"), "book_id").unionByName(scoped("no such").select(F.lit("unknown").alias("asked"), "book_id")).unionByName(scoped("empty").select(F.lit("empty").alias("asked"), "book_id"))


@query("B17_band_age", """SELECT book_id, CASE age_min % 6 WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 11 WHEN 4 THEN 14 ELSE 16 END AS age FROM books""", ("books",))
def _(t):
    label = F.element_at(F.array(*[F.lit(x) for x in C.BAND_AGES]), (F.col("age_min") % 6 + 1).cast("int"))
    return t.books.select("book_id", C.band_age(label).alias("age"))


@query("B18_catalogue_page", "SELECT book_id, title FROM pub ORDER BY title, book_id LIMIT 12 OFFSET 12", GATE, VISIBLE)
def _(t):
    return C.catalogue_page(visible(t), "title_az", page=2).select("book_id", "title")


TAGS = """tg AS (SELECT p_partkey AS tag_id, split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) AS slug, p_name || ' No ' || p_partkey % 30 AS canonical_name, CASE p_partkey % 4 WHEN 0 THEN 'themes_and_values' WHEN 1 THEN 'topics' ELSE 'characters' END AS "group",
 CASE WHEN p_partkey % 5 = 0 THEN 'pending' WHEN p_partkey % 7 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_partkey % 6 = 0 THEN p_partkey // 2 WHEN p_partkey % 11 = 0 THEN 999999999 END AS merged_into FROM part)"""


def tags(t: Inputs):
    k, word = F.col("p_partkey"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    return t.part.select(k.alias("tag_id"), F.concat_ws("-", word(1), word(2)).alias("slug"), F.concat("p_name", F.lit(" No "), (k % 30).cast("string")).alias("canonical_name"), F.when(k % 4 == 0, "themes_and_values").when(k % 4 == 1, "topics").otherwise("characters").alias("group"),
                         F.when(k % 5 == 0, "pending").when(k % 7 == 0, "archived").otherwise("active").alias("status"), F.when(k % 6 == 0, F.expr("p_partkey div 2")).when(k % 11 == 0, F.lit(999999999)).cast("long").alias("merged_into"))


@query("B19_filter_options", """SELECT DISTINCT 'language' AS kind, language_code AS value, upper(language_code) AS label FROM ed WHERE publication_status = 'published' UNION ALL SELECT DISTINCT 'education_phase', education_phase, NULL FROM ed WHERE publication_status = 'published' AND education_phase IS NOT NULL
 UNION ALL SELECT "group", slug, canonical_name FROM tg WHERE status = 'active' AND "group" IN ('themes_and_values', 'topics')""", ("editions",), FACETED + ", " + TAGS)  # fmt: skip
def _(t):
    return C.filter_options(faceted(t)[0].withColumn("language_name", F.upper("language_code")), tags(t))


@query("B20_filter_chips", """SELECT DISTINCT facet, v AS value, CASE facet WHEN 'age' THEN 'Age ' || v WHEN 'series' THEN v WHEN 'narrated' THEN 'Narrated' ELSE upper(v[1:1]) || v[2:] END AS chip FROM (SELECT unnest(['book_type', 'age', 'series', 'narrated']) AS facet,
 unnest([split_part(book_type, ' ', 1), age_min::VARCHAR, series, CASE WHEN book_id % 3 = 0 THEN '1' ELSE '' END]) AS v FROM books) WHERE v <> ''""", ("books",))  # fmt: skip
def _(t):
    values = {"book_type": F.split_part("book_type", F.lit(" "), F.lit(1)), "age": F.col("age_min").cast("string"), "series": F.col("series"), "narrated": F.when(F.col("book_id") % 3 == 0, "1").otherwise("")}
    return C.filter_chips(t.books.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in values.items()])).alias("f")).select("f.*").distinct())


@query("B21_next_in_series", "SELECT book_id, lead(book_id) OVER (PARTITION BY series ORDER BY series_volume, book_id) AS next_id FROM books", ("books",))
def _(t):
    return C.next_in_series(t.books)


@query("B21_next_by_rank", """SELECT b.book_id, coalesce(
 (SELECT c.book_id FROM r AS c WHERE c.series = b.series AND c.series_volume > b.series_volume AND c.rank <= b.rank + 1 ORDER BY c.series_volume LIMIT 1),
 (SELECT c.book_id FROM r AS c WHERE c.series = b.series AND c.series_volume > b.series_volume ORDER BY c.series_volume LIMIT 1)) AS next_id FROM r AS b""",
 ("books", "editions"), "r AS (SELECT books.*, k.rank FROM books LEFT JOIN (SELECT book_id, min(reading_rank) AS rank FROM editions GROUP BY 1) k USING (book_id))")
def _(t):
    return C.next_in_series(t.books, t.editions.groupBy("book_id").agg(F.min("reading_rank").alias("rank")))


@query("B22_best_description", """SELECT book_id, edition_id AS description_id, language_code FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY
 CASE language_code WHEN 'l4' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, edition_id) AS r FROM editions WHERE publication_status = 'published') WHERE r = 1""", ("editions",))  # fmt: skip
def _(t):
    d = t.editions.select("book_id", F.col("edition_id").alias("description_id"), "language_code", F.when(F.col("publication_status") == "published", "approved").otherwise("draft").alias("status"))
    return C.best_description(d, "l4").drop("status")


@query("B24_effective_id", """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey WHEN n_nationkey >= 20 THEN n_nationkey ELSE (n_nationkey // 5) * 5 + 4 END AS effective_id FROM nation""")
def _(t):
    # chains of five: 0 -> 1 -> 2 -> 3 -> 4; the last one's steps lead to ids that don't exist
    merged = F.when(F.col("n_nationkey") >= 20, F.col("n_nationkey") + 100).when(F.col("n_nationkey") % 5 < 4, F.col("n_nationkey") + 1)
    return C.effective_ids(t.nation.select(F.col("n_nationkey").cast("long").alias("id"), merged.cast("long").alias("merged_into"))).select(F.col("id").cast("int").alias("id"), F.col("effective_id").cast("int").alias("effective_id"))


@query("B24_long_chains", """SELECT id, CASE WHEN id % 30 <> 29 AND lead(id, (29 - id % 30)::INT) OVER (ORDER BY id) IS NULL AND id % 30 + 20 >= (SELECT max(id) FROM s) % 30 + 1 AND id // 30 = (SELECT max(id) FROM s) // 30 THEN id ELSE least(id + 20, id // 30 * 30 + 29) END AS effective_id FROM s""", (), "s AS (SELECT o_orderkey AS id FROM (SELECT DISTINCT (o_orderkey // 4)::BIGINT AS o_orderkey FROM orders))")
def _(t):
    s = t.orders.select(F.expr("cast(o_orderkey div 4 AS long)").alias("id")).distinct()
    return C.effective_ids(s.select("id", F.when(F.col("id") % 30 < 29, F.col("id") + 1).alias("merged_into")))


@query("B26_audience_band", """SELECT p_partkey, CASE WHEN a <= 3 THEN '0-3' WHEN a <= 6 THEN '4-6' WHEN a <= 9 THEN '7-9' WHEN a <= 12 THEN '10-12' WHEN a <= 15 THEN '13-15' ELSE '16+' END AS band
 FROM (SELECT p_partkey, least(p_size, 50 - p_size) AS a FROM part)""")  # fmt: skip
def _(t):
    edges = [("0-3", -99, 3), ("4-6", 4, 6), ("7-9", 7, 9), ("10-12", 10, 12), ("13-15", 13, 15), ("16+", 16, 999)]
    bands = t.spark.createDataFrame([(b, lo, hi, i) for i, (b, lo, hi) in enumerate(edges)], "band string, min_age int, max_age int, sort_order int")
    rows = t.part.select("p_partkey", F.col("p_size").alias("low"), (50 - F.col("p_size")).alias("high"))
    return C.audience_band(rows, "low", "high", bands).select("p_partkey", "band")


# A string is a tag's slug, else its whole name, else a label (the second word), else an alias (a number); the tag is followed through at most 20 merges.
RESOLVED = """q AS (SELECT p_partkey AS book_id, unnest([' ' || upper(split_part(p_name, ' ', 1)) || '_' || split_part(p_name, ' ', 2), p_name || ' nO ' || p_partkey % 31, split_part(p_name, ' ', 2), 'alias ' || p_partkey % 50, 'New  ' || split_part(p_name, ' ', 2) || '!']) AS tag FROM part),
a AS (SELECT DISTINCT book_id, lower(trim(tag)) AS norm FROM q WHERE trim(tag) <> ''), k AS (SELECT DISTINCT norm, trim(regexp_replace(regexp_replace(replace(norm, '_', '-'), '[^-\\p{L}\\p{N}\\s]+', '', 'g'), '[-\\s]+', '-', 'g'), '-') AS slug FROM a),
f AS (SELECT norm, slug, coalesce((SELECT min(tag_id) FROM tg WHERE tg.slug = k.slug), (SELECT min(tag_id) FROM tg WHERE lower(canonical_name) = norm), (SELECT min(tag_id) FROM tg WHERE lower(split_part(canonical_name, ' ', 2)) = norm), (SELECT min(tag_id) FROM tg WHERE 'alias ' || tag_id % 40 = norm AND tag_id % 3 = 0)) AS hit FROM k),
RECURSIVE_w"""
WALK = "w AS (SELECT tag_id AS hit, tag_id AS top, 0 AS n FROM tg UNION ALL SELECT w.hit, y.tag_id, n + 1 FROM w JOIN tg x ON x.tag_id = w.top JOIN tg y ON y.tag_id = x.merged_into WHERE n < 20), e AS (SELECT hit, arg_max(top, n) AS tag_id FROM w GROUP BY 1), m AS (SELECT f.norm, tg.tag_id, coalesce(tg.slug, f.slug) AS slug, coalesce(status, 'pending') AS status FROM f LEFT JOIN e USING (hit) LEFT JOIN tg ON tg.tag_id = e.tag_id)"
RESOLVED = RESOLVED.replace("RECURSIVE_w", WALK)


def resolved_tags(t: Inputs):
    known, word = tags(t), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    strings = F.array(F.concat(F.lit(" "), F.upper(word(1)), F.lit("_"), word(2)), F.concat("p_name", F.lit(" nO "), (F.col("p_partkey") % 31).cast("string")), word(2), F.concat(F.lit("alias "), (F.col("p_partkey") % 50).cast("string")), F.concat(F.lit("New  "), word(2), F.lit("!")))
    labels = known.select("tag_id", F.split_part("canonical_name", F.lit(" "), F.lit(2)).alias("name"))
    aliases = known.where("tag_id % 3 = 0").select("tag_id", F.concat(F.lit("alias "), (F.col("tag_id") % 40).cast("string")).alias("name"))
    return C.resolve_tags(t.part.select(F.col("p_partkey").alias("book_id"), F.explode(strings).alias("tag")), known, labels, aliases)


@query("B27_resolve_tags", """SELECT DISTINCT book_id, tag_id, slug, status, CASE status WHEN 'active' THEN 'matched' ELSE 'pending' END AS "group" FROM a JOIN m USING (norm)""", (), TAGS + ", " + RESOLVED, recursive=True)
def _(t):
    return resolved_tags(t)[0]


@query("B27_pending_tags", "SELECT slug, array_to_string(list_transform(string_split(min(norm), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') AS canonical_name FROM m WHERE tag_id IS NULL GROUP BY 1", (), TAGS + ", " + RESOLVED, recursive=True)
def _(t):
    return resolved_tags(t)[1]


@query("B32_best_suggestion", "SELECT user_id, event_type, event_id AS value, value AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def _(t):
    rows = t.events.select("user_id", "event_type", F.col("event_id").alias("value"), F.col("value").alias("confidence"))
    return C.best_suggestion(rows, ["user_id", "event_type"], "value", "confidence")



@query("B32_preselected_tags", """SELECT book_id, array_to_string(list_concat(coalesce(list_sort(list(slug) FILTER (o)), []), coalesce(list(slug ORDER BY s) FILTER (NOT o), [])), ',') AS tags FROM (SELECT book_id, slug, min(s) AS s, bool_or(o) AS o FROM
 (SELECT o_custkey AS book_id, 'c' || o_orderkey % 13 AS slug, o_orderkey AS s, false AS o FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT o_custkey, 'c' || o_orderkey % 7, NULL, true FROM orders WHERE o_orderkey % 4 = 1) GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def _(t):
    k, named = F.col("o_orderkey"), lambda n: F.concat(F.lit("c"), (F.col("o_orderkey") % n).cast("string")).alias("tag")
    suggested = t.orders.select(F.col("o_custkey").alias("book_id"), named(13), k.alias("seq"), (k % 4 == 1).alias("pending"))
    return C.preselected_tags(suggested, t.orders.where("o_orderkey % 4 = 1").select(F.col("o_custkey").alias("book_id"), named(7))).withColumn("tags", F.array_join("tags", ","))
