"""Catalogue discovery: rights-gated filters, search, facets, collections, series and tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rights_pass(rights: DataFrame, territory: str, today: str, null_territories: str = "deny") -> DataFrame:
    """Rights rows that allow digital sale in territory on today; bounds are inclusive and open where null.

    rights has one row a territory; '*' is everywhere. A null territory denies, or, with null_territories 'allow', is
    everywhere.
    """
    day = F.lit(today).cast("date")
    start = F.col("licence_start").isNull() | (F.col("licence_start") <= day)
    end = F.col("licence_end").isNull() | (F.col("licence_end") >= day)
    place = F.coalesce(F.col("territory").isin("*", territory), F.lit(null_territories == "allow"))
    return rights.where(F.col("digital_rights") & start & end & place)


def visible_editions(editions: DataFrame, rights: DataFrame, territory: str, today: str) -> DataFrame:
    """Published editions without any rights row, or with one that passes."""
    published = editions.where(F.col("publication_status") == "published")
    free = published.join(rights, "edition_id", "left_anti")
    passing = published.join(rights_pass(rights, territory, today), "edition_id", "left_semi")
    return free.unionByName(passing)


def published_books(books: DataFrame, editions: DataFrame, rights: DataFrame, territory: str, today: str) -> DataFrame:
    """Published books with at least one visible edition."""
    seen = visible_editions(editions, rights, territory, today)
    return books.where(F.col("status") == "published").join(seen.select("book_id"), "book_id", "left_semi")


# Features that mean a narration, and those by which a rule asks for one.
NARRATED = ["narrated", "read_along"]
ASKS_NARRATED = ["narrated", "word_highlighting"]


@dataclass(frozen=True)
class EditionFacets:
    """Facets that must all hold on one and the same published edition; None leaves a facet out."""

    language: str | None = None
    reading_level: str | None = None
    education_phase: str | None = None
    narrated: bool = False
    feature: str | None = None
    price: str | None = None  # 'free' or 'paid'

    def row(self) -> Column:
        """The facets as a struct, as edition_matches() takes them."""
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (("language", self.language), ("reading_level", self.reading_level), ("education_phase", self.education_phase), ("feature", self.feature), ("price", self.price))], F.lit(self.narrated).alias("narrated"))


def edition_matches(asked: DataFrame, editions: DataFrame, features: DataFrame) -> DataFrame:
    """ask_id, book_id: books with a published edition for which all that is asked holds together.

    asked: ask_id, facets (a struct as of EditionFacets.row(); null or blank leaves a facet out); editions: edition_id, book_id, language_code, reading_level, education_phase, price, publication_status; features:
    edition_id, feature. Asks meet editions by equal keys: by their language where they name one, else by its place in a list of all languages that published editions have, so no ask is tried against all editions of
    other languages. An edition's features come as an array, joined once.
    """
    bridge = features.groupBy("edition_id").agg(F.collect_set("feature").alias("_features"))
    published = editions.where("publication_status = 'published'").join(bridge, "edition_id", "left").withColumn("_features", F.coalesce("_features", F.array().cast("array<string>")))
    given = lambda c: F.nullif(F.col(f"facets.{c}"), F.lit(""))
    named = asked.where(given("language").isNotNull()).withColumn("_language", given("language"))
    languages = published.select(F.col("language_code").alias("_language")).distinct()
    open_ = asked.where(given("language").isNull())
    every = open_.crossJoin(languages)  # a row for each language of the shop
    keyed = named.unionByName(every)
    joined = keyed.join(published, F.col("_language").eqNullSafe(F.col("language_code")))
    fits = lambda c: given(c).isNull() | F.coalesce(F.col(c) == given(c), F.lit(False))
    price = F.when(given("price") == "free", price_is("free")).when(given("price") == "paid", price_is("paid")).otherwise(True)
    feature = given("feature").isNull() | F.array_contains("_features", given("feature"))
    narrated_ = ~F.coalesce("facets.narrated", F.lit(False)) | F.arrays_overlap("_features", F.array(*[F.lit(x) for x in NARRATED]))
    return joined.where(fits("reading_level") & fits("education_phase") & price & feature & narrated_).select("ask_id", "book_id").distinct()


def price_is(kind: str, price: str = "price") -> Column:
    """free: null or 0; paid: above 0."""
    value = F.coalesce(F.col(price), F.lit(0.0))
    return value == 0 if kind == "free" else value > 0


def with_edition(books: DataFrame, editions: DataFrame, features: DataFrame, facets: EditionFacets) -> DataFrame:
    """Books with an edition for which all facets hold: one semi join, never one a facet; features are asked once, for all facets that need them."""
    found = editions.where("publication_status = 'published'")
    for column, value in (("language_code", facets.language), ("reading_level", facets.reading_level), ("education_phase", facets.education_phase)):
        if value:
            found = found.where(F.col(column) == value)
    if facets.price in ("free", "paid"):
        found = found.where(price_is(facets.price))
    asked = ([F.col("feature").isin(*NARRATED)] if facets.narrated else []) + ([F.col("feature") == facets.feature] if facets.feature else [])
    if asked:
        # relational division: every asked feature is there
        has = features.groupBy("edition_id").agg(*[F.bool_or(a).alias(f"_a{i}") for i, a in enumerate(asked)])
        for i in range(len(asked)):
            has = has.where(f"_a{i}")
        found = found.join(has, "edition_id", "left_semi")
    return books.join(found.select("book_id"), "book_id", "left_semi")


def age_contains(age: int) -> Column:
    """Both bounds known and around age."""
    return (F.col("age_min") <= age) & (F.col("age_max") >= age)


#: Age bands of the shop and the age that stands for each.
BAND_AGES = {"0-3": 2, "4-6": 5, "7-9": 8, "10-12": 11, "13-15": 14, "16+": 16}


def band_age(label: Column) -> Column:
    """The representative age of a band's label; null for others."""
    return F.create_map(*[F.lit(x) for pair in BAND_AGES.items() for x in pair])[label]


def audience_band(rows: DataFrame, low: str, high: str, bands: DataFrame) -> DataFrame:
    """Adds band: the first band by sort_order that holds the lower bound; reversed bounds are swapped. bands is a small dimension."""
    age = F.least(F.col(low), F.col(high))
    bands = bands.select("band", F.col("min_age").alias("_b_min"), F.col("max_age").alias("_b_max"), F.col("sort_order").alias("_b_sort"))
    keyed = rows.withColumn("_b_age", age)
    ages = keyed.select("_b_age").distinct()
    best = ages.join(bands, F.col("_b_age").between(F.col("_b_min"), F.col("_b_max"))).groupBy("_b_age").agg(F.min_by("band", "_b_sort").alias("band"))
    return keyed.join(best, "_b_age", "left").drop("_b_age")


def search(books: DataFrame, term: str, fields: list[str], named: DataFrame | None = None) -> DataFrame:
    """Books whose fields hold term, or that named (book_id, name: tags, aliases, categories) gives; a blank term finds all.

    % and _ in the term are wildcards; case is folded on both sides.
    """
    term = term.strip().lower()
    if not term:
        return books
    like = f"%{term}%"
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.lower(F.col(f)).like(like), F.lit(False))
    if named is None:
        return books.where(found)
    ids = named.where(F.lower("name").like(like)).select("book_id").distinct().withColumn("_named", F.lit(True))
    return books.join(ids, "book_id", "left").where(found | F.col("_named").isNotNull()).drop("_named")


def facet_counts(books: DataFrame, dims: list[str]) -> DataFrame:
    """facet, value, n: books by each value that isn't null of every dimension, in one pass."""
    picked = books.select("book_id", F.explode(F.array(*[F.struct(F.lit(d).alias("facet"), F.col(d).cast("string").alias("value")) for d in dims])).alias("f"))
    return picked.where("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


#: Ids of a collection that one window takes.
STRETCH = 100_000


def category_counts(links: DataFrame, categories: DataFrame) -> DataFrame:
    """category, n: different books of every active category that has some."""
    active = categories.where("active").select("category")
    return links.join(active, "category", "left_semi").groupBy("category").agg(F.count_distinct("book_id").alias("n"))


def collection_order(members: DataFrame) -> DataFrame:
    """position of a manual collection's books: pinned first, then by sort_order (nulls first), then id.

    Books of one sort_order, pinned or not, are parted by ranges of ids of STRETCH; a window ranks a part, and parts are counted and summed in order, so a collection of any size makes many tasks. A row that
    comes twice has two places.
    """
    key = ["collection_id", "pinned", "sort_order", "_part"]
    rows = members.withColumn("_part", F.floor(F.col("book_id") / STRETCH))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("collection_id").orderBy(F.desc("pinned"), "sort_order", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("book_id")))
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(starts, same).withColumn("position", (F.col("_before") + F.col("_r")).cast("int")).select(*members.columns, "position")


def rule_collection(matches: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned books first, also those the published gate hides, then the rule's matches without them: book_id, tier (0, 1)."""
    rest = matches.select("book_id").join(pinned, "book_id", "left_anti")
    return pinned.select("book_id", F.lit(0).alias("tier")).unionByName(rest.select("book_id", F.lit(1).alias("tier")))


def catalogue_page(books: DataFrame, sort: str = "newest", page: int = 1, size: int = 12) -> DataFrame:
    """One page of books; unknown sorts mean newest. Ties go to the smaller book_id."""
    keys = {"newest": [F.desc("book_id")], "title_az": [F.asc("title"), F.asc("book_id")], "age_young": [F.asc("age_min"), F.asc("book_id")]}
    return books.orderBy(*keys.get(sort, keys["newest"])).offset((page - 1) * size).limit(size)


#: Volumes of a series that one window takes.
VOLUMES = 1_000


def next_in_series(books: DataFrame, ranks: DataFrame | None = None, volumes: int = VOLUMES) -> DataFrame:
    """book_id, next_id: the first later volume of the series; with ranks (book_id, rank), the earliest later volume whose rank is at most one above, else the first later one.

    A series is cut into stretches of volumes, each a window of its own; beyond a stretch its first books, one a rank, carry the answer, so a series of any length makes many tasks.
    """
    rows = books.where("series IS NOT NULL").select("book_id", "series", F.struct("series_volume", "book_id").alias("_at"), F.floor(F.col("series_volume") / volumes).alias("_part"))
    inside = Window.partitionBy("series", "_part").orderBy("_at")
    parts = rows.groupBy("series", "_part").agg(F.min("_at").alias("_first"))
    beyond = parts.select("series", "_part", F.lead("_first").over(Window.partitionBy("series").orderBy("_part"))["book_id"].alias("_beyond"))
    plain = rows.withColumn("_next", F.lead("book_id").over(inside)).join(beyond, ["series", "_part"]).withColumn("plain", F.coalesce("_next", "_beyond"))
    if ranks is None:
        return plain.select("book_id", F.col("plain").alias("next_id"))
    ranked = plain.join(ranks, "book_id", "left").select("book_id", "series", "_part", "_at", "plain", "rank")
    # for every reading rank, the first later book that has it: inside the stretch, else the first of a later stretch
    levels = ranked.where("rank IS NOT NULL").select(F.col("rank").alias("level")).distinct()
    heads = ranked.where("rank IS NOT NULL").groupBy("series", "_part", F.col("rank").alias("level")).agg(F.min("_at").alias("_head"))
    grid = parts.select("series", "_part").crossJoin(F.broadcast(levels)).join(heads, ["series", "_part", "level"], "left")  # levels: the handful of reading ranks
    later = Window.partitionBy("series", "level").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    outside = grid.select("series", "_part", "level", F.first("_head", ignorenulls=True).over(later).alias("_outside"))
    after = Window.partitionBy("series", "_part", "level").orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    steps = ranked.join(outside, ["series", "_part"])
    found = steps.withColumn("_hit", F.coalesce(F.first(F.when(F.col("rank") == F.col("level"), F.col("_at")), ignorenulls=True).over(after), "_outside"))
    best = found.where("level <= rank + 1").groupBy("book_id").agg(F.min("_hit").alias("_n"))
    return ranked.join(best, "book_id", "left").select("book_id", F.coalesce("_n.book_id", "plain").alias("next_id"))


def in_category(books: DataFrame, links: DataFrame, slug: str) -> DataFrame:
    """Books that a link ties to the category slug. links: book_id, slug."""
    return books.join(links.where(F.col("slug") == slug).select("book_id"), "book_id", "left_semi")


def narrated(books: DataFrame, features: DataFrame, meaning: list[str] | None = None) -> DataFrame:
    """Books with a feature that means a narration. features: book_id, feature."""
    return books.join(features.where(F.col("feature").isin(*(meaning or NARRATED))).select("book_id"), "book_id", "left_semi")


def label_for(labels: Column, language: str, slug: Column, separator: str = "-") -> Column:
    """A label in language, else English, else the slug made readable."""
    return F.coalesce(labels[language], labels["en"], F.initcap(F.replace(slug, F.lit(separator), F.lit(" "))))


def best_description(descriptions: DataFrame, language: str) -> DataFrame:
    """The approved description of each book: in language, else English, else any; the smaller id on ties."""
    rank = F.when(F.col("language_code") == language, 0).when(F.col("language_code") == "en", 1).otherwise(2)
    order = Window.partitionBy("book_id").orderBy(rank, "description_id")
    return descriptions.where("status = 'approved'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def effective_ids(nodes: DataFrame, missing: str = "original", hops: int = 20) -> DataFrame:
    """id, effective_id: where merged_into chains end after at most hops steps; a circle is walked hops steps far.

    nodes: id, merged_into. A target that isn't there: 'original' returns to the starting id, 'last' stays at the last id found. Only merged ids walk: steps of 1, 2, 4 ... are composed and those that make up hops
    are taken in turn, so 20 hops cost six joins. Each step's table has a row for each merged id, so none is broadcast, whatever the size of the files lets Spark expect.
    """
    known = nodes.select(F.col("id").alias("_known"))
    step = nodes.where("merged_into IS NOT NULL").select("id", "merged_into").join(known.hint("merge"), F.col("merged_into") == F.col("_known"), "left")
    # at: the last id found; lost: its target isn't there
    step = step.select(F.col("id").alias("_from"), F.coalesce("_known", "id").alias("_to"), F.col("_known").isNull().alias("_gone"))

    def after(a: DataFrame, b: DataFrame) -> DataFrame:
        """Steps a, then b from where they lead; an id that b doesn't have stays."""
        onward = b.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"), F.col("_gone").alias("_lost"))
        joined = a.join(onward.hint("merge"), (F.col("_to") == F.col("_mid")) & ~F.col("_gone"), "left")
        return joined.select("_from", F.coalesce("_end", "_to").alias("_to"), (F.col("_gone") | F.coalesce("_lost", F.lit(False))).alias("_gone"))

    walk, power, left = None, step, hops
    while left:
        if left & 1:
            walk = power if walk is None else after(walk, power)
        left >>= 1
        if left:
            power = after(power, power)
    if walk is None:
        return nodes.select("id", F.col("id").alias("effective_id"))
    end = F.when(F.col("_gone") & F.lit(missing == "original"), F.col("id")).otherwise(F.coalesce("_to", "id"))
    return nodes.select("id").join(walk.hint("merge"), F.col("id") == F.col("_from"), "left").select("id", end.alias("effective_id"))


def slug(text: Column) -> Column:
    """Lower-cased, other signs than letters, digits, spaces, - and _ dropped, runs of spaces, - and _ one -, none at the ends; @ is at. Letters aren't turned into ASCII."""
    kept = F.regexp_replace(F.replace(F.lower(F.regexp_replace(text, "_+", "-")), F.lit("@"), F.lit("-at-")), r"[^-\p{L}\p{N}\s]+", "")
    return F.btrim(F.regexp_replace(kept, r"[-\s]+", "-"), F.lit("-"))


def resolve_tags(strings: DataFrame, tags: DataFrame, labels: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each book's strings mean, and the tags to be made for those that mean nothing yet.

    strings: book_id, tag; tags: tag_id, slug, canonical_name, status, merged_into; labels, aliases: tag_id, name. A trimmed, lower-cased string that isn't blank is the tag with its slug, else with this canonical name,
    else with such a label, else alias (of several the smallest tag_id), and then where that tag's merge chain ends (a broken one at the last tag found). First result: book_id, tag_id, slug, status, group: a tag once a
    book, matched if active, pending otherwise; a string without a tag has its new slug and no tag_id. Second: slug, canonical_name of the tags to make, one a slug; a slug that is left blank is one too.
    """
    asked = strings.select("book_id", F.lower(F.trim("tag")).alias("norm")).where("norm <> ''").distinct()
    keys = asked.select("norm").distinct().withColumn("slug", slug(F.col("norm")))
    by_slug = tags.groupBy(F.col("slug")).agg(F.min("tag_id").alias("_1"))
    by_name = tags.groupBy(F.lower("canonical_name").alias("norm")).agg(F.min("tag_id").alias("_2"))
    by = lambda d, c: d.groupBy(F.lower("name").alias("norm")).agg(F.min("tag_id").alias(c))
    # strings and tags grow with the shop: neither is broadcast
    left = lambda a, b, c: a.join(b.hint("merge"), c, "left")
    found = left(left(left(left(keys, by_slug, "slug"), by_name, "norm"), by(labels, "_3"), "norm"), by(aliases, "_4"), "norm")
    ends = effective_ids(tags.select(F.col("tag_id").alias("id"), "merged_into"), "last").select(F.col("id").alias("_hit"), F.col("effective_id").alias("tag_id"))
    met = left(found.select("norm", F.col("slug").alias("_slug"), F.coalesce("_1", "_2", "_3", "_4").alias("_hit")), ends, "_hit")
    met = left(met, tags.select("tag_id", F.col("slug").alias("_own"), "status"), "tag_id")
    met = met.select("norm", "tag_id", F.coalesce("_own", "_slug").alias("slug"), F.coalesce("status", F.lit("pending")).alias("status"))
    resolved = asked.join(met.hint("merge"), "norm").select("book_id", "tag_id", "slug", "status", F.when(F.col("status") == "active", "matched").otherwise("pending").alias("group")).distinct()
    # the name of the first of the strings that share a new slug
    made = met.where("tag_id IS NULL").groupBy("slug").agg(F.initcap(F.min("norm")).alias("canonical_name"))
    return resolved, made


def best_suggestion(suggestions: DataFrame, keys: list[str], value: str, confidence: str) -> DataFrame:
    """The value with the highest confidence of each key; the smaller value on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc(confidence), value)
    return suggestions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def category_rollup(categories: DataFrame, links: DataFrame) -> DataFrame:
    """parent_id, category_id, place, books: every parent's children in order of sort_order, then id, with their number of books; a row with category_id null sums a parent's children, one with both null all.

    categories: category_id, parent_id, sort_order (top ones without parent only stand over others); links: book_id, category_id.
    """
    n = links.select("book_id", "category_id").distinct().groupBy("category_id").agg(F.count("*").alias("_n"))
    child = categories.where("parent_id IS NOT NULL").join(n, "category_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    order = Window.partitionBy("parent_id").orderBy("sort_order", "category_id")
    placed = child.withColumn("place", F.row_number().over(order))
    summed = placed.rollup("parent_id", "category_id").agg(F.sum("_n").alias("books"), F.max("place").alias("_p"))
    return summed.select("parent_id", "category_id", F.when(F.col("category_id").isNotNull(), F.col("_p")).alias("place"), "books")


def dashboard_list(books: DataFrame, editions: DataFrame, narrations: DataFrame, term: str = "", only: str | None = None, size: int = 50) -> DataFrame:
    """The latest books by created_at, then book_id, whose title, sku or author holds term (a LIKE pattern, ASCII case folded): all, or those that are ready, processing, translated (an edition) or narrated (a completed narration)."""
    found = search(books, term, ["title", "sku", "author"])
    if only in ("ready", "processing"):
        found = found.where(F.col("status") == only)
    elif only == "translated":
        found = found.join(editions.select("book_id").distinct(), "book_id", "left_semi")
    elif only == "narrated":
        found = found.join(narrations.where("status = 'completed'").select("book_id").distinct(), "book_id", "left_semi")
    return found.orderBy(F.desc("created_at"), F.desc("book_id")).limit(size)


def dashboard_counts(books: DataFrame, editions: DataFrame, narrations: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: total, ready, processing, translated, narrated (completed) books, and active jobs (queued or processing)."""
    status = books.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "processing").alias("processing"))
    known = books.select("book_id")
    translated = editions.join(known, "book_id", "left_semi").agg(F.count_distinct("book_id").alias("translated"))
    narrated = narrations.where("status = 'completed'").join(known, "book_id", "left_semi").agg(F.count_distinct("book_id").alias("narrated"))
    active = jobs.agg(F.count_if(F.col("status").isin("queued", "processing")).alias("active_jobs"))
    # one row each
    return status.crossJoin(F.broadcast(translated)).crossJoin(F.broadcast(narrated)).crossJoin(F.broadcast(active))


def missing_requirements(books: DataFrame, categories: DataFrame, descriptions: DataFrame, editions: DataFrame) -> DataFrame:
    """book_id, missing: what a book lacks before it may be published, in order: primary_category, language (its own or an edition), book_type, age_range (both ends), description (an approved one), publishable_edition
    (one that is visible, where there are editions).

    books: book_id, original_language, book_type, age_min, age_max; categories: book_id, is_primary; descriptions: book_id, status; editions: book_id, store_visible.
    """
    yes = F.lit(True)
    primary = categories.where("is_primary").select("book_id").distinct().withColumn("_primary", yes)
    approved = descriptions.where("status = 'approved'").select("book_id").distinct().withColumn("_approved", yes)
    has = editions.groupBy("book_id").agg(F.coalesce(F.bool_or("store_visible"), F.lit(False)).alias("_visible"))
    both = books.join(primary, "book_id", "left").join(approved, "book_id", "left").join(has, "book_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).isin("", "0")
    rules = [
        ("primary_category", F.col("_primary").isNull()), ("language", empty("original_language") & F.col("_visible").isNull()), ("book_type", empty("book_type")), ("age_range", F.col("age_min").isNull() | F.col("age_max").isNull()),
        ("description", F.col("_approved").isNull()), ("publishable_edition", ~F.coalesce("_visible", yes)),
    ]
    return both.select("book_id", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])).alias("missing"))


def single_primary(links: DataFrame, order: str) -> DataFrame:
    """book_id and its primary category: the one set last."""
    return links.groupBy("book_id").agg(F.max_by("category", order).alias("category"))


def store_badges(books: DataFrame, editions: DataFrame, narrations: DataFrame) -> DataFrame:
    """book_id, audio (a completed narration), languages (editions and the original; null without editions)."""
    n = editions.groupBy("book_id").agg(F.count("*").alias("_n"))
    heard = narrations.where("status = 'completed'").select("book_id").distinct().withColumn("_a", F.lit(True))
    return books.select("book_id").join(n, "book_id", "left").join(heard, "book_id", "left").select("book_id", F.coalesce("_a", F.lit(False)).alias("audio"), (F.col("_n") + 1).alias("languages"))


def serving_narration(narrations: DataFrame, language: str) -> DataFrame:
    """book_id, narration_id: the first completed narration in the language that isn't outdated."""
    return narrations.where((F.col("status") == "completed") & (F.col("language_code") == language) & ~F.col("is_outdated")).groupBy("book_id").agg(F.min("narration_id").alias("narration_id"))


def collection_scope(books: DataFrame, collections: DataFrame, members: DataFrame, slug_: str | None) -> DataFrame:
    """books inside the collection slug_: none where it is empty, all where there is no such collection (or none is asked for). collections: collection_id, slug; members: collection_id, book_id."""
    if not slug_:
        return books
    chosen = collections.where(F.col("slug") == slug_).select("collection_id")
    inside = members.join(chosen, "collection_id", "left_semi").select("book_id").distinct().withColumn("_in", F.lit(True))
    there = chosen.agg((F.count("*") > 0).alias("_there"))  # one row
    return books.join(inside, "book_id", "left").crossJoin(F.broadcast(there)).where(F.col("_in").isNotNull() | ~F.col("_there")).drop("_in", "_there")


# Groups of tags that shoppers may filter by.
FILTER_GROUPS = ["themes_and_values", "topics"]


def filter_options(editions: DataFrame, tags: DataFrame) -> DataFrame:
    """kind, value, label of what a shopper may choose: language (code, name) and education_phase of published editions, active tags (slug, canonical_name) of FILTER_GROUPS, under their group. Of several names of a language the last counts."""
    published = editions.where("publication_status = 'published'")
    none = F.lit(None).cast("string")
    languages = published.groupBy("language_code").agg(F.max("language_name").alias("label")).select(F.lit("language").alias("kind"), F.col("language_code").alias("value"), "label")
    phases = published.where("education_phase IS NOT NULL").select(F.lit("education_phase").alias("kind"), F.col("education_phase").alias("value"), none.alias("label")).distinct()
    active = tags.where((F.col("status") == "active") & F.col("group").isin(*FILTER_GROUPS)).select(F.col("group").alias("kind"), F.col("slug").alias("value"), F.col("canonical_name").alias("label"))
    return languages.where("value IS NOT NULL").unionByName(phases).unionByName(active)


def filter_chips(filters: DataFrame) -> DataFrame:
    """facet, value, chip of every filter that is set. language and series stand as they are, an age is introduced, narrated is a word, a level or price has its first letter raised; of the others the parts between - (category,
    tag) or _ have. filters: facet, value."""
    raised = lambda sep: F.array_join(F.transform(F.split("value", sep), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    facet = F.col("facet")
    first = F.concat(F.upper(F.substring("value", 1, 1)), F.substring("value", 2, 1 << 30))
    chip = F.when(facet.isin("language", "series"), F.col("value")).when(facet == "age", F.concat(F.lit("Age "), "value")).when(facet == "narrated", "Narrated").when(facet.isin("reading_level", "price"), first)
    return filters.where("coalesce(value, '') <> ''").select("facet", "value", chip.when(facet.isin("category", "tag"), raised("[- ]")).otherwise(raised("[_ ]")).alias("chip"))


def preselected_tags(suggested: DataFrame, attached: DataFrame) -> DataFrame:
    """book_id, tags: what a reviewer finds ticked: attached tags by name, then suggested ones that aren't pending or among them, in their order. suggested: book_id, tag, seq, pending; attached: book_id, tag."""
    first = suggested.where("tag IS NOT NULL AND NOT coalesce(pending, false)").groupBy("book_id", "tag").agg(F.min("seq").alias("_s"))
    own = attached.select("book_id", "tag").distinct().withColumn("_a", F.lit(True))
    both = first.join(own, ["book_id", "tag"], "full_outer")
    placed = F.array_sort(F.collect_list(F.struct(F.col("_a").isNull().alias("a"), F.when(F.col("_a").isNull(), F.col("_s")).alias("s"), F.col("tag").alias("t"))))
    return both.groupBy("book_id").agg(F.transform(placed, lambda x: x["t"]).alias("tags"))
