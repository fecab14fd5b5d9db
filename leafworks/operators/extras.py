"""Manifests, rules, labels, word lists, contracts and fonts: operators that don't fit the other modules' size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import ASKS_NARRATED, edition_matches

#: The manifest's shape: pages hold regions, regions hold items.
MANIFEST = "pages array<struct<page_number: int, page_type: string, regions: array<struct<id: string, policy: string, items: array<struct<id: string, text: string, role: string>>>>>>"


def manifest_units(manifests: DataFrame) -> DataFrame:
    """doc_id, page_number, page_type, region_id, policy, unit_id, text, role of every item of every manifest; regions without items give none."""
    pages = manifests.select("doc_id", F.explode(F.from_json("manifest", MANIFEST)["pages"]).alias("p"))
    regions = pages.select("doc_id", "p.page_number", "p.page_type", F.explode("p.regions").alias("r"))
    return regions.select("doc_id", "page_number", "page_type", F.col("r.id").alias("region_id"), "r.policy", F.explode("r.items").alias("i")).select("doc_id", "page_number", "page_type", "region_id", "policy", F.col("i.id").alias("unit_id"), "i.text", "i.role")


def expected_strings(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key, text, first: the first of columns that isn't blank, trimmed; of equal texts of a key the first stays."""
    text = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])
    return rows.select(key, text.alias("text"), F.col(order).alias("_o")).where("text IS NOT NULL").groupBy(key, "text").agg(F.min("_o").alias("first"))


def filtered_by_slug(books: DataFrame, links: DataFrame, known: DataFrame, slug: str) -> DataFrame:
    """Books linked with slug; all of them where no known slug has this name. The question is answered inside the plan."""
    unknown = known.where(F.col("slug") == slug).agg((F.count("*") == 0).alias("_all"))  # one row
    hit = links.where(F.col("slug") == slug).select("book_id").distinct().withColumn("_hit", F.lit(True))
    return books.join(hit, "book_id", "left").crossJoin(F.broadcast(unknown)).where("_all OR _hit").drop("_all", "_hit")


RULES = "language string, reading_level string, book_type string, category string, features array<string>"


def rule_matches(rules: DataFrame, books: DataFrame, editions: DataFrame, features: DataFrame, links: DataFrame) -> DataFrame:
    """collection_id, book_id of rule collections among books (the visible ones: book_id, book_type). rules: collection_id, rules (JSON).

    language (a text, or the first of a list), reading_level and, for the features narrated and word_highlighting, a narrated edition must hold on one published edition; book_type on the book; category by links (book_id, slug).
    Keys that are missing or empty, and other keys, don't filter. Rules meet books by equal keys; only a rule without any filter takes all.
    """
    first = F.when(F.col("r.language").startswith("["), F.get(F.from_json("r.language", "array<string>"), F.lit(0))).otherwise(F.col("r.language"))
    given = lambda c: F.nullif(c, F.lit(""))
    asks = F.coalesce(F.arrays_overlap("r.features", F.array(*[F.lit(x) for x in ASKS_NARRATED])), F.lit(False))
    none = F.lit(None).cast("string")
    facets = F.struct(given(first).alias("language"), given(F.col("r.reading_level")).alias("reading_level"), none.alias("education_phase"), none.alias("feature"), none.alias("price"), asks.alias("narrated"))
    r = rules.select("collection_id", F.from_json("rules", RULES).alias("r")).select(F.col("collection_id").alias("ask_id"), facets.alias("facets"), given(F.col("r.book_type")).alias("_type"), given(F.col("r.category")).alias("_category"))
    on_edition = F.col("facets.language").isNotNull() | F.col("facets.reading_level").isNotNull() | F.col("facets.narrated")
    # what takes much to find, the visible books and the links, stands in the plan once: both uses of books ask for the same rows and columns in the same places
    books = books.select("book_id", "book_type").repartition("book_id")
    linked = links.select("book_id", F.col("slug").alias("_category")).distinct()
    by_edition = edition_matches(r.where(on_edition).select("ask_id", "facets"), editions, features).join(r.select("ask_id", "_type", "_category"), "ask_id")
    plain = r.where(~on_edition).select("ask_id", "_type", "_category")
    tied = plain.where("_type IS NULL AND _category IS NOT NULL").join(linked, "_category").select("ask_id", "book_id", "_type", none.alias("_category"))
    asked = by_edition.unionByName(tied).join(books, "book_id").where(F.col("_type").isNull() | F.coalesce(F.col("_type") == F.col("book_type"), F.lit(False)))
    # a book's type, and null for rules without any filter
    keyed = books.select("book_id", F.explode(F.array("book_type", none)).alias("_key"))
    taken = plain.where("_type IS NOT NULL OR _category IS NULL").join(keyed, F.col("_type").eqNullSafe(F.col("_key")))
    found = asked.select("ask_id", "book_id", "_category").unionByName(taken.select("ask_id", "book_id", "_category"))
    fit = found.join(linked.withColumn("_tied", F.lit(True)), ["book_id", "_category"], "left").where("_category IS NULL OR _tied")
    return fit.select(F.col("ask_id").alias("collection_id"), "book_id").distinct()


def locked_terms(terms: DataFrame, given: Column) -> DataFrame:
    """book_id, term, translation, confidence, locked: given terms stand for themselves, locked, with confidence 10."""
    return terms.select("book_id", F.explode(given).alias("term")).where(F.trim("term") != "").select("book_id", "term", F.col("term").alias("translation"), F.lit(10.0).alias("confidence"), F.lit(True).alias("locked")).distinct()


def component_ids(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """key, source_id, problem: unknown, duplicate or missing component ids."""
    n = got.groupBy(key, "source_id").agg(F.count("*").alias("_n"))
    both = expected.select(key, "source_id").distinct().withColumn("_e", F.lit(True)).join(n, [key, "source_id"], "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("_n") > 1, "duplicate")
    return both.select(key, "source_id", problem.alias("problem")).where("problem IS NOT NULL")


def role_policy(units: DataFrame, defaults: dict[str, str], overrides: DataFrame) -> DataFrame:
    """unit_id, policy: an override, else the role's default, else translate."""
    o = overrides.select("unit_id", F.col("policy").alias("_o"))
    known = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return units.join(o, "unit_id", "left").select("unit_id", F.coalesce("_o", known[F.col("role")], F.lit("translate")).alias("policy"))


def integrity_verdict(required: DataFrame, faults: DataFrame) -> DataFrame:
    """edition_id, failed, families: an edition fails with a required family that is at fault; the families, sorted and comma-joined."""
    hit = required.join(faults.select("family").distinct().withColumn("_f", F.lit(True)), "family", "left")
    return hit.groupBy("edition_id").agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("failed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_f"), F.col("family")))), ",").alias("families"))


def font_match(requested: DataFrame, fonts: DataFrame, aliases: dict[str, str], hints: dict[str, list[str]], preferred: dict[str, list[str]], default: str = "handwriting") -> DataFrame:
    """family, font: an alias whose key is in the name or has it (the first listed), else the font of the same name without spaces, else the first with the largest summed length of the name's words that it holds. Under 3, the font comes from the
    category that a hint in the name tells (else the default): the first preferred one there is, or the category's first; if there is none, the best by words stays, which may be null.

    requested: family; fonts: font, category, place (their order). A subset prefix of six letters goes. Words meet fonts by an equi join with the fonts' substrings.
    """
    low = F.lower("family")
    clean = F.trim(F.replace(F.regexp_replace(low, r"^[a-z]{6}\+", ""), F.lit("-"), F.lit(" ")))
    r = requested.select("family").distinct().withColumn("clean", clean).withColumn("bare", F.replace(F.replace(low, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")))
    alias = F.lit(None).cast("string")
    for key, family in reversed(aliases.items()):
        alias = F.when(F.col("clean").contains(key) | F.lit(key).contains(F.col("clean")), family).otherwise(alias)
    kind = F.lit(default)
    for name, words_ in reversed(hints.items()):
        hit = F.lit(False)
        for w in words_:
            hit = hit | F.col("bare").contains(w)
        kind = F.when(hit, name).otherwise(kind)
    r = r.withColumn("alias", alias).withColumn("category", kind)
    f = fonts.select("font", "category", "place", F.replace(F.lower("font"), F.lit(" "), F.lit("")).alias("name"))
    exact = r.select("family", F.replace("clean", F.lit(" "), F.lit("")).alias("name")).join(f, "name").groupBy("family").agg(F.min_by("font", "place").alias("exact"))
    parts = f.select("font", "place", F.explode(F.expr("array_distinct(flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, length(name) - i + 1), n -> substring(name, i, n)))))")).alias("word"))
    asked = r.select("family", F.explode(F.filter(F.split("clean", r"\s+"), lambda w: w != "")).alias("word"))
    score = asked.join(parts, "word").groupBy("family", "font", "place").agg(F.sum(F.length("word")).alias("score"))
    near = score.groupBy("family").agg(F.min_by(F.struct("font", "score"), F.struct(-F.col("score"), F.col("place"))).alias("near"))
    liked = [(c, n, i) for c, names in preferred.items() for i, n in enumerate(names)]
    rank = F.lit(1_000_000)
    for c, n, i in reversed(liked):
        rank = F.when((F.col("category") == c) & (F.col("font") == n), i).otherwise(rank)
    by_kind = f.withColumn("_rank", rank).groupBy("category").agg(F.min_by("font", F.struct("_rank", "place")).alias("of_kind"))
    both = r.join(exact, "family", "left").join(near, "family", "left").join(by_kind, "category", "left")
    weak = F.coalesce(F.col("near.score"), F.lit(0)) < 3
    return both.select("family", F.coalesce("alias", "exact", F.when(weak, F.col("of_kind")), F.col("near.font")).alias("font"))


def page_fonts(spans: DataFrame) -> DataFrame:
    """page_id, families: the page's font names in the order of their first box (then by name), comma-joined."""
    first = spans.groupBy("page_id", "font_name").agg(F.min("span_no").alias("f"))
    return first.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "font_name"))), lambda x: x["font_name"]), ",").alias("families"))


# What makes a line carry on another one, as patterns of a trimmed line.
SOUND_BULLET, SOUND = r"^[-–—]\s*\p{L}{1,4}$", r"^\p{L}{1,3}$"
ENTRY_DASH, CLOSING = r"\s[-–—]\s", r"[.!?,:;\-–—]$"
#: Shares of a line's height (and points at least) by which boxes of one column, and lines of one unit, may be apart.
COLUMN_SHARE, COLUMN_POINTS, OVERLAP_SHARE, GAP_SHARE = 0.9, 6.0, 0.3, 0.9


def _line_traits(rows: DataFrame) -> DataFrame:
    """Adds to lines what the fold asks of them, so that no text is parsed inside it: what they can begin (sound) and be (examples), and whether they are open at the end, of several words, an entry with a dash, and in lower case."""
    t = F.trim(F.coalesce("text", F.lit("")))
    words_ = F.filter(F.split(t, r"[,\s]+"), lambda w: w != "")
    examples = F.size(words_).between(1, 3) & F.forall(words_, lambda w: w.rlike(r"^\p{L}+$"))
    several = t.rlike(r"\S\s+\S")
    return rows.withColumns({
        "t": t, "sound": F.when(t.rlike(SOUND_BULLET), 2).when(t.rlike(SOUND), 1).otherwise(0), "example": F.when(examples, F.when(t.contains(","), 2).otherwise(1)).otherwise(0),
        "open": several & ~t.rlike(CLOSING), "entry": t.rlike(ENTRY_DASH), "running": several & t.rlike(r"^\p{Ll}"),
    })


def continuation_lines(spans: DataFrame) -> DataFrame:
    """page_id, place (from 1, by steps of 2 points down the page, then from the left), text, x0, y0, x1, y1, lines: the units of a page's lines; a line that carries on the unit above it in its column is joined to it.

    spans: page_id, span_no, text, is_page_number, x0, y0, x1, y1. Page numbers, blank lines and short lines in capitals stay alone. A column is a run of body lines by their left ends without a step of over 6 points or 0.9 of
    the line's height. Down a column a line is joined where it lies between 0.3 of a line above the unit's bottom and 0.9 below, and either it runs on in lower case after several words that are open (neither of them an entry
    with a dash), or its one to three words are the examples of a lone sound above: a bulleted one, or, with a comma, any of three letters. The fold goes over a column's lines, an array of a page's size at most.
    """
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{L}", "")
    capitals = (letters != "") & (F.upper(letters) == letters) & ~letters.rlike(r"\p{Ll}") & (F.length("text") < 30)
    rows = _line_traits(spans.withColumn("body", (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.coalesce("is_page_number", F.lit(False)) & ~capitals))
    alone = rows.where("NOT body").select("page_id", "span_no", F.coalesce("text", F.lit("")).alias("text"), "x0", "y0", "x1", "y1", F.lit(1).alias("lines"))
    across = Window.partitionBy("page_id").orderBy("x0", "span_no")
    step = F.col("x0") - F.lag("x0").over(across) > F.greatest(F.lit(COLUMN_POINTS), COLUMN_SHARE * (F.col("y1") - F.col("y0")))
    columns = rows.where("body").withColumn("_new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("_column", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    fields = ["y0", "x0", "span_no", "t", "x1", "y1", "sound", "example", "open", "entry", "running"]
    lines = columns.groupBy("page_id", "_column").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_lines"))
    first = F.get("_lines", F.lit(0))
    unit = lambda x: F.struct(*[x[f].alias(f) for f in fields], F.lit(1).alias("lines"))

    def joined(u: Column, x: Column) -> Column:
        told = {"y0": F.least(u["y0"], x["y0"]), "x0": F.least(u["x0"], x["x0"]), "t": F.concat(u["t"], F.lit(" "), x["t"]), "x1": F.greatest(u["x1"], x["x1"]), "y1": F.greatest(u["y1"], x["y1"]),
                "sound": F.lit(0), "open": ~x["t"].rlike(CLOSING), "entry": u["entry"] | x["entry"]}
        return F.struct(*[told.get(f, u[f]).alias(f) for f in fields], (u["lines"] + 1).alias("lines"))

    def fold(acc: Column, x: Column) -> Column:
        u = acc["last"]
        height = F.greatest(F.lit(1.0), u["y1"] - u["y0"], x["y1"] - x["y0"])
        close = (x["y0"] - u["y1"]).between(-OVERLAP_SHARE * height, GAP_SHARE * height)
        sounds = ((u["sound"] == 2) & (x["example"] > 0)) | ((u["sound"] == 1) & (x["example"] == 2))
        goes_on = close & (sounds | (u["open"] & x["running"] & ~u["entry"] & ~x["entry"]))
        return F.struct(F.when(goes_on, acc["done"]).otherwise(F.concat(acc["done"], F.array(u))).alias("done"), F.when(goes_on, joined(u, x)).otherwise(unit(x)).alias("last"))

    rest = F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))
    none = F.filter(F.array(unit(first)), lambda _: F.lit(False))
    folded = F.aggregate(rest, F.struct(none.alias("done"), unit(first).alias("last")), fold, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    units = lines.select("page_id", F.explode(folded).alias("u")).select("page_id", "u.span_no", F.col("u.t").alias("text"), *[f"u.{c}" for c in ("x0", "y0", "x1", "y1", "lines")])
    order = Window.partitionBy("page_id").orderBy(F.bround(F.col("y0") / 2), "x0", "span_no")
    return alone.unionByName(units).withColumn("place", F.row_number().over(order)).select("page_id", "place", "text", "x0", "y0", "x1", "y1", "lines")
