"""Catalogue views over the driver tables: the DataFrame form, and the same views as SQL common table expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The view texts run unchanged in Spark and in the SQL that results are checked with.
VIEWS = {
    "books": """SELECT p_partkey AS book_id, p_name AS title, p_brand AS series,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS series_volume,
  lower(p_type) AS book_type, p_size % 12 AS age_min, p_size % 12 + 3 AS age_max,
  CASE WHEN p_partkey % 10 = 0 THEN 'draft' ELSE 'published' END AS status FROM part""",
    "editions": """SELECT l_partkey * 10000 + l_suppkey AS edition_id, l_partkey AS book_id,
  concat('l', CAST(min(s_nationkey) AS STRING)) AS language_code,
  CASE WHEN min(l_linenumber) = 1 THEN 0.0 ELSE min(l_extendedprice) END AS price,
  CASE WHEN max(l_returnflag) = 'R' THEN 'published' ELSE 'draft' END AS publication_status,
  l_partkey % 5 + 1 AS reading_rank
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, l_suppkey""",
    "edition_rights": """SELECT l_partkey * 10000 + l_suppkey AS edition_id,
  (l_partkey + l_suppkey) % 7 <> 0 AS digital_rights,
  CAST(min(l_shipdate) AS DATE) AS licence_start,
  CAST(max(l_shipdate) + INTERVAL 1000 DAY AS DATE) AS licence_end,
  CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN '*' ELSE min(r_name) END AS territory
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WHERE (l_partkey + l_suppkey) % 3 <> 0 GROUP BY l_partkey, l_suppkey""",
    "translation_pairs": """SELECT a.conv_id AS book_id, a.turn + 1 AS page_number,
  a.text AS source_text, b.text AS translated_text
  FROM conversations a LEFT JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
  WHERE a.role = 'user'""",
    "spans": """SELECT l_orderkey AS page_id, l_linenumber AS span_no,
  l_quantity * 10 AS x0, round(l_extendedprice / 150, 1) AS y0,
  l_quantity * 10 + 30 + l_discount * 400 AS x1, round(l_extendedprice / 150, 1) + 10 + l_tax * 200 AS y1,
  8 + l_partkey % 30 AS font_size, concat('F', CAST(l_suppkey % 6 AS STRING)) AS font_name,
  l_returnflag AS role FROM lineitem""",
    "checks": """SELECT user_id AS candidate_id, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'structure' WHEN 'click' THEN 'fit' WHEN 'purchase' THEN 'target_mapping'
    WHEN 'signup' THEN 'visual' ELSE 'educational' END AS check_name,
  CASE WHEN value < 0.2 THEN 'failed' WHEN value < 1 THEN 'not_run' ELSE 'passed' END AS status FROM events""",
    "runs": """SELECT o_custkey AS book_id, o_orderkey AS run_id, o_orderdate AS ts, o_totalprice AS render_time_sec,
  o_totalprice % 100 AS coverage_pct, o_totalprice / 10 AS file_size_kb FROM orders""",
}
# One page a line of a document; the two engines split differently.
PAGES_SPARK = "SELECT doc_id AS book_id, pos + 1 AS page_number, page AS extracted_text FROM documents LATERAL VIEW posexplode(split(text, '\n')) p AS pos, page"
PAGES_SQL = """SELECT doc_id AS book_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS page_number,
  unnest(string_split(text, chr(10))) AS extracted_text FROM documents"""

SOURCES = {
    "books": ["part"], "editions": ["lineitem", "supplier"], "edition_rights": ["lineitem", "supplier", "nation", "region"], "translation_pairs": ["conversations"],
    "spans": ["lineitem"], "checks": ["events"], "runs": ["orders"], "book_pages": ["documents"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue view."""
    text = PAGES_SPARK if name == "book_pages" else VIEWS[name]
    frames = {t: table(spark, sf_dir, t) for t in SOURCES[name]}
    marked = text
    for t in frames:
        for before in ("FROM ", "JOIN "):
            marked = marked.replace(f"{before}{t}", f"{before}{{{t}}}")
    return spark.sql(marked.replace("\n", " ") if name != "book_pages" else marked.replace("\n", "\\n"), **frames)


def with_views(*names: str, query: str) -> str:
    """query after the named views as common table expressions."""
    parts = [f"{n} AS ({PAGES_SQL if n == 'book_pages' else VIEWS[n]})" for n in names]
    return f"WITH {', '.join(parts)} {query}"


def load_catalog(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a folder with declared types: the columns named by each table's schema (DDL), cast where the files store another type; a value that doesn't fit is an error, a missing column null."""
    out = {}
    for name, ddl in schemas.items():
        rows, wanted = table(spark, folder, name), StructType.fromDDL(ddl)
        have = set(rows.columns)
        out[name] = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out


@dataclass(frozen=True)
class JdbcTable:
    """A table of a database: its columns with their types (DDL), and the whole-numbered column by which it is read in parts."""

    name: str
    schema: str
    part_by: str
    parts: int = 8


def load_jdbc(spark: SparkSession, tables: list[JdbcTable], options: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a database with declared types, each read in parts over the range of its column, by as many tasks; options as Spark's JDBC source takes them (url, driver, user ...).

    Filters and columns that a query doesn't need are left to the database. The range is asked for once (a row); rows outside it or with a null there, should some come in between, fall to the first and last part.
    """
    source = lambda table_: spark.read.format("jdbc").options(**options).option("dbtable", table_)
    out = {}
    for t in tables:
        wanted = StructType.fromDDL(t.schema)
        low, high = source(f"(SELECT min({t.part_by}) AS low, max({t.part_by}) AS high FROM {t.name}) bounds").load().first()
        rows = source(t.name)
        if low is not None and low < high:
            rows = rows.options(partitionColumn=t.part_by, lowerBound=str(low), upperBound=str(high), numPartitions=str(t.parts))
        rows = rows.load()
        have = {c.lower(): c for c in rows.columns}
        out[t.name] = rows.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out
