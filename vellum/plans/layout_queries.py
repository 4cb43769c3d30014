"""Queries on forms, page layout, tables and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as au
from ..operators import forms as fm
from ..operators import layout as ly
from ..sources import derived as dv
from .catalog import query, table

FIELDS = """WITH f AS (SELECT l_orderkey AS form, 'Line.' || l_linenumber AS name, l_quantity::DECIMAL(18,2) AS v, l_linenumber FROM lineitem)"""


def fields(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as fields Line.1, Line.2, ...; the third is blank."""
    q = F.concat(F.lit("$"), F.format_number(F.col("l_quantity").cast("decimal(18,2)"), 2))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("form"), F.concat(F.lit("Line."), "l_linenumber").alias("name"), F.when(F.col("l_linenumber") == 3, "").otherwise(q).alias("value"), F.lit("text").alias("kind"), "l_linenumber")


for how, sql in {"SUM": "sum(x)", "AVG": "avg(x)", "MIN": "min(x)", "MAX": "max(x)"}.items():

    @query(f"form_{how.lower()}", FIELDS + f" SELECT form, round({sql}::DOUBLE, 6) AS result FROM (SELECT form, CASE WHEN l_linenumber = 3 THEN 0 ELSE v END AS x FROM f) GROUP BY form")
    def form_calculate(spark: SparkSession, d: str, how: str = how) -> DataFrame:
        return fm.calculate(fields(spark, d), "Line", how).select("form", F.round("result", 6).alias("result"))


@query("form_notation", """SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE (o_totalprice + 2.5) * 2 / (o_orderkey % 10) END - o_totalprice / 4, 4) AS result FROM orders""")
def form_notation(spark: SparkSession, d: str) -> DataFrame:
    c = fm.notation("(total + 2.5) * 2 / rest - total / 4", {"total": F.col("o_totalprice"), "rest": (F.col("o_orderkey") % 10).cast("double")})
    return table(spark, d, "orders").select("o_orderkey", F.round(c, 4).alias("result"))


@query("form_passes", """SELECT o_orderkey AS form, (o_orderkey % 7 + 1.0 + 1.0)::DOUBLE AS a, ((o_orderkey % 7 + 1.0 + 1.0) * 2)::DOUBLE AS b, (o_orderkey % 7 + 1.0)::DOUBLE AS c, 'b,a' AS changed FROM orders""")
def form_passes(spark: SparkSession, d: str) -> DataFrame:
    forms = table(spark, d, "orders").select(F.col("o_orderkey").alias("form"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("c"))
    return fm.two_passes(forms, [("b", "a * 2"), ("a", "c + 1")])


@query("form_inventory", """WITH f AS (SELECT p_partkey AS form, 'Field.' || p_partkey AS name, unnest([0, 1])::INT AS option_no, p_type FROM part)
SELECT form, name, 'choice' AS kind, option_no, CASE option_no WHEN 0 THEN p_type ELSE 'other' END AS label, 'x' || option_no AS export, '' AS value FROM f""")
def form_inventory(spark: SparkSession, d: str) -> DataFrame:
    return fm.inventory(options(spark, d))


def options(spark: SparkSession, d: str) -> DataFrame:
    opts = F.array(F.struct(F.col("p_type").alias("label"), F.lit("x0").alias("export")), F.struct(F.lit("other").alias("label"), F.lit("x1").alias("export")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("form"), F.concat(F.lit("Field."), "p_partkey").alias("name"), F.lit("choice").alias("kind"), opts.alias("options"), F.lit("").alias("value"), F.lit(None).cast("int").alias("max_length"), (F.col("p_partkey") % 5 == 0).alias("read_only"))


@query("form_fill", """SELECT p_partkey AS form, 'Field.' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 2 THEN '' WHEN p_partkey % 3 = 0 THEN 'x1' ELSE 'x0' END AS value,
  CASE WHEN p_partkey % 5 = 0 THEN 'read only' WHEN p_partkey % 3 = 2 THEN 'no such option' END AS error, p_partkey % 5 = 0 OR p_partkey % 3 = 2 AS rejected FROM part""")
def form_fill(spark: SparkSession, d: str) -> DataFrame:
    f = options(spark, d)
    new = f.select("form", "name", F.when(F.col("form") % 3 == 0, "other").when(F.col("form") % 3 == 1, "x0").otherwise("none").alias("new"))
    return fm.fill(f, new)


@query("form_reset", """SELECT l_orderkey AS form, 'Line.' || l_linenumber AS name, CASE WHEN l_linenumber = 1 THEN 'keep' WHEN l_linenumber = 2 THEN '' ELSE 'd' END AS value FROM lineitem""")
def form_reset(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("form"), F.concat(F.lit("Line."), "l_linenumber").alias("name"), F.lit("keep").alias("value"), F.when(F.col("l_linenumber") == 1, "button").otherwise("text").alias("kind"), F.when(F.col("l_linenumber") > 2, "d").alias("default"))
    return fm.reset(f).select("form", "name", "value")


G, B = "WITH " + dv.GLYPHS_SQL, "WITH " + dv.BLOCKS_SQL


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return dv.blocks(table(spark, d, "documents"))


@query("layout_body_size", B + ", s AS (SELECT doc_id, size, count(*) AS n FROM blocks GROUP BY ALL) SELECT doc_id, arg_max(size, n * 1000 - size) AS body FROM s GROUP BY doc_id")
def layout_body_size(spark: SparkSession, d: str) -> DataFrame:
    return ly.body_size(blocks(spark, d))


@query("layout_dominant_size", B + ", s AS (SELECT doc_id, page, size, sum(length(text)) AS n, min(block_no) AS first FROM blocks GROUP BY ALL) SELECT doc_id, page, arg_max(size, n * 100000 - first) AS size FROM s GROUP BY ALL")
def layout_dominant_size(spark: SparkSession, d: str) -> DataFrame:
    return ly.dominant_size(blocks(spark, d))


@query("layout_dominant_font", B + ", f AS (SELECT *, 'Serif' || words % 3 AS font FROM blocks), s AS (SELECT doc_id, page, font, size, sum(length(text)) AS n, min(block_no) AS first FROM f GROUP BY ALL) SELECT doc_id, page, arg_max(font, n * 100000 - first) AS font, arg_max(size, n * 100000 - first) AS size FROM s GROUP BY ALL")
def layout_dominant_font(spark: SparkSession, d: str) -> DataFrame:
    return ly.dominant_font(blocks(spark, d).withColumn("font", F.concat(F.lit("Serif"), F.col("words") % 3)))


@query("layout_upper_median", B + " SELECT doc_id, list_sort(list(words))[count(*) // 2 + 1] AS median_words FROM blocks GROUP BY doc_id")
def layout_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).groupBy("doc_id").agg(ly.upper_median(F.col("words")).alias("median_words"))


@query("layout_words", G + r", t AS (SELECT doc_id, line_no, string_agg(ch, '' ORDER BY glyph_no) AS s FROM glyphs GROUP BY ALL) SELECT doc_id, line_no, trim(regexp_replace(s, ' +', ' ', 'g')) AS words FROM t WHERE trim(s) <> ''")
def layout_words(spark: SparkSession, d: str) -> DataFrame:
    return ly.word_breaks(dv.glyph_lines(table(spark, d, "documents"), ("x0", "x1", "size", "ch")))


CLASS = B + r""", b0 AS (SELECT doc_id, size, sum(length(text)) AS n FROM blocks GROUP BY ALL), b1 AS (SELECT doc_id, arg_max(size, n * 1000 - size) AS body FROM b0 GROUP BY doc_id),
classed AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*([•●◦▪■‣⁃–*-]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s') THEN 'list' WHEN length(text) <= 120 AND regexp_matches(text, '\pL') AND size >= 1.15 * body THEN 'heading' ELSE 'paragraph' END AS kind FROM blocks JOIN b1 USING (doc_id)),
levels AS (SELECT *, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 3)::INT AS level FROM classed WHERE kind = 'heading')"""


@query("layout_kinds", CLASS + " SELECT doc_id, kind, count(*) AS n FROM classed GROUP BY ALL")
def layout_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ly.classify_blocks(blocks(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def headings(spark: SparkSession, d: str) -> DataFrame:
    return ly.heading_levels(ly.classify_blocks(blocks(spark, d)).where("kind = 'heading'"))


@query("layout_heading_tree", CLASS + """ SELECT doc_id, block_no, level, (SELECT max(p.block_no) FROM levels p WHERE p.doc_id = l.doc_id AND p.block_no < l.block_no AND p.level < l.level)::INT AS parent,
  level > lag(level, 1, 0) OVER (PARTITION BY doc_id ORDER BY block_no) + 1 AS skipped FROM levels l""")
def layout_heading_tree(spark: SparkSession, d: str) -> DataFrame:
    return ly.heading_tree(headings(spark, d)).select("doc_id", "block_no", "level", "parent", "skipped")


@query("layout_wrapped_headings", CLASS + """, s AS (SELECT *, CASE WHEN lag(size) OVER w = size AND lag(block_no) OVER w = block_no - 1 THEN 0 ELSE 1 END AS st FROM levels WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_no)),
k AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY block_no) AS k FROM s)
SELECT doc_id, page, min(block_no) AS block_no, any_value(size) AS size, string_agg(text, ' ' ORDER BY block_no) AS text FROM k GROUP BY doc_id, page, k""")
def layout_wrapped_headings(spark: SparkSession, d: str) -> DataFrame:
    return ly.merge_wrapped(headings(spark, d))


@query("layout_columns", G + """, w AS (SELECT doc_id, page, line_no, min(x0) + glyph_no // 40 * 48 AS x0, max(x1) + glyph_no // 40 * 48 AS x1 FROM glyphs GROUP BY doc_id, page, line_no, glyph_no // 40),
m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
c AS (SELECT *, sum(CASE WHEN x0 > reach + 24 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, line_no ROWS UNBOUNDED PRECEDING) AS col FROM m)
SELECT doc_id, page, col::BIGINT AS "column", count(*) AS n FROM c GROUP BY ALL""")
def layout_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of 40 glyphs is a box; a gap of 48 parts it from the one before."""
    g = dv.glyphs(table(spark, d, "documents")).withColumn("seg", F.floor(F.col("glyph_no") / 40))
    g = g.withColumns({x: F.col(x) + F.col("seg") * 48.0 for x in ("x0", "x1")})
    boxes = g.groupBy("doc_id", "page", "line_no", "seg").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return ly.x_clusters(boxes, 24.0).groupBy("doc_id", "page", "column").agg(F.count("*").alias("n"))


@query("layout_redact", G + " SELECT doc_id, count(*) AS n_left FROM glyphs WHERE NOT (line_no % 20 BETWEEN 2 AND 4 AND glyph_no BETWEEN 10 AND 29) GROUP BY doc_id")
def layout_redact(spark: SparkSession, d: str) -> DataFrame:
    areas = dv.doc_pages(table(spark, d, "documents")).select("doc_id", "page", F.lit(60.0).alias("ax0"), F.lit(24.0).alias("ay0"), F.lit(180.0).alias("ax1"), F.lit(58.0).alias("ay1"))
    return ly.redact(dv.line_boxes(table(spark, d, "documents")), areas, dv.unfolded).groupBy("doc_id").agg(F.count("*").alias("n_left"))


@query("layout_linked", G + " SELECT doc_id, CASE WHEN line_no % 20 = 0 AND glyph_no < 5 THEN 'u1' WHEN line_no % 20 = 0 AND glyph_no < 10 THEN 'u2' END AS uri, count(*) AS n FROM glyphs GROUP BY ALL")
def layout_linked(spark: SparkSession, d: str) -> DataFrame:
    box = lambda n, x1, uri: F.struct(F.lit(n).alias("link_no"), F.lit(0.0).alias("bx0"), F.lit(0.0).alias("by0"), F.lit(x1).alias("bx1"), F.lit(10.0).alias("by1"), F.lit(uri).alias("uri"))
    boxes = dv.doc_pages(table(spark, d, "documents")).select("doc_id", "page", F.explode(F.array(box(1, 30.0, "u1"), box(2, 60.0, "u2"))).alias("b")).select("doc_id", "page", "b.*")
    return ly.attach_links(dv.line_boxes(table(spark, d, "documents")), boxes, dv.unfolded).groupBy("doc_id", "uri").agg(F.count("*").alias("n"))


@query("layout_dehyphenate", "WITH " + dv.TOKENS_SQL + """, b AS (SELECT doc_id, key AS a, lead(key) OVER (PARTITION BY doc_id, page ORDER BY pos) AS c, pos FROM tokens), v AS (SELECT key AS word FROM tokens UNION SELECT a || '-' || c FROM b WHERE pos % 10 = 0 AND c IS NOT NULL)
SELECT doc_id, a AS first, c AS second, CASE WHEN a || c NOT IN (FROM v) AND a || '-' || c IN (FROM v) THEN a || '-' || c ELSE a || c END AS joined FROM b WHERE c IS NOT NULL""")
def layout_dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    keys = dv.token_keys(F.col("text"))
    pages = dv.doc_pages(table(spark, d, "documents")).select("doc_id", keys.alias("keys"))
    pair = F.transform(F.slice("keys", 1, F.greatest(F.size("keys") - 1, F.lit(0))), lambda k, i: F.struct(k.alias("first"), F.get("keys", i + 1).alias("second")))
    b = pages.select("doc_id", F.posexplode(pair).alias("pos", "b")).select("doc_id", "b.*", "pos")
    vocabulary = pages.select(F.explode("keys").alias("word")).unionByName(b.where("pos % 10 = 0").select(F.concat_ws("-", "first", "second").alias("word")))
    return ly.dehyphenate(b.select("doc_id", "first", "second"), vocabulary)


@query("layout_reading_order")
def layout_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Recursive per page; tests hold it on a two-column page."""
    b = blocks(spark, d).where("words > 0")
    x0 = F.when(F.col("block_no") % 2 == 0, 0.0).otherwise(300.0)
    y0 = F.floor((F.col("block_no") % dv.LINES_A_PAGE) / 2) * 12.0
    return ly.reading_order(b.select("doc_id", "page", F.col("block_no").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + 250).alias("x1"), (y0 + 10).alias("y1")))


CELLS = "WITH " + dv.LINES_SQL + r""", r0 AS (SELECT doc_id, line_no AS "row", string_split(text, ' | ') AS cs FROM doc_lines WHERE contains(text, ' | ')),
cells AS (SELECT doc_id AS "table", "row", unnest(range(0, len(cs)))::INT AS col, unnest(cs) AS text FROM r0)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Lines with bars as table rows."""
    rows = dv.doc_lines(table(spark, d, "documents")).where(F.col("text").contains(" | "))
    return rows.select(F.col("doc_id").alias("table"), F.col("line_no").alias("row"), F.posexplode(F.split("text", r" \| ", -1)).alias("col", "text"))


@query("table_headers", CELLS + """, r AS (SELECT "table", "row", bool_and(length(text) < 8) AS bold FROM cells GROUP BY ALL) SELECT "table", coalesce(min("row") FILTER (NOT bold), 0)::INT AS header_rows FROM r GROUP BY "table" """)
def table_headers(spark: SparkSession, d: str) -> DataFrame:
    return ly.header_rows(cells(spark, d).withColumn("bold", F.length("text") < 8))


@query("table_names", CELLS + """, s AS (SELECT *, lag(text) OVER (PARTITION BY "table", col ORDER BY "row") AS before FROM cells)
SELECT "table", col, coalesce(string_agg(text, ' / ' ORDER BY "row") FILTER (text <> '' AND text IS DISTINCT FROM before), '') AS name FROM s GROUP BY ALL""")
def table_names(spark: SparkSession, d: str) -> DataFrame:
    return ly.flatten_header(cells(spark, d))


@query("table_widths", CELLS + r""" SELECT "table", col, greatest(4, least(60, max(CASE WHEN regexp_matches(text, '^[-+]?[\d.,]+%?$') THEN length(text) ELSE least(list_max(list_transform(string_split(text, ' '), lambda w: length(w))), 40) END)))::INT AS width FROM cells GROUP BY ALL""")
def table_widths(spark: SparkSession, d: str) -> DataFrame:
    return ly.column_profile(cells(spark, d))


@query("table_spans", CELLS + """ SELECT "table", "row" AS owner_row, (col - col % 2)::INT AS owner_col, string_agg(text, ' ' ORDER BY col) AS text FROM cells GROUP BY ALL""")
def table_spans(spark: SparkSession, d: str) -> DataFrame:
    return ly.span_owners(cells(spark, d).withColumns({"rowspan": F.lit(1), "colspan": F.when(F.col("col") % 2 == 0, 2).otherwise(1)}))


@query("table_continued", """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS table_no, (o_orderkey % 2)::INT AS cols, 'Head ' || o_orderkey % 2 AS header FROM orders),
s AS (SELECT *, CASE WHEN lag(cols) OVER w = cols AND lag(header) OVER w = header THEN 0 ELSE 1 END AS st FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY table_no))
SELECT doc_id, table_no, (sum(st) OVER (PARTITION BY doc_id ORDER BY table_no) - 1)::BIGINT AS logical_no FROM s""")
def table_continued(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_no"), (F.col("o_orderkey") % 2).cast("int").alias("cols"), F.concat(F.lit("Head "), F.col("o_orderkey") % 2).alias("header"))
    return ly.join_continued(t).select("doc_id", "table_no", "logical_no")


AUDIT = B + """, v AS (SELECT doc_id, count(*) FILTER (words = 0) AS blank_lines, count(*) FILTER (length(text) > 400) AS long_lines, count(*) FILTER (contains(text, '###')) AS bare_marks FROM blocks GROUP BY doc_id),
r AS (SELECT doc_id, 'blank_lines' AS rule, 'info' AS severity, blank_lines AS n_violations FROM v UNION ALL SELECT doc_id, 'long_lines', 'warning', long_lines FROM v UNION ALL SELECT doc_id, 'bare_marks', 'error', bare_marks FROM v)"""


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    return au.report(blocks(spark, d), {"blank_lines": ("info", F.col("words") == 0), "long_lines": ("warning", F.length("text") > 400), "bare_marks": ("error", F.col("text").contains("###"))})


@query("audit_report", AUDIT + " SELECT *, CASE WHEN n_violations > 0 THEN severity ELSE 'pass' END AS status FROM r")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return audit_rows(spark, d)


@query("audit_compliant", AUDIT + " SELECT doc_id, bool_and(NOT (severity = 'error' AND n_violations > 0)) AS compliant FROM r GROUP BY doc_id")
def audit_compliant(spark: SparkSession, d: str) -> DataFrame:
    return au.compliant(audit_rows(spark, d))


@query("audit_worst", AUDIT + " SELECT doc_id, rule FROM r WHERE n_violations > 0 ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, doc_id, rule LIMIT 100")
def audit_worst(spark: SparkSession, d: str) -> DataFrame:
    return audit_rows(spark, d).where("n_violations > 0").orderBy(au.severity_rank(F.col("severity")), "doc_id", "rule").limit(100).select("doc_id", "rule")
