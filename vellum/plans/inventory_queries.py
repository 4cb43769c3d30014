"""Queries on inventories, boxes, trees and page structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as ge
from ..functions import text as fn
from ..operators import inventory as iv
from ..operators import navigation as nv
from ..sources import derived as dv
from .catalog import query, table

B, G = "WITH RECURSIVE " + dv.BLOCKS_SQL, "WITH " + dv.GLYPHS_SQL


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return dv.blocks(table(spark, d, "documents"))


OBJ = """WITH o AS (SELECT event_id AS obj, user_id AS doc_id, CASE event_id % 4 WHEN 0 THEN 'metadata' WHEN 1 THEN 'scripts' WHEN 2 THEN 'links' ELSE 'bookmarks' END AS category FROM events)"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    k = F.element_at(F.array(*map(F.lit, ("metadata", "scripts", "links", "bookmarks"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("obj"), F.col("user_id").alias("doc_id"), k.alias("category"))


@query("inventory_hidden", OBJ + " SELECT doc_id, count(*) FILTER (category = 'metadata') AS metadata, count(*) FILTER (category = 'scripts') AS scripts FROM o GROUP BY doc_id")
def inventory_hidden(spark: SparkSession, d: str) -> DataFrame:
    return iv.hidden_counts(objects(spark, d), ("metadata", "scripts"))


@query("inventory_sanitized", OBJ + " SELECT obj, category FROM o WHERE category IN ('links', 'bookmarks')")
def inventory_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return iv.sanitize(objects(spark, d)).select("obj", "category")


@query("inventory_outside", G + " SELECT doc_id, page, count(*) AS n_outside FROM glyphs WHERE (x0 + x1) / 2 > 612.5 OR (y0 + y1) / 2 > 200.5 GROUP BY ALL")
def inventory_outside(spark: SparkSession, d: str) -> DataFrame:
    return iv.outside_page(dv.glyphs(table(spark, d, "documents")), 612, 200)


@query("inventory_images", """WITH p AS (SELECT l_partkey AS image, l_linenumber AS page, l_orderkey % 1000 + 100 AS px_w, l_orderkey % 700 + 100 AS px_h, l_quantity * 10 AS w, l_quantity * 5 + l_orderkey % 3 AS h FROM lineitem),
b AS (SELECT image, min(page) AS page, arg_max((px_w, px_h, w, h), (w * h, -page, px_w, px_h)) AS b FROM p GROUP BY image) SELECT image, page, round(least(b[1] / (b[3] / 72), b[2] / (b[4] / 72)), 6) AS dpi FROM b""")
def inventory_images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    p = table(spark, d, "lineitem").select(F.col("l_partkey").alias("image"), F.col("l_linenumber").alias("page"), (k % 1000 + 100).alias("px_w"), (k % 700 + 100).alias("px_h"), (F.col("l_quantity") * 10).alias("w"), (F.col("l_quantity") * 5 + k % 3).alias("h"))
    one = p.groupBy("image", "page", "w", "h").agg(F.max(F.struct("px_w", "px_h")).alias("p")).select("image", "page", "p.px_w", "p.px_h", "w", "h")
    return iv.image_inventory(one).select("image", "page", F.round("dpi", 6).alias("dpi"))


@query("inventory_text_status", B + " SELECT doc_id, count(*) AS pages, count(*) FILTER (words = 0) AS image_only, bool_and(words = 0) AS needs_text FROM blocks GROUP BY doc_id")
def inventory_text_status(spark: SparkSession, d: str) -> DataFrame:
    return iv.text_status(blocks(spark, d).select("doc_id", F.col("words").alias("chars"), F.lit(1).alias("images")))


@query("inventory_sizes", B + ", s AS (SELECT DISTINCT doc_id, (612 + words % 3) || 'x792' AS s FROM blocks) SELECT doc_id, string_agg(s, ' ' ORDER BY s) AS sizes FROM s GROUP BY doc_id")
def inventory_sizes(spark: SparkSession, d: str) -> DataFrame:
    return iv.size_mix(blocks(spark, d).select("doc_id", (F.col("words") % 3 + 612.2).alias("w"), F.lit(791.8).alias("h")))


@query("inventory_inks", B + """, i AS (SELECT DISTINCT doc_id, CASE words % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'K' ELSE 'Spot' || words % 5 END AS ink FROM blocks)
SELECT doc_id, coalesce(string_agg(ink, ',' ORDER BY ink) FILTER (ink NOT IN ('C', 'K')), '') AS spots, bool_or(ink IN ('C', 'K')) AS process FROM i GROUP BY doc_id""")
def inventory_inks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("words") % 5
    return iv.inks(blocks(spark, d).select("doc_id", F.when(k == 0, "C").when(k == 1, "K").otherwise(F.concat(F.lit("Spot"), k)).alias("ink")))


@query("inventory_skew", B + """, a AS (SELECT doc_id, (block_no % 40 - 20)::DOUBLE AS angle FROM blocks WHERE words >= 2 AND abs(block_no % 40 - 20) < 15)
SELECT doc_id, CASE WHEN count(*) >= 3 THEN list_sort(list(angle))[count(*) // 2 + 1] END AS angle FROM a GROUP BY doc_id""")
def inventory_skew(spark: SparkSession, d: str) -> DataFrame:
    return iv.skew(blocks(spark, d).select("doc_id", "words", (F.col("block_no") % 40 - 20).cast("double").alias("angle")))


@query("names_merged", """WITH f AS (SELECT c_custkey AS doc_id, 'f' || c_custkey % 20 AS name FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 + CASE WHEN name IN ('f1', 'f2') THEN 1 ELSE 0 END AS n FROM f)
SELECT doc_id, name, CASE WHEN n = 0 THEN name ELSE 'p' || n || '_' || name END AS merged_name FROM k""")
def names_merged(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("f"), F.col("c_custkey") % 20).alias("name"))
    return iv.namespaced(f, f.where("name in ('f1', 'f2')").select("name")).select("doc_id", "name", "merged_name")


@query("marks_overlay", """SELECT event_id AS mark, CASE WHEN event_id % 3 = 0 THEN 'b' || event_id % 9 ELSE '(b' || event_id % 9 || ') ' || event_type END AS overlay FROM events""")
def marks_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("mark"), F.col("event_type").alias("code_set"), F.concat(F.lit("b"), F.col("event_id") % 9).alias("code"), (F.col("event_id") % 3 == 0).alias("odd"))
    codes = e.where("not odd").select("code_set", "code", F.col("code_set").alias("title")).distinct()
    return iv.exemption_texts(e, codes).select("mark", "overlay")


@query("fields_inherited", B + """, n AS (SELECT doc_id AS tree, block_no AS node, CASE WHEN block_no > 0 THEN (block_no - 1) // 2 END AS parent, 'n' || block_no AS name, CASE WHEN block_no % 5 = 0 THEN 'v' || block_no END AS own FROM blocks),
f AS (SELECT tree, node, name AS full_name, own AS value FROM n WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, f.full_name || '.' || n.name, coalesce(n.own, f.value) FROM n JOIN f ON n.tree = f.tree AND n.parent = f.node) SELECT * FROM f""")
def fields_inherited(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("block_no")
    nodes = blocks(spark, d).select(F.col("doc_id").alias("tree"), k.alias("node"), F.when(k > 0, F.floor((k - 1) / 2).cast("int")).alias("parent"), F.concat(F.lit("n"), k).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("v"), k)).alias("own"))
    return iv.inherited(nodes, "own")


@query("threads_of_beads", B + " SELECT doc_id AS thread, block_no AS bead, block_no AS place FROM blocks")
def threads_of_beads(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).join(blocks(spark, d).groupBy("doc_id").agg(F.max("block_no").alias("last")), "doc_id")
    return iv.beads(b.select(F.col("doc_id").alias("thread"), F.col("block_no").alias("bead"), F.when(F.col("block_no") < F.col("last"), F.col("block_no") + 1).alias("next"), (F.col("block_no") == 0).alias("first")))


@query("layout_lines", G + ", t AS (SELECT doc_id, page, line_no, string_agg(ch, '' ORDER BY glyph_no) AS text FROM glyphs GROUP BY ALL) SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1)::INT AS line, text FROM t")
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return iv.build_lines(dv.glyph_pages(table(spark, d, "documents"), ("y0", "y1", "x0", "ch")))


@query("table_edges", B + """, r AS (SELECT doc_id, page, 'h' AS axis, (block_no % 20) * 2.0 + CASE WHEN block_no % 4 = 0 THEN 3.5 ELSE 0 END AS pos FROM blocks),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, page, axis ORDER BY pos) >= 3 THEN 1 ELSE 0 END AS n FROM r), k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page, axis ORDER BY pos) AS e FROM m)
SELECT doc_id, page, axis, e::BIGINT AS edge_no, round(avg(pos), 6)::DOUBLE AS "at" FROM k GROUP BY ALL""")
def table_edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("block_no")
    rules = blocks(spark, d).select("doc_id", "page", F.lit("h").alias("axis"), ((k % 20) * 2.0 + F.when(k % 4 == 0, 3.5).otherwise(0.0)).alias("at"))
    return iv.grid_edges(rules).withColumn("at", F.round("at", 6))


@query("table_merged_cells", "WITH " + dv.LINES_SQL + r""", r0 AS (SELECT doc_id, line_no AS "row", string_split(text, ' | ') AS cs FROM doc_lines WHERE contains(text, ' | ')),
c AS (SELECT doc_id, "row", unnest(range(0, len(cs)))::INT AS col, length(unnest(cs)) % 3 <> 0 AS ruled FROM r0), k AS (SELECT *, sum(ruled::INT) OVER (PARTITION BY doc_id, "row" ORDER BY col) AS k FROM c)
SELECT doc_id, "row", min(col) AS first_col, count(*) AS cols FROM k GROUP BY doc_id, "row", k""")
def table_merged_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = dv.doc_lines(table(spark, d, "documents")).where(F.col("text").contains(" | ")).select("doc_id", F.col("line_no").alias("row"), F.posexplode(F.split("text", r" \| ", -1)).alias("col", "t"))
    return iv.merged_cells(rows.withColumn("ruled", F.length("t") % 3 != 0))


@query("form_blank_fields", B + """ SELECT doc_id, block_no AS box, CASE WHEN words BETWEEN 1 AND 2 THEN 'checkbox' ELSE 'text' END AS kind FROM blocks WHERE words BETWEEN 1 AND 51 AND block_no % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words, block_no) <= 200""")
def form_blank_fields(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d)
    y = F.col("block_no") * 20.0
    return iv.blank_fields(b.select("doc_id", F.col("block_no").alias("box"), F.lit(0.0).alias("x0"), y.alias("y0"), (F.col("words") * 7.0).alias("x1"), (y + 10).alias("y1"), (F.col("block_no") % 2 == 1).alias("occupied")))


@query("layout_flow", B + """, f AS (SELECT doc_id, page, block_no AS y, 'block' AS kind, block_no AS node FROM blocks WHERE words > 0 UNION ALL SELECT doc_id, page, block_no, 'table', block_no FROM blocks WHERE contains(text, ' | '))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y, kind, node) - 1)::INT AS flow_no, kind, node FROM f""")
def layout_flow(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).withColumns({"y": F.col("block_no"), "node": F.col("block_no")})
    return iv.flow(("block", b.where("words > 0")), ("table", b.where(F.col("text").contains(" | "))))


@query("audit_preflight", """WITH f AS (SELECT l_orderkey AS doc_id, 'dpi' AS measure, l_quantity * 10 AS value FROM lineitem UNION ALL SELECT l_orderkey, 'hairline', l_discount FROM lineitem)
SELECT doc_id, 'low_dpi' AS rule, 'error' AS severity, count(*) FILTER (value < 150) AS n FROM f WHERE measure = 'dpi' GROUP BY doc_id UNION ALL SELECT doc_id, 'thin', 'warning', count(*) FILTER (value < 0.05) FROM f WHERE measure = 'hairline' GROUP BY doc_id""")
def audit_preflight(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "lineitem")
    fact = lambda m, v: item.select(F.col("l_orderkey").alias("doc_id"), F.lit(m).alias("measure"), v.alias("value"))
    return iv.preflight(fact("dpi", F.col("l_quantity") * 10.0).unionByName(fact("hairline", F.col("l_discount").cast("double"))), {"low_dpi": ("dpi", 150, "error"), "thin": ("hairline", 0.05, "warning")})


@query("fn_boxes", """WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT vec_id, least(e[1], e[3]) AS a0, greatest(e[1], e[3]) AS a1, least(e[2], e[4]) AS b0, greatest(e[2], e[4]) AS b1,
  least(e[5], e[7]) AS c0, greatest(e[5], e[7]) AS c1, least(e[6], e[8]) AS d0, greatest(e[6], e[8]) AS d1 FROM b)
SELECT vec_id, round(CASE WHEN greatest(a0, c0) < least(a1, c1) AND greatest(b0, d0) < least(b1, d1) THEN (least(a1, c1) - greatest(a0, c0)) * (least(b1, d1) - greatest(b0, d0)) ELSE 0 END, 9)::DOUBLE AS common,
  round((greatest(a1, c1) - least(a0, c0)) * (greatest(b1, d1) - least(b0, d0)), 9)::DOUBLE AS hull, 1.0::DOUBLE AS small FROM x""")
def fn_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    a, b = ge.box(e(0), e(1), e(2), e(3)), ge.box(e(4), e(5), e(6), e(7))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    return rows.select("vec_id", F.round(ge.area(ge.intersect(F.col("a"), F.col("b"))), 9).alias("common"), F.round(ge.area(ge.union(F.col("a"), F.col("b"))), 9).alias("hull"), F.round(ge.area(ge.inset(F.col("a"), 1.0)), 6).alias("small"))


@query("fn_kinds", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'replace' WHEN 2 THEN 'callout' ELSE 'other' END AS kind, '#' || upper(lpad(printf('%x', (event_id % 256)::INT), 2, '0')) || '00FF' AS color,
  epoch(date_trunc('second', ts))::BIGINT - 9000 AS at_utc FROM events""")
def fn_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("event_id") % 4 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), k)
    kind = ge.comment_kind(pick("Text", "StrikeOut", "FreeText", "Odd"), pick("", "StrikeOutTextEdit", "FreeTextCallout", ""))
    when = ge.document_date(F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+02'30'")))
    return table(spark, d, "events").select("event_id", kind.alias("kind"), fn.hex_color((F.col("event_id") % 256) / 255.0, F.lit(0.0), F.lit(1.0)).alias("color"), when.alias("at_utc"))


@query("fn_signs", """SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS raised, c_name || ' ' || c_custkey AS leaders, upper(left(c_mktsegment, 1)) AS initials FROM customer""")
def fn_signs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", ge.superscript(key).alias("raised"), ge.drop_leaders(F.concat("c_name", F.lit(" ..... "), key)).alias("leaders"), fn.initials(F.col("c_mktsegment")).alias("initials"))


@query("order_listed", """SELECT o_orderkey AS id, (row_number() OVER (ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 1000 ELSE 9999 END, o_orderkey) - 1)::INT AS place FROM orders""")
def order_listed(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders first, by the last digits of their keys."""
    o = table(spark, d, "orders")
    listed = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).cast("int").alias("pos"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("o"))
    return nv.order_list(rows, "id", listed, "o").select("id", "place")
