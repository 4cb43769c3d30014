"""Queries on column gaps, paragraphs, tables without rules, catalogues, standards and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import audits as au
from ..operators import catalogs as ct
from ..operators import compare as cp
from ..operators import forms as fm
from ..operators import inventory as iv
from ..operators import lineage as lg
from ..operators import structure as st
from ..operators import tables as tb
from ..operators import textflow as tf
from ..sources import derived as dv
from ..sources import files as fl
from .catalog import query, table

L = "WITH " + dv.LINES_SQL
MARKER_SQL = r"^([•●◦▪■‣⁃\-–*]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return dv.doc_lines(table(spark, d, "documents")).withColumn("page", F.floor(F.col("line_no") / dv.LINES_A_PAGE).cast("int"))


@query("layout_split_columns", L + r""", w AS (SELECT doc_id, (line_no // 20)::INT AS page, line_no, len(regexp_extract_all(text, '[^ \t-\r]+')) AS n FROM doc_lines),
near AS (SELECT a.doc_id, a.line_no, count(b.line_no) FILTER (b.n >= 9) AS others FROM w a LEFT JOIN w b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no <> b.line_no AND abs(a.line_no - b.line_no) <= 3 GROUP BY ALL)
SELECT w.doc_id, w.line_no, ((n > 5)::INT + (n > 8 AND others >= 2)::INT)::INT AS last_segment, n::BIGINT AS words FROM w JOIN near USING (doc_id, line_no) WHERE n > 0""")
def layout_split_columns(spark: SparkSession, d: str) -> DataFrame:
    """Words of 58 with gaps of 2; one of 32 after the fifth parts any line, one of 16 after the eighth those that agree with their neighbours."""
    words = lines(spark, d).select("doc_id", "page", "line_no", F.posexplode(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).alias("i", "word"))
    x0 = F.col("i") * 60.0 + F.when(F.col("i") >= 5, 30.0).otherwise(0.0) + F.when(F.col("i") >= 8, 14.0).otherwise(0.0)
    placed = words.select("doc_id", "page", "line_no", x0.alias("x0"), (x0 + 58).alias("x1"), ((F.col("line_no") % dv.LINES_A_PAGE) * 12.0).alias("cy"), F.lit(10.0).alias("size"))
    return tf.split_columns(placed).groupBy("doc_id", "line_no").agg(F.max("segment").alias("last_segment"), F.count("*").alias("words"))


@query("layout_paragraphs", L + f""", k AS (SELECT doc_id, (line_no // 20)::INT AS page, line_no, regexp_matches(text, '{MARKER_SQL}') AS item FROM doc_lines WHERE regexp_matches(text, '[^ \\t-\\r]')),
s AS (SELECT *, CASE WHEN lag(line_no) OVER w = line_no - 1 AND NOT item THEN 0 ELSE 1 END AS st FROM k WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))
SELECT doc_id, page, line_no, (sum(st) OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1)::INT AS block FROM s""")
def layout_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Full lines in one column: blank lines and list items part the paragraphs."""
    rows = lines(spark, d).where(F.col("text").rlike(r"[^ \t-\r]"))
    y0 = (F.col("line_no") % dv.LINES_A_PAGE) * 12.0
    return tf.group_paragraphs(rows.select("doc_id", "page", "line_no", F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(300.0).alias("x1"), (y0 + 10).alias("y1"), F.lit(10.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("mixed"), "text"))


@query("layout_continuations")
def layout_continuations(spark: SparkSession, d: str) -> DataFrame:
    """A line is a block; its width follows its text. Order-dependent within a page; tests hold it on literal pages."""
    rows = lines(spark, d).where(F.col("text").rlike(r"[^ \t-\r]"))
    y0 = (F.col("line_no") % dv.LINES_A_PAGE) * 14.0
    x1 = F.least(F.length("text") * 5.0, F.lit(400.0))
    blocks = rows.select("doc_id", "page", F.col("line_no").alias("block"), F.lit("paragraph").alias("kind"), F.lit("plain").alias("style"), F.lit(10.0).alias("size"), F.lit(0.0).alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 10).alias("y1"),
                         F.lit(1).alias("lines"), F.lit(0.0).alias("last_x0"), x1.alias("last_x1"), (F.length(F.regexp_extract("text", r"[^ \t-\r]+", 0)) * 5.0).alias("first_width"), "text")
    return tf.join_continuations(blocks).select("doc_id", "page", "block", "continues", "next_column")


@query("layout_drop_caps", "WITH " + dv.PAGES_SQL + r""" SELECT doc_id, page, 0 AS cap, 1 AS block FROM doc_pages WHERE regexp_matches(upper(left(text, 1)), '^\p{Lu}$') AND regexp_matches(text, '^\p{L}')""")
def layout_drop_caps(spark: SparkSession, d: str) -> DataFrame:
    pages = dv.doc_pages(table(spark, d, "documents"))
    cap = pages.select("doc_id", "page", F.lit(0).alias("block"), F.lit(30.0).alias("size"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(20.0).alias("x1"), fn.capital(F.left("text", F.lit(1))).alias("text"))
    body = pages.select("doc_id", "page", F.lit(1).alias("block"), F.lit(10.0).alias("size"), F.lit(21.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(300.0).alias("x1"), "text")
    return tf.drop_caps(cap.unionByName(body))


@query("table_stream")
def table_stream(spark: SparkSession, d: str) -> DataFrame:
    """Lines with bars as aligned segments below a header; tests hold it on literal tables."""
    rows = lines(spark, d).where(F.col("text").contains(" | ")).select("doc_id", "page", "line_no", F.posexplode(F.split("text", r" \| ", -1)).alias("col", "text"))
    x0, y0 = F.col("col") * 60.0, F.col("line_no") * 12.0
    return tf.stream_table(rows.where("text <> ''").select("doc_id", "page", F.lit(0).alias("table_no"), F.lit(0.0).alias("tx0"), F.lit(600.0).alias("tx1"), F.col("line_no").alias("line"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), "text"))


@query("nav_attachments", """SELECT o_custkey AS doc_id, 'tree:' || o_orderkey AS id, NULL::INT AS page, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN 'f' || o_orderkey END, o_orderkey::VARCHAR) AS filename, o_orderpriority AS description,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 7 END, o_orderkey) AS size FROM orders
UNION ALL SELECT l_partkey, 'annot:' || l_linenumber || ':' || l_orderkey, l_linenumber::INT, 'attachment', coalesce(CASE WHEN l_linenumber = 1 THEN 'first' END, l_returnflag), NULL FROM lineitem""")
def nav_attachments(spark: SparkSession, d: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    key = F.col("o_orderkey").cast("string")
    named = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("f"), key)).alias("filename"), F.col("o_orderpriority").alias("description"),
                                             F.when(F.col("o_orderkey") % 2 == 0, 7).cast("long").alias("size"), F.col("o_orderkey").cast("long").alias("length"), none("timestamp").alias("created"), none("timestamp").alias("modified"))
    annots = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_orderkey").alias("annot_no"), F.col("l_returnflag").alias("contents"), none("string").alias("filename"),
                                                F.when(F.col("l_linenumber") == 1, "first").alias("description"), none("long").alias("size"), none("timestamp").alias("created"), none("timestamp").alias("modified"))
    return ct.attachment_inventory(named, annots).drop("created", "modified")


@query("nav_layer_list", """WITH c AS (SELECT c_nationkey AS doc_id, c_custkey AS k FROM customer), rows AS (
  SELECT doc_id, 0 AS late, 0 AS a, 0 AS b, 'label' AS kind, NULL AS layer, 'Group' AS name, 0 AS depth, NULL AS group_name FROM c GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 0, k, 'layer', k, 'L' || k, 1, 'Group' FROM c WHERE k % 3 = 1 UNION ALL SELECT doc_id, 0, k, 0, 'layer', k, 'L' || k, 0, NULL FROM c WHERE k % 3 = 2
  UNION ALL SELECT doc_id, 1, k, 0, 'layer', k, 'L' || k, 0, NULL FROM c WHERE k % 3 = 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY late, a, b) - 1)::INT AS no, kind, layer, name, CASE WHEN kind = 'layer' THEN layer % 2 = 0 END AS visible, depth, group_name FROM rows""")
def nav_layer_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("doc_id"), F.col("c_custkey").cast("int").alias("layer"))
    layers = c.select("doc_id", "layer", F.concat(F.lit("L"), "layer").alias("name"), (F.col("layer") % 2 == 0).alias("visible"), F.lit(False).alias("locked"), F.col("layer").alias("ord"))
    group = c.select("doc_id").distinct().select("doc_id", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("ord"), F.lit("Group").alias("label"), F.lit(None).cast("int").alias("layer"))
    listed = c.where("layer % 3 > 0").select("doc_id", F.col("layer").alias("node"), F.when(F.col("layer") % 3 == 1, 0).alias("parent"), F.col("layer").alias("ord"), F.lit(None).cast("string").alias("label"), "layer")
    return ct.layer_inventory(layers, group.unionByName(listed)).drop("locked")


@query("nav_scripts", """SELECT user_id AS doc_id, event_type AS name, CASE event_id % 4 WHEN 0 THEN 'Keystroke' WHEN 1 THEN 'Calculate' WHEN 2 THEN 'Zz' ELSE 'Page open' END AS event, length(coalesce(props, ''))::INT AS length, left(coalesce(props, ''), 5) AS script FROM events""")
def nav_scripts(spark: SparkSession, d: str) -> DataFrame:
    trigger = F.element_at(F.array(*map(F.lit, ("K", "C", "Zz", "O"))), (F.col("event_id") % 4 + 1).cast("int"))
    actions = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit("field").alias("location"), F.col("event_type").alias("name"), trigger.alias("trigger"), F.lit(0).alias("page"), F.col("props").cast("string").alias("script"))
    return ct.script_inventory(actions, 5).select("doc_id", "name", "event", "length", "script")


@query("nav_moves", """SELECT o_custkey AS tree, o_orderkey AS node, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 <> 1, o_orderkey) - 1)::INT AS ord FROM orders""")
def nav_moves(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the orders of a customer to the top of the list."""
    n = table(spark, d, "orders").select(F.col("o_custkey").cast("int").alias("tree"), F.col("o_orderkey").cast("int").alias("node"), F.lit(None).cast("int").alias("parent"), F.col("o_orderkey").cast("int").alias("ord"))
    moves = n.where("node % 4 = 1").select("tree", "node", F.lit(None).cast("int").alias("target"), F.lit(0).alias("at"))
    return ct.move_subtrees(n, moves).select("tree", "node", "ord")


@query("audit_standard", """WITH f AS (SELECT l_orderkey AS doc_id, l_suppkey % 5 AS m, l_linenumber AS k FROM lineitem), i AS (
  SELECT doc_id, CASE m WHEN 0 THEN 'fonts' WHEN 1 THEN 'attachments' END AS rule FROM f WHERE m IN (0, 1)
  UNION ALL SELECT o_orderkey, 'structure' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM f WHERE k = 2) UNION ALL SELECT o_orderkey, 'metadata' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM f WHERE k = 3)
  UNION ALL SELECT DISTINCT doc_id, 'color' FROM f WHERE m = 2 AND doc_id NOT IN (SELECT doc_id FROM f WHERE m = 3))
SELECT doc_id, rule, 'error' AS severity, count(*) AS n FROM i GROUP BY ALL""")
def audit_standard(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as facts of a document."""
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 5).alias("m"), "l_linenumber")
    facts = F.array(*map(F.lit, ("font_not_embedded", "embedded_file", "rgb", "archive_intent")))
    a = item.where("m < 4").select("doc_id", F.get(facts, F.col("m").cast("int")).alias("fact"), F.lit("").alias("value"))
    b = item.where("l_linenumber in (2, 3)").select("doc_id", F.when(F.col("l_linenumber") == 2, "document_id").otherwise("part").alias("fact"), F.lit("2").alias("value"))
    return au.validate_standard(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), a.unionByName(b), "archive-2")


@query("tables_sink", L + """, r AS (SELECT doc_id, line_no, string_split(text, ' | ') AS cs FROM doc_lines WHERE contains(text, ' | ')), t AS (SELECT doc_id, count(*) AS n_rows, sum(len(cs))::BIGINT AS n_cells FROM r GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_texts FROM doc_lines WHERE NOT contains(text, ' | ') GROUP BY doc_id) SELECT doc_id, n_rows, n_cells, coalesce(n_texts, 0)::BIGINT AS n_texts FROM t LEFT JOIN x USING (doc_id)""")
def tables_sink(spark: SparkSession, d: str) -> DataFrame:
    """Rows with bars to tables, the other lines to the text relation; both read back."""
    folder = f"{lg.shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    every = lines(spark, d)
    rows = every.where(F.col("text").contains(" | "))
    cells = rows.select("doc_id", F.lit(0).alias("table_no"), F.col("line_no").alias("row"), F.posexplode(F.split("text", r" \| ", -1)).alias("col", "text"))
    texts = every.where(~F.col("text").contains(" | ")).select("doc_id", F.col("line_no").alias("flow_no"), "page", F.lit("paragraph").alias("kind"), "text")
    fl.write_tables(cells, texts, folder)
    t = spark.read.parquet(f"{folder}/tables").groupBy("doc_id").agg(F.countDistinct("row").alias("n_rows"), F.count("*").alias("n_cells"))
    x = spark.read.parquet(f"{folder}/text").groupBy("doc_id").agg(F.count("*").alias("n_texts"))
    return t.withColumn("doc_id", F.col("doc_id").cast("long")).join(x, "doc_id", "left").select("doc_id", "n_rows", "n_cells", F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


@query("render_xml")
def render_xml(spark: SparkSession, d: str) -> DataFrame:
    """Tests parse it and hold its words and their order against the texts."""
    return fl.render_xml(lines(spark, d))


@query("form_labels", L + r""" SELECT doc_id, (line_no // 20)::INT AS page, line_no AS field, CASE WHEN length(text) <= 220 THEN trim(text, chr(32) || chr(9) || chr(13)) WHEN line_no % 2 = 0 THEN 'tip' END AS label,
  CASE WHEN length(text) <= 220 THEN 'left' WHEN line_no % 2 = 0 THEN 'tooltip' ELSE 'none' END AS source FROM doc_lines WHERE regexp_matches(text, '[^ \t-\r]')""")
def form_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every line is a block with a field at its right; texts too long for a label leave the tooltip."""
    rows = lines(spark, d).where(F.col("text").rlike(r"[^ \t-\r]"))
    y0 = (F.col("line_no") % dv.LINES_A_PAGE) * 40.0
    x1 = F.length("text") * 5.0
    blocks = rows.select("doc_id", "page", F.col("line_no").alias("block"), F.lit(0.0).alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 10).alias("y1"), F.lit(10.0).alias("size"), "text")
    fields = rows.select("doc_id", "page", F.col("line_no").alias("field"), F.lit("text").alias("kind"), F.when(F.col("line_no") % 2 == 0, "tip").alias("tooltip"), (x1 + 10).alias("x0"), y0.alias("y0"), (x1 + 60).alias("x1"), (y0 + 10).alias("y1"))
    return fm.pair_labels(fields, blocks).select("doc_id", "page", "field", "label", "source")


@query("form_labels_tokens", L + r""", w AS (SELECT doc_id, (line_no // 20)::INT AS page, line_no, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM doc_lines),
t AS (SELECT * FROM w WHERE len(ws) >= 2 AND length(ws[1] || ' ' || ws[2]) <= 220 AND NOT contains(ws[1] || ws[2], ':'))
SELECT doc_id, page, line_no * 2 + k - 1 AS field, ws[k] AS label, 'above' AS source FROM t, (VALUES (1), (2)) AS v(k)
UNION ALL SELECT doc_id, page, -1 - line_no AS field, ws[1] AS label, 'cell_left' AS source FROM t""")
def form_labels_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of a line stand over a field each and use up their own word; a third field stands in an empty cell beside the first word's."""
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    w = lambda k: F.get("ws", F.lit(k))
    rows = lines(spark, d).withColumn("ws", words).where(F.size("ws") >= 2)
    rows = rows.where((F.length(F.concat(w(0), F.lit(" "), w(1))) <= 220) & ~F.contains(F.concat(w(0), w(1)), F.lit(":")))
    y0 = (F.col("line_no") % dv.LINES_A_PAGE) * 60.0
    token = lambda k: F.struct(F.lit(100.0 * k).alias("x0"), y0.alias("y0"), F.lit(100.0 * k + 50).alias("x1"), (y0 + 10).alias("y1"), w(k).alias("text"))
    blocks = rows.select("doc_id", "page", F.col("line_no").alias("block"), F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(150.0).alias("x1"), (y0 + 10).alias("y1"), F.lit(10.0).alias("size"), F.concat(w(0), F.lit(" "), w(1)).alias("text"), F.array(token(0), token(1)).alias("tokens"))
    field = lambda number, x, y: rows.select("doc_id", "page", number.cast("int").alias("field"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tooltip"), F.lit(x).alias("x0"), y.alias("y0"), F.lit(x + 60).alias("x1"), (y + 10).alias("y1"))
    fields = field(F.col("line_no") * 2, 0.0, y0 + 14).unionByName(field(F.col("line_no") * 2 + 1, 100.0, y0 + 14)).unionByName(field(-1 - F.col("line_no"), 700.0, y0))
    cell = lambda col, x, text: rows.select("doc_id", "page", F.lit(0).alias("table_no"), F.col("line_no").alias("row"), F.lit(col).alias("col"), F.lit(x).alias("x0"), y0.alias("y0"), F.lit(x + 100).alias("x1"), (y0 + 20).alias("y1"), text.alias("text"))
    cells = cell(0, 580.0, w(0)).unionByName(cell(1, 680.0, F.lit("")))
    return fm.pair_labels(fields, blocks, cells).select("doc_id", "page", "field", "label", "source")


@query("table_ruled_cells", L + r""", w AS (SELECT doc_id, (line_no // 20)::INT AS page, line_no % 20 AS k, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM doc_lines),
p AS (SELECT *, max(len(ws)) OVER v >= 3 AS wide, count(*) OVER v AS n FROM w WINDOW v AS (PARTITION BY doc_id, page)),
t AS (SELECT *, sum((k = 0 OR len(ws) > 0)::INT) OVER (PARTITION BY doc_id, page ORDER BY k) AS cell FROM p WHERE n >= 2)
SELECT doc_id, page, min(k)::INT AS row, 0 AS col, count(*)::INT AS row_span, 1 AS col_span, coalesce(min_by(ws[1], k), '') AS text FROM t GROUP BY doc_id, page, cell
UNION ALL SELECT doc_id, page, k::INT, 1, 1, CASE WHEN wide AND len(ws) < 3 THEN 2 ELSE 1 END, coalesce(ws[2], '') FROM t
UNION ALL SELECT doc_id, page, k::INT, 2, 1, 1, ws[3] FROM t WHERE len(ws) >= 3""")
def table_ruled_cells(spark: SparkSession, d: str) -> DataFrame:
    """A ruled row for each line of a page: its first three words in columns, the last two merged where there is no third word, the first merged with that above on blank lines."""
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    rows = lines(spark, d).select("doc_id", "page", (F.col("line_no") % dv.LINES_A_PAGE).alias("k"), words.alias("ws"))
    y = F.col("k") * 20.0
    rule = lambda axis, at, lo, hi: F.struct(F.lit(axis).alias("axis"), at.alias("at"), lo.alias("lo"), hi.alias("hi"))
    v = lambda x: rule("v", F.lit(float(x)), y, y + 20)
    h = lambda at, x0, x1: rule("h", at, F.lit(float(x0)), F.lit(float(x1)))
    whole = [v(0), v(100), v(300), h(y + 20, 100, 300), F.when(F.size("ws") >= 3, v(200)), F.when((F.col("k") == 0) | (F.size("ws") > 0), h(y, 0, 100)), F.when(F.col("k") == 0, h(y, 100, 300))]
    rules = rows.select("doc_id", "page", "k", F.posexplode(F.array_compact(F.array(*whole))).alias("i", "r")).select("doc_id", "page", (F.col("k") * 10 + F.col("i")).alias("rule"), "r.*")
    said = rows.select("doc_id", "page", y.alias("y"), F.posexplode(F.slice("ws", 1, 3)).alias("i", "text")).select("doc_id", "page", (F.col("i") * 100.0 + 10).alias("x0"), (F.col("y") + 5).alias("y0"), (F.col("i") * 100.0 + 60).alias("x1"), (F.col("y") + 15).alias("y1"), "text")
    return tb.ruled_cells(rules, said).select("doc_id", "page", "row", "col", "row_span", "col_span", "text")


@query("audit_structure")
def audit_structure(spark: SparkSession, d: str) -> DataFrame:
    """Lines as segments of their block's size; order-dependent within a page, tests hold it on literal pages."""
    b = dv.blocks(table(spark, d, "documents")).where("words > 0")
    t = 800.0 - (F.col("block_no") % dv.LINES_A_PAGE) * 14.0
    segments = b.select("doc_id", "page", F.col("block_no").alias("seg"), F.lit(50.0).alias("l"), (t - 10).alias("b"), F.least(50.0 + F.length("text") * 5.0, F.lit(550.0)).alias("r"), t.alias("t"), "size", F.lit(False).alias("bold"), F.lit(False).alias("figure"), "text", F.lit(600.0).alias("width"))
    return st.auto_structure(segments)


@query("measurements_csv", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), t AS (SELECT vec_id, list_transform(e, lambda x: round_even(x::DECIMAL(18,6), 2)::DECIMAL(18,2)::VARCHAR) AS s FROM p)
SELECT 'doc "' || vec_id || '", a' AS document, (vec_id % 7 + 1)::VARCHAR AS page, 'Distance' AS kind, array_to_string(list_transform(range(1, len(s) // 2 + 1), lambda i: s[2 * i - 1] || ' ' || s[2 * i]), '; ') AS points FROM t""")
def measurements_csv(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as polylines, written and read back."""
    folder = f"{lg.shared_dir(spark)}/measurements-{uuid.uuid4().hex}"
    e = table(spark, d, "embeddings").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = e.select(F.concat(F.lit('doc "'), "vec_id", F.lit('", a')).alias("document"), (F.col("vec_id") % 7).alias("page"), F.lit("distance").alias("kind"), F.lit("1 m").alias("label"), F.lit(None).cast("string").alias("ratio"), F.lit(None).cast("string").alias("author"), F.lit(True).alias("saved"), iv.measurement_rows(F.col("embedding")).alias("points"))
    fl.write_measurements(rows, folder)
    back = spark.read.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(folder)
    return back.select(F.col("Document").alias("document"), F.col("Page").alias("page"), F.col("Type").alias("kind"), F.col("Points").alias("points"))


@query("compare_classes", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders), c AS (SELECT doc_id, CASE WHEN k % 5 = 0 THEN 'pages' WHEN k % 5 = 1 THEN 'content' WHEN k % 5 = 2 THEN 'annotations' END AS kind FROM o
  UNION ALL SELECT doc_id, CASE WHEN k % 4 = 0 THEN 'fields' WHEN k % 4 = 1 THEN 'form_fill' END FROM o UNION ALL SELECT doc_id, 'signatures' FROM o WHERE k % 4 = 2)
SELECT doc_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM c WHERE kind IS NOT NULL GROUP BY doc_id""")
def compare_classes(spark: SparkSession, d: str) -> DataFrame:
    """The orders of a customer as pages and fields, some of them changed."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    k5, k4 = F.col("k") % 5, F.col("k") % 4
    page = lambda rows, content, notes: rows.select("doc_id", F.col("k").alias("page"), content.alias("content"), notes.alias("notes"))
    field = lambda rows, value, signed: rows.select("doc_id", F.col("k").alias("name"), value.alias("value"), signed.alias("signed"))
    same = F.lit("same")
    return cp.classify_revisions(
        page(o, same, same), page(o.where(k5 != 0), F.when(k5 == 1, "new").otherwise(same), F.when(k5 == 2, "new").otherwise(same)),
        field(o.where(k4 != 0), same, F.lit(False)), field(o, F.when(k4 == 1, "new").otherwise(same), k4 == 2))


@query("conversion_status", "WITH " + dv.BLOCKS_SQL + " SELECT CASE WHEN count(*) FILTER (words = 0) > 0 THEN 'ok_with_warnings' ELSE 'ok' END AS status FROM blocks")
def conversion_status(spark: SparkSession, d: str) -> DataFrame:
    b = dv.blocks(table(spark, d, "documents")).where("words = 0")
    return fl.report_status(fl.conversion_report(b.select(F.lit("blank").alias("code"), "page", F.lit(1).cast("long").alias("n"))))
