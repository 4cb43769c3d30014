"""Queries on page sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import pages as pg
from ..sources import derived as dv
from .catalog import query, table

P = "WITH " + dv.PAGES_SQL
B = "WITH " + dv.BLOCKS_SQL


def pages(spark: SparkSession, d: str) -> DataFrame:
    return dv.doc_pages(table(spark, d, "documents"))


@query("pages_range", P + """, n AS (SELECT doc_id, max(page) + 1 AS n FROM doc_pages GROUP BY doc_id)
SELECT doc_id, page + 1 AS page, md5(text) AS digest FROM doc_pages JOIN n USING (doc_id) WHERE n >= 3 AND page IN (0, 2)""")
def pages_range(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    wanted = p.groupBy("doc_id").agg((F.max("page") + 1).alias("n")).select("doc_id", F.explode(pg.parse_range(F.lit("1,3"), F.col("n"))).alias("page"))
    return p.withColumn("page", F.col("page") + 1).join(wanted, ["doc_id", "page"], "left_semi").select("doc_id", "page", F.md5("text").alias("digest"))


@query("pages_keep", P + """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1)::INT AS page, md5(text) AS digest FROM doc_pages WHERE page % 2 = 1""")
def pages_keep(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return pg.keep_pages(p, p.where("page % 2 = 1").select("doc_id", "page")).select("doc_id", "page", F.md5("text").alias("digest"))


@query("pages_delete", P + """, k AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS last FROM doc_pages)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1)::INT AS page, md5(text) AS digest FROM k WHERE page % 3 <> 0 OR last = 0""")
def pages_delete(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return pg.delete_pages(p, p.where("page % 3 = 0").select("doc_id", "page")).select("doc_id", "page", F.md5("text").alias("digest"))


@query("pages_insert", P + """, r AS (SELECT doc_id, page AS pos, 1 AS new, 0 AS n, text FROM doc_pages UNION ALL SELECT doc_id, 1, 0, k, 'blank ' || k FROM (SELECT DISTINCT doc_id FROM doc_pages WHERE page = 1), range(1, 3) t(k))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, new, n) - 1)::INT AS page, md5(text) AS digest FROM r""")
def pages_insert(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    new = p.where("page = 1").select("doc_id", F.lit(1).alias("at"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n")).withColumn("text", F.concat(F.lit("blank "), F.col("n")))
    return pg.insert_pages(p, new).select("doc_id", "page", F.md5("text").alias("digest"))


@query("pages_duplicate", P + """, l AS (SELECT doc_id, max(page) AS last FROM doc_pages WHERE page < 2 GROUP BY doc_id),
r AS (SELECT doc_id, page AS pos, 0 AS n, page AS p, text FROM doc_pages UNION ALL SELECT doc_id, last, k, page, text FROM doc_pages JOIN l USING (doc_id), range(1, 4) t(k) WHERE page < 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, n, p) - 1)::INT AS page, md5(text) AS digest FROM r""")
def pages_duplicate(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return pg.duplicate_pages(p, p.where("page < 2").select("doc_id", "page"), 3).select("doc_id", "page", F.md5("text").alias("digest"))


@query("pages_reorder", P + """, m AS (SELECT doc_id, max(page) AS last FROM doc_pages GROUP BY doc_id)
SELECT doc_id, (last - page)::INT AS page, md5(text) AS digest, last - page <> page AS moved FROM doc_pages JOIN m USING (doc_id)""")
def pages_reorder(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return pg.reorder_pages(p, p.select("doc_id", "page", (-F.col("page")).alias("place"))).select("doc_id", "page", F.md5("text").alias("digest"), "moved")


@query("pages_replace", P + """
SELECT a.doc_id, a.page, md5(coalesce(b.text, a.text)) AS digest FROM doc_pages a LEFT JOIN doc_pages b ON b.doc_id = a.doc_id + 1 AND b.page = a.page AND a.doc_id % 2 = 0""")
def pages_replace(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return pg.replace_pages(p, p.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)).select("doc_id", "page", F.md5("text").alias("digest"))


@query("pages_combine", P + """
SELECT doc_id // 10 AS target, (row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id % 10 DESC, page) - 1)::INT AS page, doc_id, page AS source_page FROM doc_pages""")
def pages_combine(spark: SparkSession, d: str) -> DataFrame:
    return pg.combine(pages(spark, d), -(F.col("doc_id") % 10), F.floor(F.col("doc_id") / 10))


@query("pages_stamp", P + """
SELECT doc_id, page, 'VR-' || CASE WHEN length(n::VARCHAR) >= 6 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 6, '0') END AS stamp FROM (SELECT doc_id, page, row_number() OVER (ORDER BY doc_id, page) + 99 AS n FROM doc_pages)""")
def pages_stamp(spark: SparkSession, d: str) -> DataFrame:
    return pg.global_numbers(pages(spark, d).select("doc_id", "page"), ["doc_id", "page"], 100).select("doc_id", "page", pg.sequential_stamp(F.col("number"), 6, "VR-").alias("stamp"))


@query("pages_footer", P + """
SELECT doc_id, page, 'Page ' || (page + 1) || ' of ' || count(*) OVER (PARTITION BY doc_id) || ' <<other>>' AS footer FROM doc_pages""")
def pages_footer(spark: SparkSession, d: str) -> DataFrame:
    counted = pages(spark, d).join(pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    return counted.select("doc_id", "page", pg.fill_template("Page <<PAGE>> of <<pages>> <<other>>", {"page": F.col("page") + 1, "pages": F.col("n")}).alias("footer"))


@query("pages_labels", P + """
SELECT doc_id, page, CASE WHEN page >= 3 THEN 'A-' || (page - 2) WHEN page >= 1 THEN repeat('i', page) ELSE (page + 1)::VARCHAR END AS label FROM doc_pages""")
def pages_labels(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    ranges = p.where("page = 0").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("start"), F.lit("r").alias("style"), F.lit("").alias("prefix"), F.lit(1).alias("first")), F.struct(F.lit(3).alias("start"), F.lit("D").alias("style"), F.lit("A-").alias("prefix"), F.lit(1).alias("first")))).alias("r")).select("doc_id", "r.*")
    return pg.label_pages(p.select("doc_id", "page"), ranges).select("doc_id", "page", fn.page_label(F.col("style"), F.col("prefix"), F.col("number")).alias("label"))


@query("pages_split_by_headings", B + """, m AS (SELECT doc_id, page, max_by(text, block_no) AS title FROM blocks WHERE size = 14 AND words > 0 GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, page FROM blocks)
SELECT p.doc_id, p.page, count(title) OVER w::INT AS part_no, coalesce(last_value(title IGNORE NULLS) OVER w, 'Front matter') AS title
FROM p LEFT JOIN m USING (doc_id, page) WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.page ROWS UNBOUNDED PRECEDING)""")
def pages_split_by_headings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    marks = dv.blocks(docs).where("size = 14 and words > 0").select("doc_id", "page", "block_no", F.col("text").alias("title"))
    return pg.split_by_marks(dv.doc_pages(docs), marks)


@query("pages_split_by_size", "WITH RECURSIVE " + dv.PAGES_SQL + """,
z AS (SELECT doc_id, page, length(text)::BIGINT AS n FROM doc_pages),
g AS (SELECT doc_id, page, n AS held, 0 AS part FROM z WHERE page = 0
  UNION ALL SELECT z.doc_id, z.page, CASE WHEN g.held > 0 AND g.held + z.n > 4000 THEN z.n ELSE g.held + z.n END, CASE WHEN g.held > 0 AND g.held + z.n > 4000 THEN g.part + 1 ELSE g.part END FROM g JOIN z ON z.doc_id = g.doc_id AND z.page = g.page + 1)
SELECT doc_id, page, part FROM g""")
def pages_split_by_size(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    sizes = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / dv.LINES_A_PAGE).cast("int")), lambda p: F.length(F.array_join(F.slice(lines, p * dv.LINES_A_PAGE + 1, dv.LINES_A_PAGE), "\n")).cast("long"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", sizes.alias("sizes"))
    return pg.split_by_size(docs, "sizes", 4000).select("doc_id", F.posexplode("parts").alias("page", "part"))


@query("pages_split_every", P + " SELECT doc_id, page, (page // 2)::INT AS part FROM doc_pages")
def pages_split_every(spark: SparkSession, d: str) -> DataFrame:
    return pg.split_every(pages(spark, d).select("doc_id", "page"), 2)


@query("names_unique", """
SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || ' (' || k || ')' END AS unique_name FROM (SELECT p_partkey, left(p_name, 4) AS b, row_number() OVER (PARTITION BY left(p_name, 4) ORDER BY p_partkey) AS k FROM part)""")
def names_unique(spark: SparkSession, d: str) -> DataFrame:
    return pg.unique_names(table(spark, d, "part").select("p_partkey", F.left("p_name", F.lit(4)).alias("base")), "base", ["p_partkey"]).select("p_partkey", "unique_name")


@query("documents_dedupe", """
SELECT sha256(text) AS digest, min(doc_id) AS canonical, count(*) AS copies, (sum(n_chars) - max(n_chars))::BIGINT AS saved FROM documents GROUP BY text HAVING count(*) > 1""")
def documents_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return pg.dedupe(table(spark, d, "documents"), "doc_id", "text", F.col("n_chars"))
