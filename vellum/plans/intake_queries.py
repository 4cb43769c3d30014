"""Queries on sources, renderings, intake limits and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import derived as dv
from ..sources import files as fl
from ..streaming import intake as st
from . import actions as ac
from .catalog import query, table


@query("source_units", "WITH " + dv.PAGES_SQL + r""" SELECT 'page' AS unit_kind, doc_id AS unit_id, page::BIGINT AS place, md5(text) AS digest FROM doc_pages
UNION ALL SELECT 'comment', conv_id, turn, md5(text) FROM conversations WHERE text <> ''
UNION ALL SELECT 'title', page_id, 0, md5(t) FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages) WHERE t <> ''""")
def source_units(spark: SparkSession, d: str) -> DataFrame:
    u = fl.text_units(table(spark, d, "documents"), table(spark, d, "conversations"), table(spark, d, "pages"))
    return u.select("unit_kind", "unit_id", "place", F.md5("text").alias("digest"))


@query("source_manifest")
def source_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Depends on the folder, so it has no oracle."""
    return fl.corpus_manifest(spark, d, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "bytes")


@query("source_refresh", "SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'extract' ELSE 'keep' END AS what FROM documents WHERE doc_id % 5 <> 0")
def source_refresh(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("modified"))
    now = docs.where("path % 5 <> 0").withColumn("modified", F.when(F.col("path") % 4 == 0, F.col("modified") + 1).otherwise(F.col("modified")))
    keep, extract = fl.refresh_index(docs, now)
    return keep.select("path", F.lit("keep").alias("what")).unionByName(extract.select("path", F.lit("extract").alias("what")))


NODES_SQL = "WITH " + dv.BLOCKS_SQL + r""", k AS (SELECT *, regexp_extract(text, '^\s*([•●◦▪■‣⁃\-–*]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s', 1) AS marker, CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '^\s*([•●◦▪■‣⁃\-–*]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s') THEN 'list' WHEN size = 14 THEN 'heading' ELSE 'paragraph' END AS kind,
  regexp_replace(text, '^\s*([•●◦▪■‣⁃\-–*]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s', '') AS body FROM blocks WHERE words > 0),
n AS (SELECT *, coalesce(lag(kind) OVER w, '') AS b, coalesce(lead(kind) OVER w, '') AS a FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))"""
_HTML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("render_html", NODES_SQL + f""", t AS (SELECT *, {_HTML.format("text")} AS e, CASE WHEN length(marker) = 1 THEN {_HTML.format("body")} ELSE {_HTML.format("text")} END AS i, CASE WHEN b = 'table' THEN 'td' ELSE 'th' END AS c FROM n)
SELECT doc_id, md5(string_agg(CASE kind WHEN 'heading' THEN '<h2>' || e || '</h2>' WHEN 'list' THEN CASE WHEN b <> 'list' THEN '<ul>' || chr(10) ELSE '' END || '<li>' || i || '</li>' || CASE WHEN a <> 'list' THEN chr(10) || '</ul>' ELSE '' END
  WHEN 'table' THEN CASE WHEN b <> 'table' THEN '<table>' || chr(10) ELSE '' END || '<tr><' || c || '>' || replace(e, ' | ', '</' || c || '><' || c || '>') || '</' || c || '></tr>' || CASE WHEN a <> 'table' THEN chr(10) || '</table>' ELSE '' END
  ELSE '<p>' || e || '</p>' END, chr(10) ORDER BY block_no)) AS digest FROM t GROUP BY doc_id""")
def render_html(spark: SparkSession, d: str) -> DataFrame:
    return fl.render_html(dv.blocks(table(spark, d, "documents"))).select("doc_id", F.md5("rendered").alias("digest"))


@query("render_markdown")
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    """fn_markdown_inline has the oracle of the escapes; tests hold lists and tables."""
    return fl.render_markdown(dv.blocks(table(spark, d, "documents")))


@query("render_chapters", "WITH " + dv.BLOCKS_SQL + """ SELECT doc_id, page, coalesce(arg_min(text, block_no) FILTER (size = 14 AND words > 0), left(arg_min(text, block_no) FILTER (words > 0), 40), 'Page ' || (page + 1)) AS title FROM blocks GROUP BY doc_id, page""")
def render_chapters(spark: SparkSession, d: str) -> DataFrame:
    return fl.chapters(dv.blocks(table(spark, d, "documents")))


@query("render_contents", "WITH RECURSIVE " + dv.BLOCKS_SQL + """,
p AS (SELECT DISTINCT doc_id, page FROM blocks),
m AS (SELECT doc_id, (page + (block_no % 5 = 0)::INT)::INT AS page, block_no AS a, block_no * 7 % 4 + 1 AS l, 'Mark ' || block_no AS title FROM blocks WHERE doc_id % 3 = 0 AND words BETWEEN 4 AND 9),
b AS (SELECT m.* FROM m JOIN p USING (doc_id, page)),
h AS (SELECT doc_id, page, block_no AS a, 1 AS l, trim(text, ' ') AS title FROM blocks WHERE size = 14 AND words > 0 AND doc_id NOT IN (SELECT doc_id FROM b)),
e AS (SELECT doc_id, page, page AS a, 0 AS l, 'Page ' || (page + 1) AS title FROM p WHERE doc_id NOT IN (SELECT doc_id FROM b) AND doc_id NOT IN (SELECT doc_id FROM h)),
u AS (SELECT 'bookmarks' AS source, * FROM b UNION ALL SELECT 'headings', * FROM h UNION ALL SELECT 'pages', * FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS entry, l - min(l) OVER (PARTITION BY doc_id) AS level FROM u),
d AS (SELECT doc_id, entry, 0 AS depth FROM n WHERE entry = 1 UNION ALL SELECT n.doc_id, n.entry, least(n.level, d.depth + 1) FROM d JOIN n ON n.doc_id = d.doc_id AND n.entry = d.entry + 1)
SELECT doc_id, entry, source, page, title, depth FROM n JOIN d USING (doc_id, entry)""")
def render_contents(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with bookmarks (some lead to pages that are not there), with headings only, and with neither."""
    blocks = dv.blocks(table(spark, d, "documents"))
    marks = blocks.where("doc_id % 3 = 0 and words between 4 and 9")
    outline = marks.select("doc_id", F.col("block_no").alias("ord"), (F.col("block_no") * 7 % 4 + 1).alias("level"), F.concat(F.lit("Mark "), "block_no").alias("title"), (F.col("page") + (F.col("block_no") % 5 == 0).cast("int")).alias("page"))
    return fl.contents(blocks, outline)


@query("conversion_report", "WITH " + dv.BLOCKS_SQL + """ SELECT CASE WHEN words = 0 THEN 'blank' ELSE 'long' END AS code, page, count(*) AS count FROM blocks WHERE words = 0 OR length(text) > 400 GROUP BY ALL""")
def conversion_report(spark: SparkSession, d: str) -> DataFrame:
    b = dv.blocks(table(spark, d, "documents")).where("words = 0 or length(text) > 400")
    return fl.conversion_report(b.select(F.when(F.col("words") == 0, "blank").otherwise("long").alias("code"), "page", F.lit(1).cast("long").alias("n")))


@query("intake_validate", r"""SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown_kind' WHEN event_id % 11 = 0 THEN 'missing_title' WHEN event_id % 13 = 0 THEN 'bad_email' END AS error FROM events""")
def intake_validate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "bug").when(F.col("event_type") == "view", "suggestion").otherwise(F.col("event_type"))
    return e.select("event_id", st.first_error(kind, F.when(F.col("event_id") % 11 == 0, " ").otherwise("t"), F.when(F.col("event_id") % 13 == 0, "nobody").otherwise("a@b.example")).alias("error"))


@query("intake_burst", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, event_id, k, [t] AS log, true AS accepted FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN len(list_filter(g.log, lambda x: x > o.t - 21600)) < 2 THEN list_append(list_filter(g.log, lambda x: x > o.t - 21600), o.t) ELSE list_filter(g.log, lambda x: x > o.t - 21600) END,
    len(list_filter(g.log, lambda x: x > o.t - 21600)) < 2 FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
SELECT user_id, event_id, accepted FROM g""")
def intake_burst(spark: SparkSession, d: str) -> DataFrame:
    return st.burst_limit(table(spark, d, "events"), "user_id", "ts", 2, 6 * 3600)


@query("intake_daily", "SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 5 AS accepted FROM events")
def intake_daily(spark: SparkSession, d: str) -> DataFrame:
    return st.daily_cap(table(spark, d, "events"), "user_id", "ts", 5).select("event_id", "accepted")


@query("intake_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS done FROM events GROUP BY user_id")
def intake_progress(spark: SparkSession, d: str) -> DataFrame:
    return st.stream_progress(table(spark, d, "events"), "user_id")


@query("action_run", r"""SELECT doc_id, md5(source || ': ' || regexp_replace(text, 'tion', 'SION', 'gi')) AS digest FROM documents WHERE lang = 'en' AND length(text) >= 200""")
def action_run(spark: SparkSession, d: str) -> DataFrame:
    steps = [("language", {"lang": "en"}), ("min_length", {"n": 200}), ("replace", {"find": "tion", "put": "SION"}), ("prefix", {"template": "<<source>>: "})]
    return ac.run_action(table(spark, d, "documents"), steps).select("doc_id", F.md5("text").alias("digest"))


@query("action_outputs", """WITH e AS (SELECT p_partkey, left(p_name, 3) AS name, row_number() OVER (PARTITION BY left(p_name, 3) ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey AS input, name, name || ' ' || (n + 1) AS output FROM e""")
def action_outputs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("input"), F.left("p_name", F.lit(3)).alias("name"))
    return ac.batch_outputs(p, p.select("name").distinct())


BATCH = """WITH i AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 7 THEN text END AS text FROM documents),
o AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) < 200 THEN 'at_least: too short' END AS error, CASE WHEN text IS NULL OR contains(text, 'tion') THEN '' ELSE 'replace' END AS skipped FROM i),
b AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN skipped <> '' THEN 'skipped' ELSE 'ok' END AS status FROM o)"""


@query("action_batch", BATCH + " SELECT doc_id, status, skipped, error, md5(CASE WHEN error IS NULL THEN replace(text, 'tion', 'SION') ELSE text END) AS digest FROM b")
def action_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with planted failures: no text, too short ones, and an optional step that may not apply."""
    return batch(spark, d).select("doc_id", "status", "skipped", "error", F.md5("text").alias("digest"))


def batch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 7, F.col("text")).alias("text"))
    return ac.batch_run(docs, [("replace", {"find": "tion", "put": "SION"}), ("at_least", {"n": 200})], optional=("replace",))


@query("action_batch_report", BATCH + " SELECT status, error, skipped, count(*) AS n FROM b GROUP BY ALL")
def action_batch_report(spark: SparkSession, d: str) -> DataFrame:
    return ac.batch_report(batch(spark, d))
