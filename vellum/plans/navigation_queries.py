"""Queries on links, outlines, object graphs and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import navigation as nv
from ..sources import derived as dv
from .catalog import query, table

LINKS = r"""WITH RECURSIVE l0 AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hs FROM pages),
links AS (SELECT page_id, unnest(range(0, len(hs)))::INT AS link_no, unnest(hs) AS href FROM l0)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    return nv.link_inventory(table(spark, d, "pages"))


@query("nav_links", LINKS + " SELECT page_id, link_no, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'uri' WHEN regexp_matches(href, '^[/#]') THEN 'page' ELSE 'other' END AS kind FROM links")
def nav_links(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d)


@query("nav_unsafe_counts", LINKS + " SELECT page_id, count(*) AS n_links, count(*) FILTER (regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(lower(href), '^(http|https|mailto):')) AS n_unsafe FROM links GROUP BY page_id")
def nav_unsafe_counts(spark: SparkSession, d: str) -> DataFrame:
    return nv.safe_links(links(spark, d)).groupBy("page_id").agg(F.count("*").alias("n_links"), F.sum((~F.col("safe")).cast("long")).alias("n_unsafe"))


NAMES = LINKS + r""", names AS (SELECT '/' || regexp_extract(url, '^[^:]+://([^./]*)', 1) AS name, min(page_id) AS target FROM pages GROUP BY 1),
legacy AS (SELECT href AS name, max(page_id) AS target FROM links WHERE link_no = 0 GROUP BY 1)"""


def names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    host = F.concat(F.lit("/"), F.regexp_extract("url", r"^[^:]+://([^./]*)", 1))
    return table(spark, d, "pages").groupBy(host.alias("name")).agg(F.min("page_id").alias("target")), links(spark, d).where("link_no = 0").groupBy(F.col("href").alias("name")).agg(F.max("page_id").alias("target"))


@query("nav_resolve", NAMES + " SELECT page_id, link_no, href AS dest, coalesce(n.target, g.target) AS target FROM links LEFT JOIN names n ON n.name = href LEFT JOIN legacy g ON g.name = href")
def nav_resolve(spark: SparkSession, d: str) -> DataFrame:
    return nv.resolve_destinations(links(spark, d).select("page_id", "link_no", F.col("href").alias("dest")), *names(spark, d))


@query("nav_prune", NAMES + " SELECT page_id, link_no, coalesce(n.target, g.target) AS target FROM links LEFT JOIN names n ON n.name = href LEFT JOIN legacy g ON g.name = href WHERE coalesce(coalesce(n.target, g.target) % 3, 1) <> 0")
def nav_prune(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("page"))
    return nv.prune_references(nav_resolve(spark, d).select("page_id", "link_no", "target"), gone).select("page_id", "link_no", "target")


@query("nav_rename", LINKS + " SELECT page_id, link_no, CASE WHEN length(href) < 6 THEN href || '-v2' ELSE href END AS dest, length(href) < 6 AS renamed FROM links")
def nav_rename(spark: SparkSession, d: str) -> DataFrame:
    refs = links(spark, d).select("page_id", "link_no", F.col("href").alias("dest"))
    renames = refs.select(F.col("dest").alias("old")).distinct().where("length(old) < 6").withColumn("new", F.concat("old", F.lit("-v2")))
    return nv.rename_destinations(refs, renames).select("page_id", "link_no", "dest", "renamed")


OUT = "WITH RECURSIVE " + dv.BLOCKS_SQL + """, h AS (SELECT doc_id AS tree, block_no AS node, text AS title, words FROM blocks WHERE words BETWEEN 1 AND 6),
nodes AS (SELECT tree, node, title, node AS ord, CASE WHEN words <= 3 THEN NULL ELSE (SELECT max(p.node) FROM h p WHERE p.tree = h.tree AND p.node < h.node AND p.words <= 3) END AS parent FROM h),
flat AS (SELECT tree, node, title, 0 AS depth, '' AS trail FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.tree, n.node, n.title, f.depth + 1, CASE WHEN f.trail = '' THEN f.title ELSE f.trail || ' / ' || f.title END FROM nodes n JOIN flat f ON n.tree = f.tree AND n.parent = f.node)"""


def outline(spark: SparkSession, d: str) -> DataFrame:
    """Short lines as an outline: lines of up to six words below the last line of up to three."""
    from pyspark.sql import Window

    h = dv.blocks(table(spark, d, "documents")).where("words between 1 and 6").select(F.col("doc_id").alias("tree"), F.col("block_no").alias("node"), F.col("text").alias("title"), "words")
    w = Window.partitionBy("tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return h.select("tree", "node", "title", F.col("node").alias("ord"), F.when(F.col("words") > 3, F.max(F.when(F.col("words") <= 3, F.col("node"))).over(w)).alias("parent"))


@query("nav_outline", OUT + " SELECT tree, node, title, depth FROM flat")
def nav_outline(spark: SparkSession, d: str) -> DataFrame:
    return nv.flatten_outline(outline(spark, d)).select("tree", "node", "title", "depth")


@query("nav_outline_search", OUT + " SELECT tree, node, trail FROM flat WHERE contains(lower(title), 'th')")
def nav_outline_search(spark: SparkSession, d: str) -> DataFrame:
    return nv.outline_search(nv.flatten_outline(outline(spark, d)), "TH")


SPACE = "WITH RECURSIVE " + dv.BLOCKS_SQL + """, objects AS (SELECT doc_id, block_no AS obj, length(text)::BIGINT AS bytes FROM blocks),
edges AS (SELECT doc_id, obj AS src, obj * 2 + 1 AS dst FROM objects UNION ALL SELECT doc_id, obj, obj * 2 + 2 FROM objects),
roots AS (SELECT doc_id, obj, CASE obj WHEN 1 THEN 'text' WHEN 2 THEN 'images' ELSE 'fonts' END AS category, obj AS priority FROM objects WHERE obj IN (1, 2, 5)),
reach AS (SELECT doc_id, obj, category, priority FROM roots UNION SELECT e.doc_id, e.dst, r.category, r.priority FROM edges e JOIN reach r ON e.doc_id = r.doc_id AND e.src = r.obj WHERE e.dst < 2000),
best AS (SELECT doc_id, obj, min_by(category, priority) AS category FROM reach GROUP BY ALL)"""


@query("nav_space_audit", SPACE + " SELECT doc_id, coalesce(category, 'other') AS category, sum(bytes)::BIGINT AS bytes FROM objects LEFT JOIN best USING (doc_id, obj) GROUP BY ALL")
def nav_space_audit(spark: SparkSession, d: str) -> DataFrame:
    objects = dv.blocks(table(spark, d, "documents")).select("doc_id", F.col("block_no").alias("obj"), F.length("text").cast("long").alias("bytes"))
    edges = objects.select("doc_id", F.col("obj").alias("src"), F.explode(F.array(F.col("obj") * 2 + 1, F.col("obj") * 2 + 2)).alias("dst"))
    edges = edges.join(objects.select("doc_id", F.col("obj").alias("dst")), ["doc_id", "dst"], "left_semi")
    roots = objects.where("obj in (1, 2, 5)").select("doc_id", "obj", F.when(F.col("obj") == 1, "text").when(F.col("obj") == 2, "images").otherwise("fonts").alias("category"), F.col("obj").alias("priority"))
    return nv.space_audit(objects, edges, roots)


@query("nav_layers", """WITH o AS (SELECT event_id AS obj, user_id, CASE event_id % 4 WHEN 0 THEN 'AllOn' WHEN 1 THEN 'AnyOn' WHEN 2 THEN 'AnyOff' ELSE 'AllOff' END AS policy FROM events),
s AS (SELECT obj, policy, CASE WHEN obj % 5 = 0 THEN [] ELSE [user_id % 7, user_id % 5] END AS ls FROM o)
SELECT obj, CASE WHEN len(ls) = 0 THEN true ELSE CASE policy WHEN 'AllOn' THEN len(list_filter(ls, lambda x: x % 3 = 0)) = 0 WHEN 'AnyOn' THEN len(list_filter(ls, lambda x: x % 3 <> 0)) > 0
  WHEN 'AnyOff' THEN len(list_filter(ls, lambda x: x % 3 = 0)) > 0 ELSE len(list_filter(ls, lambda x: x % 3 <> 0)) = 0 END END AS visible FROM s""")
def nav_layers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    layers = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("user_id") % 7, F.col("user_id") % 5))
    policy = F.element_at(F.array(*map(F.lit, ("AllOn", "AnyOn", "AnyOff", "AllOff"))), (F.col("event_id") % 4 + 1).cast("int"))
    states = e.select((F.col("user_id") % 7).alias("layer")).unionByName(e.select((F.col("user_id") % 5).alias("layer"))).distinct().withColumn("shown", F.col("layer") % 3 != 0)
    return nv.visible(e.select(F.col("event_id").alias("obj"), layers.alias("layers"), policy.alias("policy")), states).select("obj", "visible")


@query("nav_polylines", """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT vec_id, unnest(range(0, 32)) AS i, e FROM p), xy AS (SELECT vec_id, i, e[2 * i + 1] AS x, e[2 * i + 2] AS y, e[(2 * i + 2) % 64 + 1] AS x2, e[(2 * i + 3) % 64 + 1] AS y2 FROM q)
SELECT vec_id, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) FILTER (i < 31), 6) AS length, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 6) AS perimeter, round(abs(sum(x * y2 - x2 * y)) / 2, 6) AS area FROM xy GROUP BY vec_id""")
def nav_polylines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", *(F.round(c, 6).alias(k) for k, c in nv.polyline(F.col("embedding")).items()))


SEGS = """WITH s AS (SELECT vec_id AS tree, unnest(range(0, 16))::INT AS seg, embedding::DOUBLE[] AS e FROM embeddings),
segs AS (SELECT tree, seg, e[4 * seg + 1] AS x0, e[4 * seg + 2] AS y0, e[4 * seg + 3] AS x1, e[4 * seg + 4] AS y1 FROM s)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.get("embedding", 4 * F.col("seg") + k).cast("double")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("seg"), "embedding").select("tree", "seg", at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))


CROSSINGS = SEGS + """, p AS (SELECT a.tree, a.seg AS a, b.seg AS b, a.x0, a.y0, a.x1 - a.x0 AS ax, a.y1 - a.y0 AS ay, b.x1 - b.x0 AS bx, b.y1 - b.y0 AS "by", b.x0 - a.x0 AS wx, b.y0 - a.y0 AS wy FROM segs a JOIN segs b ON a.tree = b.tree AND a.seg < b.seg),
d AS (SELECT *, ax * "by" - ay * bx AS turn FROM p WHERE abs(ax * "by" - ay * bx) >= 1e-9), tu AS (SELECT *, (wx * "by" - wy * bx) / turn AS t, (wx * ay - wy * ax) / turn AS u FROM d),
crossings AS (SELECT tree, a, b, x0 + t * ax AS x, y0 + t * ay AS y FROM tu WHERE t BETWEEN -1e-6 AND 1 + 1e-6 AND u BETWEEN -1e-6 AND 1 + 1e-6 AND NOT ((t <= 1e-6 OR t >= 1 - 1e-6) AND (u <= 1e-6 OR u >= 1 - 1e-6)))"""


@query("nav_crossings", CROSSINGS + " SELECT tree, a, b FROM crossings")
def nav_crossings(spark: SparkSession, d: str) -> DataFrame:
    return nv.segment_crossings(segments(spark, d), 0.1).select("tree", "a", "b")


@query("nav_crossing_points", CROSSINGS + " SELECT DISTINCT tree, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y FROM crossings")
def nav_crossing_points(spark: SparkSession, d: str) -> DataFrame:
    """Each drawing's own grid."""
    return nv.crossing_points(nv.segment_crossings(segments(spark, d)))


@query("nav_snap", SEGS + """, pts AS (SELECT tree, seg AS point, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM segs), c AS (SELECT tree, seg AS cand, 1 AS priority, x0 AS cx, y0 AS cy FROM segs),
n AS (SELECT p.tree, p.point, c.cand, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS far FROM pts p JOIN c USING (tree)),
b AS (SELECT tree, point, arg_min(cand, far) AS target FROM n WHERE far <= 0.05 GROUP BY ALL) SELECT tree, point, target FROM pts LEFT JOIN b USING (tree, point)""")
def nav_snap(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    points = s.select("tree", F.col("seg").alias("point"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return nv.snap_points(points, s.select("tree", F.col("seg").alias("cand"), F.lit(1).alias("priority"), F.col("x0").alias("cx"), F.col("y0").alias("cy")), 0.05).select("tree", "point", "target")


@query("nav_fonts", "WITH " + dv.BLOCKS_SQL + """, f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'ABCDEF+' ELSE '' END || 'Serif' || words % 5 AS font, page FROM blocks)
SELECT font, list_sort(list(DISTINCT page))[:50]::VARCHAR AS pages, starts_with(font, 'ABCDEF+') AS subset FROM f GROUP BY font""")
def nav_fonts(spark: SparkSession, d: str) -> DataFrame:
    font = F.concat(F.when(F.col("doc_id") % 2 == 0, "ABCDEF+").otherwise(""), F.lit("Serif"), F.col("words") % 5)
    return nv.font_inventory(dv.blocks(table(spark, d, "documents")).select(font.alias("font"), "page")).withColumn("pages", F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]")))


@query("nav_sweep", """SELECT event_type AS op, 'E' || (event_id % 5) AS error, count(*) AS files, min(event_id) AS first_file FROM events WHERE event_id % 3 = 0 GROUP BY ALL""")
def nav_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("file"), F.col("event_type").alias("op"), F.when(F.col("event_id") % 3 == 0, "crash").otherwise("ok").alias("status"), F.concat(F.lit("E"), F.col("event_id") % 5).alias("error"))
    return nv.sweep_summary(e)


@query("nav_sweep_places", """SELECT event_type AS op, 'E' || (event_id % 5) AS error, 'line ' || event_id % 7 AS "at", count(DISTINCT user_id) AS files, min(user_id) AS first_file FROM events WHERE event_id % 3 = 0 GROUP BY ALL""")
def nav_sweep_places(spark: SparkSession, d: str) -> DataFrame:
    """Crashes of one file at one place count once."""
    return nv.sweep_summary(sweep_results(spark, d))


@query("nav_sweep_outcomes", """SELECT event_type AS op, count(*) FILTER (event_id % 3 = 1) AS ok, count(*) FILTER (event_id % 3 = 2) AS refused, count(*) FILTER (event_id % 3 = 0) AS crash FROM events GROUP BY 1""")
def nav_sweep_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return nv.sweep_outcomes(sweep_results(spark, d))


def sweep_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    error = F.when(k == 0, F.concat(F.lit("E"), F.col("event_id") % 5, F.lit(": event "), "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("op"), F.when(k == 0, "crash").when(k == 1, "ok").otherwise("refused").alias("status"), error.alias("error"), F.concat(F.lit("line "), F.col("event_id") % 7).alias("at"))


@query("nav_recent", "SELECT user_id, max(event_id) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY user_id, m ORDER BY m DESC, max(event_id) DESC LIMIT 20")
def nav_recent(spark: SparkSession, d: str) -> DataFrame:
    return nv.recent(table(spark, d, "events"), 20).select("user_id", "event_id")


@query("nav_positions", "SELECT user_id, max(event_id) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY user_id, m ORDER BY m DESC, max(event_id) DESC LIMIT 200")
def nav_positions(spark: SparkSession, d: str) -> DataFrame:
    return nv.recent(table(spark, d, "events"), 200).select("user_id", "event_id")


@query("nav_titles", r"""WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS m, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS h FROM pages),
f AS (SELECT *, m <> '' AND NOT regexp_matches(m, '(?i)\.(docx?|pdf|tmp|html?)$|^untitled') AS ok FROM t)
SELECT page_id, left(CASE WHEN ok THEN m WHEN h <> '' THEN h ELSE regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) END, 120) AS title, CASE WHEN ok THEN 'meta' WHEN h <> '' THEN 'heading' ELSE 'url' END AS source FROM f""")
def nav_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", nv.title_of(F.col("html"), F.col("url")).alias("t")).select("page_id", "t.title", "t.source")
