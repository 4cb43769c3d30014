"""Queries on review comments and on versions of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as cp
from ..operators import review as rv
from ..sources import derived as dv
from ..sources import interchange as ix
from .catalog import query, table

C = "WITH RECURSIVE " + dv.COMMENTS_SQL
T = C + """, own AS (SELECT * FROM comments WHERE NOT is_status),
threads AS (
  SELECT o.*, o.name AS root, 0 AS depth FROM own o WHERE NOT EXISTS (SELECT 1 FROM own p WHERE p.doc_id = o.doc_id AND p.name = o.parent)
  UNION ALL SELECT o.*, t.root, t.depth + 1 FROM own o JOIN threads t ON o.doc_id = t.doc_id AND o.parent = t.name)"""


def comments(spark: SparkSession, d: str) -> DataFrame:
    return dv.comments(table(spark, d, "conversations"))


@query("review_threads", T + " SELECT doc_id, name, root, depth FROM threads")
def review_threads(spark: SparkSession, d: str) -> DataFrame:
    return rv.threads(comments(spark, d)).select("doc_id", "name", "root", "depth")


@query("review_thread_texts", T + " SELECT doc_id, root, count(*) - 1 AS replies, string_agg(contents, chr(10) ORDER BY idx) AS thread_text FROM threads GROUP BY ALL")
def review_thread_texts(spark: SparkSession, d: str) -> DataFrame:
    return rv.thread_texts(rv.threads(comments(spark, d)))


@query("review_latest_status", C + " SELECT doc_id, parent, max_by(contents, idx) AS state, max_by(author, idx) AS author FROM comments WHERE is_status GROUP BY ALL")
def review_latest_status(spark: SparkSession, d: str) -> DataFrame:
    return rv.latest_status(comments(spark, d).where("is_status"))


@query("review_filter", T + """, texts AS (SELECT doc_id, root AS name, string_agg(contents, chr(10) ORDER BY idx) AS t FROM threads GROUP BY ALL)
SELECT r.doc_id, r.name FROM threads r JOIN texts USING (doc_id, name) WHERE depth = 0 AND author = 'user' AND contains(lower(t), 'the') AND contains(lower(t), 'an')""")
def review_filter(spark: SparkSession, d: str) -> DataFrame:
    return rv.review_filter(rv.threads(comments(spark, d)), "the AN", "user").select("doc_id", "name")


@query("review_filter_all", T + """, s AS (SELECT doc_id, parent AS name, CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS state FROM comments WHERE idx % 5 = 1),
texts AS (SELECT doc_id, root AS name, string_agg(contents, chr(10) ORDER BY idx) AS t FROM threads GROUP BY ALL)
SELECT r.doc_id, r.name FROM threads r JOIN texts USING (doc_id, name) LEFT JOIN s USING (doc_id, name)
WHERE depth = 0 AND r.doc_id % 3 <> 0 AND idx % 2 = 0 AND coalesce(state, 'none') = 'accepted' AND (contains(lower(t), 'the') OR contains(lower(author), 'the') OR r.doc_id % 4 = 0)""")
def review_filter_all(spark: SparkSession, d: str) -> DataFrame:
    """By kind, mark, state and a term that a quote may hold; the first answer to a comment sets its state."""
    c = comments(spark, d)
    t = rv.threads(c).withColumns({"kind": F.when(F.col("doc_id") % 3 == 0, "note").otherwise("highlight"), "marked": F.col("idx") % 2 == 0, "quote": F.when(F.col("doc_id") % 4 == 0, "Over THE quoted words")})
    status = c.where("idx % 5 = 1").withColumn("contents", F.when(F.col("doc_id") % 2 == 0, "accepted").otherwise("rejected"))
    return rv.review_filter(t, "the", kind="highlight", state="accepted", marked=True, status=status).select("doc_id", "name")


@query("review_newest", C + " SELECT doc_id, name FROM comments ORDER BY minute DESC, doc_id, page, idx LIMIT 200")
def review_newest(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).orderBy(*rv.sort_keys("newest")).limit(200).select("doc_id", "name")


@query("review_summary", T + """, s AS (SELECT doc_id, page, count(*) FILTER (depth = 0) AS comments, count(*) FILTER (depth > 0) AS replies FROM threads GROUP BY ALL)
SELECT *, (sum(comments) OVER (PARTITION BY doc_id ORDER BY page) - comments + 1)::BIGINT AS first_number FROM s""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return rv.comment_summary(rv.threads(comments(spark, d)))


@query("review_import", C + """, a AS (SELECT * FROM comments WHERE idx % 3 <> 1), b AS (SELECT * FROM comments WHERE idx % 3 <> 2 AND page BETWEEN 0 AND 1),
u AS (SELECT *, false AS imported FROM a UNION ALL SELECT *, true FROM b WHERE (doc_id, name) NOT IN (SELECT doc_id, name FROM a))
SELECT doc_id, name, CASE WHEN EXISTS (SELECT 1 FROM u p WHERE p.doc_id = u.doc_id AND p.name = u.parent) THEN parent END AS parent, imported FROM u""")
def review_import(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d)
    return rv.import_comments(c.where("idx % 3 <> 1"), c.where("idx % 3 <> 2"), 2).select("doc_id", "name", "parent", "imported")


@query("review_compare", C + """, b AS (SELECT * FROM comments WHERE idx % 6 <> 5 OR idx < 4)
SELECT doc_id, name, 'removed' AS change, '' AS fields FROM comments WHERE NOT (idx % 6 <> 5 OR idx < 4)
UNION ALL SELECT doc_id, name, CASE WHEN idx % 4 = 1 THEN 'changed' ELSE 'unchanged' END, CASE WHEN idx % 4 = 1 THEN 'contents' ELSE '' END FROM b
UNION ALL SELECT conv_id, conv_id || '-new', 'added', '' FROM (SELECT DISTINCT conv_id FROM conversations)""")
def review_compare(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d)
    kept = c.where("idx % 6 <> 5 or idx < 4").withColumn("contents", F.when(F.col("idx") % 4 == 1, F.concat("contents", F.lit("!"))).otherwise(F.col("contents")))
    new = c.where("idx = 0").withColumns({"name": F.concat("doc_id", F.lit("-new")), "contents": F.lit(""), "page": F.lit(99)})
    return rv.compare_comments(c, kept.unionByName(new))


@query("review_edits", C + """, gone AS (SELECT doc_id, name FROM comments WHERE idx = 3 UNION SELECT c.doc_id, c.name FROM comments c JOIN gone g ON c.doc_id = g.doc_id AND c.parent = g.name)
SELECT doc_id, name, CASE WHEN idx = 1 THEN 'edited' ELSE contents END AS contents FROM comments WHERE (doc_id, name) NOT IN (FROM gone)
UNION ALL SELECT DISTINCT doc_id, doc_id || '-own', 'added' FROM comments""")
def review_edits(spark: SparkSession, d: str) -> DataFrame:
    c = comments(spark, d)
    edit = lambda rows, action, text: rows.select("doc_id", "name", F.lit(action).alias("action"), F.lit(text).alias("contents"))
    adds = c.select("doc_id", F.concat("doc_id", F.lit("-own")).alias("name")).distinct()
    edits = edit(c.where("idx = 1"), "update", "edited").unionByName(edit(c.where("idx = 3"), "delete", None)).unionByName(edit(adds, "add", "added"))
    return rv.apply_edits(c, edits).select("doc_id", "name", "contents")


EDITED = r"""ew AS (SELECT doc_id, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM documents WHERE text IS NOT NULL),
eu AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM ew),
ek AS (SELECT doc_id, string_agg(CASE WHEN i % 7 = 0 THEN translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE w END, ' ' ORDER BY i) AS body, min_by(w, i) AS head FROM eu WHERE i % 11 <> 0 GROUP BY doc_id),
edited AS (SELECT d.doc_id, CASE WHEN d.doc_id % 13 = 0 THEN head || ' ' || body ELSE coalesce(body, '') END AS text FROM ew d LEFT JOIN ek USING (doc_id))"""


@query("compare_edited", "WITH " + EDITED + " SELECT doc_id, md5(text) AS digest FROM edited")
def compare_edited(spark: SparkSession, d: str) -> DataFrame:
    return cp.edited(table(spark, d, "documents").where("text is not null")).select("doc_id", F.md5("text").alias("digest"))


@query("compare_revisions", "WITH " + dv.PAGES_SQL + """, b AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN text || '!' ELSE text END AS text FROM doc_pages WHERE page < 3 UNION ALL SELECT doc_id, 100, 'new' FROM doc_pages WHERE page = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page)::INT AS page, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' ELSE 'content' END AS kind
FROM doc_pages a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.text IS DISTINCT FROM b.text""")
def compare_revisions(spark: SparkSession, d: str) -> DataFrame:
    p = dv.doc_pages(table(spark, d, "documents"))
    after = p.where("page < 3").withColumn("text", F.when((F.col("doc_id") + F.col("page")) % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return cp.revision_changes(p, after.unionByName(p.where("page = 0").select("doc_id", F.lit(100).alias("page"), F.lit("new").alias("text"))))


@query("compare_word_diff")
def compare_word_diff(spark: SparkSession, d: str) -> DataFrame:
    """The alignment is ordered, so tests hold it against a round trip instead of SQL."""
    docs = table(spark, d, "documents").where("text is not null")
    words = lambda t: t.select("doc_id", F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "").alias("words"))
    return cp.word_diff(words(docs), words(cp.edited(docs)))


@query("compare_numbered_diff", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(ws) || ':' || unnest(range(1, len(ws) + 1)) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
e AS (SELECT *, CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE w END AS v FROM u),
c AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e WHERE v IS DISTINCT FROM w),
g AS (SELECT doc_id, k, min(i) AS i, string_agg(w, ' ' ORDER BY i) AS removed, coalesce(string_agg(v, ' ' ORDER BY i), '') AS inserted FROM c GROUP BY doc_id, k)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS change_no, CASE WHEN inserted = '' THEN 'deleted' ELSE 'replaced' END AS kind, removed, inserted FROM g""")
def compare_numbered_diff(spark: SparkSession, d: str) -> DataFrame:
    """Words that carry their number are found once, so the changes are known beforehand: all pairs of whole documents."""
    words = F.transform(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""), lambda w, i: F.concat(w, F.lit(":"), (i + 1).cast("string")))
    old = table(spark, d, "documents").where("text is not null").select("doc_id", words.alias("words"))
    capital = lambda w: F.translate(w, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    new = F.filter(F.transform("words", lambda w, i: F.when((i + 1) % 11 == 0, "").when((i + 1) % 7 == 0, capital(w)).otherwise(w)), lambda w: w != "")
    return cp.word_diff(old, old.select("doc_id", new.alias("words")))


@query("compare_grouped_changes", "WITH " + dv.TOKENS_SQL + """, s AS (SELECT *, CASE WHEN pos % 11 IN (9, 10) THEN -1 WHEN pos % 7 = 6 THEN 1 ELSE 0 END AS side FROM tokens),
m AS (SELECT *, CASE WHEN side <> 0 AND coalesce(lag(side) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st FROM s WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos, side)),
k AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY pos, side) AS k FROM m),
g AS (SELECT doc_id, page, k, min(pos) AS pos, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (side = -1), '') AS removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (side = 1), '') AS inserted FROM k WHERE side <> 0 GROUP BY ALL)
SELECT doc_id, page, pos, CASE WHEN removed <> '' AND inserted <> '' THEN 'replaced' WHEN removed <> '' THEN 'deleted' ELSE 'inserted' END AS kind, removed, inserted FROM g""")
def compare_grouped_changes(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tokens(dv.doc_pages(table(spark, d, "documents")))
    return cp.group_changes(t.withColumn("side", F.when((F.col("pos") % 11).isin(9, 10), -1).when(F.col("pos") % 7 == 6, 1).otherwise(0)))


@query("compare_change_counts", "WITH " + dv.TOKENS_SQL + """, s AS (SELECT *, CASE WHEN pos % 11 IN (9, 10) THEN -1 WHEN pos % 7 = 6 THEN 1 ELSE 0 END AS side FROM tokens),
m AS (SELECT *, CASE WHEN side <> 0 AND coalesce(lag(side) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st FROM s WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos, side)),
k AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY pos, side) AS k FROM m),
g AS (SELECT doc_id, page, k, bool_or(side = -1) AS r, bool_or(side = 1) AS i FROM k WHERE side <> 0 GROUP BY ALL)
SELECT CASE WHEN r AND i THEN 'replaced' WHEN r THEN 'deleted' ELSE 'inserted' END AS kind, count(*) AS n FROM g GROUP BY 1""")
def compare_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return compare_grouped_changes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("compare_page_votes", "WITH " + dv.TOKENS_SQL + """, o AS (SELECT doc_id, key, min(page) AS old_page FROM tokens GROUP BY ALL HAVING min(page) = max(page)),
n AS (SELECT doc_id, key, (min(page) + 1)::INT AS new_page FROM tokens WHERE pos % 5 <> 0 GROUP BY ALL HAVING min(page) = max(page))
SELECT doc_id, old_page, new_page, count(*) AS votes FROM o JOIN n USING (doc_id, key) GROUP BY ALL""")
def compare_page_votes(spark: SparkSession, d: str) -> DataFrame:
    pages = dv.doc_pages(table(spark, d, "documents"))
    return cp.page_votes(dv.page_keys(pages), dv.page_keys(pages, 5).withColumn("page", F.col("page") + 1))


@query("compare_page_pairs")
def compare_page_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Greedy in page order; tests hold it against a plain loop."""
    return cp.pair_pages(compare_page_votes(spark, d))


@query("compare_page_alignment", "WITH " + dv.TOKENS_SQL + """, o AS (SELECT doc_id, key, min(page) AS old_page FROM tokens GROUP BY ALL HAVING min(page) = max(page)),
n AS (SELECT doc_id, key, (min(page) + 1)::INT AS new_page FROM tokens WHERE pos % 5 <> 0 GROUP BY ALL HAVING min(page) = max(page)),
pairs AS (SELECT DISTINCT doc_id, old_page, new_page FROM o JOIN n USING (doc_id, key)),
pages AS (SELECT doc_id, page, regexp_matches(text, '[^ \\t-\\r]') AND doc_id % 4 <> 0 AS has_text FROM doc_pages),
a AS (SELECT doc_id, page AS old_page, has_text FROM pages WHERE (doc_id, page) NOT IN (SELECT doc_id, old_page FROM pairs)),
b AS (SELECT doc_id, (page + 1)::INT AS new_page, has_text FROM pages WHERE (doc_id, page + 1) NOT IN (SELECT doc_id, new_page FROM pairs))
SELECT *, 'words' AS how FROM pairs UNION ALL
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, old_page, new_page, CASE WHEN new_page IS NULL THEN 'removed' WHEN old_page IS NULL THEN 'added' ELSE 'position' END
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND old_page = new_page AND NOT a.has_text AND NOT b.has_text""")
def compare_page_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose new version has a page before the others. Words that one page alone holds lead to one page only, so each vote is a pair."""
    pages = dv.doc_pages(table(spark, d, "documents")).select("doc_id", "page", (F.col("text").rlike(r"[^ \t-\r]") & (F.col("doc_id") % 4 != 0)).alias("has_text"))
    return cp.align_pages(compare_page_pairs(spark, d), pages, pages.withColumn("page", F.col("page") + 1))


@query("compare_coverage", "WITH " + dv.TOKENS_SQL + """, a AS (SELECT doc_id, key, count(*) AS a FROM tokens GROUP BY ALL), b AS (SELECT doc_id, key, count(*) AS b FROM tokens WHERE pos % 9 <> 4 GROUP BY ALL)
SELECT doc_id, sum(a)::BIGINT AS n_source, sum(least(a, coalesce(b, 0)))::BIGINT AS n_covered FROM a LEFT JOIN b USING (doc_id, key) GROUP BY doc_id""")
def compare_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tokens(dv.doc_pages(table(spark, d, "documents"))).select("doc_id", "pos", "key")
    return cp.word_coverage(t, t.where("pos % 9 <> 4"))


@query("compare_missing", "WITH " + dv.TOKENS_SQL + """, a AS (SELECT doc_id, key, count(*) AS a FROM tokens GROUP BY ALL), b AS (SELECT doc_id, key, count(*) AS b FROM tokens WHERE pos % 9 <> 4 GROUP BY ALL)
SELECT doc_id, key, (a - coalesce(b, 0))::BIGINT AS n_missing FROM a LEFT JOIN b USING (doc_id, key) WHERE a > coalesce(b, 0)""")
def compare_missing(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tokens(dv.doc_pages(table(spark, d, "documents"))).select("doc_id", "pos", "key")
    return cp.missing_words(t, t.where("pos % 9 <> 4"))


@query("compare_multiset_diff", "WITH " + dv.TOKENS_SQL + """
SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, key FROM tokens EXCEPT ALL SELECT doc_id, key FROM tokens WHERE pos % 9 <> 4) GROUP BY ALL""")
def compare_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tokens(dv.doc_pages(table(spark, d, "documents")))
    return t.select("doc_id", "key").exceptAll(t.where("pos % 9 <> 4").select("doc_id", "key")).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@query("corpus_vocabulary", "WITH " + dv.LINES_SQL + r""", w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:-[A-Za-z]+)*')) AS w FROM doc_lines)
SELECT word, count(*) AS n FROM (SELECT w AS word FROM w UNION ALL SELECT unnest(string_split(w, '-')) FROM w WHERE contains(w, '-')) GROUP BY word""")
def corpus_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Word counts; hyphenated words count their parts too."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+(?:-[A-Za-z]+)*)"), F.lit(1))
    each = dv.doc_lines(table(spark, d, "documents")).select(F.explode(words).alias("w"))
    return each.select(F.explode(F.when(F.col("w").contains("-"), F.concat(F.array("w"), F.split("w", "-"))).otherwise(F.array("w"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("comments_interchange", C + """, k AS (SELECT *, ['Text', 'Square', 'Highlight', 'Link', 'FreeText'][1 + (doc_id % 5)::INT] AS subtype, (doc_id % 512)::INT AS f FROM comments)
SELECT doc_id, page, subtype, CASE WHEN idx % 2 = 0 THEN name ELSE 'c-' || page || '-' || idx END AS name, parent, CASE WHEN parent IS NOT NULL THEN CASE WHEN idx % 3 = 0 THEN 'Group' ELSE 'R' END END AS reply,
  CASE WHEN f = 0 THEN 4 ELSE f END AS flags, least(idx, 5)::DOUBLE AS x0, greatest(idx, 5)::DOUBLE AS x1, (doc_id % 256)::INT AS red, CASE WHEN idx % 4 = 0 THEN NULL ELSE least(1.0, (idx % 4) / 2.0)::DOUBLE END AS opacity,
  author, nullif(regexp_replace(contents, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '') AS contents FROM k WHERE subtype <> 'Link'""")
def comments_interchange(spark: SparkSession, d: str) -> DataFrame:
    """All comments as XML elements and back: subtypes (one without an element), flags, boxes, colours, opacities, names and replies."""
    c = comments(spark, d)
    subtype = F.element_at(F.array(*map(F.lit, ("Text", "Square", "Highlight", "Link", "FreeText"))), (F.col("doc_id") % 5 + 1).cast("int"))
    x = F.col("idx").cast("double")
    more = {"subtype": subtype, "rect": F.array(x, F.lit(20.0), F.lit(5.0), F.lit(10.0)), "flags": (F.col("doc_id") % 512).cast("int"), "color": F.array((F.col("doc_id") % 256) / 255, F.lit(0.0), F.lit(1.0)),
            "opacity": F.when(F.col("idx") % 4 != 0, F.col("idx") % 4 / 2), "name": F.when(F.col("idx") % 2 == 0, F.col("name")), "reply": F.when(F.col("idx") % 3 == 0, "Group").otherwise("R")}
    back = ix.from_elements(ix.elements(c.withColumns(more), "c"))
    red = F.round(F.get("color", F.lit(0)) * 255).cast("int")
    return back.select("doc_id", "page", "subtype", "name", "parent", "reply", "flags", F.get("rect", F.lit(0)).alias("x0"), F.get("rect", F.lit(2)).alias("x1"), red.alias("red"), "opacity", "author", "contents")
