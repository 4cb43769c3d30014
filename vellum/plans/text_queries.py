"""Queries on scalar functions, search and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import search as sc
from ..sources import derived as dv
from .catalog import query, table


@query("fn_make_number", """
SELECT l_orderkey, l_linenumber,
  round(l_extendedprice, 2)::DOUBLE AS plain, -round(l_quantity, 2)::DOUBLE AS negative, round(l_tax, 2)::DOUBLE AS comma, NULL::DOUBLE AS none
FROM lineitem""")  # fmt: skip
def fn_make_number(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.make_number(F.concat(F.lit("$"), F.format_number(price, 2))).alias("plain"), fn.make_number(F.concat(F.lit("("), F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit(")"))).alias("negative"),
        fn.make_number(F.replace(F.col("l_tax").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), 3).alias("comma"), fn.make_number(F.lit("abc")).alias("none"))


@query("fn_format_number", """
WITH n AS (SELECT l_orderkey, l_linenumber, (l_extendedprice::DECIMAL(18,2)) AS p, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_extendedprice)::DECIMAL(18,2) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, '$' || format('{:,}', trunc(p)::BIGINT) || '.' || lpad((((p * 100)::BIGINT) % 100)::VARCHAR, 2, '0') AS dollars,
  CASE WHEN s < 0 THEN '(' ELSE '' END || replace(format('{:,}', trunc(abs(s))::BIGINT), ',', '.') || ',' || lpad((((abs(s) * 100)::BIGINT) % 100)::VARCHAR, 2, '0') || '€' || CASE WHEN s < 0 THEN ')' ELSE '' END AS euros,
  (l_linenumber * 100)::VARCHAR || '%' AS percent FROM n""")  # fmt: skip
def fn_format_number(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_extendedprice").cast("decimal(18,2)")
    s = (F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) * p).cast("decimal(18,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.format_number(p, 2, 0, 0, "$").alias("dollars"), fn.format_number(s, 2, 2, 2, "€", False).alias("euros"), fn.format_percent(F.col("l_linenumber").cast("decimal(10,0)"), 0, 1).alias("percent"))


@query("fn_dates", """
SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS iso, o_orderdate::DATE::VARCHAR AS slashed, o_orderdate::DATE::VARCHAR AS named, NULL::VARCHAR AS bad FROM orders""")
def fn_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", fn.parse_date(day.cast("string")).cast("string").alias("iso"), fn.parse_date(F.date_format(day, "M/d/yy")).cast("string").alias("slashed"), fn.parse_date(F.date_format(day, "MMMM d, yyyy")).cast("string").alias("named"),
                                            fn.parse_date(F.concat(F.lit("13/45/"), F.date_format(day, "yyyy"))).cast("string").alias("bad"))


@query("fn_times", """
SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS full_time, (hour(ts) * 3600 + minute(ts) * 60)::INT AS short_time, NULL::INT AS bad FROM events""")
def fn_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", fn.parse_time(F.date_format("ts", "HH:mm:ss")).alias("full_time"), fn.parse_time(F.date_format("ts", "h:mm a")).alias("short_time"), fn.parse_time(F.concat(F.lit("25:"), F.date_format("ts", "mm"))).alias("bad"))


@query("fn_special", r"""
WITH c AS (SELECT c_custkey, '555' || lpad(c_custkey::VARCHAR, 7, '0') AS dg FROM customer)
SELECT c_custkey, substr(dg, 1, 5) AS zip, substr(dg, 1, 5) || CASE WHEN length(dg) > 5 THEN '-' || substr(dg, 6, 4) ELSE '' END AS zip4,
  CASE WHEN length(dg) >= 9 THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 2) || '-' || substr(dg, 6, 4) ELSE dg END AS ssn,
  CASE WHEN length(dg) >= 10 THEN '(' || substr(dg, 1, 3) || ') ' || substr(dg, 4, 3) || '-' || substr(dg, 7, 4) WHEN length(dg) >= 7 THEN substr(dg, 1, 3) || '-' || substr(dg, 4, 4) ELSE dg END AS phone,
  length(dg) IN (0, 7, 10) AS ok FROM c""")  # fmt: skip
def fn_special(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    p = F.concat(F.lit("555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    digits = F.substring(F.regexp_replace(p, r"\D", ""), 1, 10)
    return c.select("c_custkey", fn.format_special(p, "zip").alias("zip"), fn.format_special(p, "zip4").alias("zip4"), fn.format_special(p, "ssn").alias("ssn"), fn.format_special(F.when(F.length(digits) >= 10, digits).when(F.length(digits) >= 7, F.substring(digits, 1, 7)).otherwise(digits), "phone").alias("phone"), fn.special_valid(p, "phone").alias("ok"))


@query("fn_range_check", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'must be less than or equal to 40' END AS high, CASE WHEN l_quantity < 10 THEN 'must be greater than or equal to 10' END AS low,
  CASE WHEN l_quantity NOT BETWEEN 10 AND 40 THEN 'must be between 10 and 40' END AS band, 'not a number' AS bad FROM lineitem""")  # fmt: skip
def fn_range_check(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("decimal(18,2)").cast("string")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.range_error(q, hi=40).alias("high"), fn.range_error(q, lo=10).alias("low"), fn.range_error(q, 10, 40).alias("band"), fn.range_error(F.lit("abc"), hi=40).alias("bad"))


@query("fn_typed_cell", """
SELECT p_partkey, p_partkey::DOUBLE AS plain, NULL::DOUBLE AS padded, (p_partkey * 1000)::DOUBLE AS grouped, CASE WHEN p_partkey * 1000 >= 1000 THEN 'grouped' ELSE 'number' END AS grouped_kind, p_partkey / 100.0::DOUBLE AS percent, NULL::DOUBLE AS name FROM part""")
def fn_typed_cell(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    big, kind = fn.typed_cell(F.format_number(key * 1000, 0))
    return table(spark, d, "part").select("p_partkey", fn.typed_cell(key.cast("string"))[0].alias("plain"), fn.typed_cell(F.concat(F.lit("00"), key.cast("string")))[0].alias("padded"), big.alias("grouped"), kind.alias("grouped_kind"),
                                          fn.typed_cell(F.concat(key.cast("string"), F.lit("%")))[0].alias("percent"), fn.typed_cell(F.col("p_name"))[0].alias("name"))


@query("fn_escapes", r"""
WITH """ + dv.LINES_SQL + r"""
SELECT doc_id, line_no, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
  regexp_replace(text, '([@#])', '\1' || chr(8203), 'g') AS inert,
  regexp_extract(text, '^\s*([•●◦▪■‣⁃–*-]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])\s', 1) AS marker FROM doc_lines""")  # fmt: skip
def fn_escapes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return dv.doc_lines(table(spark, d, "documents")).select("doc_id", "line_no", fn.escape_html(t).alias("html"), fn.inert_mentions(t).alias("inert"), fn.list_marker(t).alias("marker"))


@query("fn_markdown_inline", r"""
WITH """ + dv.LINES_SQL + r"""
SELECT doc_id, line_no, CASE WHEN regexp_matches(t, '\A\s*[0-9]{1,9}[.)](\s|\z)') THEN regexp_replace(t, '\A(\s*[0-9]+)', '\1\\')
  WHEN regexp_matches(t, '\A\s*(#{1,6}(\s|\z)|[+-](\s|\z)|=+\s*\z|-{3,}\s*\z)') THEN regexp_replace(t, '\A(\s*)', '\1\\') ELSE t END AS markdown
FROM (SELECT doc_id, line_no, regexp_replace(text, '([\\`*_\[\]<>|~])', '\\\1', 'g') AS t FROM doc_lines)""")
def fn_markdown_inline(spark: SparkSession, d: str) -> DataFrame:
    return dv.doc_lines(table(spark, d, "documents")).select("doc_id", "line_no", fn.escape_markdown(F.col("text")).alias("markdown"))


@query("fn_fold_keys", r"""
WITH """ + dv.TOKENS_SQL + r"""
SELECT translate(key, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS folded, count(*) AS n, count(DISTINCT key)::BIGINT AS spellings FROM tokens GROUP BY 1""")
def fn_fold_keys(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tokens(dv.doc_pages(table(spark, d, "documents")))
    by_key = t.groupBy("key").agg(F.count("*").alias("n"))
    return by_key.groupBy(fn.fold(F.col("key")).alias("folded")).agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))


@query("fn_safe_names", r"""
SELECT p_partkey, left(trim(regexp_replace(regexp_replace(p_name || '/' || p_type, '[/\\:*?"<>|]', ' ', 'g'), ' +', ' ', 'g')), 20) AS name FROM part""")
def fn_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.safe_name(F.concat_ws("/", "p_name", "p_type"), 20).alias("name"))


@query("fn_page_labels", """
SELECT doc_id, doc_id % 40 + 1 AS n, 'A-' || (doc_id % 40 + 1) AS decimal_label, repeat(chr((97 + doc_id % 40 % 26)::INT), (doc_id % 40 // 26 + 1)::INT) AS letter_label,
  CASE WHEN doc_id % 40 = 39 THEN 'xl' ELSE repeat('x', ((doc_id % 40 + 1) // 10)::INT) END || CASE (doc_id % 40 + 1) % 10 WHEN 0 THEN '' WHEN 1 THEN 'i' WHEN 2 THEN 'ii' WHEN 3 THEN 'iii' WHEN 4 THEN 'iv' WHEN 5 THEN 'v' WHEN 6 THEN 'vi' WHEN 7 THEN 'vii' WHEN 8 THEN 'viii' ELSE 'ix' END AS roman_label
FROM documents""")  # fmt: skip
def fn_page_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 40 + 1
    return table(spark, d, "documents").select("doc_id", n.alias("n"), fn.page_label(F.lit("D"), F.lit("A-"), n).alias("decimal_label"), fn.page_label(F.lit("a"), F.lit(""), n).alias("letter_label"), fn.page_label(F.lit("r"), F.lit(None), n).alias("roman_label"))


@query("fn_json_values", """
SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)""")
def fn_json_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props is not null").select("event_id", "props", F.explode(F.json_object_keys("props")).alias("key"))
    return e.select("event_id", F.expr("get_json_object(props, '$.' || key)").alias("value"), "key")


@query("search_literal", r"""
WITH """ + dv.PAGES_SQL + r""", p AS (SELECT *, string_split(lower(text), 'the ') AS parts FROM doc_pages)
SELECT doc_id, page, i::INT AS hit_no, (list_sum(list_transform(parts[1:i + 1], lambda x: length(x))) + 4 * i)::INT AS at FROM (SELECT *, unnest(range(0, len(parts) - 1)) AS i FROM p)""")
def search_literal(spark: SparkSession, d: str) -> DataFrame:
    return sc.search(dv.doc_pages(table(spark, d, "documents")), "the ").select("doc_id", "page", "hit_no", "at")


@query("search_whole_word", r"""
WITH """ + dv.PAGES_SQL + r"""
SELECT doc_id, page, len(regexp_extract_all(regexp_replace(lower(text), '[^\pL\pN\pM_''’]+', '  ', 'g'), '(?:^| )the(?: |$)'))::BIGINT AS n FROM doc_pages WHERE n > 0""")
def search_whole_word(spark: SparkSession, d: str) -> DataFrame:
    p = dv.doc_pages(table(spark, d, "documents")).withColumn("n", F.regexp_count("text", F.lit(sc.pattern("the", whole=True))).cast("long"))
    return p.where("n > 0").select("doc_id", "page", "n")


@query("search_regex", r"""
WITH """ + dv.PAGES_SQL + r"""
SELECT doc_id, page, unnest(regexp_extract_all(text, '[a-z]+tion')) AS found FROM doc_pages""")
def search_regex(spark: SparkSession, d: str) -> DataFrame:
    return sc.search(dv.doc_pages(table(spark, d, "documents")), "[a-z]+tion", case=True, regex=True).select("doc_id", "page", "found")


@query("search_proximity", r"""
WITH """ + dv.TOKENS_SQL + r""",
a AS (SELECT * FROM tokens WHERE key = 'the'), b AS (SELECT * FROM tokens WHERE key IN ('of', 'and')),
e AS (SELECT a.doc_id, a.page, a.pos AS pos0, b.key, min(b.pos) AS pos FROM a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(b.pos - a.pos) <= 5 GROUP BY ALL)
SELECT doc_id, page, least(pos0, min(pos))::INT AS start, greatest(pos0, max(pos))::INT AS stop FROM e GROUP BY doc_id, page, pos0 HAVING count(*) = 2""")  # fmt: skip
def search_proximity(spark: SparkSession, d: str) -> DataFrame:
    return sc.proximity_search(dv.doc_pages(table(spark, d, "documents")), ["the", "of", "and"], 5)


@query("search_stems", r"""
WITH """ + dv.TOKENS_SQL + r""",
lemmas AS (SELECT DISTINCT key AS form, regexp_replace(key, '(ing|ed|er|ly)$', '') AS lemma FROM tokens),
wanted AS (SELECT lemma FROM lemmas WHERE form = 'thing' UNION SELECT 'thing'),
forms AS (SELECT form FROM lemmas WHERE lemma IN (FROM wanted) UNION FROM wanted)
SELECT doc_id, page, count(*) AS n FROM tokens WHERE key IN (FROM forms) GROUP BY ALL""")  # fmt: skip
def search_stems(spark: SparkSession, d: str) -> DataFrame:
    t = dv.tokens(dv.doc_pages(table(spark, d, "documents")))
    lemmas = t.select(F.col("key").alias("form"), F.regexp_replace("key", "(ing|ed|er|ly)$", "").alias("lemma")).distinct()
    return sc.stem_search(t, "thing", lemmas).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("search_replace", r"""
SELECT doc_id, len(regexp_extract_all(text, 'tion'))::INT AS n_replaced, replace(text, 'tion', 'SION') AS text FROM documents""")
def search_replace(spark: SparkSession, d: str) -> DataFrame:
    return sc.replace_text(table(spark, d, "documents").select("doc_id", "text"), "tion", "SION", case=True).select("doc_id", "n_replaced", "text")


@query("search_capped", r"""
WITH """ + dv.LINES_SQL + r"""
SELECT doc_id, line_no FROM doc_lines WHERE contains(text, 'tion') ORDER BY doc_id, line_no LIMIT 500""")
def search_capped(spark: SparkSession, d: str) -> DataFrame:
    return sc.capped(dv.doc_lines(table(spark, d, "documents")).where(F.col("text").contains("tion")).select("doc_id", "line_no"), ["doc_id", "line_no"])


@query("search_next_page", r"""
WITH """ + dv.LINES_SQL + r""", h AS (SELECT doc_id, line_no FROM doc_lines WHERE contains(text, 'tion') AND (doc_id, line_no) > (20, 3))
SELECT doc_id, line_no, (SELECT count(*) FROM h) <= 50 AS complete FROM h ORDER BY doc_id, line_no LIMIT 50""")
def search_next_page(spark: SparkSession, d: str) -> DataFrame:
    hits = dv.doc_lines(table(spark, d, "documents")).where(F.col("text").contains("tion")).select("doc_id", "line_no")
    return sc.search_page(hits, ["doc_id", "line_no"], (20, 3), 50)


PII_SQL = r"""
hits AS (SELECT doc_id, lang, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS found FROM documents
  UNION ALL SELECT doc_id, lang, 'ssn', unnest(regexp_extract_all(text, '\b\d{3}[- ]\d{2}[- ]\d{4}\b')) FROM documents)"""


@query("pii_find", "WITH " + PII_SQL + " SELECT doc_id, kind, found FROM hits")
def pii_find(spark: SparkSession, d: str) -> DataFrame:
    return sc.find_pii(table(spark, d, "documents").select("doc_id", "text"), ("email", "ssn"))


@query("pii_find_all")
def pii_find_all(spark: SparkSession, d: str) -> DataFrame:
    """All five kinds; lookarounds keep this one from the oracle, tests hold it against Python's regex."""
    return sc.find_pii(table(spark, d, "documents").select("doc_id", "text"))


@query("pii_mask", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '█', 'g'), '\b\d{3}[- ]\d{2}[- ]\d{4}\b', '█', 'g') AS text FROM documents""")
def pii_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sc.mask_pii(F.col("text"), ("email", "ssn")).alias("text"))


@query("pii_summary", "WITH " + PII_SQL + r"""
SELECT lang, kind, count(*) AS n_found, count(DISTINCT doc_id)::BIGINT AS n_docs, 0::BIGINT AS n_left FROM hits GROUP BY lang, kind""")
def pii_summary(spark: SparkSession, d: str) -> DataFrame:
    """Found, masked and verified, by language and kind; n_left counts what a search of the masked text still finds."""
    kinds = ("email", "ssn")
    found = table(spark, d, "documents").select("doc_id", "lang", "text", sc.pii_hits(F.col("text"), kinds).alias("hits")).where(F.size("hits") > 0)
    counted = lambda hits, n, left: F.transform(hits, lambda h: F.struct(h["kind"].alias("kind"), F.lit(n).alias("n"), F.lit(left).alias("left")))
    both = F.concat(counted(F.col("hits"), 1, 0), counted(sc.pii_hits(sc.mask_pii(F.col("text"), kinds), kinds), 0, 1))
    by = found.select("lang", "doc_id", F.explode(both).alias("h")).groupBy("lang", "h.kind", "doc_id").agg(F.sum("h.n").alias("n"), F.sum("h.left").alias("left"))
    return by.groupBy("lang", "kind").agg(F.sum("n").alias("n_found"), F.sum((F.col("n") > 0).cast("long")).alias("n_docs"), F.sum("left").alias("n_left"))


@query("verify_removed", "WITH " + dv.PAGES_SQL + r""",
m AS (SELECT doc_id, page, text, replace(text, 'the', '█') AS masked FROM doc_pages),
b AS (SELECT doc_id, page, w, count(*) AS n FROM (SELECT doc_id, page, unnest(regexp_extract_all(text, '[^ \t-\r]+')) AS w FROM m) WHERE length(w) >= 3 GROUP BY ALL),
a AS (SELECT doc_id, page, w, count(*) AS n FROM (SELECT doc_id, page, unnest(regexp_extract_all(masked, '[^ \t-\r]+')) AS w FROM m) GROUP BY ALL)
SELECT doc_id, page, count(*) AS n_words, count(*) FILTER (coalesce(a.n, 0) > b.n - CASE WHEN contains(w, 'the') THEN b.n ELSE 0 END) AS n_wrong
FROM b LEFT JOIN a USING (doc_id, page, w) GROUP BY ALL""")  # fmt: skip
def verify_removed(spark: SparkSession, d: str) -> DataFrame:
    """Per page: words of three letters or more, and those that occur more often after masking than they may."""
    pages = dv.doc_pages(table(spark, d, "documents")).withColumn("masked", F.replace("text", F.lit("the"), F.lit("█")))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"([^ \t-\r]+)"), F.lit(1))
    both = pages.select("doc_id", "page", F.explode(F.concat(F.transform(words("text"), lambda w: F.struct(w.alias("w"), F.lit(1).alias("b"), F.lit(0).alias("a"))), F.transform(words("masked"), lambda w: F.struct(w.alias("w"), F.lit(0).alias("b"), F.lit(1).alias("a"))))).alias("x"))
    by = both.groupBy("doc_id", "page", "x.w").agg(F.sum("x.b").alias("b"), F.sum("x.a").alias("a")).where("b > 0 and length(w) >= 3")
    wrong = F.col("a") > F.col("b") - F.when(F.col("w").contains("the"), F.col("b")).otherwise(0)
    return by.groupBy("doc_id", "page").agg(F.count("*").alias("n_words"), F.sum(wrong.cast("long")).alias("n_wrong"))
