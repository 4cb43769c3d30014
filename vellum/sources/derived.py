"""Relations derived from the documents and conversations: lines, pages, words, blocks, glyphs, comments.

All are narrow transformations of one row each (no shuffle); a text's parts are numbered inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES_A_PAGE = 20
#: Punctuation around a word.
OUTER = ".,;:!?()[]\"'|"


def doc_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), text."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def doc_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page (from 0), text: LINES_A_PAGE lines each."""
    lines = F.split("text", "\n", -1)
    last = F.floor((F.size(lines) - 1) / LINES_A_PAGE).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice(lines, p * LINES_A_PAGE + 1, LINES_A_PAGE), "\n"))
    return docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("page", "text"))


def token_keys(text: Column) -> Column:
    """The keys of a page's words, in order: lower case without outer punctuation, the word itself if nothing is left."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    def key(w: Column) -> Column:
        bare = F.lower(F.btrim(w, F.lit(OUTER)))
        return F.when(bare == "", w).otherwise(bare)

    return F.transform(words, key)


def page_keys(pages: DataFrame, leave_out: int = 0) -> DataFrame:
    """doc_id, page, key: each key of a page once; of its words every leave_out-th from the first does not count."""
    keys = token_keys(F.col("text"))
    kept = F.filter(keys, lambda _, k: k % leave_out != 0) if leave_out else keys
    return pages.select("doc_id", "page", F.explode(F.array_distinct(kept)).alias("key"))


def tokens(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos (from 0, by page), word, key (lower case without outer punctuation)."""
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    key = F.lower(F.btrim("word", F.lit(OUTER)))
    return pages.select("doc_id", "page", F.posexplode(words).alias("pos", "word")).withColumn("key", F.when(key == "", F.col("word")).otherwise(key))


def word_count(text: str | F.Column) -> F.Column:
    return F.regexp_count(text if isinstance(text, F.Column) else F.col(text), F.lit(r"[^ \t-\r]+"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, page, block_no (line), text, words, size (14 for up to 3 words, 12 up to 6, else 10)."""
    words = word_count("text")
    return doc_lines(docs).select("doc_id", F.floor(F.col("line_no") / LINES_A_PAGE).cast("int").alias("page"), F.col("line_no").alias("block_no"), "text", words.cast("int").alias("words"),
                                  F.when(words <= 3, 14.0).when(words <= 6, 12.0).otherwise(10.0).alias("size"))


def line_boxes(docs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text of lines that are not empty, and the box of their glyphs: rx0, ry0, rx1, ry1."""
    y0 = (F.col("line_no") % LINES_A_PAGE) * 12.0
    return doc_lines(docs).where("text <> ''").select("doc_id", F.floor(F.col("line_no") / LINES_A_PAGE).cast("int").alias("page"), "line_no", "text", F.lit(0.0).alias("rx0"), y0.alias("ry0"), (F.length("text") * 6.0).alias("rx1"), (y0 + 10).alias("ry1"))


def glyph_values(line_no: Column, glyph_no: Column) -> dict[str, Column]:
    """x0, y0, x1, y1, size of a glyph by its place."""
    x0, y0 = glyph_no * 6.0, (line_no % LINES_A_PAGE) * 12.0
    return {"x0": x0, "y0": y0, "x1": x0 + 6, "y1": y0 + 10, "size": F.lit(10.0)}


def unfolded(lines: DataFrame) -> DataFrame:
    """A row for every letter of lines (line_no, text): glyph_no, ch, x0, y0, x1, y1, size. What else a line has stays, its text and box go."""
    kept = [c for c in lines.columns if c not in ("text", "rx0", "ry0", "rx1", "ry1")]
    rows = lines.select(*kept, F.posexplode(F.split("text", "")).alias("glyph_no", "ch")).where("ch <> ''")
    return rows.select(*kept, "glyph_no", "ch", *(v.alias(k) for k, v in glyph_values(F.col("line_no"), F.col("glyph_no")).items()))


def glyphs(docs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, glyph_no, ch, x0, y0, x1, y1, size of every letter of each line."""
    return unfolded(line_boxes(docs).select("doc_id", "page", "line_no", "text"))


def line_glyphs(text: Column, line_no: Column, fields: tuple[str, ...]) -> Column:
    """The glyphs of a line as an array of these fields."""

    def glyph(ch: Column, k: Column) -> Column:
        values = glyph_values(line_no, k) | {"ch": ch}
        return F.struct(*(values[f].alias(f) for f in fields))

    return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), glyph)


def glyph_lines(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, page, line_no, glyphs: an array of a line's glyphs with these fields, made within the row."""
    return line_boxes(docs).select("doc_id", "page", "line_no", line_glyphs(F.col("text"), F.col("line_no"), fields).alias("glyphs"))


def glyph_pages(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, page, glyphs: an array of a page's glyphs with these fields, made within the row."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, k: line_glyphs(line, k, fields))
    return doc_pages(docs).select("doc_id", "page", F.flatten(lines).alias("glyphs"))


def comments(conversations: DataFrame) -> DataFrame:
    """doc_id, idx, page, name, parent, author, contents, minute, is_status of every turn as a comment in a reply chain."""
    name = F.concat_ws("-", "conv_id", "turn")
    parent = F.when(F.col("turn") > 0, F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1))
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.floor(F.col("turn") / 3).cast("int").alias("page"), name.alias("name"), parent.alias("parent"), F.col("role").alias("author"),
                                F.coalesce("text", F.lit("")).alias("contents"), F.col("turn").alias("minute"), (F.col("turn") % 5 == 4).alias("is_status"))


#: The same relations as common table expressions of the oracles.
LINES_SQL = r"""doc_lines AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"""
PAGES_SQL = LINES_SQL + r""",
doc_pages AS (SELECT doc_id, (line_no // 20)::INT AS page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM doc_lines GROUP BY ALL)"""
TOKENS_SQL = PAGES_SQL + r""",
words0 AS (SELECT doc_id, page, regexp_extract_all(text, '[^ \t-\r]+') AS ws FROM doc_pages),
words1 AS (SELECT doc_id, page, unnest(range(0, len(ws)))::INT AS pos, unnest(ws) AS word FROM words0),
words2 AS (SELECT *, lower(regexp_replace(word, '^[.,;:!?()\[\]"''|]+|[.,;:!?()\[\]"''|]+$', '', 'g')) AS k FROM words1),
tokens AS (SELECT doc_id, page, pos, word, CASE WHEN k = '' THEN word ELSE k END AS key FROM words2)"""
BLOCKS_SQL = LINES_SQL + r""",
blocks0 AS (SELECT doc_id, (line_no // 20)::INT AS page, line_no AS block_no, text, len(regexp_extract_all(text, '[^ \t-\r]+'))::INT AS words FROM doc_lines),
blocks AS (SELECT *, CASE WHEN words <= 3 THEN 14.0 WHEN words <= 6 THEN 12.0 ELSE 10.0 END::DOUBLE AS size FROM blocks0)"""
GLYPHS_SQL = LINES_SQL + r""",
glyphs0 AS (SELECT doc_id, line_no, unnest(range(0, len(string_split(text, ''))))::INT AS glyph_no, unnest(string_split(text, '')) AS ch FROM doc_lines WHERE text <> ''),
glyphs AS (
  SELECT doc_id, (line_no // 20)::INT AS page, line_no, glyph_no, ch, glyph_no * 6.0::DOUBLE AS x0, (line_no % 20) * 12.0::DOUBLE AS y0,
    glyph_no * 6.0::DOUBLE + 6 AS x1, (line_no % 20) * 12.0::DOUBLE + 10 AS y1, 10.0::DOUBLE AS size FROM glyphs0)"""
COMMENTS_SQL = r"""comments AS (
  SELECT conv_id AS doc_id, turn AS idx, (turn // 3)::INT AS page, conv_id || '-' || turn AS name, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent,
    role AS author, coalesce(text, '') AS contents, turn AS minute, turn % 5 = 4 AS is_status FROM conversations)"""
