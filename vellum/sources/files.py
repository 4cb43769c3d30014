"""Manifests, the incremental text index, comment interchange and text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LIST_MARKER, escape_html, escape_markdown, list_marker
from .derived import comments, doc_pages


def corpus_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified, bytes of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).dropDuplicates(["path"])


def text_units(documents: DataFrame, conversations: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One relation of searchable texts: unit_kind, unit_id, place, text; empty comments are left out."""
    units = doc_pages(documents).select(F.lit("page").alias("unit_kind"), F.col("doc_id").alias("unit_id"), F.col("page").cast("long").alias("place"), "text")
    if conversations is not None:
        c = comments(conversations).where("contents <> ''")
        units = units.unionByName(c.select(F.lit("comment").alias("unit_kind"), F.col("doc_id").alias("unit_id"), F.col("idx").cast("long").alias("place"), F.col("contents").alias("text")))
    if pages is not None:
        title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
        units = units.unionByName(pages.select(F.lit("title").alias("unit_kind"), F.col("page_id").alias("unit_id"), F.lit(0).cast("long").alias("place"), title.alias("text")).where("text <> ''"))
    return units


def refresh_index(index: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to keep, files to extract anew): an entry is kept only if path and modified both match; files no longer listed vanish."""
    return index.join(manifest, ["path", "modified"], "left_semi"), manifest.join(index, ["path", "modified"], "left_anti")


def write_comment_xml(rows: DataFrame, path: str) -> None:
    rows.write.format("xml").option("rootTag", "comments").option("rowTag", "comment").save(path)


def read_comment_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "comment").schema(schema).load(path)


def _pieces(blocks: DataFrame) -> DataFrame:
    """Blocks with words, as nodes: kind (table, list, heading, paragraph), before and after (the kinds beside it), bullet, body (an item's text)."""
    text = F.col("text")
    marker = list_marker(text)
    kind = F.when(text.contains(" | "), "table").when(marker != "", "list").when(F.col("size") == 14.0, "heading").otherwise("paragraph")
    bullet = F.length(marker) == 1
    w = Window.partitionBy("doc_id").orderBy("block_no")
    rows = blocks.where("words > 0").select("doc_id", "block_no", "text", kind.alias("kind"), bullet.alias("bullet"), F.regexp_replace("text", r"^\s*" + LIST_MARKER, "").alias("body"), marker.alias("marker"))
    return rows.withColumns({"before": F.coalesce(F.lag("kind").over(w), F.lit("")), "after": F.coalesce(F.lead("kind").over(w), F.lit(""))})


def _assembled(nodes: DataFrame, piece: Column, end: Column) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.concat(piece, end).alias("piece")))), lambda p: p["piece"])
    return nodes.groupBy("doc_id").agg(F.array_join(parts, "").alias("rendered"))


def render_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, rendered: headings, paragraphs, lists (items follow each other) and tables (the first row is the head), escaped."""
    n = _pieces(blocks)
    heading = F.concat(F.lit("## "), escape_markdown(F.col("text")))
    item = F.concat(F.when(F.col("bullet"), "-").when(F.col("marker").rlike(r"^\d+[.)]$"), F.col("marker")).otherwise(F.concat(F.lit("- "), escape_markdown(F.col("marker")))), F.lit(" "), escape_markdown(F.col("body")))
    cells = F.split("text", r" \| ", -1)
    row = F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_markdown), " | "), F.lit(" |"))
    head = F.when((F.col("before") != "table"), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size(cells)))).otherwise("")
    piece = F.when(F.col("kind") == "heading", heading).when(F.col("kind") == "list", item).when(F.col("kind") == "table", F.concat(row, head)).otherwise(escape_markdown(F.col("text")))
    run = F.col("kind").isin("list", "table") & (F.col("kind") == F.col("after"))
    return _assembled(n, piece, F.when(F.col("after") == "", "").when(run, "\n").otherwise("\n\n"))


def render_html(blocks: DataFrame) -> DataFrame:
    """doc_id, rendered: headings, paragraphs, lists and tables (the first row is the head), a line each, escaped."""
    n = _pieces(blocks)
    text = escape_html(F.col("text"))
    item = F.concat(F.when(F.col("before") != "list", "<ul>\n").otherwise(""), F.lit("<li>"), F.when(F.col("bullet"), escape_html(F.col("body"))).otherwise(text), F.lit("</li>"), F.when(F.col("after") != "list", "\n</ul>").otherwise(""))
    cell = F.when(F.col("before") != "table", "th").otherwise("td")
    between = F.concat(F.lit("</"), cell, F.lit("><"), cell, F.lit(">"))
    row = F.concat(F.when(F.col("before") != "table", "<table>\n").otherwise(""), F.lit("<tr><"), cell, F.lit(">"), F.replace(text, F.lit(" | "), between), F.lit("</"), cell, F.lit("></tr>"), F.when(F.col("after") != "table", "\n</table>").otherwise(""))
    wrapped = lambda tag: F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))
    piece = F.when(F.col("kind") == "heading", wrapped("h2")).when(F.col("kind") == "list", item).when(F.col("kind") == "table", row).otherwise(wrapped("p"))
    return _assembled(n, piece, F.when(F.col("after") == "", "").otherwise("\n"))


def chapters(blocks: DataFrame) -> DataFrame:
    """doc_id, page, title: a chapter per page, named after its first heading, else its first words, else its number."""
    head = F.min_by(F.when(F.col("size") == 14.0, F.col("text")), F.when((F.col("size") == 14.0) & (F.col("words") > 0), F.col("block_no")))
    first = F.min_by("text", F.when(F.col("words") > 0, F.col("block_no")))
    by = blocks.groupBy("doc_id", "page").agg(head.alias("_h"), first.alias("_f"))
    return by.select("doc_id", "page", F.coalesce("_h", F.left("_f", F.lit(40)), F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"))).alias("title"))


def contents(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, entry (from 1), source, page, title, depth (from 0): each document's table of contents.

    Its bookmarks (outline: doc_id, ord, level, title, page) that lead to a page it has, in their order; without any, its
    headings; without these, its pages. Nesting never skips a level: an entry is at most one deeper than that before it,
    d(i) = min(l(i), d(i-1) + 1) with d(0) = 0, which is i plus the running minimum of l(j) - j and 0.
    Levels count from the document's least; a missing level is 0.
    """
    pages = blocks.select("doc_id", "page").distinct()
    row = lambda source, at, level, title: [F.col("doc_id"), F.lit(source).alias("source"), F.col("page"), at.cast("long").alias("_at"), F.coalesce(level, F.lit(0)).cast("int").alias("_level"), title.alias("title")]
    marks = outline.join(pages, ["doc_id", "page"], "left_semi").select(row("bookmarks", F.col("ord"), F.col("level"), F.col("title")))
    heads = blocks.where("size = 14.0 and words > 0").select(row("headings", F.col("block_no"), F.lit(1), F.trim("text")))
    every = pages.select(row("pages", F.col("page"), F.lit(0), F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"))))
    own = Window.partitionBy("doc_id")
    order = own.orderBy("_at", "page", "title")
    # The names of the sources are in the order of preference.
    best = marks.unionByName(heads).unionByName(every).withColumn("_best", F.min("source").over(own)).where("source = _best")
    numbered = best.withColumns({"entry": F.row_number().over(order), "_level": F.col("_level") - F.min("_level").over(own)})
    depth = F.col("entry") - 1 + F.least(F.lit(0), F.min(F.col("_level") - F.col("entry") + 1).over(own.orderBy("entry")))
    return numbered.select("doc_id", "entry", "source", "page", "title", depth.alias("depth"))


#: The columns of a measurement file.
MEASUREMENT_COLUMNS = ("Document", "Page", "Type", "Measurement", "Scale", "Author", "Saved in PDF", "Points")


def write_measurements(rows: DataFrame, folder: str) -> None:
    """rows (document, page from 0, kind, label, ratio, author, saved, points as "x y; x y") as RFC 4180 CSV with a header and CRLF."""
    values = (F.col("document"), F.col("page") + 1, F.initcap("kind"), F.col("label"), F.coalesce("ratio", F.lit("")), F.coalesce("author", F.lit("")), F.when(F.col("saved"), "Yes").otherwise("No"), F.col("points"))
    named = rows.select(*(v.cast("string").alias(c) for v, c in zip(values, MEASUREMENT_COLUMNS, strict=True)))
    named.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(folder)


def report_status(report: DataFrame) -> DataFrame:
    """status: ok, or ok_with_warnings if the report of conversion_report() has rows."""
    return report.agg(F.when(F.count("*") > 0, "ok_with_warnings").otherwise("ok").alias("status"))


def conversion_report(warnings: DataFrame) -> DataFrame:
    """code, page, count of warning rows (code, page, n)."""
    return warnings.groupBy("code", "page").agg(F.sum("n").alias("count"))


def write_tables(cells: DataFrame, texts: DataFrame, folder: str) -> None:
    """cells (doc_id, table_no, row, col, text) to one relation in the order of tables, a manifest of the tables (doc_id, table_no, n_rows, n_cols), and all other nodes (doc_id, flow_no, page, kind, text) in reading order.

    All are range partitions, so that a table's cells lie together, a reader of few documents skips the other files, and a very long table is no task of its own.
    """
    cells.repartitionByRange("doc_id", "table_no", "row").sortWithinPartitions("doc_id", "table_no", "row", "col").write.parquet(f"{folder}/tables")
    known = cells.sparkSession.read.schema(cells.schema).parquet(f"{folder}/tables").groupBy("doc_id", "table_no")
    known.agg(F.count_distinct("row").alias("n_rows"), (F.max("col") + 1).alias("n_cols")).write.parquet(f"{folder}/manifest")
    texts.repartitionByRange("doc_id", "flow_no").sortWithinPartitions("doc_id", "flow_no").write.parquet(f"{folder}/text")


#: Characters that XML 1.0 cannot hold.
NOT_XML = "[^\\t\\n\\r\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"


def render_xml(lines: DataFrame) -> DataFrame:
    """doc_id, rendered: pages, lines and words of a document as nested XML; words have ids and a reading order through the document.

    lines: doc_id, page, line_no, text. What XML cannot hold becomes U+FFFD.
    """
    clean = F.regexp_replace("text", NOT_XML, "\ufffd")
    words = F.filter(F.split(clean, r"[ \t-\r]+"), lambda w: w != "")
    rows = lines.select("doc_id", "page", "line_no", words.alias("words")).where(F.size("words") > 0)
    before = F.sum(F.size("words")).over(Window.partitionBy("doc_id").orderBy("line_no")) - F.size("words")
    word = lambda w, i: F.struct(F.concat_ws("-", F.lit("w"), "line_no", i).alias("_id"), (F.col("before") + i).alias("_order"), w.alias("_VALUE"))
    line = F.struct(F.concat(F.lit("l-"), "line_no").alias("_id"), F.transform("words", word).alias("word"))
    pages = rows.withColumn("before", before).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    page = F.struct(F.col("page").alias("_number"), F.col("lines").alias("line"))
    docs = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("p")))), lambda x: x["p"]).alias("pages"))
    return docs.select("doc_id", F.to_xml(F.struct(F.col("pages").alias("page")), {"rowTag": "document"}).alias("rendered"))
