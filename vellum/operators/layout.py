"""Page layout over positioned glyphs, lines and ruled boxes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_marker
from .groups import per_group
from .letters import numbers, owners, ranks, texts

HEADING_RATIO, MOST_LEVELS = 1.15, 3


def upper_median(c: Column) -> Column:
    """Element floor(n / 2) of the sorted values."""
    values = F.array_sort(F.collect_list(c))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def body_size(glyphs: DataFrame) -> DataFrame:
    """doc_id, body: the most common size in halves; of equal counts the smaller."""
    by = glyphs.groupBy("doc_id", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.count("*").alias("n"))
    return by.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body"))


def dominant_size(rows: DataFrame) -> DataFrame:
    """doc_id, page, size of most letters; of equal ones the first seen."""
    by = rows.groupBy("doc_id", "page", "size").agg(F.sum(F.length("text")).alias("n"), F.min("block_no").alias("first"))
    return by.groupBy("doc_id", "page").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("size"))


def dominant_font(rows: DataFrame) -> DataFrame:
    """doc_id, page, font, size of most letters (rows: doc_id, page, block_no, font, size, text); of equal ones the first seen."""
    by = rows.groupBy("doc_id", "page", "font", "size").agg(F.sum(F.length("text")).alias("n"), F.min("block_no").alias("first"))
    return by.groupBy("doc_id", "page").agg(F.max_by(F.struct("font", "size"), F.struct("n", -F.col("first"))).alias("_f")).select("doc_id", "page", "_f.*")


def word_breaks(glyphs: DataFrame, gap: float = 0.2) -> DataFrame:
    """doc_id, line_no, words: glyphs of a line in words; a break is a space glyph or a gap of more than gap times the larger size.

    A line's glyphs are one array, ordered and split within its row: one shuffle by line, no window over single glyphs, and no
    shuffle where they come as an array (doc_id, line_no, glyphs) with x0, x1, size and ch. A size that is null is not compared.
    """
    if "glyphs" not in glyphs.columns:
        glyphs = glyphs.groupBy("doc_id", "line_no").agg(F.collect_list(F.struct("x0", "x1", "size", "ch")).alias("glyphs"))
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, values = owners(batch.column("glyphs")), batch.column("glyphs").flatten()
            seen = pc.not_equal(values.field("ch"), " ").fill_null(False)
            line, values = line[seen.to_numpy(zero_copy_only=False)], values.filter(seen)
            x0, x1, size = numbers(values, "x0", "x1", "size")
            ch = values.field("ch")
            if not np.all((line[1:] > line[:-1]) | (x0[1:] > x0[:-1])):
                known = [k for c in ("size", "x1", "x0") for k in (*numbers(values, c), values.field(c).is_valid().to_numpy(zero_copy_only=False))]  # null before others
                order = np.lexsort((ranks(ch), *known, line))
                line, x0, x1, size, ch = line[order], x0[order], x1[order], size[order], ch.take(pa.array(order))
            apart = (line[1:] == line[:-1]) & (x0[1:] - x1[:-1] > gap * np.fmax(size[1:], size[:-1]))
            spaced = pc.if_else(pa.array(np.append(np.zeros(min(1, len(line)), bool), apart)), pc.binary_join_element_wise("", ch, " "), ch)
            lines = np.unique(line)
            at = pa.array(lines)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("line_no").take(at), texts(spaced, np.append(np.searchsorted(line, lines), len(line)))], schema=schema)

    return glyphs.select("doc_id", "line_no", "glyphs").mapInArrow(run, "doc_id long, line_no int, words string")


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with kind: list, heading (at least HEADING_RATIO of the body size, at most 120 letters, with a letter) or paragraph."""
    body = blocks.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n")).groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
    marker = list_marker(F.col("text")) != ""
    heading = (F.length("text") <= 120) & F.col("text").rlike(r"\p{L}") & (F.col("size") >= HEADING_RATIO * F.col("body"))
    return blocks.join(body, "doc_id").withColumn("kind", F.when(marker, "list").when(heading, "heading").otherwise("paragraph"))


def heading_levels(headings: DataFrame) -> DataFrame:
    """headings with level: the rank of their size in the document, MOST_LEVELS at most."""
    sizes = headings.select("doc_id", "size").distinct().withColumn("level", F.least(F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))), F.lit(MOST_LEVELS)))
    return headings.join(sizes, ["doc_id", "size"])


def heading_tree(headings: DataFrame) -> DataFrame:
    """headings (doc_id, block_no, level) with parent (the last heading before of a smaller level) and skipped (deeper than the last by more than 1)."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("int")
    for level in range(2, MOST_LEVELS + 1):
        parent = F.when(F.col("level") == level, F.last(F.when(F.col("level") < level, F.col("block_no")), ignorenulls=True).over(before)).otherwise(parent)
    return headings.withColumns({"parent": parent, "skipped": F.col("level") > F.lag("level", 1, 0).over(w) + 1})


def merge_wrapped(headings: DataFrame) -> DataFrame:
    """Headings of one size on lines that follow each other, as one."""
    w = Window.partitionBy("doc_id", "page").orderBy("block_no")
    start = ~F.coalesce((F.lag("size").over(w) == F.col("size")) & (F.lag("block_no").over(w) == F.col("block_no") - 1), F.lit(False))
    island = headings.withColumn("_s", start.cast("int")).withColumn("_k", F.sum("_s").over(w))
    rows = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return island.groupBy("doc_id", "page", "_k").agg(F.min("block_no").alias("block_no"), F.first("size").alias("size"), F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text")).drop("_k")


def x_clusters(boxes: DataFrame, gap: float) -> DataFrame:
    """boxes (doc_id, page, x0, x1) with column: a new one where x0 lies more than gap beyond all before."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.withColumn("_n", F.coalesce((F.col("x0") > reach + gap).cast("int"), F.lit(0))).withColumn("column", F.sum("_n").over(w)).drop("_n")


def with_areas(rows: DataFrame, areas: DataFrame, box: tuple[str, str, str, str], first: str | None = None) -> DataFrame:
    """rows (doc_id, page) with _areas: their page's areas as one array, in the order of a column if one is named.

    Where rows have a box that holds all their glyphs (rx0, ry0, rx1, ry1), areas that do not touch it are left out.
    """
    page = ["doc_id", "page"]
    names = ([first] if first else []) + [c for c in areas.columns if c not in (*page, first)]
    known = areas.where(F.col(first).isNotNull()) if first else areas
    met = rows.join(known.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_areas")), page, "left")
    if "rx0" in rows.columns:
        x0, y0, x1, y1 = box
        touches = lambda a: (a[x0] <= F.col("rx1")) & (F.col("rx0") <= a[x1]) & (a[y0] <= F.col("ry1")) & (F.col("ry0") <= a[y1])
        near = F.filter("_areas", touches)
        met = met.withColumn("_areas", F.when(F.size(near) > 0, near))
    return met


def redact(glyphs: DataFrame, areas: DataFrame, unfold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Glyphs left outside of areas (doc_id, page, ax0, ay0, ax1, ay1): gone are those whose centre is inside, or of whose 5 x 5 sample points two fifths are.

    The sample points inside an area are a rectangle of columns and rows, kept as bits, so that areas add up without a row a
    point. Given unfold, the first table has rows of text from which it makes glyphs when they have met their areas, so that
    texts are shuffled, not glyphs.
    """
    rows = with_areas(glyphs, areas, ("ax0", "ay0", "ax1", "ay1"))
    rows = unfold(rows) if unfold else rows

    def within(area: Column, at: Column, axis: str) -> Column:
        return (at >= area[f"a{axis}0"]) & (at <= area[f"a{axis}1"])

    def bits(area: Column, axis: str, step: int) -> Column:
        lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
        return sum((F.when(within(area, lo + (k + 0.5) / 5 * (hi - lo), axis), 1 << step * k).otherwise(0) for k in range(5)), F.lit(0))

    centre = F.exists("_areas", lambda a: within(a, (F.col("x0") + F.col("x1")) / 2, "x") & within(a, (F.col("y0") + F.col("y1")) / 2, "y"))
    touches = lambda a: (a["ax0"] <= F.col("x1")) & (F.col("x0") <= a["ax1"]) & (a["ay0"] <= F.col("y1")) & (F.col("y0") <= a["ay1"])
    points = F.aggregate("_areas", F.lit(0), lambda held, a: F.when(touches(a), held.bitwiseOR(bits(a, "x", 1) * bits(a, "y", 5))).otherwise(held))
    gone = F.when(F.col("_areas").isNull(), False).when(F.coalesce(centre, F.lit(False)), True).otherwise(F.bit_count(points) >= 10)
    return rows.where(~gone).drop("_areas")


def attach_links(glyphs: DataFrame, boxes: DataFrame, unfold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """glyphs with uri: the first box (doc_id, page, link_no, bx0, by0, bx1, by1, uri) that holds the centre. unfold: see redact()."""
    rows = with_areas(glyphs, boxes.select("doc_id", "page", "link_no", "bx0", "by0", "bx1", "by1", "uri"), ("bx0", "by0", "bx1", "by1"), "link_no")
    rows = unfold(rows) if unfold else rows
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = F.filter("_areas", lambda b: cx.between(b["bx0"], b["bx1"]) & cy.between(b["by0"], b["by1"]))
    return rows.withColumn("uri", F.when(F.col("_areas").isNotNull(), F.get(held, F.lit(0))["uri"])).drop("_areas")


def reading_order(boxes: DataFrame, gap_x: float = 6.0, gap_y: float = 2.0) -> DataFrame:
    """boxes (doc_id, page, box, x0, y0, x1, y1) with place, by recursive cuts at the widest gap.

    The cuts depend on the boxes of one page only and are made per page in Python, with a list of what is still to cut.
    """
    box, x0, x1, y0, y1 = range(5)
    least = lambda v: (v is None or v != v, v)  # noqa: E731 what is unknown comes last

    def cut(rows: list[tuple]) -> list[list[tuple]]:
        """The two parts at the widest gap, or the rows in their order one by one."""
        best = (0.0, 0, 0.0)
        for lo, hi, wide, weight in ((x0, x1, gap_x, 1.2), (y0, y1, gap_y, 1.0)):
            spans = sorted((r[lo], r[hi]) for r in rows if r[lo] is not None and r[hi] is not None)
            reach = spans[0][1] if spans else 0.0
            for a, b in spans[1:]:
                if a - reach >= wide and (a - reach) * weight > best[0]:
                    best = ((a - reach) * weight, lo, a)
                reach = max(reach, b)
        if not best[1]:
            band = lambda v: v if v is None or not math.isfinite(v) else round(v / 4)
            return [[r] for r in sorted(rows, key=lambda r: (least(band(r[y0])), least(r[x0]), r[box]))]
        before = lambda r: r[best[1]] is not None and r[best[1]] < best[2]
        return [[r for r in rows if before(r)], [r for r in rows if not before(r)]]

    def run(rows: list[tuple]) -> list[tuple]:
        todo, order, n = [rows], {}, 0
        while todo:
            part = todo.pop()
            if len(part) > 1:
                todo += cut(part)[::-1]
            elif part:
                order[part[0][box]], n = n, n + 1
        return [(r[box], order[r[box]]) for r in rows]

    return per_group(boxes, ["doc_id", "page"], ["box", "x0", "x1", "y0", "y1"], run, "doc_id long, page int, box int, place int")


def dehyphenate(breaks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """breaks (doc_id, first, second) with joined: first-second stays hyphenated only where that form is in vocabulary (word) and the joined one is not.

    Each pair of words is looked up once; the breaks themselves are shuffled once, with nothing but their words.
    """
    known = vocabulary.select("word").distinct()
    whole, hyphen = F.concat("first", "second"), F.concat_ws("-", "first", "second")
    pairs = breaks.select("first", "second").distinct()
    unknown = pairs.join(known, whole == F.col("word"), "left_anti")
    stays = unknown.join(known, hyphen == F.col("word"), "left_semi").withColumn("_stays", F.lit(True))
    return breaks.join(stays, ["first", "second"], "left").select("doc_id", "first", "second", F.when(F.col("_stays"), hyphen).otherwise(whole).alias("joined"))


def header_rows(cells: DataFrame) -> DataFrame:
    """table, header_rows: leading rows that are bold throughout, never all rows."""
    rows = cells.groupBy("table", "row").agg(F.every("bold").alias("bold"))
    by = rows.groupBy("table").agg(F.count("*").alias("n"), F.min(F.when(~F.col("bold"), F.col("row"))).alias("first"))
    return by.select("table", F.coalesce("first", F.lit(0)).cast("int").alias("header_rows"))


def flatten_header(cells: DataFrame) -> DataFrame:
    """table, col, name: the header cells of a column joined by ' / ', repeats in a row once."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda r: r["text"])
    kept = F.filter(F.col("_t"), lambda t, i: (t != "") & ((i == 0) | (t != F.get("_t", i - 1))))
    return cells.groupBy("table", "col").agg(texts.alias("_t")).select("table", "col", F.array_join(kept, " / ").alias("name"))


def column_profile(cells: DataFrame) -> DataFrame:
    """table, col, width: whole numbers, the longest word of text (40 at most), 4 to 60 in all."""
    text = F.col("text")
    longest = F.array_max(F.transform(F.split(text, " "), lambda w: F.length(w)))
    width = F.when(text.rlike(r"^[-+]?[\d.,]+%?$"), F.length(text)).otherwise(F.least(longest, F.lit(40)))
    return cells.groupBy("table", "col").agg(F.greatest(F.lit(4), F.least(F.lit(60), F.max(width))).alias("width"))


def span_owners(cells: DataFrame) -> DataFrame:
    """Each slot's text: a cell inside an earlier span (rowspan, colspan) appends its text to the span's owner."""
    slots = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    owner = slots.groupBy("table", "r", "c").agg(F.min(F.struct("row", "col")).alias("o")).select("table", F.col("r").alias("row"), F.col("c").alias("col"), "o")
    owned = cells.join(owner, ["table", "row", "col"]).select("table", F.col("o.row").alias("owner_row"), F.col("o.col").alias("owner_col"), "row", "col", "text")
    rows = F.array_sort(F.collect_list(F.struct("row", "col", "text")))
    return owned.groupBy("table", "owner_row", "owner_col").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"))


def join_continued(tables: DataFrame) -> DataFrame:
    """tables (doc_id, table_no, cols, header) with logical_no: one that has the columns and the non-empty header of the table before continues it."""
    w = Window.partitionBy("doc_id").orderBy("table_no")
    key = F.lower(F.regexp_replace("header", r"[\s–—-]+", " "))
    same = (F.lag("cols").over(w) == F.col("cols")) & (F.lag("_k").over(w) == F.col("_k")) & (F.col("_k") != "")
    marked = tables.withColumn("_k", key).withColumn("_s", (~F.coalesce(same, F.lit(False))).cast("int"))
    return marked.withColumn("logical_no", F.sum("_s").over(w) - 1).drop("_k", "_s")
