"""Inventories of objects, images, layers, attachments and fields; sanitising; lines, grids and blank fields of pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .letters import numbers, owners, ranks, texts
from .lineage import cut

#: Categories that are removed unless the caller says otherwise.
REMOVED = ("metadata", "files", "scripts", "hidden_layers", "hidden_text", "private_data")


def hidden_counts(objects: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """doc_id and a count per category."""
    return objects.groupBy("doc_id").agg(*(F.sum((F.col("category") == c).cast("long")).alias(c) for c in categories))


def sanitize(objects: DataFrame, on: tuple[str, ...] = REMOVED) -> DataFrame:
    return objects.where(~F.col("category").isin(*on))


def outside_page(items: DataFrame, width: float, height: float, slack: float = 0.5) -> DataFrame:
    """doc_id, page, n_outside: items whose centre lies more than slack outside the page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return items.where((cx < -slack) | (cx > width + slack) | (cy < -slack) | (cy > height + slack)).groupBy("doc_id", "page").agg(F.count("*").alias("n_outside"))


def image_inventory(placements: DataFrame) -> DataFrame:
    """image, page (of the first), dpi of the largest placement; of placements (image, page, px_w, px_h, w, h in points)."""
    big = F.max_by(F.struct("px_w", "px_h", "w", "h"), F.struct(F.col("w") * F.col("h"), -F.col("page")))
    by = placements.groupBy("image").agg(F.min("page").alias("page"), big.alias("b"))
    return by.select("image", "page", F.least(F.col("b.px_w") / (F.col("b.w") / 72), F.col("b.px_h") / (F.col("b.h") / 72)).alias("dpi"))


def text_status(pages: DataFrame) -> DataFrame:
    """doc_id, pages, image_only (pages without letters but with images), needs_text (all pages are) of pages (doc_id, chars, images)."""
    only = (F.col("chars") == 0) & (F.col("images") > 0)
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(only.cast("long")).alias("image_only"), F.every(only).alias("needs_text"))


def size_mix(pages: DataFrame) -> DataFrame:
    """doc_id, sizes: the distinct page sizes (w x h, rounded), sorted."""
    return pages.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("x", F.round("w").cast("int"), F.round("h").cast("int")))), " ").alias("sizes"))


def inks(rows: DataFrame) -> DataFrame:
    """doc_id, spots (names), process: whether any of cyan, magenta, yellow, black is used."""
    process = F.col("ink").isin("C", "M", "Y", "K")
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(~process, F.col("ink")))), ",").alias("spots"), F.bool_or(process).alias("process"))


def skew(lines: DataFrame) -> DataFrame:
    """doc_id, angle: the upper median of line angles below 15 degrees, of lines with two words or more; null for fewer than three."""
    fine = lines.where((F.col("words") >= 2) & (F.abs("angle") < 15))
    values = F.array_sort(F.collect_list("angle"))
    return fine.groupBy("doc_id").agg(F.when(F.count("*") >= 3, F.get(values, F.floor(F.count("*") / 2).cast("int"))).alias("angle"))


def namespaced(fields: DataFrame, others: DataFrame) -> DataFrame:
    """fields (doc_id, name) with merged_name: of a name that others, or an earlier document, has, later ones get p<n>_ in front.

    n is the first number, from the count of those before on, that gives a name which neither others, nor a field that
    keeps its name, nor an earlier field of that new name has; names that clash are numbered on until none does.
    """
    taken = others.select("name").distinct().withColumn("_t", F.lit(1))
    n = F.row_number().over(Window.partitionBy("name").orderBy("doc_id")) - 1 + F.coalesce("_t", F.lit(0))
    merged = F.when(F.col("_n") == 0, F.col("name")).otherwise(F.concat(F.lit("p"), "_n", F.lit("_"), F.col("name")))
    now = cut(fields.join(taken, "name", "left").withColumn("_n", n).drop("_t").withColumn("merged_name", merged))
    while True:
        held = taken.select(F.col("name").alias("merged_name")).unionByName(now.where("_n = 0").select("merged_name")).distinct().withColumn("_held", F.lit(True))
        nth = F.row_number().over(Window.partitionBy("merged_name").orderBy("doc_id", "name"))
        checked = now.join(held, "merged_name", "left").withColumn("_clash", (F.col("_n") > 0) & (F.col("_held").isNotNull() | (nth > 1)))
        if not checked.where("_clash").limit(1).count():
            return now.drop("_n")
        now = cut(checked.withColumn("_n", F.col("_n") + F.col("_clash").cast("int")).withColumn("merged_name", merged).drop("_held", "_clash"))


def exemption_texts(marks: DataFrame, codes: DataFrame) -> DataFrame:
    """marks (mark, code_set, code) with overlay, from codes (code_set, code, title); an unknown code stays bare."""
    return marks.join(codes, ["code_set", "code"], "left").withColumn("overlay", F.coalesce(F.concat(F.lit("("), "code", F.lit(") "), "title"), "code"))


def inherited(nodes: DataFrame, attribute: str) -> DataFrame:
    """nodes (tree, node, parent, name, ...) with full_name and the nearest own or ancestor's attribute, level by level; nodes on a cycle are unreachable and left out."""
    level = cut(nodes.where("parent is null").select("tree", "node", F.col("name").alias("full_name"), F.col(attribute).alias("value")))
    found = level
    while True:
        above = level.select("tree", F.col("node").alias("parent"), F.col("full_name").alias("_f"), F.col("value").alias("_v"))
        level = cut(nodes.join(above, ["tree", "parent"]).select("tree", "node", F.concat_ws(".", "_f", "name").alias("full_name"), F.coalesce(attribute, "_v").alias("value")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def beads(links: DataFrame) -> DataFrame:
    """thread, bead, place: linked lists (thread, bead, next, first) walked by doubling the distance to the start; beads on a cycle without a start are left out."""
    at = cut(links.select("thread", "bead", F.col("next").alias("to")))
    start = cut(links.where("first").select("thread", "bead", F.lit(0).alias("place")))
    reach, step = start, 1
    while True:
        far = reach.join(at, ["thread", "bead"]).where("to is not null").select("thread", F.col("to").alias("bead"), (F.col("place") + step).alias("place"))
        grown = cut(reach.unionByName(far).groupBy("thread", "bead").agg(F.min("place").alias("place")))
        if grown.count() == reach.count():
            break
        reach, step = grown, step * 2
        hop = at.select("thread", F.col("bead").alias("to"), F.col("to").alias("_to"))
        at = cut(at.join(hop, ["thread", "to"], "left").select("thread", "bead", F.col("_to").alias("to")))
    return reach


def build_lines(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, line, text: glyphs share a line while their centres lie within 0.4 heights of the line's; what joins a line depends on order.

    glyphs: a row for each (doc_id, page, y0, y1, x0, ch), or for each page with an array of them. Neighbours of one height and
    place go to the same line, so each such run is dealt with once; its letters are never touched one by one.
    """
    if "glyphs" not in glyphs.columns:
        glyphs = glyphs.groupBy("doc_id", "page").agg(F.collect_list(F.struct("y0", "y1", "x0", "ch")).alias("glyphs"))
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string())])

    def homes(pages: list[int], tops: list[float], bottoms: list[float]) -> tuple[list[int], list[int], list[int]]:
        """For each run its line, counted through the batch; for each line its page and its number there."""
        lines: list[float] = []
        home, of_page, number = [], [], []
        first, at = 0, None
        for page, y0, y1 in zip(pages, tops, bottoms, strict=True):
            if page != at:
                first, at = len(lines), page
            centre, height = (y0 + y1) / 2, y1 - y0
            found = next((k for k in range(len(lines) - 1, max(first, len(lines) - 5) - 1, -1) if abs(lines[k] - centre) <= 0.4 * height), None)
            if found is None:
                found = len(lines)
                lines.append(centre)
                of_page.append(page)
                number.append(found - first)
            home.append(found)
        return home, of_page, number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, values = owners(batch.column("glyphs")), batch.column("glyphs").flatten()
            y0, y1, x0 = numbers(values, "y0", "y1", "x0")
            ch = values.field("ch")
            new_page = page[1:] != page[:-1]
            if not np.all(new_page | (y0[1:] > y0[:-1]) | ((y0[1:] == y0[:-1]) & (x0[1:] >= x0[:-1]))):
                order = np.lexsort((x0, y0, page))
                page, y0, y1, x0, ch = page[order], y0[order], y1[order], x0[order], ch.take(pa.array(order))
                new_page = page[1:] != page[:-1]
            opens = np.append(np.ones(min(1, len(page)), bool), new_page | (y0[1:] != y0[:-1]) | (y1[1:] != y1[:-1]) | ~((y1[1:] >= y0[1:]) & np.isfinite(y0[1:] + y1[1:])))
            starts = np.flatnonzero(opens)
            home, of_page, number = homes(page[starts].tolist(), y0[starts].tolist(), y1[starts].tolist())
            line = np.repeat(np.array(home, np.int64), np.diff(np.append(starts, len(page))))
            if not np.all((line[1:] > line[:-1]) | ((line[1:] == line[:-1]) & (x0[1:] > x0[:-1]))):
                order = np.lexsort((ranks(ch), x0, line))  # letters at one place stand in their own order
                line, ch = line[order], ch.take(pa.array(order))
            text = texts(ch, np.searchsorted(line, np.arange(len(number) + 1)))
            at = pa.array(of_page, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page").take(at), pa.array(number, pa.int32()), text], schema=schema)

    return glyphs.select("doc_id", "page", "glyphs").mapInArrow(run, "doc_id long, page int, line int, text string")


def grid_edges(rules: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, axis, edge_no, at: ruled lines (axis, at) clustered where neighbours lie within tolerance; at is their mean."""
    w = Window.partitionBy("doc_id", "page", "axis").orderBy("at")
    marked = rules.withColumn("_n", F.coalesce((F.col("at") - F.lag("at").over(w) >= tolerance).cast("int"), F.lit(0))).withColumn("edge_no", F.sum("_n").over(w))
    return marked.groupBy("doc_id", "page", "axis", "edge_no").agg(F.avg("at").alias("at"))


def merged_cells(separators: DataFrame) -> DataFrame:
    """doc_id, row, first_col, cols: boxes of a row (doc_id, row, col, ruled: a rule on the left) in runs without a rule between."""
    w = Window.partitionBy("doc_id", "row").orderBy("col")
    run = F.sum(F.col("ruled").cast("int")).over(w)
    return separators.withColumn("_k", run).groupBy("doc_id", "row", "_k").agg(F.min("col").alias("first_col"), F.count("*").alias("cols")).drop("_k")


def blank_fields(boxes: DataFrame, most: int = 200) -> DataFrame:
    """doc_id, box, kind: empty boxes (doc_id, box, x0, y0, x1, y1, occupied) of a field's size, the smallest first where they overlap.

    The choice is greedy by size within a document and runs per document on the boxes that qualify.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fit = boxes.where(~F.col("occupied") & h.between(7, 72) & w.between(7, 360)).withColumn("kind", F.when(w.between(7, 20) & h.between(7, 20) & (w / h).between(0.7, 1.4), "checkbox").otherwise("text"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for b in part.assign(a=(part.x1 - part.x0) * (part.y1 - part.y0)).sort_values(["a", "box"]).itertuples():
            if len(kept) < most and all(b.x1 <= k.x0 or k.x1 <= b.x0 or b.y1 <= k.y0 or k.y1 <= b.y0 for k in kept):
                kept.append(b)
        return pd.DataFrame([(b.doc_id, b.box, b.kind) for b in kept], columns=["doc_id", "box", "kind"])

    return fit.groupBy("doc_id").applyInPandas(run, "doc_id long, box int, kind string")


def flow(*parts: tuple[str, DataFrame]) -> DataFrame:
    """doc_id, flow_no, kind, node: nodes of several kinds (doc_id, page, y, node) in one reading order."""
    whole: DataFrame | None = None
    for kind, rows in parts:
        own = rows.select("doc_id", "page", "y", F.lit(kind).alias("kind"), "node")
        whole = own if whole is None else whole.unionByName(own)
    w = Window.partitionBy("doc_id").orderBy("page", "y", "kind", "node")
    return whole.select("doc_id", (F.row_number().over(w) - 1).alias("flow_no"), "kind", "node")


def preflight(facts: DataFrame, profile: dict[str, tuple[str, float, str]], by: str = "doc_id") -> DataFrame:
    """by, rule, severity, n: facts (by, measure, value) against a profile {rule: (measure, least value, severity)}."""
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(m).alias("_m"), F.lit(float(v)).alias("_v"), F.lit(s).alias("severity")) for r, (m, v, s) in profile.items())))
    each = facts.select(by, "measure", "value", rules.alias("r")).where(F.col("measure") == F.col("r._m"))
    return each.groupBy(by, "r.rule", "r.severity").agg(F.sum((F.col("value") < F.col("r._v")).cast("long")).alias("n"))


def measurement_rows(points: Column) -> Column:
    """Points as "x y; x y" with two decimals, for a CSV sink."""
    n = F.floor(F.size(points) / 2).cast("int")
    two = lambda i: F.bround(F.get(points, i).cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", two(2 * i), two(2 * i + 1))), "; ")
