"""Links, destinations, outlines, layers, object graphs and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .pages import global_numbers

HREF = r'<a\s[^>]*href="([^"]*)"'
SAFE = ("http", "https", "mailto")


def link_inventory(pages: DataFrame) -> DataFrame:
    """page_id, link_no, href, kind: uri (with a scheme), page (a path or fragment) or other (empty)."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link_no", "href"))
    kind = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "uri").when(F.col("href").rlike("^[/#]"), "page").otherwise("other")
    return rows.withColumn("kind", kind)


def safe_links(links: DataFrame) -> DataFrame:
    """links with safe: internal ones and those of a safe scheme."""
    scheme = F.lower(F.regexp_extract("href", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return links.withColumn("safe", (scheme == "") | scheme.isin(*SAFE))


def resolve_destinations(refs: DataFrame, names: DataFrame, legacy: DataFrame) -> DataFrame:
    """refs (..., dest) with target: names (name, target) wins over legacy (name, target); unresolved ones keep null."""
    a = names.select(F.col("name").alias("dest"), F.col("target").alias("_a"))
    b = legacy.select(F.col("name").alias("dest"), F.col("target").alias("_b"))
    return refs.join(a, "dest", "left").join(b, "dest", "left").withColumn("target", F.coalesce("_a", "_b")).drop("_a", "_b")


def rename_destinations(refs: DataFrame, renames: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """refs with dest rewritten by renames (old, new), and renamed.

    With names (name), all that exist, a new name that another destination keeps or also takes fails.
    """
    if names is not None:
        kept = names.join(renames.select(F.col("old").alias("name")), "name", "left_anti").select(F.col("name").alias("new"))
        clash = renames.select("new").unionByName(kept).groupBy("new").agg(F.count("*").alias("_n"))
        checked = renames.join(clash, "new")
        renames = checked.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a destination has this name: "), F.col("new"))).cast("boolean")).otherwise(True)).select("old", "new")
    return refs.join(renames.select(F.col("old").alias("dest"), "new"), "dest", "left").withColumn("renamed", F.col("new").isNotNull()).withColumn("dest", F.coalesce("new", "dest")).drop("new")


def rename_count(renamed: DataFrame) -> DataFrame:
    """n: how many references rename_destinations() has rewritten."""
    return renamed.agg(F.sum(F.col("renamed").cast("long")).alias("n"))


def prune_references(refs: DataFrame, gone: DataFrame) -> DataFrame:
    """refs whose target is not among the removed ones."""
    return refs.join(gone.select(F.col("page").alias("target")), "target", "left_anti")


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent, ord, title) -> with depth and path (titles from the top), level by level; nodes on a cycle are unreachable and left out."""
    level = nodes.where("parent is null").select("tree", "node", F.lit(0).alias("depth"), F.array("title").alias("path"), F.array("ord").alias("place"))
    found = level
    while True:
        above = level.select("tree", F.col("node").alias("parent"), "depth", "path", "place")
        below = nodes.join(above, ["tree", "parent"])
        level = cut(below.select("tree", "node", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("title")).alias("path"), F.concat("place", F.array("ord")).alias("place")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return nodes.join(found, ["tree", "node"])


def outline_search(flat: DataFrame, text: str) -> DataFrame:
    """tree, node, trail (titles above it) of titles that hold the text in any case."""
    return flat.where(F.lower("title").contains(text.lower())).select("tree", "node", F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), " / ").alias("trail"))


def space_audit(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, category, bytes: an object belongs to the first category (by priority) whose root reaches it, else to other.

    roots (doc_id, obj, category, priority). Reach grows by one edge a round, keeping the least priority per object.
    """
    reach = now = cut(roots.groupBy("doc_id", "obj").agg(F.min(F.struct("priority", "category")).alias("c")))
    while True:  # ends: every round lowers the priority of an object
        more = edges.join(now.withColumnRenamed("obj", "src"), ["doc_id", "src"]).groupBy("doc_id", F.col("dst").alias("obj")).agg(F.min("c").alias("n"))
        now = cut(more.join(reach, ["doc_id", "obj"], "left").where("c is null or n < c").select("doc_id", "obj", F.col("n").alias("c")))
        if now.isEmpty():
            break
        reach = cut(reach.unionByName(now).groupBy("doc_id", "obj").agg(F.min("c").alias("c")))
    own = objects.join(reach, ["doc_id", "obj"], "left").withColumn("category", F.coalesce("c.category", F.lit("other")))
    return own.groupBy("doc_id", "category").agg(F.sum("bytes").alias("bytes"))


def visible(objects: DataFrame, states: DataFrame) -> DataFrame:
    """objects (obj, layers, policy) with visible; states (layer, shown). An empty membership is visible."""
    each = objects.select("obj", F.explode("layers").alias("layer")).join(states, "layer", "left").groupBy("obj").agg(F.every(F.coalesce("shown", F.lit(True))).alias("_all"), F.bool_or(F.coalesce("shown", F.lit(True))).alias("_any"))
    rule = F.when(F.col("policy") == "AllOn", F.col("_all")).when(F.col("policy") == "AnyOn", F.col("_any")).when(F.col("policy") == "AnyOff", ~F.col("_all")).otherwise(~F.col("_any"))
    return objects.join(each, "obj", "left").withColumn("visible", F.coalesce(rule, F.lit(True))).drop("_all", "_any")


def polyline(points: Column) -> dict[str, Column]:
    """length, perimeter and area of array<double> x, y, x, y, ...; 0 for too few points."""
    n = F.floor(F.size(points) / 2).cast("int")
    xs = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(points, 2 * i).cast("double").alias("x"), F.get(points, 2 * i + 1).cast("double").alias("y")))
    pairs = F.zip_with(F.slice(xs, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(xs, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    length = F.aggregate(pairs, F.lit(0.0), lambda a, e: a + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))
    first, last = F.get(xs, F.lit(0)), F.get(xs, n - 1)
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    area = F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, e: a + cross(e["p"], e["q"])) + cross(last, first)) / 2
    return {"length": F.when(n >= 2, length).otherwise(0.0), "perimeter": F.when(n >= 3, length + F.hypot(first["x"] - last["x"], first["y"] - last["y"])).otherwise(0.0), "area": F.when(n >= 3, area).otherwise(0.0)}


#: Segments of a smaller cross product are parallel; ends meet within this share of a length; most cells a side.
PARALLEL, AT_END, MOST_CELLS = 1e-9, 1e-6, 256


def segment_crossings(segments: DataFrame, cell: float | None = None) -> DataFrame:
    """tree, a, b, x, y: pairs of segments (tree, seg, x0, y0, x1, y1) that cross, and where. A joint, an end on an end, is no crossing; an end on an inner point is.

    Only segments that share a grid cell meet. Without a cell the grid of a tree follows from its extent and its number of
    segments, with MOST_CELLS a side at most. Segments with a coordinate that is null or not finite cross nothing.
    """
    ends = ("x0", "y0", "x1", "y1")
    fine = segments.select("tree", "seg", *ends).where(" and ".join(f"abs({c}) < double('infinity')" for c in ends))
    if cell is None:
        low = {c: F.min(F.least(f"{c}0", f"{c}1")) for c in "xy"}
        high = {c: F.max(F.greatest(f"{c}0", f"{c}1")) for c in "xy"}
        side = F.greatest(F.lit(1.0), F.least(F.lit(float(MOST_CELLS)), F.floor(F.sqrt(F.count("*")))))
        grid = fine.groupBy("tree").agg((F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(1.0)) / side).alias("cell"))
        fine = fine.join(grid, "tree")
    else:
        fine = fine.withColumn("cell", F.lit(float(cell)))

    def span(c: str) -> Column:
        u, v = F.col(f"{c}0"), F.col(f"{c}1")
        over = F.abs(v - u) * AT_END
        return F.sequence(F.floor((F.least(u, v) - over) / F.col("cell")), F.floor((F.greatest(u, v) + over) / F.col("cell")))

    cells = fine.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    a, b = (cells.select("tree", "cx", "cy", *(F.col(c).alias(f"{side}_{c}") for c in ("seg", *ends))) for side in "ab")
    pairs = a.join(b, ["tree", "cx", "cy"]).where("a_seg < b_seg").drop("cx", "cy").dropDuplicates(["tree", "a_seg", "b_seg"])
    dx = {s: F.col(f"{s}_x1") - F.col(f"{s}_x0") for s in "ab"}
    dy = {s: F.col(f"{s}_y1") - F.col(f"{s}_y0") for s in "ab"}
    wx, wy = F.col("b_x0") - F.col("a_x0"), F.col("b_y0") - F.col("a_y0")
    turn = dx["a"] * dy["b"] - dy["a"] * dx["b"]
    on = pairs.withColumn("turn", turn).where(F.abs("turn") >= PARALLEL).withColumns({"t": (wx * dy["b"] - wy * dx["b"]) / F.col("turn"), "u": (wx * dy["a"] - wy * dx["a"]) / F.col("turn")})
    inside = F.col("t").between(-AT_END, 1 + AT_END) & F.col("u").between(-AT_END, 1 + AT_END)
    joint = ((F.col("t") <= AT_END) | (F.col("t") >= 1 - AT_END)) & ((F.col("u") <= AT_END) | (F.col("u") >= 1 - AT_END))
    return on.where(inside & ~joint).select("tree", F.col("a_seg").alias("a"), F.col("b_seg").alias("b"), (F.col("a_x0") + F.col("t") * dx["a"]).alias("x"), (F.col("a_y0") + F.col("t") * dy["a"]).alias("y"))


def crossing_points(crossings: DataFrame) -> DataFrame:
    """tree, x, y: the places of crossings, merged at two decimals."""
    return crossings.select("tree", *((F.round(c, 2) + 0.0).alias(c) for c in ("x", "y"))).distinct()


def snap_points(points: DataFrame, candidates: DataFrame, tolerance: float) -> DataFrame:
    """points (tree, point, x, y) with target: the candidate (tree, cand, priority, cx, cy) of least priority, then least distance, then the later one, within tolerance."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = points.withColumn("gx", F.explode(F.array(cell("x") - 1, cell("x"), cell("x") + 1))).withColumn("gy", F.explode(F.array(cell("y") - 1, cell("y"), cell("y") + 1)))
    right = candidates.withColumns({"gx": cell("cx"), "gy": cell("cy")})
    far = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    near = left.join(right, ["tree", "gx", "gy"]).withColumn("far", far).where(F.col("far") <= tolerance)
    best = near.groupBy("tree", "point").agg(F.min_by("cand", F.struct("priority", "far", -F.col("cand"))).alias("target"))
    return points.join(best, ["tree", "point"], "left")


def font_inventory(rows: DataFrame) -> DataFrame:
    """font, pages (the first 50), subset (six capitals and a plus) of rows (font, page)."""
    return rows.groupBy("font").agg(F.slice(F.array_sort(F.collect_set("page")), 1, 50).alias("pages")).withColumn("subset", F.col("font").rlike(r"^[A-Z]{6}\+"))


def sweep_summary(results: DataFrame) -> DataFrame:
    """op, error (its class, before the first colon), at (where results name a place), files, first_file of crashes; of results (file, op, status, error)."""
    by = ["op", "error", *(c for c in ("at",) if c in results.columns)]
    crashes = results.where("status = 'crash'").withColumn("error", F.substring_index("error", ":", 1))
    return crashes.groupBy(*by).agg(F.count_distinct("file").alias("files"), F.min("file").alias("first_file"))


def sweep_outcomes(results: DataFrame) -> DataFrame:
    """op, ok, refused, crash: how often an operation ended so."""
    return results.groupBy("op").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "refused", "crash")))


def recent(events: DataFrame, k: int, by: str = "user_id") -> DataFrame:
    """The k keys whose last event is the newest, with that event."""
    last = events.groupBy(by).agg(F.max(F.struct("ts", "event_id")).alias("m")).select(by, F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))
    return last.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def order_list(rows: DataFrame, key: str, listed: DataFrame, original: str) -> DataFrame:
    """rows with place: listed (key, pos) first in their order, the others after in the original order."""
    both = rows.join(listed, key, "left").withColumn("pos", F.coalesce("pos", F.lit((1 << 31) - 1)))
    return global_numbers(both, ["pos", original], 0).withColumn("place", F.col("number").cast("int")).drop("pos", "number")


def title_of(html: Column, url: Column) -> Column:
    """(title, source): the <title> unless it looks like a file name, else the first <h1>, else the URL's last part."""
    meta = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    fine = (meta != "") & ~meta.rlike(r"(?i)\.(docx?|pdf|tmp|html?)$|^untitled")
    last = F.regexp_extract(url, "([^/?#]*)/?(?:[?#].*)?$", 1)
    return F.struct(F.left(F.when(fine, meta).when(head != "", head).otherwise(last), F.lit(120)).alias("title"), F.when(fine, "meta").when(head != "", "heading").otherwise("url").alias("source"))
