"""Inventories of attachments, layers and scripts, and moves in an outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

MOST_SCRIPT = 200_000
#: What an action's trigger is called.
EVENTS = {"K": "Keystroke", "F": "Format", "V": "Validate", "C": "Calculate", "E": "Mouse enter", "X": "Mouse exit", "D": "Mouse down", "U": "Mouse up", "Fo": "Focus", "Bl": "Blur", "PO": "Page open", "PC": "Page close", "PV": "Page visible", "PI": "Page invisible", "O": "Page open", "Open": "Open", "Activate": "Activate"}


def attachment_inventory(named: DataFrame, annotations: DataFrame) -> DataFrame:
    """doc_id, id, page, filename, description, size, created, modified: attachments of the document, then of its pages.

    named: doc_id, key, filename, description, size, length (of the stored bytes), created, modified. annotations: doc_id,
    page, annot_no, contents and the same without key and length. A missing size is that of the bytes, a missing file name
    the key or "attachment", a missing description the annotation's contents.
    """
    rest = ["created", "modified"]
    a = named.select("doc_id", F.concat(F.lit("tree:"), F.coalesce("key", F.lit(""))).alias("id"), F.lit(None).cast("int").alias("page"), F.coalesce("filename", "key").alias("filename"), "description", F.coalesce("size", "length").alias("size"), *rest)
    b = annotations.select("doc_id", F.concat_ws(":", F.lit("annot"), "page", "annot_no").alias("id"), "page", F.coalesce("filename", F.lit("attachment")).alias("filename"), F.coalesce("description", "contents").alias("description"), "size", *rest)
    return a.unionByName(b)


def layer_inventory(layers: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, no, kind, layer, name, visible, locked, depth, group_name: the nested order's labels and layers, then unlisted layers.

    layers: doc_id, layer, name, visible, locked, ord. order: doc_id, node, parent, ord, label (of a group) or layer. A
    layer counts once, where it is listed first. Nesting is followed level by level.
    """
    level = cut(order.where("parent is null").select("doc_id", "node", "label", "layer", F.lit(0).alias("depth"), F.array("ord").alias("place"), F.lit(None).cast("string").alias("group_name")))
    found = level
    while not level.isEmpty():
        above = level.select("doc_id", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("place").alias("_p"), F.coalesce("label", "group_name").alias("group_name"))
        level = cut(order.join(above, ["doc_id", "parent"]).select("doc_id", "node", "label", "layer", "depth", F.concat("_p", F.array("ord")).alias("place"), "group_name"))
        found = found.unionByName(level)
    once = Window.partitionBy("doc_id", "layer").orderBy("place")
    listed = found.where("layer is not null").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").join(layers.drop("ord"), ["doc_id", "layer"])
    labels = found.where("layer is null and label is not null")
    none = lambda t: F.lit(None).cast(t)
    a = labels.select("doc_id", F.lit(0).alias("late"), "place", F.lit("label").alias("kind"), none("int").alias("layer"), F.col("label").alias("name"), none("boolean").alias("visible"), F.lit(False).alias("locked"), "depth", "group_name")
    b = listed.select("doc_id", F.lit(0).alias("late"), "place", F.lit("layer").alias("kind"), "layer", "name", "visible", "locked", "depth", "group_name")
    rest = layers.join(listed.select("doc_id", "layer"), ["doc_id", "layer"], "left_anti")
    c = rest.select("doc_id", F.lit(1).alias("late"), F.array("ord").alias("place"), F.lit("layer").alias("kind"), "layer", "name", "visible", "locked", F.lit(0).alias("depth"), none("string").alias("group_name"))
    no = (F.row_number().over(Window.partitionBy("doc_id").orderBy("late", "place")) - 1).alias("no")
    shown = F.when(F.col("kind") == "layer", F.coalesce("name", F.lit("Untitled layer"))).otherwise(F.col("name"))
    return a.unionByName(b).unionByName(c).select("doc_id", no, "kind", "layer", shown.alias("name"), F.when(F.col("kind") == "layer", F.coalesce("visible", F.lit(True))).alias("visible"), F.coalesce("locked", F.lit(False)).alias("locked"), "depth", "group_name")


def script_inventory(actions: DataFrame, most: int = MOST_SCRIPT) -> DataFrame:
    """doc_id, location, name, event, page, length, script of actions (doc_id, location, name, trigger, page, script).

    Triggers get their names, others stay; the length is the whole script's, of which at most so many letters are shown.
    """
    names = F.create_map(*(F.lit(x) for kv in EVENTS.items() for x in kv))
    script = F.coalesce("script", F.lit(""))
    return actions.select("doc_id", "location", F.coalesce("name", F.lit("(unnamed)")).alias("name"), F.coalesce(F.try_element_at(names, F.col("trigger")), F.col("trigger")).alias("event"), "page", F.length(script).alias("length"), F.substring(script, 1, most).alias("script"))


def move_subtrees(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """nodes (tree, node, parent, ord) after moves (tree, node, target, at): target null is the top, at null the end.

    The moved nodes of a tree go under one target, in document order, before the sibling that stood at that place; a node
    whose ancestor moves too stays below it. A move into itself or below fails.
    """
    top = nodes.where("parent is null").select("tree", "node", F.array("ord").alias("path"), F.array("node").alias("line"))
    level = found = cut(top)
    while not level.isEmpty():
        above = level.select("tree", F.col("node").alias("parent"), F.col("path").alias("_p"), F.col("line").alias("_l"))
        level = cut(nodes.join(above, ["tree", "parent"]).select("tree", "node", F.concat("_p", F.array("ord")).alias("path"), F.concat("_l", F.array("node")).alias("line")))
        found = found.unionByName(level)
    goal = moves.select("tree", "node", "target", "at")
    lines = found.select("tree", F.col("node").alias("target"), "line")
    checked = goal.join(lines, ["tree", "target"], "left")
    inside = F.array_contains(F.coalesce("line", F.array().cast("array<int>")), F.col("node"))
    checked = checked.where(F.when(inside, F.raise_error(F.concat(F.lit("a node cannot move below itself: "), F.col("node")))).cast("boolean").isNull())
    moved = checked.select("tree", "node", "target", "at").join(found.select("tree", "node", "path", "line"), ["tree", "node"])
    above = moved.select("tree", "node", F.explode(F.slice("line", F.lit(1), F.size("line") - 1)).alias("_up"))
    within = above.join(moved.select("tree", F.col("node").alias("_up")), ["tree", "_up"], "left_semi").select("tree", "node")
    moved = moved.join(within, ["tree", "node"], "left_anti")
    stays = nodes.join(moved.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", "parent", "ord")
    rank = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("ord")) - 1
    old = nodes.select("tree", "node", rank.alias("old_at"))
    kept = stays.join(old, ["tree", "node"]).select("tree", "node", "parent", F.col("old_at").alias("slot"), F.lit(1).alias("side"), F.array("ord").alias("place"))
    new = moved.select("tree", "node", F.col("target").alias("parent"), F.coalesce("at", F.lit((1 << 31) - 1)).alias("slot"), F.lit(0).alias("side"), F.col("path").alias("place"))
    order = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("slot", "side", "place")) - 1
    placed = kept.unionByName(new).select("tree", "node", "parent", order.cast("int").alias("ord"))
    return nodes.drop("parent", "ord").join(placed, ["tree", "node"])
