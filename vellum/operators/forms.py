"""Forms: fields with values, calculation, filling, resetting. A field row is (form, name, kind, value, ...)."""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import make_number
from .groups import per_group
from .lineage import cut

CALCULATIONS = ("SUM", "PRD", "AVG", "MIN", "MAX")


def calculate(fields: DataFrame, group: str, how: str) -> DataFrame:
    """form, result over the field of that name or, for a group, all below it; a blank or unreadable value counts as 0."""
    if how not in CALCULATIONS:
        raise ValueError(f"unknown calculation {how}")
    own = fields.where((F.col("name") == group) | F.col("name").startswith(group + "."))
    value = F.coalesce(make_number(F.col("value")), F.lit(0.0)).cast("decimal(24,6)")
    result = {"SUM": F.sum(value).cast("double"), "PRD": F.product(value.cast("double")), "AVG": (F.sum(value).cast("double") / F.count("*")), "MIN": F.min(value).cast("double"), "MAX": F.max(value).cast("double")}[how]
    return fields.select("form").distinct().join(own.groupBy("form").agg(result.alias("result")), "form", "left").withColumn("result", F.coalesce("result", F.lit(0.0)))


def notation(expression: str, column: dict[str, Column]) -> Column:
    """A Column for + - * /, brackets and unary minus over named fields; a division by 0 gives 0. Unknown names fail before anything runs."""
    ops = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in ops:
            return ops[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in column:
            return column[node.id]
        raise ValueError(f"cannot read {ast.unparse(node)}")

    return build(ast.parse(expression, mode="eval").body)


def inventory(fields: DataFrame) -> DataFrame:
    """form, name, kind, option_no, label, export, value: a row per option, one for fields without options."""
    return fields.select("form", "name", "kind", "value", F.posexplode_outer("options").alias("option_no", "o")).select("form", "name", "kind", "option_no", "o.label", "o.export", "value")


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """fields with new values (form, name, new) and error.

    Unknown fields and read-only ones are errors; text is cut to max_length; a choice is taken by its export, then
    by its label. A form with any error keeps all of its values.
    """
    both = fields.join(values, ["form", "name"], "full_outer")
    by_export = F.filter("options", lambda o: o["export"] == F.col("new"))
    by_label = F.filter("options", lambda o: o["label"] == F.col("new"))
    choice = F.coalesce(F.get(by_export, F.lit(0))["export"], F.get(by_label, F.lit(0))["export"])
    put = F.when(F.col("kind") == "choice", choice).when(F.col("max_length").isNotNull(), F.left("new", F.col("max_length"))).otherwise(F.col("new"))
    error = F.when(F.col("kind").isNull(), "unknown field").when(F.col("new").isNotNull() & F.col("read_only"), "read only").when((F.col("kind") == "choice") & F.col("new").isNotNull() & choice.isNull(), "no such option")
    checked = both.withColumns({"_put": put, "error": error})
    bad = checked.groupBy("form").agg(F.bool_or(F.col("error").isNotNull()).alias("rejected"))
    return checked.join(bad, "form").withColumn("value", F.when(F.col("rejected"), F.col("value")).otherwise(F.coalesce("_put", "value"))).select("form", "name", "value", "error", "rejected")


def reset(fields: DataFrame) -> DataFrame:
    """Defaults, else blank; buttons and signatures stay."""
    return fields.withColumn("value", F.when(F.col("kind").isin("button", "signature"), F.col("value")).otherwise(F.coalesce("default", F.lit(""))))


def two_passes(forms: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """forms (a column per field) after two passes of rules (field, notation) in order, which settles one step out of order; changed lists the fields that moved."""
    names = [n for n, _ in rules]
    before = forms.select(*forms.columns, F.struct(*names).alias("_was"))
    for _ in range(2):
        for name, expression in rules:
            before = before.withColumn(name, notation(expression, {c: F.coalesce(F.col(c), F.lit(0.0)) for c in forms.columns}))
    return before.withColumn("changed", F.array_join(F.array_compact(F.array(*(F.when(~F.col(n).eqNullSafe(F.col(f"_was.{n}")), n) for n in names))), ",")).drop("_was")


#: What each place of a label adds to its distance, and how far it may lie, in font sizes.
PENALTIES = {"inside": 0.0, "right": 0.0, "left": 0.5, "above": 0.5, "below": 0.6, "caption": 0.7, "right_hint": 0.8}
REACH = {"above": 1.5, "below": 1.2, "left": 6.0, "right": 3.0}
SUPPLEMENTS = ("below", "right_hint")
RIVALS, MOST_LABEL = 0.15, 220
#: Places where a label is what stands over or under the field, not the whole block.
PARTIAL = ("inside", "above", "below")


def with_tokens(blocks: DataFrame) -> DataFrame:
    """blocks with tokens (x0, y0, x1, y1, text); where they are not given, the block is its only token."""
    if "tokens" in blocks.columns:
        return blocks
    return blocks.withColumn("tokens", F.array(F.struct("x0", "y0", "x1", "y1", "text")))


class Candidate(NamedTuple):
    """What may label a field, as candidates are ordered."""

    score: float
    field: int
    block: int
    nth: int
    tooltip: str | None
    source: str
    text: str
    taken: list[int]


def label_candidates(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, field, tooltip, block, nth, source, score, text, taken: everything that may label a field by where it stands; see pair_labels().

    taken holds the places of the tokens that the label would use up: of a block inside, above or below a field only those
    over or under it, of others the whole block. nth numbers what one block may be to a field.
    Blocks that neither stand in a field's row nor have a token or their middle as close above, in or below it as a rule asks
    are no candidates, whatever their letters; these pairs go before letters and tokens are looked at.
    """
    place = ["doc_id", "page"]
    size = blocks.groupBy(*place).agg(F.median("size").alias("s"))
    reach = lambda name, pick: pick(F.transform("tokens", lambda t: t[name]))
    middles = F.transform("tokens", lambda t: (t["y0"] + t["y1"]) / 2)
    high = {"_top0": reach("y0", F.array_min), "_top1": reach("y0", F.array_max), "_end0": reach("y1", F.array_min), "_end1": reach("y1", F.array_max), "_mid0": F.array_min(middles), "_mid1": F.array_max(middles)}
    b = with_tokens(blocks).join(size, place).select(*place, "block", "text", "tokens", "s", *(v.alias(k) for k, v in high.items()), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    check = F.col("kind").isin("checkbox", "radio")
    row = (F.least("y1", "by1") - F.greatest("y0", "by0") >= 0.3 * F.least(F.col("y1") - F.col("y0"), F.col("by1") - F.col("by0"))) | (F.abs(F.col("by0") + F.col("by1") - F.col("y0") - F.col("y1")) / 2 <= 0.6 * (F.col("y1") - F.col("y0")))
    right = F.col("bx0") - F.col("x1")
    boxes = fields.where(check).select(*place, "x0", "y0", "x1", "y1")
    owned = b.join(boxes, place).where(row & right.between(0, 3 * F.col("s"))).select(*place, "block").distinct().withColumn("owned", F.lit(True))
    lower = (F.col("by0") + F.col("by1")) / 2
    over_it = (F.col("y0") - F.col("_end1") <= REACH["above"] * F.col("s")) & (F.col("y0") - F.col("_end0") >= -2)
    under_it = (F.col("_top0") - F.col("y1") <= REACH["below"] * F.col("s")) & (F.col("_top1") - F.col("y1") >= -2)
    in_it = (F.col("_mid1") >= F.col("y0") - 1) & (F.col("_mid0") <= F.col("y1") + 1)
    caption = lower.between((F.col("y0") + F.col("y1")) / 2, F.col("y1") + REACH["below"] * F.col("s"))
    close = F.coalesce(row, F.lit(False)) | F.coalesce(over_it, F.lit(False)) | F.coalesce(under_it, F.lit(False)) | F.coalesce(in_it, F.lit(False)) | F.coalesce(caption, F.lit(False))
    near = fields.where(~F.col("kind").isin("button", "signature")).join(b.join(owned, [*place, "block"], "left"), place).where(close)
    # what stands over the field's width: its places, box and text
    middle_x, middle_y = (lambda t: (t["x0"] + t["x1"]) / 2), (lambda t: (t["y0"] + t["y1"]) / 2)
    over_field = F.filter(F.transform("tokens", lambda t, k: F.struct(k.alias("k"), t.alias("t"))), lambda e: middle_x(e["t"]).between(F.col("x0"), F.col("x1")))
    near = near.withColumn("_part", over_field)
    side = lambda name, pick: pick(F.transform("_part", lambda e: e["t"][name]))
    near = near.withColumns({"_px0": side("x0", F.array_min), "_py0": side("y0", F.array_min), "_px1": side("x1", F.array_max), "_py1": side("y1", F.array_max)})
    part_text = F.array_join(F.transform("_part", lambda e: e["t"]["text"]), " ")
    whole, part = F.transform("tokens", lambda t, k: k), F.transform("_part", lambda e: e["k"])

    left, above, below = F.col("x0") - F.col("bx1"), F.col("y0") - F.col("_py1"), F.col("_py0") - F.col("y1")
    width, words = F.col("bx1") - F.col("bx0"), F.size(F.split(F.trim("text"), r"\s+"))
    part_words = F.size(F.split(F.trim(part_text), r"\s+"))
    over = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    part_over = F.least("x1", "_px1") - F.greatest("x0", "_px0") >= 0.5 * (F.col("_px1") - F.col("_px0"))
    begins = F.get(part, F.lit(0)) == 0
    free = F.col("owned").isNull() & (F.length("text") <= MOST_LABEL)
    within = lambda gap, side: gap.between(-2, REACH[side] * F.col("s"))
    middle = (F.col("by0") + F.col("by1")) / 2
    inside = F.forall("_part", lambda e: middle_y(e["t"]).between(F.col("y0") - 1, F.col("y1") + 1)) & (F.col("_py1") - F.col("_py0") <= F.col("y1") - F.col("y0") + 2)
    rules = {  # source: (kind of field, condition, distance in font sizes or what stands for it)
        "right": (check, row & within(right, "right"), right / F.col("s")),
        "left": (check, row & within(left, "right"), left / F.col("s") + 0.3),
        "inside": (~check, free & (F.size("_part") > 0) & inside, F.lit(0.0)),
        "above": (~check, free & part_over & within(above, "above") & (begins | ~F.contains("text", F.lit(":"))), above / F.col("s") + F.greatest(F.col("_px0") - F.col("x0"), F.lit(0.0)) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))),
        "below": (~check, free & part_over & within(below, "below") & (part_words <= 4) & ~F.rtrim(part_text).endswith(":"), below / F.col("s")),
        "caption": (~check, free & F.col("text").contains(":") & F.col("bx0").between(F.col("x0") - 3 * F.col("s"), F.col("x1")) & (over >= 0.3 * width) & middle.between((F.col("y0") + F.col("y1")) / 2, F.col("y1") + REACH["below"] * F.col("s")), F.greatest(middle - F.col("y1"), F.lit(0.0)) / F.col("s")),
        "right_hint": (~check, free & row & within(right, "right") & (words <= 3) & (F.col("text").startswith("(") | (F.length("text") <= 14)), right / F.col("s") - F.when(F.col("text").startswith("("), 0.4).otherwise(0.0)),
    }
    rules["beside"] = (~check, free & row & within(left, "left"), left / F.col("s"))
    named = lambda name: "left" if name == "beside" else name
    use = lambda name: (part_text, part) if name in PARTIAL else (F.col("text"), whole)
    each = [F.when(kind & where, F.struct(F.lit(named(name)).alias("source"), (F.greatest(distance, F.lit(0.0)) + PENALTIES[named(name)]).alias("score"), use(name)[0].alias("text"), use(name)[1].alias("taken"))) for name, (kind, where, distance) in rules.items()]
    found = near.select(*place, "field", "tooltip", "block", F.posexplode(F.array_compact(F.array(*each))).alias("nth", "c"))
    return found.select(*place, "field", "tooltip", "block", "nth", "c.source", "c.score", "c.text", "c.taken")


def cell_labels(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, page, field, cell_label, cell_source of the fields whose middle lies in a cell (doc_id, page, table_no, row, col, x0, y0, x1, y1, text).

    The cell's own text is the label. In an empty cell a box is labelled by the next cell at its right that has text, any other
    field by the last one at its left, else by the last one above.
    """
    place = ["doc_id", "page"]
    own = F.trim(F.regexp_replace("text", r"\s+", " "))
    c = cells.select(*place, "table_no", "row", "col", F.nullif(own, F.lit("")).alias("own"), *(F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")))
    to_left = Window.partitionBy(*place, "table_no", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    to_right = Window.partitionBy(*place, "table_no", "row").orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    upward = Window.partitionBy(*place, "table_no", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    around = c.withColumns({"at_left": F.last("own", ignorenulls=True).over(to_left), "at_right": F.first("own", ignorenulls=True).over(to_right), "over": F.last("own", ignorenulls=True).over(upward)})
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = fields.select(*place, "field", "kind", x.alias("mx"), y.alias("my")).join(around, place).where(F.col("mx").between(F.col("cx0"), F.col("cx1")) & F.col("my").between(F.col("cy0"), F.col("cy1")))
    check = F.col("kind").isin("checkbox", "radio")
    told = lambda label, source: F.struct(F.col(label).alias("label"), F.lit(source).alias("source"))
    found = F.when(F.col("own").isNotNull(), told("own", "cell")).when(check, told("at_right", "cell_right")).when(F.col("at_left").isNotNull(), told("at_left", "cell_left")).otherwise(told("over", "cell_above"))
    first = held.groupBy(*place, "field").agg(F.min_by(found, F.struct("table_no", "row", "col")).alias("f"))
    return first.select(*place, "field", F.col("f.label").alias("cell_label"), F.when(F.col("f.label").isNotNull(), F.col("f.source")).otherwise("none").alias("cell_source"))


def field_groups(fields: DataFrame) -> DataFrame:
    """fields (name) with group: the bare name of radio buttons, and of fields of a kind that share a name on a page; else null."""
    shared = F.count("*").over(Window.partitionBy("doc_id", "page", "name", "kind")) > 1
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), r"\W+", " ")), " ", "-")
    return fields.withColumn("group", F.when((F.col("kind") == "radio") | shared, F.when(bare == "", "unnamed").otherwise(bare)))


def pair_labels(fields: DataFrame, blocks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """fields (doc_id, page, field, kind, tooltip, x0, y0, x1, y1) with label, source, ambiguous and taken, from blocks (doc_id, page, block, x0, y0, x1, y1, size, text and, if known, tokens).

    Fields inside cells of tables take the label of their cell or its neighbour (cell_labels). For the others candidates
    are made and scored by a join within the page. In the order of their scores each token labels one field, so one block may
    label several; a field whose best candidates lie within RIVALS of each other takes the one that its tooltip agrees with, or
    is ambiguous. Tokens below a field and hints at its right are added to its label. Then text fields without one share
    that of the nearest field at their left in the same row, unless unused text stands between; what is left takes its
    tooltip. The choice is ordered, so it runs per page, on candidates only. blocks_left() has what no label used up.
    """
    place = ["doc_id", "page"]
    took = "array<struct<block:int,token:int>>"

    def choose(rows: list[tuple]) -> list[tuple]:
        bare = lambda t: " ".join(re.sub(r"\W+", " ", t or "").lower().split())
        every = [Candidate(*r) for r in rows]
        by_field: dict[int, list] = {}
        for c in every:
            by_field.setdefault(c.field, []).append(c)
        used: set = set()
        tokens = lambda c: {(c.block, k) for k in c.taken}
        main, more, unclear = {}, {}, set()
        for c in every:
            extra = c.source in SUPPLEMENTS
            if used & tokens(c) or (c.field in more if extra else c.field in main or c.field in unclear):
                continue
            if not extra:
                rivals = [o for o in by_field[c.field] if o.source not in SUPPLEMENTS and not used & tokens(o) and abs(o.score - c.score) <= RIVALS and o.text != c.text]
                if rivals:
                    tip = bare(c.tooltip)
                    agree = [o for o in (c, *rivals) if tip and (tip in bare(o.text) or bare(o.text) in tip)]
                    if len(agree) != 1:
                        unclear.add(c.field)
                        continue
                    c = agree[0]
            used |= tokens(c)
            (more if extra else main)[c.field] = c
        found = []
        for f in by_field:
            chosen = [x[f] for x in (main, more) if f in x]
            if f in main or (f in more and more[f].source == "below"):
                found.append((f, " ".join(c.text.strip() for c in chosen), chosen[0].source, False, [{"block": b, "token": k} for c in chosen for b, k in sorted(tokens(c))]))
            elif f in unclear:
                found.append((f, None, None, True, []))
        return found

    if cells is None:
        in_cells, loose = None, fields
    else:
        in_cells = cell_labels(fields.where("kind <> 'button'"), cells)
        loose = fields.join(in_cells, [*place, "field"], "left_anti")
    chosen = cut(per_group(label_candidates(loose, blocks), place, list(Candidate._fields), choose, f"doc_id long, page int, field int, label string, source string, ambiguous boolean, taken {took}"))
    paired = loose.join(chosen, [*place, "field"], "left")
    mate = paired.where(F.col("label").isNotNull() & F.col("source").isin("left", "inside", "above", "caption")).select(*place, F.col("x1").alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"), F.col("label").alias("_label"), F.col("source").alias("_source"))
    alone = paired.where(F.col("label").isNull() & ~F.coalesce("ambiguous", F.lit(False)) & ~F.col("kind").isin("checkbox", "radio", "button", "signature"))
    beside = (F.col("_x1") <= F.col("x0") + 2) & (F.least("y1", "_y1") - F.greatest("y0", "_y0") >= 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0")))
    nearest = alone.join(mate, place).where(beside).groupBy(*place, "field").agg(F.max_by(F.struct("_label", "_source", "_x1", "_y0", "_y1"), "_x1").alias("_m"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("y1").alias("y1"))
    kept = blocks_left(blocks, chosen).select(*place, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    between = [nearest[c] == kept[c] for c in place] + [F.least("x0", "bx1") - F.greatest("_m._x1", "bx0") > 2, F.least(F.greatest("y1", "_m._y1"), F.col("by1")) > F.greatest(F.least("y0", "_m._y0"), F.col("by0"))]
    shared = nearest.join(kept, between, "left_anti").select(*place, "field", "_m")
    label = F.coalesce("label", "_m._label", F.col("tooltip"))
    source = F.when(F.col("label").isNotNull(), F.col("source")).when(F.col("_m").isNotNull(), F.concat("_m._source", F.lit("_shared"))).when(F.col("tooltip").isNotNull(), "tooltip").otherwise("none")
    none = F.array().cast(took)
    found = paired.join(shared, [*place, "field"], "left").select(*fields.columns, label.alias("label"), source.alias("source"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce("taken", none).alias("taken"))
    if in_cells is None:
        return found
    return found.unionByName(fields.join(in_cells, [*place, "field"]).select(*fields.columns, F.col("cell_label").alias("label"), F.col("cell_source").alias("source"), F.lit(False).alias("ambiguous"), none.alias("taken")))


def blocks_left(blocks: DataFrame, paired: DataFrame) -> DataFrame:
    """blocks with the box, text and tokens of what pair_labels() did not use up; a block of which nothing is left goes."""
    place = ["doc_id", "page"]
    gone = paired.select(*place, F.explode("taken").alias("t")).select(*place, "t.block", "t.token").groupBy(*place, "block").agg(F.collect_set("token").alias("_gone"))
    rows = with_tokens(blocks).join(gone, [*place, "block"], "left")
    left = rows.withColumn("tokens", F.filter("tokens", lambda t, k: ~F.coalesce(F.array_contains("_gone", k), F.lit(False)))).where(F.size("tokens") > 0)
    side = lambda name, pick: F.when(F.col("_gone").isNull(), F.col(name)).otherwise(pick(F.transform("tokens", lambda t: t[name])))
    cut_box = {c: side(c, pick) for c, pick in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))}
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("tokens", lambda t: t["text"]), " "))
    return left.withColumns({**cut_box, "text": text}).drop("_gone")
