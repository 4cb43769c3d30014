"""Comments as XML elements: one mapping that the writer and the reader share.

A comment has the columns page (from 0), idx, subtype, rect (array of four numbers), and any of OPTIONAL; doc_id, if there
is one, is written as the attribute document. Other columns are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element names by subtype, names of flag bits, and attributes by column (plain strings).
TAGS = {"Text": "text", "FreeText": "freetext", "Line": "line", "Square": "square", "Circle": "circle", "Polygon": "polygon", "PolyLine": "polyline", "Highlight": "highlight", "Underline": "underline",
        "Squiggly": "squiggly", "StrikeOut": "strikeout", "Stamp": "stamp", "Caret": "caret", "Ink": "ink", "FileAttachment": "fileattachment", "Sound": "sound"}
FLAGS = {1: "invisible", 2: "hidden", 4: "print", 8: "nozoom", 16: "norotate", 32: "noview", 64: "readonly", 128: "locked", 256: "togglenoview"}
STRINGS = {"author": "title", "subject": "subject", "modified": "date", "created": "creationdate", "state": "state", "state_model": "statemodel", "intent": "intent", "icon": "icon"}
OPTIONAL = {"name": "string", "parent": "string", "reply": "string", "flags": "int", "color": "array<double>", "fill": "array<double>", "opacity": "double", "width": "double", "quads": "array<double>", "contents": "string"} | dict.fromkeys(STRINGS, "string")
ATTRIBUTES = ["document", "page", "rect", "name", "flags", *STRINGS.values(), "color", "interior-color", "opacity", "width", "inreplyto", "replyType", "coords"]
SCHEMA = ", ".join([*(f"`_{a}` string" for a in ATTRIBUTES), "contents string"])
#: Characters that XML cannot hold.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"


def number_text(x: Column) -> Column:
    """At most three decimals, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", x.cast("double")), r"\.?0+$", "")


def numbers_text(xs: Column) -> Column:
    return F.when(xs.isNotNull(), F.array_join(F.transform(xs, lambda x: number_text(F.coalesce(x, F.lit(0.0)))), ","))


def numbers(text: Column) -> Column:
    """The numbers of a list by commas, semicolons or space; what is none counts as 0; null stays null."""
    return F.transform(F.filter(F.split(text, r"[,;\s]+"), lambda x: x != ""), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def color_text(c: Column) -> Column:
    """#RRGGBB of one (grey), three (red, green, blue) or four numbers (cyan, magenta, yellow, black) from 0 to 1; null for others."""
    at = lambda k: F.get(c, F.lit(k))
    rgb = F.when(F.size(c) == 1, F.array(at(0), at(0), at(0))).when(F.size(c) == 3, c).when(F.size(c) == 4, F.array(*((1 - at(k)) * (1 - at(3)) for k in range(3))))
    part = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(x * 255).cast("int")))), 2, "0")
    return F.when(rgb.isNotNull(), F.concat(F.lit("#"), F.array_join(F.transform(rgb, part), "")))


def color(text: Column) -> Column:
    digits = F.regexp_extract(text, r"^\s*#*([0-9A-Fa-f]{6})\s*$", 1)
    return F.when(digits != "", F.array(*(F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5))))


def elements(comments: DataFrame, prefix: str = "comment") -> DataFrame:
    """tag, element (attributes with _ before their names, contents) of the comments whose subtype has an element.

    A comment without a name gets <prefix>-<page>-<idx>. The corners of a box are put in order; flags of 0, empty strings and
    colours of another number of parts are left out; a reply names its parent, and its type only if that is Group.
    """
    known = comments.select(*comments.columns, *(F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in comments.columns))
    tag = functools.reduce(lambda got, st: F.when(F.col("subtype") == st[0], st[1]).otherwise(got), TAGS.items(), F.lit(None).cast("string"))
    said = lambda c: F.nullif(F.regexp_replace(c, NOT_XML, ""), F.lit(""))
    r = lambda k: F.coalesce(F.get("rect", F.lit(k)).cast("double"), F.lit(0.0))
    box = F.array(F.least(r(0), r(2)), F.least(r(1), r(3)), F.greatest(r(0), r(2)), F.greatest(r(1), r(3)))
    box = F.when(F.size("rect") == 4, box).otherwise(F.array(*[F.lit(0.0)] * 4))
    flags = F.array_join(F.array_compact(F.array(*(F.when(F.col("flags").bitwiseAND(bit) != 0, name) for bit, name in FLAGS.items()))), ",")
    values = {
        "document": F.col("doc_id").cast("string") if "doc_id" in comments.columns else F.lit(None).cast("string"),
        "page": F.col("page").cast("string"), "rect": numbers_text(box), "name": F.coalesce(said(F.col("name")), F.concat_ws("-", F.lit(prefix), "page", "idx")), "flags": F.nullif(flags, F.lit("")),
        **{a: said(F.col(c)) for c, a in STRINGS.items()},
        "color": color_text(F.col("color")), "interior-color": color_text(F.col("fill")), "opacity": F.when(F.col("opacity").isNotNull(), number_text(F.col("opacity"))), "width": F.when(F.col("width").isNotNull(), number_text(F.col("width"))),
        "inreplyto": said(F.col("parent")), "replyType": F.when(said(F.col("parent")).isNotNull() & (F.col("reply") == "Group"), "group"), "coords": numbers_text(F.col("quads")),
    }
    element = F.struct(*(values[a].alias(f"_{a}") for a in ATTRIBUTES), said(F.col("contents")).alias("contents"))
    return known.select(tag.alias("tag"), element.alias("element")).where("tag is not null")


def from_elements(found: DataFrame) -> DataFrame:
    """The comments of elements(): doc_id, page, subtype, rect and OPTIONAL.

    Elements of an unknown name and those without a box of four numbers are passed over. No flags: print. Opacity is held
    within 0 and 1, and is 1 where it is no number. A colour that is not six hexadecimal digits is null.
    """
    a = lambda name: F.nullif(F.col("element")[f"_{name}"], F.lit(""))
    subtype = functools.reduce(lambda got, st: F.when(F.col("tag") == st[1], st[0]).otherwise(got), TAGS.items(), F.lit(None).cast("string"))
    names = F.transform(F.split(F.coalesce(a("flags"), F.lit("print")), ","), lambda x: F.lower(F.trim(x)))
    flags = functools.reduce(lambda got, bn: got + F.when(F.array_contains(names, bn[1]), bn[0]).otherwise(0), FLAGS.items(), F.lit(0))
    real = lambda text, default: F.when(text.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(default)))
    rows = found.select(
        a("document").try_cast("long").alias("doc_id"), F.coalesce(a("page").try_cast("double"), F.lit(0.0)).cast("int").alias("page"), subtype.alias("subtype"), numbers(a("rect")).alias("rect"), a("name").alias("name"), a("inreplyto").alias("parent"),
        F.when(a("inreplyto").isNotNull(), F.when(F.lower(a("replyType")) == "group", "Group").otherwise("R")).alias("reply"), flags.alias("flags"), color(a("color")).alias("color"), color(a("interior-color")).alias("fill"),
        F.when(a("opacity").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), real(a("opacity"), 1.0)))).alias("opacity"), real(a("width"), 1.0).alias("width"), numbers(a("coords")).alias("quads"), F.nullif(F.col("element")["contents"], F.lit("")).alias("contents"),
        *(a(attribute).alias(c) for c, attribute in STRINGS.items()),
    )
    return rows.where("subtype is not null and size(rect) = 4")


def write_comments(comments: DataFrame, path: str, prefix: str = "comment") -> None:
    """XML files below path, a folder for each element name that occurs (there are len(TAGS) at most)."""
    rows = elements(comments, prefix)
    for (tag,) in rows.select("tag").distinct().collect():
        rows.where(F.col("tag") == tag).select("element.*").write.format("xml").option("rootTag", "annots").option("rowTag", tag).save(f"{path}/{tag}")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """The comments of XML files at or below path; files are split between tasks, and read once an element name."""
    def of(tag: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("ignoreSurroundingSpaces", False).option("recursiveFileLookup", True).schema(SCHEMA).load(path)
        return rows.select(F.lit(tag).alias("tag"), F.struct(*rows.columns).alias("element"))

    return from_elements(functools.reduce(DataFrame.unionByName, map(of, TAGS.values())))
