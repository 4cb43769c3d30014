"""Boxes, colours, comment kinds, document dates and superscripts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of comments by subtype, and by subtype and intent.
KINDS = {"Text": "note", "Highlight": "highlight", "Underline": "underline", "StrikeOut": "strikeout", "Squiggly": "squiggly", "FreeText": "text box", "Caret": "insert", "Stamp": "stamp", "Ink": "drawing",
         "Line": "line", "Square": "rectangle", "Circle": "oval", "Polygon": "polygon", "PolyLine": "polyline", "FileAttachment": "attachment"}
INTENTS = {("StrikeOut", "StrikeOutTextEdit"): "replace", ("Caret", "Replace"): "replace", ("FreeText", "FreeTextCallout"): "callout", ("Line", "LineArrow"): "arrow", ("Polygon", "PolygonCloud"): "cloud"}


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box whose corners are in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def intersect(a: Column, b: Column) -> Column:
    """Null where the boxes do not overlap."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def inset(a: Column, by: float, least: float = 1.0) -> Column:
    """Smaller by `by` on each side; a side below `least` grows around its centre."""
    def side(lo: Column, hi: Column) -> tuple[Column, Column]:
        small = hi - lo - 2 * by < least
        return F.when(small, (lo + hi) / 2 - least / 2).otherwise(lo + by), F.when(small, (lo + hi) / 2 + least / 2).otherwise(hi - by)

    (x0, x1), (y0, y1) = side(a["x0"], a["x1"]), side(a["y0"], a["y1"])
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(a: Column) -> Column:
    return F.coalesce((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), F.lit(0.0))


def comment_kind(subtype: Column, intent: Column) -> Column:
    kind = F.lit("other")
    for s, k in KINDS.items():
        kind = F.when(subtype == s, k).otherwise(kind)
    for (s, i), k in INTENTS.items():
        kind = F.when((subtype == s) & (intent == i), k).otherwise(kind)
    return kind


def document_date(text: Column) -> Column:
    """Seconds since 1970 (UTC) of D:YYYYMMDDHHmmSS with an optional offset such as +02'30'; null if unreadable."""
    rule = r"^D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+\-Z])(?:(\d{2})'?(\d{2})?'?)?)?$"
    part = lambda k, default: F.coalesce(F.regexp_extract(text, rule, k).try_cast("int"), F.lit(default))
    day = F.concat_ws("-", F.lpad(part(1, 0).cast("string"), 4, "0"), F.lpad(part(2, 1).cast("string"), 2, "0"), F.lpad(part(3, 1).cast("string"), 2, "0")).try_cast("date")
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + part(4, 0) * 3600 + part(5, 0) * 60 + part(6, 0)
    offset = part(8, 0) * 3600 + part(9, 0) * 60
    sign = F.regexp_extract(text, rule, 7)
    return F.when(text.rlike(rule), F.when(sign == "+", seconds - offset).when(sign == "-", seconds + offset).otherwise(seconds))


def superscript(text: Column) -> Column:
    return F.translate(text, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def drop_leaders(text: Column) -> Column:
    """Three dots or more vanish with the space around them."""
    return F.regexp_replace(text, r"\s*(?:[.…] ?){3,}\s*", " ")
