"""Page sequences: selection, insertion, order, numbering, labels and splits. A sequence is (doc_id, page, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def parse_range(text: Column, n: Column | int) -> Column:
    """Pages (from 1) of a range such as "1-3,7"; null if an element is empty, no number, descending, out of range or out of order."""
    parts = F.split(F.replace(text, F.lit("–"), F.lit("-")), ",")
    ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int").alias("lo"), F.coalesce(F.regexp_extract(p, r"-\s*(\d+)\s*$", 1).try_cast("int"), F.regexp_extract(p, r"^\s*(\d+)\s*$", 1).try_cast("int")).alias("hi")))
    fine = F.forall(parts, lambda p: p.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$")) & F.coalesce(F.forall(ends, lambda e: (e["lo"] >= 1) & (e["lo"] <= e["hi"]) & (e["hi"] <= n)), F.lit(False))
    pages = F.flatten(F.transform(F.filter(ends, lambda e: e["lo"] <= e["hi"]), lambda e: F.sequence(e["lo"], e["hi"])))
    return F.when(fine & (pages == F.array_sort(F.array_distinct(pages))), pages)


def renumber(rows: DataFrame, *order: str, by: str = "doc_id") -> DataFrame:
    """Dense pages from 0 in the given order."""
    return rows.withColumn("page", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def keep_pages(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages listed in wanted (doc_id, page), renumbered."""
    return renumber(rows.join(wanted.distinct(), ["doc_id", "page"], "left_semi").withColumn("_p", F.col("page")), "_p").drop("_p")


def delete_pages(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The other pages, renumbered; a document that would lose all of its pages keeps them."""
    marked = rows.join(gone.distinct().withColumn("_gone", F.lit(True)), ["doc_id", "page"], "left")
    all_gone = F.min(F.coalesce("_gone", F.lit(False))).over(Window.partitionBy("doc_id"))
    left = marked.withColumn("_all", all_gone).where("_all or _gone is null").withColumn("_p", F.col("page"))
    return renumber(left, "_p").drop("_p", "_gone", "_all")


def insert_pages(rows: DataFrame, new: DataFrame) -> DataFrame:
    """new (doc_id, at, n, ...) goes before page at, in the order of n."""
    own = rows.withColumns({"_at": F.col("page"), "_new": F.lit(1), "_n": F.lit(0)})
    put = new.withColumnsRenamed({"at": "_at", "n": "_n"}).withColumns({"_new": F.lit(0), "page": F.lit(None).cast("int")})
    return renumber(own.unionByName(put, allowMissingColumns=True), "_at", "_new", "_n").drop("_at", "_new", "_n")


def duplicate_pages(rows: DataFrame, wanted: DataFrame, copies: int) -> DataFrame:
    """Copies (1..100) of the wanted pages after the last of them."""
    if not 1 <= copies <= 100:
        raise ValueError("copies must be 1 to 100")
    chosen = rows.join(wanted.distinct(), ["doc_id", "page"], "left_semi")
    last = F.max("page").over(Window.partitionBy("doc_id"))
    more = chosen.withColumn("_at", last).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    all_rows = rows.withColumns({"_at": F.col("page"), "_n": F.lit(0)}).unionByName(more).withColumn("_p", F.col("page"))
    return renumber(all_rows, "_at", "_n", "_p").drop("_at", "_n", "_p")


def reorder_pages(rows: DataFrame, order: DataFrame) -> DataFrame:
    """order (doc_id, page, place) must place every page of its documents once; moved tells pages whose number changed."""
    both = rows.join(order, ["doc_id", "page"], "left")
    w = Window.partitionBy("doc_id")
    fine = (F.count("place").over(w) == F.count("*").over(w)) & (F.size(F.collect_set("place").over(w)) == F.count("*").over(w))
    placed = both.withColumn("_fine", fine).withColumn("_to", F.when(F.col("_fine"), F.row_number().over(w.orderBy("place", "page")) - 1).otherwise(F.col("page")))
    return placed.withColumn("moved", F.col("_to") != F.col("page")).withColumn("page", F.col("_to")).drop("_fine", "_to", "place")


def replace_pages(rows: DataFrame, sources: DataFrame, content: str = "text") -> DataFrame:
    """sources (doc_id, page, content) replaces the content; the rest of a page stays."""
    new = sources.select("doc_id", "page", F.col(content).alias("_new"))
    return rows.join(new, ["doc_id", "page"], "left").withColumn(content, F.coalesce("_new", content)).drop("_new")


def combine(rows: DataFrame, order: Column, into: Column) -> DataFrame:
    """Documents appended by order within each target: target, page, doc_id, source_page."""
    w = Window.partitionBy("target").orderBy("_o", "doc_id", "source_page")
    return rows.select(into.alias("target"), order.alias("_o"), "doc_id", F.col("page").alias("source_page")).withColumn("page", F.row_number().over(w) - 1).select("target", "page", "doc_id", "source_page")


def global_numbers(rows: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Running numbers over all rows in order without a single task for all: range partitions, their counts, then numbers within.

    The partitions are cut, since bounds sampled again for the counts would differ.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    shared = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = shared.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).select("_part", "_before")
    return shared.join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_n") + (start - 1)).drop("_part", "_n", "_before")


def sequential_stamp(number: Column, digits: int, prefix: str = "", suffix: str = "") -> Column:
    """The number padded with zeros; longer numbers are kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")), F.lit(suffix))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """<<name>> tokens, in any case, filled in; unknown ones stay."""
    text: Column = F.lit(template)
    for name, value in values.items():
        parts = F.split(text, f"(?i)<<{name}>>", -1)
        text = F.array_join(parts, "\x00")
        text = F.replace(text, F.lit("\x00"), value.cast("string"))
    return text


def label_pages(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """As-of: the last range (start, style, prefix, first) that starts at or before the page; without one, page + 1.

    Ranges are put among the pages and carried forward, so neither side is joined or broadcast.
    """
    columns = rows.columns
    marks = ranges.select("doc_id", F.col("start").alias("page"), F.struct("start", "style", "prefix", "first").alias("_r"))
    both = rows.withColumns({"_r": F.lit(None).cast(marks.schema["_r"].dataType), "_k": F.lit(1)}).unionByName(marks.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("page", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_now", F.last("_r", ignorenulls=True).over(w)).where("_k = 1")
    n = F.when(F.col("_now").isNull(), F.col("page") + 1).otherwise(F.col("_now.first") + F.col("page") - F.col("_now.start"))
    return found.select(*columns, F.coalesce("_now.style", F.lit("D")).alias("style"), F.coalesce("_now.prefix", F.lit("")).alias("prefix"), n.alias("number"))


def split_by_marks(rows: DataFrame, marks: DataFrame, front: str = "Front matter") -> DataFrame:
    """doc_id, page, part_no, title: each part runs from a mark (doc_id, page, title) to the next; of marks on one page the last holds."""
    one = marks.groupBy("doc_id", "page").agg(F.max_by("title", "block_no").alias("title"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.select("doc_id", "page").join(one, ["doc_id", "page"], "left")
    part = F.count("title").over(w)
    return joined.select("doc_id", "page", part.cast("int").alias("part_no"), F.coalesce(F.last("title", ignorenulls=True).over(w), F.lit(front)).alias("title"))


def split_by_size(docs: DataFrame, sizes: str, limit: int) -> DataFrame:
    """docs with parts: the part of each page. Greedy in page order; an oversized page is a part of its own."""
    zero = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        more = (acc["held"] > 0) & (acc["held"] + x > limit)
        part = F.when(more, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(F.when(more, x).otherwise(acc["held"] + x).cast("long").alias("held"), part.alias("part"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    return docs.withColumn("parts", F.aggregate(sizes, zero, step)["parts"])


def split_every(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1) / n).cast("int"))


def unique_names(rows: DataFrame, name: str, order: list[str], shape: str = " (%d)") -> DataFrame:
    """A suffix for the second and later rows of a name."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.format_string(shape, k))))


def dedupe(rows: DataFrame, key: str, payload: str, size: Column) -> DataFrame:
    """digest, canonical, copies, saved: equal payloads share their smallest key's copy."""
    by = rows.groupBy(F.sha2(payload, 256).alias("digest")).agg(F.min(key).alias("canonical"), F.count("*").alias("copies"), (F.sum(size) - F.max(size)).alias("saved"))
    return by.where("copies > 1")
