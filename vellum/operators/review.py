"""Review comments: threads, states, filters, merges and comparisons. A comment is (doc_id, idx, name, parent, author, contents, ...)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def threads(comments: DataFrame) -> DataFrame:
    """comments that are no status rows, with root and depth: parents are followed by doubling the distance each round.

    A parent that is missing, or a status row, makes a root. A chain of n takes log2(n) rounds. Comments on a cycle of
    replies, or below one, have no root: each becomes its own, at depth 0.
    """
    own = comments.where(~F.col("is_status"))
    names = own.select(F.col("doc_id"), F.col("name").alias("parent")).distinct().withColumn("_there", F.lit(True))
    up = own.join(names, ["doc_id", "parent"], "left").select(*own.columns, F.when(F.col("_there"), F.col("parent")).alias("_up"))
    jump = cut(up.select("doc_id", "name", F.coalesce("_up", "name").alias("root"), F.when(F.col("_up").isNull(), 0).otherwise(1).alias("depth"), F.col("_up").isNull().alias("done")).dropDuplicates(["doc_id", "name"]))
    left = jump.where("not done").count()
    while left:
        far = jump.select("doc_id", F.col("name").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = jump.where("not done").join(far, ["doc_id", "root"]).select("doc_id", "name", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        jump = cut(jump.where("done").unionByName(moved))
        before, left = left, jump.where("not done").count()
        if left == before:  # what does not get nearer to a root is on a cycle or below one
            break
    settled = jump.select("doc_id", "name", F.when(F.col("done"), F.col("root")).otherwise(F.col("name")).alias("root"), F.when(F.col("done"), F.col("depth")).otherwise(0).alias("depth"))
    return own.join(settled, ["doc_id", "name"])


def thread_texts(threaded: DataFrame) -> DataFrame:
    """doc_id, root, replies, thread_text (in the order of idx)."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "contents")))
    by = threaded.groupBy("doc_id", "root").agg((F.count("*") - 1).alias("replies"), rows.alias("_rows"))
    return by.select("doc_id", "root", "replies", F.array_join(F.transform("_rows", lambda r: r["contents"]), "\n").alias("thread_text"))


def latest_status(status: DataFrame) -> DataFrame:
    """doc_id, parent, state, author: the last status row of each comment; of equal times the later row."""
    last = F.max_by(F.struct("contents", "author"), F.struct("minute", "idx"))
    return status.groupBy("doc_id", "parent").agg(last.alias("s")).select("doc_id", "parent", F.col("s.contents").alias("state"), F.col("s.author").alias("author"))


def review_filter(threaded: DataFrame, terms: str = "", author: str | None = None, kind: str | None = None, state: str | None = None, marked: bool | None = None, status: DataFrame | None = None) -> DataFrame:
    """Root comments that pass every filter that is set, with their thread text.

    Every term (any case) must occur in the thread text, the author or the column quote; author and kind must be equal;
    marked must be that of the column marked (null: not marked); state must be the comment's last one in status
    (doc_id, parent, contents, author, minute, idx), "none" where it has none.
    """
    own = [c for c in ("kind", "quote", "marked") if c in threaded.columns]
    roots = threaded.where("depth = 0").select("doc_id", "name", "author", *own).join(thread_texts(threaded).withColumnRenamed("root", "name"), ["doc_id", "name"])
    where = F.lit(True)
    for w in terms.lower().split():
        where = where & (F.lower("thread_text").contains(w) | F.lower(F.coalesce("author", F.lit(""))).contains(w) | (F.lower(F.coalesce("quote", F.lit(""))).contains(w) if "quote" in own else F.lit(False)))
    if author is not None:
        where = where & (F.col("author") == author)
    if kind is not None:
        where = where & (F.col("kind") == kind)
    if marked is not None:
        where = where & (F.coalesce("marked", F.lit(False)) == marked)
    found = roots.where(where)
    if state is None:
        return found
    if status is None:
        raise ValueError("a filter by state needs the status rows")
    last = latest_status(status).select("doc_id", F.col("parent").alias("name"), "state")
    return found.join(last, ["doc_id", "name"], "left").withColumn("state", F.coalesce("state", F.lit("none"))).where(F.col("state") == state)


def sort_keys(order: str) -> list[Column]:
    """Document order breaks every tie."""
    place = [F.col("doc_id"), F.col("page"), F.col("idx")]
    return {"page": place, "newest": [F.desc("minute"), *place], "oldest": [F.asc("minute"), *place], "author": [F.lower("author"), *place]}[order]


def comment_summary(threaded: DataFrame) -> DataFrame:
    """doc_id, page, comments (roots), replies, first_number: roots are numbered through the pages of a document."""
    by = threaded.groupBy("doc_id", "page").agg(F.sum((F.col("depth") == 0).cast("long")).alias("comments"), F.sum((F.col("depth") > 0).cast("long")).alias("replies"))
    w = Window.partitionBy("doc_id").orderBy("page")
    return by.withColumn("first_number", F.sum("comments").over(w) - F.col("comments") + 1)


def import_comments(target: DataFrame, incoming: DataFrame, pages: int) -> DataFrame:
    """target and the incoming rows whose name is new and whose page exists; a second import adds nothing. Of incoming rows with one name the first by idx counts."""
    new = incoming.where((F.col("page") >= 0) & (F.col("page") < pages)).join(target.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    one = new.groupBy("doc_id", "name").agg(F.min_by(F.struct(*(c for c in new.columns if c not in ("doc_id", "name"))), "idx").alias("_r")).select("doc_id", "name", "_r.*")
    both = target.withColumn("imported", F.lit(False)).unionByName(one.select(*target.columns).withColumn("imported", F.lit(True)))
    parents = both.select("doc_id", F.col("name").alias("parent")).distinct().withColumn("_there", F.lit(True))
    return both.join(parents, ["doc_id", "parent"], "left").withColumn("parent", F.when(F.col("_there"), F.col("parent"))).select(*target.columns, "imported")


def compare_comments(ours: DataFrame, theirs: DataFrame, extra: tuple[str, ...] = (), within: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, name, change (added, removed, changed, unchanged), fields: by name, then by (page, author), then by (page, text); each row is used once.

    Compared are page, author, contents and the extra columns (colour, state, opacity, ...); numbers in within, such as a
    position, count as changed if they differ by more than its value.
    """
    compared = ("page", "author", "contents", *extra)
    left = ours.select("doc_id", F.col("name").alias("a"), F.struct(*compared).alias("x"))
    right = theirs.select("doc_id", F.col("name").alias("b"), F.struct(*compared).alias("y"))
    named = left.join(right, (left["doc_id"] == right["doc_id"]) & (left["a"] == right["b"])).select(left["doc_id"], "a", "b", "x", "y")
    matched = named
    for fields in (("page", "author"), ("page", "contents")):
        l = left.join(matched.select("doc_id", "a"), ["doc_id", "a"], "left_anti")  # noqa: E741
        r = right.join(matched.select("doc_id", "b"), ["doc_id", "b"], "left_anti")
        if "contents" in fields:
            l, r = l.where("x.contents <> ''"), r.where("y.contents <> ''")  # noqa: E741
        key = [f"_k{i}" for i in range(len(fields))]
        l = l.withColumns({k: F.col(f"x.{f}") for k, f in zip(key, fields, strict=True)})  # noqa: E741
        r = r.withColumns({k: F.col(f"y.{f}") for k, f in zip(key, fields, strict=True)})
        l = l.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("a")))  # noqa: E741
        r = r.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("b")))
        matched = matched.unionByName(l.join(r, ["doc_id", *key, "_n"]).select("doc_id", "a", "b", "x", "y"))
    shown = lambda side, f: F.coalesce(F.nullif(F.col(f"{side}.{f}").cast("string"), F.lit("")), F.lit(""))

    def differs(f: str) -> Column:
        apart = ~shown("x", f).eqNullSafe(shown("y", f))
        return apart & F.coalesce(F.abs(F.col(f"x.{f}") - F.col(f"y.{f}")) > within[f], F.lit(True)) if f in (within or {}) else apart

    fields = F.array_compact(F.array(*(F.when(differs(f), f) for f in compared)))
    pairs = matched.select("doc_id", F.col("a").alias("name"), F.when(F.size(fields) > 0, "changed").otherwise("unchanged").alias("change"), F.array_join(fields, ",").alias("fields"))
    gone = left.join(matched.select("doc_id", "a"), ["doc_id", "a"], "left_anti").select("doc_id", F.col("a").alias("name"), F.lit("removed").alias("change"), F.lit("").alias("fields"))
    new = right.join(matched.select("doc_id", "b"), ["doc_id", "b"], "left_anti").select("doc_id", F.col("b").alias("name"), F.lit("added").alias("change"), F.lit("").alias("fields"))
    return pairs.unionByName(gone).unionByName(new)


def apply_edits(comments: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (doc_id, name, action, contents): update, add and delete against the state before; deletes take replies with them.

    An unknown action, or an update or delete of a comment that is not there, fails the whole batch.
    """
    known = comments.select("doc_id", "name").withColumn("_there", F.lit(True))
    checked = edits.join(known, ["doc_id", "name"], "left")
    bad = ~F.col("action").isin("add", "update", "delete") | (F.col("action").isin("update", "delete") & F.col("_there").isNull())
    checked = checked.where(F.when(bad, F.raise_error(F.concat(F.lit("bad edit of "), F.col("name"))).cast("boolean")).otherwise(True))
    updates = checked.where("action = 'update'").select("doc_id", "name", F.col("contents").alias("_new"))
    adds = checked.where("action = 'add' and _there is null").select("doc_id", "name", "contents")
    changed = comments.join(updates, ["doc_id", "name"], "left").withColumn("contents", F.coalesce("_new", "contents")).drop("_new")
    whole = changed.unionByName(adds, allowMissingColumns=True)
    gone = checked.where("action = 'delete'").select("doc_id", "name")
    found = gone
    links = comments.where("parent is not null").select("doc_id", "name", "parent")
    while True:
        below = cut(links.join(found.withColumnRenamed("name", "parent"), ["doc_id", "parent"], "left_semi").select("doc_id", "name").join(gone, ["doc_id", "name"], "left_anti"))
        if below.isEmpty():
            break
        gone, found = gone.unionByName(below), below
    return whole.join(gone.distinct(), ["doc_id", "name"], "left_anti")
