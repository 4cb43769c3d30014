"""Line dedup: repeated runs of lines, found by a suffix array; their later copies are deleted.

A text is the sequence of the ids of its lines that hold a word; blank lines are passed over and stay. A run is a
stretch of such lines in one document with ``MIN_WORDS`` words or more. A line is deleted if it lies in a run that
also occurs earlier, by (doc_id, line).

Suffix array. Only lines that occur at least twice can lie in such a run, so all others are left out first; a line's
rank is its place among the sorted 128-bit hashes of these. Prefix doubling ranks the suffixes by their first 2, 4,
8 ... lines: the rank of 2n lines is the place, in sorted order, of the pair of the ranks of n lines here and n lines
on. Pairs are counted before they are sorted; a suffix whose pair occurs once is settled and leaves. Doubling goes on
until all have left, so a repeated run of n lines takes log2(n) rounds.

Common prefixes. Suffixes with equal first n lines are an interval of the sorted suffixes. ``shared_prefixes`` finds for
each suffix the longest prefix it shares with an earlier one by halving: from the widest rank down, an interval of
common prefix n is parted by the ranks of the 2^i lines that follow. Each part of several suffixes becomes an interval
of common prefix n + 2^i, in which all but its first suffix go on; the firsts of all parts stay in the interval
before, where shorter prefixes are looked for among them: what a later member shares with a suffix outside its
part, its part's first shares too. So an interval holds one suffix more than it decides on, and the table of intervals
stays linear in the lines, whatever repeats.

The stretches found are merged by the running maximum of their ends: these are the maximal repeated runs, without
their first occurrences. Hot lines, pairs and intervals are joined apart from the others (``split_join``), so none lands
in one task.

Defined results. Null text: stays null, no lines. Empty text: stays. Null doc_id: before all others. Rows equal in
doc_id and text: one document, with the same result for each row. Rows equal in doc_id alone: documents of their own,
ordered by a hash of their texts. No rows: no rows. Extra columns are kept by ``without_later_copies``, where columns
named n_lines or n_deleted give way to the results, and dropped by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, split_join, table

MIN_WORDS = 10
OWN = ("d", "h")


def place(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def documents(docs: DataFrame, s: Scratch) -> DataFrame:
    """d, h (place in the order, hash of the text) and text of every document; repeated rows once."""
    rows = docs.where("text is not null").select(place(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("h"), "text")
    again = s.save(rows.groupBy(*OWN).agg(F.count("*").alias("n")).where("n > 1").select(*OWN))
    several = rows.join(again, list(OWN), "left_semi").groupBy(*OWN).agg(F.first("text").alias("text"))
    return rows.join(again, list(OWN), "left_anti").unionByName(several)


def line_rows(docs: DataFrame) -> DataFrame:
    """d, h, k (place among lines with a word), line (place among all), words, x and y (hashes) of every line with a word."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit("[^ \\t-\\r]+")).alias("words"), F.xxhash64(x).alias("x"), F.xxhash64(F.lit(1), x).alias("y")))
    return docs.select(*OWN, F.posexplode(F.filter(lines, lambda x: x["words"] > 0)).alias("k", "z")).select(*OWN, "k", "z.line", "z.words", "z.x", "z.y")


def ranked(rows: DataFrame, by: list[str], total: int, s: Scratch) -> DataFrame:
    """rows that share their values of by, with the place r of these in sorted order."""
    often = s.save(rows.groupBy(*by).agg(F.count("*").alias("many")).where("many > 1").orderBy(*by).withColumn("r", F.monotonically_increasing_id()))
    found = s.save(split_join(rows, often, by, "many", total).drop(*by, "many"))
    s.free(often)
    return found


def suffix_ranks(first: DataFrame, total: int, s: Scratch) -> list[DataFrame]:
    """From d, h, k, r of single lines: tables d, h, k, r for 1, 2, 4 ... lines, each of the suffixes whose stretch occurs again.

    If a stretch occurs again, so do all inside it; a row that is missing between k and k + step thus means that the
    pair cannot occur again either.
    """
    levels, step = [first], 1
    order = Window.partitionBy(*OWN).orderBy("k")
    while not levels[-1].isEmpty():
        pairs = levels[-1].select(*OWN, "k", F.col("r").alias("a"), F.when(F.lead("k", step).over(order) == F.col("k") + step, F.lead("r", step).over(order)).alias("b"))
        pairs = s.save(pairs.where("b is not null"))
        levels.append(ranked(pairs, ["a", "b"], total, s))
        s.free(pairs)
        step *= 2
    s.free(levels.pop())
    return levels


def shared_prefixes(levels: list[DataFrame], total: int, s: Scratch) -> DataFrame | None:
    """d, h, k, n: the number n > 0 of lines from k on that an earlier suffix shares; None if there are no ranks.

    Rows of the working table: a suffix (d, h, k) in an interval (node) of common prefix n; decides: whether its own
    length is looked for there, which holds in one interval for every suffix. The interval of prefix 0 is not written.
    """
    at = [*OWN, "k"]
    held = None
    for i in reversed(range(len(levels))):
        ranks, known = levels[i], held
        if known is None:
            parted, apart = ranks, None
        else:
            parted = ranks.join(known.where("decides").select(*at).hint("merge"), at, "left_anti")
            there = ranks.select(*OWN, F.col("k").alias("to"), "r")
            met = s.save(known.withColumn("to", F.col("k") + F.col("n")).join(there.hint("merge"), [*OWN, "to"], "left").drop("to"))
            apart = met.where("r is null").drop("r")
        parted = parted.select(*at, F.lit(0).cast("long").alias("node"), F.lit(0).alias("n"), F.lit(True).alias("decides"), "r")
        parted = s.save(parted if known is None else parted.unionByName(met.where("r is not null")))
        parts = parted.groupBy("node", "r").agg(F.count("*").alias("many"), F.min(F.struct(*at)).alias("first")).where("many > 1")
        parts = s.save(parts.withColumn("part", F.monotonically_increasing_id() + F.lit((i + 1) << 56)))
        own = split_join(parted, parts, ["node", "r"], "many", 2 * total, "left")
        is_first, alone = F.struct(*at) == F.col("first"), F.col("part").isNull()
        stays = F.when((F.col("node") != 0) & (alone | is_first), F.struct("node", "n", "decides"))
        goes = F.when(~alone, F.struct(F.col("part").alias("node"), (F.col("n") + (1 << i)).alias("n"), (F.col("decides") & ~is_first).alias("decides")))
        now = own.select(*at, F.explode(F.array_compact(F.array(stays, goes))).alias("z")).select(*at, "z.*")
        held = s.save(now if apart is None else now.unionByName(apart))
        s.free(parted, parts, *([] if known is None else [known, met]))
    return None if held is None else held.where("decides").select(*at, "n")


def lines_needed(words: Column, min_words: int) -> Column:
    """How many of the numbers, from the first on, reach min_words; null if all do not."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
    found = F.aggregate(words, begin, lambda acc, x: F.when(acc["words"] >= min_words, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["words"] + x).alias("words"))))
    return F.when(found["words"] >= min_words, found["n"])


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, gone (for each line up to the last deleted one: whether it is deleted) of every document with any."""
    min_words = max(min_words, 1)
    s = Scratch(docs.sparkSession)
    every = s.save(line_rows(documents(docs, s)))
    total = every.count()
    rows = ranked(every, ["x", "y"], total, s)
    s.free(every)
    levels = suffix_ranks(rows.select(*OWN, "k", "r"), total, s) if total else []
    shared = shared_prefixes(levels, total, s)
    if shared is None:
        shared = rows.select(*OWN, "k", F.lit(None).cast("int").alias("n"))
    order = Window.partitionBy(*OWN).orderBy("k")
    need = lines_needed(F.collect_list("words").over(order.rowsBetween(0, min_words - 1)), min_words)
    ends = rows.join(shared.hint("merge"), [*OWN, "k"], "left").select(*OWN, "k", "line", F.when(F.col("n") >= need, F.col("k") + F.col("n") - 1).alias("end"))
    inside = ends.withColumn("end", F.max("end").over(order)).where("end >= k")
    spaced = inside.select(*OWN, "line", (F.col("line") - F.lag("line", 1, -1).over(order) - 1).alias("kept_before"))
    flags = F.transform(F.array_sort(F.collect_list(F.struct("line", "kept_before"))), lambda x: F.concat(F.array_repeat(F.lit(False), x["kept_before"]), F.array(F.lit(True))))
    found = s.save(spaced.groupBy(*OWN).agg(F.flatten(flags).alias("gone")))
    s.free(rows, *levels[1:])
    return found


def without_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies taken out of text, and n_lines and n_deleted."""
    gone = later_copies(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_words)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"), place(F.col("doc_id")).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    found = rows.join(gone.hint("merge"), list(OWN), "left")
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_deleted": F.coalesce(F.array_size(F.filter("gone", lambda x: x)), F.lit(0)).cast("long")}
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return found.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts), *(c.alias(n) for n, c in counts.items()))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, text without the later copies."""
    return without_later_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs go, and n_chars follows; a document of which no word is left goes with them."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = without_later_copies(packed).where(~((F.col("n_deleted") > 0) & ~F.col("text").rlike("[^ \\t-\\r]")))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None
    return found.select(*(F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))


OP5_SQL = r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS line FROM p),
l AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM u),
c AS (
  SELECT *, row_number() OVER w AS k, sum(words) OVER w AS total FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
starts AS (
  SELECT a.doc_id, a.k, min(b.k) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 9 AND b.total - a.total + a.words >= 10 GROUP BY ALL),
ends AS (
  SELECT b.doc_id, max(a.k) AS k, b.k AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 9 AND b.total - a.total + a.words >= 10 GROUP BY b.doc_id, b.k),
runs AS (SELECT * FROM starts UNION SELECT * FROM ends),
said AS (
  SELECT r.doc_id, r.k, r.e, string_agg(c.x, chr(10) ORDER BY c.k) AS content
  FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.k BETWEEN r.k AND r.e GROUP BY ALL),
later AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT c.doc_id, c.line FROM later JOIN c ON c.doc_id = later.doc_id AND c.k BETWEEN later.k AND later.e),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_deleted, coalesce(string_agg(l.x, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, kept.text AS text
FROM documents LEFT JOIN kept USING (doc_id)
"""
