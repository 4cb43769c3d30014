"""Document fingerprints by closed syncmers.

A k-mer (``K`` bytes of UTF-8) is a closed syncmer if the least of its inner s-mers (``S`` bytes, by hash) stands at its first or
last place. All of them are anchors. Whether one is chosen depends on nothing outside it, so a passage keeps its anchors wherever it
stands, and any ``K - S + 1`` k-mers in a row hold an anchor. A text is worked off in chunks that overlap by K - 1 bytes, inside its
row; the result is that of the whole text. A fingerprint holds the ``KEPT`` distinct anchors of least hash, each with its first
position: 32 bits of hash and 32 of position. It is a sketch: how far two of them meet estimates how far all anchors do. With
``kept=None`` it holds every anchor, and the likeness is exact.

The likeness of two fingerprints looks at the KEPT least anchors of both together. An anchor in both counts if it stands at the
same place, or if another anchor is displaced by the same distance. With the share J of those that count, likeness is
2 J / (1 + J): two equal texts have 1, two texts that share one of their halves about 0.5, texts without a common passage 0.

The edited text's anchors are those of the part that stays, those of the part taken over, and those that hold bytes of both; the
first are sorted out while a text's own anchors are at hand.

The next document is found without a task for all rows: keys are numbered by range partitions and their counts, and only
texts are shuffled, once whole and once as the prefix that the neighbour takes over. Everything is native.

Defined results. Null or empty text: an empty fingerprint, which equals itself (1) and nothing else (0). Texts without an anchor, as
those below K bytes: one, the whole text. Null doc_id: after all others. Equal doc_ids: by hash of the text. Repeated rows: each is
followed by its repetition, the last one by the next document. One row: it follows itself. No rows: no rows. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, S, KEPT = 32, 23, 48
#: Anchors are not chosen by their hash: all lie below.
LEAST = 1 << 63
CHUNK = 4096
LOW = (1 << 32) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def least(values: Column, kept: int | None) -> Column:
    """The kept least distinct hashes of packed anchors (None: all), each at its least position."""
    distinct = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(s, i - 1), 32)))
    found = let(F.sort_array(values), distinct)
    return found if kept is None else F.slice(found, 1, kept)


def anchors(piece: Column, start: Column) -> Column:
    """Packed anchors of a piece of at least K bytes that stands at start: all closed syncmers in it."""
    others = K - S  # s-mers of a k-mer but the first or the last

    def lows(v: Column, width: int, body: Callable[[Column], Column]) -> Column:
        """body of the least of the ``others`` hashes from each place on, as v holds the least of width; at the end those there are."""
        if width == others:
            return body(v)
        wide = min(3 * width, others)
        lesser = F.transform(v, lambda x, i: F.least(x, *(F.get(v, i + by) for by in sorted({min(width, wide - width), wide - width}))))
        return let(lesser, lambda w: lows(w, wide, body))

    def chosen(h: Column, low: Column) -> Column:
        closed = lambda x, i: (F.get(h, i + others) <= x) | (F.get(h, i) <= F.get(low, i + 1))
        # a place that no whole k-mer starts at has no hash at i + others
        places = F.transform(low, lambda x, i: F.when(F.get(h, i + others).isNotNull() & closed(x, i), i))
        return F.transform(F.filter(places, lambda i: i.isNotNull()), lambda i: packed(F.substring(piece, i + 1, F.lit(K)), start + i))

    smers = F.transform(F.sequence(F.lit(1), F.octet_length(piece) - (S - 1)), lambda i: F.xxhash64(F.substring(piece, i, F.lit(S))))
    return let(smers, lambda h: lows(h, 1, lambda low: chosen(h, low)))


def packed(kmer: Column, at: Column) -> Column:
    return F.shiftleft(F.shiftright(F.xxhash64(kmer), 32), 32).bitwiseOR(at.cast("long"))


def within(b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(piece, start) of each chunk of bytes of which there are K at least; none of fewer."""
    chunk = lambda c: let(F.substring(b, c * CHUNK + 1, F.lit(CHUNK + K - 1)), lambda piece: body(piece, c * CHUNK))
    last = F.floor((F.octet_length(b) - K) / CHUNK).cast("int")
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), chunk)


def sketch(text: Column, kept: int | None = KEPT) -> Column:
    """The kept least anchors of a text; none of a text without."""
    each = lambda piece, start: least(anchors(piece, start), kept)
    return let(text.cast("binary"), lambda b: least(F.flatten(within(b, each)), kept))


def sketches(text: Column, stays: Column, kept: int | None = KEPT) -> Column:
    """The sketches of a text and of its first ``stays`` bytes, in one array: a struct's unused field would be cut off."""
    both = lambda v: F.array(*(least(F.flatten(F.transform(v, lambda x: F.get(x, F.lit(k)))), kept) for k in (0, 1)))

    def of(b: Column, last: Column) -> Column:
        head = lambda v: F.filter(v, lambda x: x.bitwiseAND(F.lit(LOW)) <= last)
        each = lambda piece, start: let(anchors(piece, start), lambda v: F.array(least(v, kept), least(head(v), kept)))
        return let(within(b, each), both)

    return let(text.cast("binary"), lambda b: let(stays - K, lambda last: of(b, last)))


def named(found: Column, text: Column) -> Column:
    """A sketch as fingerprint of its text: one without an anchor is one itself."""
    return let(found, lambda v: F.when((F.size(v) > 0) | (text == ""), v).otherwise(F.array(packed(text.cast("binary"), F.lit(0)))))


def fingerprint(text: Column, kept: int | None = KEPT) -> Column:
    """array<long> of a text's anchors, least hash first."""
    return let(F.coalesce(text, F.lit("")), lambda t: named(sketch(t, kept), t))


def joined(a: Column, b: Column, of_a: Column, of_b: Column, kept: int | None = KEPT) -> Column:
    """The sketch of a text put together from a and b, of theirs."""

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = F.octet_length(a)
        start = F.greatest(n - (K - 1), F.lit(0))
        seam = F.concat(F.substring(a, start + 1, F.lit(K - 1)), F.substring(b, 1, K - 1))
        over = let(seam, lambda piece: F.when(F.octet_length(piece) >= K, anchors(piece, start)).otherwise(F.array().cast("array<bigint>")))
        return least(F.concat(of_a, over, F.transform(of_b, lambda x: x + n)), kept)

    return let(F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b")), of)


def likeness(a: Column, b: Column, kept: int | None = KEPT) -> Column:
    """Of two fingerprints with the same ``kept``."""
    entries = lambda v, side: F.transform(v, lambda x: F.struct(F.shiftright(x, 32).alias("h"), F.lit(side).alias("side"), x.bitwiseAND(F.lit(LOW)).alias("at")))

    def share(s: Column) -> Column:
        first = lambda x, i: (i == 0) | (F.get(s, i - 1)["h"] != x["h"])
        hashes = F.transform(F.filter(s, first), lambda x: x["h"])
        n = F.size(hashes) if kept is None else F.least(F.size(hashes), F.lit(kept))
        twice = lambda last: F.transform(s, lambda x, i: F.when((i > 0) & (x["h"] <= last) & (F.get(s, i - 1)["h"] == x["h"]), F.get(s, i - 1)["at"] - x["at"]))
        moved = let(F.get(hashes, n - 1), lambda last: F.sort_array(F.filter(twice(last), lambda d: d.isNotNull())))
        counted = let(moved, lambda d: F.size(F.filter(d, lambda x, i: (x == 0) | (x == F.get(d, i + 1)) | ((i > 0) & (x == F.get(d, i - 1))))))
        return counted / n

    found = let(F.sort_array(F.concat(entries(a, 0), entries(b, 1))), share)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(found, lambda j: 2 * j / (1 + j)))


def rendered(anchors: Column) -> Column:
    """Sixteen hexadecimal digits an anchor: hash, then position."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


KEY = ["k0", "k1", "k2", "k3"]


def keyed(docs: DataFrame) -> DataFrame:
    """text under a key that only repeated rows share: doc_id (k3: it is null) and two hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("text", F.coalesce("doc_id", F.lit(0)).alias("k0"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.col("doc_id").isNull().alias("k3"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Per distinct key in descending order of doc_id: the key with that of the row before (p0 to p3), that row's half and its repetitions."""
    s = Scratch(docs.sparkSession)
    order = [F.asc("k3"), F.desc("k0"), F.asc("k1"), F.asc("k2")]
    known = keyed(docs).groupBy(*KEY).agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"), F.count("*").alias("times"))
    dealt = s.save(known.repartitionByRange(*order).sortWithinPartitions(*order).select(*KEY, "half", "times", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("nth")))
    counts = dealt.groupBy("at").agg(F.count("*").alias("n"), F.min("nth").alias("from"))
    before = F.broadcast(counts.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n") - F.col("from")).alias("more")))  # a row a partition
    ranked = dealt.join(before, "at").withColumn("rank", F.col("nth") + F.col("more")).drop("at", "nth", "more")
    total = max(dealt.count(), 1)
    previous = ranked.select(F.pmod(F.col("rank") + 1, F.lit(total)).alias("rank"), *(F.col(k).alias(f"p{k[1]}") for k in KEY), "half", "times")
    return ranked.select("rank", *KEY).join(previous, "rank").drop("rank")


def fingerprints(docs: DataFrame, kept: int | None = KEPT) -> DataFrame:
    """doc_id, text, next_text (as much of it as the edit takes), anchors, next_anchors, edited_anchors.

    Own and lent texts come from the same shuffle, so the columns of rows must be those that both need.
    """
    same = Window.partitionBy(*KEY).orderBy(F.lit(0))
    stay = F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))")
    rows = keyed(docs).withColumn("own", sketches(F.col("text"), F.octet_length(stay), kept)).repartition(*KEY).withColumn("nth", F.row_number().over(same))
    whole = F.get("own", F.lit(0))
    taken = rows.where("nth = 1").join(neighbours(docs).hint("merge"), KEY).withColumn("next_text", F.expr("left(text, half)"))
    lent = taken.select(*(F.col(f"p{k[1]}").alias(k) for k in KEY), "times", "next_text", sketch(F.col("next_text"), kept).alias("lent"), named(whole, F.col("text")).alias("next_anchors"))
    met = rows.join(lent.hint("merge"), KEY)
    again = F.col("nth") < F.col("times")
    half = F.expr("left(text, cast(floor(length(text) / 2) as int))")
    met = met.select(
        F.when(~F.col("k3"), F.col("k0")).alias("doc_id"), "text", F.when(again, half).otherwise(F.col("next_text")).alias("next_text"), stay.alias("stay"), "own",
        F.when(again, sketch(half, kept)).otherwise(F.col("lent")).alias("lent"), named(whole, F.col("text")).alias("anchors"), "next_anchors", again.alias("again"))
    edited = named(joined(F.col("stay"), F.col("next_text"), F.get("own", F.lit(1)), F.col("lent"), kept), F.concat("stay", "next_text"))
    return met.select("doc_id", "text", "next_text", "anchors", F.when(F.col("again"), F.col("anchors")).otherwise(F.col("next_anchors")).alias("next_anchors"), edited.alias("edited_anchors"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.col("next_text"))
    rows = fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode(edited, "utf-8"), 256).alias("edited_sha256"),
        rendered(F.col("anchors")).alias("fingerprint"), rendered(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))
