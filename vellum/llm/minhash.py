"""Near-duplicates by HyperMinHash.

Words are lower-cased (A-Z) runs of non-space; a document's set holds its distinct word pairs (``SHINGLE`` words;
in the pipeline's stage runs of ``STAGE_SHINGLE`` words).
The hashes of a set fall into 256 buckets by their first 8 bits; a bucket's register is made from its least hash:
the count of leading zeros and the next ``MANTISSA`` bits. An empty bucket borrows, for banding only, the register
of the full bucket that a fixed random order puts first. 42 bands of 6 registers are hashed; two sets of
similarity 0.8 miss each other in all bands with probability 3e-6.

1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. Each document is paired with one other: of the documents that share a band value with it, the one whose own band
   values have the most members. Pairs whose collision-corrected estimate lies within ``SIGMAS`` standard errors of
   the threshold, and that two bounds on sizes and registers leave possible, are confirmed on the full sets;
   confirmed links give components. In a family of near copies nearly all link to its centre here.
3. Documents of band values that still hold several components are open. Their band values are split further: two
   sets that link share one of their rarest shingles, at places that the threshold bounds (rarest by a sketch of
   shingle counts over the open documents; any order would be exact). First each document meets one of the largest
   component that shares such a shingle, its most central one; then pairs of components that are still different meet,
   unless the parities of their shingles tell that too many are apart. They are estimated and confirmed as in 2. A copy
   with too many changes to link has only rare shingles there and meets nobody, so a family does not give all of its
   pairs.

A component loses no link, while pairs within a component are not listed. Band values, shingles and centres of many
members are split over tasks. Shuffled are band values, registers and sets of candidates, and the rarest shingles of
open documents.

Defined results. Null, empty or blank text: an empty set (n_shingles 0), linked with nothing, kept. Fewer words
than SHINGLE: the whole sequence as one shingle. Null doc_id: component_id null, kept, linked with nothing.
Repeated rows: the same class, so the same component. Rows that share a doc_id count as one document, which has the
links of each of its texts; they are all kept or all dropped. No rows: no rows. Extra columns are dropped by
``near_duplicates`` and kept by the stage; names cannot clash, since both read doc_id and text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, split_join, table
from .components import connected_components

SHINGLE, PERCENT = 2, 80
STAGE_SHINGLE = 5
BUCKETS, MANTISSA, WIDE, BANDS = 256, 10, 6, 42
SIGMAS = 4.5
#: A centre's register or set is sent once for so many of its pairs; members of a hot shingle are dealt in such parts.
CHUNK, PART = 512, 4096
MARKS = ("m0", "m1", "m2", "m3")
#: Counters of the sketch that orders shingles, 4 bytes each.
COUNTERS = 1 << 17
KNOWN_WORDS = 300_000
#: Two registers of different hashes agree with this probability: leading zeros (1/3) and mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
ORDER = np.random.default_rng(11).random((BUCKETS, BUCKETS))
STARTS = (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)).astype(np.uint64)
BAND_SEED = np.random.default_rng(12).integers(0, 1 << 63, BANDS, dtype=np.uint64)
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hash(w: bytes) -> int:
    if len(_known) >= KNOWN_WORDS:
        _known.clear()
    h = _known[w] = xxhash.xxh64_intdigest(w)
    return h


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _known.get
    h = np.array([x if (x := known(w)) is not None else word_hash(w) for w in words], np.uint64)
    n = max(len(h) - width + 1, 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """256 registers, 0 where a bucket is empty."""
    at = np.searchsorted(hashes, STARTS)
    after = np.append(at[1:], len(hashes))
    full = after > at
    least = (hashes[np.minimum(at, len(hashes) - 1)] >> np.uint64(4)) & np.uint64((1 << 52) - 1)
    zeros = 52 - np.frexp(least.astype(np.float64))[1]
    mantissa = ((least << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 52) - 1)) >> np.uint64(52 - MANTISSA)
    return np.where(full, ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64), 0).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(regs)
    if len(full) < BUCKETS:
        empty = np.flatnonzero(regs == 0)
        regs = regs.copy()
        regs[empty] = regs[full[ORDER[np.ix_(empty, full)].argmin(1)]]
    r = regs[: BANDS * WIDE].reshape(BANDS, WIDE).astype(np.uint64)
    half = [r[:, k] | (r[:, k + 1] << np.uint64(16)) | (r[:, k + 2] << np.uint64(32)) for k in (0, 3)]
    return mixed(mixed(half[0] + BAND_SEED) + half[1]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of rows of registers, corrected for chance collisions, and the buckets that it rests on."""
    either = ((a | b) != 0).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    n = np.maximum(either, 1)
    return (same / n - COLLISION) / (1 - COLLISION), n


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray | int, size_b: np.ndarray) -> np.ndarray:
    """Rows of registers and set sizes whose link is possible.

    Two bounds hold for certain: the sizes' ratio, and the buckets whose registers differ, each of which holds a
    shingle of one set only (a link leaves (1 - t) / (1 + t) of both sizes for these).
    """
    found, n = estimate(a, b)
    t = PERCENT / 100
    apart = (a != b).sum(-1)
    sizes = np.minimum(size_a, size_b) >= t * np.maximum(size_a, size_b) - 1e-9
    return sizes & (apart <= (1 - t) / (1 + t) * (size_a + size_b) + 1e-9) & (found >= t - SIGMAS * np.sqrt(t * (1 - t) / n) - 1e-9)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set) and regs, both null without shingles; docs has doc_id long and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            n, keys, regs = [], [], []
            for text in part.column(1).to_pylist():
                h = shingles(text, width)
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "key", "regs"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, regs binary")


def representatives(known: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """One row of known (doc_id, n_shingles, key, regs) for each class: that of its smallest doc_id."""
    several = classes.where("n > 1")
    own = split_join(known, several, "key", "n", rows).where("doc_id = rep").groupBy("key", "doc_id", "n_shingles").agg(F.first("regs").alias("regs"))
    names = ["doc_id", "n_shingles", "regs"]
    alone = known.join(several.select("key"), "key", "left_anti")
    return alone.select(names).unionByName(own.select(names))


def banded(reps: DataFrame) -> DataFrame:
    """band, doc_id: the band values of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = np.concatenate([bands(r) for r in rows_of(part.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["band", "doc_id"])

    return reps.select("doc_id", "regs").mapInArrow(run, "band long, doc_id long")


def rows_of(regs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(regs), np.uint16).reshape(len(regs), BUCKETS)


def dealt(pairs: DataFrame, total: int) -> DataFrame:
    """Pairs (centre, leaf) with a chunk, so that no centre has more than about CHUNK of them in one."""
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    return split_join(pairs, sizes, "centre", "n", total).select("centre", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk"), "leaf")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (centre, chunk, leaf) whose registers leave the link possible."""
    of = lambda who, r, n: reps.select(F.col("doc_id").alias(who), F.col("regs").alias(r), F.col("n_shingles").alias(n))
    both = pairs.join(of("leaf", "rl", "nl"), "leaf").join(pairs.select("centre", "chunk").distinct().join(of("centre", "rc", "nc"), "centre"), ["centre", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            ok = may_link(*(rows_of(part.column(c).to_pylist()) for c in ("rc", "rl")), *(part.column(c).to_numpy() for c in ("nc", "nl")))
            yield part.select(["centre", "chunk", "leaf"]).filter(pa.array(ok))

    return both.select("centre", "chunk", "leaf", "rc", "rl", "nc", "nl").mapInArrow(run, "centre long, chunk int, leaf long")


def sets_of(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """rows (doc_id and more) with items, the shingles of the document."""
    names = [c for c in rows.columns if c != "doc_id"]
    schema = T.StructType([rows.schema["doc_id"], *(rows.schema[c] for c in names), T.StructField("items", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            before, items, out = None, b"", []
            for text in part.column("text").to_pylist():
                if text != before:  # the rows of one document follow each other
                    before, items = text, shingles(text, width).tobytes()
                out.append(items)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *names)), pa.array(out, pa.binary())], schema.names)

    return docs.join(rows, "doc_id").select("doc_id", *names, "text").mapInArrow(run, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links (a, b) among pairs (centre, chunk, leaf), by their full sets; only the sets of these documents are made."""
    leaves = sets_of(docs, pairs.withColumnRenamed("leaf", "doc_id"), width).withColumnRenamed("doc_id", "leaf")
    centres = sets_of(docs, pairs.select(F.col("centre").alias("doc_id"), "chunk").distinct(), width).select(F.col("doc_id").alias("centre"), "chunk", F.col("items").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part.column("own").to_pylist(), part.column("items").to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return leaves.join(centres, ["centre", "chunk"]).select(F.col("centre").alias("a"), F.col("leaf").alias("b"), "own", "items").mapInArrow(run, "a long, b long").distinct()


def star(shared: DataFrame, total: int) -> DataFrame:
    """Pairs (centre, leaf): each document with the one of most members in its band values, among those that share one."""
    weight = shared.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    centres = shared.join(weight, "doc_id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("less"))).alias("c"), F.max("size").alias("n"))
    best = split_join(shared, centres, "band", "n", total).groupBy("doc_id").agg(F.max("c").alias("c"))
    return best.select((-F.col("c.less")).alias("centre"), F.col("doc_id").alias("leaf")).where("centre <> leaf")


def open_documents(shared: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """doc_id, component of the documents whose band values hold several components; found: id, component."""
    now = shared.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("size").alias("n")).where("lo <> hi").select("band", "n")
    return split_join(now, several, "band", "n", total).select("doc_id", "component").distinct()


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall on each of COUNTERS hash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for part in slices(batches, 256):
            every = np.frombuffer(b"".join(part.column("items").to_pylist()), np.uint64)
            n += np.bincount((every % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    found = sets.select("items").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["at"]] = found["n"]
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint32)


def rarest(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """shingle, doc_id, component, size, place, MARKS: the shingles by which a set can meet one that links with it.

    In the order of counts, sets of sizes a and b that link share a shingle at places up to a - o and b - o, where
    o = ceil(t / (1 + t) * (a + b)) is the overlap that they need; b >= t * a bounds the first by a - ceil(t * a). MARKS are
    256 parities of the set by hash: as many of two sets' marks differ at most as they have shingles apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found, n, place, marks = [], [], [], []
            for raw in part.column("items").to_pylist():
                s = np.frombuffer(raw, np.uint64)
                often = counts[(s % np.uint64(COUNTERS)).astype(np.int64)]
                last = len(s) - -(-PERCENT * len(s) // 100) + 1
                first = np.lexsort((s, often))[:last]
                at = np.flatnonzero(often[first] > 1)  # a shingle counted once is in no other set
                found.append(s[first[at]])
                n.append(len(at))
                place.append(at)
                marks.append(np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) & 255, minlength=256) & 1))
            size = np.array([len(raw) // 8 for raw in part.column("items").to_pylist()])
            cols = (np.concatenate(found).view(np.int64), *(np.repeat(part.column(c).to_numpy(), n) for c in ("doc_id", "component")), np.repeat(size, n), np.concatenate(place), *(np.repeat(c, n) for c in np.stack(marks).view(np.int64).T))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["shingle", "doc_id", "component", "size", "place", *MARKS])

    return sets.select("doc_id", "component", "items").mapInArrow(run, "shingle long, doc_id long, component long, size long, place long, " + ", ".join(f"{m} long" for m in MARKS))


def several_components(rare: DataFrame) -> DataFrame:
    """shingle, main (its largest component), head (of main's documents that with the fewest rarer shingles), m (rows) where a shingle has several components."""
    per = rare.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.min(F.struct("place", "doc_id")).alias("head"))
    first = F.struct("n", "component")
    return per.groupBy("shingle").agg(F.max_by("component", first).alias("main"), F.max_by("head", first).alias("head"), F.sum("n").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")


def heads(rare: DataFrame, total: int) -> DataFrame:
    """Pairs (centre, leaf): each document outside a shingle's largest component with one document of that, the most central it meets."""
    rows = split_join(rare, several_components(rare), "shingle", "m", total).where("component <> main")
    return rows.groupBy("doc_id").agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("centre"), F.col("doc_id").alias("leaf"))


def open_pairs(rare: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of rarest() at places where they may link.

    Of a shingle's components the largest is not paired with itself: all of its members are met by those of the others.
    Many members are dealt out in parts, to each of which the others come.
    """
    rows = split_join(rare, several_components(rare), "shingle", "m", total).drop("head")
    parts = F.ceil(F.col("m") / PART).cast("int")
    every = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).drop("main", "m")
    others = rows.where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("shingle", "part", *(F.col(c).alias(f"o_{c}") for c in ("doc_id", "component", "size", "place", *MARKS)))
    need = F.ceil((F.col("size") + F.col("o_size")) * PERCENT / (100 + PERCENT) - 1e-9)
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"o_{m}"))) for m in MARKS), F.lit(0))
    near = (F.col("place") <= F.col("size") - need) & (F.col("o_place") <= F.col("o_size") - need) & (apart <= F.col("size") + F.col("o_size") - 2 * need)
    met = every.join(others, ["shingle", "part"]).where((F.col("component") != F.col("o_component")) & near)
    return met.select(F.least("doc_id", "o_doc_id").alias("a"), F.greatest("doc_id", "o_doc_id").alias("b")).where("a <> b").distinct()


def oriented(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as (centre, leaf): the one in more pairs is the centre."""
    n = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).groupBy("x").agg(F.count("*").alias("n"))
    both = pairs.join(n.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    return both.select(F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("leaf"))


def ids_of_several_texts(sigs: DataFrame) -> DataFrame:
    """doc_id of documents whose rows differ in text."""
    h = F.xxhash64("key")
    return sigs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("doc_id")


def shared_ids(known: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of the documents ids."""
    reps = known.select("doc_id", "key").join(ids, "doc_id").join(classes.select("key", "rep"), "key")
    return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """docs (doc_id long, text) -> doc_id, n_shingles, component_id, kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = Scratch(docs.sparkSession)
    sigs = s.save(signatures(docs, width))
    known = sigs.where("doc_id is not null and key is not null")
    classes = s.save(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    rows = known.count()
    ids = s.save(ids_of_several_texts(sigs))
    reps = s.save(representatives(known, classes, rows))
    every = banded(reps)
    sizes = s.save(every.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    shared = s.save(split_join(every, sizes, "band", "size", rows * BANDS))
    total = shared.count()
    # every document with the centre of its family
    pairs = s.save(star(shared, total))
    near = s.save(likely(dealt(pairs, pairs.count()), reps))
    edges = s.save(confirmed(near, docs, width).unionByName(shared_ids(known, classes, ids)))
    found = s.save(connected_components(edges))
    # what shares a band value with another component
    sets = s.save(sets_of(docs, open_documents(shared, found, total), width))
    rare = s.save(rarest(sets, shingle_counts(sets)))
    rows_open = rare.count()
    for find in (heads, lambda r, n: oriented(open_pairs(r, n))):
        more = s.save(find(rare, rows_open))
        near_too = s.save(likely(dealt(more, more.count()), reps))
        new = s.save(confirmed(near_too, docs, width))
        s.free(more, near_too)
        if new.head(1):
            edges = edges.unionByName(new)
            found = s.save(connected_components(edges))
            moved = found.withColumnRenamed("id", "doc_id").withColumnRenamed("component", "now")
            rare = rare.join(moved, "doc_id", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
    s.free(reps, sizes, shared, pairs, near, sets)
    whole = classes.join(found, classes["rep"] == found["id"], "left").select("key", "n", F.coalesce("component", "rep").alias("component"))
    own = sigs.select("doc_id", "n_shingles", "key")
    full = split_join(own.where("key is not null"), whole, "key", "n", rows, "left").select("doc_id", "n_shingles", "component")
    texts = known.select("doc_id", "key").join(ids, "doc_id").join(whole, "key").groupBy("doc_id").agg(F.min("component").alias("component"))
    empty = own.where("key is null").join(texts, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return full.unionByName(empty).select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; its shingles have STAGE_SHINGLE words."""
    dropped = near_duplicates(docs, STAGE_SHINGLE).where("not kept").select("doc_id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(dropped, "doc_id", "left_anti").select("row.*")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) <= 1 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS items
  FROM w),
n AS (SELECT doc_id, len(items)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(items) AS item FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n_shingles + nb.n_shingles - k)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS at, doc_id AS seen FROM n UNION SELECT reach.at, step.b FROM reach JOIN step ON step.a = reach.seen)
SELECT n.doc_id, n_shingles, min(seen)::BIGINT AS component_id, n.doc_id = min(seen) AS kept
FROM n JOIN reach ON reach.at = n.doc_id GROUP BY n.doc_id, n_shingles
"""
