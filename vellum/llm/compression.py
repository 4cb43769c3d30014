"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found by metric trees.

Components become integers, so that every distance, sum and mean is exact. The rows of an Arrow batch form blocks of up
to ``BLOCK`` vectors; for each part position of a block a tree is built once by the anchors hierarchy, middle out: about
sqrt(n) anchors are chosen, each the row that lies farthest from its own anchor, and take over the rows nearer to them
(rows within half the gap between two anchors cannot change hands and are not looked at); anchors are merged upwards,
always the two whose common ball is smallest, and split downwards by the same procedure. A ball caches the sum and
the number of its rows, a pivot and a radius.

A round walks down all trees of a block. A ball inherits its parent's list of candidate entries; an entry goes if the
whole ball lies on the nearer side of the bisector between it and the best one. A ball left with one candidate is wholly
owned, and its cached sum and number are added; rows of leaves are compared one by one. Spark adds up the sums of all
blocks, and the driver holds the codebooks alone.

Defined results. Null vectors, null or non-finite components: dropped. Vectors whose length is not that of most kept rows (the
longer one at a tie): dropped. Lengths that do not divide by the number of parts: parts differ by one component. Null
vec_id: kept, last in the order of the first entries. Equal vec_ids: by vector. Fewer rows than entries: as many
entries as rows. Equal entries: the lower index takes all, the others stay. Null labels: together. An error beyond a
long: null, and not in label_error. Repeated rows: each has its code. No rows: no rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, split_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK, LEAF = 4096, 24
#: Sums travel as digits of this many bits, so that they are exact whatever their size.
DIGIT = 40
LONG = 1 << 63


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as Python integers where 64 bits may not hold what is made of them."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 1 << 53 else floor(v * scale) for v in row] for row in x.tolist()], object)


def narrow(x: np.ndarray, d: int) -> bool:
    """Whether squared distances and products of such values fit 64 bits."""
    return not x.size or int(np.abs(x).max()) ** 2 * 8 * max(d, 1) < 1 << 62


class Tree:
    """Balls over the distinct rows of one part of a block; the rows of a ball stand next to each other."""

    def __init__(self, x: np.ndarray):
        """x: integers (rows x components)."""
        if x.dtype == object or not narrow(x, x.shape[1]):
            self.rows, self.inverse = x.astype(object), np.arange(len(x))
            self.weights, self.tree = np.ones(len(x), np.int64), False
            return
        rows, inverse, self.weights = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        self.tree = True
        self.members: list[np.ndarray | None] = []
        self.children: list[tuple[int, int]] = []
        self.grow(rows)
        order = np.concatenate([self.members[k] for k in self.lay()])
        self.rows, self.weights = rows[order], self.weights[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse = place[inverse.reshape(-1)]
        self.cache()
        del self.members

    def grow(self, rows: np.ndarray) -> None:
        self.points = rows.astype(float)
        self.root = self.split(np.arange(len(rows)))
        del self.points

    def node(self, members: np.ndarray | None, children: tuple[int, int] = (-1, -1)) -> int:
        self.members.append(members)
        self.children.append(children)
        return len(self.children) - 1

    def split(self, idx: np.ndarray) -> int:
        """The ball of rows idx, through anchors."""
        if len(idx) <= LEAF:
            return self.node(idx)
        x = self.points[idx]
        owner, far = np.zeros(len(x), np.int64), np.linalg.norm(x - x[0], axis=1)
        at = [0]
        for k in range(1, max(2, int(sqrt(len(x))))):
            new = int(far.argmax())
            if not far[new]:
                break
            gap = np.linalg.norm(x[at] - x[new], axis=1)
            may = np.flatnonzero(far > gap[owner] / 2)
            d = np.linalg.norm(x[may] - x[new], axis=1)
            won = d < far[may]
            owner[may[won]], far[may[won]] = k, d[won]
            at.append(new)
        parts = [idx[owner == k] for k in range(len(at))]
        centres, radii, sizes = x[at], np.array([far[owner == k].max() for k in range(len(at))]), np.array([len(p) for p in parts], float)
        return self.merge([self.split(p) for p in parts], centres, radii, sizes)

    def merge(self, nodes: list[int], c: np.ndarray, r: np.ndarray, n: np.ndarray) -> int:
        """The root above nodes: the two whose common ball has the least radius are merged until one is left."""
        nodes, k = list(nodes), len(nodes)
        radius = lambda i: np.maximum((np.linalg.norm(c - c[i], axis=1) + r + r[i]) / 2, np.maximum(r, r[i]))
        cost = np.stack([radius(i) for i in range(k)])
        np.fill_diagonal(cost, np.inf)
        for _ in range(k - 1):
            i, j = divmod(int(cost.argmin()), k)
            nodes[i] = self.node(None, (nodes[i], nodes[j]))
            centre = (c[i] * n[i] + c[j] * n[j]) / (n[i] + n[j])
            r[i] = max(np.linalg.norm(centre - c[i]) + r[i], np.linalg.norm(centre - c[j]) + r[j])
            c[i], n[i] = centre, n[i] + n[j]
            cost[j], cost[:, j] = np.inf, np.inf
            now = radius(i)
            now[np.isinf(cost[i])] = np.inf
            cost[i], cost[:, i] = now, now
            root = i
        return nodes[root]

    def lay(self) -> list[int]:
        """The leaves from left to right; the extent of every ball is set."""
        leaves, at, size = [], 0, len(self.children)
        self.start, self.stop = np.zeros(size, np.int64), np.zeros(size, np.int64)
        stack = [(self.root, False)]
        while stack:
            k, done = stack.pop()
            a, b = self.children[k]
            if a < 0:
                leaves.append(k)
                self.start[k], self.stop[k] = at, at + len(self.members[k])
                at = self.stop[k]
            elif done:
                self.start[k], self.stop[k] = self.start[a], self.stop[b]
            else:
                stack += [(k, True), (b, False), (a, False)]
        self.children = np.array(self.children)
        return leaves

    def cache(self) -> None:
        """Sum, number, pivot and radius of every ball."""
        whole = np.concatenate([np.zeros((1, self.rows.shape[1]), np.int64), np.cumsum(self.rows * self.weights[:, None], 0)])
        many = np.concatenate([[0], np.cumsum(self.weights)])
        self.sums, self.sizes = whole[self.stop] - whole[self.start], many[self.stop] - many[self.start]
        self.pivots = self.sums // self.sizes[:, None]
        off = [((self.rows[a:b] - p) ** 2).sum(1).max() for a, b, p in zip(self.start, self.stop, self.pivots, strict=True)]
        self.radii = np.sqrt(np.array(off, float)) * (1 + 1e-9)
        small = next(t for t in (np.int16, np.int32, np.int64) if not self.rows.size or np.abs(self.rows).max() <= np.iinfo(t).max)
        self.rows = self.rows.astype(small)

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry of every row, and sum and number of the rows of every entry (rows count with their weights)."""
        k, d = book.shape
        code = np.zeros(len(self.rows), np.int64)
        if not self.tree or not narrow(book, d):
            rows, wide = self.rows.astype(object), book.astype(object)
            sums, sizes = np.zeros((k, d), object), np.zeros(k, np.int64)
            for i, row in enumerate(rows):
                code[i] = min(range(k), key=lambda e: (sum((row - wide[e]) ** 2), e))
                sums[code[i]] += row * int(self.weights[i])
                sizes[code[i]] += self.weights[i]
            return code, sums, sizes
        sums, sizes = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        length = (book * book).sum(1)
        gap = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2).astype(float))
        first = np.array([not (book[:e] == book[e]).all(1).any() for e in range(k)])
        balls, may = np.array([self.root]), first[None]
        never = np.iinfo(np.int64).max
        while len(balls):
            far = length[None] - 2 * self.pivots[balls] @ book.T
            best = np.where(may, far, never).argmin(1)
            margin = far - far[np.arange(len(balls)), best][:, None]
            may = may & ~(margin > 2 * self.radii[balls][:, None] * gap[best] * (1 + 1e-9) + 1e-3)
            own = may.sum(1) == 1
            np.add.at(sums, best[own], self.sums[balls[own]])
            np.add.at(sizes, best[own], self.sizes[balls[own]])
            for a, b, e in zip(self.start[balls[own]], self.stop[balls[own]], best[own], strict=True):
                code[a:b] = e
            leaf = ~own & (self.children[balls, 0] < 0)
            if leaf.any():
                n = self.stop[balls[leaf]] - self.start[balls[leaf]]
                ball = np.repeat(np.arange(len(n)), n)
                at = self.start[balls[leaf]][ball] + np.arange(len(ball)) - (np.cumsum(n) - n)[ball]
                rows = self.rows[at].astype(np.int64)
                code[at] = np.where(may[leaf][ball], length[None] - 2 * rows @ book.T, never).argmin(1)
                np.add.at(sums, code[at], rows * self.weights[at][:, None])
                np.add.at(sizes, code[at], self.weights[at])
            inner = ~own & ~leaf
            balls, may = self.children[balls[inner]].reshape(-1), np.repeat(may[inner], 2, 0)
        return code, sums, sizes

    def errors(self, book: np.ndarray, code: np.ndarray) -> np.ndarray:
        wide = object if not self.tree or not narrow(book, book.shape[1]) else np.int64
        return ((self.rows.astype(wide) - book[code].astype(wide)) ** 2).sum(1)


def digits(values: list[int]) -> list[list[int]]:
    """Digits of DIGIT bits, each with its number's sign, lowest first: as many lists as the largest value needs."""
    out, size = [], [abs(v) for v in values]
    while not out or any(size):
        out.append([(-(a & (1 << DIGIT) - 1) if v < 0 else a & (1 << DIGIT) - 1) for a, v in zip(size, values, strict=True)])
        size = [a >> DIGIT for a in size]
    return out


def cuts_of(dim: int, parts: int) -> list[tuple[int, int]]:
    ends = np.linspace(0, dim, parts + 1).astype(int).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True))


def planted(kept: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """A row per block of kept (vec_id, label, vec): its ids, labels and trees."""
    kinds = {n: kept.schema[n].dataType for n in ("vec_id", "label")}
    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["vec_id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("trees", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, BLOCK):
            if not part.num_rows:
                continue
            x = integers(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1))
            trees = [pickle.dumps(Tree(x[:, a:b]), 5) for a, b in cuts]
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([whole(part.column(0)), whole(part.column(1)), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    return kept.select("vec_id", "label", "vec").mapInArrow(run, schema)


def summed(blocks: DataFrame, books: list[np.ndarray]) -> list:
    """Rows (part, entry, digit, place, total) of all blocks' sums; the place after a part's last component holds the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for trees in batch.column(0):
                out = []
                for p, raw in enumerate(trees):
                    _, sums, sizes = pickle.loads(raw.as_py()).nearest(books[p])
                    for e in np.flatnonzero(sizes):
                        out += [(p, int(e), k, values) for k, values in enumerate(digits([*map(int, sums[e]), int(sizes[e])]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "digit", "sums"])

    rows = blocks.select("trees").mapInArrow(run, "part int, entry int, digit int, sums array<long>")
    return rows.select("part", "entry", "digit", F.posexplode("sums").alias("place", "v")).groupBy("part", "entry", "digit", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).collect()


def renewed(books: list[np.ndarray], totals: list) -> list[np.ndarray]:
    found: dict[tuple[int, int, int], int] = {}
    for r in totals:
        key = (r["part"], r["entry"], r["place"])
        found[key] = found.get(key, 0) + (int(r["total"]) << DIGIT * r["digit"])
    out = []
    for p, book in enumerate(books):
        d = book.shape[1]
        rows = [[found[p, e, k] // found[p, e, d] for k in range(d)] if (p, e, d) in found else list(map(int, book[e])) for e in range(len(book))]
        out.append(whole_numbers(rows, d))
    return out


def whole_numbers(rows: list[list[int]], d: int) -> np.ndarray:
    fits = all(-LONG <= v < LONG for row in rows for v in row)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), d)


def coded(blocks: DataFrame, books: list[np.ndarray], kinds: T.StructType) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    schema = T.StructType([*(T.StructField(n, kinds[n].dataType) for n in ("vec_id", "label")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns, strict=True):
                codes, error = [], 0
                for p, raw in enumerate(trees):
                    tree = pickle.loads(raw.as_py())
                    code, _, _ = tree.nearest(books[p])
                    codes.append(code[tree.inverse])
                    error = error + tree.errors(books[p], code)[tree.inverse].astype(object)
                text = np.stack(codes, 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([r.tobytes().hex() for r in text]), pa.array([int(e) if e < LONG else None for e in error], pa.int64())], schema.names)

    return blocks.select("ids", "labels", "trees").mapInArrow(run, schema)


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of every kept vector; the final codebooks, an array entries x components a part)."""
    if not 0 < entries <= 256:
        raise ValueError("a code takes one byte: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(fine & (F.size("vec") > 0))
    lengths = kept.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    kept, cuts = kept.where(F.size("vec") == dim), cuts_of(dim, parts)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").collect()
    start = integers(np.array([r[0] for r in first], float).reshape(len(first), dim))
    books = [start[:, a:b] for a, b in cuts]
    blocks = Scratch(vectors.sparkSession).save(planted(kept, cuts))
    for _ in range(rounds if first else 0):
        books = renewed(books, summed(blocks, books))
    return coded(blocks, books, kept.schema), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes (label, error, ...) with label_error, the sum of error over rows of equal label, nulls together."""
    s = Scratch(codes.sparkSession)
    rows = s.save(codes.withColumns({"label_text": F.coalesce(F.col("label").cast("string"), F.lit("")), "no_label": F.col("label").isNull()}))
    sums = rows.groupBy("label_text", "no_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("label_rows"))
    return split_join(rows, sums, ["label_text", "no_label"], "label_rows", rows.count()).drop("label_text", "no_label", "label_rows")


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def sql() -> str:
    """Lloyd's rounds spelt out, a pair of relations each."""
    nearest = """a{k} AS MATERIALIZED (
  SELECT rid, part, entry, dist FROM (
    SELECT rid, part, entry, sum((x - c)::HUGEINT * (x - c)) AS dist FROM cells JOIN c{k} USING (part, pos) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY dist, entry) = 1)"""
    means = """m{k} AS MATERIALIZED (SELECT part, entry, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN cells USING (rid, part) GROUP BY ALL),
c{n} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, CASE WHEN n IS NULL THEN c ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS c
  FROM c{k} c LEFT JOIN m{k} USING (part, entry, pos))"""
    steps = [x.format(k=k, n=k + 1) for k in range(ROUNDS) for x in (nearest, means)] + [nearest.format(k=ROUNDS)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT rid, i // (len(e) // {PARTS}) AS part, i % (len(e) // {PARTS}) AS pos, floor({SCALE} * e[i + 1])::BIGINT AS x
  FROM (SELECT rid, e, unnest(range(len(e))) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, rid AS entry, pos, x AS c FROM cells WHERE rid < {ENTRIES}),
{", ".join(steps)},
found AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN found USING (rid)
"""


OP11_SQL = sql()
