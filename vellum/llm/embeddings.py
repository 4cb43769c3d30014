"""Embedding near-duplicates by product quantisation.

Coarse centroids and residual codebooks are fitted on a bounded sample (``FIT_ROWS`` vectors, those of the smallest
hashes); every vector is indexed: its list, the codes of its residual in ``PARTS`` subspaces, and the length of what
the codes leave out. There are 2 * sqrt(n) lists (at most FIT_ROWS / 8; beyond some 4 million vectors lists grow
instead, and with them the work per vector). Every distinct vector is also a query.

Of two vectors within the radius R = sqrt(2 - 2 * cosine) in different cells, one lies within half of the pair's extent
across the cells' bisector. That extent is R at most, and for most pairs much less: it is the length of their difference
along one direction. How long that is is measured on the sample (``spread``), and a vector probes each list whose bisector
is at most ``REACH`` times its root mean square / 2 away, R / 2 at most; no cap on the number of probes. So a link may be
lost if its difference lies as no close pair of the sample shows; ``exact=True`` probes up to R / 2 and loses none. A pair that is met from one side only counts for both. Within a list, distances to the coded vectors come from lookup tables; a vector goes on to
the exact cosine in double precision unless its table distance exceeds R by more than its own coding error, which
loses no pair.

Vectors that are equal bit by bit form a class and are searched once. Lists are dealt out in blocks of members and
of queries. A block returns the number of links per vector and edges that span its links, never all pairs.

Defined results. Null, zero or non-finite vectors, null components, and vectors whose length is not that of most
rows: no links. Null vec_id: linked and counted as any other; its component_id is the smallest vec_id of its component,
null if that has none, and it is kept only then. Repeated rows, and rows that share a vec_id: each is a vector of its
own and links with the others. No rows: no rows. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices, split_join, table, unit_hash
from .components import connected_components

COSINE = 0.95
FIT_ROWS = 32_768
PARTS, CODES = 16, 256
REACH = 4.0
#: Rows of the sample whose close pairs in it are looked for.
CLOSE_ROWS = 2048
#: So many close pairs across cells tell how far pairs extend across bisectors.
CROSSING = 200
BLOCK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]])) / n[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[k : k + 4096] @ c.T).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def spread(sample: np.ndarray, coarse: np.ndarray, radius: float) -> float:
    """Root mean square of the extent of close pairs across the bisector of their cells, in radii.

    Where the sample shows too few such pairs: the largest standard deviation, along any direction, of the unit
    differences of its close pairs and of what centroids leave.
    """
    step = max(1, len(sample) // CLOSE_ROWS)
    few = sample[::step]
    close = []
    for k in range(0, len(few), 256):
        i, j = np.nonzero(few[k : k + 256] @ sample.T >= 1 - radius**2 / 2)
        every = max(1, len(i) // 8192)  # pairs enough for a second moment
        close.append((k + i[::every], j[::every]))
    i, j = (np.concatenate(c) for c in zip(*close, strict=True))
    at = nearest(sample, coarse)
    one, two = at[i * step], at[j]
    cross = one != two
    if cross.sum() >= CROSSING:
        normal = coarse[one[cross]] - coarse[two[cross]]
        extent = ((few[i[cross]] - sample[j[cross]]) * normal).sum(1) / np.linalg.norm(normal, axis=1)
        return float(np.sqrt((extent**2).mean())) / radius
    most = 0.0
    for rows in (few[i] - sample[j], sample - coarse[at]):
        size = np.linalg.norm(rows, axis=1)
        unit = rows[size > 1e-9] / size[size > 1e-9, None]
        if len(unit) > 1:
            most = max(most, float(np.linalg.eigvalsh(unit.T @ unit / len(unit))[-1]))
    return math.sqrt(most) if most else 1.0


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float, exact: bool = False):
        self.coarse = kmeans(sample, lists, 8, 1)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.reach = radius / 2 * (1.0 if exact else min(1.0, REACH * spread(sample, self.coarse, radius)))
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, 6, 2) for a, b in zip(self.cuts, self.cuts[1:])]  # noqa: B905
        self.apart = np.sqrt(np.maximum(((self.coarse[:, None, :] - self.coarse[None]) ** 2).sum(2), 0)) if len(self.coarse) <= 512 else None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each unit vector."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1)  # noqa: B905
        back = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        return at, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each unit vector probes."""
        c = self.coarse
        d = np.maximum((c * c).sum(1)[None] - 2 * x @ c.T + 1, 0)
        own = d.argmin(1)
        apart = self.apart[own] if self.apart is not None else np.sqrt(np.maximum(((c[own] ** 2).sum(1))[:, None] + (c * c).sum(1)[None] - 2 * c[own] @ c.T, 0))
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * self.reach * apart + 1e-12
        return [np.flatnonzero(row) for row in near]

    def table_distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances (queries x members) to the coded members of list at."""
        rest = q - self.coarse[at]
        total = np.zeros((len(q), len(codes)))
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):  # noqa: B905
            part = rest[:, a:b]
            look = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)[None]
            total += look[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


INDEXED = "id long, vec binary, n long, list int, codes binary, err double, probes array<int>"


def search(rows: DataFrame, index: Index, kind: str, cosine: float) -> DataFrame:
    """Blocks of rows (list, mb, vb, side, and INDEXED), members first -> q, n (links, if x is null) or edges q, x."""
    radius = math.sqrt(2 - 2 * cosine)

    def compare(at: int, members: list[tuple], queries: list[tuple]) -> pa.RecordBatch:
        ids, n = np.array([m[0] for m in members]), np.array([m[2] for m in members])
        x, codes, err = unit_rows([m[1] for m in members], kind), np.frombuffer(b"".join(m[4] for m in members), np.uint8).reshape(len(members), -1), np.array([m[5] for m in members])
        who, where = np.repeat(np.arange(len(members)), [len(m[6]) for m in members]), np.concatenate([m[6] for m in members])
        group = np.arange(len(ids))
        mirrored = np.zeros(len(ids), np.int64)
        out: list[tuple[int, int | None, int]] = []
        for k in range(0, len(queries), 512):
            part = queries[k : k + 512]
            q = unit_rows([p[1] for p in part], kind)
            may = index.table_distances(q, at, codes) <= radius + err[None] + 1e-9
            for r in np.flatnonzero(may.any(1)):
                near = np.flatnonzero(may[r])
                near = near[(x[near] @ q[r] >= cosine) & (ids[near] != part[r][0])]
                if not len(near):
                    continue
                out.append((part[r][0], None, int(n[near].sum())))
                if part[r][3] != at:  # members that do not probe the query's list do not meet it there
                    back = np.zeros(len(ids), bool)
                    back[who[where == part[r][3]]] = True
                    mirrored[near[~back[near]]] += part[r][2]
                kinds, first = np.unique(group[near], return_index=True)
                out += [(part[r][0], int(ids[near[f]]), 0) for f in first]
                if len(kinds) > 1:
                    group[np.isin(group, kinds)] = kinds[0]
        out += [(int(ids[m]), None, int(mirrored[m])) for m in np.flatnonzero(mirrored)]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["q", "x", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, queries = None, [], []
        for part in slices(batches, 2048):
            for at, mb, vb, side, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if block != (at, mb, vb):
                    if members and queries:
                        yield compare(block[0], members, queries)
                    block, members, queries = (at, mb, vb), [], []
                (queries if side else members).append(row)
        if members and queries:
            yield compare(block[0], members, queries)

    return rows.mapInArrow(run, "q long, x long, n long")


def dealt(known: DataFrame) -> DataFrame:
    """Members and queries of each list in blocks of about BLOCK of either: list, mb, vb, side and INDEXED."""
    visits = known.select("id", "vec", "n", F.col("list").alias("own"), F.explode("probes").alias("list"))
    of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = F.broadcast(blocks(known, "m").join(blocks(visits, "v"), "list"))  # a row a list
    members = known.join(both, "list").select("list", of(F.col("m")).alias("mb"), every(F.col("v")).alias("vb"), F.lit(0).alias("side"), "id", "vec", "n", F.lit(None).cast("int").alias("own"), "codes", "err", "probes")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("codes", "binary"), ("err", "double"), ("probes", "array<int>"))]
    queries = visits.join(both, "list").select("list", every(F.col("m")).alias("mb"), of(F.col("v")).alias("vb"), F.lit(1).alias("side"), "id", "vec", "n", "own", *none)
    return members.unionByName(queries).repartition("list", "mb", "vb").sortWithinPartitions("list", "mb", "vb", "side")


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    lengths = rows.where("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            out = []
            for v in part.column(1):
                if not v.is_valid or len(v) != dim or not dim or v.values.null_count:
                    out.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                out.append(x.astype(kind).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    s = Scratch(vectors.sparkSession)
    rows = s.save(rows.mapInArrow(valid, "vec_id long, vec binary"))
    classes = s.save(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    total = classes.count()
    if total:
        sample = unit_rows([r[0] for r in classes.where(unit_hash("vec") <= min(1.0, 2 * FIT_ROWS / total)).orderBy(F.xxhash64("vec"), "vec").limit(FIT_ROWS).select("vec").collect()], kind)
        index = Index(sample, max(1, min(FIT_ROWS // 8, math.ceil(2 * math.sqrt(total)))), math.sqrt(2 - 2 * cosine), exact)

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 1024):
                x = unit_rows(part.column("vec").to_pylist(), kind)
                at, codes, err = index.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "vec", "n")), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array([p.tolist() for p in index.probes(x)], pa.list_(pa.int32()))],
                    [c.split()[0] for c in INDEXED.split(", ")])

        known = s.save(classes.select("id", "vec", "n").mapInArrow(indexed, INDEXED))
        found = s.save(search(dealt(known).select("list", "mb", "vb", "side", "id", "vec", "n", "own", "codes", "err", "probes"), index, kind, cosine))
        links = found.where("x is null").groupBy(F.col("q").alias("id")).agg(F.sum("n").alias("more"))
        parts = s.save(connected_components(found.where("x is not null").select(F.col("q").alias("a"), F.col("x").alias("b"))))
        labelled = s.save(classes.join(links, "id", "left").join(parts, "id", "left"))
        least = labelled.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("m"))
        alone = labelled.where("component is null").select("vec", "n", F.coalesce("more", F.lit(0)).alias("more"), F.col("rep").alias("least"))
        classes = split_join(labelled.where("component is not null"), least, "component", "m", total).select("vec", "n", F.coalesce("more", F.lit(0)).alias("more"), "least").unionByName(alone)
    else:
        classes = classes.select("vec", "n", F.lit(0).alias("more"), F.col("rep").alias("least"))
    whole = classes.select("vec", "n", (F.col("n") - 1 + F.col("more")).alias("n_links"), F.col("least").alias("component_id"))
    good = split_join(rows.where("vec is not null"), whole, "vec", "n", rows.count()).select("vec_id", "n_links", "component_id")
    bad = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumns({"n_links": F.col("n_links").cast("long"), "kept": F.col("component_id").isNull() | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))})


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS src, vec_id AS seen FROM v UNION SELECT reach.src, link.b FROM reach JOIN link ON link.a = reach.seen),
comp AS (SELECT src, min(seen) AS component_id FROM reach GROUP BY src)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON src = vec_id
"""
