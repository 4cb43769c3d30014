"""Quality rules: an isolation forest on rule statistics.

Each text gets its rule statistics (words, symbols, repeated lines and word windows, capitals, exclamation
marks) and, from all of them, ``RATES``, measured in the width that most good labelled rows cover. A tree is grown
over good rows in the box that all labelled rows span: the box is cut at a random place across a random rate, a rate
being as likely as the box is long in it, until a part holds one row or none. Parts that no good text reaches are cut off
early, so the shorter a document's mean path over the trees, the odder it is; its combination of rates may be odd
although each of them is usual. Widths and forest are fitted on a bounded sample of labelled rows (``FIT_ROWS``); the
threshold is calibrated over all labelled rows, and path length alone decides.

Defined results. Null text: no words, so the base rules reject it. Empty text: the same. Repeated rows: each
is judged on its own. Null doc_id: judged, but without a label. No table of labels, or none of quality 1: no
verdict can be learned, and every document that passes the base rules is kept. Labels that contradict each
other: the lower one holds. Extra columns are kept by ``apply_quality`` and dropped by ``quality_report``;
names cannot clash, since results are written under the names given in the docstrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, cut, slices, table

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: At most so many labelled rows fit the forest; those of the smallest hashes are taken.
FIT_ROWS = 8192
TREES, ROWS_A_TREE = 100, 256
#: What the forest splits on: symbols, capitals, exclamation marks, letters, repeated lines, repeated words, words a line.
RATES = ("symbols / words", "capitals / letters", "marks / words", "letters / words", "repeated / lines", "repeated / words", "words / lines")
#: A rate's width is what the labelled good rows of the sample cover but for this share at either end.
EDGE = 0.01
#: The threshold is the strictest that rejects at most this share of the labelled good rows.
MAX_FALSE_REJECTS = 0.002
BINS = 2000


def rule_statistics(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    dup = full = 0
    for line in lines:
        if line in seen:
            dup += 1
            full += 1
        elif line and not line.isspace():
            seen.add(line)
            full += 1
    letters = np.frombuffer(raw, np.uint8)
    upper = int(((letters - np.uint8(65)) < 26).sum())
    return n, len(text) - blanks, symbols, dup, repeated_words(words), upper, text.count("!"), full


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    v = len(known)
    pairs = ids[:-1] * v + ids[1:]
    if v > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def rates(s: np.ndarray) -> np.ndarray:
    """Rows of STATS as RATES."""
    n, chars, symbols, dup, repeat, upper, marks, lines = (s[:, k].astype(float) for k in range(len(STATS)))
    words, letters, full = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([symbols / words, upper / letters, marks / words, chars / words, dup / full, repeat / words, n / full], 1)


@dataclass
class Scale:
    """Where good rows begin in each rate, and the width they cover."""

    low: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, good: np.ndarray) -> Scale:
        low, high = np.quantile(rates(good), (EDGE, 1 - EDGE), axis=0)
        return cls(low, np.maximum(high - low, 1e-3))

    def features(self, s: np.ndarray) -> np.ndarray:
        return (rates(s) - self.low) / self.width


def failed_base(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PERCENT * s[:, 0])


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m)


@dataclass
class IsolationForest:
    """Trees as flat arrays: the feature (-1 in a leaf), the split, the children, the path length at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    rows: int

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, trees: int = TREES, rows: int = ROWS_A_TREE, seed: int = 7) -> IsolationForest:
        """Trees over rows of x that are good, in the box of all of x."""
        rng = np.random.default_rng(seed)
        inside = np.flatnonzero(good)
        rows = min(rows, len(inside))
        limit = int(np.ceil(np.log2(max(rows, 2))))
        size = 2 ** (limit + 1)
        feature, split = np.full((trees, size), -1), np.zeros((trees, size))
        child, depth = np.zeros((trees, size), int), np.zeros((trees, size))
        for t in range(trees):
            used = 1
            todo = [(0, x[rng.choice(inside, rows, replace=False)], x.min(0), x.max(0), 0)]
            while todo:
                at, part, low, high, d = todo.pop()
                long = high - low
                if d >= limit or len(part) <= 1 or not long.sum():
                    depth[t, at] = d + float(mean_depth(len(part)))
                    continue
                k = rng.choice(len(long), p=long / long.sum())
                cutoff = rng.uniform(low[k], high[k])
                left = part[:, k] < cutoff
                feature[t, at], split[t, at], child[t, at] = k, cutoff, used
                below, above = high.copy(), low.copy()
                below[k] = above[k] = cutoff
                todo += [(used, part[left], low, below, d + 1), (used + 1, part[~left], above, high, d + 1)]
                used += 2
        return cls(feature, split, child, depth, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-path/mean path): towards 1 for rows that few splits isolate."""
        path = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, child, depth in zip(self.feature, self.split, self.child, self.depth, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(64):
                k = feature[at]
                inner = k >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(k, 0)] >= split[at]
                at = np.where(inner, child[at] + right, at)
            path += depth[at]
        return 2 ** -(path / len(self.feature) / max(float(mean_depth(self.rows)), 1e-9))


@dataclass
class QualityModel:
    """All are None if no labels could be learned from."""

    scale: Scale | None
    forest: IsolationForest | None
    threshold: float | None

    def keeps(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and verdict of rows of STATS."""
        score = self.forest.score(self.scale.features(s)) if self.forest is not None and len(s) else np.zeros(len(s))
        ok = ~failed_base(s)
        return score, ok if self.threshold is None else ok & (score <= self.threshold)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [rule_statistics(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], ["doc_id", *STATS])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in STATS], 1) if part.num_rows else np.zeros((0, len(STATS)), np.int64)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_false_rejects: float = MAX_FALSE_REJECTS) -> QualityModel:
    """Forest from at most fit_rows labelled rows, threshold from a histogram of the scores of all labelled rows."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = stats.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    rows = cut(passed.join(known, "doc_id").select(*STATS, (F.col("quality") > 0).alias("good"), F.xxhash64("doc_id").alias("by")))
    # a share of the hashes first, so that each task sends few rows
    share = min(1.0, 2 * fit_rows / max(1, rows.count()))
    sample = rows.where(F.shiftrightunsigned("by", 11) < int(share * (1 << 53))).orderBy("by", *STATS).limit(fit_rows).select(*STATS, "good").toPandas()
    sample, good = sample[list(STATS)].to_numpy(), sample["good"].to_numpy(bool)
    if len(sample) < 2 or not good.any():
        return QualityModel(None, None, None)
    scale = Scale.of(sample[good])
    forest = IsolationForest.fit(scale.features(sample), good)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            at = np.minimum((forest.score(scale.features(matrix(part))) * BINS).astype(int), BINS)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part.column("good")], ["bin", "good"])

    counts = rows.select(*STATS, "good").mapInArrow(binned, "bin int, good boolean").groupBy("bin").agg(F.sum(F.col("good").cast("long")).alias("good")).toPandas()
    good = np.zeros(BINS + 1)
    good[counts["bin"]] = counts["good"]
    # rejected by a threshold at the upper end of bin k: all in higher bins
    lost = 1 - np.cumsum(good) / max(good.sum(), 1)
    return QualityModel(scale, forest, (int(np.flatnonzero(lost <= max_false_rejects + 1e-12)[0]) + 1) / BINS)


def quality_report(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the rule statistics, base_failed, score and kept of every row of with_statistics()."""
    names = [*STATS[:5], "base_failed", "score", "kept"]
    schema = T.StructType([stats.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in STATS[:5]), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            s = matrix(part)
            score, kept = model.keeps(s)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in STATS[:5]), pa.array(failed_base(s)), pa.array(score), pa.array(kept)], ["doc_id", *names])

    return stats.mapInArrow(run, schema)


def apply_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = np.array([rule_statistics(t) for t in part.column(at).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield part.filter(pa.array(model.keeps(s)[1]))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    stats = cut(with_statistics(table(spark, sf_dir, "documents")))
    return quality_report(stats, fit(stats, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    model = fit(cut(with_statistics(docs)), table(spark, sf_dir, "labels"))
    return apply_quality(docs, model)
