"""Language-model scoring by deleted interpolation.

P(w | v) = a(v) c(v w) / c(v) + b(v) c(w) / N + g(v) / (V + 1). The weights depend on the bucket of the context's
count c(v), its bit length. They are learned by expectation-maximisation on held-out counts: documents of the
tuning fold are scored with the counts of the other training documents, and the EM runs on a histogram of the
quarter-octave bins of both estimates over all of their tokens. The final model counts the tuning fold too.

Counts are exact and cover all training documents. Documents are packed into chunks of about ``CHUNK_TOKENS``
tokens, each with its own word list. A chunk sends its distinct words and word pairs (64-bit hashes) with their
counts to the groups of a hash range, a row per chunk and range, so a common word comes once from a chunk; the group
adds them up and replies with the totals in the order asked. So tokens themselves are never shuffled one by one.
The number of ranges grows with the tokens; a group's size does not. A chunk has no more rows than distinct keys, so
rows grow at most as the tokens.

Defined results. Null or empty text: only the end token. Null doc_id: training, its scores under a null doc_id.
Repeated rows: each counts and is scored. No training documents: N and V are 0, every word is unknown. No tuning
documents: equal weights. No rows: no rows. Extra columns are dropped. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .minhash import mixed

FOLDS, HELD_OUT, TUNING = 7, 2, 3
CHUNK_TOKENS, RANGE_TOKENS = 1_000_000, 500_000
#: Groups of a hash range, and chunks, that one task takes; the number of tasks grows with the tokens.
RANGES_A_TASK, CHUNKS_A_TASK = 8, 2
BUCKETS, STEPS, EM_ROUNDS = 24, 4, 60
END = b"\n"  # no word holds a line end

CHUNKS = "chunk long, tuning boolean, docs int, doc_ids binary, folds binary, nulls binary, lengths binary, words binary, tokens binary"
REQUESTS = "chunk long, kind int, part int, keys binary, width int, train binary, tune binary"
REPLIES = "chunk long, kind int, part int, train binary, tune binary, known long"


def packed(v: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, 255 for those that follow in full."""
    large = v >= 255
    return np.int64(len(v)).tobytes() + np.minimum(v, 255).astype(np.uint8).tobytes() + v[large].astype("<i8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    v = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    v[v == 255] = np.frombuffer(raw, "<i8", offset=8 + n)
    return v


def packed_keys(k: np.ndarray) -> tuple[bytes, int]:
    """Sorted keys as differences of as many bytes as the largest takes."""
    d = np.diff(k, prepend=np.uint64(0))
    rest = d[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    return d[:1].tobytes() + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpacked_keys(raw: bytes, width: int) -> np.ndarray:
    rest = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, width)
    d = np.zeros((len(rest) + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, 8)
    d[1:, :width] = rest
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def chunked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, fold, text) packed into chunks; those of the tuning fold apart."""

    def row(chunk: int, tuning: bool, ids: list, folds: list[int], lengths: list[int], known: dict[bytes, int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        words = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        values = [chunk, tuning, len(ids), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(folds, np.uint8).tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(),
                  np.array(lengths, "<i8").tobytes(), words.tobytes(), squeeze(np.concatenate(tokens).astype("<u4").tobytes())]
        kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        empty = lambda: ([], [], [], {END: 0}, [])
        now = {True: empty(), False: empty()}
        size = {True: 0, False: 0}
        base = TaskContext.get().partitionId() << 32
        for part in slices(batches, 64):
            for i, fold, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                side = fold == TUNING
                ids, folds, lengths, known, tokens = now[side]
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                t = np.array([known.setdefault(w, len(known)) for w in words] + [0], np.uint32)
                ids.append(i)
                folds.append(fold)
                lengths.append(len(t))
                tokens.append(t)
                size[side] += len(t)
                if size[side] >= CHUNK_TOKENS:
                    yield row(base + made, side, *now[side])
                    made += 1
                    now[side], size[side] = empty(), 0
        for side in (True, False):
            if now[side][0]:
                yield row(base + made, side, *now[side])
                made += 1

    return docs.mapInArrow(run, CHUNKS)


class Chunk:
    """The arrays of a chunk row."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), "<u4").astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.folds = np.frombuffer(row["folds"], np.uint8)
        self.order = np.argsort(self.words, kind="stable")
        # the end before a document is the context of its first token
        self.contexts = np.concatenate([[0], self.tokens[:-1]])
        h = self.words
        self.pairs, self.pair_of = np.unique(mixed(h[self.contexts] * np.uint64(0x9E3779B97F4A7C15) + h[self.tokens]), return_inverse=True)

    def counts(self, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the words (in the order of their hashes) and of the pairs in documents of these folds."""
        w = np.repeat(folds, self.lengths).astype(float)
        one = np.bincount(self.tokens, w, len(self.words)).astype(np.int64)[self.order]
        return one, np.bincount(self.pair_of, w, len(self.pairs)).astype(np.int64)


def requests(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            c = Chunk(row)
            train, tune = c.counts(c.folds != HELD_OUT), c.counts(c.folds == TUNING) if row["tuning"] else None
            out = []
            for kind, keys in enumerate((c.words[c.order], c.pairs)):
                ends = np.searchsorted(keys, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64))
                at = [0, *ends.tolist(), len(keys)]
                for p, (a, b) in enumerate(zip(at, at[1:])):  # noqa: B905
                    if a < b:
                        raw, width = packed_keys(keys[a:b])
                        out.append((row["chunk"], kind, p, raw, width, packed(train[kind][a:b]), packed(tune[kind][a:b]) if tune else b""))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in REQUESTS.split(", ")])

    return chunks.mapInArrow(run, REQUESTS)


def totals(group: pd.DataFrame) -> pd.DataFrame:
    """All requests of a kind and hash range -> the totals, per chunk in the order asked; known: distinct training keys, on one row."""
    keys = [unpacked_keys(k, w) for k, w in zip(group["keys"], group["width"], strict=True)]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    train = np.bincount(at, np.concatenate([unpacked(x) for x in group["train"]]), len(every)).astype(np.int64)
    tune = np.bincount(at, np.concatenate([unpacked(x) if len(x) else np.zeros(len(k), np.int64) for x, k in zip(group["tune"], keys, strict=True)]), len(every)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    own = np.split(at, ends)
    known = np.zeros(len(group), np.int64)
    known[0] = (train > 0).sum()
    return pd.DataFrame({"chunk": group["chunk"], "kind": group["kind"], "part": group["part"], "train": [packed(train[k]) for k in own], "tune": [packed(tune[k]) if len(x) else b"" for k, x in zip(own, group["tune"], strict=True)], "known": known})


def answered(chunk: Chunk, replies: pd.DataFrame, cols: tuple[str, ...] = ("train",)) -> tuple[np.ndarray, ...]:
    """Per token: training count of the token, of its context and of the pair; then, if asked for, the same of the tuning fold."""
    replies = replies.sort_values(["kind", "part"])
    found = []
    for col in cols:
        one = np.zeros(len(chunk.words), np.int64)
        one[chunk.order] = np.concatenate([unpacked(x) for x in replies.loc[replies["kind"] == 0, col]])
        two = np.concatenate([unpacked(x) for x in replies.loc[replies["kind"] == 1, col]])
        found += [one[chunk.tokens], one[chunk.contexts], two[chunk.pair_of]]
    return tuple(found)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def estimates(token: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), token / max(n, 1)


def binned(p: np.ndarray) -> np.ndarray:
    """0 for none, else the quarter octave."""
    return np.where(p > 0, 1 + np.round(-STEPS * np.log2(np.maximum(p, 1e-300))), 0).astype(np.int64)


def unbinned(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 2.0 ** (-(k - 1) / STEPS), 0.0)


def expectation_maximisation(histogram: pd.DataFrame, v: int) -> np.ndarray:
    """Weights (BUCKETS x 3) of pair, word and uniform estimates from bucket, two, one (bins) and n (tokens)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # an unseen context has no pairs
    for b, rows in histogram.groupby("bucket"):
        p = np.stack([unbinned(rows["two"].to_numpy()), unbinned(rows["one"].to_numpy()), np.full(len(rows), 1 / (v + 1))], 1)
        n, w = rows["n"].to_numpy(float), weights[int(b)].copy()
        for _ in range(EM_ROUNDS):
            share = w * p
            w = (n[:, None] * share / share.sum(1)[:, None]).sum(0) / n.sum()
        w = np.maximum(w, [0 if not b else 1e-6, 1e-6, 1e-6])
        weights[int(b)] = w / w.sum()
    return weights


def lm_scores(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    doc_id = F.col("doc_id").cast("long")
    fold = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")
    s = Scratch(docs.sparkSession)
    chunks = s.save(chunked(docs.select(doc_id.alias("doc_id"), fold.alias("fold"), F.col("text").cast("string").alias("text"))))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            out = []
            for r in part.to_pylist():
                lengths, folds = np.frombuffer(r["lengths"], "<i8"), np.frombuffer(r["folds"], np.uint8)
                out.append((int(lengths.sum()), int(lengths[folds != HELD_OUT].sum()), int(lengths[folds == TUNING].sum())))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["all", "train", "tune"])

    every, train, tune = (x or 0 for x in chunks.select("folds", "lengths").mapInArrow(sizes, "all long, train long, tune long").agg(F.sum("all"), F.sum("train"), F.sum("tune")).first())
    bits = max(3, math.ceil(math.log2(max(every, 1) / RANGE_TOKENS))) if every else 3
    replies = s.save(requests(chunks, bits).repartition(max(8, (2 << bits) // RANGES_A_TASK), "kind", "part").groupBy("kind", "part").applyInPandas(totals, REPLIES))
    v = replies.where("kind = 0").agg(F.sum("known")).first()[0] or 0
    answers = replies.select("chunk", "kind", "part", "train", "tune")

    def gather(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(own.to_dict("records")[0])
        token, context, pair, token2, context2, pair2 = answered(c, told, ("train", "tune"))
        two, one = estimates(token - token2, context - context2, pair - pair2, train - tune)
        rows = pd.DataFrame({"bucket": bucket(context - context2), "two": binned(two), "one": binned(one)})
        return rows.groupby(["bucket", "two", "one"]).size().reset_index(name="n")

    tuning = chunks.where("tuning")
    asked = answers.where("octet_length(tune) > 0")
    gathered = tuning.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(gather, "bucket long, two long, one long, n long")
    weights = expectation_maximisation(gathered.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas(), v)

    def score(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = own.to_dict("records")[0]
        c = Chunk(row)
        token, context, pair = answered(c, told)
        two, one = estimates(token, context, pair, train)
        w = weights[bucket(context)]
        p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1)
        starts = np.cumsum(c.lengths) - c.lengths
        by_doc = lambda x: np.add.reduceat(x, starts)
        ids = pd.Series(np.frombuffer(row["doc_ids"], "<i8"), dtype="Int64").mask(np.frombuffer(row["nulls"], np.uint8) > 0)
        return pd.DataFrame({"doc_id": ids, "held_out": c.folds == HELD_OUT, "n_tokens": c.lengths, "n_known": by_doc((token > 0).astype(np.int64)), "train_tokens": train,
                             "base_score": by_doc(np.log10((token + 1) / (train + v + 1))), "score": by_doc(np.log10(p))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    tasks = max(8, chunks.count() // CHUNKS_A_TASK)
    told = answers.select("chunk", "kind", "part", "train").repartition(tasks, "chunk")
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(score, schema)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm_scores(table(spark, sf_dir, "documents"))
