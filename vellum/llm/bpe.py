"""BPE encoding and decoding with a contiguous rank array.

A word is held as its parts' boundaries and the merge ranks of adjacent parts: the least rank is sought by a
scan, its boundary deleted and the two neighbouring ranks refreshed. Words of more than ``SHORT`` parts take
the same merges in the same order from a heap, so that one long word costs n log n.

The tokenizer's file gives vocabulary, merges and special tokens; it lies at the same path on all machines.
Special tokens' strings in a text become their ids, as in the tokenizers library. Text is put in NFC, lower-cased
letter by letter, split at white space and then by the pattern below; each word is spelled in bytes and ends with
``</w>``. Words, and runs of them and signs, are encoded once and kept in caches of bounded size per
Python worker.

Defined results. Null text: as empty, no ids. Empty text: no ids; decoded, the empty string. Null ids: decoded to
the empty string. Ids that are not in the vocabulary: ValueError. Repeated rows: each is encoded. No rows: no rows. Extra columns are dropped by ``encode`` and
kept by ``with_ids``. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

TOKENIZER = "word_bpe_49k.json"
SHORT = 64
CACHED_WORDS, CACHED_CHUNKS = 1_000_000, 300_000
#: White space and words of this tokenizer.
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Bpe:
    """One tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.id_of: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token = {i: t for t, i in self.id_of.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([self.token.get(i) for i in range(max(self.token) + 1)], pa.string())
        self.letters = byte_letters()
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """Parts of a word after all merges."""
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            b = after[k]
            if not parts[k] or b >= n or rank((parts[k], parts[b])) != r:
                continue
            parts[k] += parts[b]
            parts[b] = ""
            after[k] = after[b]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank((parts[before[k]], parts[k]))) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [p for p in parts if p]

    def spell(self, word: str) -> bytes:
        """Ids of one word of lower-cased text, as little-endian unsigned 32-bit integers."""
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        found = np.array([self.id_of[p] for p in self.merge(parts)], "<u4").tobytes()
        if len(word) <= SHORT:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        text = unicodedata.normalize("NFC", chunk)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        known, spell = self.words.get, self.spell
        found = b"".join([e if (e := known(w)) is not None else spell(w) for w in WORDS.findall(text)])
        if len(chunk) <= SHORT:
            if len(self.cache) >= CACHED_CHUNKS:
                self.cache.clear()
            self.cache[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.at_special is not None and "<|" in text and self.at_special.search(text):
            found, at = [], 0
            for m in self.at_special.finditer(text):
                found += [self.plain(text[at : m.start()]), np.uint32(self.special[m[0]]).astype("<u4").tobytes()]
                at = m.end()
            return b"".join([*found, self.plain(text[at:])])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text  # str.split() takes these for white space
        chunks = filter(None, WHITE.split(text)) if odd else text.split()
        known, chunk = self.cache.get, self.chunk
        found = [e if (e := known(c)) is not None else chunk(c) for c in chunks]
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0].as_py()

    def decode_all(self, ids: list[bytes]) -> pa.Array:
        """The texts that ids stand for: their tokens, with a space between."""
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = np.frombuffer(b"".join(ids), "<u4")
        if len(flat) and int(flat.max()) >= len(self.tokens):
            raise ValueError(f"id {int(flat.max())} is not in the vocabulary")
        tokens = self.tokens.take(pa.array(flat))
        if tokens.null_count:
            raise ValueError("an id is not in the vocabulary")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")


@functools.cache
def tokenizer(path: str) -> Bpe:
    """Once per Python worker."""
    return Bpe(path)


def vocabulary(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def id_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def with_ids(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """docs with token_ids (array of int); keep_text False drops the text."""
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != at]
    schema = T.StructType([*(docs.schema[k] for k in kept if docs.columns[k] != ids_col), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    kept = [k for k in kept if docs.columns[k] != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in slices(batches, 256):
            ids = [bpe.encode(t) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), id_lists(ids)], schema.names)

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """docs with the text that token_ids stand for, in a column decoded."""
    names = [c for c in docs.columns if c != "decoded"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in slices(batches, 256):
            texts = bpe.decode_all([np.array(x or [], "<i8").astype("<u4").tobytes() for x in part.column(ids_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), texts], schema.names)

    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids (little-endian unsigned 32-bit) and of the text decoded from them."""
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    schema = T.StructType([docs.schema["doc_id"], T.StructField(names[1], T.LongType()), *(T.StructField(c, T.StringType()) for c in names[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for part in slices(batches, 256):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            back = bpe.decode_all(ids).cast(pa.binary()).to_pylist()
            digests = (pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (ids, back))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *digests], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids and n_tokens of every document."""
    return with_ids(docs.select("doc_id", "lang", "source", "text"), vocabulary(), keep_text=False).withColumn("n_tokens", F.size("token_ids").cast("long"))
