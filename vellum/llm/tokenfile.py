"""Token ids in binary files: written in ascending doc_id order, compressed by an adaptive context-mixing range coder.

Documents are range-partitioned and sorted by doc_id; each task writes one file of independent blocks. A block
holds whole documents, about ``BLOCK_TOKENS`` ids: a table of doc_ids and lengths (deflated) and the ids as coder.py
codes them, both checksummed. The model is reset in every block, so any block can be read alone. Files lie in a
folder that all executors share and are opened by its URI; a file's name holds a random part, and the index names
only files of tasks that committed.

Texts are split at white space, where this tokenizer's words end, and the tokenizers library encodes each distinct
word, lower-case letters by its model alone; the words and their ids are kept in arrays, ``CACHED_WORDS`` at most per
Python worker, found by the sorted hashes of the words and compared. Texts that hold a special token's string, or a control
character that Arrow would split at, are given to the library whole.

Defined results. Null or empty text: only the end id. Null doc_id: before all others. Equal doc_ids: by text. No rows:
no files. Extra columns are dropped. Texts of any length are one document in one block.
"""

from __future__ import annotations

import array
import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import coder
from .bpe import byte_letters, vocabulary
from .common import cut, shared_dir, slices, table

END_ID = 2
TEXTS_A_BATCH = 2048
BLOCK_TOKENS = 3_000_000
CACHED_WORDS = 2_000_000
#: Signs that the tokenizer takes together, as one word of their own.
SIGNS = ".,;:!?*$%#&|"
#: Letters that lower-case one by one and that no letter joins with: ASCII and Latin-1.
SMALL_LETTERS = "a-zß-öø-ÿ"
PLAIN_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
#: A key of the table of words is a hash and, in its low bits, the word's place.
PLACE_BITS = 22
MULTIPLIER = 0x9E3779B97F4A7C15
MAGIC = b"IDBLOCK1"
FILES = "part int, file string, n_docs long, n_tokens long, n_bytes long"


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that begin at starts, one after another, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)], ends


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of 64 - PLACE_BITS bits of each string: its bytes as digits of a number."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sizes = np.diff(ends)
    powers = np.full(int(sizes.max(initial=0)) + 1, MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = int(ends[-1] - ends[0])
    place = np.arange(total) - np.repeat(ends[:-1] - ends[0], sizes)
    sums = np.zeros(total + 1, np.uint64)
    if total:
        np.cumsum((np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] + np.uint64(1)) * powers[place], out=sums[1:])
    mixed = (sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]) * np.uint64(MULTIPLIER)
    return (mixed ^ mixed >> np.uint64(32)) * np.uint64(MULTIPLIER) >> np.uint64(PLACE_BITS)


class ChunkEncoder:
    """The tokenizers library behind a table of words and their ids, held in arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # small letters beyond ASCII, spelled by signs that are none of them
        self.spelled = {c: "".join(byte_letters()[x] for x in c.encode()) for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.forget()

    def forget(self) -> None:
        self.words, self.keys = pa.array([], pa.string()), np.zeros(0, np.uint64)
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> tuple[array.array, array.array]:
        """Ids, one after another, and their numbers of words of lower-case letters: one word each to the tokenizer, so its model gets them, spelled in bytes."""
        ids, sizes = array.array("H"), array.array("q")
        text = "\n".join(words)
        if not text.isascii():
            for c, spelled in self.spelled.items():
                text = text.replace(c, spelled)
        tokenize = self.library.model.tokenize
        for word in text.split("\n") if words else ():
            found = tokenize(word)
            sizes.append(len(found))
            ids.extend([t.id for t in found])
        return ids, sizes

    def learn(self, words: pa.Array) -> np.ndarray:
        """Adds words to the table; their places."""
        distinct = words.dictionary_encode()
        new = distinct.dictionary
        plain = pc.match_substring_regex(new, f"^[{SMALL_LETTERS}]+$").to_numpy(zero_copy_only=False)
        order = np.argsort(~plain, kind="stable")
        new, n = new.take(pa.array(order)), int(plain.sum())
        strings = new.to_numpy(zero_copy_only=False).tolist()
        ids, sizes = self.letters(strings[:n])
        for found in self.whole(strings[n:]):
            sizes.append(len(found))
            ids.extend(found)
        sizes = np.array(sizes, np.int64)
        at = len(self.words) + np.arange(len(new))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint16)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.words = pa.concat_arrays([self.words, new])
        self.keys = np.sort(np.concatenate([self.keys, hashes(new) << np.uint64(PLACE_BITS) | at.astype(np.uint64)]))
        back = np.empty(len(new), np.int64)
        back[order] = at
        return back[distinct.indices.to_numpy()]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The places of words in the table; unknown ones are learned. A word whose hash is another's is learned each time."""
        if not len(words):
            return np.zeros(0, np.int64)
        if not len(self.keys):
            return self.learn(words)
        own = hashes(words)
        order = np.argsort(own)
        near = np.empty(len(words), np.int64)
        near[order] = np.searchsorted(self.keys, own[order] << np.uint64(PLACE_BITS))
        key = self.keys[np.minimum(near, len(self.keys) - 1)]
        at = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        known = np.flatnonzero(key >> np.uint64(PLACE_BITS) == own)
        known = known[pc.equal(self.words.take(pa.array(at[known])), words.take(pa.array(known))).to_numpy(zero_copy_only=False)]
        new = np.ones(len(words), bool)
        new[known] = False
        if new.any():
            at[new] = self.learn(words.filter(pa.array(new)))
        return at

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after another, and their numbers; letters and the signs after them are looked up apart."""
        if len(self.words) > CACHED_WORDS:
            self.forget()
        word = pc.utf8_rtrim(chunks, SIGNS)
        plain = pc.match_substring_regex(word, f"^[A-ZÀ-ÖØ-Þ{SMALL_LETTERS}]+$")
        sign = pc.if_else(plain, pc.utf8_ltrim(chunks, PLAIN_LETTERS), "").dictionary_encode()
        first = self.numbers(pc.if_else(plain, pc.utf8_lower(word), chunks))
        second = self.numbers(sign.dictionary)[sign.indices.to_numpy()]
        units = np.stack([first, second], 1).ravel()
        sizes = self.sizes[units]
        ids, _ = gathered(self.ids, self.starts[units], sizes)
        return ids, sizes.reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers.

        The texts are split and their chunks numbered by Arrow, so each distinct chunk of the batch is looked up once;
        the ids are then gathered by number.
        """
        odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]|" + "|".join(map(re.escape, self.special))).fill_null(False)
        found: dict[int, bytes] = {}
        for k in pc.indices_nonzero(odd).to_pylist():
            found[k] = np.array(self.whole([texts[k].as_py()])[0], "<u2").tobytes()
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts.fill_null("")))
        numbered = split.flatten().dictionary_encode()
        own, n = self.chunk_ids(numbered.dictionary)
        ends = 2 * np.concatenate([[0], np.cumsum(n)])
        chunks = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(own.astype("<u2"))])
        _, offsets, data = chunks.take(numbered.indices).buffers()
        cuts = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        ids = memoryview(data) if data else b""
        return [found.get(k) or bytes(ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]  # noqa: B905


@functools.cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    lengths = np.array([len(x) // 2 for x in ids], "<i8")
    head = zlib.compress(np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes() + lengths.tobytes(), 6)
    body = coder.encode(np.frombuffer(b"".join(ids), "<u2").astype(np.int64))
    return MAGIC + np.array([len(ids), len(head), zlib.crc32(head), len(body)], "<i8").tobytes() + head + body


def read_blocks(f: pa.NativeFile) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, lengths and all ids (little-endian unsigned 32-bit) of one block after another."""
    while magic := f.read(len(MAGIC)):
        n, size, crc, body = np.frombuffer(f.read(32), "<i8").tolist()
        head = f.read(size)
        if magic != MAGIC or zlib.crc32(head) != crc:
            raise ValueError("damaged block")
        raw = zlib.decompress(head)
        ids, nulls, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<i8", n, 9 * n)
        yield [None if z else i for i, z in zip(ids.tolist(), nulls, strict=True)], lengths, coder.decode(f.read(body))


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes docs (doc_id long, text) and writes the files; returns the index of files in order (FILES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        end = np.array([end_id], "<u2").tobytes()
        encoder = chunk_encoder(path)
        out, n_docs, n_tokens, n_bytes, held = None, 0, 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def flush() -> int:
            raw = write_block(doc_ids, ids)
            out.write(raw)
            doc_ids.clear()
            ids.clear()
            return len(raw)

        try:
            for batch in slices(batches, TEXTS_A_BATCH):
                out = out or store.open_output_stream(name, compression=None)
                for i, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                    doc_ids.append(i)
                    ids.append(x + end)
                    held += len(ids[-1]) // 2
                    if held >= BLOCK_TOKENS:
                        n_docs, n_tokens, held, n_bytes = n_docs + len(ids), n_tokens + held, 0, n_bytes + flush()
            if ids:
                n_docs, n_tokens, n_bytes = n_docs + len(ids), n_tokens + held, n_bytes + flush()
        finally:
            if out is not None:
                out.close()
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (name, pa.string()), (n_docs, pa.int64()), (n_tokens, pa.int64()), (n_bytes, pa.int64()))], [c.split()[0] for c in FILES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILES))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of write_ids()."""
    starts = files.select("file", "part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in slices(batches, 64):
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as f:
                    for doc_ids, lengths, ids in read_blocks(f):
                        ends = np.cumsum(lengths)
                        at = (ends - lengths).tolist()
                        sums = [zlib.crc32(ids[a:b]) for a, b in zip(at, ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1]) if len(ends) else 0

    dealt = starts.repartitionByRange(max(1, files.count()), "part")
    return dealt.select("file", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder, vocabulary()), folder)
