"""Each operator against a brute-force version, an oracle, a round trip or held-out figures, on small and odd inputs."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows_of, same_rows
from pyspark.sql import functions as F

from vellum.llm import bpe, chat, coder, embeddings, lines, lm, minhash, mixing, quality, registry, tokenfile, warc
from vellum.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, regs string, key string, band long"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
ODD = [None, "", " \n\t ", "one", "one", "One two", "a b c d e f g h i j\n\na b c d e f g h i j", LONG, LONG + " tail", "x" * 5000, "#$%& | <b> ### \\ </turn>", "née é \U0001f600 ΑΣ \x1c y"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None, "clash", "clash", 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], rows[8], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def sf(spark, tmp_path):
    """A folder with the given tables."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, DATA), duck.execute(registry.ORACLES[name]))


# components


def test_components_of_a_chain_and_a_star(spark):
    chain, star = [(k, k + 1) for k in range(100, 160)], [(k, 7) for k in range(20, 60)]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([*chain, *star, (5, 5), (7, 20)], "a long, b long")).collect()}
    assert found == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(20, 60)]}


# 1


def shingle_set(text, width=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))} if words else set()


def components_by_hand(texts, width=2):
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_minhash_odd(odd, none):
    found = minhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by_hand = components_by_hand({k: t for k, t in enumerate(ODD)})
    assert all((r["n_shingles"], r["component_id"]) == by_hand[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_borderline_and_a_large_group(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(300)) for _ in range(120)]
    texts = {}
    for k in range(260):
        words = list(base)
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10_000)}"
        texts[k] = " ".join(words)
    texts |= {1000 + k: " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for k in range(150)}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == components_by_hand(texts)


def test_bounds_never_exclude_a_link():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.8, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        if len(b) and minhash.links(a, b):
            ra, rb = minhash.registers(a), minhash.registers(b)
            assert minhash.may_link(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]


def test_minhash_family_of_near_copies(spark):
    """One text in many edited copies: all links are kept, and the pairs compared grow no faster than n log n."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]

    def copies(n):
        texts = {}
        for k in range(n):
            words = list(base)
            for _ in range(rng.randrange(8)):
                words[rng.randrange(60)] = f"z{rng.randrange(50_000)}"
            texts[k] = " ".join(words)
        return texts

    pairs = []
    save = minhash.Scratch.save

    def counting(self, df):
        out = save(self, df)
        if df.columns == ["centre", "leaf"]:
            pairs.append(out.count())
        return out

    minhash.Scratch.save = counting
    try:
        for n in (600, 1800):
            texts = copies(n)
            found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
            assert found == components_by_hand(texts)
    finally:
        minhash.Scratch.save = save
    few, many = sum(pairs[:3]), sum(pairs[3:])
    assert many <= 1.3 * few * (1800 * math.log(1800)) / (600 * math.log(600))


def test_minhash_rows_that_share_an_id(spark):
    a, b = "one two three four", " ".join(f"w{k}" for k in range(40))
    rows = [(1, a), (1, b), (6, b + " more"), (7, a), (0, None), (0, b + " more"), (9, "alone"), (9, "")]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(0, 0, 0, True), (0, 40, 0, True), (1, 3, 0, False), (1, 39, 0, False), (6, 40, 0, False), (7, 3, 0, False), (9, 0, 9, True), (9, 1, 9, True)]


# 2 and 3


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def random_texts(n):
    rng = random.Random(1)
    letters = "aAbé'sS tTlLdDΣσİ1٣½<|endoftext|>.,!  \n\x1c\x85  漢字\U0001f600é́ﬁ"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)] + ["don't<|endoftext|>Foo <|startoftext|>", "a" * 3000, "aab" * 500 + "!" * 300]


def test_bpe_equals_the_library(library):
    own = bpe.tokenizer(bpe.vocabulary())
    chunks = tokenfile.chunk_encoder(bpe.vocabulary())
    texts = [t for t in [*random_texts(3000), *ODD] if t is not None]
    for text, e, c in zip(texts, library.encode_batch(texts, add_special_tokens=False), chunks.encode(pa.array(texts, pa.string())), strict=True):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids == np.frombuffer(c, "<u2").tolist()
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_unknown_ids_are_told():
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.tokenizer(bpe.vocabulary()).decode(np.array([1, 60_000], "<u4").tobytes())


def test_long_words_merge_alike():
    own = bpe.tokenizer(bpe.vocabulary())
    for word in ("thethethe" * 7, "ingandth" * 8):
        parts = [*word[:-1], word[-1] + own.end]
        short = bpe.SHORT
        try:
            bpe.SHORT = 10_000
            by_scan = own.merge(list(parts))
        finally:
            bpe.SHORT = short
        assert own.merge_long(list(parts)) == by_scan


def test_bpe_query(odd, none, sf, spark, library):
    found = bpe.encode_digests(odd, bpe.vocabulary()).collect()
    assert len(found) == odd.count()
    for r in found:
        if r["doc_id"] is not None:
            e = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decoded(bpe.with_ids(odd, bpe.vocabulary()), bpe.vocabulary())
    assert back.count() == odd.count() and set(odd.columns) < set(back.columns)
    assert bpe.op2_bpe(spark, sf(documents=none)).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [65535], [7] * 5000, list(range(3000)) * 2, list(np.random.default_rng(2).integers(0, 65536, 4000)), list(np.random.default_rng(3).zipf(1.3, 9000) % 49408)])
def test_coder_round_trip(ids):
    raw = coder.encode(np.array(ids, np.int64))
    assert coder.decode(raw).tolist() == list(ids)


def test_coder_mixes():
    """The widths of all ids tile the range for every kind of context, and an id has the sum of its shares, once."""
    rng = np.random.default_rng(5)
    history = [[0] for _ in range(64)]
    model = coder.Model(64)
    for _ in range(129):
        ids = np.minimum(rng.zipf(1.4, 64), 500) % 500
        _, _, coded, _ = model.place(ids)
        model.learn(ids, coded)
        for lane, i in zip(history, ids.tolist(), strict=True):
            lane.append(i)
    seen = {}
    for lane in history:
        for a, b in zip(lane[:-2], lane[1:-1], strict=True):  # the last step has not been folded in
            seen.setdefault(a, Counter())[b] += 1
    owned = model.owner[model.owner >= 0]
    every = np.arange(1 << 16)
    lone = next(c for c in sorted(seen, key=lambda c: -sum(seen[c].values())))
    for last, pair in ((lone, 400 << 16 | 65000), (int(owned[0] & 0xFFFF), int(owned[0])), (int(owned[-1] & 0xFFFF), int(owned[-1])), (60000, 60000)):
        model.last, model.pair = np.full(1 << 16, last), np.full(1 << 16, pair)
        start, width, _, raw = model.place(every)
        parts = np.unique(np.stack([start, start + width], 1), axis=0)
        assert parts[0, 0] == 0 and parts[-1, 1] == 1 << 24 and (parts[1:, 0] == parts[:-1, 1]).all() and (width > 0).all()
        slots = np.linspace(0, (1 << 24) - 1, 1 << 16).astype(np.int64)
        back, start_back, width_back, _ = model.symbols(slots)
        assert ((start_back <= slots) & (slots < start_back + width_back)).all()
        known = back < 1 << 16
        assert (start[back[known]] == start_back[known]).all() and (width[back[known]] == width_back[known]).all() and set(raw) == set(np.flatnonzero(model.freq[:-1] == 0)) - set(back[known])
    model.last, model.pair = np.full(1 << 16, lone), np.full(1 << 16, 400 << 16 | 65000)
    _, width, coded, _ = model.place(every)
    top = sorted(seen[lone].items(), key=lambda x: (-x[1], x[0]))[: coder.ONE_MOST]
    came = model.came[model.cell[(1 << 16) + lone]]
    a1 = coder.MOST_LISTED * came[1] / came.sum() / 65536
    for i, n in top:
        assert width[i] / (1 << 24) == pytest.approx(a1 * n / sum(n for _, n in top) + (1 - a1) * model.freq[i] / 65536, abs=1e-3)
    assert set(np.flatnonzero(coded >= 0)) == {i for i, _ in top}


def test_coder_checksum_and_limit():
    raw = bytearray(coder.encode(np.arange(4000) % 50))
    raw[-40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(bytes(raw))
    with pytest.raises(ValueError, match="below"):
        coder.encode(np.array([65536]))


def test_token_files(odd, none, sf, spark, library):
    found = tokenfile.op3_tokenfile(spark, sf(documents=odd)).orderBy("start").collect()
    known = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(found, known, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_a_look_at_few_words_does_not_go_through_the_table():
    chunks = tokenfile.ChunkEncoder(bpe.vocabulary())
    letters = np.frombuffer(b"abcdefghijklmnopqrst", np.uint8)
    many = letters[np.arange(160_000)[:, None] // 20 ** np.arange(4) % 20].view("S4").ravel().astype(str).tolist()
    chunks.encode(pa.array([" ".join(many)], pa.string()))
    few = pa.array(["the of, And", None, "", " "], pa.string())

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: chunks.encode(few)) < least(lambda: chunks.words.dictionary_encode())


def test_words_of_one_hash_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "hashes", lambda words: np.full(len(words), (1 << 42) - 1, np.uint64))
    chunks = tokenfile.ChunkEncoder(bpe.vocabulary())
    texts = ["The cat, the hat", "été über straße", "the <|endoftext|> dog 12", "", "hat!! the Été"]
    for _ in range(3):
        found = [np.frombuffer(x, "<u2").tolist() for x in chunks.encode(pa.array(texts, pa.string()))]
        assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_texts_without_words():
    chunks = tokenfile.ChunkEncoder(bpe.vocabulary())
    for texts in (["", " ", None], [None], []):
        assert chunks.encode(pa.array(texts, pa.string())) == [b""] * len(texts)


def test_coder_holds_rows_of_seen_contexts_only():
    model = coder.Model(64)
    for ids in np.random.default_rng(6).integers(0, 300, (17, 64)):
        model.learn(ids, model.place(ids)[2])
    assert sum(a.nbytes for a in vars(model).values() if isinstance(a, np.ndarray)) < 1 << 23


@pytest.mark.parametrize("ids", [[65535, 5] * 4000, [65535, 65534, 65535] * 3000, list(range(65536)) * 3])
def test_coder_round_trip_of_the_last_id(ids):
    assert coder.decode(coder.encode(np.array(ids, np.int64))).tolist() == ids


def test_token_files_of_nothing(none, sf, spark):
    assert tokenfile.op3_tokenfile(spark, sf(documents=none)).count() == 0


# 4


def test_chat_log(spark):
    log = [(1, 0, 1, "start", "user", ""), (1, 0, 2, "delta", None, "Hel"), (1, 0, 3, "delta", None, "lo"), (1, 1, 1, "start", "assistant", ""), (1, 1, 2, "delta", None, "bad"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "go"),
           (1, 1, 5, "delta", None, "od"), (1, 0, 9, "edit", None, "Hi # </turn>"), (1, 1, 6, "noise", None, "?"), (2, 0, 1, "delta", None, "stray"), (None, None, None, None, None, None)]
    found = {r["conv_id"]: r for r in chat.parse(chat.chat_format(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string"))).collect()}
    assert [tuple(t) for t in found[1]["turns"]] == [("user", "Hi # </turn>"), ("assistant", "good")]
    (span,) = found[1]["loss_spans"]
    assert found[1]["formatted"][span["start"] : span["start"] + span["length"]] == "good"
    assert [tuple(t) for t in found[2]["turns"]] == [("", "stray")] and found[None]["turns"] == []


def test_chat_round_trip(spark):
    rng = random.Random(4)
    said = lambda: "".join(rng.choice(["\\", "#", "</turn>", "\n", "### ", ":", " ", "é", "$1", "<\\/turn>"]) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "a: b\\", ""]), said()) for c in range(40) for t in range(5)]
    turns = spark.createDataFrame([*rows, (99, 0, None, None), (99, None, "user", "x"), (99, None, "user", "x")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.parse(chat.chat_format(chat.conversation_log(turns))).collect()}
    assert all(found[c] == [(r[2], r[3]) for r in rows if r[0] == c] for c in range(40))
    assert found[99] == [("user", "x"), ("user", "x"), ("", "")]


def test_chat_ties_in_the_order_of_the_oracle(spark, sf, duck):
    rows = [(1, 0, "user", t) for t in ("zz", "aa", "mm", "aa")] + [(1, 0, "assistant", "z"), (2, 1, "user", None), (2, 1, None, "x"), (2, 1, "user", "")]
    at = sf(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.parse(chat.chat_format(chat.conversation_log(spark.read.parquet(f"{at}/conversations.parquet")))).collect()}
    assert found[1] == [("assistant", "z"), ("user", "aa"), ("user", "aa"), ("user", "mm"), ("user", "zz")]
    assert found[2] == [("", "x"), ("user", ""), ("user", "")]
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
    same_rows(chat.op4_chat(spark, at), con.execute(registry.ORACLES["op4_chat"]))


def test_chat_of_many_deltas(spark):
    log = [(1, 0, 0, "start", "assistant", "")] + [(1, 0, k, "delta", None, f"{k} ") for k in range(1, 3000)]
    (found,) = chat.parse(chat.chat_format(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string"))).collect()
    assert [tuple(t) for t in found["turns"]] == [("assistant", "".join(f"{k} " for k in range(1, 3000)))]


def test_chat_of_nothing(spark, sf):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.op4_chat(spark, sf(conversations=empty)).collect()] == [-7]


def test_chat_long_roles_and_many_turns(spark):
    """A role of a million characters, marks at the start of a text, and time linear in the turns."""
    import time

    role = "a:\\# </turn>\n" * 80_000
    rows = [(1, 0, role, "\ufeffx"), (1, 1, "assistant", "\ufeff\U0001f600 \\"), (1, 2, "assistant", ""), (2, 0, "assistant", "y" * 1_000_000)]
    log = chat.conversation_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = chat.parse(chat.chat_format(log)).select("*", F.transform(chat.under(F.col("formatted"), F.col("loss_spans")), chat.unescape).alias("lost")).orderBy("conv_id").collect()
    assert [[tuple(t) for t in r["turns"]] for r in read] == [[(a, b) for c, _, a, b in rows if c == k] for k in (1, 2)]
    assert [r["lost"] for r in read] == [["\ufeff\U0001f600 \\", ""], ["y" * 1_000_000]]
    long = spark.range(12_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word # "), 20).alias("text"))
    start = time.time()
    (found,) = chat.parse(chat.chat_format(chat.conversation_log(long))).select(F.size("turns").alias("n"), F.array_join(chat.under(F.col("formatted"), F.col("loss_spans")), "").alias("lost")).collect()
    assert found["n"] == 12_000 and found["lost"] == "word \\# " * 20 * 6000 and time.time() - start < 30


# 5


def lines_by_hand(docs, min_words=lines.MIN_WORDS):
    """{doc_id: deleted places}: every run of lines with words that reaches min_words, by content."""
    first, gone = {}, defaultdict(set)
    runs = []
    for doc_id in sorted(docs):
        own = [(k, x) for k, x in enumerate((docs[doc_id] or "").split("\n")) if x.encode().split()]
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b][1].encode().split())
                if n >= min_words:
                    content = tuple(x for _, x in own[a : b + 1])
                    runs.append((doc_id, a, [k for k, _ in own[a : b + 1]], content))
                    first.setdefault(content, (doc_id, a))
                if b - a > 40:
                    break
    for doc_id, a, places, content in runs:
        if first[content] < (doc_id, a):
            gone[doc_id] |= set(places)
    return gone


def test_lines_by_hand(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))) for _ in range(8)] + ["", " "]
    docs = {k: "\n".join(rng.choice(pool) if rng.random() < 0.8 else f"own {k} {rng.random()}" for _ in range(rng.randrange(1, 14))) for k in range(80)}
    found = lines.without_later_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    gone = lines_by_hand(docs)
    assert sum(map(len, gone.values())) > 50
    for r in found:
        kept = [x for k, x in enumerate(docs[r["doc_id"]].split("\n")) if k not in gone[r["doc_id"]]]
        assert (r["text"], r["n_deleted"]) == ("\n".join(kept), len(gone[r["doc_id"]]))


def test_lines_of_repeated_rows(spark):
    text = "\n".join(["a b c", "d e f", "g h i", "j k l", "m n o"])
    rows = [(1, text), (2, text), (2, text), (3, "other"), (3, "other"), (None, text + "\nz"), (4, None), (4, None)]
    found = lines.without_later_copies(spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], "doc_id long, text string, deleted string, n_lines long, d string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_deleted"], r["deleted"], r["d"]) for r in found if r["doc_id"] != 4) == sorted(
        [(0, text + "\nz", 6, 0, "clash", "clash"), (1, "", 5, 5, "clash", "clash"), (2, "", 5, 5, "clash", "clash"), (2, "", 5, 5, "clash", "clash"), (3, "other", 1, 0, "clash", "clash"), (3, "other", 1, 0, "clash", "clash")])
    assert [(r["text"], r["n_lines"]) for r in found if r["doc_id"] == 4] == [(None, 0)] * 2


def test_lines_of_a_long_repeated_run(spark):
    run = [f"line {k}" for k in range(400)]
    docs = {1: "\n".join(run), 2: "\n".join(["x", *run[50:350], "y"]), 3: "\n".join(["line 7"] * 9), 4: "\n".join(["line 7"] * 9)}
    found = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in lines.without_later_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert found == {1: (docs[1], 0), 2: ("x\ny", 300), 3: ("line 7", 8), 4: ("", 9)}


def test_shared_prefixes_by_hand(spark):
    """The longest prefix shared with an earlier suffix, against all pairs; sequences of few different lines, of which some are missing."""
    rng = random.Random(5)
    docs = {d: [rng.randrange(2 + d % 3) if rng.random() < 0.97 else None for _ in range(rng.randrange(1, 40))] for d in range(24)} | {30: [7] * 50, 31: [7] * 20}
    rows = [(d, 0, k, v) for d, line in docs.items() for k, v in enumerate(line) if v is not None]
    s = lines.Scratch(spark)
    many = spark.createDataFrame(rows, "d long, h long, k int, v int")
    levels = lines.suffix_ranks(lines.ranked(many, ["v"], len(rows), s), len(rows), s)
    assert len(levels) == 6  # 32 of the 50 equal lines occur again, 64 do not
    found = {(r["d"], r["k"]): r["n"] for r in lines.shared_prefixes(levels, len(rows), s).collect()}

    def shared(p, q):
        a, b = docs[p[0]][p[1] :], docs[q[0]][q[1] :]
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x is None or x != y), min(len(a), len(b)))

    at = [r[:1] + r[2:3] for r in rows]
    longest = {p: max((shared(p, q) for q in at if q < p), default=0) for p in at}
    assert found == {p: n for p, n in longest.items() if n}


def test_lines_of_many_equal_lines(spark):
    docs = {1: "\n".join(["line of one text"] * 10_000), 2: "\n".join(["line of one text"] * 3)}
    found = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in lines.without_later_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert found == {1: ("line of one text", 9_999), 2: ("", 3)}


def test_lines_odd(odd, none):
    found = lines.without_later_copies(odd).collect()
    assert len(found) == odd.count()
    assert all(r["text"] is None and not r["n_lines"] for r in found if r["doc_id"] == 0)
    assert {r["text"] for r in found if r["doc_id"] == 6} == {"a b c d e f g h i j\n"}
    assert lines.without_later_copies(none).count() == 0


# 6


def test_embeddings_by_hand(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + rng.normal(scale=0.12, size=(60, 16)), x[:20], x[:5] * 3, x[:1]]).astype(np.float32)
    ids = [*range(len(x) - 1), None]  # the last row is a vector as any other, without an id
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [1.0], 0), (905, [], 0), (906, [float("inf")] + [1.0] * 15, 0)]
    found = embeddings.embedding_duplicates(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, n long")).collect()
    assert len(found) == len(rows) + len(odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= embeddings.COSINE
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([label[near[k]].min() for k in range(len(x))])
        if (new == label).all():
            break
        label = new
    for r in found:
        if r["vec_id"] is not None and r["vec_id"] >= 900:
            assert r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"]
        else:
            k = len(x) - 1 if r["vec_id"] is None else r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (near[k].sum() - 1, label[k], r["vec_id"] == label[k])


def test_embeddings_of_great_and_small_length(spark):
    big, small = [1e200, 2e200], [1e-200, 2e-200]
    found = embeddings.embedding_duplicates(spark.createDataFrame([(1, big), (2, small), (3, [1.0, 2.0]), (3, [2.0, 1.0]), (None, [-5.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 2, 1, False)]


@pytest.mark.parametrize("n", [20_000])
def test_embeddings_recall(spark, n):
    """Measured against all pairs, at borderline cosines and a size with many lists."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n // 2, 64))
    y = x + rng.normal(size=x.shape) * rng.uniform(0.05, 0.4, len(x))[:, None]
    x = np.concatenate([x, y]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))}))
    found = embeddings.embedding_duplicates(df).toPandas().set_index("vec_id").loc[np.arange(n)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    degree = np.concatenate([(u[k : k + 1000] @ u.T >= embeddings.COSINE).sum(1) - 1 for k in range(0, n, 1000)])
    assert (found["n_links"].to_numpy() <= degree).all()
    recall = found["n_links"].sum() / degree.sum()
    assert degree.sum() > n / 4 and recall >= 0.999


@pytest.mark.parametrize(("varied", "exact", "least"), [(64, False, 0.999), (8, False, 0.99), (4, False, 0.99), (16, False, 0.99), (16, True, 1.0)])
def test_embeddings_of_low_dimension(spark, varied, exact, least):
    """Links found where vectors vary in few of their dimensions."""
    rng = np.random.default_rng(varied)
    half = np.zeros((1500, 64))
    half[:, :varied] = rng.normal(size=(1500, varied))
    half /= np.linalg.norm(half, axis=1)[:, None]
    noise = np.zeros_like(half)
    noise[:, :varied] = rng.normal(size=(1500, varied))
    noise -= (noise * half).sum(1)[:, None] * half
    x = np.concatenate([half, half * 0.952 + noise / np.linalg.norm(noise, axis=1)[:, None] * math.sqrt(1 - 0.952**2)])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))}))
    found = embeddings.embedding_duplicates(df, exact=exact).agg(F.sum("n_links")).first()[0]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int((u @ u.T >= embeddings.COSINE).sum()) - len(x)
    assert least * want <= found <= want


def test_embeddings_of_nothing(spark):
    assert embeddings.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = embeddings.embedding_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["n_links"], r["kept"]) for r in only] == [(0, True)] * 2


# 7


def statistics_by_hand(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@pytest.mark.parametrize("text", [*ODD, "a b c a b c\na b c\na b c", "x x x x", "\n\n \n"])
def test_rule_statistics(text):
    assert quality.rule_statistics(text)[:5] == statistics_by_hand(text)


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.with_statistics(docs).cache()
    model = quality.fit(stats, labels.where("doc_id % 2 = 0"))
    judged = quality.quality_report(stats, model).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in judged}
    assert kept[1] >= 0.98 and kept[0] <= 0.2


def test_quality_verdicts_by_hand(spark):
    """Statistics, ranges, path lengths and verdicts, each row and tree walked on its own."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(rng.randrange(60, 120))) for _ in range(120)]
    bad = [" ".join(word() + "##" if k % 2 else word() for k in range(80)) for _ in range(6)] + [" ".join(word() * 5 for _ in range(80)) for _ in range(6)]
    texts = dict(enumerate([*good, *bad, "short", None]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < len(good)), 0) for k in range(len(good) + len(bad))], "doc_id long, quality int, toxic int")
    stats = quality.with_statistics(docs)
    model = quality.fit(stats, labels)
    found = {r["doc_id"]: r for r in quality.quality_report(stats, model).collect()}
    sample = np.array([quality.rule_statistics(texts[k]) for k in range(len(good))])
    low, high = np.quantile(quality.rates(sample), (quality.EDGE, 1 - quality.EDGE), axis=0)
    assert np.allclose(model.scale.low, low) and np.allclose(model.scale.width, np.maximum(high - low, 1e-3))
    forest = model.forest
    for k, text in texts.items():
        s = quality.rule_statistics(text)
        x = model.scale.features(np.array([s]))[0]
        total = 0.0
        for t in range(len(forest.feature)):
            at = 0
            while forest.feature[t][at] >= 0:
                at = forest.child[t][at] + int(x[forest.feature[t][at]] >= forest.split[t][at])
            total += forest.depth[t][at]
        score = 2 ** -(total / len(forest.feature) / float(quality.mean_depth(forest.rows)))
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert math.isclose(found[k]["score"], score, rel_tol=1e-9)
        assert (found[k]["base_failed"], found[k]["kept"]) == (failed, not failed and score <= model.threshold)
    assert all(found[k]["kept"] for k in range(len(good))) and not any(found[k]["kept"] for k in range(len(good), len(texts)))


def test_quality_forest_decides(spark):
    """The verdict is not that of ranges: documents inside every good row's range are rejected, by their path length."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    stats = quality.with_statistics(docs).cache()
    model = quality.fit(stats, labels)
    known = stats.join(labels.where("quality = 1"), "doc_id").select(*quality.STATS).toPandas().to_numpy()
    good = quality.rates(known[~quality.failed_base(known)])
    every = stats.select(*quality.STATS).toPandas().to_numpy()
    every = every[~quality.failed_base(every)]
    score, kept = model.keeps(every)
    x = quality.rates(every)
    inside = ((x >= np.quantile(good, 0.0002, axis=0)) & (x <= np.quantile(good, 0.9998, axis=0))).all(1)
    assert (inside & ~kept).any() and (kept == (score <= model.threshold)).all()
    assert len(np.unique(score[kept])) > 1000


def test_quality_odd(spark, odd, none, sf):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    stats = quality.with_statistics(odd)
    for known in (labels, labels.limit(0)):
        model = quality.fit(stats, known)
        assert model.threshold is None
        found = quality.quality_report(stats, model).collect()
        assert len(found) == odd.count() and {r["doc_id"] for r in found if r["kept"]} == {7, 8}
        assert quality.apply_quality(odd, model).columns == odd.columns
    assert quality.op7_quality(spark, sf(documents=none, labels=labels.limit(0))).count() == 0


# 8


def test_warc_round_trip(spark):
    big, other = "<p>é" * 400, "<p>x" * 400
    rows = [(5, "http://a/", big), (9, None, big), (2, "u\r\nx", big), (1, "u", other), (3, "u", "small"), (4, "u", "small"), (6, None, None), (7, "u", ""), (None, "u", big), (3, "u", "small"), (-8, "u", other)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    from vellum.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/warc-test"
    index = warc.write_warc(warc.with_revisits(pages), folder)
    found = warc.read_warc(index, folder, payloads=True).collect()
    top = {big: 9, other: 1}
    expected = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", top[h]) if h in top and i != top[h] else ("response", None))) for i, _, h in rows]
    assert sorted(map(repr, (tuple(r)[:5] for r in found))) == sorted(map(repr, expected))
    assert all(r["payload"] == (b"" if r["record_type"] == "revisit" else next(h or "" for i, _, h in rows if i == r["page_id"]).encode()) for r in found)
    some = warc.read_warc(index.where("page_id > 4"), folder)
    assert {r["page_id"] for r in some.collect()} == {5, 6, 7, 9}
    assert warc.read_warc(warc.write_warc(warc.with_revisits(pages.limit(0)), folder), folder).count() == 0


# 9


def test_raking_meets_its_targets(spark):
    rng = random.Random(9)
    cells = [(f"s{a}", f"l{b}", f"t{c}", rng.randrange(1, 1000), 3) for a in range(4) for b in range(3) for c in range(2)]
    df = spark.createDataFrame([*cells, ("s0", "l0", "empty", 0, 5)], "source string, lang string, topic string, tokens long, docs long")
    found = mixing.rake(df, shares={"source": {"s0": 0.5}}, fraction=0.5).toPandas()
    live = found[found["tokens"] > 0]
    total = live["tokens"].sum()
    for key in mixing.KEYS:
        by = live.groupby(key).agg({"weight": "sum", f"goal_{key}": "first"})
        assert np.allclose(by["weight"], by[f"goal_{key}"], rtol=1e-5)
    assert math.isclose(live[live["source"] == "s0"]["weight"].sum(), total / 2, rel_tol=1e-5)
    assert math.isclose((live["prob"] * live["tokens"]).sum(), total / 2, rel_tol=1e-3) and (found[found["tokens"] == 0]["prob"] == 1).all()
    # the same by a plain loop
    w = {tuple(c[:3]): float(c[3]) for c in cells}
    goal = {k: live.groupby(k)[f"goal_{k}"].first().to_dict() for k in mixing.KEYS}
    for _ in range(200):
        for at, key in enumerate(mixing.KEYS):
            sums = Counter()
            for c, x in w.items():
                sums[c[at]] += x
            w = {c: x * goal[key][c[at]] / sums[c[at]] for c, x in w.items()}
    assert np.allclose(live["weight"], [w[tuple(r)] for r in live[list(mixing.KEYS)].to_numpy()], rtol=1e-5)


def test_mixing_by_hand(spark):
    """Cells, raking, rate and draw by plain loops."""
    rng = random.Random(12)
    docs = [(k, " ".join(["w"] * rng.randrange(0, 30)) + rng.choice(["", " a@b", " | "]), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2"])) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = mixing.described(df)
    found = {r["doc_id"]: r for r in mixing.with_probability(rows, mixing.rake(mixing.cells_of(rows))).withColumn("u", mixing.unit_hash("doc_id")).collect()}
    tokens = Counter()
    cell = {}
    for k, text, lang, source in docs:
        topic = "contact" if "@b" in text else "table" if "|" in text else "prose"
        cell[k] = (source, lang or "", topic)
        tokens[cell[k]] += len(text.split())
    total = sum(tokens.values())
    goal = []
    for at in range(3):
        own = Counter()
        for c, n in tokens.items():
            own[c[at]] += n
        whole = sum(n**mixing.TEMPER for n in own.values())
        goal.append({v: n**mixing.TEMPER / whole * total for v, n in own.items()})
    w = {c: float(n) for c, n in tokens.items() if n}
    for _ in range(300):
        for at in range(3):
            sums = Counter()
            for c, x in w.items():
                sums[c[at]] += x
            w = {c: x * goal[at][c[at]] / sums[c[at]] for c, x in w.items()}
    lo, hi = 0.0, 1e6
    for _ in range(200):
        r = (lo + hi) / 2
        lo, hi = (r, hi) if sum(min(tokens[c], r * x) for c, x in w.items()) < mixing.FRACTION * total else (lo, r)
    for k, *_ in docs:
        prob = min(1.0, lo * w[cell[k]] / tokens[cell[k]]) if tokens[cell[k]] else 1.0
        assert math.isclose(found[k]["prob"], prob, rel_tol=1e-4)
    kept = {r["doc_id"] for r in mixing.mix(df).collect()}
    assert kept == {k for k, r in found.items() if r["u"] < r["prob"]}


def test_raking_tells_of_targets_that_cannot_be_met(spark):
    cells = [("a", "x", "t", 10, 1), ("b", "y", "t", 10, 1)]  # source and language always go together
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, docs long")
    with pytest.warns(UserWarning, match="marginal is off"):
        found = mixing.rake(df, shares={"source": {"a": 0.9}, "lang": {"x": 0.2}}).collect()
    assert max(r["off"] for r in found) > 0.1


def test_mixing_odd(spark, odd, none, sf):
    kept = mixing.mix(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert kept.where("text = ''").count() == 1  # no tokens in its cell, or drawn with it: never lost to a null
    found = mixing.op9_mixing(spark, sf(documents=odd)).collect()
    assert len(found) == odd.count() and all(0 <= r["prob"] <= 1 for r in found)
    assert mixing.mix(none).count() == 0


# 10


def test_lm_by_hand(odd):
    found = lm.lm_scores(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter()
    for i, t in texts:
        if fold(i) != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(found) == len(texts)
    expected = sorted((i or -1, fold(i) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in texts)
    assert sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)


def test_lm_scores_by_hand(spark):
    """Counts, held-out EM and scores from dictionaries."""
    rng = random.Random(3)
    texts = {k: " ".join(rng.choice("abcdefghij") + rng.choice(["", "x"]) for _ in range(rng.randrange(0, 40))) for k in range(120)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    tokens = {k: [*t.split(), "END"] for k, t in texts.items()}
    grams = lambda k: list(zip(["END", *tokens[k]], tokens[k]))  # noqa: B905, E731

    def counts(folds):
        one, two = Counter(), Counter()
        for k in texts:
            if fold(k) in folds:
                one.update(tokens[k])
                two.update(grams(k))
        return one, two

    every, known = {0, 1, 3, 4, 5, 6}, {0, 1, 4, 5, 6}
    one, two = counts(every)
    n, v = sum(one.values()), len(one)
    part1, part2 = counts(known)
    m = sum(part1.values())
    seen = defaultdict(list)
    for k in texts:
        if fold(k) == 3:
            for a, b in grams(k):
                seen[min(part1[a].bit_length(), lm.BUCKETS - 1)].append((part2[a, b] / max(part1[a], 1), part1[b] / m, 1 / (v + 1)))
    near = lambda p: 2.0 ** (-round(-lm.STEPS * math.log2(p)) / lm.STEPS) if p else 0.0
    weights = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b in range(lm.BUCKETS)}
    for b, rows in seen.items():
        rows = [(near(x), near(y), z) for x, y, z in rows]
        w = weights[b]
        for _ in range(lm.EM_ROUNDS):
            total = [0.0] * 3
            for p in rows:
                s = sum(x * y for x, y in zip(w, p, strict=True))
                total = [t + x * y / s for t, x, y in zip(total, w, p, strict=True)]
            w = [t / len(rows) for t in total]
        w = [max(x, 0 if k == 0 and not b else 1e-6) for k, x in enumerate(w)]
        weights[b] = [x / sum(w) for x in w]
    for r in lm.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        score = 0.0
        for a, b in grams(r["doc_id"]):
            w = weights[min(one[a].bit_length(), lm.BUCKETS - 1)]
            score += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (v + 1))
        assert math.isclose(r["score"], score, rel_tol=1e-6)


def test_lm_predicts_better_than_its_base(spark):
    p = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = p[p["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_of_nothing(none):
    assert lm.lm_scores(none).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 600, 1000)
    assert (lm.unpacked(lm.packed(counts)) == counts).all()
    for n in (1, 2, 500):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm.unpacked_keys(*lm.packed_keys(keys)) == keys).all()


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert sorted(after.columns) == sorted(docs.columns), name
        if name == "near_dedup":
            by_hand = components_by_hand({r["doc_id"]: r["text"] for r in before.collect()}, minhash.STAGE_SHINGLE)
            assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in by_hand.items() if i == c}
        if name == "line_dedup":
            known = {r["doc_id"]: r["text"] for r in before.collect()}
            gone = lines_by_hand(known)
            kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in known.items()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t for i, t in kept.items() if t.strip() or not gone[i]}
        assert 0 < after.count() <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() and last.where("n_tokens <> size(token_ids)").count() == 0


def test_pipeline_odd(spark, odd, none, sf):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names through every stage; and no rows at all."""
    import corpus_pipeline

    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    at = sf(labels=labels)
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, at)
            assert after.columns == docs.columns and after.count() <= docs.count(), name  # each on the odd rows themselves
        last = corpus_pipeline.STAGES[-1][1](spark, docs, at)
        assert last.count() == docs.count() and last.where("n_tokens <> size(token_ids)").count() == 0


def test_near_dedup_stage_takes_five_words(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = {0: " ".join(base), 1: " ".join(base), 2: " ".join(["z", *base]), 3: " ".join(w if k % 20 else f"y{k}" for k, w in enumerate(base))}
    texts |= {10 + k: " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for k in range(40)}
    runs = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in ((i, t.split()) for i, t in texts.items())}
    top = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and 100 * len(runs[i] & runs[j]) >= 80 * len(runs[i] | runs[j]):
                a, b = sorted((top[i], top[j]))
                top = {k: a if t == b else t for k, t in top.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert top[3] == 3 and components_by_hand(texts)[3][1] == 0  # a copy at two words only
    assert {r["doc_id"] for r in minhash.near_dedup_stage(spark, docs, "").collect()} == {i for i, t in top.items() if i == t}
