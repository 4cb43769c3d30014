"""Vector codes, source divergence and document fingerprints against brute force, on small and odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from vellum.llm import compression, divergence, fingerprints

# vector codes


def lloyd(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector), all kept: codes, errors and codebooks by plain loops over Python integers."""
    cut = compression.cuts_of(len(rows[0][1]), parts)
    whole = [[math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    books = [[whole[k][a:b] for k in order[:entries]] for a, b in cut]
    far = lambda u, v: sum((x - y) ** 2 for x, y in zip(u, v, strict=True))
    best = lambda p, k: min(range(len(books[p])), key=lambda e: (far(whole[k][cut[p][0] : cut[p][1]], books[p][e]), e))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            at = [best(p, k) for k in range(len(rows))]
            for e in range(len(books[p])):
                mine = [whole[k][a:b] for k in range(len(rows)) if at[k] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = ["".join(f"{best(p, k):02x}" for p in range(parts)) for k in range(len(rows))]
    errors = [sum(far(whole[k][a:b], books[p][best(p, k)]) for p, (a, b) in enumerate(cut)) for k in range(len(rows))]
    return codes, errors, hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def test_tree_agrees_with_all_distances():
    rng = np.random.default_rng(3)
    for n, d, spread in ((1, 4, 9), (30, 2, 3), (2000, 8, 4000), (3000, 3, 50), (500, 1, 10)):
        x = (rng.normal(size=(n, d)) * spread + rng.integers(0, 4, (n, 1)) * spread * 9).astype(np.int64)
        tree = compression.Tree(x)
        book = x[rng.integers(0, n, 16)] + rng.integers(-2, 3, (16, d))
        code, sums, sizes = tree.nearest(book)
        want = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code[tree.inverse] == want.argmin(1)).all() and (tree.rows[tree.inverse] == x).all()
        assert (sizes == np.bincount(want.argmin(1), minlength=16)).all()
        assert all((sums[e] == x[want.argmin(1) == e].sum(0)).all() for e in range(16))
        assert (tree.errors(book, code)[tree.inverse] == want.min(1)).all()


def test_balls_are_owned_whole(monkeypatch):
    """On clusters most rows are never compared one by one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 40_000
    x = (np.repeat(centres, 250, 0) + rng.normal(size=(4000, 8)) * 300).astype(np.int64)
    tree = compression.Tree(x)
    seen = []
    plain = np.add.at
    monkeypatch.setattr(compression.np, "add", type("Add", (), {"at": staticmethod(lambda a, i, b: (seen.append(len(i)) if np.ndim(b) == 1 else None, plain(a, i, b)))}))
    _, _, sizes = tree.nearest(centres.astype(np.int64))
    assert sizes.sum() == 4000 and sum(seen) < 1500


def odd_vectors():
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) + (k % 5) for _ in range(16)], k % 3 if k % 7 else None) for k in range(60)]
    rows += [rows[3], rows[3], (3, rows[9][1], 1), (None, rows[5][1], None), (None, [0.0] * 16, 2), (90, [-1e-9] * 16, 2)]
    bad = [(100, None, 1), (101, [1.0] * 15 + [None], 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, 1), (104, [1.0] * 8, 1), (105, [], 1), (None, None, None)]
    return rows, bad


def test_compression_odd(spark):
    for huge in (False, True):
        rows, bad = odd_vectors()
        rows += [(200, [1e305, -1e305] + [2.0**70] * 14, 5), (201, [4e18] * 16, 5)] if huge else []
        df = spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in [*bad, *rows]], "vec_id long, embedding array<double>, label int, code string, part int").repartition(3)
        codes, books = compression.compress_vectors(df)
        found = compression.with_label_error(codes).collect()
        want, errors, digest = lloyd([(i, v) for i, v, _ in rows])
        errors = [e if e < 1 << 63 else None for e in errors]
        by_label = defaultdict(int)
        for (_, _, label), e in zip(rows, errors, strict=True):
            by_label[label] += e or 0
        labels = {k: v for k, v in by_label.items() if any(e is not None and r[2] == k for r, e in zip(rows, errors, strict=True))}
        assert compression.book_digest(books) == digest
        key = lambda r: repr(r)
        assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=key) == sorted(((i, c, e, labels.get(label)) for (i, _, label), c, e in zip(rows, want, errors, strict=True)), key=key)


def test_compression_of_nothing_and_few(spark):
    schema = "vec_id long, embedding array<float>, label string"
    codes, books = compression.compress_vectors(spark.createDataFrame([(1, None, "a")], schema))
    assert codes.count() == 0 and all(b.size == 0 for b in books)
    codes, books = compression.compress_vectors(spark.createDataFrame([(2, [1.0] * 5, None), (1, [0.5] * 5, "a")], schema))
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in codes.collect()) == [(1, "00" * 8, 0), (2, "".join("00" if a == b else "01" for a, b in compression.cuts_of(5, 8)), 0)]


# source divergence


def audited(docs, least, top):
    """The contract by dense vectors of Python integers."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))) for lang, source, text in docs]
    out = []
    for lang in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == lang]
        in_docs = Counter(t for r in here for t in set(r[2]))
        terms = sorted(t for t, n in in_docs.items() if n >= least)
        counts = {s: Counter(t for r in here if r[1] == s for t in r[2] if in_docs[t] >= least) for s in {r[1] for r in here}}
        every = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}  # noqa: E731, B023
        shares, q = {s: p(c) for s, c in counts.items()}, p(every)
        for s in counts:
            found = {"pair": {u: sum(abs(shares[s][t] - shares[u][t]) for t in terms) for u in counts if u != s}, "term": {t: shares[s][t] - q[t] for t in terms if counts[s][t] and shares[s][t] > q[t]}}
            for part, items in found.items():
                for rank, (item, value) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergence_odd(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = random.Random(4)
    words = ["Alpha", "alpha", "née", "NÉE", "ÉTÉ", "x1y", "\U0001f600", "b_c", "ΑΣ", *(f"w{chr(97 + k)}" for k in range(20))]
    docs = [(f"l{k % 2}" if k % 11 else None, f"s{k % 5 if k % 3 else 0}" if k % 13 else None, " ".join(rng.choices(words, k=rng.randrange(30)))) for k in range(300)]
    docs += [("l0", "s1", "one and the same Text")] * 40 + [("l0", "s2", "one and the same Text")] * 3 + [("l0", "empty", None), ("l0", "blank", " \t\n"), ("only", "one", "a"), ("none", "a", "b"), ("none", "c", "d"), (None, None, None), ("l1", "long", "tail " * 50_000)]
    df = spark.createDataFrame([(k, *r, "clash", 7) for k, r in enumerate(docs)], "doc_id long, lang string, source string, text string, term string, n int").repartition(4)
    for least, top in ((5, 4), (30, 50), (10_000, 50)):
        assert sorted(tuple(r) for r in divergence.source_divergence(df, least, top).collect()) == audited(docs, least, top)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_identical_texts_are_tokenized_once(spark):
    df = spark.createDataFrame([("en", f"s{k % 3}", "same") for k in range(90)] + [("fr", "s0", "same"), ("en", "s0", "other")], "lang string, source string, text string")
    rows = divergence.collapsed(df).collect()
    assert len(rows) == 3 and sorted(s["n"] for r in rows if r["lang"] == "en" and r["text"] == "same" for s in r["sources"]) == [30, 30, 30]


# document fingerprints


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_anchors(text):
    """{hash: first place} of the whole text's anchors, by looking at every inner s-mer of every k-mer."""
    b = text.encode()
    h = lambda x: signed(xxhash.xxh64_intdigest(x, 42))
    found = {}
    s = [h(b[i : i + fingerprints.S]) for i in range(len(b) - fingerprints.S + 1)]
    for i in range(len(b) - fingerprints.K + 1):
        inner = s[i : i + fingerprints.K - fingerprints.S + 1]
        if min(inner) in (inner[0], inner[-1]) and min(inner) < fingerprints.LEAST:
            found.setdefault(h(b[i : i + fingerprints.K]) >> 32, i)
    if b and not found:
        found[h(b) >> 32] = 0
    return dict(sorted(found.items())[: fingerprints.KEPT])


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    both = sorted({*a, *b})[: fingerprints.KEPT]
    moved = [a[h] - b[h] for h in both if h in a and h in b]
    j = sum(d == 0 or moved.count(d) > 1 for d in moved) / len(both)
    return 2 * j / (1 + j)


def test_fingerprints_odd(spark, tmp_path):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(["née", "house", "tree", "Ω", "of", "\U0001f600"]) + str(rng.randrange(500)) for _ in range(n))
    texts = [prose(200), prose(40), prose(3000), "", None, "x", "x" * 5000, " " * 40, prose(5), "ab" * 16, "line of a list\n" * 400]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "other"), (2, texts[2]), (2, texts[2]), (None, prose(60)), (None, None), (-3, texts[0])]
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, k1 string, nth int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op13_fingerprints(spark, str(tmp_path)).collect()
    with_hash = lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    order = sorted(((i, t or "") for i, t in rows), key=with_hash)
    text_of = lambda a: "".join(f"{(h & 0xFFFFFFFF) << 32 | at:016x}" for h, at in a.items())
    want = []
    for (i, t), (_, after) in pairwise([*order, order[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = brute_anchors(t), brute_anchors(edited), brute_anchors(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), brute_likeness(a, b), brute_likeness(a, c)))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_fingerprints_of_one_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "a text that follows itself and has more than a few bytes in it")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/one/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    (row,) = fingerprints.op13_fingerprints(spark, f"{tmp_path}/one").collect()
    assert row["near_next"] == 1.0 and fingerprints.op13_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_moved_passages_keep_their_anchors(spark):
    passage = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 3000").select("text").first()[0][:3000]
    whole = spark.createDataFrame([(passage, "Something else stands in front of it. " * 3 + passage)], "a string, b string")
    assert whole.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))).first()[0] > 0.9


def test_all_closed_syncmers_are_anchors(spark):
    """Any K - S + 1 k-mers in a row hold an anchor; a sketch of all of them compares all."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (8, 9, 10, 11, 12, 300, 1500)]
    pairs = [(t, "A few words before " + t + " and behind") for t in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = (fingerprints.fingerprint(F.col(c), None) for c in "ab")
    reach = fingerprints.K - fingerprints.S + 1
    for row in df.select("a", "b", a.alias("x"), b.alias("y"), fingerprints.likeness(a, b, None).alias("near"), fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("sketched")).collect():
        places = sorted(v & 0xFFFFFFFF for v in row["x"])
        assert all(y - x <= reach for x, y in pairwise([-1, *places, len(row["a"]) - fingerprints.K + 1]))
        sides = [{v >> 32: v & 0xFFFFFFFF for v in row[c]} for c in "xy"]
        assert set(sides[0]) <= set(sides[1])
        share = len(sides[0]) / len(sides[1])
        assert row["near"] == pytest.approx(2 * share / (1 + share)) and abs(row["sketched"] - row["near"]) < 0.1


def test_fingerprints_run_no_python(spark):
    plan = fingerprints.op13_fingerprints(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


if __name__ == "__main__":
    pytest.main([__file__])
