"""Literal cases, invariants, and operators that SQL cannot express, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as fn
from vellum.operators import audits as au
from vellum.operators import catalogs as ct
from vellum.operators import compare as cp
from vellum.operators import forms as fm
from vellum.operators import inventory as iv
from vellum.operators import layout as ly
from vellum.operators import navigation as nv
from vellum.operators import pages as pg
from vellum.operators import review as rv
from vellum.operators import search as sc
from vellum.operators import structure as sr
from vellum.operators import tables as tb
from vellum.operators import textflow as tf
from vellum.plans import actions as ac
from vellum.registry import QUERIES
from vellum.sources import derived as dv
from vellum.sources import files as fl
from vellum.sources import interchange as ix
from vellum.streaming import intake as st

DOCS = "doc_id long, text string"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "style", "expected"), [("$1,234.50", 0, 1234.5), ("1.234,5", 2, 1234.5), ("abc", 0, None), ("(5)", 0, -5.0), ("", 0, None), (None, 0, None)])
def test_make_number(spark, text, style, expected):
    assert value(spark, fn.make_number(F.lit(text).cast("string"), style)) == expected


@pytest.mark.parametrize(("number", "args", "expected"), [("1234.5", (2, 0, 0, "$", True), "$1,234.50"), ("-1234.5", (2, 2, 2, "€", False), "(1.234,50€)"), ("-5", (0, 0, 3), "(5)"), ("-0.001", (2,), "0.00"), (None, (2,), "")])
def test_format_number(spark, number, args, expected):
    assert value(spark, fn.format_number(F.lit(number).cast("decimal(18,4)"), *args)) == expected


@pytest.mark.parametrize(("text", "expected"), [("1/2/24", "2024-01-02"), ("13/45/2024", None), ("March 4, 2025", "2025-03-04"), ("1/2/75", "1975-01-02"), ("2024-02-30", None), (None, None)])
def test_parse_date(spark, text, expected):
    assert value(spark, fn.parse_date(F.lit(text).cast("string")).cast("string")) == expected


def test_masks(spark):
    assert value(spark, fn.format_special(F.lit("4065551234"), "phone")) == "(406) 555-1234"
    assert value(spark, fn.format_special(F.lit("123456789"), "ssn")) == "123-45-6789"
    assert value(spark, fn.format_special(F.lit("598121234"), "zip4")) == "59812-1234"
    assert value(spark, fn.range_error(F.lit("400"), 0, None)) is None
    assert "less than or equal to 120" in value(spark, fn.range_error(F.lit("400"), None, 120))


def test_labels(spark):
    assert value(spark, fn.page_label(F.lit("a"), F.lit(""), F.lit(27))) == "aa"
    assert value(spark, fn.page_label(F.lit("R"), F.lit("x-"), F.lit(1994))) == "x-MCMXCIV"


def test_markdown_line_starts(spark):
    for text, expected in [("# a", "\\# a"), ("1. a", "1\\. a"), ("- a", "\\- a"), ("a*b", "a\\*b"), ("plain", "plain")]:
        assert value(spark, fn.escape_markdown(F.lit(text))) == expected


RUNNER = "The runner was running fast in running shoes; runners run at the café."


@pytest.mark.parametrize(("term", "options", "hits"), [("running", {}, 2), ("RUNNING", {"case": True}, 0), ("run", {"whole": True}, 1), (r"run+ers?\b", {"regex": True}, 2), ("zzz", {}, 0)])
def test_search(spark, term, options, hits):
    units = spark.createDataFrame([(1, RUNNER), (2, None), (3, "")], DOCS)
    found = sc.search(units, term, **options).collect()
    assert len(found) == hits
    assert all(RUNNER[r["at"] : r["at"] + len(r["found"])] == r["found"] for r in found)


@pytest.mark.parametrize(("text", "term", "n"), [("café", "caf", 0), ("κόσμος κόσ", "κόσ", 1), ("field_name", "name", 0), ("don't don", "don", 1), ("Cat cat scatter cat_2 CAT", "cat", 3)])
def test_whole_words(spark, text, term, n):
    assert sc.search(spark.createDataFrame([(1, text)], DOCS), term, whole=True).count() == n


def test_pii_against_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {(r["doc_id"], r["kind"], r["found"]) for r in sc.find_pii(docs, ("phone", "email", "ssn")).collect()}
    expected = {(r["doc_id"], k, m[0]) for r in docs.collect() for k in ("phone", "email", "ssn") for m in re.finditer(sc.PII[k], r["text"] or "")}
    assert found == expected and found


def test_mask_then_find_is_empty(spark):
    docs = spark.createDataFrame([(1, "call 406-555-1234 or a@b.example, 4111 1111 1111 1111, 1/2/2024, 123-45-6789"), (2, None), (3, "4111 1111 1111 1112")], DOCS)
    masked = docs.withColumn("text", sc.mask_pii(F.col("text")))
    assert sc.find_pii(docs).where("kind = 'card'").count() == 1
    assert sc.find_pii(masked).count() == 0


def test_ranges(spark):
    for text, expected in [("1-3,7", [1, 2, 3, 7]), ("3-1", None), ("1,1", None), ("0", None), ("9", None), ("a", None), ("1,", None), ("2–4", [2, 3, 4])]:
        assert value(spark, pg.parse_range(F.lit(text), 8)) == expected


def test_split_and_combine_is_identity(spark):
    pages = spark.createDataFrame([(1, k, f"p{k}") for k in range(7)], "doc_id long, page int, text string")
    parts = pg.split_every(pages, 3)
    back = pg.combine(parts, F.col("doc_id"), F.lit(0))
    assert [r["source_page"] for r in back.orderBy("page").collect()] == list(range(7))


def test_global_numbers(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("page"))
    assert [r["number"] for r in pg.global_numbers(rows, ["doc_id", "page"], 5).orderBy("doc_id").collect()] == list(range(5, 105))


def test_import_twice_is_once(spark):
    c = dv.comments(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    once = rv.import_comments(c.where("idx < 2"), c, 100).drop("imported")
    assert rv.import_comments(once, c, 100).where("imported").count() == 0
    assert once.count() == c.count()


def test_bad_edit_fails_whole_batch(spark):
    c = dv.comments(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    edits = spark.createDataFrame([(0, "no-such", "update", "x")], "doc_id long, name string, action string, contents string")
    with pytest.raises(Exception, match="bad edit"):
        rv.apply_edits(c, edits).collect()


def test_word_diff_round_trip(spark):
    old = spark.createDataFrame([(1, "a b c d e".split()), (2, ["x"]), (3, [])], "doc_id long, words array<string>")
    new = spark.createDataFrame([(1, "a b z d".split()), (2, ["x"]), (3, ["n"])], "doc_id long, words array<string>")
    found = [(r["doc_id"], r["kind"], r["removed"], r["inserted"]) for r in cp.word_diff(old, new).orderBy("doc_id", "change_no").collect()]
    assert found == [(1, "replaced", "c", "z"), (1, "deleted", "e", ""), (3, "inserted", "", "n")]


def test_pair_pages(spark):
    votes = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 9), (1, 1, 2, 3), (1, 2, 2, 3)], "doc_id long, old_page int, new_page int, votes long")
    assert sorted(tuple(r) for r in cp.pair_pages(votes).collect()) == [(1, 0, 0), (1, 1, 2)]


def test_align_pages(spark):
    """Pages without text pair by position if both are free; all others that are left over are told."""
    pairs = spark.createDataFrame([(1, 0, 1), (1, 3, 3)], "doc_id long, old_page int, new_page int")
    old = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True), (1, 4, True), (2, 0, False)], "doc_id long, page int, has_text boolean")
    new = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True), (1, 4, False), (3, 0, False)], "doc_id long, page int, has_text boolean")
    found = set(map(tuple, cp.align_pages(pairs, old, new).collect()))
    assert found == {(1, 0, 1, "words"), (1, 3, 3, "words"), (1, 2, 2, "position"), (1, 1, None, "removed"), (1, 4, None, "removed"), (2, 0, None, "removed"), (1, None, 0, "added"), (1, None, 4, "added"), (3, None, 0, "added")}


def test_reading_order_two_columns(spark):
    boxes = [(1, 0, 0, 0.0, 0.0, 100.0, 10.0), (1, 0, 1, 200.0, 0.0, 300.0, 10.0), (1, 0, 2, 0.0, 12.0, 100.0, 22.0), (1, 0, 3, 200.0, 12.0, 300.0, 22.0)]
    found = ly.reading_order(spark.createDataFrame(boxes, "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double"))
    assert [r["box"] for r in found.orderBy("place").collect()] == [0, 2, 1, 3]


def test_notation_errors():
    with pytest.raises(ValueError, match="cannot read"):
        fm.notation("a + b", {})


def test_unknown_operation():
    with pytest.raises(ValueError, match="unknown operation"):
        ac.checked([("mask", {}), ("nonsense", {})])


def test_comment_xml_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("n1", "a & b"), ("n2", "<c>")], "name string, contents string")
    fl.write_comment_xml(rows, f"{tmp_path}/xml")
    assert sorted(map(tuple, fl.read_comment_xml(spark, f"{tmp_path}/xml", "name string, contents string").select("name", "contents").collect())) == [("n1", "a & b"), ("n2", "<c>")]


def test_contents_never_skip_a_level(spark):
    blocks = spark.createDataFrame([(d, 0, k, t, len(t.split()), s) for d in (1, 2, 3) for k, (t, s) in enumerate([("A head", 14.0 if d < 3 else 10.0), ("and its text of more words", 12.0)])] + [(1, 1, 2, "", 0, 14.0)], "doc_id long, page int, block_no int, text string, words int, size double")
    levels = [3, 9, 2, 5, 5, 9, None]
    marks = spark.createDataFrame([(1, k, v, f"m{k}", k % 2) for k, v in enumerate(levels)] + [(2, 0, 1, "elsewhere", 7)], "doc_id long, ord int, level int, title string, page int")
    found = sorted(map(tuple, fl.contents(blocks, marks).select("doc_id", "entry", "source", "title", "depth").collect()))
    depths, before = [], -1
    for v in levels:
        before = min(v or 0, before + 1)
        depths.append(before)
    assert found == [*((1, k + 1, "bookmarks", f"m{k}", d) for k, d in enumerate(depths)), (2, 1, "headings", "A head", 0), (3, 1, "pages", "Page 1", 0)]


def test_comments_through_files(spark, tmp_path):
    """Every column through XML files and back; names that are missing are made, subtypes without an element and odd values have their result."""
    schema = "doc_id long, page int, idx int, subtype string, rect array<double>, name string, parent string, reply string, flags int, color array<double>, fill array<double>, opacity double, width double, author string, contents string"
    rows = [
        (1, 0, 0, "Text", [10.0, 40.5, 30.0, 20.25], None, None, None, 0, [0.5], None, 1.5, None, "A & <B>", "  two\nlines  "),
        (1, 0, 1, "Text", [1.0, 2.0, 3.0, 4.0], "n2", "comment-0-0", "R", 4 + 128, [1.0, 0.0, 0.2], [0.0, 0.0, 0.0, 1.0], 0.25, 2.0, None, ""),
        (2, 3, 7, "Highlight", [1.0], "n3", "n2", "Group", 1, [0.1, 0.2], None, -1.0, 1.0 / 3, "x", None),
        (2, 0, 0, "Link", [1.0, 2.0, 3.0, 4.0], "n4", None, None, 4, None, None, None, None, None, "no element"),
    ]
    ix.write_comments(spark.createDataFrame(rows, schema), f"{tmp_path}/xml")
    found = {r["name"]: r.asDict() for r in ix.read_comments(spark, f"{tmp_path}/xml").collect()}
    assert sorted(found) == ["comment-0-0", "n2", "n3"]
    a, b, c = (found[n] for n in ("comment-0-0", "n2", "n3"))
    assert (a["doc_id"], a["page"], a["subtype"], a["rect"], a["flags"], a["opacity"], a["author"], a["contents"]) == (1, 0, "Text", [10.0, 20.25, 30.0, 40.5], 4, 1.0, "A & <B>", "  two\nlines  ")
    assert (a["parent"], a["reply"], a["color"], a["fill"], a["width"]) == (None, None, [128 / 255] * 3, None, None)
    assert (b["parent"], b["reply"], b["flags"], b["color"], b["fill"], b["opacity"], b["width"], b["contents"]) == ("comment-0-0", "R", 132, [1.0, 0.0, 0.2], [0.0] * 3, 0.25, 2.0, None)
    assert (c["page"], c["subtype"], c["rect"], c["parent"], c["reply"], c["flags"], c["color"], c["opacity"], c["width"]) == (3, "Highlight", [0.0] * 4, "n2", "Group", 1, None, 0.0, 0.333)


def test_comments_of_other_writers(spark, tmp_path):
    (tmp_path / "a.xfdf").write_text(
        """<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://example.org/x"><annots>
        <square page="2" rect="1;2 3,x" name="s" flags="Print, LOCKED,unknown" color="#zz0000" opacity="thin" replyType="group"/>
        <square page="2" rect="1,2,3" name="no box"/><other page="1" rect="1,2,3,4" name="no kind"/>
        <text rect="1,2,3,4" inreplyto="s" replyType="GROUP"><contents>Hello</contents></text></annots></xfdf>"""
    )
    found = {r["subtype"]: r.asDict() for r in ix.read_comments(spark, str(tmp_path)).collect()}
    assert sorted(found) == ["Square", "Text"]
    s, t = found["Square"], found["Text"]
    assert (s["doc_id"], s["page"], s["rect"], s["name"], s["flags"], s["color"], s["opacity"], s["reply"]) == (None, 2, [1.0, 2.0, 3.0, 0.0], "s", 132, None, 1.0, None)
    assert (t["page"], t["name"], t["parent"], t["reply"], t["flags"], t["opacity"], t["contents"]) == (0, None, "s", "Group", 4, None, "Hello")


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, made, mode, batch in (
        ("burst", st.stream_burst_limit(stream, "user_id", 2, 21600), "append", st.burst_limit(events, "user_id", "ts", 2, 21600)),
        ("recent", st.stream_recent(stream, "user_id"), "complete", st.stream_recent(events, "user_id")),
        ("progress", st.stream_progress(stream, "user_id"), "complete", st.stream_progress(events, "user_id")),
    ):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(name)
        assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_index(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")
    for _ in range(2):  # the second run finds nothing new
        st.stream_index(stream, f"{tmp_path}/index", f"{tmp_path}/state").start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/index").count() == dv.doc_lines(docs).count()


def test_route(spark):
    private, public = [], []
    rows = spark.createDataFrame([(1, "a@b.example", "t")], "event_id long, email string, title string")
    st.route(rows, ["email"], lambda d: private.append(d.columns), lambda d: public.append(d.columns))(rows, 0)
    assert (private, public) == ([["event_id", "email"]], [["event_id", "title"]])


def test_glyph_queries_take_whole_lines(spark, tmp_path):
    texts = {1: "ab cd" * 120 + "\n" + "x" * 450 + "\nshort", 2: "é 1 " * 90, 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(i, k, t) for i, text in texts.items() if text is not None for k, t in enumerate(text.split("\n")) if t]
    rows = lambda name, *columns: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    assert rows("layout_lines", "doc_id", "text") == sorted((i, t) for i, _, t in lines)
    assert rows("layout_words", "doc_id", "line_no", "words") == sorted((i, k, " ".join(t.split())) for i, k, t in lines)
    assert rows("layout_redact", "doc_id", "n_left") == sorted((i, sum(len(t) - (len(t[10:30]) if k in (2, 3, 4) else 0) for j, k, t in lines if j == i)) for i in (1, 2))
    assert sum(n for _, n in rows("layout_linked", "doc_id", "n")) == sum(len(t) for *_, t in lines)
    assert rows("inventory_outside", "doc_id", "n_outside") == sorted((i, n) for i in (1, 2) if (n := sum(g * 6 + 3 > 612.5 or k * 12 + 5 > 200.5 for j, k, t in lines if j == i for g in range(len(t)))))
    assert rows("layout_columns", "doc_id", "column", "n") == sorted((i, c, n) for i in (1, 2) for c in range(15) if (n := sum(len(t) > 40 * c for j, _, t in lines if j == i)))


def test_word_diff_of_long_pairs(spark):
    old = [f"w{k % 701}" for k in range(12_000)]
    new = ["first", *old[1:6000], "x", "y", *old[6000:9000], *old[9001:11_990], "z", *old[11_991:]]
    frame = lambda w: spark.createDataFrame([(1, w)], "doc_id long, words array<string>")
    found = [tuple(r) for r in cp.word_diff(frame(old), frame(new)).orderBy("change_no").collect()]
    assert found == [(1, 0, "replaced", old[0], "first"), (1, 1, "inserted", "", "x y"), (1, 2, "deleted", old[9000], ""), (1, 3, "replaced", old[11_990], "z")]


def shortest(a, b):
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
    return len(a) + len(b) - 2 * common[-1][-1]


def applied(a, b, runs):
    back, at = [], 0
    for i0, i1, j0, j1 in runs:
        back += [*a[at:i0], *b[j0:j1]]
        at = i1
    return back + list(a[at:])


@pytest.mark.parametrize("kept", [2048, 3, 1])
def test_edit_runs_are_shortest(monkeypatch, kept):
    """Kept step by step or halved: the fewest edits, in runs that do not touch."""
    monkeypatch.setattr(cp, "KEPT_EDITS", kept)
    rng = random.Random(2)
    for _ in range(300):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(14))], np.int64) for _ in range(2))
        runs = cp.edit_runs(a, b)
        assert applied(a, b, runs) == list(b)
        assert sum(i1 - i0 + j1 - j0 for i0, i1, j0, j1 in runs) == shortest(a, b)
        assert all(r[1] < s[0] and r[3] < s[2] for r, s in zip(runs, runs[1:], strict=False))


def test_gaps_between_anchors(monkeypatch):
    """Gaps lie apart, cover every difference and are aligned by shortest scripts; anchors are words found once in both."""
    monkeypatch.setattr(cp, "WHOLE_WORDS", 6)
    rng = random.Random(3)
    for _ in range(200):
        a = np.array([rng.randrange(30) for _ in range(40)], np.int64)
        b = np.array([w for w in a if rng.random() > 0.1] + [rng.randrange(30)], np.int64)
        found = sorted(cp.gaps(a, b))
        runs = [(i + i0, i + i1, j + j0, j + j1) for i, i_end, j, j_end in found for i0, i1, j0, j1 in cp.edit_runs(a[i:i_end], b[j:j_end])]
        assert applied(a, b, runs) == list(b)
        chain = cp.anchors(a, b)
        assert all(list(a).count(a[i]) == list(b).count(b[j]) == 1 and a[i] == b[j] for i, j in chain) and chain == sorted(chain, key=lambda x: x[1])


def test_word_diff_of_a_rewritten_book(spark):
    """200,000 words of a small vocabulary with 50,000 edits: no word is an anchor, and it ends."""
    rng = random.Random(5)
    old = [f"w{rng.randrange(400)}" for _ in range(200_000)]
    new = [w if rng.random() > 0.25 else f"n{rng.randrange(400)}" for w in old]
    frame = lambda w: spark.createDataFrame([(1, w)], "doc_id long, words array<string>")
    rows = cp.word_diff(frame(old), frame(new)).orderBy("change_no").collect()
    edits = sum(len(r["removed"].split()) + len(r["inserted"].split()) for r in rows)
    assert edits <= 2 * sum(x != y for x, y in zip(old, new, strict=True))
    assert [r["change_no"] for r in rows] == list(range(len(rows)))


def test_table_names_of_all_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a | b | c | d | e\na | f | c | g | h\nno bars")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["table_names"](spark, str(tmp_path)).select("table", "col", "name").orderBy("col").collect()
    assert [tuple(r) for r in found] == [(1, 0, "a"), (1, 1, "b / f"), (1, 2, "c"), (1, 3, "d / g"), (1, 4, "e / h")]


def test_blank_fields_of_long_documents(spark, tmp_path):
    texts = {1: "\n".join("a b c" for _ in range(300)), 2: "\n".join("a " * (50 - k // 20) for k in range(900)), 3: "a b\nx"}
    spark.createDataFrame(list(texts.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["box"]) for r in QUERIES["form_blank_fields"](spark, str(tmp_path)).collect()}
    expected = set()
    for i, text in texts.items():
        words = {k: len(t.split()) for k, t in enumerate(text.split("\n")) if k % 2 == 0}
        expected |= {(i, k) for k in sorted((k for k, n in words.items() if 1 <= n <= 51), key=lambda k: (words[k], k))[:200]}
    assert found == expected and sum(i == 1 for i, _ in found) == 150


def test_page_labels_of_all_documents(spark, tmp_path):
    spark.createDataFrame([(k, "x") for k in range(80)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["fn_page_labels"](spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(80))
    assert [found[k]["roman_label"] for k in (8, 38, 39, 79)] == ["ix", "xxxix", "xl", "xl"]
    assert (found[39]["n"], found[39]["decimal_label"], found[39]["letter_label"]) == (40, "A-40", "nn")


def test_order_list_in_many_tasks(spark):
    rows = spark.range(2000).select("id", (-F.col("id")).alias("o"))
    listed = spark.createDataFrame([(7, 1), (1500, 0)], "id long, pos int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = nv.order_list(rows, "id", listed, "o").withColumn("task", F.spark_partition_id()).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["id"] for r in found] == [1500, 7, *(k for k in range(1999, -1, -1) if k not in (7, 1500))]
    assert [r["place"] for r in found] == list(range(2000)) and len({r["task"] for r in found}) > 1


# depth and length without limits


def test_threads_of_any_depth_and_cycles(spark):
    chain = [(1, k, 0, f"c{k}", f"c{k - 1}" if k else None, "a", "x", k, False) for k in range(150)]
    ring = [(2, k, 0, f"r{k}", f"r{(k + 1) % 3}", "a", "x", k, False) for k in range(3)] + [(2, 9, 0, "below", "r0", "a", "x", 9, False)]
    df = spark.createDataFrame(chain + ring, "doc_id long, idx int, page int, name string, parent string, author string, contents string, minute int, is_status boolean")
    found = {(r["doc_id"], r["name"]): (r["root"], r["depth"]) for r in rv.threads(df).collect()}
    assert all(found[1, f"c{k}"] == ("c0", k) for k in range(150))
    assert all(found[2, n] == (n, 0) for n in ("r0", "r1", "r2", "below"))


def test_deleting_takes_replies_of_any_depth(spark):
    comments = spark.createDataFrame([(1, f"c{k}", f"c{k - 1}" if k else None, "x") for k in range(45)] + [(2, "a", "b", "x"), (2, "b", "a", "x"), (2, "z", None, "x")], "doc_id long, name string, parent string, contents string")
    edits = spark.createDataFrame([(1, "c2", "delete", None), (2, "a", "delete", None)], "doc_id long, name string, action string, contents string")
    assert {(r["doc_id"], r["name"]) for r in rv.apply_edits(comments, edits).collect()} == {(1, "c0"), (1, "c1"), (2, "z")}


def test_trees_of_any_depth(spark):
    nodes = spark.createDataFrame([(1, k, k - 1 if k else None, 0, f"t{k}", f"n{k}", "top" if k == 0 else None) for k in range(40)], "tree int, node int, parent int, ord int, title string, name string, own string")
    assert {r["node"]: r["depth"] for r in nv.flatten_outline(nodes).collect()} == {k: k for k in range(40)}
    found = {r["node"]: (r["full_name"], r["value"]) for r in iv.inherited(nodes, "own").collect()}
    assert found[39] == (".".join(f"n{k}" for k in range(40)), "top")
    objects = spark.createDataFrame([(1, k, 1) for k in range(40)], "doc_id int, obj int, bytes long")
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(39)], "doc_id int, src int, dst int")
    roots = spark.createDataFrame([(1, 0, "pages", 0)], "doc_id int, obj int, category string, priority int")
    assert [tuple(r) for r in nv.space_audit(objects, edges, roots).collect()] == [(1, "pages", 40)]


def test_a_long_thread_of_beads(spark):
    n = 20_000
    beads = spark.range(n).selectExpr("1 AS thread", "id AS bead", f"CASE WHEN id < {n - 1} THEN id + 1 END AS next", "id = 0 AS first")
    assert iv.beads(beads).where("bead = place").count() == n


def test_glyphs_of_a_long_line(spark):
    line = "".join(chr(97 + k % 26) for k in range(500))
    found = iv.build_lines(dv.glyphs(spark.createDataFrame([(1, line)], DOCS))).collect()
    assert [r["text"] for r in found] == [line]


# columns, paragraphs, continuations, tables without rules


def test_split_columns_needs_agreeing_neighbours(spark):
    row = lambda line, gap: [(1, 0, line, 0.0, 50.0, line * 12.0, 10.0), (1, 0, line, 50.0 + gap, 120.0, line * 12.0, 10.0)]
    soft = row(0, 14) + row(1, 14) + row(2, 14) + row(10, 14) + row(11, 4) + row(20, 30) + row(21, 3)
    found = tf.split_columns(spark.createDataFrame(soft, "doc_id int, page int, line_no int, x0 double, x1 double, cy double, size double"))
    assert {r["line_no"]: r["n"] for r in found.groupBy("line_no").agg(F.max("segment").alias("n")).collect()} == {0: 1, 1: 1, 2: 1, 10: 0, 11: 0, 20: 1, 21: 0}


def test_paragraphs(spark):
    said = [("The first line of a text", 300, 10), ("goes on here", 300, 10), ("and ends short.", 90, 10), ("A new one begins", 300, 10), ("1. an item", 200, 10), ("Large", 60, 16), ("after a gap", 300, 10)]
    y = [0, 12, 24, 36, 48, 62, 120]
    rows = [(1, 0, k, 0.0, float(y[k]), float(w), float(y[k] + 10), float(s), False, False, t) for k, (t, w, s) in enumerate(said)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, mixed boolean, text string")
    assert {r["line_no"]: r["block"] for r in tf.group_paragraphs(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4}


def test_continuations(spark):
    def block(k, text, x0, y0, x1, last, first=30.0):
        return (1, 0, k, "paragraph", "plain", 10.0, float(x0), float(y0), float(x1), float(y0 + 10), 1, float(x0), float(last), first, text)

    rows = [block(0, "a full line that runs on and", 0, 0, 300, 298), block(1, "goes on below with more of it", 0, 20, 300, 295), block(2, "then it ends here.", 0, 40, 300, 90), block(3, "Another paragraph of", 0, 60, 300, 290),
            block(4, "indented text begins", 20, 80, 300, 300), block(5, "and the column ends with", 0, 300, 300, 299), block(6, "the next column carrying on", 320, 0, 600, 600)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block int, kind string, style string, size double, x0 double, y0 double, x1 double, y1 double, lines int, last_x0 double, last_x1 double, first_width double, text string")
    found = {r["block"]: (r["continues"], r["next_column"]) for r in tf.join_continuations(df).collect()}
    assert found == {0: (None, False), 1: (0, False), 2: (1, False), 3: (None, False), 4: (None, False), 5: (None, False), 6: (5, True)}


def test_paragraphs_in_two_columns(spark):
    """Lines side by side: each column's lines chain among themselves, and no page runs through Python."""
    left = [(0.0, 140.0, "Left begins here"), (0.0, 140.0, "and goes on"), (0.0, 50.0, "and ends."), (0.0, 140.0, "Next of left")]
    right = [(160.0, 300.0, "Right begins here"), (160.0, 300.0, "and goes on"), (160.0, 300.0, "still"), (160.0, 300.0, "to its end")]
    rows = [(1, 0, 2 * k + c, x0, 12.0 * k, x1, 12.0 * k + 10, 10.0, False, False, t) for c, side in enumerate((left, right)) for k, (x0, x1, t) in enumerate(side)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, mixed boolean, text string")
    found = tf.group_paragraphs(df)
    assert {r["line_no"]: r["block"] for r in found.collect()} == {0: 0, 2: 0, 4: 0, 6: 2, 1: 1, 3: 1, 5: 1, 7: 1}
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()


def test_continuations_chain_on_their_own_spacing(spark):
    """A block joined once sets the spacing for the next: wide gaps end a chain of narrow ones and may start one of their own."""
    def block(k, y0):
        return (1, 0, k, "paragraph", "plain", 10.0, 0.0, float(y0), 300.0, float(y0 + 10), 1, 0.0, 298.0, 30.0, "words that fill their line and")

    rows = [block(0, 0), block(1, 12), block(2, 24), block(3, 48), block(4, 72), block(5, 76 + 10)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block int, kind string, style string, size double, x0 double, y0 double, x1 double, y1 double, lines int, last_x0 double, last_x1 double, first_width double, text string")
    found = {r["block"]: r["continues"] for r in tf.join_continuations(df).collect()}
    assert found == {0: None, 1: 0, 2: 1, 3: None, 4: 3, 5: 4}


def test_stream_table(spark):
    def seg(line, x0, text, width=40.0):
        return (1, 0, 0, 100.0, 400.0, line, float(x0), line * 12.0, float(x0 + width), text)

    rows = [seg(0, 0, "Row"), seg(0, 110, "1"), seg(0, 200, "2"), seg(1, 0, "Long"), seg(2, 0, "label"), seg(2, 110, "3"), seg(2, 200, "4"), seg(3, 150, "Part", 10.0), seg(4, 0, "End"), seg(4, 110, "5"), seg(4, 200, "6"), seg(5, 110, "note")]
    schema = "doc_id int, page int, table_no int, tx0 double, tx1 double, line int, x0 double, y0 double, x1 double, text string"
    found = [tuple(r)[3:] for r in tf.stream_table(spark.createDataFrame(rows, schema)).orderBy("row", "col").collect()]
    assert found == [(0, 0, 1, "Row"), (0, 1, 1, "1"), (0, 2, 1, "2"), (1, 0, 1, "Long label"), (1, 1, 1, "3"), (1, 2, 1, "4"), (2, 0, 3, "Part"), (3, 0, 1, "End"), (3, 1, 1, "5"), (3, 2, 1, "6")]
    sentence = [*rows[:6], seg(3, 0, "A sentence below the table", 300.0), *rows[8:11]]
    assert tf.stream_table(spark.createDataFrame(sentence, schema)).count() == 0  # fewer than three full lines before it


def test_moves_in_an_outline(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0), (1, 2, None, 1), (1, 3, None, 2), (1, 4, 2, 0), (1, 5, 4, 0)], "tree int, node int, parent int, ord int")
    move = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "tree int, node int, target int, at int")
    placed = lambda moves: {r["node"]: (r["parent"], r["ord"]) for r in ct.move_subtrees(nodes, moves).collect()}
    assert placed(move((1, None, 2))) == {2: (None, 0), 1: (None, 1), 3: (None, 2), 4: (2, 0), 5: (4, 0)}
    assert placed(move((4, None, None), (5, None, None))) == {1: (None, 0), 2: (None, 1), 3: (None, 2), 4: (None, 3), 5: (4, 0)}
    with pytest.raises(Exception, match="below itself"):
        placed(move((2, 5, None)))


def test_standards(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    facts = [(1, "print_intent", ""), (1, "print_version", "4"), (1, "trapped", "true"), (1, "version", "1.7"), (2, "xfa", ""), (2, "xfa", ""), (2, "print_version", "3"), (2, "print_intent", ""), (2, "trapped", "false")]
    found = {tuple(r) for r in au.validate_standard(docs, spark.createDataFrame(facts, "doc_id int, fact string, value string"), "print").collect()}
    assert found == {(1, "version", "warning", 1), (2, "forms", "error", 2), (2, "metadata", "error", 1)}


def test_render_xml_reads_back(spark):
    import xml.etree.ElementTree as ET

    text = "One two\x01 <&\n\nthree\n" + "\n" * 20 + "four"
    (found,) = fl.render_xml(dv.doc_lines(spark.createDataFrame([(1, text)], DOCS)).withColumn("page", F.floor(F.col("line_no") / 20).cast("int"))).collect()
    root = ET.fromstring(found["rendered"])
    words = [(int(w.get("order")), w.get("id"), w.text) for w in root.iter("word")]
    assert words == [(0, "w-0-0", "One"), (1, "w-0-1", "two�"), (2, "w-0-2", "<&"), (3, "w-2-0", "three"), (4, "w-23-0", "four")]
    assert [int(p.get("number")) for p in root.iter("page")] == [0, 1]


def test_fold(spark):
    assert value(spark, fn.fold(F.lit("ÀŽý Ά έ Йogh ñ"))) == "azy α ε иogh n"


def test_labels_of_fields(spark):
    b = [(1, 0, 0, 0, 0, 50, "Name:"), (1, 0, 1, 60, 40, 100, "City"), (1, 0, 2, 60, 62, 100, "(town)"), (1, 0, 3, 30, 100, 90, "Yes, I agree"), (1, 0, 4, 0, 140, 50, "Left"), (1, 0, 5, 60, 122, 100, "Right over"), (1, 0, 6, 300, 300, 340, "far")]
    f = [(1, 0, 0, "text", None, 60, 0, 160), (1, 0, 1, "text", None, 60, 52, 160), (1, 0, 2, "checkbox", None, 10, 100, 20), (1, 0, 3, "text", "the left one", 60, 140, 160), (1, 0, 4, "text", "tip", 400, 500, 450), (1, 0, 5, "text", None, 170, 0, 220), (1, 0, 6, "signature", None, 60, 300, 160)]
    blocks = spark.createDataFrame([(d, p, k, float(x0), float(y), float(x1), y + 10.0, 10.0, t) for d, p, k, x0, y, x1, t in b], "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    fields = spark.createDataFrame([(d, p, k, kind, tip, float(x0), float(y), float(x1), y + 10.0) for d, p, k, kind, tip, x0, y, x1 in f], "doc_id long, page int, field int, kind string, tooltip string, x0 double, y0 double, x1 double, y1 double")
    found = {r["field"]: (r["label"], r["source"], r["ambiguous"]) for r in fm.pair_labels(fields, blocks).collect()}
    assert found == {0: ("Name:", "left", False), 1: ("City (town)", "above", False), 2: ("Yes, I agree", "right", False), 3: ("Right over", "above", False), 4: ("tip", "tooltip", False), 5: ("Name:", "left_shared", False), 6: (None, "none", False)}


FIELDS = "doc_id long, page int, field int, kind string, name string, tooltip string, x0 double, y0 double, x1 double, y1 double"


def test_labels_use_up_tokens(spark):
    """One line of three words over three fields labels each with its word; what no field took stays."""
    token = lambda x, w: (float(x), 0.0, float(x + 30), 10.0, w)
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 330.0, 10.0, 10.0, "First Last Town Rest", [token(0, "First"), token(100, "Last"), token(200, "Town"), token(300, "Rest")])],
                                   "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string, tokens array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    fields = spark.createDataFrame([(1, 0, k, "text", f"f{k}", None, 100.0 * k, 14.0, 100.0 * k + 60, 26.0) for k in range(3)], FIELDS)
    found = fm.pair_labels(fields, blocks)
    assert {r["field"]: (r["label"], r["source"]) for r in found.collect()} == {0: ("First", "above"), 1: ("Last", "above"), 2: ("Town", "above")}
    (rest,) = fm.blocks_left(blocks, found).collect()
    assert (rest["text"], rest["x0"], rest["x1"]) == ("Rest", 300.0, 330.0)


def test_labels_in_cells_and_groups(spark):
    """The cell's own text, the cell at the right of a box, at the left of a text field, the one above; buttons take none."""
    texts = {(0, 0): "Name", (0, 1): "Value", (1, 0): "", (1, 1): "agree\n fully", (2, 0): "", (2, 1): "", (3, 0): "Total:", (3, 1): ""}
    cells = spark.createDataFrame([(1, 0, 0, r, c, 100.0 * c, 20.0 * r, 100.0 * c + 100, 20.0 * r + 20, t) for (r, c), t in texts.items()], "doc_id long, page int, table_no int, row int, col int, x0 double, y0 double, x1 double, y1 double, text string")
    at = lambda k, kind, r, c, name=None: (1, 0, k, kind, name or f"n{k}", None, 100.0 * c + 10, 20.0 * r + 5, 100.0 * c + 20, 20.0 * r + 15)
    fields = spark.createDataFrame([at(0, "checkbox", 1, 0), at(1, "text", 3, 1), at(2, "text", 2, 1), at(3, "text", 0, 0), at(4, "checkbox", 2, 1), at(5, "button", 0, 0), at(6, "text", 9, 0, "a"), at(7, "radio", 9, 1, "Pick One!"), at(8, "text", 9, 3, "a")], FIELDS)
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 400.0, 9.0, 410.0, 10.0, "far")], "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    found = {r["field"]: (r["label"], r["source"]) for r in fm.pair_labels(fields, blocks, cells).collect()}
    assert found == {0: ("agree fully", "cell_right"), 1: ("Total:", "cell_left"), 2: ("agree fully", "cell_above"), 3: ("Name", "cell"), 4: (None, "none"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none"), 8: (None, "none")}
    assert {r["field"]: r["group"] for r in fm.field_groups(fields).collect() if r["group"]} == {6: "a", 7: "pick-one", 8: "a"}


def test_merged_names_pass_taken_prefixes(spark):
    """A prefix that some field or the target has already is passed over."""
    fields = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (1, "p1_x"), (2, "y"), (4, "p2_x")], "doc_id long, name string")
    others = spark.createDataFrame([("y",), ("p1_y",)], "name string")
    found = {(r["doc_id"], r["name"]): r["merged_name"] for r in iv.namespaced(fields, others).collect()}
    assert found[1, "x"] == "x" and found[1, "p1_x"] == "p1_x" and found[4, "p2_x"] == "p2_x" and found[2, "y"] == "p2_y"
    assert len(set(found.values())) == 6 and {found[2, "x"], found[3, "x"]} == {"p3_x", "p4_x"}


def test_ruled_tables(spark):
    """Two tables on a page, rules drawn twice and in pieces, a cell over two rows and one over two columns, boxed text that is none."""
    def box(x, y, rows, cols, step=40, without=()):
        h = [("h", y + r * step, x + c * step, x + (c + 1) * step) for r in range(rows + 1) for c in range(cols) if ("h", r, c) not in without]
        return h + [("v", x + c * step, y + r * step, y + (r + 1) * step) for c in range(cols + 1) for r in range(rows) if ("v", r, c) not in without]

    drawn = box(0, 0, 3, 2, without={("h", 1, 0), ("v", 2, 1)}) + [("h", 121.5, 0, 80)] + box(300, 0, 2, 2) + box(0, 400, 1, 3)
    rules = spark.createDataFrame([(1, 0, k, a, float(at), float(lo), float(hi)) for k, (a, at, lo, hi) in enumerate(drawn)] + [(1, 0, 999, "h", None, 0.0, 1.0)], "doc_id long, page int, rule int, axis string, at double, lo double, hi double")
    word = lambda x, y, t: (1, 0, float(x), float(y), float(x + 10), float(y + 8), t)
    words = spark.createDataFrame([word(5, 45, "below"), word(5, 5, "tall"), word(50, 90, "wide"), word(5, 90, "is"), word(310, 50, "other"), word(5, 410, "box"), word(500, 500, "out")], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    found = {tuple(r[c] for c in ("table_no", "row", "col", "row_span", "col_span")): r["text"] for r in tb.ruled_cells(rules, words).collect()}
    assert found == {(0, 0, 0, 2, 1): "tall below", (0, 0, 1, 1, 1): "", (0, 1, 1, 1, 1): "", (0, 2, 0, 1, 2): "is wide", (1, 0, 0, 1, 1): "", (1, 0, 1, 1, 1): "", (1, 1, 0, 1, 1): "other", (1, 1, 1, 1, 1): ""}
    assert tb.ruled_cells(rules.limit(0), words).count() == 0


def structure_of(spark, rows):
    schema = "doc_id long, page int, seg int, l double, b double, r double, t double, size double, bold boolean, figure boolean, text string, width double"
    df = spark.createDataFrame([(1, 0, k, float(l), float(t - 10), float(r), float(t), float(size), bold, text is None, text or "", 600.0) for k, (l, r, t, size, bold, text) in enumerate(rows)], schema)
    return [(r["kind"], r["segs"], r["items"]) for r in sr.auto_structure(df).orderBy("no").collect()]


def test_structure_of_one_column(spark):
    rows = [(50, 300, 780, 16, False, "A heading"), (50, 400, 750, 10, False, "text that goes"), (50, 400, 738, 10, False, "on here"), (50, 200, 700, 10, False, "- one"), (50, 200, 686, 10, False, "- two"), (70, 200, 674, 10, False, "wrapped"),
            (50, 90, 600, 10, False, "a"), (150, 190, 600, 10, False, "b"), (250, 290, 600, 10, False, "c"), (50, 90, 580, 10, False, "d"), (150, 190, 580, 10, False, "e"), (250, 290, 580, 10, False, "f"),
            (50, 100, 500, 10, False, None), (50, 200, 400, 10, False, "1. only one"), (50, 200, 300, 11, True, "Bold")]
    assert structure_of(spark, rows) == [("Heading", [0], 0), ("Paragraph", [1, 2], 0), ("List", [3, 4, 5], 2), ("Table", [6, 7, 8, 9, 10, 11], 2), ("Figure", [12], 0), ("Paragraph", [13], 1), ("Heading", [14], 0)]


def test_structure_of_two_columns(spark):
    rows = [(50, 550, 780, 10, False, "a line across both columns that is wide")] + [(50, 280, 700 - 12 * k, 10, False, f"left {k}") for k in range(6)] + [(320, 550, 700 - 12 * k, 10, False, f"right {k}") for k in range(6)]
    assert structure_of(spark, rows) == [("Paragraph", [0], 0), ("Paragraph", [1, 2, 3, 4, 5, 6], 0), ("Paragraph", [7, 8, 9, 10, 11, 12], 0)]


def test_renaming_a_destination_to_a_taken_name_fails(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "ref int, dest string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    renames = lambda *rows: spark.createDataFrame(list(rows), "old string, new string")
    swapped = nv.rename_destinations(refs, renames(("a", "b"), ("b", "a")), names)
    assert {r["ref"]: r["dest"] for r in swapped.collect()} == {1: "b", 2: "a", 3: "b"} and nv.rename_count(swapped).first()["n"] == 3
    for bad in ([("a", "c")], [("a", "x"), ("b", "x")]):
        with pytest.raises(Exception, match="has this name"):
            nv.rename_destinations(refs, renames(*bad), names).collect()


def test_burst_limit_of_bouts(spark):
    times = [0, 1, 2, 3, 59, 60, 61, 125, 126, 300]
    df = spark.createDataFrame([("u", t, k) for k, t in enumerate(times)], "user string, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    log, expected = [], {}
    for k, t in enumerate(times):
        log = [x for x in log if x > t - 60]
        expected[k] = len(log) < 3
        log += [t] if expected[k] else []
    assert {r["event_id"]: r["accepted"] for r in st.burst_limit(df, "user", "ts", 3, 60).collect()} == expected


def test_renderings_of_lists_and_tables(spark):
    lines = ["Title", "", "a plain line of text <b>", "- one *", "- two", "1. first", "Name | Age", "Ann | 7", "end of the whole text"]
    blocks = dv.blocks(spark.createDataFrame([(1, "\n".join(lines))], DOCS))
    markdown = "## Title\n\na plain line of text \\<b\\>\n\n- one \\*\n- two\n1. first\n\n| Name | Age |\n| --- | --- |\n| Ann | 7 |\n\nend of the whole text"
    assert fl.render_markdown(blocks).first()["rendered"] == markdown
    html = "<h2>Title</h2>\n<p>a plain line of text &lt;b&gt;</p>\n<ul>\n<li>one *</li>\n<li>two</li>\n<li>1. first</li>\n</ul>\n<table>\n<tr><th>Name</th><th>Age</th></tr>\n<tr><td>Ann</td><td>7</td></tr>\n</table>\n<p>end of the whole text</p>"
    assert fl.render_html(blocks).first()["rendered"] == html


def test_comparing_comments_by_more_fields(spark):
    schema = "doc_id long, name string, page int, author string, contents string, color string, x double"
    ours = spark.createDataFrame([(1, "a", 0, "u", "t", "red", 5.0), (1, "b", 0, "u", "s", None, 5.0), (1, "c", 1, "u", "r", "red", None)], schema)
    theirs = spark.createDataFrame([(1, "a", 0, "u", "t", "blue", 5.5), (1, "b", 0, "u", "s", "", 7.0), (1, "c", 1, "u", "r", "red", 1.0)], schema)
    found = {r["name"]: (r["change"], r["fields"]) for r in rv.compare_comments(ours, theirs, ("color", "x"), {"x": 1.0}).collect()}
    assert found == {"a": ("changed", "color"), "b": ("changed", "x"), "c": ("changed", "x")}


def test_words_of_glyphs(spark):
    row = lambda line, k, ch, x0, x1, size=10.0: (1, line, k, ch, x0, x1, size)
    rows = [row(0, 0, "a", 0.0, 5.0), row(0, 1, "b", 5.0, 10.0), row(0, 2, "c", 13.0, 18.0), row(0, 3, " ", 18.0, 20.0), row(0, 4, "d", 20.0, 25.0, 20.0), row(1, 0, "x", 9.0, 12.0), row(1, 1, "y", 0.0, 3.0), row(2, 0, " ", 0.0, 2.0)]
    g = spark.createDataFrame(rows, "doc_id long, line_no int, glyph_no int, ch string, x0 double, x1 double, size double")
    assert {(r["line_no"], r["words"]) for r in ly.word_breaks(g).collect()} == {(0, "ab cd"), (1, "y x")}
    assert {(r["line_no"], r["words"]) for r in ly.word_breaks(g, 0.05).collect()} == {(0, "ab c d"), (1, "y x")}


def test_redact_adds_areas(spark):
    """Two areas that cover a fifth of the points each take a glyph away; one alone does not."""
    g = spark.createDataFrame([(1, 0, 0, k, 10.0 * k, 0.0, 10.0 * k + 10, 10.0) for k in range(3)], "doc_id long, page int, line_no int, glyph_no int, x0 double, y0 double, x1 double, y1 double")
    area = lambda *rows: spark.createDataFrame([(1, 0, *map(float, r)) for r in rows], "doc_id long, page int, ax0 double, ay0 double, ax1 double, ay1 double")
    left = lambda a: [r["glyph_no"] for r in ly.redact(g, a).orderBy("glyph_no").collect()]
    assert left(area((0, 0, 2, 10))) == [0, 1, 2]
    assert left(area((0, 0, 2, 10), (8, 0, 10, 10))) == [1, 2]
    assert left(area((0, 0, 2, 10), (0, 0, 2, 10))) == [0, 1, 2]
    assert left(area((14, 4, 16, 6))) == [0, 2]


def crossings_by_hand(segments):
    found = set()
    for a, (_, sa, *p) in enumerate(segments):
        for _, sb, *q in segments[a + 1 :]:
            ax, ay, bx, by = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
            turn = ax * by - ay * bx
            if abs(turn) < 1e-9:
                continue
            t, u = ((q[0] - p[0]) * by - (q[1] - p[1]) * bx) / turn, ((q[0] - p[0]) * ay - (q[1] - p[1]) * ax) / turn
            end = [min(abs(v), abs(v - 1)) <= 1e-6 for v in (t, u)]
            if -1e-6 <= t <= 1 + 1e-6 and -1e-6 <= u <= 1 + 1e-6 and not all(end):
                found.add((sa, sb, round(p[0] + t * ax, 6), round(p[1] + t * ay, 6)))
    return found


def test_crossing_points(spark):
    schema = "tree long, seg int, x0 double, y0 double, x1 double, y1 double"
    cross, end_on, joint, parallel = (0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.0, 10.0, 10.0, 0.0), (0, 2, 10.0, 10.0, 20.0, 10.0), (0, 3, 0.0, 1.0, 10.0, 11.0)
    tee, odd = (0, 4, 5.0, 5.0, 5.0, -7.0), (0, 5, float("nan"), 0.0, 1.0, 1.0)
    rows = [cross, end_on, joint, parallel, tee, odd]
    found = nv.segment_crossings(spark.createDataFrame(rows, schema))
    assert {(r["a"], r["b"], r["x"], r["y"]) for r in found.collect()} == {(0, 1, 5.0, 5.0), (1, 3, 4.5, 5.5), (0, 4, 5.0, 5.0), (1, 4, 5.0, 5.0)}
    assert {(r["x"], r["y"]) for r in nv.crossing_points(found).collect()} == {(5.0, 5.0), (4.5, 5.5)}
    rng = random.Random(4)
    many = [(7, k, *(float(rng.randint(0, 12)) for _ in range(4))) for k in range(60)]
    for cell in (None, 2.5, 1000.0):
        got = nv.segment_crossings(spark.createDataFrame(many, schema), cell).collect()
        assert {(r["a"], r["b"], round(r["x"], 6), round(r["y"], 6)) for r in got} == crossings_by_hand(many)
        assert len(got) == len(crossings_by_hand(many))
    assert nv.segment_crossings(spark.createDataFrame([], schema)).count() == 0


def test_tables_in_one_relation(spark, tmp_path):
    cells = spark.createDataFrame([(d, t, r, c, f"{d}{t}{r}{c}") for d in range(3) for t in range(2) for r in range(4) for c in range(t + 1)], "doc_id long, table_no int, row int, col int, text string")
    texts = spark.createDataFrame([(0, 0, 0, "paragraph", "x")], "doc_id long, flow_no int, page int, kind string, text string")
    fl.write_tables(cells, texts, str(tmp_path / "t"))
    assert not list((tmp_path / "t").glob("tables/*="))
    back = spark.read.parquet(str(tmp_path / "t/tables"))
    assert back.schema == cells.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t/manifest")).collect()} == {(d, t, 4, t + 1) for d in range(3) for t in range(2)}


def test_batch_run(spark, tmp_path):
    rows = [(1, "nation MAIL a@b.example"), (2, "none"), (3, None), (4, "12.50"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    steps = [("replace", {"find": "tion", "put": "SION"}), ("mask", {}), ("at_least", {"n": 4})]
    found = {r["doc_id"]: tuple(r)[1:] for r in ac.batch_run(docs, steps, ("replace", "mask")).collect()}
    assert found[1][0].startswith("naSION MAIL ") and "a@b.example" not in found[1][0] and found[1][1:] == ("ok", "", None)
    assert found[2] == ("none", "skipped", "replace,mask", None) and found[3] == (None, "error", "", "no text")
    assert found[5] == ("", "error", "replace,mask", "at_least: too short")
    strict = {r["doc_id"]: (r["status"], r["error"]) for r in ac.batch_run(docs, steps, ("mask",)).collect()}
    assert strict[2] == ("error", "replace: not applicable") and strict[1] == ("ok", None)
    numbers = {r["doc_id"]: (r["text"], r["error"]) for r in ac.batch_run(docs, [("number", {})]).collect()}
    assert numbers[4] == ("12.500000", None) and numbers[2] == ("none", "number: not a number")
    coded = {r["doc_id"]: r["error"] for r in ac.batch_run(docs, [("base64", {})]).collect()}
    assert coded[2] is None and coded[4] == "base64: not base64"
    for bad in ([("nothing", {})], [("number", {"n": 1})]):
        with pytest.raises(ValueError):
            ac.batch_run(docs, bad)
    run = ac.batch_run(docs.withColumn("status", F.lit("clash")), steps, ("replace", "mask"))
    version = ac.publish_batch(run, str(tmp_path / "out"))
    (tmp_path / "out/version-broken/outputs").mkdir(parents=True)
    assert [v.split("/")[-1] for v in ac.published(spark, str(tmp_path / "out"))] == [version.split("/")[-1]]
    assert {r["doc_id"] for r in spark.read.parquet(f"{version}/outputs").collect()} == {1, 2, 4}
    assert spark.read.parquet(f"{version}/manifest").where("error is not null").count() == 2
    assert {tuple(r) for r in ac.batch_report(run).collect()} >= {("ok", None, "", 1), ("error", "no text", "", 1)}


def test_sweep_resumes(spark, tmp_path):
    seen = []

    def run(new):
        seen.append({(r["file"], r["op"]) for r in new.collect()})
        return new.select("file", "op", F.when(F.col("file") == "b", "crash").otherwise("ok").alias("status"), F.when(F.col("file") == "b", "E: x").alias("error"), F.lit(None).cast("string").alias("at"))

    todo = lambda *files: spark.createDataFrame([(f, op) for f in files for op in ("open", "save")], "file string, op string")
    folder = str(tmp_path / "ledger")
    assert ac.sweep(todo("a", "b"), run, folder).count() == 4
    (tmp_path / "ledger/run-broken").mkdir()
    spark.createDataFrame([("c", "open", "ok", None, None)], ac.SWEEP).write.parquet(str(tmp_path / "ledger/run-half"))
    (tmp_path / "ledger/run-half/_SUCCESS").unlink()
    every = ac.sweep(todo("a", "b", "c"), run, folder)
    assert seen == [{("a", "open"), ("a", "save"), ("b", "open"), ("b", "save")}, {("c", "open"), ("c", "save")}]
    assert every.count() == 6 and ac.sweep(todo("a"), run, folder).count() == 6 and len(seen) == 2
    assert {tuple(r) for r in nv.sweep_outcomes(every).collect()} == {("open", 2, 0, 1), ("save", 2, 0, 1)}
    assert {tuple(r) for r in nv.sweep_summary(every).collect()} == {("open", "E", None, 1, "b"), ("save", "E", None, 1, "b")}
    assert {r["operation"] for r in ac.list_operations(spark).collect()} == set(k for k, s in ac.CATALOGUE.items() if s.params)
