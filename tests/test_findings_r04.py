"""One small case for each finding of round 4, against the query's SQL where it has one."""

import random

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import GroupedData

from vellum.operators import compare as cp
from vellum.operators import forms as fm
from vellum.operators import inventory as iv
from vellum.operators import layout as ly
from vellum.registry import ORACLES, QUERIES

DOCS = "doc_id long, text string"


def holds(spark, tmp_path, name, texts):
    """The query over these documents equals its SQL."""
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name]))


def test_f5_drop_caps_of_all_letters(spark, tmp_path):
    """The capital of ß is one letter; letters of Unicode 14 count. Every place outside the ideographs begins a page."""
    places = [c for c in [*range(1, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1F000)] if not 0xD800 <= c <= 0xDFFF]
    holds(spark, tmp_path, "layout_drop_caps", [f"{chr(c)}x" for c in places])


GLYPH = "doc_id long, page int, line_no int, glyph_no int, ch string, x0 double, y0 double, x1 double, y1 double, size double"
ODD = ["ab cd\n\n x  y \n" * 15 + "é ß 漢字 😀 end", "", "\n\n", "one", "x" * 700 + "\n" + "y " * 300, "\n".join(f"line {k} of many" for k in range(65))]


def lines_by_loop(rows):
    """Lines of a page as they are defined: glyph by glyph from the top."""
    lines = []
    for ch, x0, y0, y1 in sorted(rows, key=lambda r: (r[2], r[1])):
        centre = (y0 + y1) / 2
        home = next((line for line in reversed(lines[-5:]) if abs(line[0] - centre) <= 0.4 * (y1 - y0)), None)
        if home is None:
            lines.append(home := [centre, []])
        home[1].append((x0, ch))
    return ["".join(c for _, c in sorted(x)) for _, x in lines]


def test_f1_lines_of_glyphs(spark, tmp_path):
    holds(spark, tmp_path, "layout_lines", ODD)
    plan = QUERIES["layout_lines"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rng = random.Random(1)
    pages = {(d, p): [(rng.choice("abcdé"), float(rng.randrange(12)) + k / 1000, float(rng.randrange(30)), rng.choice([4.0, 8.0, 12.0, -1.0])) for k in range(rng.randrange(1, 90))] for d in range(20) for p in range(3)}
    rows = [(d, p, 0, 0, ch, x, y, x + 1, y + h, 10.0) for (d, p), found in pages.items() for ch, x, y, h in found]
    got = {}
    for r in iv.build_lines(spark.createDataFrame(rows, GLYPH)).orderBy("doc_id", "page", "line").collect():
        got.setdefault((r["doc_id"], r["page"]), []).append((r["line"], r["text"]))
    assert got == {at: list(enumerate(lines_by_loop([(ch, x, y, y + h) for ch, x, y, h in found]))) for at, found in pages.items()}


def test_f3_links_meet_texts(spark, tmp_path):
    holds(spark, tmp_path, "layout_linked", ODD)
    g = spark.createDataFrame([(1, 0, 0, k, "a", 10.0 * k, 0.0, 10.0 * k + 10, 10.0, 10.0) for k in range(4)], GLYPH)
    boxes = spark.createDataFrame([(1, 0, 2, 0.0, 0.0, 30.0, 10.0, "second"), (1, 0, 1, 10.0, 0.0, 20.0, 10.0, "first"), (1, 1, 0, 0.0, 0.0, 99.0, 99.0, "other page"), (1, 0, 0, 0.0, 50.0, 99.0, 99.0, "far")], "doc_id long, page int, link_no int, bx0 double, by0 double, bx1 double, by1 double, uri string")
    assert [r["uri"] for r in ly.attach_links(g, boxes).orderBy("glyph_no").collect()] == ["second", "first", "second", None]
    plan = QUERIES["layout_linked"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("glyph_no") < plan.index("Join")  # glyphs are made above the join


def test_f4_words_without_a_shuffle(spark, tmp_path):
    holds(spark, tmp_path, "layout_words", ODD)
    assert "Exchange" not in QUERIES["layout_words"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_f13_redaction_meets_texts(spark, tmp_path):
    holds(spark, tmp_path, "layout_redact", ODD)
    plan = QUERIES["layout_redact"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    assert plan.index("glyph_no") < plan.index("Join")


@pytest.fixture
def no_frames(spark, monkeypatch):
    """A frame for each small group is what took the time: a query that makes one fails."""

    def refused(*_):
        raise AssertionError("a frame for each group")

    for kind in {GroupedData, type(spark.range(1).groupBy("id"))}:
        monkeypatch.setattr(kind, "applyInPandas", refused)


def test_f2_alignment_by_lists(spark, tmp_path, no_frames):
    holds(spark, tmp_path, "compare_page_alignment", ODD)


def test_f15_pairs_by_lists(spark, no_frames):
    rng = random.Random(2)
    votes = [(d, o, n, rng.randrange(1, 4)) for d in range(9) for o in range(8) for n in range(8) if rng.random() < 0.4]
    expected = set()
    for d in range(9):
        used = set()
        for o in range(8):
            free = [(-v, abs(n - o), n) for i, p, n, v in votes if (i, p) == (d, o) and n not in used]
            if free:
                used.add(min(free)[2])
                expected.add((d, o, min(free)[2]))
    assert {tuple(r) for r in cp.pair_pages(spark.createDataFrame(votes, "doc_id long, old_page int, new_page int, votes long")).collect()} == expected


def test_f12_reading_order_of_a_long_page(spark, no_frames):
    """1,500 boxes one under another are cut off one by one."""
    rows = [(1, 0, k, 0.0, 12.0 * k, 50.0, 12.0 * k + 5) for k in range(1500)] + [(2, 0, 7, 0.0, 0.0, 1.0, 1.0)]
    random.Random(3).shuffle(rows)
    found = ly.reading_order(spark.createDataFrame(rows, "doc_id long, page int, box int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted(tuple(r) for r in found) == [*((1, 0, k, k) for k in range(1500)), (2, 0, 7, 0)]


def test_f14_structure_by_lists(spark, tmp_path, no_frames):
    spark.createDataFrame(list(enumerate(ODD)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["audit_structure"](spark, str(tmp_path)).collect()
    segs = {(r["doc_id"], r["page"], s) for r in found for s in r["segs"]}
    assert segs == {(d, k // 20, k) for d, t in enumerate(ODD) for k, line in enumerate(t.split("\n")) if line.split()}
    assert len(segs) == sum(len(r["segs"]) for r in found)


def test_f11_labels_by_lists(spark, tmp_path, no_frames):
    holds(spark, tmp_path, "form_labels", ODD)


def test_f8_candidates_are_near(spark, tmp_path):
    """The pairs of a page whose letters are looked at are those that stand near each other, a few for each field."""
    holds(spark, tmp_path, "form_labels_tokens", ODD)
    box = "x0 double, y0 double, x1 double, y1 double"
    fields = spark.createDataFrame([(1, 0, k, "text", None, 60.0, 40.0 * k, 110.0, 40.0 * k + 10) for k in range(40)], f"doc_id long, page int, field int, kind string, tooltip string, {box}")
    blocks = spark.createDataFrame([(1, 0, k, 0.0, 40.0 * k, 50.0, 40.0 * k + 10, 10.0, f"word {k}") for k in range(40)], f"doc_id long, page int, block int, {box}, size double, text string")
    plan = fm.label_candidates(fields, blocks)
    assert plan.count() == 40
    assert any("Join Inner" in line and "_end1" in line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_f9_pairs_are_looked_up_once(spark, tmp_path):
    holds(spark, tmp_path, "layout_dehyphenate", [*ODD, "well known well-known to day today co op co-op xx yy zz " * 9, "a (b) -- c, d"])
    plan = QUERIES["layout_dehyphenate"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
