"""Source divergence audit: how far the word frequencies of the sources of a language lie apart.

Identical texts of a language are collapsed first: one row with the number of its documents per source, combined before
the shuffle, so that copies cost nothing however many they are. Each text is tokenized once; its counts are weighted
with these multiplicities. Terms in at least ``LEAST_DOCS`` documents of a language are kept.

Smoothed shares p are integers, so all sums are exact. The distance of two sources is a sum over all kept terms, of
which most do not occur in either. With b for the share of a term that does not occur,

    sum |p - q| = V |b - b'| + sum over the one's terms (|p - b'| - |b - b'|) + sum over the other's (|q - b| - |b - b'|)
                  + sum over shared terms (|p - q| - |p - b'| - |q - b| + |b - b'|)

The second and third sums come from running totals over a source's distinct shares; only the last looks at pairs of sources,
those in the list of a term. Tasks add these up per pair of sources and hand on their totals.

Defined results. Null text, lang, source: ''. Languages without a kept term: pairs of value 0. Languages of one source: no pairs.
Ties: by item in UTF-8. Repeated rows: each counts. No rows: no rows. Extra columns are dropped; doc_id is not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table

LEAST_DOCS, SMOOTH, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: On UTF-8: runs of ASCII letters and of bytes of other characters.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: A task hands on its counts or sums when it holds so many.
HELD = 600_000
#: Sources of a language are numbered in so many bits; the pairs of more could not be listed.
SID_BITS = 24
MOST_SOURCES = (1 << SID_BITS) - 1


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, sources (source, n): a row per distinct text of a language. Texts, known by their SHA-256, are shuffled once."""
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "text", "source"))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = named.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")).groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return named.groupBy("lang", "digest").agg(F.first("text").alias("text")).join(copies.hint("merge"), ["lang", "digest"]).select("lang", "text", "sources")


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, term, source, docs, n, partitioned by language and term: documents with the term and its occurrences.

    A task hands on one row per term, with the sources side by side.
    """

    def flushed(held: dict) -> pa.RecordBatch:
        rows: dict = defaultdict(list)
        for (lang, source), (by_doc, by_word) in held.items():
            for t, k in by_word.items():
                rows[lang, t].append((source, by_doc[t], k))
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows.values()])]).astype(np.int32)
        at = pa.StructArray.from_arrays([pa.array([x[c] for r in rows.values() for x in r], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["source", "docs", "n"])
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), at)], ["lang", "term", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for part in slices(batches):
            for lang, text, sources in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), part.column(2).to_pylist(), strict=True):
                words = TERM.findall(text.as_py().lower())  # of bytes: A-Z only
                once = len(sources) == 1 and sources[0]["n"] == 1
                counts = None if once else Counter(words)
                for s in sources:
                    by_doc, by_word = held[lang, s["source"]]
                    if once:
                        by_doc.update(set(words))
                        by_word.update(words)
                        continue
                    for t, k in counts.items():
                        by_doc[t] += s["n"]
                        by_word[t] += s["n"] * k
            if sum(len(w) for _, w in held.values()) > HELD:
                yield flushed(held)
                held.clear()
        if held:
            yield flushed(held)

    rows = texts.mapInArrow(run, "lang string, term string, at array<struct<source:string,docs:long,n:long>>").repartition("lang", "term")
    return rows.select("lang", "term", F.inline("at")).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + SMOOTH), wide(total) + wide(terms) * SMOOTH)


def shared_sums(lists: DataFrame) -> DataFrame:
    """lang, s, u (s < u), v: the last sum of the formula, of lists (lang, at: array of (sid, p, b)), a row per term."""

    def combined(keys: list, values: list) -> tuple[np.ndarray, np.ndarray]:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        return key, np.add.reduceat(value[order], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        waiting = 0

        def flushed() -> pa.RecordBatch:
            key, total = combined(keys, values)
            names = list(langs)
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in key >> 2 * SID_BITS], pa.string()), pa.array(key >> SID_BITS & MOST_SOURCES), pa.array(key & MOST_SOURCES), pa.array(total)], ["lang", "s", "u", "v"])

        for part in slices(batches):
            for lang, at in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                sid, p, b = (at.values.field(k).to_numpy() for k in range(3))
                order = np.argsort(sid)
                sid, p, b = sid[order], p[order], b[order]
                for k in range(0, len(sid), 256):
                    i, j = np.triu_indices(min(256, len(sid) - k), 1, len(sid) - k)
                    i, j = i + k, j + k
                    if len(i):
                        waiting += len(i)
                        keys.append((langs.setdefault(lang, len(langs)) << 2 * SID_BITS) + (sid[i] << SID_BITS) + sid[j])
                        values.append(np.abs(p[i] - p[j]) - np.abs(p[i] - b[j]) - np.abs(p[j] - b[i]) + np.abs(b[i] - b[j]))
                    if waiting > 4 * HELD:
                        key, total = combined(keys, values)
                        keys, values, waiting = [key], [total], len(key)
                        if waiting > 2 * HELD:
                            yield flushed()
                            keys, values, waiting = [], [], 0
        if keys:
            yield flushed()

    return lists.mapInArrow(run, "lang string, s long, u long, v long").groupBy("lang", "s", "u").agg(F.sum("v").alias("v"))


def own_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, s, u, own: sum of |p - b of u| - |b of s - b of u| over the terms of s, for every other u of the language."""
    distinct = counts.groupBy("lang", F.col("sid").alias("s"), F.col("p").alias("at")).agg(F.count("*").alias("h"))
    one, other = groups.select("lang", F.col("sid").alias("s"), F.col("b").alias("own_b")), groups.select("lang", F.col("sid").alias("u"), "b")
    asked = one.join(other, "lang").where("s <> u")
    none = lambda t: F.lit(None).cast(t)
    both = distinct.select("lang", "s", "at", "h", (F.col("h") * F.col("at")).alias("hp"), none("long").alias("u"), none("long").alias("own_b")).unionByName(
        asked.select("lang", "s", F.col("b").alias("at"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("hp"), "u", "own_b")
    )
    below = Window.partitionBy("lang", "s").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "s")
    run = both.select("*", F.sum("h").over(below).alias("ch"), F.sum("hp").over(below).alias("cp"), F.sum("h").over(whole).alias("n"), F.sum("hp").over(whole).alias("sp")).where("u is not null")
    gap = F.expr("(sp - cp) - (n - ch) * at + ch * at - cp - n * abs(own_b - at)")
    return run.select("lang", "s", "u", gap.alias("own"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    s = Scratch(docs.sparkSession)
    term = Window.partitionBy("lang", "term")
    counts = term_counts(collapsed(docs)).select("lang", "source", "term", "n", F.sum("docs").over(term).alias("in_docs"), F.sum("n").over(term).alias("all_n"))
    kept = s.save(counts.where(F.col("in_docs") >= least_docs).drop("in_docs"))
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_distinct("term").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("lang_n", "v", "source_n")}
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long").alias("sid")
    groups = named.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").withColumns(zero).select("*", numbered)
    groups = s.save(groups.withColumn("b", F.when(F.col("v") > 0, share(F.lit(0), F.col("source_n"), F.col("v"))).otherwise(0)))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "sid", "term", "b", share(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))
    shares = s.save(shares)

    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "b")).alias("at")).select("lang", "at")
    shared = shared_sums(lists)
    both = shared.unionByName(shared.select("lang", F.col("u").alias("s"), F.col("s").alias("u"), "v"))
    own = s.save(own_sums(shares, groups))
    back = own.select("lang", F.col("s").alias("u"), F.col("u").alias("s"), F.col("own").alias("back"))
    names = groups.select("lang", "source", "sid", "b", "v")
    one, other = names.select("lang", "source", F.col("sid").alias("s"), F.col("b").alias("b1"), F.col("v").alias("terms")), names.select("lang", F.col("source").alias("item"), F.col("sid").alias("u"), F.col("b").alias("b2"))
    pairs = one.join(other, "lang").where("s <> u").join(own, ["lang", "s", "u"], "left").join(back, ["lang", "s", "u"], "left").join(both, ["lang", "s", "u"], "left")
    value = F.expr("terms * abs(b1 - b2) + coalesce(own, 0) + coalesce(back, 0) + coalesce(v, 0)")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(ranked))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    return found.unionByName(terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and source: lang, source, part (pair or term), item, value, rank."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
words AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
counts AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
lang_n AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
source_n AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + {UNIT} * (coalesce(c.n, 0) + {SMOOTH}) // (coalesce(s.total, 0) + {SMOOTH} * l.v) AS p, 1 + {UNIT} * (k.n + {SMOOTH}) // (l.total + {SMOOTH} * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN lang_n l USING (lang) LEFT JOIN source_n s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
