"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed by (source, lang, topic) before anything is shuffled. The cells' weights are then raked:
scaled in turn so that their sums by source, by language and by topic equal the targets, until no marginal is off
by more than ``TOLERANCE``. Each document is kept with the probability of its cell, min(1, rate * raked weight /
tokens); the rate is set so that the kept tokens are ``FRACTION`` of all in expectation. The draw is a hash of
doc_id, the same in every run and at every degree of parallelism.

Targets are shares by value for each marginal; values without a target keep their share of what is left. Where no
targets are given, shares are tempered: the token share to the power ``TEMPER``, normalised, which raises small
sources. The cells are as many as there are combinations of values: with up to ``SMALL`` of them (counted first)
the raking runs in one partition without shuffles and the result is broadcast; beyond, the same windows are
shuffled by their keys and the join is an ordinary one on salted keys.

Topics come from ``topic_column``, rules on the text itself; a topic column of the table would serve as well.

Defined results. Null source or language: the value ''. Null or empty text: no tokens; kept with its cell's
probability, and cells without any tokens are kept whole. Null doc_id: drawn by the hash of null. Repeated rows:
drawn alike, since the draw depends on doc_id alone. No rows: no rows. Extra columns are kept by ``mix`` and
dropped by the query. Everything is native: no Python runs on the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, unit_hash

KEYS = ("source", "lang", "topic")
TEMPER, FRACTION, TOLERANCE = 0.7, 0.8, 1e-6
ROUNDS, MOST_ROUNDS = 6, 60
SMALL, SALTS = 50_000, 32
#: Topics by the first rule that the text matches; the others are prose.
TOPICS = {"legal": "(?i)licen[cs]e|copyright", "contact": r"@\w|https?://", "table": r"\|", "symbols": r"[#$%&*]{3}"}


def topic_column(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    found = F.lit("prose")
    for name, rule in reversed(list(topics.items())):
        found = F.when(text.rlike(rule), name).otherwise(found)
    return found


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long")
    return docs.select("doc_id", *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in KEYS[:2]), topic_column(text).alias("topic"), words.alias("n_tokens"))


def targets(cells: DataFrame, key: str, shares: Mapping[str, float] | None) -> DataFrame:
    """cells with goal_<key>: the tokens that the key's value is to have; in all as many as there are."""
    own = Window.partitionBy(key)
    cells = cells.withColumn("_own", F.sum("tokens").over(own)).withColumn("_n", F.count("*").over(own))
    if shares:
        given = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))
        share = F.try_element_at(given, F.col(key))
        rest, left = cells.agg(F.sum(F.when(share.isNull(), F.col("tokens"))), F.sum(F.when(share.isNotNull(), share / F.col("_n")))).first()
        goal = F.when(share.isNotNull(), share).otherwise(F.col("_own") * (max(1 - (left or 0.0), 0.0) / (rest or 1)))
    else:
        goal = F.pow(F.col("_own").cast("double"), TEMPER)
    cells = cells.withColumn("_goal", goal)
    total, tokens = cells.agg(F.sum(F.col("_goal") / F.col("_n")), F.sum("tokens")).first()
    return cells.withColumn(f"goal_{key}", F.col("_goal") * ((tokens or 0) / (total or 1.0))).drop("_own", "_n", "_goal")


def rate(live: DataFrame, fraction: float) -> float:
    """r so that min(tokens, r * weight) over all cells sums to fraction of the tokens: what cells that are kept whole cannot give is spread over the others."""
    tokens, found = live.agg(F.sum("tokens")).first()[0], fraction
    full = -1
    while True:
        whole = F.lit(found) * F.col("weight") >= F.col("tokens")
        n, given, rest = live.agg(F.count(F.when(whole, 1)), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))).first()
        if n <= full or not rest:  # each round only adds cells, so this ends
            return found
        full, found = n, (fraction * tokens - (given or 0)) / rest


def rake(cells: DataFrame, keys: tuple[str, ...] = KEYS, shares: Mapping[str, Mapping[str, float]] | None = None, fraction: float = FRACTION) -> DataFrame:
    """Cells (keys, tokens, docs) with weight, the raked tokens, off, the largest relative error of the cell's marginals, and prob, the probability that a document is kept.

    Targets that the filled cells cannot meet leave errors above TOLERANCE: a warning tells the largest.
    """
    cells = cut(cells)
    small = cells.count() <= SMALL
    pack = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    cells = pack(cells)
    live = cells.where("tokens > 0")
    for key in keys:
        live = targets(live, key, (shares or {}).get(key))
    live = cut(live.withColumn("weight", F.col("tokens").cast("double")))
    off = F.greatest(*(F.abs(F.sum("weight").over(Window.partitionBy(k)) / F.col(f"goal_{k}") - 1) for k in keys))
    for done in range(ROUNDS, MOST_ROUNDS + 1, ROUNDS):
        live = pack(live)
        for _ in range(ROUNDS):
            for key in keys:
                live = live.withColumn("weight", F.col("weight") * F.col(f"goal_{key}") / F.sum("weight").over(Window.partitionBy(key)))
        live = cut(live)
        worst = pack(live).select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0
        if worst <= TOLERANCE:
            break
        if done == MOST_ROUNDS:
            warnings.warn(f"raking: a marginal is off by {worst:.2g} after {done} rounds", stacklevel=2)
    found = rate(live, fraction) if live.head(1) else fraction
    prob = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("weight") * found / F.col("tokens")))
    raked = pack(live).select(*keys, "tokens", "docs", *(f"goal_{k}" for k in keys), "weight", off.alias("off"), prob.alias("prob"))
    none = cells.where("tokens <= 0").select(*keys, "tokens", "docs", *(F.lit(0.0).alias(f"goal_{k}") for k in keys), F.lit(0.0).alias("weight"), F.lit(0.0).alias("off"), F.lit(1.0).alias("prob"))
    return cut(raked.unionByName(none))


def with_probability(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (keys and more) with prob of their cells."""
    probs = cells.select(*KEYS, "prob")
    if cells.count() <= SMALL:
        return rows.join(F.broadcast(probs), list(KEYS), "left")
    salted = probs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*KEYS, "salt"], "left").drop("salt")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, prob, kept."""
    rows = cut(described(table(spark, sf_dir, "documents")))
    found = with_probability(rows, rake(cells_of(rows)))
    return found.select("doc_id", *KEYS, "n_tokens", "prob", (unit_hash("doc_id") < F.col("prob")).alias("kept"))


def mix(docs: DataFrame, shares: Mapping[str, Mapping[str, float]] | None = None, fraction: float = FRACTION) -> DataFrame:
    """The documents that are drawn, with their columns as they are."""
    cells = rake(cells_of(described(docs)), shares=shares, fraction=fraction)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": topic_column(text)}
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), *(c.alias(k) for k, c in keyed.items()))
    return with_probability(packed, cells).where(unit_hash("doc_id") < F.col("prob")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights."""
    return mix(docs)
