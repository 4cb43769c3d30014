"""Rule engines: each rule is a relation of violations; a report joins them to the catalogue of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities in the order of reports.
SEVERITIES = ("error", "warning", "info", "pass")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


def report(facts: DataFrame, rules: dict[str, tuple[str, Column]], by: str = "doc_id") -> DataFrame:
    """by, rule, severity, n_violations, status: one pass over facts; rules maps a name to (severity, violated)."""
    found = facts.groupBy(by).agg(*(F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias(name) for name, (_, bad) in rules.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(name).alias("n_violations")) for name, (severity, _) in rules.items()))
    each = found.select(by, F.explode(rows).alias("r")).select(by, "r.*")
    return each.withColumn("status", F.when(F.col("n_violations") > 0, F.col("severity")).otherwise("pass"))


def compliant(report_rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, compliant: no rule of severity error is violated."""
    return report_rows.groupBy(by).agg(F.every(F.col("status") != "error").alias("compliant"))


#: What every standard forbids, by the fact that shows it.
FORBIDDEN = {
    "encrypted": "encryption", "font_not_embedded": "fonts", "document_script": "actions", "forbidden_action": "actions", "trigger": "actions", "lzw_stream": "compression", "interpolated_image": "images",
    "postscript_object": "xobjects", "transfer_function": "graphics", "needs_appearances": "forms", "xfa": "forms", "forbidden_annotation": "annotations", "hidden_annotation": "annotations", "annotation_without_appearance": "annotations",
}
#: Per standard: more forbidden facts, facts that must be there (with a value, if one is given), the newest version.
STANDARDS = {
    "archive-2": ({"embedded_file": "attachments", "file_annotation": "annotations", "compressed_metadata": "metadata", "layer_without_name": "layers", "automatic_layer_state": "layers"}, {"document_id": ("structure", None), "part": ("metadata", "2")}, (1.7, "error")),
    "archive-3": ({"embedded_file_without_relation": "attachments", "compressed_metadata": "metadata", "layer_without_name": "layers", "automatic_layer_state": "layers"}, {"document_id": ("structure", None), "part": ("metadata", "3")}, (1.7, "error")),
    "print": ({"page_without_trim_box": "boxes"}, {"print_intent": ("color", None), "print_version": ("metadata", "4"), "trapped": ("metadata", None)}, (1.6, "warning")),
    "engineering": ({}, {"engineering_version": ("metadata", "1")}, None),
}


def validate_standard(docs: DataFrame, facts: DataFrame, standard: str) -> DataFrame:
    """doc_id, rule, severity, n: issues of docs (doc_id) by facts (doc_id, fact, value) against a standard; no error: compliant.

    Archives also need an archive intent where device colours or transparency are used.
    """
    extra, required, newest = STANDARDS[standard]
    named = {**FORBIDDEN, **extra}
    rules = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    issues = [facts.where(F.col("fact").isin(*named)).select("doc_id", rules[F.col("fact")].alias("rule"), F.lit("error").alias("severity"))]
    for fact, (rule, value) in required.items():
        there = facts.where((F.col("fact") == fact) & (F.lit(True) if value is None else F.col("value") == value)).select("doc_id")
        issues.append(docs.select("doc_id").join(there, "doc_id", "left_anti").select("doc_id", F.lit(rule).alias("rule"), F.lit("error").alias("severity")))
    if newest:
        issues.append(facts.where((F.col("fact") == "version") & (F.col("value").try_cast("double") > newest[0])).select("doc_id", F.lit("version").alias("rule"), F.lit(newest[1]).alias("severity")))
    if standard.startswith("archive"):
        device = facts.where(F.col("fact").isin("rgb", "cmyk", "transparency")).select("doc_id").distinct()
        intent = facts.where("fact = 'archive_intent'").select("doc_id")
        issues.append(device.join(intent, "doc_id", "left_anti").select("doc_id", F.lit("color").alias("rule"), F.lit("error").alias("severity")))
    every = issues[0]
    for more in issues[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))
