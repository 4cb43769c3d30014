"""Actions: named steps DataFrame -> DataFrame that are checked before any runs and published as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search as sc


class NotApplicable(Exception):
    """A step that has nothing to do; optional steps are then skipped."""


@dataclass
class Step:
    run: Callable[..., DataFrame]
    params: dict[str, tuple[str, object]] = field(default_factory=dict)  # name: (kind, default)


CATALOGUE: dict[str, Step] = {
    "mask": Step(lambda df, overlay: df.withColumn("text", sc.mask_pii(F.col("text"), overlay=overlay)), {"overlay": ("text", "█")}),
    "replace": Step(lambda df, find, put: sc.replace_text(df, find, put).drop("n_replaced"), {"find": ("text", ""), "put": ("text", "")}),
    "min_length": Step(lambda df, n: df.where(F.length("text") >= n), {"n": ("number", 1)}),
    "language": Step(lambda df, lang: df.where(F.col("lang") == lang), {"lang": ("choice", "en")}),
    "prefix": Step(lambda df, template: df.withColumn("text", F.concat(F.replace(F.lit(template), F.lit("<<source>>"), F.col("source")), F.col("text"))), {"template": ("text", "")}),
}


def list_operations(spark: SparkSession) -> DataFrame:
    rows = [(name, p, kind, str(default)) for name, s in CATALOGUE.items() for p, (kind, default) in s.params.items()]
    return spark.createDataFrame(rows, "operation string, parameter string, kind string, default string")


def checked(steps: list[tuple[str, dict]]) -> list[tuple[Step, dict]]:
    out = []
    for name, params in steps:
        if name not in CATALOGUE:
            raise ValueError(f"unknown operation {name}")
        step = CATALOGUE[name]
        if unknown := set(params) - set(step.params):
            raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        out.append((step, {p: params.get(p, default) for p, (_, default) in step.params.items()}))
    return out


def run_action(df: DataFrame, steps: list[tuple[str, dict]], optional: tuple[str, ...] = ()) -> DataFrame:
    """df after all steps; nothing runs if a name or parameter is unknown. A step listed as optional may not apply."""
    for (name, _), (step, params) in zip(steps, checked(steps), strict=True):
        try:
            df = step.run(df, **params)
        except NotApplicable:
            if name not in optional:
                raise
    return df


def publish(df: DataFrame, folder: str, action: list[tuple[str, dict]]) -> str:
    """The result of an action in a new version below folder; readers take the version that is returned."""
    out = f"{folder}/version-{uuid.uuid4().hex}"
    run_action(df, action).write.parquet(out)
    return out


#: What a step says of an input that it has nothing to do for.
NOT_APPLICABLE = "not applicable"


@dataclass
class TextStep:
    """A step on one text as expressions, so that an input's failure is a value: fault gives a text, or null where run may go ahead."""

    run: Callable[..., Column]
    fault: Callable[..., Column] = lambda text: F.lit(None).cast("string")
    params: dict[str, object] = field(default_factory=dict)


TEXT_STEPS: dict[str, TextStep] = {
    "mask": TextStep(lambda t, overlay: sc.mask_pii(t, overlay=overlay), lambda t, overlay: F.when(sc.mask_pii(t, overlay=overlay) == t, NOT_APPLICABLE), {"overlay": "█"}),
    "replace": TextStep(lambda t, find, put: F.replace(t, F.lit(find), F.lit(put)), lambda t, find, put: F.when(~F.contains(t, F.lit(find)), NOT_APPLICABLE), {"find": "", "put": ""}),
    "at_least": TextStep(lambda t, n: t, lambda t, n: F.when(F.length(t) < n, "too short"), {"n": 1}),
    "number": TextStep(lambda t: t.try_cast("decimal(38,6)").cast("string"), lambda t: F.when(t.try_cast("decimal(38,6)").isNull(), "not a number")),
    "base64": TextStep(lambda t: F.try_to_binary(t, F.lit("base64")).cast("string"), lambda t: F.when(F.try_to_binary(t, F.lit("base64")).isNull(), "not base64")),
}


def batch_run(inputs: DataFrame, steps: list[tuple[str, dict]], optional: tuple[str, ...] = ()) -> DataFrame:
    """inputs with text after all steps, and status (ok, skipped, error), skipped (steps, joined by commas) and error ("step: fault").

    One input's failure stops nothing else: it keeps its text, and later steps pass it over. A step listed as optional that
    does not apply to an input is passed over for it and named in skipped; any other fault, and a null text, is an error.
    Unknown steps or parameters raise before anything runs. Columns named status, skipped or error give way.
    """
    for name, params in steps:
        if name not in TEXT_STEPS:
            raise ValueError(f"unknown operation {name}")
        if unknown := set(params) - set(TEXT_STEPS[name].params):
            raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    kept = [c for c in inputs.columns if c not in ("text", "status", "skipped", "error")]
    found = inputs.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), F.col("text").alias("was"), F.col("text").alias("now"), F.lit("").alias("skipped"), F.when(F.col("text").isNull(), "no text").alias("error"))
    for name, params in steps:
        step = TEXT_STEPS[name]
        args = {**step.params, **params}
        said = found.withColumn("fault", F.when(F.col("error").isNull(), step.fault(F.col("now"), **args)))
        passed = (F.col("fault") == NOT_APPLICABLE) & F.lit(name in optional)
        found = said.withColumns({
            "skipped": F.when(passed, F.concat_ws(",", F.nullif("skipped", F.lit("")), F.lit(name))).otherwise(F.col("skipped")),
            "now": F.when(F.col("error").isNull() & F.col("fault").isNull(), step.run(F.col("now"), **args)).otherwise(F.col("now")),
            "error": F.coalesce("error", F.when(~passed, F.concat(F.lit(f"{name}: "), F.col("fault")))),
        }).drop("fault")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("skipped") != "", "skipped").otherwise("ok")
    return found.select(*(F.col("row")[c].alias(c) for c in kept), F.when(F.col("error").isNull(), F.col("now")).otherwise(F.col("was")).alias("text"), status.alias("status"), "skipped", "error")


def batch_report(run: DataFrame) -> DataFrame:
    """status, error, skipped, n of a batch run."""
    return run.groupBy("status", "error", "skipped").agg(F.count("*").alias("n"))


def publish_batch(run: DataFrame, folder: str) -> str:
    """A batch run in a new version below folder: its good outputs, and, written last, a manifest of all inputs without their texts.

    A version without a manifest is one that was broken off; ``published`` does not give it.
    """
    out = f"{folder}/version-{uuid.uuid4().hex}"
    run.write.parquet(f"{out}/inputs")
    rows = run.sparkSession.read.schema(run.schema).parquet(f"{out}/inputs")
    rows.where("status <> 'error'").drop("status", "skipped", "error").write.parquet(f"{out}/outputs")
    rows.drop("text").write.parquet(f"{out}/manifest")
    return out


def complete(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match and were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath().getParent()) for f in found or [])


def published(spark: SparkSession, folder: str) -> list[str]:
    """The versions below folder that are whole."""
    return [m.removesuffix("/manifest") for m in complete(spark, f"{folder}/version-*/manifest")]


SWEEP = "file string, op string, status string, error string, at string"


def sweep(todo: DataFrame, run: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """All results so far (file, op, status, error, at) after run has been given those pairs of todo (file, op, ...) that the ledger in folder lacks.

    Results are appended as a folder of their own, which counts once it is written to its end: a sweep that is broken off
    leaves no half of it, and a second one runs only what is new.
    """
    spark = todo.sparkSession
    ledger = lambda: spark.read.schema(SWEEP).parquet(*done) if (done := complete(spark, f"{folder}/run-*")) else spark.createDataFrame([], SWEEP)
    new = todo.join(ledger().select("file", "op"), ["file", "op"], "left_anti")
    if not new.isEmpty():
        run(new).select("file", "op", "status", "error", "at").write.parquet(f"{folder}/run-{uuid.uuid4().hex}")
    return ledger()


def batch_outputs(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """inputs (name) with output: a name that is taken, before or by an earlier input, gets " 2", " 3", ..."""
    taken = existing.select(F.regexp_extract("name", r"^(.*?)(?: \d+)?$", 1).alias("base"), F.coalesce(F.regexp_extract("name", r" (\d+)$", 1).try_cast("int"), F.lit(1)).alias("k")).groupBy("base").agg(F.max("k").alias("most"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("input"))
    both = inputs.withColumn("_n", n).join(taken.withColumnRenamed("base", "name"), "name", "left")
    k = F.coalesce("most", F.lit(0)) + F.col("_n")
    return both.select("input", "name", F.when(k == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", k)).alias("output"))
