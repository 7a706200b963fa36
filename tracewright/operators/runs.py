"""Runs that go on where they stopped: which stages of which runs are due, from a log of status events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources import sinks

# The states of a stage that artifacts and reports name.
RUNNING, DONE, ERROR = "running", "done", "error"
EVENTS = "run_id string, stage string, status string, error string"

#: A stage: the runs that are due (run_id) to a table of those that failed (run_id, error), or None.
Stage = Callable[[DataFrame], DataFrame | None]


def stages_due(
    runs: DataFrame, status: DataFrame, stages: list[str], skipped: Iterable[str] = (), force: Column | bool = False, behind: bool = True
) -> DataFrame:
    """run_id, place, stage, status, action ('run' or 'skip') and why, for each run and each stage of the chain.

    runs: run_id (once). status: run_id, stage, status: the latest of each (sinks.latest_status); what it has besides does
    not count. A stage runs if it is not done, if it is forced (a flag, or a column of runs), or, with `behind`, if a
    stage before it runs: what it read is then old. Stages in `skipped` are no part of the chain. A run without events
    runs all of it.
    """
    left_out = set(skipped)
    chain = [s for s in stages if s not in left_out]
    wanted = runs.select(
        "run_id",
        (force if isinstance(force, Column) else F.lit(force)).alias("forced"),
        F.posexplode(F.array(*map(F.lit, chain))).alias("place", "stage")
    )
    known = wanted.join(status.select("run_id", "stage", "status"), ["run_id", "stage"], "left")
    open_ = ~F.coalesce(F.col("status") == DONE, F.lit(False))
    before = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    stale = F.coalesce(F.max(open_ | F.col("forced")).over(before), F.lit(False)) & F.lit(behind)
    why = F.when(F.col("forced"), "forced").when(
        open_, F.coalesce(F.concat(F.lit("was "), "status"), F.lit("never ran"))
    ).when(stale, "a stage before it runs").otherwise("done")
    return known.select(
        "run_id",
        "place",
        "stage",
        "status",
        F.when(F.col("forced") | open_ | stale, "run").otherwise("skip").alias("action"),
        why.alias("why")
    )


def _told(runs: DataFrame, stage: str, status: str, error: Column | None = None) -> DataFrame:
    return runs.select(
        "run_id",
        F.lit(stage).alias("stage"),
        F.lit(status).alias("status"),
        (error if error is not None else F.lit(None).cast("string")).alias("error")
    )


def run_chain(
    spark: SparkSession,
    runs: DataFrame,
    stages: dict[str, Stage],
    log: str,
    skipped: Iterable[str] = (),
    force: bool = False,
    behind: bool = True
) -> DataFrame:
    """Runs what is due, stage by stage, each stage once for all its runs; returns the plan it followed (stages_due).

    Events are appended to `log`, the plan is written beside it. A stage gives back the runs that failed: these leave the
    chain, the others go on. If a stage itself breaks, all its runs have failed and the error is raised. A chain that is
    started again goes on from the log, wherever the last one stopped.
    """
    sinks.append(spark.createDataFrame([], EVENTS), log)  # the log is there, whatever comes
    logged = lambda: sinks.latest_status(spark.read.parquet(log))
    path = f"{log.rstrip('/')}.plans/{uuid.uuid4().hex}"
    stages_due(runs, logged(), list(stages), skipped, force, behind).write.parquet(path)
    plan, tried = spark.read.parquet(path), []
    for name, stage in stages.items():
        due = plan.where((F.col("stage") == name) & (F.col("action") == "run")).select("run_id")
        if tried:
            due = due.join(
                logged().where(F.col("stage").isin(tried) & (F.col("status") == ERROR)).select("run_id").distinct(), "run_id", "left_anti"
            )
        if due.isEmpty():
            continue
        tried.append(name)
        sinks.append(_told(due, name, RUNNING), log)
        try:
            failed = stage(due)
            if failed is None:
                sinks.append(_told(due, name, DONE), log)
            else:
                why = failed.groupBy("run_id").agg(F.min(F.coalesce("error", F.lit(""))).alias("why"))
                ended = due.join(why, "run_id", "left").withColumn("status", F.when(F.col("why").isNull(), DONE).otherwise(ERROR))
                sinks.append(ended.select("run_id", F.lit(name).alias("stage"), "status", F.col("why").alias("error")), log)
        except Exception as e:
            sinks.append(_told(due, name, ERROR, F.lit(str(e)[:1000])), log)
            raise
    return plan
