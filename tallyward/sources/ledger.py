"""Run and model ledgers: append-only event tables; the present state is the latest event.

Events: ``run_events(run_id, step, status, at, file_hash, error)`` where step ``run`` speaks for the whole
run, and ``model_events(model_name, version_id, attempt, event, at, metric)`` where event is
``registered`` or ``promoted``.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.operators.running import running

RUN_EVENTS = "run_id string, step string, status string, at timestamp, file_hash string, error string"
MODEL_EVENTS = "model_name string, version_id string, attempt int, event string, at timestamp, metric double"

# Stage names in order, and promotions kept per model.
STEPS = ["feature", "training", "inference", "forecasting", "risk", "drift_monitoring", "drift_handling", "alerting"]
KEPT_PROMOTIONS = 5


def new_run_id(now: datetime | None = None) -> str:
    """Sortable by time: ``run_<yyyymmdd_HHMMSS>_<8 hex digits>``, in UTC."""
    moment = now or datetime.now(timezone.utc)
    return f"run_{moment:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def run_event(
    spark: SparkSession, run_id: str, step: str, status: str, file_hash: str | None = None, error: str | None = None
) -> DataFrame:
    row = (run_id, step, status, datetime.now(timezone.utc).replace(tzinfo=None), file_hash, error)
    return spark.createDataFrame([row], RUN_EVENTS)


def step_status(events: DataFrame) -> DataFrame:
    """(run_id, step, status, at): latest event per run and step."""
    body = F.struct("status", "at")
    order = F.struct("at", F.array_position(F.array(*[F.lit(s) for s in ("PENDING", "RUNNING", "COMPLETE", "FAILED")]), F.col("status")))
    latest = events.groupBy("run_id", "step").agg(F.max_by(body, order).alias("last"))
    return latest.select("run_id", "step", "last.status", "last.at")


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status, started_at, completed_at, error, steps): one row per run."""
    whole = events.where("step = 'run'").groupBy("run_id").agg(
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") == "COMPLETE", F.col("at"))).alias("completed_at"),
        F.max("error").alias("error"),
    )
    now = step_status(events)
    state = now.where("step = 'run'").select("run_id", "status")
    steps = now.where("step <> 'run'").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "step", "status"))).alias("steps")
    )
    return state.join(whole, "run_id").join(steps, "run_id", "left")


def last_run(events: DataFrame) -> DataFrame:
    """(run_id) of the newest run, as one row."""
    return events.agg(F.max("run_id").alias("run_id"))


def new_files(hashes: DataFrame, events: DataFrame) -> DataFrame:
    """Files whose content no completed run has read. A failed run does not block a retry."""
    done = step_status(events).where("step = 'run' AND status = 'COMPLETE'").select("run_id")
    known = events.where("file_hash IS NOT NULL").join(done, "run_id", "left_semi").select("file_hash").distinct()
    return hashes.join(known, "file_hash", "left_anti")


def known_runs(hashes: DataFrame, events: DataFrame) -> DataFrame:
    """(path, file_hash, run_id): the completed run that already read the same content."""
    done = step_status(events).where("step = 'run' AND status = 'COMPLETE'").select("run_id")
    known = events.where("file_hash IS NOT NULL").join(done, "run_id", "left_semi")
    first = known.groupBy("file_hash").agg(F.min("run_id").alias("run_id"))
    return hashes.join(first, "file_hash")


def reference_runs(events: DataFrame) -> DataFrame:
    """(run_id, reference_run): the last earlier run that finished drift monitoring."""
    finished = F.max(
        F.when((F.col("step") == "drift_monitoring") & (F.col("status") == "COMPLETE"), F.col("run_id"))
    )
    per_run = events.groupBy("run_id").agg(finished.alias("finished"))
    # Runs come in order, so the last one that finished is the largest before.
    return running(per_run, "run_id", last_before={"reference_run": F.col("finished")}).drop("finished")


def model_versions(events: DataFrame) -> DataFrame:
    """Versions of each model, newest first by ``place``, with ``is_production`` for the current one."""
    per_version = events.groupBy("model_name", "version_id").agg(
        F.max(F.when(F.col("event") == "registered", F.col("at"))).alias("registered_at"),
        F.max(F.when(F.col("event") == "promoted", F.struct("at", "attempt"))).alias("promoted"),
        F.max_by("metric", "at").alias("metric"),
    )
    newest = Window.partitionBy("model_name").orderBy(F.desc("registered_at"), F.desc("version_id"))
    latest = Window.partitionBy("model_name").orderBy(F.col("promoted").desc_nulls_last(), F.desc("version_id"))
    return per_version.select(
        "model_name", "version_id", "registered_at", "metric",
        F.row_number().over(newest).alias("place"),
        ((F.row_number().over(latest) == 1) & F.col("promoted").isNotNull()).alias("is_production"),
    )


def production_models(events: DataFrame) -> DataFrame:
    return model_versions(events).where("is_production").select("model_name", "version_id", "metric")


def cold_start_models(events: DataFrame, names: list[str]) -> list[str]:
    """Which of the named models have no version yet."""
    held = {r[0] for r in events.where(F.col("model_name").isin(names)).select("model_name").distinct().collect()}
    return [n for n in names if n not in held]


def promotion_history(events: DataFrame) -> DataFrame:
    """The last five promotions of each model; place 1 is the current one, place 2 the rollback target."""
    order = Window.partitionBy("model_name").orderBy(F.desc("at"), F.desc("attempt"), F.desc("version_id"))
    ranked = events.where("event = 'promoted'").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= KEPT_PROMOTIONS).select(
        "model_name", "place", "version_id", "attempt", "at", "metric"
    )


def rollback_events(events: DataFrame, model_name: str) -> DataFrame:
    """The promotion event that restores the second most recent production version. Append it to roll back."""
    target = promotion_history(events.where(F.col("model_name") == model_name)).where("place = 2")
    if target.isEmpty():
        raise ValueError(f"{model_name} has no earlier production version")
    return target.select(
        "model_name", "version_id", "attempt", F.lit("promoted").alias("event"),
        F.current_timestamp().cast("timestamp").alias("at"), "metric",
    )
