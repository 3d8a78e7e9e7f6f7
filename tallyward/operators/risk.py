"""Risk of each entity over its runs: trend, escalation, repeated overtime, history.

The register is a long table with one row per entity and run. Several records of one entity in
a run first merge into one state, so an entity never has more rows than there are runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ["absenteeism", "overtime_abuse", "salary_manipulation"]


def entity_states(
    scored: DataFrame, entity: str = "employee_id", run: str = "run_id", score: str = "final_anomaly_score"
) -> DataFrame:
    """(entity, run, score, absenteeism, overtime_calc, salary_manipulation), one row per entity and run.

    Of several records the one with the highest score stands; the merge combines before the shuffle.
    """
    have = set(scored.columns)

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)

    state = F.struct(
        F.col(score).alias("score"),
        flag("absenteeism").alias("absenteeism"),
        flag("overtime_calc").alias("overtime_calc"),
        flag("salary_manipulation").alias("salary_manipulation"),
    )
    merged = scored.where(F.col(entity).isNotNull()).groupBy(
        F.col(entity).cast("string").alias(entity), run
    ).agg(F.max(state).alias("state"))
    return merged.select(entity, run, "state.*")


def _trend(now: Column, before: Column) -> Column:
    return F.when(now > before, "increasing").when(now < before, "decreasing").otherwise("stable")


def assess_history(states: DataFrame, entity: str = "employee_id", run: str = "run_id") -> DataFrame:
    """Trend, escalation and the repeated-overtime flag for every state of every entity.

    Once two states in a row break the overtime limit, the flag stays on for good. So it is on
    exactly where the limit is broken now, or was broken twice in a row at any earlier time.
    """
    order = Window.partitionBy(entity).orderBy(run)
    s1, s2 = F.lag("score", 1).over(order), F.lag("score", 2).over(order)
    twice = F.col("overtime_calc") & F.coalesce(F.lag("overtime_calc").over(order), F.lit(False))
    table = states.withColumns({"s1": s1, "s2": s2, "twice": twice})
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    stuck = F.coalesce(F.max("twice").over(earlier), F.lit(False))
    rising = (F.col("score") > F.col("s1")) & (F.col("s1") > F.col("s2"))
    return table.withColumns(
        {
            "trend": _trend(F.col("score"), F.col("s1")),
            "escalation": F.coalesce(rising, F.lit(False)),
            "overtime_abuse": F.col("overtime_calc") | stuck,
        }
    ).select(entity, run, "score", "trend", "escalation", *FLAGS)


def prior_states(register: DataFrame, before: str, entity: str = "employee_id", run: str = "run_id") -> DataFrame:
    """(entity, s1, s2, o1, o2): last two scores and stored overtime flags before a run."""
    order = Window.partitionBy(entity).orderBy(F.desc(run))
    recent = register.where(F.col(run) < before).withColumn("back", F.row_number().over(order))
    recent = recent.where("back <= 2")

    def pick(c: str, back: int) -> Column:
        return F.max(F.when(F.col("back") == back, F.col(c)))

    return recent.groupBy(entity).agg(
        pick("score", 1).alias("s1"), pick("score", 2).alias("s2"),
        pick("overtime_abuse", 1).alias("o1"), pick("overtime_abuse", 2).alias("o2"),
    )


def assess_run(
    states: DataFrame, register: DataFrame, run_id: str, entity: str = "employee_id", run: str = "run_id"
) -> DataFrame:
    """The same for one new run against the stored register, without touching older states again."""
    joined = states.where(F.col(run) == run_id).join(prior_states(register, run_id, entity, run), entity, "left")
    rising = (F.col("score") > F.col("s1")) & (F.col("s1") > F.col("s2"))
    stuck = F.coalesce(F.col("o1") & F.col("o2"), F.lit(False))
    return joined.select(
        entity, run, "score",
        _trend(F.col("score"), F.col("s1")).alias("trend"),
        F.coalesce(rising, F.lit(False)).alias("escalation"),
        "absenteeism",
        (F.col("overtime_calc") | stuck).alias("overtime_abuse"),
        "salary_manipulation",
    )


def _dimensions() -> Column:
    return F.struct(*[F.col(f) for f in FLAGS])


def register_now(
    assessed: DataFrame, active_in: str | None = None, entity: str = "employee_id", run: str = "run_id"
) -> DataFrame:
    """Latest state per entity; ``active_in`` keeps only the entities seen in that run."""
    state = F.struct(
        F.col(run).alias("last_run_id"), F.col("score").alias("current_score"), "trend",
        _dimensions().alias("risk_dimensions"),
    )
    latest = assessed.groupBy(entity).agg(F.max_by(state, F.col(run)).alias("state")).select(entity, "state.*")
    return latest.where(F.col("last_run_id") == active_in) if active_in else latest


def history_arrays(assessed: DataFrame, entity: str = "employee_id", run: str = "run_id") -> DataFrame:
    """The nested register: one row per entity with its states in run order, at most one per run."""
    step = F.struct(F.col(run).alias("run_id"), "score", "trend", _dimensions().alias("dimensions"))
    return assessed.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sort_array(F.collect_list(step)).alias("history")
    )
