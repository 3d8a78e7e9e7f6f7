"""Column roles: mapping varied headers to one schema. Works on column names only, no job runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted names of each canonical column, in order of preference.
SYNONYMS: dict[str, list[str]] = {
    "employee_id": ["emp_id", "employee_id", "id", "staff_id", "worker_id"],
    "base_salary": ["base_salary", "basic_pay", "gross_pay", "salary", "basic_salary", "ctc"],
    "present_days": ["present_days", "days_present", "attendance_days", "working_days_attended"],
    "overtime_hours": ["overtime_hours", "ot_hours", "extra_hours", "overtime"],
    "lop_days": ["lop_days", "loss_of_pay", "unpaid_leave", "lop"],
    "department": ["department", "dept", "division", "team", "business_unit"],
    "designation": ["designation", "role", "title", "job_title", "position"],
    "total_working_days": ["total_working_days", "working_days", "business_days"],
    "overtime_pay_per_hour": ["overtime_pay_per_hour", "ot_rate", "ot_pay_rate"],
    "net_salary": ["net_salary", "take_home", "net_pay", "updated_net_salary", "actual_salary"],
}

# Column order of the feature table and the whole-number columns.
CANONICAL = [
    "employee_id", "department", "designation", "base_salary", "present_days",
    "total_working_days", "overtime_hours", "overtime_pay_per_hour", "net_salary", "lop_days",
]
WHOLE_NUMBERS = [
    "base_salary", "present_days", "total_working_days", "overtime_hours",
    "overtime_pay_per_hour", "net_salary", "lop_days",
]
LOW_CONFIDENCE = 0.7

# Columns that would give the absenteeism label away.
ABSENTEEISM_LEAKS = [
    "present_days", "total_working_days", "lop_days", "attendance_ratio", "earned_base",
    "expected_gross_salary", "expected_net", "salary_diff", "net_salary",
]


@dataclass(frozen=True)
class RoleMap:
    """Which input column plays which canonical role."""

    mapped: Mapping[str, str]
    unmapped: tuple[str, ...]

    @property
    def confidence(self) -> float:
        return len(self.mapped) / (len(self.mapped) + len(self.unmapped))

    @property
    def warnings(self) -> list[str]:
        return ["SCHEMA_MISMATCH_WARNING"] if self.confidence < LOW_CONFIDENCE else []

    @property
    def skipped_features(self) -> list[str]:
        needed = {"overtime_hours", "overtime_pay_per_hour"}
        return [] if needed <= set(self.mapped) else ["overtime_pay"]

    @property
    def absent_features(self) -> list[str]:
        """Roles worth naming in explanations: only when the schema as a whole is doubtful."""
        return list(self.unmapped) if self.warnings else []


def tidy_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def map_roles(columns: Sequence[str], synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> RoleMap:
    """For each role, the first of its accepted names that is present."""
    present = set(columns)
    choice = {role: next((n for n in names if n in present), None) for role, names in synonyms.items()}
    return RoleMap(
        mapped={role: name for role, name in choice.items() if name},
        unmapped=tuple(role for role, name in choice.items() if not name),
    )


def to_canonical(df: DataFrame, roles: RoleMap, keep: Sequence[str] = ()) -> DataFrame:
    """Only the mapped roles under their canonical names, plus ``keep``."""
    chosen = [F.col(roles.mapped[r]).alias(r) for r in CANONICAL if r in roles.mapped]
    return df.select(*[k for k in keep if k in df.columns], *chosen)


def with_role_names(df: DataFrame, roles: RoleMap, keep: Sequence[str] = ()) -> DataFrame:
    """Mapped columns under their canonical names, all other columns kept.

    A column that has a canonical name without playing that role gets the suffix ``_raw``.
    """
    role_of = {source: role for role, source in roles.mapped.items()}
    names = []
    for c in df.columns:
        spare = f"{c}_raw" if c in SYNONYMS and c not in keep else c
        names.append(role_of.get(c, spare))
    return df.toDF(*names)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """All numeric columns by schema. Identifiers are no measurements and are left out."""
    skip = {"employee_id", *exclude}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def detector_features(df: DataFrame) -> list[str]:
    return numeric_columns(df, exclude=["net_salary"])


def absenteeism_features(df: DataFrame) -> list[str]:
    labels = [f"{c}_code" for c in ("department", "designation") if c in df.columns]
    leaks = [*ABSENTEEISM_LEAKS, "department_code", "designation_code"]
    return numeric_columns(df, exclude=leaks) + labels


def manipulation_features(df: DataFrame) -> list[str]:
    wanted = ["salary_diff", "salary_dev_pct", "robust_z_salary_diff", "robust_z_salary_dev_pct"]
    return [c for c in wanted if c in df.columns]


def feature_vector(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """The stored feature list in its own order; a column the data lacks counts as 0."""
    held = set(df.columns)
    return [
        (F.col(f).cast("double") if f in held else F.lit(0.0)).alias(f) for f in features
    ]


def shared_columns(current: DataFrame, reference: DataFrame) -> list[str]:
    """Numeric columns both tables have, in the order of the current one."""
    return [c for c in numeric_columns(current) if c in set(reference.columns)]


def stack_histories(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several runs in one table; a column a run lacks is null there."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
