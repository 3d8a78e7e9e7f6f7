import pytest
from pyspark.sql import functions as F

from tallyward.errors import DataCleaningError, InsufficientDataError
from tallyward.operators import cleaning, quality, schema
from tallyward.operators.settling import Size

RAW = (
    "run_id string, employee_id string, department string, designation string, base_salary double, present_days double, "
    "total_working_days double, overtime_hours double, overtime_pay_per_hour double, net_salary double, lop_days double"
)


def table(spark, data):
    return spark.createDataFrame([("r", *x) for x in data], RAW)


def test_first_listed_synonym_wins():
    roles = schema.map_roles(["employee_id", "emp_id", "salary", "ctc", "dept"])
    assert roles.mapped["employee_id"] == "emp_id" and roles.mapped["base_salary"] == "salary"
    assert roles.confidence == pytest.approx(0.3)
    assert roles.warnings == ["SCHEMA_MISMATCH_WARNING"] and "net_salary" in roles.absent_features


def test_six_of_ten_roles_still_warn_and_skip_overtime():
    roles = schema.map_roles(["employee_id", "department", "base_salary", "net_salary", "present_days", "total_working_days"])
    assert roles.confidence == pytest.approx(0.6)
    assert roles.skipped_features == ["overtime_pay"]


def test_full_schema_has_no_warning():
    roles = schema.map_roles(list(schema.SYNONYMS))
    assert roles.confidence == 1.0 and not roles.warnings and not roles.absent_features


def test_unknown_headers_map_nothing():
    assert schema.map_roles(["col_a", "col_b"]).confidence == 0.0


def test_role_names_do_not_collide(spark):
    df = spark.createDataFrame([("a", "b", 1)], "emp_id string, employee_id string, tax_deducted int")
    out = schema.with_role_names(df, schema.map_roles(df.columns))
    assert out.columns == ["employee_id", "employee_id_raw", "tax_deducted"]


def test_null_flag_needs_more_than_twenty_percent(spark):
    df = spark.createDataFrame([("r", i, None if i < 2 else "x", None if i < 1 else "y") for i in range(5)],
                               "run_id string, i int, a string, b string")
    flags = {r["column"]: (r["null_pct"], r["flagged"]) for r in quality.null_profile(df).collect()}
    assert flags["a"] == (40.0, True) and flags["b"] == (20.0, False)


def test_copies_and_negatives(spark):
    df = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", -2, None), ("r", -2, None), ("r", 3, "b")],
                               "run_id string, x int, s string")
    line = quality.row_quality(df).first()
    assert (line["total_rows"], line["duplicate_rows"], line["impossible_value_rows"]) == (5, 2, 2)


DIRTY = [
    ("P1", "Ops", "Clerk", 41000.0, 20.0, 22.0, 4.0, 150.0, 42000.0, 2.0),
    ("P1", "Ops", "Clerk", 41000.0, 20.0, 22.0, 4.0, 150.0, 42000.0, 2.0),
    ("P2", "Law", "Aide", 52000.0, 22.0, 22.0, 0.0, 0.0, 52000.0, 0.0),
    (None, "Law", "Aide", 61000.0, 19.0, 22.0, None, 0.0, 61000.0, 3.0),
    ("P4", None, "Clerk", None, 21.0, 22.0, 0.0, 0.0, 33000.0, 1.0),
    ("P5", "Ops", "Lead", 73000.0, 22.0, 22.0, -3.0, 90.0, 73000.0, 0.0),
]


def test_copies_and_missing_required_leave_three_rows(spark, path_taken):
    traced = cleaning.trace_cleaning(table(spark, DIRTY))
    clean = cleaning.clean_rows(traced)
    assert clean.count() == 3
    assert not clean.where(" OR ".join(f"{c} IS NULL" for c in clean.columns)).count()
    line = cleaning.cleaning_summary(traced).first()
    assert (line["duplicates"], line["dropped_null_required"], line["overtime_hours_zeroed"]) == (1, 2, 1)
    assert line["original_rows"] == 6 and line["removal_pct"] == 50.0 and line["removal_warning"]


def test_impossible_values(spark, path_taken):
    data = [
        ("Q1", "A", "x", 100.0, 26.0, 22.0, 0.0, 0.0, 100.0, 0.0),
        ("Q2", "A", "x", 100.0, -3.0, 22.0, 0.0, -5.0, 100.0, 9.0),
        ("Q3", "A", "x", -100.0, 20.0, 22.0, 0.0, 0.0, 100.0, 0.0),
        ("Q4", "A", "x", 100.0, 20.0, 22.0, 0.0, 0.0, 0.0, 0.0),
    ]
    clean = {r["employee_id"]: r for r in cleaning.clean_records(table(spark, data)).collect()}
    assert set(clean) == {"Q1", "Q2"}
    assert (clean["Q1"]["present_days"], clean["Q1"]["lop_days"]) == (22, 0)
    assert (clean["Q2"]["present_days"], clean["Q2"]["lop_days"], clean["Q2"]["overtime_pay_per_hour"]) == (0, 22, 0)


def test_fills_use_rows_that_stay(spark, path_taken):
    data = [
        ("A", None, None, 10.0, None, None, None, None, 10.0, None),
        ("B", "d", "x", 10.0, 10.0, 20.0, 1.0, 1.0, 10.0, 0.0),
        ("C", "d", "x", 10.0, 13.0, 20.0, 1.0, 1.0, 10.0, 0.0),
        ("D", "d", "x", 10.0, 12.0, 21.0, 1.0, 1.0, 10.0, 0.0),
        ("E", "d", "x", 10.0, 13.0, 21.0, 1.0, 1.0, 10.0, 0.0),
        (None, "d", "x", 10.0, 1.0, 5.0, 1.0, 1.0, 10.0, 0.0),
    ]
    a = cleaning.clean_records(table(spark, data)).where("employee_id = 'A'").first()
    assert (a["department"], a["designation"]) == ("Unknown", "Unknown")
    # Median 12.5 is cut to 12; of the modes 20 and 21 the smaller one counts.
    assert (a["present_days"], a["total_working_days"], a["lop_days"], a["overtime_hours"]) == (12, 20, 8, 0)


def test_runs_without_any_day_value_use_a_full_month(spark, path_taken):
    data = [(f"E{i}", "d", "x", 10.0, None, None, 0.0, 0.0, 10.0, None) for i in range(3)]
    line = cleaning.clean_records(table(spark, data)).first()
    assert (line["present_days"], line["total_working_days"]) == (23, 23)


def test_text_numbers_are_read_before_the_checks(spark):
    df = spark.createDataFrame([("50000.5", "22"), ("60000", "n/a"), ("-", None)], "base_salary string, present_days string")
    out = [tuple(r) for r in cleaning.to_whole_numbers(df).collect()]
    assert out == [(50000, 22), (60000, 0), (0, 0)]


def test_gates(spark):
    two = table(spark, DIRTY[1:3])
    with pytest.raises(InsufficientDataError):
        cleaning.assert_usable(two)
    cleaning.assert_usable(two, min_rows=2)
    with pytest.raises(DataCleaningError):
        cleaning.assert_usable(two.withColumn("net_salary", F.lit(None).cast("bigint")), min_rows=1)


def test_a_third_of_all_rows_being_copies_costs_one_row(spark):
    many = spark.range(3000).select(
        F.lit("r").alias("run_id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("x")
    )
    line = quality.row_quality(many).first()
    assert (line["total_rows"], line["duplicate_rows"]) == (3000, 999)


def test_columns_a_file_lacks_are_not_needed(spark):
    df = table(spark, DIRTY).select("run_id", "employee_id", "base_salary", "net_salary")
    assert cleaning.clean_records(df, size=Size(6)).count() == 3


def test_coercion_of_suffixes_and_large_whole_numbers(spark):
    from tallyward.functions import scalars

    texts = spark.createDataFrame([("12d",), ("7f",), ("9007199254740993",), (" 5 ",), ("1.9",), ("1e3",), (".5",), (None,), ("x",)], "t string")
    assert [r[0] for r in texts.select(scalars.whole_number("t")).collect()] == [0, 0, 2**53 + 1, 5, 1, 1000, 0, 0, 0]
    large = spark.createDataFrame([(2**53 + 1,)], "n long")
    assert large.select(scalars.whole_number("n", "bigint")).first()[0] == 2**53 + 1
    shown = spark.createDataFrame([(2.5,), (-0.001,), (3e26,)], "x double").select(scalars.fixed(F.col("x"), 1)).collect()
    assert [r[0] for r in shown] == ["2.5", "0.0", "300000000000000000000000000.0"]
