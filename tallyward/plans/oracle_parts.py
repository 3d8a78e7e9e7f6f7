"""Common table expressions of the check queries, in the SQL of the checking engine."""

from __future__ import annotations

_PARTS = {
    "pay": """
SELECT CONCAT('E', CAST(c_custkey AS VARCHAR)) AS employee_id, CONCAT('run_', CAST(yr AS VARCHAR)) AS run_id,
  c_mktsegment AS department, n_name AS designation, base_salary,
  CAST(23 - k1 % 6 AS BIGINT) AS present_days, CAST(23 AS BIGINT) AS total_working_days,
  CAST(k2 % 20 AS BIGINT) + CASE WHEN c_custkey % 41 = 0 THEN CAST(40 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS overtime_hours,
  CAST(300 + 100 * (c_custkey % 3) AS BIGINT) AS overtime_pay_per_hour,
  CAST(FLOOR(CAST(base_salary AS DOUBLE) * CAST(23 - k1 % 6 AS DOUBLE) / CAST(23 AS DOUBLE)) AS BIGINT)
    + (CAST(k2 % 20 AS BIGINT) + CASE WHEN c_custkey % 41 = 0 THEN CAST(40 AS BIGINT) ELSE CAST(0 AS BIGINT) END)
      * CAST(300 + 100 * (c_custkey % 3) AS BIGINT)
    + CASE WHEN c_custkey % 37 = 0 THEN CAST(50000 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS net_salary,
  CAST(k1 % 6 AS BIGINT) AS lop_days
FROM (SELECT c_custkey, c_mktsegment, n_name, EXTRACT(YEAR FROM o_orderdate) AS yr,
    CAST(FLOOR(CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE)) AS BIGINT) AS base_salary,
    MIN(o_orderkey) AS k1, SUM(o_orderkey) AS k2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY c_custkey, c_mktsegment, n_name, EXTRACT(YEAR FROM o_orderdate)) g
""",
    "dirty_once": """
SELECT k, CASE WHEN k % 101 = 0 THEN NULL ELSE employee_id END AS employee_id, run_id,
  CASE WHEN k % 13 = 0 THEN NULL ELSE department END AS department, designation,
  CASE WHEN k % 89 = 0 THEN NULL WHEN k % 97 = 0 THEN -base_salary ELSE base_salary END AS base_salary,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 19 = 0 THEN CAST(25 AS BIGINT) WHEN k % 23 = 0 THEN CAST(-2 AS BIGINT) ELSE present_days END AS present_days,
  CASE WHEN k % 17 = 0 THEN NULL ELSE total_working_days END AS total_working_days,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 31 = 0 THEN -overtime_hours - 1 ELSE overtime_hours END AS overtime_hours,
  CASE WHEN k % 43 = 0 THEN 'n/a' ELSE CAST(overtime_pay_per_hour AS VARCHAR) END AS overtime_pay_per_hour,
  CASE WHEN k % 83 = 0 THEN CAST(0 AS BIGINT) ELSE net_salary END AS net_salary, lop_days
FROM (SELECT pay.*, CAST(SUBSTRING(employee_id, 2) AS BIGINT) AS k FROM pay) p
""",
    "dirty": """
SELECT * EXCLUDE (k) FROM dirty_once UNION ALL SELECT * EXCLUDE (k) FROM dirty_once WHERE k % 29 = 0
""",
    "complete": """
SELECT DISTINCT * FROM dirty WHERE employee_id IS NOT NULL AND base_salary IS NOT NULL AND net_salary IS NOT NULL
""",
    "fills": """
SELECT c.run_id, CAST(TRUNC(MEDIAN(present_days)) AS BIGINT) AS usual_present,
  (SELECT total_working_days FROM complete m WHERE m.run_id = c.run_id AND total_working_days IS NOT NULL
   GROUP BY total_working_days ORDER BY COUNT(*) DESC, total_working_days LIMIT 1) AS usual_total
FROM complete c GROUP BY c.run_id
""",
    "filled": """
SELECT employee_id, c.run_id, COALESCE(department, 'Unknown') AS department, COALESCE(designation, 'Unknown') AS designation,
  base_salary, COALESCE(present_days, usual_present, 23) AS present_days,
  COALESCE(total_working_days, usual_total, 23) AS total_working_days,
  COALESCE(overtime_hours, 0) AS overtime_hours,
  COALESCE(TRY_CAST(overtime_pay_per_hour AS DOUBLE), 0) AS overtime_pay_per_hour, net_salary
FROM complete c LEFT JOIN fills USING (run_id)
""",
    "clean": """
SELECT employee_id, run_id, department, designation, base_salary,
  GREATEST(LEAST(present_days, total_working_days), 0) AS present_days, total_working_days,
  GREATEST(overtime_hours, 0) AS overtime_hours,
  CAST(GREATEST(overtime_pay_per_hour, 0) AS BIGINT) AS overtime_pay_per_hour, net_salary,
  total_working_days - GREATEST(LEAST(present_days, total_working_days), 0) AS lop_days
FROM filled WHERE base_salary > 0 AND net_salary > 0
""",
    "fe": """
SELECT p.*, present_days / total_working_days AS attendance_ratio,
  overtime_hours * overtime_pay_per_hour AS overtime_pay,
  (base_salary / total_working_days) * present_days AS earned_base,
  (base_salary / total_working_days) * present_days + overtime_hours * overtime_pay_per_hour AS expected_gross_salary,
  (base_salary / total_working_days) * present_days + overtime_hours * overtime_pay_per_hour AS expected_net,
  net_salary - ((base_salary / total_working_days) * present_days + overtime_hours * overtime_pay_per_hour) AS salary_diff,
  (base_salary - peer_mean) / peer_mean * 100 AS salary_dev_pct
FROM pay p JOIN (SELECT run_id, designation, AVG(base_salary) AS peer_mean FROM pay GROUP BY run_id, designation) m
  USING (run_id, designation)
""",
    "long": """
UNPIVOT (SELECT employee_id, run_id, CAST(base_salary AS DOUBLE) AS base_salary, CAST(present_days AS DOUBLE) AS present_days,
  CAST(total_working_days AS DOUBLE) AS total_working_days, CAST(overtime_hours AS DOUBLE) AS overtime_hours,
  CAST(overtime_pay_per_hour AS DOUBLE) AS overtime_pay_per_hour, CAST(net_salary AS DOUBLE) AS net_salary,
  CAST(lop_days AS DOUBLE) AS lop_days, CAST(attendance_ratio AS DOUBLE) AS attendance_ratio,
  CAST(overtime_pay AS DOUBLE) AS overtime_pay, earned_base, expected_gross_salary, expected_net, salary_diff, salary_dev_pct FROM fe)
ON base_salary, present_days, total_working_days, overtime_hours, overtime_pay_per_hour, net_salary, lop_days, attendance_ratio,
  overtime_pay, earned_base, expected_gross_salary, expected_net, salary_diff, salary_dev_pct INTO NAME col VALUE x
""",
    "medians": "SELECT run_id, col, QUANTILE_CONT(x, 0.5) AS med FROM long GROUP BY run_id, col",
    "mads": """
SELECT run_id, col, med, QUANTILE_CONT(ABS(x - med), 0.5) AS mad FROM long JOIN medians USING (run_id, col) GROUP BY run_id, col, med
""",
    "z": """
SELECT employee_id, run_id, col, CASE WHEN mad = 0 THEN 0.0 ELSE (x - med) / mad END AS z FROM long JOIN mads USING (run_id, col)
""",
    "zs": """
SELECT employee_id, run_id, MAX(CASE WHEN col = 'base_salary' THEN z END) AS z_base,
  MAX(CASE WHEN col = 'salary_dev_pct' THEN z END) AS z_dev FROM z WHERE col IN ('base_salary', 'salary_dev_pct') GROUP BY employee_id, run_id
""",
    "rules": """
SELECT fe.*, s.diff_sigma, s.dev_sigma, g.m + 2 * COALESCE(g.s, s.hours_sigma, 0) AS overtime_limit,
  COALESCE(s.diff_sigma > 0 AND ABS(salary_diff) > s.diff_sigma, FALSE) AS breaks_salary_diff,
  COALESCE(s.dev_sigma > 0 AND ABS(salary_dev_pct) > s.dev_sigma, FALSE) AS breaks_salary_dev_pct,
  overtime_hours > g.m + 2 * COALESCE(g.s, s.hours_sigma, 0) AS breaks_overtime,
  1 + CASE WHEN s.diff_sigma > 0 THEN 1 ELSE 0 END + CASE WHEN s.dev_sigma > 0 THEN 1 ELSE 0 END AS rules_evaluated
FROM fe JOIN (SELECT run_id, STDDEV_SAMP(salary_diff) AS diff_sigma, STDDEV_SAMP(salary_dev_pct) AS dev_sigma,
    STDDEV_SAMP(overtime_hours) AS hours_sigma FROM fe GROUP BY run_id) s USING (run_id)
  JOIN (SELECT run_id, department, AVG(overtime_hours) AS m, STDDEV_SAMP(overtime_hours) AS s FROM fe GROUP BY run_id, department) g
  USING (run_id, department)
""",
    "judged": """
SELECT *, CAST(breaks_salary_diff AS INT) + CAST(breaks_salary_dev_pct AS INT) + CAST(breaks_overtime AS INT) AS rules_violated FROM rules
""",
    "zmean": """
SELECT employee_id, run_id, z_base, z_dev, (ABS(z_base) + ABS(z_dev)) / 2.0 AS zm FROM zs
""",
    "zcomp": """
SELECT employee_id, run_id, z_base, z_dev, CASE WHEN hi > lo THEN (zm - lo) / (hi - lo) ELSE 0.0 END AS z_component
FROM zmean JOIN (SELECT run_id, MIN(zm) AS lo, MAX(zm) AS hi FROM zmean GROUP BY run_id) b USING (run_id)
""",
    # The stand-in model decision of the check queries: minus the distance of pay from its expectation.
    "modelled": """
SELECT employee_id, run_id, CASE WHEN hi > lo THEN (ABS(salary_diff) - lo) / (hi - lo) ELSE 0.0 END AS model_component
FROM fe JOIN (SELECT run_id, MIN(ABS(salary_diff)) AS lo, MAX(ABS(salary_diff)) AS hi FROM fe GROUP BY run_id) b USING (run_id)
""",
    "scored": """
SELECT *, CASE WHEN score < 0.3 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' WHEN score < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_tier
FROM (SELECT j.*, z_base, z_dev, z_component, model_component,
    0.4 * (rules_violated / rules_evaluated) + 0.3 * z_component + 0.3 * model_component AS score
  FROM judged j JOIN zcomp USING (employee_id, run_id) JOIN modelled USING (employee_id, run_id)) s
""",
    "overtime": """
SELECT fe.*, overtime_hours > m + 2 * COALESCE(s, 0) AS overtime_calc
FROM fe JOIN (SELECT run_id, department, MEDIAN(overtime_hours) AS m, STDDEV_SAMP(overtime_hours) AS s FROM fe GROUP BY run_id, department) g
  USING (run_id, department)
""",
    # One state per entity and run; the score of the check queries is the size of the peer deviation.
    "states": """
SELECT employee_id, run_id, ABS(salary_dev_pct) AS score, overtime_calc, present_days < total_working_days * 0.9 AS absenteeism,
  ABS(salary_diff) > 40000 AS salary_manipulation FROM overtime
""",
    "lagged": """
SELECT *, LAG(score, 1) OVER w AS s1, LAG(score, 2) OVER w AS s2,
  overtime_calc AND COALESCE(LAG(overtime_calc) OVER w, FALSE) AS twice FROM states WINDOW w AS (PARTITION BY employee_id ORDER BY run_id)
""",
    "assessed": """
SELECT employee_id, run_id, score, CASE WHEN score > s1 THEN 'increasing' WHEN score < s1 THEN 'decreasing' ELSE 'stable' END AS trend,
  COALESCE(score > s1 AND s1 > s2, FALSE) AS escalation, absenteeism, salary_manipulation,
  overtime_calc OR COALESCE(BOOL_OR(twice) OVER (PARTITION BY employee_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS overtime_abuse
FROM lagged
""",
    "pairs": """
SELECT run_id, LAG(run_id) OVER (ORDER BY run_id) AS reference_run FROM (SELECT DISTINCT run_id FROM pay) r
""",
    # Pay of every other run scaled by 2.1, so that drift between runs is strong.
    "swung": """
SELECT employee_id, run_id, 'base_salary' AS col, CASE WHEN CAST(SUBSTRING(run_id, 5) AS INT) % 2 = 0 THEN base_salary * CAST(2.1 AS DOUBLE) ELSE CAST(base_salary AS DOUBLE) END AS x FROM fe
UNION ALL SELECT employee_id, run_id, 'overtime_hours', CAST(overtime_hours AS DOUBLE) + CASE WHEN run_id = 'run_1999' THEN 6 ELSE 0 END FROM fe
UNION ALL SELECT employee_id, run_id, 'salary_dev_pct', salary_dev_pct FROM fe
UNION ALL SELECT employee_id, run_id, 'present_days', CAST(present_days AS DOUBLE) FROM fe
""",
    "edges": """
SELECT run_id, col, QUANTILE_CONT(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM swung GROUP BY run_id, col
""",
    "placed": """
SELECT p.run_id, e.col, CASE WHEN s.run_id = p.run_id THEN 1 ELSE 0 END AS is_current,
  LIST_SUM(LIST_TRANSFORM(e.e, lambda v: CASE WHEN s.x >= v THEN 1 ELSE 0 END)) AS bin
FROM pairs p JOIN edges e ON e.run_id = p.reference_run
  JOIN swung s ON s.col = e.col AND (s.run_id = p.run_id OR s.run_id = p.reference_run)
""",
    "shares": """
SELECT run_id, col, b AS bin,
  COALESCE(NULLIF(CAST(COUNT(*) FILTER (WHERE is_current = 1 AND bin = b) AS DOUBLE), 0) / COUNT(*) FILTER (WHERE is_current = 1), 1e-4) AS c,
  COALESCE(NULLIF(CAST(COUNT(*) FILTER (WHERE is_current = 0 AND bin = b) AS DOUBLE), 0) / COUNT(*) FILTER (WHERE is_current = 0), 1e-4) AS r
FROM placed CROSS JOIN (SELECT UNNEST(RANGE(10)) AS b) bins GROUP BY run_id, col, b
""",
    "psi": "SELECT run_id, col, SUM((c - r) * LN(c / r)) AS psi FROM shares GROUP BY run_id, col",
    "drift": """
SELECT run_id, MAX(psi) AS max_psi, CASE WHEN MAX(psi) < 0.1 THEN 'No Drift' WHEN MAX(psi) <= 0.25 THEN 'Moderate Drift' ELSE 'Significant Drift' END AS overall_severity
FROM psi GROUP BY run_id
""",
    "months": """
SELECT STRFTIME(o_orderdate, '%Y-%m') AS month, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1
""",
    "segment_months": """
SELECT c_mktsegment AS department, STRFTIME(o_orderdate, '%Y-%m') AS month, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
""",
    # Sparse on purpose: one series per nation, priority and segment has gaps and late starts.
    "sparse_quarters": """
SELECT CONCAT(n_name, '/', o_orderpriority, '/', c_mktsegment) AS team, CONCAT(EXTRACT(YEAR FROM o_orderdate), '-Q', EXTRACT(QUARTER FROM o_orderdate)) AS quarter,
  CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""",
    "run_totals": """
SELECT run_id, CAST(SUM(net_salary) AS BIGINT) AS total_payroll, CAST(SUM(overtime_hours) AS BIGINT) AS overtime_hours FROM pay GROUP BY run_id
""",
    "indexed_runs": "SELECT *, ROW_NUMBER() OVER (ORDER BY run_id) AS t FROM run_totals",
    "expanding": """
SELECT a.run_id, a.t, CAST(a.total_payroll AS DOUBLE) AS actual,
  GREATEST(COALESCE(REGR_INTERCEPT(CAST(b.total_payroll AS DOUBLE), b.t) + REGR_SLOPE(CAST(b.total_payroll AS DOUBLE), b.t) * (a.t + 1), a.total_payroll), 0) AS prediction
FROM indexed_runs a JOIN indexed_runs b ON b.t <= a.t GROUP BY a.run_id, a.t, a.total_payroll
""",
    "forecasts": """
SELECT *, prediction * drift_multiplier AS predicted_total FROM (SELECT e.*, CASE LAG(overall_severity) OVER (ORDER BY run_id)
    WHEN 'Significant Drift' THEN CAST(1.10 AS DOUBLE) WHEN 'Moderate Drift' THEN CAST(1.05 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS drift_multiplier
  FROM expanding e LEFT JOIN drift USING (run_id)) f
""",
}

_NEEDS = {
    "dirty_once": ["pay"], "dirty": ["dirty_once"], "complete": ["dirty"], "fills": ["complete"],
    "filled": ["complete", "fills"], "clean": ["filled"], "fe": ["pay"], "long": ["fe"], "medians": ["long"],
    "mads": ["medians"], "z": ["mads"], "zs": ["z"], "rules": ["fe"], "judged": ["rules"], "zmean": ["zs"],
    "zcomp": ["zmean"], "modelled": ["fe"], "scored": ["judged", "zcomp", "modelled"], "overtime": ["fe"],
    "states": ["overtime"], "lagged": ["states"], "assessed": ["lagged"], "pairs": ["pay"], "swung": ["fe"],
    "edges": ["swung"], "placed": ["pairs", "edges"], "shares": ["placed"], "psi": ["shares"], "drift": ["psi"],
    "run_totals": ["pay"], "indexed_runs": ["run_totals"], "expanding": ["indexed_runs"],
    "forecasts": ["expanding", "drift"],
}


def using(*names: str) -> str:
    """A WITH clause that defines the named parts and all they need, in order."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for needed in _NEEDS.get(name, []):
            add(needed)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({_PARTS[n].strip()})" for n in _PARTS if n in wanted) + " "
