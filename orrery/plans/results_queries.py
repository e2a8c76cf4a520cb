"""Queries over run results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import results as R
from ..sources.scratch import shared_dir
from . import views as V
from .registry import query

BASE = V.ctes("checks", "requests", "verdicts")
COUNTS = """COUNT(*) AS total_requests,
  COUNT(*) FILTER (v = 'passed') AS passed_requests, COUNT(*) FILTER (v = 'failed') AS failed_requests, COUNT(*) FILTER (v = 'error') AS error_requests, COUNT(*) FILTER (v = 'skipped') AS skipped_requests,
  SUM(a)::BIGINT AS total_assertions, SUM(IF(live, ap, 0))::BIGINT AS passed_assertions, SUM(IF(live, a - ap, 0))::BIGINT AS failed_assertions,
  SUM(t)::BIGINT AS total_tests, SUM(IF(live, tp, 0))::BIGINT AS passed_tests, SUM(IF(live, t - tp, 0))::BIGINT AS failed_tests,
  SUM(p)::BIGINT AS total_pre_tests, SUM(IF(live, pp, 0))::BIGINT AS passed_pre_tests, SUM(IF(live, p - pp, 0))::BIGINT AS failed_pre_tests,
  SUM(q)::BIGINT AS total_post_tests, SUM(IF(live, qp, 0))::BIGINT AS passed_post_tests, SUM(IF(live, q - qp, 0))::BIGINT AS failed_post_tests"""
JUDGED = BASE + """,
judged AS (
  SELECT *, COALESCE(status, '') <> 'skipped' AS live,
    CASE WHEN status = 'skipped' THEN 'skipped' WHEN any_failed THEN 'failed' WHEN status = 'error' THEN 'error' ELSE 'passed' END AS v
  FROM verdicts)
"""


@query("d1_run_summary", JUDGED + f"SELECT run_id, {COUNTS} FROM judged GROUP BY run_id")
def d1(spark, sf):
    return R.run_summary(V.counted_results(spark, sf), "run_id")


@query("a7_report_round_trip", JUDGED + f"SELECT run_id, {COUNTS}, COUNT(*) AS n_rows, STRING_AGG(seq, ',' ORDER BY seq) AS seqs, 1 AS summaries FROM judged GROUP BY run_id")
def a7(spark, sf):
    """Reports of all runs, written and read back: summaries, rows by the manifest, and the results themselves."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    results = V.run_results(spark, sf)
    R.write_report(results, path, compression="gzip")
    rows = R.read_report(spark, path, "results", results.schema)
    listed = spark.read.parquet(f"{path}/manifest").groupBy("run_id").agg(F.sum(F.when(F.col("part") == "results", F.col("rows"))).alias("n_rows"), F.sum(F.when(F.col("part") == "summary", F.col("rows"))).cast("int").alias("summaries"))
    seqs = rows.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("seqs"))
    return R.read_report(spark, path, "summary", R.run_summary(results, "run_id").schema).join(listed, "run_id").join(seqs, "run_id")


@query("d2_summary_rollup", JUDGED + f"SELECT run_id, iteration_index::INT AS iteration_index, GROUPING(run_id, iteration_index)::BIGINT AS level, {COUNTS} FROM judged GROUP BY ROLLUP (run_id, iteration_index)")
def d2(spark, sf):
    return R.summary_rollup(V.counted_results(spark, sf))


@query("d3_check_totals", BASE + """
SELECT run_id, COUNT(c.status) AS total, COUNT(*) FILTER (c.status = 'pass') AS passed, COUNT(*) FILTER (c.status = 'fail') AS failed, 0::BIGINT AS skipped
FROM requests r LEFT JOIN checks c ON c.seq = r.seq AND grp = 'assertions' GROUP BY run_id""")
def d3(spark, sf):
    return R.check_totals(V.run_results(spark, sf), "assertions")


@query("d4_report_metrics", BASE + """,
tests AS (SELECT seq, COUNT(*) FILTER (grp <> 'assertions') AS n FROM checks GROUP BY seq)
SELECT run_id, CASE WHEN ROUND(SUM(run_duration), 3) = 0 THEN '-' ELSE printf('%.3f', ROUND(SUM(run_duration), 3)) END AS total_duration,
  SUM(CASE WHEN no_body THEN 2 ELSE LENGTH('{"total":' || CAST(o_totalprice AS VARCHAR) || '}') END)::BIGINT AS bytes_received,
  COALESCE(CAST(FLOOR(AVG(CASE WHEN response_time > 0 THEN response_time END) + 0.5)::BIGINT AS VARCHAR), '-') AS mean_response_time, SUM(COALESCE(n, 0))::BIGINT AS all_tests
FROM requests LEFT JOIN tests USING (seq) GROUP BY run_id""")
def d4(spark, sf):
    return R.report_metrics(V.run_results(spark, sf))


@query("d5_run_gate", JUDGED + """SELECT run_id, COUNT(*) AS total_requests, COUNT(*) FILTER (v = 'passed') AS passed_requests, COUNT(*) FILTER (v = 'failed') AS failed_requests,
  COUNT(*) FILTER (v = 'error') AS error_requests, COUNT(*) FILTER (v = 'skipped') AS skipped_requests, ROUND(SUM(response_time), 2) AS total_response_time,
  NOT BOOL_OR(v IN ('failed', 'error')) AS gate_open FROM judged GROUP BY run_id""")
def d5(spark, sf):
    return R.run_gate(V.counted_results(spark, sf))


OUTCOME = BASE + """,
outcome AS (
  SELECT *, COALESCE(status NOT IN ('error', 'skipped'), TRUE) AND NOT has_fail AS is_passed, COALESCE(status, '') <> 'skipped' AND (COALESCE(status, '') = 'error' OR has_fail) AS is_failed, COALESCE(status, '') = 'skipped' AS is_skipped
  FROM verdicts)
"""


@query("b6_outcomes", OUTCOME + "SELECT run_id, seq, is_passed, is_failed, is_skipped FROM outcome")
def b6(spark, sf):
    return R.outcome_row(V.counted_results(spark, sf)).select("run_id", "seq", "is_passed", "is_failed", "is_skipped")


@query("d10_outcome_counts", OUTCOME + "SELECT run_id, COUNT(*) AS n_all, COUNT(*) FILTER (is_passed) AS n_passed, COUNT(*) FILTER (is_failed) AS n_failed, COUNT(*) FILTER (is_skipped) AS n_skipped FROM outcome GROUP BY run_id")
def d10(spark, sf):
    return R.outcome_counts(V.counted_results(spark, sf))


@query("b7_only_failed", BASE + "SELECT run_id, seq, name FROM verdicts WHERE status = 'error' OR has_fail")
def b7(spark, sf):
    return R.only_failed(V.run_results(spark, sf)).select("run_id", "seq", "name")


@query("e4_bail_cut", BASE + """,
marked AS (SELECT *, MAX((COALESCE(status, '') = 'error' OR has_fail)::INT) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM verdicts)
SELECT run_id, seq FROM marked WHERE COALESCE(before, 0) = 0""")
def e4(spark, sf):
    return R.bail_cut(V.counted_results(spark, sf)).select("run_id", "seq")


@query("g1_results_and_skipped_files", BASE + """SELECT run_id, seq, name, status, status IS NOT DISTINCT FROM 'skipped' AS skipped FROM requests
UNION ALL SELECT NULL, NULL, 'bad/' || p_partkey || '.json', 'skipped', TRUE FROM part WHERE p_partkey % 20 = 0""")
def g1(spark, sf):
    bad = V.table(spark, sf, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("bad/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), F.lit("unreadable").alias("error"))
    return R.with_skipped_files(V.requests(spark, sf), bad).select("run_id", "seq", "name", "status", "skipped")


@query("a8_report_suites", BASE + """,
n AS (SELECT seq, COUNT(*) AS n, COUNT(*) FILTER (status = 'fail') AS f FROM checks GROUP BY seq)
SELECT run_id, seq, name AS suite, (CASE WHEN status = 'error' THEN 1 ELSE COALESCE(n, 0) END)::INT AS tests, COALESCE(f, 0)::INT AS failures,
  (COALESCE(status, '') = 'error')::INT AS errors, (COALESCE(status, '') = 'skipped')::INT AS skips, printf('%.3f', run_duration) AS suite_time
FROM requests LEFT JOIN n USING (seq)""")
def a8_suites(spark, sf):
    return R.report_suites(V.run_results(spark, sf))


@query("a8_report_cases", BASE + """,
n AS (SELECT seq, COUNT(*) AS n FROM checks GROUP BY seq),
cases AS (
  SELECT r.run_id, c.seq, ROW_NUMBER() OVER (PARTITION BY c.seq ORDER BY CASE grp WHEN 'assertions' THEN 0 WHEN 'pre_tests' THEN 1 WHEN 'tests' THEN 2 ELSE 3 END, pos) - 1 AS case_pos,
    CASE WHEN grp = 'assertions' THEN lhs || ' ' || rhs ELSE description END AS case_name, c.status AS case_status, CASE WHEN c.status = 'fail' THEN 'expected ' || rhs END AS failure, NULL AS case_error
  FROM checks c JOIN requests r USING (seq) WHERE COALESCE(r.status, '') <> 'error'
  UNION ALL SELECT run_id, seq, 0, 'Test suite has no errors', 'fail', NULL, 'connection refused' FROM requests WHERE status = 'error')
SELECT run_id, seq, 'https://api.example.com/orders/' || seq AS classname, case_pos::INT AS case_pos, case_name, case_status, failure, case_error FROM cases""")
def a8_cases(spark, sf):
    return R.report_cases(V.run_results(spark, sf)).drop("case_time")


@query("s21_redacted", BASE + "SELECT seq, NULL::VARCHAR AS auth, 'application/json' AS mime, NULL::VARCHAR AS response_data, NULL::VARCHAR AS request_data FROM requests")
def s21(spark, sf):
    rows = V.requests(spark, sf).withColumn("request_data", F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit("}")))
    out = R.redacted(rows, headers=("AUTHORIZATION",), response_body=True, request_body=True)
    return out.select("seq", F.element_at("headers", "Authorization").alias("auth"), F.element_at("headers", "content-type").alias("mime"), "response_data", "request_data")


@query("c1_enriched_results", BASE + ", " + V.SQL["items"] + """
SELECT seq, run_id, i.name AS item_name, ARRAY_TO_STRING(LIST_SORT(i.tags), ',') AS item_tags FROM requests r JOIN items i ON i.uid = 'o' || r.seq WHERE i.type <> 'js'""".replace("r.seq", "r.seq").replace("SELECT seq", "SELECT r.seq AS seq"))
def c1(spark, sf):
    catalog = V.items(spark, sf).where("type <> 'js'")
    return R.enriched(V.requests(spark, sf).select("run_id", "seq"), catalog).select("seq", "run_id", "item_name", F.array_join("item_tags", ",").alias("item_tags"))
