"""Jobs over run results: summaries, gates, filters, reports. A row is one executed request with four lists of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import fixed
from ..plans.views import CHECK, GROUPS
from .running import most, running

# Fixed value: name of the case that stands for a broken request in reports.
ERROR_CASE = "Test suite has no errors"


def checks(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{CHECK}>"))


def all_checks() -> Column:
    """Checks in report order: assertions, before the request, tests, after the response."""
    return F.concat(*[checks(g) for g in ("assertions", "pre_tests", "tests", "post_tests")])


def counted(name: str) -> Column:
    """Checks that count in totals: script errors don't, except among assertions."""
    return checks(name) if name == "assertions" else F.filter(checks(name), lambda c: ~F.coalesce(c["is_script_error"], F.lit(False)))


def passed_in(name: str) -> Column:
    return F.size(F.filter(counted(name), lambda c: c["status"] == "pass"))


def has_failed() -> Column:
    """A check that isn't passed, or a script error outside the assertions."""
    tests = F.concat(*[checks(g) for g in GROUPS if g != "assertions"])
    return F.exists(checks("assertions"), lambda c: ~c["status"].eqNullSafe("pass")) | F.exists(tests, lambda c: ~c["status"].eqNullSafe("pass") | F.coalesce(c["is_script_error"], F.lit(False)))


def check_counts(rows: DataFrame) -> DataFrame:
    """Numbers of checks of each request from check rows (seq, grp, status, is_script_error): hash aggregation, combined before the
    shuffle, for jobs that need no lists."""
    passed, script = F.col("status").eqNullSafe("pass"), F.coalesce("is_script_error", F.lit(False)) & (F.col("grp") != "assertions")
    in_group = {g: (F.col("grp") == g) & ~script for g in GROUPS}
    return rows.groupBy("seq").agg(
        *[F.count_if(test).alias(f"n_{g}") for g, test in in_group.items()],
        *[F.count_if(test & passed).alias(f"good_{g}") for g, test in in_group.items()],
        F.count_if(~passed | script).alias("n_bad"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
    )


def with_counts(results: DataFrame) -> DataFrame:
    """Results with the columns of ``check_counts``: from their lists, or those that they have already (null: no checks)."""
    names = [f"{k}_{g}" for k in ("n", "good") for g in GROUPS] + ["n_bad", "n_fail"]
    if set(names) <= set(results.columns):
        return results.fillna(0, names)
    counts = {f"n_{g}": F.size(counted(g)) for g in GROUPS} | {f"good_{g}": passed_in(g) for g in GROUPS}
    return results.withColumns(counts | {"n_bad": has_failed().cast("int"), "n_fail": F.size(F.filter(all_checks(), lambda c: c["status"] == "fail"))})


def verdict() -> Column:
    """skipped, failed, error or passed: any failure beats the error status."""
    status = F.coalesce("status", F.lit(""))
    return F.when(status == "skipped", "skipped").when(F.col("n_bad") > 0, "failed").when(status == "error", "error").otherwise("passed")


def summary_row(results: DataFrame) -> DataFrame:
    """Per-request numbers of the summary: no list is exploded, the aggregation sees narrow rows."""
    live = ~F.col("status").eqNullSafe("skipped")
    out = with_counts(results).withColumn("verdict", verdict())
    for g in GROUPS:
        total, good = F.col(f"n_{g}"), F.col(f"good_{g}")
        out = out.withColumns({f"total_{g}": total, f"passed_{g}": F.when(live, good).otherwise(0), f"failed_{g}": F.when(live, total - good).otherwise(0)})
    return out


def summary_aggregates() -> list[Column]:
    requests = [F.count("*").alias("total_requests"), *[F.count_if(F.col("verdict") == v).alias(f"{v}_requests") for v in ("passed", "failed", "error", "skipped")]]
    return requests + [F.sum(f"{kind}_{g}").alias(f"{kind}_{g}") for g in GROUPS for kind in ("total", "passed", "failed")]


def run_summary(results: DataFrame, *keys: str) -> DataFrame:
    return summary_row(results).groupBy(*keys).agg(*summary_aggregates())


def summary_rollup(results: DataFrame) -> DataFrame:
    """Summaries by run and iteration, by run, and of everything, in one pass."""
    return summary_row(results).rollup("run_id", "iteration_index").agg(F.grouping_id().alias("level"), *summary_aggregates())


def check_totals(results: DataFrame, group: str) -> DataFrame:
    """Total, passed, failed and (anything else) skipped checks of one group by run."""
    of = lambda test: F.sum(F.size(F.filter(checks(group), test)))
    passed, failed = (lambda c: c["status"] == "pass"), (lambda c: c["status"] == "fail")
    other = lambda c: ~F.coalesce(c["status"].isin("pass", "fail"), F.lit(False))
    return results.groupBy("run_id").agg(F.sum(F.size(checks(group))).alias("total"), of(passed).alias("passed"), of(failed).alias("failed"), of(other).alias("skipped"))


def report_metrics(results: DataFrame) -> DataFrame:
    """Duration, bytes received and mean response time by run, and the merged test totals; a missing body counts 2 bytes.

    Durations are doubles, whose sum depends on their order, and a sum next to half a millisecond may then be rounded to either side. So they
    are added one by one in order of ``seq``, as a runner does; halves are rounded away from zero.
    """
    tests = F.size(F.concat(*[checks(g) for g in ("pre_tests", "tests", "post_tests")]))
    waited = F.when(F.col("response_time") > 0, F.col("response_time"))
    rows = results.select("run_id", "seq", "run_duration", waited.alias("waited"), F.coalesce(F.octet_length("response_data"), F.lit(2)).alias("n_bytes"), tests.alias("n_tests"))
    so_far = Window.partitionBy("run_id").orderBy("seq", "run_duration", "waited").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = rows.withColumns({"nth": F.count("*").over(so_far), "duration_so_far": F.sum("run_duration").over(so_far), "waited_so_far": F.sum("waited").over(so_far)})
    totals = added.groupBy("run_id").agg(
        F.max_by("duration_so_far", "nth").alias("duration"), (F.max_by("waited_so_far", "nth") / F.count("waited")).alias("mean"), F.sum("n_bytes").alias("bytes_received"), F.sum("n_tests").alias("all_tests")
    )
    # not F.round to three digits: that rounds the shortest decimal text of a sum
    seconds = F.round(F.col("duration") * 1000) / 1000
    return totals.select(
        "run_id",
        F.when(seconds == 0, "-").otherwise(fixed(seconds, 3)).alias("total_duration"),
        "bytes_received",
        F.coalesce(F.floor(F.col("mean") + 0.5).cast("string"), F.lit("-")).alias("mean_response_time"),
        "all_tests",
    )


def run_gate(results: DataFrame) -> DataFrame:
    """Whether each run may pass: no failed check, failed request or error."""
    bad = F.col("failed_requests") + F.col("error_requests") + sum((F.col(f"failed_{g}") for g in GROUPS), F.lit(0)) > 0
    rows = summary_row(results).groupBy("run_id").agg(*summary_aggregates(), F.round(F.sum("response_time"), 2).alias("total_response_time"))
    return rows.select("run_id", "total_requests", "passed_requests", "failed_requests", "error_requests", "skipped_requests", "total_response_time", (~bad).alias("gate_open"))


def outcome_row(results: DataFrame) -> DataFrame:
    """Outcome columns of the runner's list: a group passes if all its checks do, and an error, skipped or running row has no group status."""
    settled = ~F.coalesce(F.col("status").isin("error", "skipped", "running"), F.lit(False))
    group_fails = F.col("n_fail") > 0
    is_error, skipped = F.col("status").eqNullSafe("error"), F.col("status").eqNullSafe("skipped")
    return with_counts(results).withColumns({"is_passed": settled & ~group_fails, "is_failed": ~skipped & (is_error | (settled & group_fails)), "is_skipped": skipped}).select(*results.columns, "is_passed", "is_failed", "is_skipped")


def outcome_counts(results: DataFrame) -> DataFrame:
    rows = outcome_row(results)
    return rows.groupBy("run_id").agg(F.count("*").alias("n_all"), *[F.count_if(f"is_{k}").alias(f"n_{k}") for k in ("passed", "failed", "skipped")])


def only_failed(results: DataFrame) -> DataFrame:
    """Report rows with an error status or any check that isn't passed."""
    return results.where(F.col("status").eqNullSafe("error") | F.exists(all_checks(), lambda c: ~c["status"].eqNullSafe("pass")))


def bail_cut(results: DataFrame) -> DataFrame:
    """Rows of each run up to and including its first failure: an error that isn't skipped, or a failed check."""
    fails = (F.col("error").isNotNull() & ~F.col("skipped")) | (F.col("n_fail") > 0)
    rows = running(with_counts(results), ["run_id"], ["seq"], {"_failed": most(fails)}, itself=False)
    return rows.where(~F.coalesce("_failed", F.lit(False))).select(*results.columns)


def with_skipped_files(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """Executed rows and one skipped row for each unreadable file (path, error)."""
    rows = skipped.select(F.col("path").alias("name"), F.lit("skipped").alias("status"), F.col("error"), F.lit(True).alias("skipped"), F.lit(0.0).alias("run_duration"), F.lit(0.0).alias("response_time"))
    return results.unionByName(rows, allowMissingColumns=True)


def report_cases(results: DataFrame) -> DataFrame:
    """One case per check in report order; the error of a row that isn't skipped replaces its cases by a single one."""
    n = F.size(all_checks())
    seconds = lambda c: fixed(c, 3)
    name = lambda c: F.when(c["grp"] == "assertions", F.concat_ws(" ", c["lhs"], c["rhs"])).otherwise(c["description"])
    tag = lambda g: F.transform(checks(g), lambda c: c.withField("grp", F.lit(g)))
    tagged = F.concat(*[tag(g) for g in ("assertions", "pre_tests", "tests", "post_tests")])
    normal = F.transform(tagged, lambda c: F.struct(name(c).alias("case_name"), c["status"].alias("case_status"), seconds(F.col("run_duration") / n).alias("case_time"), F.when(c["status"] == "fail", c["error"]).alias("failure"), F.lit(None).cast("string").alias("case_error")))
    broken = F.array(F.struct(F.lit(ERROR_CASE).alias("case_name"), F.lit("fail").alias("case_status"), seconds(F.col("run_duration")).alias("case_time"), F.lit(None).cast("string").alias("failure"), F.col("error").alias("case_error")))
    is_error = ~F.col("skipped") & F.col("error").isNotNull()
    return results.select("run_id", "seq", F.col("url").alias("classname"), F.posexplode(F.when(is_error, broken).otherwise(normal)).alias("case_pos", "c")).select("run_id", "seq", "classname", "case_pos", "c.*")


def report_suites(results: DataFrame) -> DataFrame:
    """One suite per request: counts of tests, failures, errors and skips. An error sets tests to 1 and leaves the failures."""
    is_error = ~F.col("skipped") & F.col("error").isNotNull()
    return results.select(
        "run_id",
        "seq",
        F.col("name").alias("suite"),
        F.when(is_error, 1).otherwise(F.size(all_checks())).alias("tests"),
        F.size(F.filter(all_checks(), lambda c: c["status"] == "fail")).alias("failures"),
        is_error.cast("int").alias("errors"),
        F.col("skipped").cast("int").alias("skips"),
        fixed(F.col("run_duration"), 3).alias("suite_time"),
    )


ROWS_A_FILE = 100_000


def write_report(results: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE, compression: str = "none") -> None:
    """JSON report of many runs: summaries and results in files of at most ``rows_a_file`` rows, sorted by run, and a manifest.

    The manifest has a row (part, run_id, file, rows) for each run in each file. A run of any size is cut over files, and small ones share them.
    Summaries are made from the results as they were written, so ``results`` are computed once. ``compression`` of the files as Spark names it.
    """
    spark = results.sparkSession

    def put(part: str, rows: DataFrame, *order: str) -> None:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_a_file).option("compression", compression).json(f"{path}/{part}")

    put("results", results, "run_id", "seq")
    put("summary", run_summary(read_report(spark, path, "results", results.schema), "run_id"), "run_id")
    schema = T.StructType([results.schema["run_id"]])
    listed = [spark.read.schema(schema).json(f"{path}/{part}").groupBy(F.lit(part).alias("part"), "run_id", F.input_file_name().alias("file")).agg(F.count("*").alias("rows")) for part in ("summary", "results")]
    listed[0].unionByName(listed[1]).coalesce(1).write.parquet(f"{path}/manifest")


def read_report(spark: SparkSession, path: str, part: str, schema: T.StructType, runs: list | None = None) -> DataFrame:
    """Rows of one part of a report, of some runs if they are given: then only the files that the manifest names for them are read."""
    if runs is None:
        return spark.read.schema(schema).json(f"{path}/{part}")
    named = spark.read.parquet(f"{path}/manifest").where((F.col("part") == part) & F.col("run_id").isin(runs)).select("file").distinct()
    files = [r["file"] for r in named.toLocalIterator()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(files).where(F.col("run_id").isin(runs))


def write_xml_report(results: DataFrame, path: str) -> None:
    """XML report with one element per suite and its cases inside."""
    cases = report_cases(results).groupBy("run_id", "seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("case_pos", "case_name", "case_status", "classname", "case_time", "failure", "case_error"))), lambda c: F.struct(c["case_name"].alias("_name"), c["case_status"].alias("_status"), c["classname"].alias("_classname"), c["case_time"].alias("_time"), c["failure"].alias("failure"), c["case_error"].alias("error"))).alias("testcase"))
    suites = report_suites(results).join(cases, ["run_id", "seq"], "left")
    suites.select(F.col("suite").alias("_name"), F.col("tests").alias("_tests"), F.col("failures").alias("_failures"), F.col("errors").alias("_errors"), F.col("skips").alias("_skipped"), F.col("suite_time").alias("_time"), "testcase").write.format("xml").option("rootTag", "testsuites").option("rowTag", "testsuite").save(path)


def redacted(results: DataFrame, all_headers: bool = False, headers: tuple[str, ...] = (), response_body: bool = False, request_body: bool = False) -> DataFrame:
    """Rows without all headers, the named headers (any case), the response body or the request body (``request_data``)."""
    names = [h.lower() for h in headers]
    out = results
    if all_headers:
        out = out.withColumn("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    elif names:
        out = out.withColumn("headers", F.map_filter("headers", lambda k, v: ~F.lower(k).isin(names)))
    gone = [c for c, wanted in (("response_data", response_body), ("request_data", request_body)) if wanted and c in out.columns]
    return out.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in gone}) if gone else out


def enriched(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with their item's name and sorted tags; rows whose item is gone are dropped."""
    return results.join(catalog.select("uid", F.col("name").alias("item_name"), F.array_sort("tags").alias("item_tags")), F.concat(F.lit("o"), F.col("seq").cast("string")) == F.col("uid"))
