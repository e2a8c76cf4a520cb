"""The library's tables, derived from the driver's star schema by fixed rules.

Each view has a counterpart in ``SQL``, common table expressions for DuckDB, so that oracles start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK = "struct<status:string,description:string,lhs:string,rhs:string,operator:string,error:string,is_script_error:boolean>"
GROUPS = ["assertions", "tests", "pre_tests", "post_tests"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _failed() -> Column:
    return (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")


def _check(of: Callable[[str], Column], failed: Column) -> dict[str, Column]:
    """Group and fields of the check that a line item stands for."""
    group = F.element_at(F.array(*[F.lit(g) for g in ("post_tests", "assertions", "tests", "pre_tests")]), (of("l_linenumber") % 4 + 1).cast("int"))
    return {
        "grp": group,
        "status": F.when(failed, "fail").otherwise("pass"),
        "description": F.concat(F.lit("part "), of("l_partkey").cast("string")),
        "lhs": F.concat(F.lit("res.body.q"), of("l_suppkey").cast("string")),
        "rhs": of("l_linenumber").cast("string"),
        "operator": F.lit("eq"),
        "error": F.when(failed, F.concat(F.lit("expected "), of("l_linenumber").cast("string"))),
        "is_script_error": (of("l_quantity") == 50) & (of("l_linenumber") % 4 != 1),
    }


def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each check of a request, with its group and its place in the group."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("seq"), *[c.alias(name) for name, c in _check(F.col, _failed()).items()], F.struct(*PLACE).alias("pos"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed requests: a request per order, a run per customer, four lists of checks from line items.

    Line items are shuffled as they are, and the texts of checks are made behind the shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), *PLACE, (~_failed()).alias("passed"))
    grouped = li.repartition("seq").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct(*PLACE, "passed"))).alias("rows"))

    def of_group(g: str) -> Column:
        number = {"post_tests": 0, "assertions": 1, "tests": 2, "pre_tests": 3}[g]
        made = F.transform(F.filter("rows", lambda r: r["l_linenumber"] % 4 == number), lambda r: F.struct(*[c.alias(name) for name, c in _check(lambda f: r[f], ~r["passed"]).items() if name != "grp"]))
        return F.when(F.exists("rows", lambda r: r["l_linenumber"] % 4 == number), made)

    return requests(spark, sf_dir).join(grouped.select("seq", *[of_group(g).alias(g) for g in GROUPS]), "seq", "left")


def counted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed requests with the numbers of their checks, for jobs that need no lists."""
    from ..operators.results import check_counts

    return requests(spark, sf_dir).join(check_counts(check_rows(spark, sf_dir)), "seq", "left")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed requests without their checks."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderpriority") == "5-LOW", "skipped").when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), "error")
    return o.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") % 4).cast("int").alias("iteration_index"),
        F.concat(F.lit("request "), F.col("o_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("https://api.example.com/orders/"), F.col("o_orderkey").cast("string")).alias("url"),
        status.alias("status"),
        F.when(status == "error", "connection refused").alias("error"),
        F.coalesce(status == "skipped", F.lit(False)).alias("skipped"),
        F.col("o_totalprice").alias("response_time"),
        (F.col("o_totalprice") / 1000).alias("run_duration"),
        F.create_map(F.lit("Authorization"), F.col("o_orderpriority"), F.lit("content-type"), F.lit("application/json")).alias("headers"),
        F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit('{"total":'), F.col("o_totalprice").cast("string"), F.lit("}"))).alias("response_data"),
    )


METHODS = {"view": "GET", "purchase": "POST", "signup": "put", "click": "delete"}
LOG_TYPES = {"view": "log", "purchase": "info", "signup": "debug", "click": "warn", "error": "error"}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream of its files, with timestamps as the watermark needs them."""
    path = f"{sf_dir}/events.parquet"
    # by a pattern, since a stream takes no path of a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def traffic(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Recorded requests: one per event."""
    e = table(spark, sf_dir, "events") if events is None else events
    method = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in LOG_TYPES.items() for x in kv])
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        (F.col("user_id") % 7).alias("collection_uid"),
        F.col("user_id").alias("item_uid"),
        F.element_at(method, F.col("event_type")).alias("method"),
        F.col("props").alias("body"),
        F.col("value").alias("duration"),
        F.element_at(kind, F.col("event_type")).alias("log_type"),
    )


EVENTS = {"signup": "request-queued", "view": "request-sent", "click": "response-received", "purchase": "assertion-results", "error": "error"}


def run_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events of runs: a run per day, ten items, each queued again and again."""
    e = table(spark, sf_dir, "events") if events is None else events
    kinds = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    return e.select(F.col("event_id").alias("seq"), "ts", F.to_date("ts").cast("string").alias("run_id"), (F.col("user_id") % 10).alias("item_uid"), (F.col("user_id") / 50).cast("long").alias("request_uid"), F.element_at(kinds, F.col("event_type")).alias("event_type"), F.col("value").alias("value"), F.col("props").alias("payload"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as an adjacency list: region, nation, customer and order as collection, folder, folder and request."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    tag = lambda *cols: F.array(*cols).cast("array<string>")
    none = tag()
    row = lambda uid, parent, kind, name, seq, pos, tags, transient: [uid.alias("uid"), parent.alias("parent_uid"), F.lit(kind).alias("type"), name.alias("name"), seq.cast("double").alias("seq"), pos.cast("long").alias("pos"), tags.alias("tags"), transient.alias("is_transient")]
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    collections = r.select(*row(key("r", "r_regionkey"), F.lit(None).cast("string"), "collection", F.col("r_name"), F.lit(None), F.col("r_regionkey"), none, F.lit(False)))
    folders = n.select(*row(key("n", "n_nationkey"), key("r", "n_regionkey"), "folder", F.col("n_name"), F.lit(None), F.col("n_nationkey"), none, F.lit(False)))
    inner = c.select(*row(key("c", "c_custkey"), key("n", "c_nationkey"), "folder", F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5 + 1), F.col("c_custkey"), none, F.col("c_custkey") % 50 == 49))
    requests = o.select(*row(key("o", "o_orderkey"), key("c", "o_custkey"), "http-request", F.concat(F.lit("get "), F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 9), F.col("o_orderkey"), tag(F.col("o_orderpriority"), F.col("o_orderstatus")), F.col("o_orderkey") % 40 == 11)).withColumn("type", request_type())
    return collections.unionByName(folders).unionByName(inner).unionByName(requests)


def request_type():
    n = F.substring("uid", 2, 20).cast("long") % 10
    return F.when(n == 3, "graphql-request").when(n == 7, "js").otherwise("http-request")


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and variables on every level: (uid, pos, name, value, enabled)."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))

    def rows(df, uid, entries):
        made = F.array(*[F.struct(F.lit(i).alias("pos"), name.alias("name"), value.cast("string").alias("value"), enabled.alias("enabled")) for i, (name, value, enabled) in enumerate(entries)])
        return df.select(uid.alias("uid"), F.explode(made).alias("e")).select("uid", "e.*")

    yes = F.lit(True)
    return (
        rows(r, F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), [(F.lit("Accept"), F.col("r_name"), yes), (F.lit("X-Level"), F.lit("collection"), yes)])
        .unionByName(rows(n, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), [(F.lit("X-Level"), F.lit("folder"), yes), (F.lit("X-Nation"), F.col("n_name"), F.col("n_nationkey") % 3 != 0)]))
        .unionByName(rows(c, F.concat(F.lit("c"), F.col("c_custkey").cast("string")), [(F.lit("X-Segment"), F.col("c_mktsegment"), yes), (F.lit("x-level"), F.lit("inner"), yes)]))
        .unionByName(rows(o, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), [(F.lit("X-Total"), F.floor("o_totalprice"), yes), (F.lit("Accept"), F.col("o_orderstatus"), F.col("o_orderstatus") != "P")]))
    )


def endpoints(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Endpoints of the ``old`` or ``new`` spec, or of the ``catalog``; of parts with one id the last is the endpoint."""
    p = table(spark, sf_dir, "part")
    kept = {"old": F.col("p_partkey") % 10 != 0, "new": F.col("p_partkey") % 10 != 1, "catalog": F.col("p_partkey") % 10 != 2}[side]
    changed = {"old": F.lit(False), "new": F.col("p_partkey") % 7 == 0, "catalog": F.col("p_partkey") % 5 == 0}[side]
    method = F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST")
    path = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/"), F.col("p_size").cast("string"))
    rows = p.where(kept).select(
        F.concat(F.lit("spec"), (F.col("p_size") % 3).cast("string")).alias("spec_id"),
        F.concat(method, F.lit(":"), path).alias("endpoint_id"),
        method.alias("method"),
        path.alias("path"),
        F.col("p_partkey").alias("pos"),
        F.when(F.col("p_partkey") % 6 != 0, F.concat(F.split("p_name", " ")[0], F.lit(" & co"))).alias("tag"),
        F.when(changed, F.array(F.lit("q:query"), F.lit("page:query"))).otherwise(F.array(F.lit("q:query"), F.lit("id:path"))).alias("params"),
        F.when(changed & (F.col("p_partkey") % 2 == 0), F.array(F.lit("accept"), F.lit("x-new"))).otherwise(F.array(F.lit("accept"))).alias("headers"),
        F.when(changed & (F.col("p_partkey") % 3 == 0), "xml").otherwise("json").alias("body_mode"),
        F.concat(F.lit('{"name":"'), F.col("p_name"), F.when(changed, '","extra":[{"a":1}]}').otherwise('","size":1}')).alias("json_body"),
        F.md5(F.concat_ws("|", F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.when(changed, "changed").otherwise("same"))).alias("hash"),
    )
    last = rows.groupBy("spec_id", "endpoint_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("spec_id", "endpoint_id")]), "pos").alias("e"))
    return last.select("spec_id", "endpoint_id", "e.*")


def cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cookie writes: one per event, of fifty domains."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    host = F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com"))
    return e.select(
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).when(F.col("user_id") % 5 == 0, "example.com").otherwise(host).alias("domain"),
        F.element_at(F.array(F.lit("/"), F.lit("/a"), F.lit("/a/b")), k % 3 + 1).alias("path"),
        F.concat(F.lit("k"), (k % 11).cast("string")).alias("key"),
        F.col("value").cast("string").alias("value"),
        F.when(k % 4 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("value").cast("int"))).alias("expires"),
        (F.col("user_id") % 3 == 0).alias("secure"),
        (F.col("user_id") % 2 == 0).alias("host_only"),
        F.col("ts").alias("creation"),
        F.col("event_id").alias("seq"),
    )


SQL = {
    "checks": """checks AS (
  SELECT l_orderkey AS seq, CASE l_linenumber % 4 WHEN 1 THEN 'assertions' WHEN 2 THEN 'tests' WHEN 3 THEN 'pre_tests' ELSE 'post_tests' END AS grp,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'fail' ELSE 'pass' END AS status, 'part ' || l_partkey AS description,
    'res.body.q' || l_suppkey AS lhs, l_linenumber AS rhs, l_quantity = 50 AND l_linenumber % 4 <> 1 AS is_script_error,
    ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber % 4 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos
  FROM lineitem)""",
    "requests": """requests AS (
  SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderkey % 4 AS iteration_index, 'request ' || o_orderkey AS name,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'skipped' WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'error' END AS status,
    o_totalprice AS response_time, o_totalprice / 1000 AS run_duration, o_orderkey % 10 = 0 AS no_body, o_totalprice, o_orderpriority
  FROM orders)""",
    "verdicts": """per AS (
  SELECT seq, COUNT(*) FILTER (status <> 'pass' AND NOT is_script_error) AS bad, BOOL_OR(is_script_error) AS script,
    COUNT(*) FILTER (grp = 'assertions') AS a, COUNT(*) FILTER (grp = 'assertions' AND status = 'pass') AS ap,
    COUNT(*) FILTER (grp = 'tests' AND NOT is_script_error) AS t, COUNT(*) FILTER (grp = 'tests' AND NOT is_script_error AND status = 'pass') AS tp,
    COUNT(*) FILTER (grp = 'pre_tests' AND NOT is_script_error) AS p, COUNT(*) FILTER (grp = 'pre_tests' AND NOT is_script_error AND status = 'pass') AS pp,
    COUNT(*) FILTER (grp = 'post_tests' AND NOT is_script_error) AS q, COUNT(*) FILTER (grp = 'post_tests' AND NOT is_script_error AND status = 'pass') AS qp,
    COUNT(*) FILTER (status = 'fail') AS failed
  FROM checks GROUP BY seq),
verdicts AS (
  SELECT r.*, COALESCE(bad, 0) > 0 OR COALESCE(script, FALSE) AS any_failed, COALESCE(failed, 0) > 0 AS has_fail, COALESCE(a, 0) AS a, COALESCE(ap, 0) AS ap, COALESCE(t, 0) AS t, COALESCE(tp, 0) AS tp,
    COALESCE(p, 0) AS p, COALESCE(pp, 0) AS pp, COALESCE(q, 0) AS q, COALESCE(qp, 0) AS qp
  FROM requests r LEFT JOIN per USING (seq))""",
    "traffic": """traffic AS (
  SELECT event_id AS seq, ts, user_id % 7 AS collection_uid, user_id AS item_uid,
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'put' WHEN 'click' THEN 'delete' END AS method,
    props AS body, value AS duration, CASE event_type WHEN 'view' THEN 'log' WHEN 'purchase' THEN 'info' WHEN 'signup' THEN 'debug' WHEN 'click' THEN 'warn' ELSE 'error' END AS log_type
  FROM events)""",
    "run_events": """run_events AS (
  SELECT event_id AS seq, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, user_id % 10 AS item_uid, user_id // 50 AS request_uid,
    CASE event_type WHEN 'signup' THEN 'request-queued' WHEN 'view' THEN 'request-sent' WHEN 'click' THEN 'response-received' WHEN 'purchase' THEN 'assertion-results' ELSE 'error' END AS event_type, value, props AS payload
  FROM events)""",
    "items": """items AS (
  SELECT 'r' || r_regionkey AS uid, NULL AS parent_uid, 'collection' AS type, r_name AS name, NULL::DOUBLE AS seq, r_regionkey AS pos, []::VARCHAR[] AS tags, FALSE AS is_transient FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'folder', n_name, NULL, n_nationkey, [], FALSE FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'folder', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 + 1 END, c_custkey, [], c_custkey % 50 = 49 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE o_orderkey % 10 WHEN 3 THEN 'graphql-request' WHEN 7 THEN 'js' ELSE 'http-request' END, 'get ' || o_orderstatus,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 END, o_orderkey, [o_orderpriority, o_orderstatus], o_orderkey % 40 = 11 FROM orders)""",
    "paths": """paths AS (
  SELECT 'o' || o_orderkey AS item, 'o' || o_orderkey AS node, 3 AS level FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 2 FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 'n' || c_nationkey, 1 FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'o' || o_orderkey, 'r' || n_regionkey, 0 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""",
    "key_values": """key_values AS (
  SELECT 'r' || r_regionkey AS uid, 0 AS pos, 'Accept' AS name, r_name AS value, TRUE AS enabled FROM region
  UNION ALL SELECT 'r' || r_regionkey, 1, 'X-Level', 'collection', TRUE FROM region
  UNION ALL SELECT 'n' || n_nationkey, 0, 'X-Level', 'folder', TRUE FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 1, 'X-Nation', n_name, n_nationkey % 3 <> 0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 0, 'X-Segment', c_mktsegment, TRUE FROM customer
  UNION ALL SELECT 'c' || c_custkey, 1, 'x-level', 'inner', TRUE FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 0, 'X-Total', CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS VARCHAR), TRUE FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 1, 'Accept', o_orderstatus, o_orderstatus <> 'P' FROM orders)""",
    "endpoints": """parts AS (
  SELECT 'spec' || (p_size % 3) AS spec_id, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    '/' || LOWER(p_type) || '/' || REPLACE(LOWER(p_brand), '#', '') || '/' || p_size AS path, p_partkey AS pos, p_name, p_brand, p_type, p_size,
    CASE WHEN p_partkey % 6 <> 0 THEN SPLIT_PART(p_name, ' ', 1) || ' & co' END AS tag
  FROM part),
sided AS (
  SELECT *, method || ':' || path AS endpoint_id, side,
    CASE side WHEN 'old' THEN FALSE WHEN 'new' THEN pos % 7 = 0 ELSE pos % 5 = 0 END AS changed
  FROM parts, (VALUES ('old'), ('new'), ('catalog')) s(side)
  WHERE CASE side WHEN 'old' THEN pos % 10 <> 0 WHEN 'new' THEN pos % 10 <> 1 ELSE pos % 10 <> 2 END),
endpoints AS (
  SELECT *, MD5(p_brand || '|' || p_type || '|' || p_size || '|' || CASE WHEN changed THEN 'changed' ELSE 'same' END) AS hash
  FROM sided QUALIFY ROW_NUMBER() OVER (PARTITION BY side, spec_id, endpoint_id ORDER BY pos DESC) = 1)""",
    "cookies": """writes AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
cookies AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'example.com' ELSE 'd' || (user_id % 50) || '.example.com' END AS domain,
    CASE k % 3 WHEN 0 THEN '/' WHEN 1 THEN '/a' ELSE '/a/b' END AS path, 'k' || (k % 11) AS key, CAST(value AS VARCHAR) AS value,
    CASE WHEN k % 4 <> 0 THEN ts + to_minutes(CAST(TRUNC(value) AS INT)) END AS expires, user_id % 3 = 0 AS secure, user_id % 2 = 0 AS host_only, ts AS creation, event_id AS seq
  FROM writes)""",
}
SQL["live_cookies"] = SQL["cookies"] + """,
live AS (SELECT * FROM cookies WHERE domain IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY domain, path, key ORDER BY seq DESC) = 1)"""


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
