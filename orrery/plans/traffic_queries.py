"""Queries over traffic, logs and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cookies as K
from ..operators import traffic as T
from ..sources.scratch import shared_dir
from ..streaming import folds as S
from . import views as V
from .registry import query

TRAFFIC = V.ctes("traffic")
EVENTS = V.ctes("run_events")
METHOD = "COALESCE(UPPER(method), 'GET')"


@query("b4_logs_of_types", TRAFFIC + "SELECT seq, log_type FROM traffic WHERE log_type IN ('warn', 'error')")
def b4(spark, sf):
    return T.logs_of_types(V.traffic(spark, sf), ["warn", "error"]).select("seq", "log_type")


@query("b5_requests_of_methods", TRAFFIC + f"SELECT seq, {METHOD} AS method FROM traffic WHERE {METHOD} IN ('GET', 'PUT')")
def b5(spark, sf):
    return T.requests_of_methods(V.traffic(spark, sf), ["GET", "PUT"]).select("seq", T.method_of(F.col("method")).alias("method"))


@query("d6_log_counts", TRAFFIC + "SELECT log_type, COUNT(*) AS n FROM traffic GROUP BY 1")
def d6(spark, sf):
    return T.log_counts(V.traffic(spark, sf))


@query("d7_method_counts", TRAFFIC + f"SELECT {METHOD} AS method, COUNT(*) AS n FROM traffic GROUP BY 1")
def d7(spark, sf):
    return T.method_counts(V.traffic(spark, sf))


@query("f3_network_list", TRAFFIC + f"SELECT seq, item_uid, {METHOD} AS method, duration FROM traffic ORDER BY ts, seq")
def f3(spark, sf):
    return T.oldest_first(V.traffic(spark, sf)).select("seq", "item_uid", T.method_of(F.col("method")).alias("method"), "duration")


@query("e5_newest_logs", TRAFFIC + "SELECT seq, log_type FROM traffic ORDER BY ts DESC, seq DESC LIMIT 1000")
def e5(spark, sf):
    return T.newest_rows(V.traffic(spark, sf), 1000).select("seq", "log_type")


@query("e5_newest_errors_per_collection", TRAFFIC + "SELECT seq, collection_uid FROM traffic WHERE log_type = 'error' QUALIFY ROW_NUMBER() OVER (PARTITION BY collection_uid ORDER BY ts DESC, seq DESC) <= 500")
def e5b(spark, sf):
    return T.newest_per(V.traffic(spark, sf).where("log_type = 'error'"), "collection_uid", 500).select("seq", "collection_uid")


@query("c9_without_stale_events", EVENTS + """, latest AS (SELECT item_uid, ARG_MAX(request_uid, seq) AS request_uid FROM run_events GROUP BY item_uid)
SELECT e.seq, e.item_uid, e.request_uid FROM run_events e JOIN latest USING (item_uid, request_uid)""")
def c9(spark, sf):
    return T.without_stale(V.run_events(spark, sf)).select("seq", "item_uid", "request_uid")


ATTACHED = EVENTS + """, attached AS (
  SELECT *, LAST_VALUE(CASE WHEN event_type = 'request-queued' THEN seq END IGNORE NULLS) OVER (PARTITION BY run_id, item_uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS occurrence FROM run_events)
"""


@query("c10_as_of_queued", ATTACHED + "SELECT seq, run_id, item_uid, occurrence FROM attached WHERE occurrence IS NOT NULL")
def c10(spark, sf):
    return T.attach_to_queued(V.run_events(spark, sf)).select("seq", "run_id", "item_uid", "occurrence")


RUN_FOLD = ATTACHED + """SELECT run_id, item_uid, occurrence,
  CASE WHEN BOOL_OR(event_type = 'error') THEN 'error' WHEN BOOL_OR(event_type = 'response-received') THEN 'completed' WHEN BOOL_OR(event_type = 'request-sent') THEN 'running' ELSE 'queued' END AS status,
  ARG_MAX(value, seq) FILTER (event_type = 'response-received') AS response_value, ARG_MAX(payload, seq) FILTER (event_type = 'assertion-results') AS assertions,
  COUNT(*) AS n_events, COUNT(*) FILTER (event_type = 'error') AS n_errors FROM attached WHERE occurrence IS NOT NULL GROUP BY 1, 2, 3"""


@query("t1_run_fold", RUN_FOLD)
def t1(spark, sf):
    return T.fold_run(T.attach_to_queued(V.run_events(spark, sf)))


REQUEST_FOLD = EVENTS + """, latest AS (SELECT item_uid, ARG_MAX(request_uid, seq) AS request_uid FROM run_events GROUP BY item_uid)
SELECT item_uid, request_uid, CASE WHEN BOOL_OR(event_type = 'error') THEN 'error' WHEN BOOL_OR(event_type = 'response-received') THEN 'received' WHEN BOOL_OR(event_type = 'request-sent') THEN 'sending' WHEN BOOL_OR(event_type = 'request-queued') THEN 'queued' END AS state,
  MIN(ts) FILTER (event_type = 'request-sent') AS sent_at, COUNT(*) AS n_events FROM run_events JOIN latest USING (item_uid, request_uid) GROUP BY 1, 2"""


@query("t2_request_fold", REQUEST_FOLD)
def t2(spark, sf):
    return T.fold_requests(V.run_events(spark, sf))


def calls(spark, sf):
    """Calls and socket sessions: one for each user and day."""
    e = V.table(spark, sf, "events")
    return e, F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("call_uid")


CALLS = """WITH calls AS (
  SELECT event_id AS seq, ts, user_id || '-' || CAST(ts AS DATE) AS call_uid, {kinds} AS event_type, {code} AS code FROM events)
"""
CALL_KINDS = {"signup": "request", "view": "message", "click": "status", "purchase": "cancel", "error": "error"}
SOCKET_KINDS = {"signup": "connecting", "view": "message", "click": "open", "purchase": "close", "error": "error"}


def kinds_sql(kinds):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + " END"


def call_rows(spark, sf, kinds, code):
    e, uid = calls(spark, sf)
    return e.select(F.col("event_id").alias("seq"), "ts", uid, F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")).alias("event_type"), code.alias("code"))


@query("t3_call_fold", CALLS.format(kinds=kinds_sql(CALL_KINDS), code="CASE WHEN event_type = 'click' THEN event_id % 3 END") + """, coded AS (
  SELECT *, CASE event_type WHEN 'status' THEN code WHEN 'error' THEN COALESCE(code, 2) WHEN 'cancel' THEN 1 END AS c FROM calls)
SELECT call_uid, COUNT(*) FILTER (event_type = 'message') AS n_messages, ARG_MAX(c, seq) FILTER (c IS NOT NULL) AS code, COALESCE(ARG_MAX(c, seq) FILTER (c IS NOT NULL) <> 0, FALSE) AS is_error,
  ROUND((EPOCH_US(MAX(ts)) - EPOCH_US(MIN(ts) FILTER (event_type = 'request'))) / 1000000.0, 3)::DOUBLE AS duration_s FROM coded GROUP BY call_uid""")
def t3(spark, sf):
    return T.fold_calls(call_rows(spark, sf, CALL_KINDS, F.when(F.col("event_type") == "click", F.col("event_id") % 3)))


DETAILED = """WITH calls AS (
  SELECT event_id AS seq, user_id || '-' || CAST(ts AS DATE) AS call_uid, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN '{extra}' ELSE {kinds} END AS event_type, {code} AS code,
    CASE WHEN event_id % 2 = 0 AND (event_type <> 'view' OR {shown}) THEN props END AS details, CASE WHEN event_id % 3 <> 0 THEN 'm' || event_id END AS metadata FROM events)
"""


def detailed_rows(spark, sf, kinds, extra, code, shown):
    e, uid = calls(spark, sf)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    n, is_view = F.col("event_id"), F.col("event_type") == "view"
    details = F.when((n % 2 == 0) & (~is_view | shown), F.col("props"))
    return e.select(n.alias("seq"), uid, F.when(is_view & (n % 5 == 0), extra).otherwise(kind).alias("event_type"), code.cast("int").alias("code"), details.alias("details"), F.when(n % 3 != 0, F.concat(F.lit("m"), n.cast("string"))).alias("metadata"))


CALL_NAMES = "CASE known " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.CALL_CODES.items()) + " ELSE 'UNKNOWN' END"


@query("t3_call_details", DETAILED.format(extra="metadata", kinds=kinds_sql(CALL_KINDS), code="CASE WHEN event_type = 'click' OR (event_type = 'view' AND event_id % 77 = 0) THEN event_id % 18 WHEN event_type = 'error' AND event_id % 4 = 0 THEN event_id % 6 END", shown="FALSE") + f""", bads AS (
  SELECT *, event_type = 'error' OR (event_type = 'message' AND code IS NOT NULL) AS bad FROM calls),
told AS (SELECT *, CASE WHEN bad THEN COALESCE(NULLIF(code, 0), 2) WHEN event_type = 'status' THEN code WHEN event_type = 'cancel' THEN 1 END AS known, bad OR (event_type = 'status' AND code <> 0) AS fault FROM bads),
named AS (SELECT *, {CALL_NAMES} AS name FROM told)
SELECT call_uid, ARG_MAX(known, seq) FILTER (known IS NOT NULL)::INT AS code, ARG_MAX(name, seq) FILTER (known IS NOT NULL) AS status_text,
  NULLIF(ARG_MAX(CASE WHEN event_type = 'cancel' THEN 'Stream cancelled by client or server' ELSE COALESCE(details, '') END, seq) FILTER (event_type IN ('status', 'error', 'cancel')), '') AS description,
  COALESCE(BOOL_OR(fault), FALSE) AS failed,
  ARG_MAX(COALESCE(details, CASE event_type WHEN 'error' THEN 'Unknown gRPC error' WHEN 'message' THEN 'gRPC error occurred' ELSE 'gRPC error with code ' || code || ' (' || name || ')' END), seq) FILTER (fault) AS error,
  NULLIF(ARG_MAX(COALESCE(metadata, ''), seq) FILTER (event_type = 'metadata'), '') AS metadata, ARG_MAX(metadata, seq) FILTER (event_type IN ('status', 'error') AND metadata IS NOT NULL) AS trailers
FROM named GROUP BY call_uid""")
def t3c(spark, sf):
    n, kind = F.col("event_id"), F.col("event_type")
    code = F.when((kind == "click") | ((kind == "view") & (n % 77 == 0)), n % 18).when((kind == "error") & (n % 4 == 0), n % 6)
    return T.call_details(detailed_rows(spark, sf, CALL_KINDS, "metadata", code, F.lit(False)))


@query("t3_call_messages", CALLS.format(kinds=kinds_sql(CALL_KINDS), code="NULL") + "SELECT call_uid, seq, ROW_NUMBER() OVER (PARTITION BY call_uid ORDER BY seq)::INT AS message_no FROM calls WHERE event_type = 'message'")
def t3b(spark, sf):
    return T.numbered_messages(call_rows(spark, sf, CALL_KINDS, F.lit(None).cast("int"))).select("call_uid", "seq", "message_no")


@query("t4_socket_fold", CALLS.format(kinds=kinds_sql(SOCKET_KINDS), code="CASE WHEN event_type = 'purchase' THEN 1000 + event_id % 2 END") + """
SELECT call_uid, ARG_MAX(event_type, seq) FILTER (event_type <> 'message') AS state, COUNT(*) FILTER (event_type = 'message') AS n_messages, ARG_MAX(code, seq) FILTER (event_type = 'close') AS close_code,
  CASE WHEN ARG_MAX(code, seq) FILTER (event_type = 'close') = 1000 THEN 'error' WHEN COUNT(*) FILTER (event_type = 'close') > 0 THEN 'info' END AS close_row FROM calls GROUP BY call_uid""")
def t4(spark, sf):
    return T.fold_sockets(call_rows(spark, sf, SOCKET_KINDS, F.when(F.col("event_type") == "purchase", 1000 + F.col("event_id") % 2)))


SOCKETS = DETAILED.format(extra="redirect", kinds=kinds_sql(SOCKET_KINDS).replace("'click' THEN 'open'", "'click' THEN CASE WHEN event_id % 4 = 1 THEN 'upgrade' ELSE 'open' END"), code="CASE WHEN event_type = 'purchase' THEN 1000 + event_id % 20 END", shown="TRUE")
CLOSE_NAMES = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in T.CLOSE_CODES.items()) + " ELSE 'CLOSED' END"


def socket_events(spark, sf):
    n, kind = F.col("event_id"), F.col("event_type")
    rows = detailed_rows(spark, sf, SOCKET_KINDS, "redirect", F.when(kind == "purchase", 1000 + n % 20), F.lit(True))
    upgrade = (F.col("event_type") == "open") & (F.col("seq") % 4 == 1)
    return rows.withColumns({"event_type": F.when(upgrade, "upgrade").otherwise(F.col("event_type")), "kind": F.when(F.col("seq") % 3 == 0, "incoming").otherwise("outgoing")})


@query("t4_socket_details", SOCKETS + f"""
SELECT call_uid, CASE ARG_MAX(event_type, seq) FILTER (moves) WHEN 'connecting' THEN 'CONNECTING' WHEN 'open' THEN 'CONNECTED' WHEN 'close' THEN 'CLOSED' WHEN 'error' THEN 'ERROR' END AS status,
  ARG_MAX(CASE event_type WHEN 'connecting' THEN 'CONNECTING' WHEN 'open' THEN 'CONNECTED' WHEN 'error' THEN 'ERROR' ELSE {CLOSE_NAMES} END, seq) FILTER (moves) AS status_text,
  ARG_MAX(CASE event_type WHEN 'open' THEN 0 WHEN 'close' THEN code ELSE 1011 END, seq) FILTER (moves AND event_type <> 'connecting')::INT AS status_code,
  ARG_MAX(COALESCE(details, ''), seq) FILTER (event_type = 'close') AS description, ARG_MAX(event_type, seq) = 'error' AS failed,
  CASE WHEN ARG_MAX(event_type, seq) = 'error' THEN ARG_MAX(COALESCE(details, 'WebSocket error occurred'), seq) FILTER (event_type = 'error') END AS error,
  NULLIF(ARG_MAX(COALESCE(metadata, ''), seq) FILTER (event_type = 'redirect'), '') AS request_headers, NULLIF(ARG_MAX(COALESCE(metadata, ''), seq) FILTER (event_type = 'upgrade'), '') AS headers
FROM (SELECT *, event_type IN ('connecting', 'open', 'close', 'error') AS moves FROM calls) GROUP BY call_uid""")
def t4b(spark, sf):
    return T.socket_details(socket_events(spark, sf))


@query("t4_socket_rows", SOCKETS + """
SELECT call_uid, seq, CASE WHEN event_type IN ('message', 'redirect') THEN CASE WHEN seq % 3 = 0 THEN 'incoming' ELSE 'outgoing' END WHEN event_type = 'open' THEN 'info' WHEN event_type = 'close' THEN CASE WHEN code = 1000 THEN 'error' ELSE 'info' END ELSE 'error' END AS kind,
  CASE event_type WHEN 'open' THEN 'Connected to ' || COALESCE(details, '') WHEN 'close' THEN CASE WHEN details IS NULL THEN 'Closed' ELSE 'Closed: ' || TRIM(details) END WHEN 'error' THEN COALESCE(details, 'WebSocket error occurred') ELSE details END AS message
FROM calls WHERE event_type NOT IN ('connecting', 'upgrade')""")
def t4c(spark, sf):
    return T.socket_rows(socket_events(spark, sf))


@query("t5_chunk_totals", "SELECT user_id AS item_uid, SUM(strlen(props))::BIGINT AS n_bytes, COUNT(*) AS n_chunks FROM events GROUP BY 1")
def t5(spark, sf):
    return T.chunk_totals(V.traffic(spark, sf).withColumnRenamed("body", "data"))


@query("t5_chunk_running_sizes", "SELECT event_id AS seq, SUM(strlen(props)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS running_bytes FROM events")
def t5b(spark, sf):
    return T.chunk_sizes(V.traffic(spark, sf).withColumnRenamed("body", "data")).select("seq", "running_bytes")


@query("g2_timelines_with_collections", TRAFFIC + "SELECT seq, n_name AS collection FROM traffic JOIN nation ON n_nationkey = collection_uid")
def g2(spark, sf):
    names = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("collection_uid"), F.col("n_name").alias("collection"))
    return T.with_collection_names(V.traffic(spark, sf), names).select("seq", "collection")


@query("c12_item_timeline", TRAFFIC + """, sources AS (SELECT DISTINCT item_uid, collection_uid, CASE WHEN item_uid >= 3 THEN item_uid // 2 END AS folder_uid FROM traffic),
creds AS (SELECT seq, ts, collection_uid, CASE WHEN seq % 3 <> 0 THEN item_uid // 2 END AS folder_uid FROM traffic WHERE log_type = 'debug')
SELECT item_uid, seq, ts, 'request' AS kind FROM traffic
UNION SELECT s.item_uid, c.seq, c.ts, 'oauth2' FROM sources s JOIN creds c ON c.collection_uid = s.collection_uid AND c.folder_uid IS NOT DISTINCT FROM s.folder_uid""")
def c12(spark, sf):
    t = V.traffic(spark, sf)
    sources = t.select("item_uid", "collection_uid", F.when(F.col("item_uid") >= 3, F.floor(F.col("item_uid") / 2)).alias("folder_uid")).distinct()
    creds = t.where("log_type = 'debug'").select("seq", "ts", "collection_uid", F.when(F.col("seq") % 3 != 0, F.floor(F.col("item_uid") / 2)).alias("folder_uid"))
    return T.item_timeline(t, creds, sources)


@query("d15_process_metrics", """SELECT DATE_TRUNC('hour', ts) AS sample_ts, ROUND(SUM(value), 4) AS cpu, ROUND(SUM(value * 2) * 1024, 2) AS memory,
  EPOCH(DATE_TRUNC('hour', ts))::BIGINT - EPOCH(DATE_TRUNC('second', MIN(ts)))::BIGINT AS uptime_s FROM events GROUP BY 1""")
def d15(spark, sf):
    e = V.table(spark, sf, "events")
    return T.process_metrics(e.select(F.date_trunc("hour", "ts").alias("sample_ts"), F.col("value").alias("cpu"), (F.col("value") * 2).alias("memory_kb"), F.col("ts").alias("creation")))


COOKIES = V.ctes("live_cookies")
NOW = "2024-01-20 00:00:00"


@query("e11_cookie_upsert", COOKIES + "SELECT domain, path, key, value, seq FROM live")
def e11(spark, sf):
    return K.latest(V.cookies(spark, sf)).select("domain", "path", "key", "value", "seq")


@query("e11_cookie_modify", COOKIES + """, first AS (SELECT domain, path, key, MIN(creation) AS creation FROM cookies WHERE domain IS NOT NULL GROUP BY ALL)
SELECT domain, path, key, value, first.creation FROM live JOIN first USING (domain, path, key)""")
def e11b(spark, sf):
    return K.modified(V.cookies(spark, sf)).select("domain", "path", "key", "value", "creation")


@query("d12_cookies_by_domain", COOKIES + f"SELECT domain, COUNT(*) AS n, STRING_AGG(key || '=' || value, '; ' ORDER BY path, key) AS cookies FROM live WHERE expires IS NULL OR expires > TIMESTAMP '{NOW}' GROUP BY domain")
def d12(spark, sf):
    return K.by_domain(K.latest(V.cookies(spark, sf)), NOW)




def request_urls(spark, sf):
    e = V.table(spark, sf, "events")
    host = F.concat(F.when(F.col("event_id") % 2 == 0, "www.").otherwise(""), F.lit("d"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com"))
    path = F.element_at(F.array(F.lit("/"), F.lit("/a"), F.lit("/a/b/c"), F.lit("/ab")), (F.col("event_id") % 4 + 1).cast("int"))
    scheme = F.when(F.col("event_id") % 3 == 0, "http://").otherwise("https://")
    return e.select(F.col("event_id").alias("url_id"), F.concat(scheme, host, path).alias("url"))


MATCHED = COOKIES + f""", urls AS (
  SELECT event_id AS url_id, event_id % 3 = 0 AS plain, CASE WHEN event_id % 2 = 0 THEN 'www.' ELSE '' END || 'd' || (user_id % 50) || '.example.com' AS host,
    CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/a' WHEN 2 THEN '/a/b/c' ELSE '/ab' END AS p FROM events),
matched AS (
  SELECT url_id, c.* FROM urls u JOIN live c ON (u.host = c.domain OR (NOT c.host_only AND ends_with(u.host, '.' || c.domain)))
    AND (c.path = '/' OR u.p = c.path OR starts_with(u.p, c.path || '/')) AND (NOT c.secure OR NOT u.plain) AND (c.expires IS NULL OR c.expires > TIMESTAMP '{NOW}'))
"""


@query("c7_cookies_for_urls", MATCHED + "SELECT url_id, STRING_AGG(key || '=' || value, '; ' ORDER BY LENGTH(path) DESC, domain, key) AS cookie_string FROM matched GROUP BY url_id")
def c7(spark, sf):
    return K.cookie_strings(K.for_urls(request_urls(spark, sf), K.latest(V.cookies(spark, sf)), NOW))


@query("c8_delete_cookies", COOKIES + ", gone AS (SELECT DISTINCT domain, path, key FROM cookies WHERE seq % 5 = 0 AND domain IS NOT NULL) SELECT domain, path, key FROM live WHERE (domain, path, key) NOT IN (SELECT domain, path, key FROM gone) AND domain <> 'd7.example.com'")
def c8(spark, sf):
    all_ = V.cookies(spark, sf)
    kept = K.without(K.latest(all_), all_.where("seq % 5 = 0").select("domain", "path", "key"))
    return K.without_domain(kept, "d7.example.com").select("domain", "path", "key")


@query("c8_delete_by_url_and_name", MATCHED + """, gone AS (
  SELECT domain, path, key FROM matched JOIN urls USING (url_id) WHERE key = 'k' || (url_id % 11)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY url_id ORDER BY path = p DESC, LENGTH(path) DESC, LENGTH(domain) DESC) = 1)
SELECT domain, path, key FROM live ANTI JOIN gone USING (domain, path, key)""")
def c8b(spark, sf):
    urls = request_urls(spark, sf).withColumn("key", F.concat(F.lit("k"), (F.col("url_id") % 11).cast("string")))
    return K.without_named(K.latest(V.cookies(spark, sf)), urls, NOW).select("domain", "path", "key")


@query("e10_latest_credentials", "SELECT user_id % 7 AS collection_uid, 'https://id' || (user_id % 4) || '.example.com' AS url, 'cred' || (event_id % 3) AS credentials_id, ARG_MAX(props, event_id) AS credentials FROM events GROUP BY 1, 2, 3")
def e10(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("user_id") % 7).alias("collection_uid"), F.concat(F.lit("https://id"), (F.col("user_id") % 4).cast("string"), F.lit(".example.com")).alias("url"), F.concat(F.lit("cred"), (F.col("event_id") % 3).cast("string")).alias("credentials_id"), F.col("props").alias("credentials"), F.col("event_id").alias("seq"))
    return K.latest_credentials(e).select("collection_uid", "url", "credentials_id", "credentials")


def streamed(spark, rows, key):
    """A stream run to the end of its source, in a place of its own."""
    return S.run_to_end(rows, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", key)


@query("t1_stream_run_fold", RUN_FOLD)
def t1s(spark, sf):
    return streamed(spark, S.run_fold(V.run_events(spark, sf, V.event_stream(spark, sf))), ["run_id", "item_uid", "occurrence"])


@query("t2_stream_request_fold", REQUEST_FOLD)
def t2s(spark, sf):
    return streamed(spark, S.request_fold(V.run_events(spark, sf, V.event_stream(spark, sf))), ["item_uid"])


@query("t5_stream_chunk_totals", "SELECT user_id AS item_uid, SUM(strlen(props))::BIGINT AS n_bytes, COUNT(*) AS n_chunks FROM events GROUP BY 1")
def t5s(spark, sf):
    return streamed(spark, S.chunk_totals(V.traffic(spark, sf, V.event_stream(spark, sf)).withColumnRenamed("body", "data")), ["item_uid"])


@query("t6_live_counts", TRAFFIC + f"SELECT 'method' AS kind, {METHOD} AS name, COUNT(*) AS n FROM traffic GROUP BY 2 UNION ALL SELECT 'log', log_type, COUNT(*) FROM traffic GROUP BY 2")
def t6(spark, sf):
    return streamed(spark, S.live_counts(V.traffic(spark, sf, V.event_stream(spark, sf))), ["kind", "name"])
