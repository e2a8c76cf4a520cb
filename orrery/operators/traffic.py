"""Jobs over recorded requests, console logs and run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import last, number, running, total


def method_of(method: Column) -> Column:
    """Upper-case method, GET if missing."""
    return F.coalesce(F.upper(method), F.lit("GET"))


def logs_of_types(logs: DataFrame, types: list[str]) -> DataFrame:
    return logs.where(F.col("log_type").isin(types))


def requests_of_methods(traffic: DataFrame, methods: list[str]) -> DataFrame:
    return traffic.where(method_of(F.col("method")).isin(methods))


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("log_type").agg(F.count("*").alias("n"))


def method_counts(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy(method_of(F.col("method")).alias("method")).agg(F.count("*").alias("n"))


def oldest_first(traffic: DataFrame) -> DataFrame:
    return traffic.orderBy("ts", "seq")


def newest_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows of the whole table, a top-k that never sorts more than ``limit`` rows a task."""
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def newest_per(rows: DataFrame, key: str, limit: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def current_requests(events: DataFrame) -> DataFrame:
    """The request that each item is at: that of its latest event."""
    return events.groupBy("item_uid").agg(F.max_by("request_uid", F.struct("ts", "seq")).alias("request_uid"))


def without_stale(events: DataFrame) -> DataFrame:
    """Events of each item's current request only."""
    return events.join(current_requests(events), ["item_uid", "request_uid"], "left_semi")


def attach_to_queued(events: DataFrame) -> DataFrame:
    """Each event with the ``seq`` of the latest request-queued event of its item in its run; events before any are dropped."""
    queued = F.when(F.col("event_type") == "request-queued", F.col("seq"))
    return running(events, ["run_id", "item_uid"], ["seq"], {"occurrence": last(queued)}).where(F.col("occurrence").isNotNull())


def item_timeline(traffic: DataFrame, credentials: DataFrame, sources: DataFrame) -> DataFrame:
    """Own entries of each item, and credential entries of its effective auth source (a folder, or the collection if the
    entry names no folder). ``sources``: (item_uid, collection_uid, folder_uid). Two equi-joins, no OR; the result has a row for
    each item and entry of its source, so a collection's own entries come back once for each item without a folder."""
    own = traffic.select("item_uid", "seq", "ts", F.lit("request").alias("kind"))
    in_folder = sources.join(credentials.where("folder_uid is not null"), ["collection_uid", "folder_uid"])
    in_collection = sources.where("folder_uid is null").drop("folder_uid").join(credentials.where("folder_uid is null").drop("folder_uid"), "collection_uid")
    entries = lambda df: df.select("item_uid", "seq", "ts", F.lit("oauth2").alias("kind"))
    return own.unionByName(entries(in_folder)).unionByName(entries(in_collection)).dropDuplicates(["item_uid", "seq", "kind"])


def with_collection_names(traffic: DataFrame, collections: DataFrame) -> DataFrame:
    return traffic.join(collections, "collection_uid")


def process_metrics(samples: DataFrame) -> DataFrame:
    """CPU and memory (kilobytes to bytes) over all processes of a sample, and the time since the oldest started."""
    return samples.groupBy("sample_ts").agg(F.round(F.sum("cpu"), 4).alias("cpu"), F.round(F.sum("memory_kb") * 1024, 2).alias("memory"), (F.col("sample_ts").cast("timestamp").cast("long") - F.min("creation").cast("timestamp").cast("long")).alias("uptime_s"))


def fold_run(attached: DataFrame) -> DataFrame:
    """One row for each queued occurrence of an item in a run: status, last values, number of events and errors."""
    last = lambda kind, col: F.max_by(F.when(F.col("event_type") == kind, F.col(col)), F.when(F.col("event_type") == kind, F.col("seq")))
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    return attached.groupBy("run_id", "item_uid", "occurrence").agg(
        F.when(has("error"), "error").when(has("response-received"), "completed").when(has("request-sent"), "running").otherwise("queued").alias("status"),
        last("response-received", "value").alias("response_value"),
        last("assertion-results", "payload").alias("assertions"),
        F.count("*").alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
    )


def fold_requests(events: DataFrame) -> DataFrame:
    """State of each item's current request. Queued is void once sending or received; a response may precede the sending."""
    live = without_stale(events)
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    return live.groupBy("item_uid", "request_uid").agg(F.when(has("error"), "error").when(has("response-received"), "received").when(has("request-sent"), "sending").when(has("request-queued"), "queued").alias("state"), first("request-sent").alias("sent_at"), F.count("*").alias("n_events"))


# Names of the status codes of calls and of the close codes of sockets.
CALL_CODES = {0: "OK", 1: "CANCELLED", 2: "UNKNOWN", 3: "INVALID_ARGUMENT", 4: "DEADLINE_EXCEEDED", 5: "NOT_FOUND", 6: "ALREADY_EXISTS", 7: "PERMISSION_DENIED", 8: "RESOURCE_EXHAUSTED", 9: "FAILED_PRECONDITION", 10: "ABORTED", 11: "OUT_OF_RANGE", 12: "UNIMPLEMENTED", 13: "INTERNAL", 14: "UNAVAILABLE", 15: "DATA_LOSS", 16: "UNAUTHENTICATED"}
CLOSE_CODES = {1000: "NORMAL_CLOSURE", 1001: "GOING_AWAY", 1002: "PROTOCOL_ERROR", 1003: "UNSUPPORTED_DATA", 1004: "RESERVED", 1005: "NO_STATUS_RECEIVED", 1006: "ABNORMAL_CLOSURE", 1007: "INVALID_FRAME_PAYLOAD_DATA", 1008: "POLICY_VIOLATION", 1009: "MESSAGE_TOO_BIG", 1010: "MANDATORY_EXTENSION", 1011: "INTERNAL_ERROR", 1012: "SERVICE_RESTART", 1013: "TRY_AGAIN_LATER", 1014: "BAD_GATEWAY", 1015: "TLS_HANDSHAKE"}


def _named(code: Column, names: dict[int, str], otherwise: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code.cast("int")), F.lit(otherwise))


def _last(value: Column, when: Column) -> Column:
    """The value of the last event of a kind."""
    return F.max_by(F.when(when, value), F.when(when, F.col("seq")))


def fold_calls(events: DataFrame) -> DataFrame:
    """Streaming calls: number of messages, last status (non-zero is an error), default codes 2 for errors and 1 for cancels,
    duration since the request."""
    e = F.col("event_type")
    code = F.when(e == "status", F.col("code")).when(e == "error", F.coalesce("code", F.lit(2))).when(e == "cancel", F.lit(1))
    start = F.min(F.when(e == "request", F.col("ts")))
    return events.groupBy("call_uid").agg(
        F.count_if(e == "message").alias("n_messages"),
        F.max_by(code, F.when(code.isNotNull(), F.col("seq"))).alias("code"),
        F.coalesce(F.max_by(code, F.when(code.isNotNull(), F.col("seq"))) != 0, F.lit(False)).alias("is_error"),
        F.round(F.max("ts").cast("timestamp").cast("double") - start.cast("timestamp").cast("double"), 3).alias("duration_s"),
    )


def call_details(events: DataFrame) -> DataFrame:
    """What streaming calls report beside their messages: metadata, trailers, the last status with its name and description, errors.

    ``events`` have ``code``, ``details`` and ``metadata`` (JSON) as well. A message with a code or details failed. A call has failed once
    it has an error, a failed message or a status other than 0, whatever comes after it; a cancel is no error.
    """
    e, code, details = F.col("event_type"), F.col("code"), F.nullif(F.col("details"), F.lit(""))
    bad = (e == "error") | (e.eqNullSafe(F.lit("message")) & (code.isNotNull() | details.isNotNull()))
    known = F.when(bad, F.coalesce(F.nullif(code, F.lit(0)), F.lit(2))).when(e == "status", code).when(e == "cancel", F.lit(1))
    name = _named(known, CALL_CODES, "UNKNOWN")
    ends = bad | e.isin("status", "cancel")
    fault = bad | ((e == "status") & ~code.eqNullSafe(F.lit(0)))
    default = F.when(e == "error", "Unknown gRPC error").when(e == "message", "gRPC error occurred").otherwise(F.concat(F.lit("gRPC error with code "), F.coalesce(code.cast("string"), F.lit("undefined")), F.lit(" ("), name, F.lit(")")))
    return events.groupBy("call_uid").agg(
        _last(known, ends).alias("code"),
        _last(name, ends).alias("status_text"),
        _last(F.when(e == "cancel", "Stream cancelled by client or server").otherwise(details), ends & (e != "message")).alias("description"),
        F.coalesce(F.bool_or(fault), F.lit(False)).alias("failed"),
        _last(F.coalesce(details, default), fault).alias("error"),
        _last(F.col("metadata"), e == "metadata").alias("metadata"),
        _last(F.col("metadata"), e.isin("status", "error") & F.col("metadata").isNotNull()).alias("trailers"),
    )


def fold_sockets(events: DataFrame) -> DataFrame:
    """Socket sessions: last status, messages, close code, and the kind of the close row (``error`` for 1000, else ``info``)."""
    e = F.col("event_type")
    state = F.when(e.isin("connecting", "open", "close", "error"), e)
    close = F.max_by(F.when(e == "close", F.col("code")), F.when(e == "close", F.col("seq")))
    return events.groupBy("call_uid").agg(
        F.max_by(state, F.when(state.isNotNull(), F.col("seq"))).alias("state"),
        F.count_if(e == "message").alias("n_messages"),
        close.alias("close_code"),
        F.when(close == 1000, "error").when(close.isNotNull(), "info").alias("close_row"),
    )


def socket_details(events: DataFrame) -> DataFrame:
    """Status, close reason, headers and error of socket sessions; an error holds until the next event of any kind.

    ``details`` is the close reason or the error's text; ``metadata`` the headers of a redirect (sent) or of an upgrade (received).
    """
    e, details = F.col("event_type"), F.nullif(F.col("details"), F.lit(""))
    moves = e.isin("connecting", "open", "close", "error")
    status = F.when(e == "connecting", "CONNECTING").when(e == "open", "CONNECTED").when(e == "close", "CLOSED").otherwise("ERROR")
    text = F.when(e == "close", _named(F.col("code"), CLOSE_CODES, "CLOSED")).otherwise(status)
    code = F.when(e == "open", 0).when(e == "close", F.col("code")).otherwise(1011)
    return events.groupBy("call_uid").agg(
        _last(status, moves).alias("status"),
        _last(text, moves).alias("status_text"),
        _last(code, moves & (e != "connecting")).alias("status_code"),
        _last(F.coalesce("details", F.lit("")), e == "close").alias("description"),
        F.coalesce(F.max_by(e, "seq") == "error", F.lit(False)).alias("failed"),
        F.when(F.max_by(e, "seq") == "error", _last(F.coalesce(details, F.lit("WebSocket error occurred")), e == "error")).alias("error"),
        _last(F.col("metadata"), e == "redirect").alias("request_headers"),
        _last(F.col("metadata"), e == "upgrade").alias("headers"),
    )


def socket_rows(events: DataFrame) -> DataFrame:
    """(call_uid, seq, kind, message): what a session shows, row by row. ``details`` is the text, the URL of an ``open`` or the reason of a ``close``.

    Messages and redirects keep their own ``kind``; the row of a normal close (1000) is an error, of any other ``info``.
    """
    e, details = F.col("event_type"), F.col("details")
    reason = F.trim(F.coalesce(details, F.lit("")))
    kind = F.when(e.isin("message", "redirect"), F.col("kind")).when(e == "open", "info").when(e == "close", F.when(F.col("code").eqNullSafe(F.lit(1000)), "error").otherwise("info")).otherwise("error")
    text = F.when(e.isin("message", "redirect"), details).when(e == "open", F.concat(F.lit("Connected to "), F.coalesce(details, F.lit("")))).when(e == "close", F.when(reason == "", "Closed").otherwise(F.concat(F.lit("Closed: "), reason))).otherwise(F.coalesce(F.nullif(details, F.lit("")), F.lit("WebSocket error occurred")))
    return events.where(e.isin("message", "redirect", "open", "close", "error")).select("call_uid", "seq", kind.alias("kind"), text.alias("message"))


def numbered_messages(events: DataFrame) -> DataFrame:
    """Message rows of calls and sockets, numbered in order of arrival: lists of any length stay rows."""
    return running(events.where("event_type = 'message'"), ["call_uid"], ["seq"], {"message_no": number()})


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Bytes and number of the chunks of each item."""
    return chunks.groupBy("item_uid").agg(F.sum(F.octet_length("data")).alias("n_bytes"), F.count("*").alias("n_chunks"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """Chunks with the running size of their item, in order of arrival."""
    return running(chunks, ["item_uid"], ["seq"], {"running_bytes": total(F.octet_length("data").cast("long"))})
