"""Structured Streaming forms of the folds and counters. They agree with the batch jobs on data inside the watermark.

The watermark is ours and only bounds state. Events are folded in order of ``seq``, whatever batches bring them, and state holds counters and last
values, never whole messages.

``run_to_end`` runs such a stream over what its source has and keeps its rows in a table: the last row of a key is its value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.traffic import method_of

RUN_OUTPUT = "run_id string, item_uid long, occurrence long, status string, response_value double, assertions string, n_events long, n_errors long"
RUN_STATE = "kept string"
STATUS_RANK = ["queued", "running", "completed", "error"]
#: Event type to the least status it brings.
BRINGS = {"request-queued": "queued", "request-sent": "running", "response-received": "completed", "error": "error"}
DAY_MS = 86_400_000


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _forget_after(state: GroupState, last_ms: int) -> None:
    """A key is forgotten when the watermark is a day past its last event."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last_ms) + DAY_MS)


def _occurrences(base: list | None, events: list[list]) -> tuple[dict[int, list], list | None]:
    """Occurrences of an item after ``base`` and events in order of seq: each starts at a request-queued event. And the open one."""
    rows: dict[int, list] = {}
    current = list(base) if base else None
    for seq, _, kind, value, payload in events:
        if kind == "request-queued":
            current = [seq, "queued", None, None, 0, 0]
        if current is None:
            continue
        new = BRINGS.get(kind)
        if new and STATUS_RANK.index(new) > STATUS_RANK.index(current[1]):
            current[1] = new
        if kind == "response-received":
            current[2] = value
        elif kind == "assertion-results":
            current[3] = payload
        current[4] += 1
        current[5] += kind == "error"
        rows[current[0]] = list(current)
    return rows, current


def _fold_item(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of all occurrences that a batch changed.

    Events are held until the watermark has passed them and folded in order of seq each time, so batches may bring them in any order; what
    lies before the watermark is kept as the one open occurrence.
    """
    if state.hasTimedOut:
        state.remove()
        return
    base, held = json.loads(state.get[0]) if state.exists else (None, [])
    before, _ = _occurrences(base, held)
    for batch in batches:
        for e in batch.itertuples(index=False):
            kept = e.event_type == "assertion-results"
            held.append([int(e.seq), _ms(e.ts), e.event_type, None if pd.isna(e.value) else float(e.value), e.payload if kept else None])
    held.sort(key=lambda e: e[0])
    last = max((e[1] for e in held), default=0)
    after, _ = _occurrences(base, held)
    passed = next((i for i, e in enumerate(held) if e[1] >= state.getCurrentWatermarkMs()), len(held))
    _, base = _occurrences(base, held[:passed])
    state.update((json.dumps([base, held[passed:]]),))
    _forget_after(state, last)
    changed = [row for seq, row in after.items() if before.get(seq) != row]
    if changed:
        yield pd.DataFrame([[*key, *row] for row in changed], columns=[c.split()[0] for c in RUN_OUTPUT.split(", ")])


def run_fold(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Run events folded per (run, item, occurrence), in update mode: the last row of an occurrence is its result."""
    return events.withWatermark("ts", delay).groupBy("run_id", "item_uid").applyInPandasWithState(_fold_item, RUN_OUTPUT, RUN_STATE, "update", GroupStateTimeout.EventTimeTimeout)


REQUEST_OUTPUT = "item_uid long, request_uid long, state string, sent_at timestamp, n_events long"
REQUEST_STATE = "kept string"
REQUEST_RANK = ["queued", "sending", "received", "error"]
REQUEST_BRINGS = {"request-queued": "queued", "request-sent": "sending", "response-received": "received", "error": "error"}


def _fold_request(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The current request of an item: that of the greatest seq. Queued is void once it is sending; a response may precede the sending.

    Events of other requests are stale and never shown. What they amount to is kept until the watermark has passed them, as one of them may
    turn out to be the current one, in whatever order batches bring them; then they are void.
    """
    if state.hasTimedOut:
        state.remove()
        return
    # by request: state, sent at (microseconds), events, greatest seq, last time (milliseconds)
    requests = json.loads(state.get[0]) if state.exists else {}
    for batch in batches:
        for e in batch.itertuples(index=False):
            now = requests.setdefault(str(e.request_uid), [None, None, 0, -1, 0])
            new = REQUEST_BRINGS.get(e.event_type)
            if new and (now[0] is None or REQUEST_RANK.index(new) > REQUEST_RANK.index(now[0])):
                now[0] = new
            if e.event_type == "request-sent":
                at = int(pd.Timestamp(e.ts).value // 1000)
                now[1] = at if now[1] is None else min(now[1], at)
            now[2:] = [now[2] + 1, max(now[3], int(e.seq)), max(now[4], _ms(e.ts))]
    current = max(requests, key=lambda r: requests[r][3])
    mark = state.getCurrentWatermarkMs()
    state.update((json.dumps({r: x for r, x in requests.items() if r == current or x[4] >= mark}),))
    _forget_after(state, max(x[4] for x in requests.values()))
    status, sent, n = requests[current][:3]
    yield pd.DataFrame([[*key, int(current), status, None if sent is None else pd.Timestamp(sent, unit="us"), n]], columns=[c.split()[0] for c in REQUEST_OUTPUT.split(", ")])


def request_fold(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The current request of each item in update mode, one row an item; stale events change nothing."""
    return events.withWatermark("ts", delay).groupBy("item_uid").applyInPandasWithState(_fold_request, REQUEST_OUTPUT, REQUEST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def _totals(events: DataFrame, key: str, output: str, kept: str, step: Callable[[list, pd.DataFrame], list], delay: str) -> DataFrame:
    """Totals by ``key`` in update mode: ``step`` adds a batch's events, ordered by seq, to what is kept. A key that has been silent for
    a day behind the watermark is forgotten, so state doesn't grow for ever."""
    names, size = [c.split()[0] for c in output.split(", ")], len(kept.split(", "))
    dtypes = {c.split()[0]: "Int64" for c in output.split(", ") if c.split()[1] in ("int", "long") and c.split()[0] != key}

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events = pd.concat(batches).sort_values("seq")
        current = step(list(state.get) if state.exists else [None] * size, events)
        state.update(tuple(current))
        _forget_after(state, _ms(events["ts"].max()))
        yield pd.DataFrame([[*group, *current][: len(names)]], columns=names).astype(dtypes)

    return events.withWatermark("ts", delay).groupBy(key).applyInPandasWithState(fold, output, kept, "update", GroupStateTimeout.EventTimeTimeout)


def _add_call(now: list, events: pd.DataFrame) -> list:
    n, code, code_seq = now[0] or 0, now[1], now[2]
    for kind, given, seq in events[["event_type", "code", "seq"]].itertuples(index=False):
        n += kind == "message"
        given = None if pd.isna(given) else int(given)
        new = {"status": given, "error": 2 if given is None else given, "cancel": 1}.get(kind)
        if new is not None and (code_seq is None or seq > code_seq):
            code, code_seq = new, int(seq)
    return [int(n), code, code_seq]


def call_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages and last code of streaming calls."""
    return _totals(events, "call_uid", "call_uid string, n_messages long, code long", "n_messages long, code long, code_seq long", _add_call, delay)


def _add_socket(now: list, events: pd.DataFrame) -> list:
    n, state, close, state_seq, close_seq = now[0] or 0, *now[1:]
    for kind, code, seq in events[["event_type", "code", "seq"]].itertuples(index=False):
        n += kind == "message"
        if kind in ("connecting", "open", "close", "error") and (state_seq is None or seq > state_seq):
            state, state_seq = kind, int(seq)
        if kind == "close" and (close_seq is None or seq > close_seq):
            close, close_seq = None if pd.isna(code) else int(code), int(seq)
    return [int(n), state, close, state_seq, close_seq]


def socket_totals(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages, last state and close code of socket sessions."""
    return _totals(events, "call_uid", "call_uid string, n_messages long, state string, close_code long", "n_messages long, state string, close_code long, state_seq long, close_seq long", _add_socket, delay)


def chunk_totals(chunks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Bytes and number of the chunks of each item; the bytes are measured before they leave the JVM."""
    sizes = chunks.select("item_uid", "ts", "seq", F.octet_length("data").cast("long").alias("n"))
    step = lambda now, part: [int((now[0] or 0) + part["n"].sum()), int((now[1] or 0) + len(part))]
    return _totals(sizes, "item_uid", "item_uid long, n_bytes long, n_chunks long", "n_bytes long, n_chunks long", step, delay)


def live_counts(traffic: DataFrame) -> DataFrame:
    """Requests by method and logs by type, one row each."""
    return traffic.select(F.explode(F.array(F.struct(F.lit("method").alias("kind"), method_of(F.col("method")).alias("name")), F.struct(F.lit("log").alias("kind"), F.col("log_type").alias("name")))).alias("c")).groupBy("c.kind", "c.name").agg(F.count("*").alias("n"))


def run_to_end(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Process all that the source of ``rows`` has now, and give the table under ``path`` as it then stands: one row a key.

    Each batch is written to a folder of its number, in place of what an attempt cut short has left there, and the checkpoint lies beside
    them; so a run that is started again goes on where it stopped, and counts nothing twice.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return current_rows(spark, path, rows.schema, key)


def current_rows(spark: SparkSession, path: str, schema, key: list[str]) -> DataFrame:
    """The last row of each key."""
    kept = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    values = [c for c in schema.names if c not in key]
    last = kept.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return last.select(*key, "row.*")
