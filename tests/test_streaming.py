"""Streams over split files give what the batch jobs give."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import traffic as T
from orrery.plans import traffic_queries as Q
from orrery.plans import views as V
from orrery.streaming import folds as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def replay(spark, tmp_path):
    """Feed a table as a stream of files in order of seq, and give the sink's rows."""

    def run(df, job, mode="update", parts=3, shuffled=False):
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        n = df.count()
        if shuffled:
            for i in range(parts):
                df.where(F.pmod(F.xxhash64("seq"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        cuts = [r["seq"] for r in df.orderBy("seq").select("seq").collect()]
        for i in range(0 if shuffled else parts):
            low, high = cuts[i * n // parts], cuts[min((i + 1) * n // parts, n - 1)]
            part = df.where((F.col("seq") >= low) & ((F.col("seq") < high) if i < parts - 1 else F.lit(True)))
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = []
        writer = job(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, i: out.extend((i, r.asDict()) for r in batch.collect())).start().awaitTermination()
        return out

    return run


def latest(rows, *key):
    got = {}
    for i, r in sorted(rows, key=lambda x: (x[0], x[1].get("n_events", 0))):
        got[tuple(r[k] for k in key)] = r
    return got


@pytest.mark.parametrize("shuffled", [False, True])
def test_run_fold(spark, replay, shuffled):
    events = V.run_events(spark, SF)
    got = latest(replay(events, lambda e: S.run_fold(e, "1000 days"), shuffled=shuffled, parts=5), "run_id", "item_uid", "occurrence")
    want = {(r["run_id"], r["item_uid"], r["occurrence"]): r.asDict() for r in T.fold_run(T.attach_to_queued(events)).collect()}
    assert got == want


@pytest.mark.parametrize("shuffled", [False, True])
def test_request_fold(spark, replay, shuffled):
    """One row an item, whatever the order: the sink has no rule but that the last row of an item holds."""
    events = V.run_events(spark, SF)
    got = latest(replay(events, lambda e: S.request_fold(e, "1000 days"), shuffled=shuffled), "item_uid")
    want = {(r["item_uid"],): r.asDict() for r in T.fold_requests(events).collect()}
    assert got == want and want


def test_late_event_of_an_older_request(spark, replay):
    rows = [(1, 7, 1, "request-queued"), (2, 7, 1, "request-sent"), (4, 7, 2, "request-queued"), (5, 7, 2, "request-sent"), (3, 7, 1, "error"), (6, 7, 2, "response-received")]
    events = spark.createDataFrame(rows, "seq long, item_uid long, request_uid long, event_type string").withColumns({"ts": F.timestamp_seconds(F.col("seq")), "value": F.lit(1.0), "payload": F.lit("p"), "run_id": F.lit("r")})
    out = replay(events.withColumn("place", F.col("seq")), S.request_fold, parts=3, shuffled=True)
    last = latest(out, "item_uid")[7,]
    assert (last["request_uid"], last["state"], last["n_events"]) == (2, "received", 3)
    assert latest(out, "item_uid").keys() == {(7,)}


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    t = V.traffic(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    half = t.where("seq % 2 = 0")
    half.write.parquet(f"{tmp_path}/in")
    stream = lambda: S.live_counts(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"))
    counts = lambda df: {("method", r["method"]): r["n"] for r in T.method_counts(df).collect()} | {("log", r["log_type"]): r["n"] for r in T.log_counts(df).collect()}
    table = lambda: {(r["kind"], r["name"]): r["n"] for r in S.run_to_end(stream(), f"{tmp_path}/out", ["kind", "name"]).collect()}
    assert table() == counts(half)
    t.where("seq % 2 = 1").write.mode("append").parquet(f"{tmp_path}/in")
    assert table() == counts(t) and table() == counts(t)


@pytest.mark.parametrize("shuffled", [False, True])
def test_call_totals(spark, replay, shuffled):
    rows = Q.call_rows(spark, SF, Q.CALL_KINDS, F.when(F.col("event_type") == "click", F.col("event_id") % 3))
    got = latest(replay(rows, lambda e: S.call_totals(e, "1000 days"), shuffled=shuffled), "call_uid")
    want = {(r["call_uid"],): r for r in T.fold_calls(rows).collect()}
    assert got.keys() == want.keys() and all(r[c] == want[k][c] for k, r in got.items() for c in r)


@pytest.mark.parametrize("shuffled", [False, True])
def test_socket_totals(spark, replay, shuffled):
    rows = Q.call_rows(spark, SF, Q.SOCKET_KINDS, F.when(F.col("event_type") == "purchase", 1000 + F.col("event_id") % 2))
    got = latest(replay(rows, lambda e: S.socket_totals(e, "1000 days"), shuffled=shuffled), "call_uid")
    want = {(r["call_uid"],): r for r in T.fold_sockets(rows).collect()}
    assert got.keys() == want.keys() and all(r[c] == want[k][c] for k, r in got.items() for c in r)


def test_counters_and_chunks(spark, replay):
    t = V.traffic(spark, SF)
    counts = {(r["kind"], r["name"]): r["n"] for _, r in replay(t, S.live_counts)}
    assert counts == {("method", r["method"]): r["n"] for r in T.method_counts(t).collect()} | {("log", r["log_type"]): r["n"] for r in T.log_counts(t).collect()}


def test_chunk_totals(spark, replay):
    t = V.traffic(spark, SF).withColumnRenamed("body", "data")
    got = latest(replay(t, S.chunk_totals), "item_uid")
    assert {k[0]: (r["n_bytes"], r["n_chunks"]) for k, r in got.items()} == {r["item_uid"]: (r["n_bytes"], r["n_chunks"]) for r in T.chunk_totals(t).collect()}
