"""Replay, late data, crashes and compaction of the streaming consumers."""

import json
from datetime import UTC, datetime
from pathlib import Path

import pytest
from conftest import values
from pyspark.sql import functions as F

from ledgerline.functions.validation import ACCESS_LOGS, ORDERS, decode
from ledgerline.operators.dedup import conflicting_reuse, first_occurrences, pending
from ledgerline.plans.health import minute_metrics_from_access_events
from ledgerline.registry import queries
from ledgerline.registry.queries import all_queries
from ledgerline.schemas import RAW_RECORD
from ledgerline.sources.tables import record_file_stream
from ledgerline.streaming import ingest
from ledgerline.streaming.ledger import FencedWriterError, Ledger

ACCESS_JOB = ingest.Job(ACCESS_LOGS, "log-consumer")
ORDER_JOB = ingest.Job(ORDERS, "order-consumer")
CLOCK = "2026-08-06 00:00:00"


def uuid(n):
    return f"00000000-0000-0000-0000-{n:012d}"


def access(n, offset, *, time="2026-08-06T00:00:30Z", status=200, ms=10, endpoint="/a"):
    body = dict(event_id=uuid(n), event_type="api_access_log", event_time=time, source="s",
                payload=dict(request_id="R", service="api", endpoint=endpoint, http_method="GET",
                             status_code=status, response_time_ms=ms, client_ip="1.1.1.1"))
    return (b"api", json.dumps(body).encode(), "logs", 0, offset, None)


def order(n, offset, kind="order_cancelled", **payload):
    body = dict(event_id=uuid(n), event_type=kind, event_time="2026-08-06T00:00:00Z", source="s",
                payload=dict(order_id="O1", user_id="U1", **payload))
    return (b"O1", json.dumps(body).encode(), "orders", 0, offset, None)


class Consumer:
    """Feeds record files to a consumer and reads its ledger."""

    def __init__(self, spark, folder, job, period=100):
        self.spark, self.folder, self.job = spark, str(folder), job
        self.ledger = Ledger(spark, f"{self.folder}/ledger", job.row_schema, period, buckets=4)

    def send(self, *records):
        frame = self.spark.createDataFrame(list(records), RAW_RECORD).coalesce(1)
        frame.write.mode("append").parquet(f"{self.folder}/records")

    def start(self, checkpoint="main", **options):
        stream = record_file_stream(self.spark, f"{self.folder}/records")
        return ingest.start(stream, self.job, f"{self.folder}/ledger",
                            f"{self.folder}/checkpoint-{checkpoint}", period=self.ledger.period, **options)

    def run(self, checkpoint="main"):
        self.start(checkpoint, available_now=True).awaitTermination()

    def minutes(self):
        return values(self.ledger.log_metrics_minute().drop("updated_at"))


@pytest.fixture
def logs(spark, tmp_path):
    return Consumer(spark, tmp_path, ACCESS_JOB)


@pytest.fixture
def folding(spark, tmp_path):
    """A consumer that folds every batch as soon as the next one is there."""
    return Consumer(spark, tmp_path, ACCESS_JOB, period=1)


def minute(endpoint, *counts, hour=0):
    return (datetime(2026, 8, 6, hour, 0), "api", endpoint, *counts)


def test_upsert_replay_late_event_and_compaction(logs):
    logs.send(access(1, 0, ms=10), access(2, 1, status=404, ms=20))
    logs.run()
    assert logs.minutes() == [minute("/a", 2, 1, 1, 0, 30, 20)]
    logs.send(access(3, 2, status=500, ms=30), access(1, 3, ms=10))
    logs.run()
    total = [minute("/a", 3, 1, 1, 1, 60, 30)]
    assert logs.minutes() == total
    logs.run("from-the-start")
    assert logs.minutes() == total
    logs.send(access(4, 4, time="2026-08-05T23:00:59Z", ms=5))
    logs.run()
    late = (datetime(2026, 8, 5, 23, 0), "api", "/a", 1, 1, 0, 0, 5, 5)
    assert logs.minutes() == [late, *total]
    logs.ledger.compact()
    assert logs.minutes() == [late, *total]
    logs.send(access(1, 9, ms=10), access(5, 10, ms=40))
    logs.run()
    grown = [late, minute("/a", 4, 2, 1, 1, 100, 40)]
    assert logs.minutes() == grown
    logs.ledger.compact()
    assert logs.minutes() == grown
    assert logs.ledger.markers().count() == 5


def test_conflicting_reuse_goes_to_dead_letters_and_exact_copies_do_not(logs):
    logs.send(access(1, 5, ms=10), access(1, 6, ms=10), access(1, 7, ms=11),
              access(2, 8, endpoint="/b"), access(2, 4, endpoint="/c"))
    logs.run()
    assert logs.minutes() == [minute("/a", 1, 1, 0, 0, 10, 10), minute("/c", 1, 1, 0, 0, 10, 10)]
    letters = values(logs.ledger.dead_letters(), "original_offset", "error_type")
    assert letters == [(7, "DuplicateEventConflict"), (8, "DuplicateEventConflict")]
    markers = values(logs.ledger.markers(), "event_id", "offset_id")
    assert markers == [(uuid(1), 5), (uuid(2), 4)]


def test_dead_letters_are_read_once_after_a_new_checkpoint_and_reach_the_sink(spark, tmp_path):
    consumer = Consumer(spark, tmp_path, ACCESS_JOB)
    consumer.send(access(1, 0), (b"k", b"{", "logs", 0, 1, None), (b"k", b"[]", "logs", 0, 2, None))
    sent = []
    stream = record_file_stream(spark, f"{consumer.folder}/records")
    query = ingest.start(stream, ACCESS_JOB, f"{consumer.folder}/ledger", f"{consumer.folder}/first",
                         available_now=True, dead_letter_sink=lambda letters: sent.append(letters.count()))
    query.awaitTermination()
    assert sent == [2]
    consumer.run("again")
    assert values(consumer.ledger.dead_letters(), "original_offset") == [(1,), (2,)]
    assert consumer.ledger.markers().count() == 1


def test_flush_interval_runs_until_stopped(spark, tmp_path):
    consumer = Consumer(spark, tmp_path, ACCESS_JOB)
    consumer.send(access(1, 0))
    stream = record_file_stream(spark, f"{consumer.folder}/records")
    query = ingest.start(stream, ACCESS_JOB, f"{consumer.folder}/ledger", f"{consumer.folder}/timed",
                         flush_interval="1 second")
    try:
        query.processAllAvailable()
        consumer.send(access(2, 1))
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert consumer.ledger.markers().count() == 2


def test_every_record_is_processed_duplicate_or_dead(logs):
    logs.send(access(1, 0), access(1, 1), access(2, 2, status=700), (b"k", b"{", "logs", 0, 3, None))
    logs.run()
    assert logs.ledger.markers().count() == 1
    assert values(logs.ledger.dead_letters(), "original_offset", "error_type") == [
        (2, "ValidationError"), (3, "JSONDecodeError")
    ]


def test_crash_after_the_write_is_repaired_by_replay(spark, tmp_path, monkeypatch):
    consumer = Consumer(spark, tmp_path, ORDER_JOB)
    created = dict(product_id="P", quantity=1, amount="9.50", currency="TWD", channel="web")
    consumer.send(order(1, 0, "order_created", **created),
                  order(2, 1, cancellation_reason="x"), order(2, 2, cancellation_reason="x"))
    write = Ledger.write_batch

    def write_then_crash(self, *args):
        write(self, *args)
        raise RuntimeError("executor and driver lost")

    monkeypatch.setattr(Ledger, "write_batch", write_then_crash)
    with pytest.raises(Exception, match="lost"):
        consumer.run()
    monkeypatch.setattr(Ledger, "write_batch", write)
    consumer.run()
    consumer.run("from-the-start")
    found = values(consumer.ledger.valid_orders(), "event_id", "event_type", "product_id",
                   "currency", "kafka_offset")
    assert found == [
        (uuid(1), "order_created", "P", "TWD", 0), (uuid(2), "order_cancelled", None, None, 1)
    ]


def log_files(consumer, kind="log"):
    found = Path(f"{consumer.folder}/ledger/{kind}").rglob("part-*.parquet")
    return {str(path.parent.relative_to(f"{consumer.folder}/ledger/{kind}")) for path in found}


def test_compaction_appends_segments_and_empties_their_folders(folding):
    logs = folding
    stored = lambda: {
        p: p.stat().st_mtime_ns for p in Path(f"{logs.folder}/ledger/markers").rglob("*.parquet")
    }
    for n in range(3):
        logs.send(access(n, n, ms=n), (b"k", b"{", "logs", 0, 100 + n, None))
        before = stored()
        logs.run()
    assert before and before.items() < stored().items()
    assert {p.split("/", 1)[1] for p in log_files(logs)} == {"period=2/batch_id=2"}
    assert len(log_files(logs, "dead_letters")) == 1
    assert logs.minutes() == [minute("/a", 3, 3, 0, 0, 3, 2)]
    logs.ledger.compact()
    assert logs.ledger.markers().count() == logs.ledger.dead_letters().count() == 3
    logs.send(access(1, 50, ms=1), access(8, 51, ms=0))
    logs.run("from-the-start")
    assert logs.ledger.markers().count() == 4
    assert logs.ledger.dead_letters().count() == 3


def test_unfinished_compaction_is_ignored(folding, monkeypatch):
    logs = folding
    logs.send(access(0, 0))
    logs.run()
    logs.send(access(1, 1))

    def crash(self, *args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "_write_segments", crash)  # markers are written, minutes are not
        with pytest.raises(Exception, match="lost"):
            logs.run()
    total = [minute("/a", 2, 2, 0, 0, 20, 10)]
    assert logs.minutes() == total and logs.ledger.markers().count() == 2
    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "_empty", crash)  # covered is written, folders are still there
        with pytest.raises(RuntimeError, match="lost"):
            logs.ledger.compact()
    assert logs.minutes() == total and logs.ledger.markers().count() == 2
    logs.run()
    assert logs.minutes() == total and logs.ledger.markers().count() == 2


def test_stored_markers_are_neither_shuffled_nor_sorted(spark, tmp_path):
    """4,000 markers in 50 segments: a batch shuffles its ids to the buckets, not the history."""
    rows = spark.range(4000).select(
        F.lit("log-consumer").alias("consumer_group"), F.concat(F.lit("e"), "id").alias("event_id"),
        F.lit("api_access_log").alias("event_type"), F.lit(CLOCK).cast("timestamp").alias("event_time"),
        F.lit("logs").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.lit(CLOCK).cast("timestamp").alias("processed_at"), F.lit("api").alias("service"),
        F.lit("/a").alias("endpoint"), F.lit(200).alias("status_code"), F.lit(1).alias("response_time_ms"),
        F.lit("d").alias("digest"), F.lit("t").alias("token"),
        F.lit("q").alias("query_id"), (F.col("id") % 51).alias("period"), (F.col("id") % 51 * 2).alias("batch_id"),
    )
    ledger = Ledger(spark, f"{tmp_path}/ledger", ACCESS_JOB.row_schema, 2, buckets=4)
    rows.repartition("period").write.partitionBy("query_id", "period", "batch_id").parquet(f"{ledger.root}/log")
    ledger.compact()
    ids = spark.range(3990, 4010).select(F.concat(F.lit("e"), "id").alias("event_id"))
    seen = ledger.seen(ids, "log-consumer", "other", 0)
    assert seen.count() == 10
    plan = seen._jdf.queryExecution().executedPlan().toString()
    stored = plan[: plan.index("Bucketed: true")]
    assert "Exchange" not in stored[stored.rindex("ShuffledHashJoin") :].replace("BroadcastExchange", "")
    assert "Sort [" not in stored[stored.rindex("ShuffledHashJoin") :]


def test_more_partitions_than_buckets_leave_the_stored_markers_in_place(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")  # four times the buckets
    try:
        test_stored_markers_are_neither_shuffled_nor_sorted(spark, tmp_path)
    finally:
        spark.conf.set(name, before)


def test_a_conflict_with_an_earlier_batch_is_a_dead_letter(folding):
    logs = folding
    logs.send(access(1, 0, ms=10), access(2, 1))
    logs.run()
    logs.send(access(10, 10))  # with this batch the markers of the first one are compacted
    logs.run()
    logs.send(access(1, 20, ms=10), access(1, 21, ms=11), access(2, 22, endpoint="/b"),
              access(10, 23, ms=9), access(3, 24))
    logs.run()
    letters = values(logs.ledger.dead_letters(), "original_offset", "error_type")
    assert letters == [(n, "DuplicateEventConflict") for n in (21, 22, 23)]
    assert logs.ledger.markers().count() == 4


def test_a_second_query_takes_the_ledger_over_and_the_first_fails(spark, tmp_path):
    consumer = Consumer(spark, tmp_path, ACCESS_JOB)
    consumer.send(access(1, 0))
    first = consumer.start("first", flush_interval="1 second")
    first.processAllAvailable()
    consumer.run("second")
    consumer.send(access(2, 1))
    with pytest.raises(Exception, match="was taken over by query"):
        first.awaitTermination(60)
        first.processAllAvailable()
    consumer.run("second")
    consumer.run("first")
    assert consumer.ledger.markers().count() == 2
    assert consumer.minutes() == [minute("/a", 2, 2, 0, 0, 20, 10)]


def test_a_write_under_way_at_a_takeover_stays_invisible(spark, tmp_path, monkeypatch):
    """Both queries take the same id; the slower one is fenced between its check and its write."""
    consumer = Consumer(spark, tmp_path, ACCESS_JOB)
    ledger = consumer.ledger
    records = spark.createDataFrame([access(1, 0), access(2, 1)], RAW_RECORD)
    slow = ledger.claim("slow")
    write = Ledger.write_batch

    def overtaken(self, accepted, query_id, batch_id, token):
        if query_id == "slow":
            fast = self.claim("fast")
            ingest.persist_batch(records.limit(1), 0, ACCESS_JOB, self, "fast", fast)
        write(self, accepted, query_id, batch_id, token)

    with monkeypatch.context() as patch:
        patch.setattr(Ledger, "write_batch", overtaken)
        with pytest.raises(FencedWriterError, match="taken over by query fast"):
            ingest.persist_batch(records, 0, ACCESS_JOB, ledger, "slow", slow)
    assert values(ledger.markers(), "event_id") == [(uuid(1),)]
    again = ledger.claim("slow")
    ingest.persist_batch(records, 0, ACCESS_JOB, ledger, "slow", again)
    assert values(ledger.markers(), "event_id") == [(uuid(1),), (uuid(2),)]
    assert consumer.minutes() == [minute("/a", 2, 2, 0, 0, 20, 10)]


def test_two_claims_of_one_epoch_give_way(spark, tmp_path, monkeypatch):
    ledger = Consumer(spark, tmp_path, ACCESS_JOB).ledger
    first = ledger.claim("a")
    append = Ledger._append

    def race(self, table, rows):
        monkeypatch.setattr(Ledger, "_append", append)
        append(self, table, rows)
        append(self, table, rows.withColumn("token", F.lit("rival")).withColumn("owner", F.lit("c")))

    monkeypatch.setattr(Ledger, "_append", race)
    token = ledger.claim("b")
    ledger.check_owner(token)
    for fenced in (first, "rival"):
        with pytest.raises(FencedWriterError):
            ledger.check_owner(fenced)


def test_stream_equals_batch(spark, logs):
    records = [access(n % 40, n, ms=n % 40, status=200 + 100 * (n % 40 % 4)) for n in range(120)]
    for start in range(0, 120, 40):
        logs.send(*records[start:start + 40])
        logs.run()
    decoded = decode(spark.createDataFrame(records, RAW_RECORD), ACCESS_LOGS)
    accepted = ingest.resolve(decoded, ACCESS_JOB, None, F.lit(datetime.now(UTC))).accepted
    batch = minute_metrics_from_access_events(accepted.withColumn("updated_at", F.col("processed_at")))
    assert logs.minutes() == values(batch.drop("updated_at"))


def test_markers_are_scoped_to_their_group(rows):
    schema = "consumer_group string, event_id string"
    records = rows([dict(consumer_group=g, event_id=e) for g in "ab" for e in "12"], schema)
    seen = rows([dict(consumer_group="a", event_id="1")], schema)
    assert values(pending(records, seen)) == [("a", "2"), ("b", "1"), ("b", "2")]


def test_hot_id_collapses_before_the_shuffle_and_all_conflicts_are_found(spark):
    copies = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("event_id"),
        F.col("id").alias("offset"),
        F.when(F.col("id") % 30 == 0, F.lit("x")).otherwise(F.lit("y")).alias("value"),
    )
    firsts = first_occurrences(copies, ["event_id"], ["offset"])
    assert firsts.count() == 2001
    assert firsts.filter("event_id = 'hot'").first().offset == 0
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    conflicts = conflicting_reuse(copies, ["event_id"], ["offset"], ["value"])
    assert conflicts.count() == 900
    assert {row.value for row in conflicts.select("value").distinct().collect()} == {"y"}


def test_conflicts_repeat_no_key_and_are_never_broadcast(spark):
    """Each of 500 ids conflicts: its first value is joined once, unless the id has too many rows for one task."""
    copies = spark.range(2000).selectExpr("CAST(id % 500 AS STRING) AS event_id", "id AS offset",
                                          "CAST(id DIV 500 AS STRING) AS value")

    def plan_of(**options):
        found = conflicting_reuse(copies, ["event_id"], ["offset"], ["value"], **options)
        assert sorted(row.offset for row in found.collect()) == list(range(500, 2000))
        return found._jdf.queryExecution().executedPlan()

    def generated(plan):
        """Rows that the salts of the keys make."""
        nodes, made = [plan], []
        while nodes:
            node = nodes.pop()
            name = node.nodeName()
            if name == "AdaptiveSparkPlan":
                nodes.append(node.executedPlan())
            elif name.endswith("QueryStage"):
                nodes.append(node.plan())
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
            if name == "Generate":
                made.append(node.metrics().apply("numOutputRows").value())
        return made

    plan = plan_of()
    assert generated(plan) == [500]
    assert "BroadcastHashJoin" not in plan.toString().split("Initial Plan")[0]
    assert generated(plan_of(hot=1)) == [2000]


def test_bounded_minutes_run_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame(
        [("a", datetime(2026, 8, 6, 0, 0, 5), "s", "/e", 200, 4),
         ("a", datetime(2026, 8, 6, 0, 0, 5), "s", "/e", 200, 4),
         ("b", datetime(2026, 8, 6, 0, 0, 59), "s", "/e", 500, 6)],
        "event_id string, event_time timestamp, service string, endpoint string, status_code int, "
        "response_time_ms int",
    )
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = (ingest.bounded_minutes(stream, "10 minutes").writeStream.outputMode("update")
             .format("memory").queryName("bounded").trigger(availableNow=True)
             .option("checkpointLocation", f"{tmp_path}/cp").start())
    query.awaitTermination()
    row = spark.table("bounded").first()
    assert (row.request_count, row.success_count, row.server_error_count) == (2, 1, 1)
    assert (row.response_time_sum_ms, row.max_response_time_ms) == (10, 6)


@pytest.mark.parametrize("name", ["ingest_access_dead_letters", "ingest_access_outcomes"])
def test_plans_of_resolved_records_hold_no_copy_of_the_rules(spark, capsys, name):
    all_queries()[name](spark, "/root/testdata/sf0.001").explain()
    assert len(capsys.readouterr().out) < 20_000  # one copy of the rules alone is longer


def test_dead_letters_of_bounded_batches_equal_those_of_one(spark, monkeypatch):
    monkeypatch.setattr(queries, "BATCH_BYTES", 1)  # a file a batch
    monkeypatch.setattr(queries, "FILE_RECORDS", 600)
    found = all_queries()["stream_access_dead_letters"](spark, "/root/testdata/sf0.001")
    plain = all_queries()["ingest_access_dead_letters"](spark, "/root/testdata/sf0.001")
    assert values(found) == values(plain)


@pytest.mark.parametrize("streamed, plain", [
    ("stream_log_metrics_minute", "ingest_log_metrics_minute"), ("stream_valid_orders", "ingest_valid_orders"),
])
def test_streams_of_many_batches_equal_one_batch(spark, monkeypatch, streamed, plain):
    """A reused id keeps its first coordinate however the records are cut into batches."""
    batches, persist = [], ingest.persist_batch
    monkeypatch.setattr(ingest, "persist_batch", lambda *given, **names: batches.append(given[1]) or persist(*given, **names))
    monkeypatch.setattr(queries, "BATCH_BYTES", 1)  # a file a batch
    monkeypatch.setattr(queries, "FILE_RECORDS", 250)
    found = all_queries()[streamed](spark, "/root/testdata/sf0.001")
    wanted = all_queries()[plain](spark, "/root/testdata/sf0.001")
    assert values(found) == values(wanted.select(*found.columns))
    assert max(batches) >= 3
