"""Durable batch ledger: one write per micro-batch carries markers and facts together.

Plain Parquet has no transaction over several tables. Therefore the accepted events of
micro-batch *n* of a streaming query are one overwrite of

    <root>/log/query_id=<id>/period=<n / PERIOD>/batch_id=<n>

and the idempotency markers, the order table and the minute table are all read from that
log. A crash before the write leaves nothing; a crash after it is repaired by the replay of
the same batch, which overwrites the same folder with the same rows. A batch looks for its
ids only in other folders, so a replay does not see its own rows as duplicates.

Compaction appends and never rewrites: it turns whole finished periods of a query into
segments, names them in ``covered``, which is written last, and empties their log folders.
Segments that ``covered`` does not name, and log folders that it does, are not read.

Markers of segments lie in a table bucketed and sorted by event id. A batch sends its ids to
the buckets; the stored side of that join is neither shuffled nor sorted, however many
batches it holds.

Writers are fenced. A writer claims the next epoch with a token, then seals what is visible
from earlier epochs. It checks before and after each batch that no newer claim exists. Rows
count if they carry the newest sealed token or lie below its seal, so a write that was under
way when another writer took over stays invisible, and its writer fails instead of
committing the batch. A claim that meets another one of its epoch goes on to the next epoch.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.dedup import first_occurrences
from ledgerline.plans.health import ADDITIVE, MINUTE_KEY, access_contributions, combine_minutes
from ledgerline.schemas import (
    DEAD_LETTER,
    LOG_METRICS_MINUTE,
    MONEY,
    PROCESSED_EVENTS,
    VALID_ORDERS,
)

_COMMON = [
    T.StructField("consumer_group", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("processed_at", T.TimestampType()),
]
ORDER_ROW = T.StructType(
    [
        *_COMMON,
        T.StructField("order_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)
ACCESS_ROW = T.StructType(
    [
        *_COMMON,
        T.StructField("service", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("response_time_ms", T.IntegerType()),
    ]
)
_COVERED = T.StructType(
    [T.StructField("query_id", T.StringType()), T.StructField("period", T.LongType())]
)
_BATCH_COLUMNS = [
    T.StructField("query_id", T.StringType()),
    T.StructField("period", T.LongType()),
    T.StructField("batch_id", T.LongType()),
]
_TOKEN = T.StructField("token", T.StringType())
#: A marker with the measures that came with the id, as a digest; NULL where none are compared.
_DIGEST = T.StructField("digest", T.StringType())
_MARKER = T.StructType([*PROCESSED_EVENTS.fields, _DIGEST])
_CLAIM = T.StructType(
    [_TOKEN, T.StructField("owner", T.StringType()), T.StructField("buckets", T.IntegerType()),
     T.StructField("epoch", T.LongType())]
)
_SEAL = T.StructType(
    [_TOKEN, T.StructField("query_id", T.StringType()), T.StructField("through_batch", T.LongType()),
     T.StructField("epoch", T.LongType())]
)

#: Batches of one query that compaction folds into one segment.
PERIOD = 100
#: Files over which the markers of a segment are spread by event id; fixed with the first claim.
BUCKETS = 16


class FencedWriterError(RuntimeError):
    """Another query has taken over the ledger."""


@dataclass(frozen=True)
class Ledger:
    """The log, dead letters and compacted segments of one event family under one folder."""

    spark: SparkSession
    root: str
    row_schema: T.StructType
    period: int = PERIOD
    buckets: int = BUCKETS
    _known: dict = field(default_factory=dict, compare=False, repr=False)

    # --- writers ---

    def claim(self, owner: str) -> str:
        """Take the ledger over for ``owner``; returns the token that its batches carry."""
        while True:
            epoch = (self._newest_claim() or (0,))[0] + 1
            token = uuid.uuid4().hex
            rows = [(token, owner, self._bucket_count(), epoch)]
            self._append("claims", self.spark.createDataFrame(rows, _CLAIM))
            if self._newest_claim() == (epoch, {token: owner}):
                self._seal(epoch, token)
                self._known["current"] = (epoch, [token])
                return token

    def check_owner(self, token: str) -> None:
        """Raise unless ``token`` holds the newest claim, alone."""
        epoch, claims = self._newest_claim() or (0, {})
        if set(claims) != {token}:
            others = ", ".join(sorted(owner for key, owner in claims.items() if key != token))
            raise FencedWriterError(
                f"ledger {self.root} was taken over by query {others or 'unknown'} (epoch {epoch}); "
                "a ledger takes one running query at a time"
            )

    def _seal(self, epoch: int, token: str) -> None:
        self._known.pop("current", None)
        through = self._visible(self._log()).groupBy("query_id").agg(F.max("batch_id").alias("through_batch"))
        named = self.spark.createDataFrame([(token, None, None, epoch)], _SEAL)
        found = through.select(F.lit(token).alias("token"), "query_id", "through_batch", F.lit(epoch).alias("epoch"))
        self._append("seals", named.unionByName(found))

    def _append(self, table: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").partitionBy("epoch").parquet(f"{self.root}/{table}")

    def _newest_claim(self) -> tuple[int, dict[str, str]] | None:
        """The newest epoch and its claims, one owner per token."""
        # one row per start of a query
        claims = self._read(f"{self.root}/claims", _CLAIM).select("epoch", "token", "owner").collect()
        if not claims:
            return None
        newest = max(row.epoch for row in claims)
        return newest, {row.token: row.owner for row in claims if row.epoch == newest}

    def _bucket_count(self) -> int:
        first = self._read(f"{self.root}/claims", _CLAIM).orderBy("epoch", "token").first()
        return self.buckets if first is None else first.buckets

    # --- writing ---

    def batch_path(self, kind: str, query_id: str, batch_id: int) -> str:
        period = batch_id // self.period
        return f"{self.root}/{kind}/query_id={query_id}/period={period}/batch_id={batch_id}"

    def write_batch(self, accepted: DataFrame, query_id: str, batch_id: int, token: str) -> None:
        rows = accepted.select(*self.row_schema.fieldNames(), _DIGEST.name, F.lit(token).alias("token"))
        rows.write.mode("overwrite").parquet(self.batch_path("log", query_id, batch_id))

    def write_dead_letters(self, letters: DataFrame, query_id: str, batch_id: int) -> None:
        path = self.batch_path("dead_letters", query_id, batch_id)
        letters.write.mode("overwrite").parquet(path)

    # --- reading ---

    def markers(self) -> DataFrame:
        """Every idempotency marker, compacted or not."""
        return self._stored_markers().unionByName(_markers_of(self._tail())).drop(_DIGEST.name)

    def seen(self, ids: DataFrame, consumer_group: str, query_id: str, batch_id: int) -> DataFrame:
        """(event_id, digest) of those ids that have a marker of the group from other batches.

        The batch's ids are dealt to exactly the buckets of the stored markers and hashed there. With
        Spark's own number of partitions the markers, all of them in every batch, would be dealt anew.
        """
        wanted = ids.select("event_id").repartition(self._bucket_count(), "event_id").distinct().hint("shuffle_hash")
        earlier = (F.col("query_id") != query_id) | (F.col("batch_id") < batch_id)

        def met(markers: DataFrame) -> DataFrame:
            own = markers.filter(F.col("consumer_group") == consumer_group)
            return own.select("event_id", _DIGEST.name).join(wanted, "event_id")

        found = met(self._stored_markers()).unionByName(met(_markers_of(self._tail().filter(earlier))))
        return found.groupBy("event_id").agg(F.min(_DIGEST.name).alias(_DIGEST.name))

    def valid_orders(self) -> DataFrame:
        return order_facts(self._tail()).unionByName(self._segments("orders", VALID_ORDERS))

    def log_metrics_minute(self) -> DataFrame:
        """Additive merge of the segments' minutes and the newer contributions."""
        minutes = _contributions(self._tail()).unionByName(self._segments("minutes", _MINUTE_PART))
        return combine_minutes(minutes).select(*LOG_METRICS_MINUTE.fieldNames())

    def dead_letters(self) -> DataFrame:
        """One letter per consumer group and original coordinate, the first that was written.

        Records that a new checkpoint delivers again are stored again, but not read twice.
        """
        letters = self._uncovered(self._folders("dead_letters", DEAD_LETTER))
        names = DEAD_LETTER.fieldNames()
        letters = letters.select(*names).unionByName(self._segments("letters", DEAD_LETTER))
        coordinate = ["original_topic", "original_partition", "original_offset"]
        return first_occurrences(letters, ["consumer_group", *coordinate], ["failed_at"])

    def dead_letters_of(self, query_id: str, batch_id: int) -> DataFrame:
        """The letters that one micro-batch wrote."""
        path = self.batch_path("dead_letters", query_id, batch_id)
        return self.spark.read.schema(DEAD_LETTER).parquet(path)

    # --- compaction ---

    def compact(self) -> None:
        """Fold finished periods into segments, also while the query runs.

        A period is finished when its query has written a batch of a later one, so the newest
        batch, the only one that a restart can replay, stays in the log. Only the folded
        periods are read; a repetition after a crash writes the same segments again.
        """
        tail = self._tail()
        newest = tail.groupBy("query_id").agg(F.max("period").alias("newest"))
        periods = (
            tail.select("query_id", "period").distinct().join(newest, "query_id")
            .filter(F.col("period") < F.col("newest")).select("query_id", "period").collect()
        )
        if not periods:
            return
        # periods finished since the last call: as a rule one
        chosen = self.spark.createDataFrame([tuple(row) for row in periods], _COVERED)
        rows = tail.join(F.broadcast(chosen), ["query_id", "period"], "left_semi")
        self._write_markers(rows)
        place = ("query_id", "period")
        if self.row_schema is ORDER_ROW:
            self._write_segments("orders", order_facts(rows, *place))
        else:
            self._write_segments("minutes", combine_minutes(_contributions(rows, *place), *place))
        letters = self._folders("dead_letters", DEAD_LETTER).join(F.broadcast(chosen), list(place), "left_semi")
        self._write_segments("letters", letters.select(*DEAD_LETTER.fieldNames(), *place))
        chosen.coalesce(1).write.mode("append").parquet(f"{self.root}/covered")
        for row in periods:
            self._empty("log", row.query_id, row.period)
            self._empty("dead_letters", row.query_id, row.period)

    def _write_segments(self, part: str, rows: DataFrame) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("query_id", "period").parquet(f"{self.root}/{part}")

    def _write_markers(self, rows: DataFrame) -> None:
        name = self._attach_markers()
        self._known.pop("segments", None)
        dealt = _markers_of(rows, "query_id", "period").repartition(self._bucket_count(), "event_id")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            dealt.select(*_MARKER.fieldNames(), "query_id", "period").write.insertInto(name, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def _empty(self, kind: str, query_id: str, period: int) -> None:
        """Replace a period's folders by nothing."""
        path = f"{self.root}/{kind}/query_id={query_id}/period={period}"
        nothing = self.spark.createDataFrame([], T.StructType([_TOKEN, _BATCH_COLUMNS[-1]]))
        nothing.write.mode("overwrite").partitionBy("batch_id").parquet(path)

    # --- helpers ---

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        """A stored table, empty where nothing is stored yet."""
        try:
            return self.spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _covered(self) -> DataFrame:
        return self._read(f"{self.root}/covered", _COVERED).distinct()

    def _folders(self, kind: str, schema: T.StructType, *more: T.StructField) -> DataFrame:
        return self._read(f"{self.root}/{kind}", T.StructType([*schema.fields, *more, *_BATCH_COLUMNS]))

    def _uncovered(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._covered(), ["query_id", "period"], "left_anti")

    def _log(self) -> DataFrame:
        return self._uncovered(self._folders("log", self.row_schema, _DIGEST, _TOKEN))

    def _visible(self, rows: DataFrame) -> DataFrame:
        """Rows of the newest sealed epoch and rows that its seal includes."""
        seals = self._read(f"{self.root}/seals", _SEAL)
        epoch, tokens = self._known.get("current") or _newest(seals)
        if epoch is None:
            return rows
        through = seals.filter((F.col("epoch") == epoch) & F.col("query_id").isNotNull())
        through = through.groupBy("query_id").agg(F.max("through_batch").alias("_through"))
        visible = F.col("token").isin(tokens) | (F.col("batch_id") <= F.coalesce("_through", F.lit(-1)))
        return rows.join(through, "query_id", "left").filter(visible).drop("_through")

    def _tail(self) -> DataFrame:
        """Visible log rows that no segment covers."""
        return self._visible(self._log())

    def _segments(self, part: str, schema: T.StructType) -> DataFrame:
        rows = self._read(f"{self.root}/{part}", T.StructType([*schema.fields, *_COVERED.fields]))
        rows = rows.join(self._covered(), ["query_id", "period"], "left_semi")
        return rows.select(*schema.fieldNames())

    def _attach_markers(self) -> str:
        """Declare the marker folder as an external table, so that Spark knows its buckets."""
        name = f"ledger_markers_{hashlib.md5(self.root.encode()).hexdigest()}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*_MARKER.fields, *_COVERED.fields])
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (query_id, period) "
            f"CLUSTERED BY (event_id) SORTED BY (event_id) INTO {self._bucket_count()} BUCKETS "
            f"LOCATION '{self.root}/markers'"
        )
        return name

    def _stored_markers(self) -> DataFrame:
        """Markers of covered segments, in their buckets; attached again after each compaction."""
        covered = self._covered()
        segments = covered.count()
        if not segments:
            return self.spark.createDataFrame([], _MARKER)
        if self._known.get("segments") != segments:
            self._known.update(segments=segments, name=self._attach_markers())
            self.spark.sql(f"MSCK REPAIR TABLE {self._known['name']}")
        rows = self.spark.table(self._known["name"])
        return rows.join(covered, ["query_id", "period"], "left_semi").select(*_MARKER.fieldNames())


_MINUTE_PART = T.StructType([f for f in LOG_METRICS_MINUTE.fields if f.name in
                             {*MINUTE_KEY, *ADDITIVE, "max_response_time_ms", "updated_at"}])


def _newest(seals: DataFrame) -> tuple[int | None, list[str]]:
    """The newest sealed epoch and its tokens; one row per start of a query and query sealed."""
    found = seals.select("epoch", "token").distinct().collect()
    newest = max((row.epoch for row in found), default=None)
    return newest, [row.token for row in found if row.epoch == newest]


def _markers_of(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "consumer_group",
        "event_id",
        "topic",
        F.col("partition").alias("partition_id"),
        F.col("offset").alias("offset_id"),
        "processed_at",
        _DIGEST.name,
        *more,
    )


def _contributions(rows: DataFrame, *more: str) -> DataFrame:
    flagged = access_contributions(rows.withColumn("updated_at", F.col("processed_at")))
    return flagged.select(*_MINUTE_PART.fieldNames(), *more)


def order_facts(rows: DataFrame, *more: str) -> DataFrame:
    """Map accepted order events to the stored table; absent payload fields stay NULL."""
    created = F.col("event_type") == "order_created"
    priced = F.col("event_type") != "order_cancelled"
    return rows.select(
        "event_id",
        "order_id",
        "event_type",
        "user_id",
        F.when(created, F.col("product_id")).alias("product_id"),
        F.when(created, F.col("quantity")).alias("quantity"),
        F.when(priced, F.col("amount")).alias("amount"),
        F.when(priced, F.col("currency")).alias("currency"),
        F.when(created, F.col("channel")).alias("channel"),
        "event_time",
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("processed_at").alias("created_at"),
        *more,
    )
