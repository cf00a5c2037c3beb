"""Streaming forms of the ledger jobs.

Each job maps a stream to a stream with built-in stateful operators; ``stateful`` has those that need state and timers
of their own. ``run_available`` drives a job over what has arrived and writes a table; the
checkpoint lies beside it in the shared folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursebank.operators import ledger as lg
from coursebank.sources.tables import DRIVER_SCHEMAS

c = F.col


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Event files of a folder as a stream. Watermarks need zoned times, so ``ts`` is read in the session's zone."""
    rows = spark.readStream.schema(DRIVER_SCHEMAS["events"]).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", c("ts").cast("timestamp"))


def plain_times(df: DataFrame) -> DataFrame:
    """Zoned times back as the zone-less ones that the tables hold."""
    zoned = [f.name for f in df.schema if f.dataType == T.TimestampType()]
    return df.withColumns({x: c(x).cast("timestamp_ntz") for x in zoned}) if zoned else df


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which timers need and which keeps large state out of the heap, for queries started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _drain(stream: DataFrame, folder: str, name: str, mode: str, write) -> None:
    """Run ``write(batch, batch_id)`` for everything that has arrived; a restarted query goes on where it stopped."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").queryName(name)
    with _state_store(stream.sparkSession):
        writer.trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def run_available(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Process all available input and return the written rows, with their batch number.

    Every micro-batch owns a directory that it overwrites, so a batch repeated after a failure leaves
    the same rows. In update mode a key can appear in several batches; the latest counts.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={batch_id}")

    _drain(stream, folder, name, mode, write)
    schema = T.StructType([*stream.schema, T.StructField("batch_no", T.IntegerType())])
    return plain_times(stream.sparkSession.read.schema(schema).parquet(out))


def latest_rows(updates: DataFrame, key: list[str]) -> DataFrame:
    """Last update of each key of an update-mode table."""
    rest = [x for x in updates.columns if x not in (*key, "batch_no")]
    last = updates.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_no").alias("r"))
    return last.select(*key, "r.*")


def dedupe_notices(notes: DataFrame, key: list[str], watermark: str, ts: str = "ts") -> DataFrame:
    """Notices without repetitions that arrive within the watermark."""
    return notes.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(key)


def settle_stream(notes: DataFrame, txn: DataFrame) -> DataFrame:
    """Orders settled by a stream of transfer notes against the stored orders, with the earliest fitting note (update mode).

    One row per order: a later batch can only move its ``ts`` back, and credits belong to the order, not to the
    emission, so write by ``code``. A note is honoured however late it comes, so state has no watermark: it holds
    one row per settled order.
    """
    fitting = lg.match_transfers(notes, txn).where(c("amount_fits") & (c("old_status") != "paid"))
    first = fitting.groupBy("code").agg(
        F.min(F.struct("ts", "note_id")).alias("first"), F.min("user_id").alias("user_id"), F.min("credits_added").alias("credits_added"))
    return first.select("code", "user_id", "credits_added", c("first.ts").alias("ts"))


MARKS = "max_us BIGINT, batch_no INT"


def settle_on_time(notes: DataFrame, txn: DataFrame, folder: str, name: str, delay_minutes: int = 60) -> None:
    """Settle a stream of transfer notes (note_id, ts, content, amount) batch by batch; late notes go to a side table.

    A note is late when its time lies more than ``delay_minutes`` before the latest time of earlier batches; one without
    a time is late. Every batch writes three directories of its own: the first fitting note per open order
    (``firsts``), the late notes as they came (``late``) and its latest time (``marks``). What it writes depends on
    earlier batches' marks alone, so a batch repeated after a failure leaves the same rows. No state is kept in between.
    """
    spark = notes.sparkSession
    slack = F.expr(f"INTERVAL {delay_minutes} MINUTE")

    def write(batch: DataFrame, batch_id: int) -> None:
        marks = spark.createDataFrame([], MARKS)
        if batch_id:
            marks = spark.read.schema(MARKS).parquet(f"{folder}/marks")
        mark = marks.where(c("batch_no") < batch_id).agg(F.max("max_us")).first()[0]
        late = c("ts").isNull()
        if mark is not None:
            late = late | (c("ts") < F.timestamp_micros(F.lit(mark)) - slack)
        part = f"batch_no={batch_id}"
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/{part}")
        first_notes(batch.where(~late), txn).write.mode("overwrite").parquet(f"{folder}/firsts/{part}")
        batch.agg(F.max(F.unix_micros("ts")).alias("max_us")).where("max_us IS NOT NULL").write.mode("overwrite").parquet(
            f"{folder}/marks/{part}")

    _drain(notes, folder, name, "append", write)


def first_notes(notes: DataFrame, txn: DataFrame) -> DataFrame:
    """First fitting note of each open order: code, user_id, credits_added, ts, note_id."""
    fitting = lg.match_transfers(notes, txn).where(c("amount_fits") & (c("old_status") != "paid"))
    first = fitting.groupBy("code").agg(F.min(F.struct("ts", "note_id")).alias("f"), F.any_value("user_id").alias("user_id"),
                                        F.any_value("credits_added").alias("credits_added"))
    return first.select("code", "user_id", "credits_added", "f.ts", "f.note_id")


def late_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The side table of ``settle_on_time``."""
    return plain_times(spark.read.schema("note_id BIGINT, ts TIMESTAMP, content STRING, amount DOUBLE, batch_no INT").parquet(f"{folder}/late"))


def reconcile(spark: SparkSession, folder: str, txn: DataFrame) -> DataFrame:
    """Orders settled by notes on time and by late ones: code, user_id, credits_added, ts, note_id, late.

    An order is settled once, by its earliest fitting note, however late that came; ``late`` says that it was in the
    side table. The result is a minimum per order over both tables, so running it again, or after further batches,
    merges late notes without granting credits twice.
    """
    schema = "code STRING, user_id BIGINT, credits_added BIGINT, ts TIMESTAMP, note_id BIGINT"
    on_time = plain_times(spark.read.schema(schema).parquet(f"{folder}/firsts")).drop("batch_no").withColumn("late", F.lit(False))
    late = first_notes(late_notes(spark, folder).drop("batch_no"), txn).withColumn("late", F.lit(True))
    rest = ("user_id", "credits_added", "ts", "note_id", "late")
    best = on_time.unionByName(late).groupBy("code").agg(F.min_by(F.struct(*rest), F.struct("ts", "note_id")).alias("r"))
    return best.select("code", *[f"r.{x}" for x in rest])


def expire_stream(orders: DataFrame, payments: DataFrame, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Orders (order_id, user_id, ts) without a payment (payment_id, user_id, ts) within ``minutes``.

    A stream-stream outer join: an order is given up once the watermark has passed its limit, so state
    holds one interval of orders and payments.
    """
    left = orders.select("order_id", c("user_id").alias("buyer"), c("ts").alias("ordered_at")).withWatermark("ordered_at", delay)
    right = payments.select("payment_id", "user_id", c("ts").alias("paid_at")).withWatermark("paid_at", delay)
    near = F.expr(f"buyer = user_id AND paid_at >= ordered_at AND paid_at <= ordered_at + INTERVAL {minutes} MINUTES")
    return left.join(right, near, "left_outer").where(c("payment_id").isNull()).select("order_id", c("buyer").alias("user_id"), "ordered_at")


def revenue_stream(payments: DataFrame, width: str, watermark: str) -> DataFrame:
    """Revenue per tumbling window (update mode emits a window whenever it changes)."""
    return lg.windowed_revenue(payments.withWatermark("ts", watermark), width)
