"""Streams against their batch forms, with input that arrives in several files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coursebank.operators import ledger as lg
from coursebank.session import shared_folder
from coursebank.streaming import ledger_stream as ls
from coursebank.streaming import stateful as sl

T0 = datetime(2024, 1, 1)


def stream_of(spark, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    folder = shared_folder(spark, "input")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_revenue_windows(spark):
    schema = "ts timestamp, amount bigint"
    batches = [[(T0 + timedelta(minutes=7 * i + 60 * b), 10 + i) for i in range(12)] for b in range(3)]
    stream = ls.revenue_stream(stream_of(spark, batches, schema), "1 hour", "5 hours")
    got = ls.latest_rows(ls.run_available(stream, shared_folder(spark, "t"), "t1", "update"), ["window_start"])
    want = lg.windowed_revenue(spark.createDataFrame(sum(batches, []), schema), "1 hour")
    want = ls.plain_times(want)
    assert sorted(map(tuple, got.select("window_start", "n", "revenue").collect())) == sorted(map(tuple, want.collect()))


def test_orders_settle_once_over_batches(spark):
    txn = spark.createDataFrame(
        [(str(i), i, 1000, 5, "paid" if i == 3 else "pending") for i in range(6)],
        "order_code string, user_id bigint, amount_vnd bigint, credits_added bigint, status string")
    schema = "note_id bigint, ts timestamp, content string, amount double"
    batches = [[(i + 10 * b, T0 + timedelta(minutes=i + b), f"DH {i}", 1000.0 + 5000 * (i == 4)) for i in range(6)] for b in range(3)]
    # Far later and late notes of a settled order change nothing but an earlier time.
    batches += [[(40, T0 + timedelta(days=102), "DH 1", 1000.0), (41, T0 - timedelta(days=1), "DH 2", 1000.0)]]
    updates = ls.run_available(ls.settle_stream(stream_of(spark, batches, schema), txn), shared_folder(spark, "t"), "t2", "update")
    got = ls.latest_rows(updates, ["code"])
    want = ls.plain_times(lg.settle_transfers(spark.createDataFrame(sum(batches, []), schema), txn).where("outcome = 'settled'"))
    assert sorted((r.code, r.ts) for r in got.collect()) == sorted((r.code, r.ts) for r in want.collect())
    assert sorted(r.code for r in got.collect()) == ["0", "1", "2", "5"]


DELETION = "event_id bigint, ts timestamp, email string, kind string, request_id bigint"


def deletions(spark, batches, **options):
    stream = sl.deletion_stream(stream_of(spark, batches, DELETION), **options)
    return sl.latest_deletions(ls.run_available(stream, shared_folder(spark, "t"), "t3", "update"))


def asks(i, minutes, email="A@x ", kind="request", of=None):
    return (i, T0 + timedelta(minutes=minutes), email, kind, of)


def test_deletion_cooldown_and_confirmation(spark):
    batches = [[asks(1, 0), asks(2, 5), asks(9, 0, "no at sign"), asks(10, 0, None)],
               [asks(3, 14), asks(4, 14, kind="confirm", of=1), asks(5, 15), asks(6, 15, "b@x")],
               [asks(7, 20, kind="confirm", of=2), asks(8, 16), asks(11, 17, kind="confirm", of=1)],
               [asks(100, 10_000, "later@x")]]
    got = {r.event_id: (r.accepted, r.confirmed_at) for r in deletions(spark, batches, delay="30 minutes").collect()}
    # 3 and the confirmation of 1 share a time; the confirmation comes first.
    at14 = T0 + timedelta(minutes=14)
    assert got == {1: (True, at14), 2: (False, None), 3: (True, None), 5: (False, None), 6: (True, None), 8: (False, None)}


def test_deletion_stream_equals_batch(spark):
    """Several files, out of order within the delay, with confirmations in time, too late and of refused requests."""
    import random

    rng, rows, t = random.Random(4), [], 0
    for i in range(0, 600, 2):
        t += rng.choice([0, 1, 4, 9, 20, 60])
        mail = f"U{rng.randrange(3)}@x"
        rows.append(asks(i, t, mail))
        if rng.random() < 0.6:
            later = rng.choice([0, 1, 3, 10, 47 * 60, 49 * 60])
            rows.append(asks(i + 1, t + later, mail, "confirm", i))
            if rng.random() < 0.2:
                rows.append(asks(10_000 + i, t + later + 1, mail, "confirm", i))
    rows.sort(key=lambda r: (r[1], r[0]))
    for lo in range(0, len(rows), 5):  # arrival is shuffled over a few rows
        rows[lo:lo + 5] = rng.sample(rows[lo:lo + 5], len(rows[lo:lo + 5]))
    size = len(rows) // 6 + 1
    batches = [rows[lo:lo + size] for lo in range(0, len(rows), size)] + [[asks(99_999, 500_000, "end@x")]]
    got = deletions(spark, batches, delay="6 hours")
    plain = spark.createDataFrame(rows, DELETION).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = lg.deletion_requests(plain)
    names = ["event_id", "email", "accepted", "created_at", "expires_at", "confirmed_at"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert 20 < want.where("confirmed_at IS NOT NULL").count() < want.where("accepted").count() < want.count()


def test_first_confirmation_in_time_counts(spark):
    rows = [asks(1, 10), asks(2, 5, kind="confirm", of=1), asks(3, 20, kind="confirm", of=1)]
    df = spark.createDataFrame(rows, DELETION).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert lg.deletion_requests(df).first().confirmed_at == T0 + timedelta(minutes=20)


JOB = "job_id bigint, ts timestamp, seq bigint, percent int, phase string, done boolean"


def job(i, minutes, percent, done, seq=0):
    return (i, T0 + timedelta(minutes=minutes), seq, percent, f"at {percent}", done)


def test_jobs_expire(spark):
    batches = [[job(1, 0, 10, False), job(2, 0, 50, False), job(3, 1, 100, True), job(5, 2, 100, True)],
               [job(1, 2, 100, True), job(2, 1, 60, None), job(5, 1, 0, False), job(4, 30, 5, False)],
               [job(4, 40, 100, True), job(2, 40, 70, False, 2), job(2, 40, 65, False, 1), job(6, 41, 100, True)],
               [job(7, 51, 1, False)]]
    stream = sl.job_board(stream_of(spark, batches, JOB), keep=10, delay="1 minute")
    folder, out = shared_folder(spark, "t"), []
    with ls._state_store(spark):
        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True)
        run = run.foreachBatch(lambda b, i: out.extend((i, *r) for r in b.collect())).start()
        run.awaitTermination()
    latest = {}
    for r in sorted(out, key=lambda r: (r[0], r[-1])):
        latest[r[1]] = r
    # The watermark ends at 50 minutes: job 4, done at 40, is still shown, as in the batch job at that time.
    shown = {k: r[3] for k, r in latest.items() if not r[-1]}
    rows = spark.createDataFrame(sum(batches, []), JOB).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert shown == {r.job_id: r.percent for r in lg.job_status(rows, str(T0 + timedelta(minutes=50))).collect()}
    assert set(shown) == {2, 4, 6, 7}
    kept = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert kept[-1] < max(kept)


def test_job_without_done_is_running(spark):
    rows = [(1, T0, 0, 5, "a", None), (2, T0, 0, 5, "a", True)]
    df = spark.createDataFrame(rows, JOB).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.job_id for r in lg.job_status(df, "2024-02-01 00:00:00").collect()] == [1]


NOTE = "note_id bigint, ts timestamp, content string, amount double"


def test_late_notes_settle_once(spark):
    txn = spark.createDataFrame(
        [(str(i), i, 1000, 5, "paid" if i == 3 else "pending") for i in range(6)],
        "order_code string, user_id bigint, amount_vnd bigint, credits_added bigint, status string")

    def note(i, minutes, code, amount=1000.0):
        return (i, None if minutes is None else T0 + timedelta(minutes=minutes), f"DH {code}", amount)

    batches = [[note(1, 0, 1), note(2, 300, 2)], [note(3, 10, 4), note(4, 5, 2), note(5, 290, 0), note(6, 1, 3)],
               [note(7, 400, 4), note(8, 11, 5, 9.0), note(9, None, 5)]]
    folder, source = shared_folder(spark, "t"), shared_folder(spark, "input")
    for rows in batches:
        spark.createDataFrame(rows, NOTE).coalesce(1).write.mode("append").parquet(source)
        ls.settle_on_time(spark.readStream.schema(NOTE).parquet(source), txn, folder, "t7")
    assert sorted(r.note_id for r in ls.late_notes(spark, folder).collect()) == [3, 4, 6, 8, 9]
    first = sorted(map(tuple, ls.reconcile(spark, folder, txn).collect()))
    plain = ls.plain_times(spark.createDataFrame(sum(batches, []), NOTE))
    want = {(r.code, r.note_id) for r in lg.settle_transfers(plain, txn).where("outcome = 'settled'").collect()}
    assert {(r[0], r[4]) for r in first} == want
    assert {r[0]: r[5] for r in first} == {"0": False, "1": False, "2": True, "4": True, "5": True}
    # A batch that is repeated after a failure overwrites its own rows.
    again = shared_folder(spark, "t")
    for _ in range(2):
        ls.settle_on_time(spark.readStream.schema(NOTE).parquet(source), txn, f"{again}", "t8")
    assert len({r[0] for r in ls.reconcile(spark, again, txn).collect()}) == len(want)


def test_duplicate_notices(spark):
    schema = "note_id bigint, ts timestamp"
    batches = [[(1, T0), (2, T0)], [(1, T0), (3, T0)]]
    once = ls.dedupe_notices(stream_of(spark, batches, schema), ["note_id"], "1 hour")
    got = ls.run_available(once, shared_folder(spark, "t"), "t4")
    assert sorted(r.note_id for r in got.collect()) == [1, 2, 3]


def test_restart_goes_on(spark):
    schema = "ts timestamp, amount bigint"
    folder, source = shared_folder(spark, "t"), shared_folder(spark, "input")
    for day in range(2):
        spark.createDataFrame([(T0 + timedelta(days=day), 1)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = ls.revenue_stream(spark.readStream.schema(schema).parquet(source), "1 day", "1 day")
        updates = ls.run_available(stream, folder, f"t5{day}", "update")
    assert ls.latest_rows(updates, ["window_start"]).agg(F.sum("n")).first()[0] == 2
